"""Words of a batch of texts, found and hashed by whole-array operations on UTF-8 bytes."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64) + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a column of texts; null counts as empty."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of flagged bytes inside one text."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(member) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate(([False], member[:-1]))
    starts = np.flatnonzero(member & (~before | first[:-1]))
    after = np.concatenate((member[1:], [False]))
    ends = np.flatnonzero(member & (~after | first[1:])) + 1
    return starts, ends


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), 0xD6E8FEB86659FD93, np.uint64))
    values = _BYTE_VALUES[data[place + np.repeat(starts, size)]] * powers[place]
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64))


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text each run lies in."""
    return np.searchsorted(offsets, starts, "right") - 1
