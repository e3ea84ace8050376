"""SentencePiece encoding and decoding with the N best segmentations.

The vocabulary's scores make a lattice of pieces over a text. Forward, Viterbi
gives the best score up to every place. Backward, A-star expands partial
segmentations from the end; the forward scores are their exact remaining cost,
so complete ones leave the queue best first, and the N first are the N best.

No piece of these vocabularies holds the space mark after another character
(checked when a vocabulary is read), so each path of the lattice passes the
places before a run of spaces, and any place whose two neighbours stand side by
side in no piece. The lattice is solved between these places and solutions are
remembered per word; the N best of a text are the N best sums, exactly. A character without a piece becomes its bytes at the penalty of an
unknown piece. Texts are encoded whole, in Arrow batches, without a shuffle.

Defined results: a null or empty text has one segmentation of no pieces, with
score 0. Spaces are never changed; a space mark in the text itself is encoded
as bytes, so decoding gives back every text exactly. Fewer than N segmentations
give fewer. Ties go to the segmentation that comes first in queue order, alike
at each run. Rows repeated or without an id are encoded each.
"""

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from duecheck.llm.common import small_batches
from duecheck.llm.words import text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
SPACE = "▁"
_UNKNOWN_PENALTY = 10.0
_CACHE_WORDS = 400_000
#: Words up to such lengths are solved together, padded to the next one; candidates of one such array at most.
_WIDTHS = (4, 6, 8, 10, 12, 15, 20, 28, 40)
_CELLS = 1 << 20
_ODD = re.compile(f" +[^ {SPACE}]*|[^ {SPACE}]+|{SPACE}")

_RANK = itemgetter(0, 1, 2)

Segmentation = tuple[float, tuple[int, ...]]


@dataclass
class Vocabulary:
    """Pieces with ids and scores; ids of single bytes; the score of an unknown character."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: float
    text_of: list[bytes | None] = field(repr=False)

    @classmethod
    def read(cls, path: str = MODEL) -> "Vocabulary":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, text_of = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                text_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text_of.append(None)
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"{piece!r} holds a space after another character")
                pieces[piece] = (i, model.get_score(i))
                text_of.append(piece.replace(SPACE, " ").encode())
        if not all(byte_ids):
            raise ValueError("the vocabulary has no bytes to fall back on")
        least = min(s for _, s in pieces.values() if s > -1e8)
        return cls(pieces, byte_ids, least - _UNKNOWN_PENALTY, text_of)

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 18


class PieceTable:
    """Ids and scores of pieces by the hash of their characters, for whole arrays of candidates at once."""

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        self.longest = max(map(len, pieces))
        names, keys = list(pieces), np.zeros(len(pieces), np.uint64)
        sizes = np.array(list(map(len, names)))
        for size in np.unique(sizes):
            same = np.flatnonzero(sizes == size)
            text = "".join([names[i] for i in same])
            keys[same] = self._hash(np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64))
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        found = list(pieces.values())
        ids, scores = np.array([i for i, _ in found], np.int32), np.array([s for _, s in found])
        self.shift, self.slots = np.uint64(64 - _SLOT_BITS), []
        left = np.arange(len(keys))
        while len(left):  # each round holds the first piece of every slot, the next round the rest
            place = (keys[left] >> self.shift).astype(np.int64)
            _, first = np.unique(place, return_index=True)
            own = left[first]
            size = 1 << _SLOT_BITS
            key, number, score = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.full(size, -np.inf)
            key[place[first]], number[place[first]], score[place[first]] = keys[own], ids[own], scores[own]
            self.slots.append((key, number, score))
            left = np.delete(left, first)

    @staticmethod
    def extend(key: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = (key ^ code) * _FACTOR
        return key ^ (key >> np.uint64(29))

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        key = np.full(len(codes), 7, np.uint64)
        for i in range(codes.shape[1]):
            key = self.extend(key, codes[:, i])
        return key * _FACTOR

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of hashed candidates; -inf where there is no such piece."""
        key = key * _FACTOR
        place = (key >> self.shift).astype(np.int64)
        ids, scores = np.zeros(len(key), np.int32), np.full(len(key), -np.inf)
        left = np.arange(len(key))
        for keys, number, score in self.slots:
            seen = keys[place[left]]
            same = seen == key[left]
            hit = left[same]
            ids[hit], scores[hit] = number[place[hit]], score[place[hit]]
            left = left[~same & (seen != 0)]
        return ids, scores


class Lattice:
    """N-best segmentations by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST) -> None:
        self.v, self.n = vocabulary, n
        # a piece, or None for what only begins one
        self.begun: dict[str, tuple[int, float] | None] = {p[:i]: None for p in vocabulary.pieces for i in range(1, len(p))}
        self.begun.update(vocabulary.pieces)
        self.joined = {p[i : i + 2] for p in vocabulary.pieces for i in range(len(p) - 1)}
        self.table = PieceTable(vocabulary.pieces)
        self.words: dict[str, tuple] = {}
        self.parts: dict[str, tuple] = {}
        self.several: dict[str, list[Segmentation]] = {}

    def as_bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.v.byte_ids[b] for b in text.encode())

    def solve(self, text: str, n: int) -> list[Segmentation]:
        """The n best segmentations of a text whose spaces are marks: forward Viterbi, backward A-star."""
        size, begun, nothing = len(text), self.begun, ()
        edges: list[list[tuple]] = [[] for _ in range(size + 1)]
        best = [0.0] + [-np.inf] * size
        for start in range(size):
            here = best[start]
            single = False
            for end in range(start + 1, size + 1):
                piece = begun.get(text[start:end], nothing)
                if not piece:
                    if piece is nothing:
                        break
                    continue
                single = single or end == start + 1
                edges[end].append((start, piece[1], piece[0]))
                if here + piece[1] > best[end]:
                    best[end] = here + piece[1]
            if not single:
                end, score = start + 1, self.v.unknown
                edges[end].append((start, score, self.as_bytes(text[start].replace(SPACE, " "))))
                if here + score > best[end]:
                    best[end] = here + score
        # (whole score, -place, order of arrival, score behind the place, pieces behind it). Each entry stands for the
        # best way to complete it, no two for the same, so only as many as are still wanted need to stay.
        # Among equals the one nearest to the start goes on, or ties would be followed in all their number.
        queue: list[tuple] = [(best[size], -size, 0, 0.0, None)]
        arrivals, out = 0, []
        while queue and len(out) < n:
            whole, place, _, behind, rest = queue.pop()
            if place == 0:
                out.append((whole, self._ids(rest)))
                continue
            free = n - len(out) - len(queue)
            least = -np.inf if free > 0 else queue[0][0]
            for start, score, found in edges[-place]:
                score += behind
                if best[start] + score >= least:
                    arrivals -= 1
                    queue.append((best[start] + score, -start, arrivals, score, (found, rest)))
            queue.sort(key=_RANK)
            del queue[: len(out) - n]
        return out

    @staticmethod
    def _ids(rest) -> tuple[int, ...]:
        out: list[int] = []
        while rest is not None:
            found, rest = rest
            out += found if isinstance(found, tuple) else (found,)
        return tuple(out)

    def _cuts(self, marked: str) -> list[str]:
        """Parts between which no piece reaches: no piece holds the two characters next to the cut."""
        joined, out, last = self.joined, [], 0
        for i in range(1, len(marked)):
            if marked[i - 1 : i + 1] not in joined:
                out.append(marked[last:i])
                last = i
        out.append(marked[last:])
        return out

    def _word(self, marked: str) -> tuple[bytes, float, float, str]:
        """(ids of the best as bytes, its score, loss of the second best, the word)."""
        found = self.parts.get(marked)
        if found is None:
            parts = self._cuts(marked) if len(marked) > 1 else [marked]
            if marked == "":  # a literal space mark
                found = (np.asarray(self.as_bytes(SPACE), "<i4").tobytes(), self.v.unknown, np.inf, marked)
            elif len(parts) > 1:
                each = [self._word(p) for p in parts]
                found = (b"".join([e[0] for e in each]), sum(e[1] for e in each), min(e[2] for e in each), marked)
            else:
                solved = self.solve(marked, min(self.n, 2))
                gap = solved[0][0] - solved[1][0] if len(solved) > 1 else np.inf
                found = (array("i", solved[0][1]).tobytes(), solved[0][0], gap, marked)
                self.parts[marked] = found
        return found

    def _learn(self, words: set[str]) -> None:
        """Solve new words together, by ranges of length: forward and backward Viterbi over arrays of words.

        The second best path has an edge off the best one, so its score is the
        best score through any such edge: forward + edge + backward.
        """
        by_width: dict[int, list[str]] = {}
        for w in words:
            if len(w) < _WIDTHS[-1]:
                by_width.setdefault(_WIDTHS[bisect_left(_WIDTHS, len(w) + 1)], []).append(w)
            else:
                self.words[w] = self._word(SPACE + w)
        for width, similar in by_width.items():
            most = _CELLS // (width * width)
            for low in range(0, len(similar), most):
                self._solve_together(similar[low : low + most], width)

    def _solve_together(self, words: list[str], size: int) -> None:
        """Words of up to ``size`` characters with their mark. What pads a word lies behind its end, where no path of it goes."""
        n = len(words)
        text = "".join([(SPACE + w).ljust(size, "\0") for w in words])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(n, size).T.astype(np.uint64)
        own_end, each_word = np.array([len(w) + 1 for w in words]), np.arange(n)
        ids: dict[tuple, np.ndarray] = {}
        scores: dict[tuple, np.ndarray] = {}
        for start in range(size):
            key = np.full(n, 7, np.uint64)
            for end in range(start + 1, min(size, start + self.table.longest) + 1):
                key = self.table.extend(key, codes[end - 1])
                found, score = self.table.look_up(key)
                if end == start + 1:
                    found[score == -np.inf] = -1
                    score[score == -np.inf] = self.v.unknown
                elif score.max() == -np.inf:
                    continue
                ids[start, end], scores[start, end] = found, score
        ahead, back = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        ahead[0], back[own_end, each_word] = 0, 0
        origin, piece = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int32)
        for start, end in sorted(scores, key=lambda e: e[1]):
            new = ahead[start] + scores[start, end]
            better = new > ahead[end]
            np.copyto(ahead[end], new, where=better)
            np.copyto(origin[end], start, where=better)
            np.copyto(piece[end], ids[start, end], where=better)
        for start, end in sorted(scores, reverse=True):
            np.maximum(back[start], scores[start, end] + back[end], out=back[start])
        used = np.zeros((size + 1, n), bool)
        used[own_end, each_word] = True
        for end in range(size, 0, -1):
            rows = np.flatnonzero(used[end])
            used[origin[end][rows], rows] = True
        second = np.full(n, -np.inf)
        for (start, end), score in scores.items():
            through = ahead[start] + score + back[end]
            through[used[end] & (origin[end] == start)] = -np.inf
            np.maximum(second, through, out=second)
        rows, ends = np.nonzero(used[1:].T)
        flat = piece[ends + 1, rows].astype("<i4")
        cuts = (np.searchsorted(rows, np.arange(n + 1)) * 4).tolist()
        score = ahead[own_end, each_word]
        raw, total, gap = flat.tobytes(), score.tolist(), (score - second).tolist()
        unknown = set(rows[flat == -1].tolist())
        for i, w in enumerate(words):
            marked, own = SPACE + w, slice(cuts[i], cuts[i + 1])
            best = raw[own]
            if i in unknown:
                places = range(own.start // 4, own.stop // 4)
                each = [(flat[k],) if flat[k] >= 0 else self.as_bytes(marked[ends[k]].replace(SPACE, " ")) for k in places]
                best = array("i", [x for e in each for x in e]).tobytes()
            self.words[w] = (best, total[i], gap[i], marked)

    def encode_all(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """The N best (score, ids as little-endian 32-bit integers) of each whole text."""
        if len(self.words) > _CACHE_WORDS:
            self.words.clear()
        for kept in (self.parts, self.several):
            if len(kept) > _CACHE_WORDS:
                kept.clear()
        split = [None if _irregular(t) else t.split(" ") for t in texts]
        self._learn(set().union(*(w for w in split if w)) - self.words.keys())
        return [self._best(t, words) if t else [(0.0, b"")] for t, words in zip(texts, split, strict=True)]

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        return self.encode_all([text])[0]

    def _best(self, text: str, plain: list[str] | None) -> list[tuple[float, bytes]]:
        if plain is not None:
            words = list(map(self.words.__getitem__, plain))
        else:
            parts = _ODD.findall(" " + text)
            words = [self._word("" if p == SPACE else p.replace(" ", SPACE)) for p in parts]
        ids, scores, gaps, _ = zip(*words)
        total = float(sum(scores))
        # Only the n - 1 words that lose least can differ from their best among the n best sums.
        open_ = np.argsort(np.array(gaps), kind="stable")[: self.n - 1]  # ties: the first word
        sums: list[tuple[float, dict[int, tuple]]] = [(0.0, {})]
        for w in map(int, open_):
            if gaps[w] == np.inf:
                break
            own = tuple(array("i", ids[w]))
            marked = words[w][3]
            if marked not in self.several:
                self.several[marked] = self.solve(marked, self.n)
            others = [(words[w][1], own)] + [x for x in self.several[marked] if x[1] != own]
            more = [
                (lost + words[w][1] - score, chosen | ({w: found} if k else {}))
                for lost, chosen in sums
                for k, (score, found) in enumerate(others[: self.n])
            ]
            sums = sorted(more, key=lambda x: x[0])[: self.n]
        out = []
        for lost, chosen in sums:
            parts = ids if not chosen else list(ids)
            for w, found in chosen.items():
                parts[w] = array("i", found).tobytes()
            out.append((total - lost, b"".join(parts)))
        return out


def _irregular(text: str) -> bool:
    """Whether the words of a text are not simply what stands between single spaces."""
    return not text or text[0] == " " or text[-1] == " " or "  " in text or SPACE in text


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    """The text of pieces; controls are silent, bytes that are no text become U+FFFD."""
    text = b"".join([vocabulary.text_of[i] or b"" for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


class Decoder:
    """Texts of whole arrays of pieces: bytes are gathered from one table, no piece is touched on its own."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        texts = [t or b"" for t in vocabulary.text_of]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start and end of each text) of the pieces between consecutive ``cuts``; a leading space is left out."""
        size = self.size[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(upto[-1]) + np.repeat(self.start[ids] - upto[:-1], size)
        data = self.data[place]
        start, end = upto[cuts[:-1]], upto[cuts[1:]]
        some = np.flatnonzero(end > start)
        start[some] += data[start[some]] == ord(" ")
        return data, start, end


def _same(data: np.ndarray, start: np.ndarray, end: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each decoded text is, byte for byte, the text of the column."""
    held, offsets = text_bytes(texts)
    raw, own = data.tobytes(), held.tobytes()
    ends = zip(start.tolist(), end.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())
    return np.fromiter((raw[a:b] == own[c:d] for a, b, c, d in ends), bool, len(start))


SEGMENTATIONS = ArrayType(StructType([StructField("score", DoubleType()), StructField("ids", ArrayType(IntegerType()))]))


def encode(
    docs: DataFrame,
    model: str = MODEL,
    n: int = N_BEST,
    name: str = "segmentations",
    round_trip: str | None = None,
    without: Sequence[str] = (),
) -> DataFrame:
    """``docs`` with its N best segmentations, best first, as a further column, which must be new.

    ``round_trip`` names a further column that tells whether decoding the best
    one gives the text back; columns named in ``without`` are not returned.
    """
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary.read(model)
    kept = [f for f in docs.schema.fields if f.name not in without]
    checked = [StructField(round_trip, BooleanType())] if round_trip else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = Lattice(vocabulary, n), Decoder(vocabulary)  # the lattice's memory of words ends with the task
        for batch in batches:
            texts = batch.column("text")
            found = lattice.encode_all([t or "" for t in texts.to_pylist()])
            flat = [x for f in found for x in f]
            pieces = np.frombuffer(b"".join([x for _, x in flat]), np.int32)
            cuts = np.cumsum([0] + [len(x) // 4 for _, x in flat])
            ids = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(pieces))
            scores = pa.array([s for s, _ in flat], pa.float64())
            each = pa.StructArray.from_arrays([scores, ids], ["score", "ids"])
            firsts = np.cumsum([0] + [len(f) for f in found])
            columns = [batch.column(f.name) for f in kept] + [pa.ListArray.from_arrays(firsts.astype(np.int32), each)]
            if round_trip:
                best = [f[0][1] for f in found]
                ends = np.cumsum([0] + [len(x) // 4 for x in best])
                decoded = decoder.decode(np.frombuffer(b"".join(best), np.int32), ends)
                columns.append(pa.array(_same(*decoded, texts)))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + [name] + [f.name for f in checked])

    return docs.mapInArrow(rows, StructType([*kept, StructField(name, SEGMENTATIONS), *checked]))


def decode(pieces: DataFrame, ids: str, model: str = MODEL, name: str = "decoded") -> DataFrame:
    """``pieces`` with the text of the id lists in column ``ids``; a null list stays null."""
    small_batches(pieces.sparkSession, 256)
    vocabulary = Vocabulary.read(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
            data, start, end = decoder.decode(flat.astype(np.int64), cuts)
            raw = data.tobytes()
            texts = [
                raw[a:b].decode("utf-8", "replace") if there else None
                for a, b, there in zip(start.tolist(), end.tolist(), lists.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return pieces.mapInArrow(rows, StructType([*pieces.schema.fields, StructField(name, StringType())]))
