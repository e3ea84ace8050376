"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives FEATURES numbers, from its characters and words alone. They are
binned by quantiles. Training goes round the features: on the gradient of the
log loss summed by bin, a tree of depth two is grown and a small part of it is
added to that feature's table. Then the pairs with most gradient left get
two-way tables in the same manner. A score is the sum of table entries, one per
feature and pair, through the logistic function.

Training reads at most ``max_rows`` labelled rows (the rows with the smallest
hash of their id, 40,000 as a rule), on the driver: at most
40,000 x FEATURES numbers. Scoring reads every text whole and shuffles nothing.

Defined results: null and empty texts have the features of a text of no words
and are scored like others. Labels other than 0 and 1, or null, are ignored.
Without a label, or with one kind only, the score is the share of ones, 0.5 if
there are none. Rows without an id or repeated are scored each.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from duecheck.llm import words
from duecheck.llm.common import small_batches

FEATURES = [
    "log_bytes", "log_words", "letters", "upper", "digits", "spaces", "newlines", "marks", "symbols", "bars",
    "bangs", "wide", "word_length", "long_words", "distinct", "top_word", "repeats", "repeated_pairs",
    "upper_words", "symbol_words", "bare_symbols", "words_a_line", "repeated_lines", "ends",
]
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, RIDGE = 64, 8, 10, 120, 0.1, 2.0
MAX_ROWS = 40_000
THRESHOLD = 0.3


# Byte kinds: 0 other, 1 upper, 2 lower, 3 wide, 4 digit, 5 white space, 6 newline, 7 mark, 8 symbol, 9 bar, 10 bang
_KINDS = 16
_KIND = np.zeros(256, np.int64)
for _n, _codes in enumerate(
    [range(65, 91), range(97, 123), range(128, 256), b"0123456789", b" \t\v\f\r", b"\n", b".,;:?'\"-()",
     b"#$%&*+<=>@[]^_`{}~\\/", b"|", b"!"], 1):
    _KIND[list(_codes)] = _n
_UPPER, _LOWER, _SYMBOL = 1, 1 << 21, 1 << 42
_IN_WORD = np.select([_KIND == 1, _KIND == 2, (_KIND >= 8)], [_UPPER, _LOWER, _SYMBOL], 0)


def _repeat_shares(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's keys: the share that is distinct, and the share of the most frequent."""
    count = np.bincount(owner, minlength=n)
    if not len(keys):
        return np.ones(n), np.zeros(n)
    bits = max(1, n.bit_length())
    both = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (keys >> np.uint64(bits)))
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    whose = (both[at] >> np.uint64(64 - bits)).astype(np.int64)
    sizes = np.diff(np.append(at, len(both)))
    first = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
    top = np.zeros(n)
    top[whose[first]] = np.maximum.reduceat(sizes, first)
    distinct = np.bincount(whose, minlength=n) + (count == 0)
    return distinct / np.maximum(count, 1), top / np.maximum(count, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = _KIND[data]
    bytes_of = np.bincount(kind + np.repeat(np.arange(n) * _KINDS, size), minlength=n * _KINDS)
    share = (bytes_of.reshape(n, _KINDS) / np.maximum(size, 1)[:, None]).T

    starts, ends = words.runs(~words.SPACE[data], offsets)
    if not len(starts):
        out = np.zeros((n, len(FEATURES)))
        out[:, 0], out[:, 5], out[:, 6] = np.log1p(size), share[5] + share[6], share[6]
        out[:, FEATURES.index("distinct")] = 1
        return out
    owner = words.owners(starts, offsets)
    count = np.bincount(owner, minlength=n)
    keys = words.hashes(data, starts, ends)
    after = owner[1:] == owner[:-1]
    repeated = np.concatenate(([False], (keys[1:] == keys[:-1]) & after))
    pairs = (keys[1:] * np.uint64(3) + keys[:-1])[after]
    distinct, top = _repeat_shares(keys, owner, n)
    distinct_pairs, _ = _repeat_shares(pairs, owner[1:][after], n)

    line = np.searchsorted(np.flatnonzero(kind == 6), starts)
    line_at = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | ~after)))
    place = np.arange(len(keys)) - np.repeat(line_at, np.diff(np.append(line_at, len(keys))))
    line_keys = words.mix(np.add.reduceat(keys * (2 * place.astype(np.uint64) + np.uint64(1)), line_at))
    lines = np.maximum(np.bincount(owner[line_at], minlength=n), 1)
    distinct_lines, _ = _repeat_shares(line_keys, owner[line_at], n)

    # a word's letters and symbols: bytes up to the next word's start, white space counts for nothing
    inside = np.add.reduceat(_IN_WORD[data], starts)
    upper, lower, symbol = inside % _LOWER, inside // _LOWER % _LOWER, inside // _SYMBOL
    length = ends - starts
    closing = np.isin(data[ends - 1], list(b".!?"))
    by_word = lambda x: np.bincount(owner, x, n) / np.maximum(count, 1)
    columns = [
        np.log1p(size), np.log1p(count), share[1] + share[2] + share[3], share[1], share[4], share[5] + share[6],
        share[6], share[7] + share[10], share[8], share[9], share[10], share[3], by_word(length),
        by_word(length > 20), distinct, top, by_word(repeated), 1 - distinct_pairs,
        by_word((upper > 1) & (lower == 0)), by_word(symbol > 0), by_word((symbol > 0) & (upper + lower == 0)),
        count / lines, 1 - distinct_lines, by_word(closing),
    ]
    return np.stack(columns, 1)


@dataclass
class Model:
    """``cuts`` per feature, tables of log-odds per feature and per pair."""

    prior: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        if self.cuts:
            fine, coarse = self.bins(x, self.cuts), self.bins(x, self.pair_cuts)
            for f, t in enumerate(self.tables):
                total += t[fine[:, f]]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                total += t[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """The best cut of bins low..high; (gain, first bin on the right)."""
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    if not len(left_g):
        return 0.0, low
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    best = int(np.argmax(gains))
    return float(gains[best]), low + best + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins of one feature: its step per bin."""
    gain, middle = _cut(g, h, 0, len(g))
    edges = {0, len(g)}
    if gain > 0:
        edges.add(middle)
        for low, high in ((0, middle), (middle, len(g))):
            more, at = _cut(g, h, low, high)
            if more > 0:
                edges.add(at)
    edges = sorted(edges)
    step = np.zeros(len(g))
    for low, high in zip(edges, edges[1:]):
        step[low:high] = g[low:high].sum() / (h[low:high].sum() + RIDGE)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut on either axis, four leaves; (gain, step per cell)."""
    G, H = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    q = [(G[:-1, :-1], H[:-1, :-1])]
    q += [(G[:-1, -1:] - q[0][0], H[:-1, -1:] - q[0][1]), (G[-1:, :-1] - q[0][0], H[-1:, :-1] - q[0][1])]
    q += [(G[-1, -1] - sum(x for x, _ in q), H[-1, -1] - sum(x for _, x in q))]
    gains = sum(_gain(*x) for x in q)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    step = np.empty_like(g)
    parts = [np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]]
    for part, (x, y) in zip(parts, q, strict=True):
        step[part] = x[i, j] / (y[i, j] + RIDGE)
    return float(gains[i, j] - _gain(G[-1, -1], H[-1, -1])), step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of feature tables, then of pair tables."""
    ones = y.sum()
    share = (ones + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if not 0 < ones < len(y):
        return Model(prior, [], [], [], [], [])

    def cuts(bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]

    model = Model(prior, cuts(BINS), [], [], cuts(PAIR_BINS), [])
    fine, coarse = model.bins(x, model.cuts), model.bins(x, model.pair_cuts)
    total = np.full(len(y), prior)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            g, h = slope()
            own = fine[:, f]
            step = RATE * _tree(np.bincount(own, g, len(t)), np.bincount(own, h, len(t)))
            t += step
            total += step[own]

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)
        return coarse[:, a] * shape[1] + coarse[:, b], shape

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        cell, shape = cells(a, b)
        n = shape[0] * shape[1]
        g, h = slope()
        return np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape)

    able = [f for f, c in enumerate(model.pair_cuts) if len(c)]
    ranked = sorted(combinations(able, 2), key=lambda p: -_pair_tree(*sums(*p))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros(cells(*p)[1]) for p in model.pairs]
    for _ in range(ROUNDS // 4):
        for p, t in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _pair_tree(*sums(*p))[1]
            t += step
            total += step.reshape(-1)[cells(*p)[0]]
    return model


def _texts(batch: pa.RecordBatch) -> np.ndarray:
    return features(*words.text_bytes(batch.column("text")))


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents for whose label row ``usable`` holds."""
    small_batches(docs.sparkSession)
    fit_for_use = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(usable)
        .select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("y"))
    )
    # Of many labels only a thin range of hashes is sorted: about twice the bound, however many there are.
    share = min(1.0, 2 * max_rows / max(1, fit_for_use.count()))
    place = F.pmod(F.xxhash64("labelled"), F.lit(1 << 40))
    thin = fit_for_use if share == 1 else fit_for_use.where(place < F.lit(int(share * (1 << 40))))
    chosen = thin.orderBy(place, "labelled", "y").limit(max_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pa.array(list(_texts(batch)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *x], ["doc_id", "y", "x"])

    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
        .select("doc_id", "text", "y")
        .mapInArrow(rows, "doc_id long, y double, x array<double>")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .toPandas()
    )
    if not len(found):
        return Model(0.0, [], [], [], [], [])
    return fit(np.stack(found.x.to_numpy()), found.y.to_numpy())


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score as a further column ``name``, which must be new."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_texts(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    return docs.mapInArrow(rows, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
