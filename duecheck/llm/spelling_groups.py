"""Spelling variant grouping: search schemes over bidirectional FM-indexes of the vocabulary.

Two words are near if one insertion, deletion or replacement of a code point
turns one into the other. A near word therefore agrees with a word's first half
or with its second half exactly. A bidirectional FM-index holds the vocabulary
as a text of words between delimiters, once forward and once reversed, with
suffix-rank intervals kept in step on both sides. One search matches the first
half exactly, from the middle to the delimiter before it, turns, and extends to
the right over the second half with one error and the delimiter; the other
search is its mirror image.

The vocabulary is counted by Spark. Every word is sent, as a word to be found,
to the buckets of the halves that a near word may have (lengths differ by one
at most), and, as a query, to the buckets of its own two halves, so that each
bucket holds whole searches and no pair is missed. A bucket is an index of about
BUCKET_CHARS characters. A half that many words share is cut into blocks of
words and blocks of queries that all meet: exact, and bounded in memory. Searches
step all queries of a bucket at once through wavelet matrices.

A word's form is its near word of largest count, if that count is at least
RATIO times its own; roots follow forms by pointer doubling (counts grow tenfold
each time, so a handful of rounds is enough).

Defined results: a null text has no words; a null doc_id counts as the empty
text where it enters the hash. Repeated rows count their words each. Ties in
count go to the smaller word in code-point order. Other columns are ignored; an
empty table, or one whose words are all too short or too rare, gives no rows.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecheck.sources.tables import stage

LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10
ERASED = 31
BUCKET_CHARS = 1 << 20
_QUERIES = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "word string, n long, n_near long, form string, form_n long"


def erased(doc_id: Column, run: Column) -> Column:
    """The run, less one code point where the hash of document and run says so."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(name.cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % ERASED == 0, less).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    runs = F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}"), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("run"))
    lowered = each.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    words = lowered.select(erased(F.col("doc_id"), F.col("run")).alias("word"))
    return (
        words.where(F.char_length("word") >= LEAST_CHARS)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


class Wavelet:
    """Ranks of symbols in a sequence, and how many smaller ones an interval holds."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(bits - 1, -1, -1):
            ones = (sequence >> shift) & 1
            upto = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(ones, out=upto[1:])
            self.levels.append((shift, upto, len(sequence) - int(upto[-1])))
            sequence = np.concatenate((sequence[ones == 0], sequence[ones == 1]))
        self.first = self._walk(np.arange(1 << bits), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64))[0]

    def _walk(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.zeros(len(c), np.int64)
        for shift, upto, zeros in self.levels:
            one = ((c >> shift) & 1).astype(bool)
            low1, high1 = upto[low].astype(np.int64), upto[high].astype(np.int64)
            smaller += np.where(one, (high - high1) - (low - low1), 0)
            low = np.where(one, zeros + low1, low - low1)
            high = np.where(one, zeros + high1, high - high1)
        return low, high, smaller

    def ranks(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each symbol: how many before ``low``, how many in the interval, how many smaller ones in it."""
        start, end, smaller = self._walk(c, low, high)
        return start - self.first[c], end - start, smaller


def _suffixes(text: np.ndarray, tail: np.ndarray, bits: int) -> np.ndarray:
    """Places of the suffixes in order: by what follows up to a delimiter, then by place (words are sorted)."""
    n, width = len(text), 62 // bits
    padded = np.concatenate((text, np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for t in range(width):
        key = (key << bits) | np.where(t < tail, padded[t : t + n], 0)
    longest = int(tail.max())
    while True:
        order = np.argsort(key, kind="stable")
        if width >= longest:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        rest = np.where(tail > width, rank[np.minimum(np.arange(n) + width, n - 1)] + 1, 0)
        key, width = rank * (n + 2) + rest, 2 * width


class Half:
    """One direction of the index: words in their own order, each before and behind a delimiter (symbol 0)."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray, bits: int):
        size = sizes[order]
        at = np.cumsum(size + 1) - size  # place of each word behind its delimiter
        n = int(size.sum()) + len(size) + 1
        text = np.zeros(n, np.int64)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(at, size) + within] = symbols[np.repeat(starts[order], size) + within]
        tail = np.ones(n, np.int64)
        tail[np.repeat(at, size) + within] = np.repeat(size, size) - within + 1
        tail[at - 1] = size + 2
        places = _suffixes(text, tail, bits)
        self.order, self.length = order, n
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << bits))))
        self.wavelet = Wavelet(text[places - 1], bits)

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval of each pattern with ``c`` put in front of it, and the shift of its mirror interval."""
        rank, count, smaller = self.wavelet.ranks(c, low, high)
        low = self.before[c] + rank
        return low, low + count, smaller

    def word(self, rank: np.ndarray) -> np.ndarray:
        """The word of each rank that a pattern from delimiter to delimiter has; rank 0 is the last delimiter."""
        return self.order[rank - 1]


@dataclass
class Words:
    """Words as flat symbols: 1 and up in code-point order."""

    symbols: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The symbol at each place, 0 behind the end."""
        inside = place < self.sizes[word]
        return np.where(inside, self.symbols[np.where(inside, self.starts[word] + place, 0)], 0)

    def mirrored(self) -> "Words":
        end = self.starts + self.sizes
        within = np.arange(len(self.symbols)) - np.repeat(self.starts, self.sizes)
        return Words(self.symbols[np.repeat(end, self.sizes) - 1 - within], self.starts, self.sizes)


def as_symbols(words: list[str]) -> tuple[Words, int]:
    """(the words as symbols, bits of a symbol)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    known, symbols = np.unique(points, return_inverse=True)
    sizes = np.array([len(w) for w in words], np.int64)
    return Words(symbols.astype(np.int64) + 1, np.cumsum(sizes) - sizes, sizes), len(known).bit_length()


def search(there: Half, back: Half, queries: Words, whose: np.ndarray, split: np.ndarray, own: np.ndarray, symbols: int):
    """Yield (query, word) for the words that have the query's first ``split`` symbols and one error behind them.

    ``there`` puts symbols in front, ``back`` behind; ``own`` marks queries that are words of the index themselves.
    """
    low, high = np.zeros(len(whose), np.int64), np.full(len(whose), there.length)
    mirror = low.copy()
    for step in range(int(split.max(initial=-1)) + 1):  # the exact half, then the delimiter
        on = np.flatnonzero(step <= split)
        place = split[on] - 1 - step
        c = np.where(place >= 0, queries.at(whose[on], np.maximum(place, 0)), 0)
        low[on], high[on], smaller = there.extend(c, low[on], high[on])
        mirror[on] += smaller
    # turned: intervals of ``back`` from here
    state = (np.arange(len(whose)), mirror, mirror + high - low, split.copy())
    once: list[tuple[np.ndarray, ...]] = []
    letters = np.arange(1, symbols + 1)
    while len(state[0]):
        q, low, high, place = state
        more = high - low > own[q]  # an interval of the query alone leads to no other word
        q, low, high, place = q[more], low[more], high[more], place[more]
        wanted, size = queries.at(whose[q], place), queries.sizes[whose[q]]
        skip = (place < size) & (wanted != queries.at(whose[q], place + 1))  # of a run, its last
        once.append((q[skip], low[skip], high[skip], place[skip] + 1))
        each, c = np.repeat(np.arange(len(q)), symbols), np.tile(letters, len(q))
        to_low, to_high, _ = back.extend(c, low[each], high[each])
        there_is = to_high > to_low
        each, c, to_low, to_high = each[there_is], c[there_is], to_low[there_is], to_high[there_is]
        same = c == wanted[each]
        off, replaced = ~same, ~same & (place[each] < size[each])
        once.append((q[each[off]], to_low[off], to_high[off], place[each[off]]))
        once.append((q[each[replaced]], to_low[replaced], to_high[replaced], place[each[replaced]] + 1))
        state = (q[each[same]], to_low[same], to_high[same], place[each[same]] + 1)
    q, low, high, place = (np.concatenate(x) for x in zip(*once)) if once else [np.zeros(0, np.int64)] * 4
    while len(q):
        c = queries.at(whose[q], place)
        low, high, _ = back.extend(c, low, high)
        found = high > low
        done = found & (place == queries.sizes[whose[q]])
        yield q[done], back.word(low[done])
        on = found & ~done
        q, low, high, place = q[on], low[on], high[on], place[on] + 1


def near_words(vocabulary: list[str], asked: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of the sorted ``vocabulary``) that are near.

    A query with ``first`` looks for words with its first half, another for words
    with its second half that do not have the first as well.
    """
    both, bits = as_symbols([*vocabulary, *asked])
    n = len(vocabulary)
    mirror = both.mirrored()
    backward = np.array(sorted(range(n), key=lambda i: vocabulary[i][::-1]), np.int64)
    forward = Half(both.symbols, both.starts, both.sizes, np.arange(n), bits)
    reverse = Half(mirror.symbols, mirror.starts, mirror.sizes, backward, bits)
    symbols = int(both.symbols.max(initial=0))
    held = set(vocabulary)
    own = np.array([w in held for w in asked], np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for side, (there, back, words) in ((True, (forward, reverse, both)), (False, (reverse, forward, mirror))):
        mine = np.flatnonzero(first == side)
        for low in range(0, len(mine), _QUERIES):
            part = mine[low : low + _QUERIES]
            size = both.sizes[n + part]
            split = size // 2 if side else size - size // 2
            for q, w in search(there, back, words, n + part, split, own[part], symbols):
                q = part[q]
                if not side:
                    apart = [vocabulary[j][: len(asked[i]) // 2] != asked[i][: len(asked[i]) // 2] for i, j in zip(q, w)]
                    q, w = q[apart], w[apart]
                pairs.append((q, w))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, w = (np.concatenate(x) for x in zip(*pairs))
    return q, w


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """What each query of one bucket finds there: count of near words, the best of them."""
    held = pdf[~pdf.asks].drop_duplicates("word").sort_values("word", key=lambda s: s.map(lambda w: w.encode()))
    asks = pdf[pdf.asks]
    vocabulary, counts = held.word.tolist(), held.n.to_numpy()
    n_near, best = np.zeros(len(asks), np.int64), np.full(len(asks), -1)
    if len(vocabulary) and len(asks):
        q, w = near_words(vocabulary, asks.word.tolist(), asks["first"].to_numpy(bool))
        n_near += np.bincount(q, minlength=len(asks))
        order = np.lexsort((w, -counts[w], q))
        at = order[np.concatenate(([True], q[order][1:] != q[order][:-1]))[: len(order)]]
        best[q[at]] = w[at]
    found = {
        "word": asks.word.tolist(),
        "n": asks.n.to_numpy(),
        "n_near": n_near,
        "form": [vocabulary[i] if i >= 0 else None for i in best],
        "form_n": [int(counts[i]) if i >= 0 else None for i in best],
    }
    return pd.DataFrame({c: pd.Series(v, dtype=object) if isinstance(v, list) else v for c, v in found.items()})


def _halves(size: str) -> tuple[str, str]:
    """SQL for the keys of a word of ``size`` characters: its first half, its second half."""
    return f"concat('<', left(word, {size} div 2))", f"concat('>', right(word, {size} - {size} div 2))"


def _dealt(words: DataFrame, bucket_chars: int) -> DataFrame:
    """(bucket, word, n, asks, first): words to be found and queries, in buckets of bounded size."""
    sizes = ("(char_length(word) - 1)", "char_length(word)", "(char_length(word) + 1)")
    keys = ", ".join(k for size in sizes for k in _halves(size))
    found = words.select("word", "n", F.explode(F.expr(f"array_distinct(array({keys}))")).alias("key"))
    asked = words.select("word", "n", F.explode(F.expr(f"array({', '.join(_halves(sizes[1]))})")).alias("key"))
    chars = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    buckets = math.ceil(4 * chars / bucket_chars)
    per_key = found.groupBy("key").agg(F.sum(F.char_length("word") + 1).alias("chars"))
    hot = stage(
        per_key.where(F.col("chars") > bucket_chars).select("key", F.ceil(F.col("chars") / bucket_chars).cast("int").alias("blocks")),
        "hot-halves",
    )
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def placed(rows: DataFrame, asks: bool) -> DataFrame:
        met = rows.join(hot, "key", "left")
        cut = met.where(F.col("blocks").isNotNull()).withColumn("other", F.explode(every))
        i, j = ("other", own) if asks else (own, "other")
        return (
            met.where(F.col("blocks").isNull())
            .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, buckets))).cast("string"))
            .unionByName(cut.withColumn("bucket", F.concat_ws("/", "key", i, j)), allowMissingColumns=True)
            .select("bucket", "word", "n", F.lit(asks).alias("asks"), F.startswith("key", F.lit("<")).alias("first"))
        )

    # hot halves are at most 4 * chars / bucket_chars, so that Spark broadcasts them at any likely size
    return placed(found, False).unionByName(placed(asked, True))


def near_forms(words: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """word, n, n_near, form, form_n of a stored vocabulary (word, n) of distinct words of two characters and more."""
    found = _dealt(words, bucket_chars).groupBy("bucket").applyInPandas(_bucket, _FOUND)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), "form")))
    per_word = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    kept = -F.col("best.minus") >= RATIO * F.col("n")
    return per_word.select(
        "word", "n", "n_near", F.when(kept, F.col("best.form")).alias("form"), F.when(kept, -F.col("best.minus")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, by pointer doubling over a stored table (word, form)."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = reached.join(onward, "root", "left")
        reached = stage(
            joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"
        )
        if reached.where("moved").isEmpty():
            return reached.drop("moved")


def group_variants(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents."""
    words = stage(vocabulary(docs), "vocabulary")
    found = stage(near_forms(words, bucket_chars), "near-forms")
    with_form = found.where(F.col("form").isNotNull())
    ends = roots(with_form.select("word", "form"))
    alone = found.where(F.col("form").isNull()).withColumn("root", F.col("word"))
    return alone.unionByName(with_form.join(ends, "word"))
