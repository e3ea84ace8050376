"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree.

Sources get targets in words by weight (``with_targets``). A source's documents
are permuted by a hash of their content and cut into up to BLOCKS blocks, the
leading bits of the hash. A target of f times the source takes every block
floor(f) times, and for the rest the first blocks of the permutation. The block
in which the rest ends is cut finer and finer, by further bits, until at most
LEAF documents are left; there, documents are taken in hash order as long as
they fit, and exchanged as long as that brings the sum nearer.

The drawn blocks of all sources are dealt over output shards by a splitting
tree: exact numbers of blocks are split in two by a multivariate hypergeometric
draw, each half again, down to single shards; first for GROUPS groups of
sources, then, in a task per group, for its sources, within what the group got.
Every source then deals disjoint runs of its permuted blocks to the shards by
these quotas, and each shard is shuffled by hash on its own.

Everything follows from the seed and the rows' content: a retried task and a
rerun agree, however the input is split or ordered. What a document gets can be
told from its source, its place in the permutation and small tables, so whole
texts move once, to their shard. Rows alike in id, source and text are numbered
among themselves; they are documents each, and it does not matter which of them
has which number. The driver sees sums and GROUPS numbers per shard, no sources.

Defined results: a null text has size 0; null sources are one source, the last.
Documents of size 0 are taken with their block but count no words. Only whole
documents are taken. Rows repeated are documents each. An empty table, or one
of no words, takes nothing.
"""

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecheck.llm.common import split_by
from duecheck.operators.joins import hot_join
from duecheck.sources.tables import stage

BLOCK_BITS = 12
BLOCKS = 1 << BLOCK_BITS
HASH_BITS = 63
LEAF = 4096
GROUPS = 64
WEIGHTS = (3, 1, 2)
FACTOR, MOST = 1.5, 2
LEAST_SHARDS = 64
SHARD_WORDS = 1 << 28
_SOURCE = ["src", "nosrc"]
_ROW = ["key", "key2", "number"]
_NUMPY_MOST = 1_000_000_000


def _keyed(docs: DataFrame, seed: int, *columns: Column) -> DataFrame:
    """Source and two hashes of the content of each document, and further ``columns``."""
    content = [F.col(c) for c in ("doc_id", "source", "text")]
    return docs.select(
        *columns,
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("nosrc"),
        F.xxhash64(F.lit(seed), *content).alias("key"),
        F.xxhash64(*content, F.lit(seed)).alias("key2"),
    )


def _numbered(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``number`` tells rows of the same content apart, from 0, whatever the order of the rows.

    They are numbered per task of their scan and moved by the counts of the
    tasks before, so a group of copies never meets in one task.
    """
    if repeated is None:
        return rows.withColumn("number", F.lit(0).cast("long"))
    maybe, sure = split_by(rows, F.col("key"), repeated, "key")
    met = maybe.join(repeated.withColumn("again", F.lit(True)), ["key", "key2"], "left")
    alone = met.where(F.col("again").isNull()).drop("again").unionByName(sure)
    copies = stage(met.where("again").drop("again").withColumn("_at", F.monotonically_increasing_id()), "repeated-rows")
    salted = copies.withColumn("_salt", F.pmod(F.shiftright("_at", 33), F.lit(64)))
    before = Window.partitionBy("key", "key2").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("key", "key2", "_salt").agg(F.count("*").alias("_n"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("key", "key2", "_salt").orderBy("_at")) - 1
    numbered = salted.withColumn("_inside", inside).join(offsets, ["key", "key2", "_salt"])
    numbered = numbered.withColumn("number", F.col("_before") + F.col("_inside")).drop("_at", "_salt", "_inside", "_before")
    return alone.withColumn("number", F.lit(0).cast("long")).unionByName(numbered)


def _with_place(rows: DataFrame, seed: int) -> DataFrame:
    """Where a document stands in its source's permutation, and in which block."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *_ROW), 64 - HASH_BITS)
    return rows.withColumn("place", place).withColumn("block", _cell(str(BLOCK_BITS)))


def placed(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, size, source, content hashes, number, place and block of each document; contents that occur again)."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = stage(_keyed(docs, seed, F.col("doc_id"), size.alias("size")), "mix-contents")
    repeated = stage(rows.groupBy("key", "key2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "mix-repeated")
    again = None if repeated.isEmpty() else repeated
    return stage(_with_place(_numbered(rows, again), seed), "mix-places"), again


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of each source by code point, from 0, null last: inside slices, moved by the slices before."""
    slices = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sources.repartitionByRange(slices, "nosrc", "src").withColumn("slice", F.spark_partition_id())
    ranged = stage(ranged, "mix-slices")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    counts = ranged.groupBy("slice").agg(F.count("*").alias("n"))
    offsets = counts.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("nosrc", "src")) - 1
    return ranged.withColumn("inside", inside).join(offsets, "slice").withColumn("rank", F.col("offset") + F.col("inside")).drop(
        "slice", "inside", "offset"
    )


def with_targets(sources: DataFrame, weights: Sequence[float], factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """``target`` of each source (size, weight by rank): ``factor`` times all sizes, at most ``most`` times the source.

    A target is the weight times a common level, or the most. The level rises
    with the sources that it passes; each step is one aggregation.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    weighed = sources.withColumn("weight", weight)
    bound = F.col("size") * float(most)
    total = factor * (weighed.agg(F.sum("size").alias("n")).first()["n"] or 0)
    level, closed = 0.0, -1
    while True:
        over = F.col("weight") * level > bound
        found = weighed.agg(
            F.count(F.when(over, 1)).alias("closed"),
            F.coalesce(F.sum(F.when(over, bound)), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if found["closed"] == closed or not found["open"]:
            break
        closed, level = found["closed"], (total - found["given"]) / found["open"]
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), bound)).drop("weight")


def mixing_table(rows: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """One row per source: its size, target, whole passes and the words of the rest."""
    found = rows.groupBy(*_SOURCE).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    wanted = with_targets(stage(_ranked(found), "mix-ranks"), weights)
    quota = F.least(F.floor(F.col("target") + 0.5), MOST * F.col("size"))
    safe = F.nullif("size", F.lit(0))
    return stage(
        wanted.withColumn("quota", quota).select(
            *_SOURCE,
            "n",
            F.col("size").alias("source_size"),
            "target",
            F.coalesce(F.call_function("div", "quota", safe), F.lit(0)).cast("int").alias("passes"),
            F.coalesce(F.col("quota") % safe, F.lit(0)).alias("rest"),
        ),
        "mix-sources",
    )


def _cell(bits: str) -> Column:
    return F.expr(f"shiftright(place, {HASH_BITS} - {bits})")


def _boundaries(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source with a rest: its last cell (bits, cell) and the words to take of that cell.

    Documents before the cell are all taken. One pass per level over the cells
    still open; each is cut into cells of about half of LEAF documents and more.
    """
    found = sources.where("rest > 0").select(
        *_SOURCE, F.lit(0).alias("bits"), F.lit(0).cast("long").alias("cell"), F.col("rest").alias("left"), "n"
    )
    finer = f"least({HASH_BITS}, bits + least({BLOCK_BITS}, length(bin(n div {LEAF}))))"
    whole = (F.col("n") <= LEAF) | (F.col("bits") == HASH_BITS)
    closed: list[DataFrame] = []
    while True:
        closed.append(found.where(whole).drop("n"))
        open_ = stage(found.where(~whole).withColumn("finer", F.expr(finer)).drop("n"), "mix-open-cells")
        if open_.isEmpty():
            return stage(reduce(DataFrame.unionByName, closed), "mix-last-cells")
        inside = hot_join(rows.select(*_SOURCE, "place", "size"), open_, _SOURCE).where(_cell("bits") == F.col("cell"))
        order = Window.partitionBy(*_SOURCE).orderBy("sub")
        found = stage(
            inside.groupBy(*_SOURCE, "left", "finer", _cell("finer").alias("sub"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("n"))
            .withColumn("upto", F.sum("words").over(order))
            .where("upto > left and upto - words <= left")
            .select(
                *_SOURCE, F.col("finer").alias("bits"), F.col("sub").alias("cell"), (F.expr("left - upto + words")).alias("left"), "n"
            ),
            "mix-cells",
        )


def filled(sizes: np.ndarray, left: int) -> np.ndarray:
    """Which documents of one last cell are taken: those that still fit, in order, then better ones by exchange.

    As long as it brings the sum nearer to ``left``, a document that did not fit
    takes the place of a smaller one.
    """
    taken = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes):
        if 0 < size <= left:
            taken[i] = True
            left -= size
    while left > 0:
        inside = np.flatnonzero(taken)[np.argsort(sizes[taken], kind="stable")]
        outside = np.flatnonzero(~taken & (sizes > 0))
        at = np.searchsorted(sizes[inside], sizes[outside] - left)  # the smallest that makes room
        outside, at = outside[at < len(inside)], at[at < len(inside)]
        gain = sizes[outside] - sizes[inside[at]]
        if not len(gain) or gain.max() <= 0:
            break
        best = int(np.argmax(gain))
        taken[outside[best]], taken[inside[at[best]]] = True, False
        left -= int(gain[best])
    return taken


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["place", *_ROW])
    return pdf[filled(pdf["size"].to_numpy(), int(pdf.left.iloc[0]))][_ROW]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One univariate draw. Beyond what numpy takes, by inversion around the mode, to double precision."""
    if good < _NUMPY_MOST and bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mean = n * good / (good + bad)
    deviation = np.sqrt(max(1.0, mean * bad / (good + bad) * (good + bad - n) / max(1, good + bad - 1)))
    low, high = max(low, int(mean - 12 * deviation) - 12), min(high, int(mean + 12 * deviation) + 12)
    k = np.arange(low, high, dtype=float)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    upto = np.cumsum(np.exp(log_p - log_p.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw as a chain of univariate ones."""
    out, total = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts):
        if n == 0:
            break
        c = int(c)
        out[i] = _hypergeometric(rng, c, total - c, n) if 0 < c < total else min(c, n)
        total -= c
        n -= int(out[i])
    return out


def split_tree(counts: Sequence[int], totals: Sequence[int], seed: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes, blocks of each) by recursive multivariate-hypergeometric splits; shards get ``totals`` blocks."""
    upto = np.concatenate(([0], np.cumsum(np.asarray(totals, np.int64))))

    def split(low: int, high: int, which: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        some = left > 0
        which, left = which[some], left[some]
        if not len(which):
            return
        if high - low == 1:
            yield low, which, left
            return
        middle = (low + high) // 2
        chosen = _draw(np.random.default_rng([*seed, low, high]), left, int(upto[middle] - upto[low]))
        yield from split(low, middle, which, chosen)
        yield from split(middle, high, which, left - chosen)

    yield from split(0, len(totals), np.arange(len(counts)), np.asarray(counts, np.int64))


def shard_quotas(draws: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source or group per shard, of shards of even size."""
    total = int(sum(draws))
    out = np.zeros((shards, len(draws)), np.int64)
    for shard, which, blocks in split_tree(draws, np.diff(np.arange(shards + 1) * total // shards), [seed]):
        out[shard, which] = blocks
    return out


def _decks(taken: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per source and block the shard of each copy: ``shards``, by copy."""
    spark = taken.sparkSession
    group = F.pmod(F.xxhash64(*_SOURCE), F.lit(GROUPS)).cast("int").alias("g")
    most = taken.where("copies > 0").groupBy(*_SOURCE, "block").agg(F.max("copies").alias("copies"))
    each = stage(most.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies"), "mix-drawn-blocks")
    per_source = each.groupBy(*_SOURCE).agg(F.count("*").alias("blocks")).select(group, *_SOURCE, "blocks")
    totals = {r.g: r.n for r in per_source.groupBy("g").agg(F.sum("blocks").alias("n")).collect()}  # GROUPS rows at most
    quotas = shard_quotas([totals.get(g, 0) for g in range(GROUPS)], shards, seed)
    dealt = spark.createDataFrame([(g, quotas[:, g].tolist()) for g in sorted(totals)], "g int, quota array<long>")

    def deal(key, sources: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values(_SOURCE).reset_index(drop=True)
        runs = split_tree(sources.blocks.tolist(), quota.quota.iloc[0], [seed, 1 + key[0]])
        parts = [(np.repeat(which, blocks), np.full(int(blocks.sum()), shard)) for shard, which, blocks in runs]
        which, shard = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((shard, which))
        out = sources.loc[which[order], _SOURCE].reset_index(drop=True)
        out["turn"] = out.groupby(_SOURCE).cumcount() + 1
        out["shard"] = shard[order]
        return out

    kinds = "src string, nosrc boolean, turn long, shard int"
    runs = per_source.groupBy("g").cogroup(dealt.groupBy("g")).applyInPandas(deal, kinds)
    order = Window.partitionBy(*_SOURCE).orderBy(F.xxhash64(F.lit(seed + 1), *_SOURCE, "copy", "block"), "copy", "block")
    met = each.withColumn("turn", F.row_number().over(order).cast("long")).join(runs, [*_SOURCE, "turn"])
    copies = F.array_sort(F.collect_list(F.struct("copy", "shard")))
    return stage(met.groupBy(*_SOURCE, "block").agg(copies.getField("shard").alias("shards")), "mix-decks")


class Mix:
    """What a run decides: tables by which the copies and shards of each document are told."""

    def __init__(self, docs: DataFrame, seed: int = 17, shards: int | None = None, weights: Sequence[float] = WEIGHTS):
        self.seed = seed
        self.rows, self.repeated = placed(docs, seed)
        sources = mixing_table(self.rows, weights)
        last = _boundaries(self.rows, sources)
        self.sources = stage(sources.join(last, _SOURCE, "left"), "mix-table")
        leaf = hot_join(self.rows, last, _SOURCE).where(_cell("bits") == F.col("cell"))
        leaf = leaf.select(*_SOURCE, *_ROW, "place", "size", "left")
        self.fits = stage(leaf.groupBy(*_SOURCE).applyInPandas(_fill, "key long, key2 long, number long"), "mix-fitting")
        if shards is None:
            words = self.sources.agg(F.sum("target").alias("n")).first()["n"] or 0
            shards = max(LEAST_SHARDS, -int(-words // SHARD_WORDS))
        self.shards = shards
        self.taken = stage(self.copies(self.rows), "mix-taken")
        self.decks = _decks(self.taken, shards, seed)

    def copies(self, rows: DataFrame) -> DataFrame:
        """Rows with a place, and how often each is taken."""
        known = hot_join(rows, self.sources.drop("n", "left"), _SOURCE, counted_on=self.rows, spread=_ROW)
        marked = known.join(self.fits.withColumn("fits", F.lit(True)), _ROW, "left")
        at = _cell("bits")
        extra = F.when(F.col("bits").isNull(), False).otherwise((at < F.col("cell")) | ((at == F.col("cell")) & F.coalesce("fits", F.lit(False))))
        return marked.withColumn("copies", F.col("passes") + extra.cast("int")).drop("bits", "cell", "passes", "rest", "fits")

    def with_shards(self, taken: DataFrame, how: str) -> DataFrame:
        """Rows with copies, and the shard of each copy."""
        met = hot_join(taken, self.decks, [*_SOURCE, "block"], how, counted_on=self.rows, spread=_ROW)
        return met.withColumn("shards", F.slice("shards", F.lit(1), F.col("copies")))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the shards it goes to."""
    mix = Mix(docs, **options)
    shards = F.coalesce(F.sort_array("shards"), F.array().cast("array<int>"))
    return mix.with_shards(mix.taken, "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), shards.alias("shards")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with all their columns: a partition per shard, shuffled within.

    A document drawn twice is there twice.
    """
    mix = Mix(docs, **options)
    whole = _with_place(_numbered(_keyed(docs, mix.seed, F.struct("*").alias("doc")), mix.repeated), mix.seed)
    drawn = mix.with_shards(mix.copies(whole).where("copies > 0"), "inner")
    each = drawn.select("doc", *_ROW, F.posexplode("shards").alias("copy", "shard"))
    turn = F.xxhash64(F.lit(mix.seed + 2), *_ROW, "copy")
    return each.repartitionById(mix.shards, "shard").sortWithinPartitions(turn, *_ROW, "copy").select("doc.*")
