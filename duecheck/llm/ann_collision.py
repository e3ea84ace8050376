"""Approximate nearest neighbours by collision counting over query-centred windows.

Nearness is the inner product. Vectors are dealt into blocks by length and, in
a block, brought into the unit ball by its longest length; one more coordinate
takes them to the unit sphere, where the largest product with a query is the
smallest distance to it. A block keeps PROJECTIONS sorted arrays, the
projections of its vectors on single random directions.

A query opens a window around its own projection in every array, as wide as
HALF_WIDTH times a radius on each side. A vector at that distance falls into a
window with probability ``p``, a farther one less often; one that falls into
COLLISIONS windows is verified by its exact product. Virtual rehashing widens
the same windows to the next radius, counting only what is new, until the k-th
best vector known is no farther than the radius. The last radius takes in all
vectors, so a query always gets its k if there are as many.

Every vector is indexed, none sampled, and no candidate is capped. A first pass
meets one block a query and gives it a bound. After that, a block takes part
only if its longest vector can still reach the bound of some query of a block of
queries; which blocks meet is found from their numbers, before vectors are sent.

Defined results: vectors null or empty, of zeros only, or holding a null or
non-finite component take no part, nor do null ids. Vectors of unlike length are
compared as if zeros followed the shorter. Products are summed in double
precision in the order of components; where that overflows, the score is what
doubles give. Rows repeated under one id are candidates each, but not for a
query of that id, and queries each. Ties go to the smaller id. Other columns are
ignored. An empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecheck.sources.tables import stage

PROJECTIONS = 128
HALF_WIDTH = 1.4
#: Of PROJECTIONS windows. A vector at the radius meets 107.3 of them on average (deviation 4.2), fewer than these 1 time in 200.
COLLISIONS = 96
BLOCK_ROWS = 4096
BLOCK_VALUES = 1 << 22
QUERY_ROWS = 512
QUERY_BLOCKS = 8
FIRST_RADIUS = 0.4
WIDEN = 1.15
_FARTHEST = 2.0
_SPAN = 64.0
_SEED = 1729
_BLOCK = "bucket long, longest double, ids binary, size int, width int, kind string, data binary, places binary"
_ASK = "q_block long, q_rows binary, q_ids binary, q_size int, q_width int, q_data binary, q_theta binary, q_least double"
_FOUND = "row long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v, norm) of all vectors that take part; the length survives tiny and huge components."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    most = F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c.cast("double"))))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.pow(c.cast("double") / F.col("most"), 2))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
        .withColumn("most", most)
        .where("most > 0")
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", (F.col("most") * F.sqrt(square)).alias("norm"))
    )


def directions(width: int) -> tuple[np.ndarray, np.ndarray]:
    """(one direction per column, alike for any width; what the added coordinate weighs in each)."""
    lift = np.random.default_rng(_SEED + 1).standard_normal(PROJECTIONS)
    return np.random.default_rng(_SEED).standard_normal((width, PROJECTIONS)), lift


def _matrix(v: pd.Series) -> np.ndarray:
    out = np.zeros((len(v), max(map(len, v))), np.asarray(v.iloc[0]).dtype)
    for i, x in enumerate(v):
        out[i, : len(x)] = x
    return out


def _heights(data: np.ndarray, longest: float) -> np.ndarray:
    """Projections of the vectors of a block, lifted to the unit sphere: a row per direction."""
    ball = data.astype(float) / longest
    along, lift = directions(data.shape[1])
    return (ball @ along + np.sqrt(np.maximum(0, 1 - (ball**2).sum(1)))[:, None] * lift).T


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: its vectors, and the order of their projections in each sorted array."""
    data = _matrix(pdf.v)
    longest = float(pdf.norm.max())
    made = {
        "bucket": int(pdf.block.iloc[0]),
        "longest": longest,
        "ids": pdf.vec_id.to_numpy("<i8").tobytes(),
        "size": len(data),
        "width": data.shape[1],
        "kind": data.dtype.str,
        "data": data.tobytes(),
        "places": np.argsort(_heights(data, longest), axis=1, kind="stable").astype("<u2").tobytes(),
    }
    return pd.DataFrame([made])


def _ask(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of queries with their bounds; ``q_least`` is what a block's longest length must reach."""
    data = _matrix(pdf.v).astype("<f8")
    made = {
        "q_block": int(pdf.block.iloc[0]),
        "q_rows": pdf.row.to_numpy("<i8").tobytes(),
        "q_ids": pdf.vec_id.to_numpy("<i8").tobytes(),
        "q_size": len(data),
        "q_width": data.shape[1],
        "q_data": data.tobytes(),
        "q_theta": pdf.theta.to_numpy("<f8").tobytes(),
        "q_least": float((pdf.theta / pdf.norm).min()),
    }
    return pd.DataFrame([made])


def _blocked(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """``block`` of each vector, longest first, ``rows`` to a block but the last, however the table is partitioned."""
    slices = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = vectors.repartitionByRange(slices, F.desc("norm"), "vec_id", "row")
    sliced = stage(ranged.withColumn("slice", F.spark_partition_id()), name)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    counts = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    offsets = counts.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy(F.desc("norm"), "vec_id", "row")) - 1
    placed = sliced.withColumn("inside", inside).join(offsets, "slice")
    return placed.withColumn("block", F.expr(f"(offset + inside) div {rows}")).drop("slice", "inside", "offset")


class Block:
    """One block of vectors, ready to be asked."""

    def __init__(self, r, width: int):
        self.longest, self.size = r.longest, r.size
        self.ids = np.frombuffer(r.ids, "<i8")
        self.rows = np.zeros((r.size, width))
        self.rows[:, : r.width] = np.frombuffer(r.data, r.kind).reshape(r.size, r.width)
        self.places = np.frombuffer(r.places, "<u2").reshape(PROJECTIONS, r.size)
        self.base = np.arange(PROJECTIONS) * _SPAN
        heights = np.take_along_axis(_heights(self.rows[:, : r.width], r.longest), self.places, 1)
        self.heights = (np.clip(heights, -_SPAN / 4, _SPAN / 4) + self.base[:, None]).ravel()
        self.first = np.arange(PROJECTIONS) * r.size

    def windows(self, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Where each array's window begins and ends."""
        if radius > _FARTHEST:
            return np.zeros(PROJECTIONS, np.int64), np.full(PROJECTIONS, self.size)
        reach = HALF_WIDTH * radius
        low = self.base + np.clip(centre - reach, -_SPAN / 3, _SPAN / 3)
        high = self.base + np.clip(centre + reach, -_SPAN / 3, _SPAN / 3)
        start, end = np.searchsorted(self.heights, low, "left"), np.searchsorted(self.heights, high, "right")
        return start - self.first, end - self.first

    def tally(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each vector lies in the given parts of the arrays."""
        parts = [self.places[i, low:high] for i, (low, high) in enumerate(zip(starts.tolist(), ends.tolist())) if low < high]
        return np.bincount(np.concatenate(parts), minlength=self.size) if parts else np.zeros(self.size, np.int64)

    def counted(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Collisions of each vector in first windows, from what lies inside or outside, whichever is less."""
        if 2 * int((end - start).sum()) <= PROJECTIONS * self.size:
            return self.tally(start, end)
        none, whole = np.zeros_like(start), np.full_like(end, self.size)
        return PROJECTIONS - self.tally(none, start) - self.tally(end, whole)

    def nearest(self, q: np.ndarray, centre: np.ndarray, norm: float, own: int, theta: float, k: int):
        """(ids, scores) of up to ``k`` vectors found that reach ``theta``, best first; and how many were verified.

        Products of all candidates are taken at once, and once more for those
        near the k-th, summed component after component: equal vectors get
        equal scores.
        """
        slack = 1e-15 * (len(q) + 8) * norm * self.longest
        verified = np.zeros(self.size, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        bound = self.distance(theta, norm)
        radius = min(bound, FIRST_RADIUS) if bound > _FARTHEST else bound / WIDEN
        low, high = self.windows(centre, radius)
        count = self.counted(low, high)
        while True:
            fresh = np.flatnonzero((count >= COLLISIONS) & ~verified)
            verified[fresh] = True
            fresh = fresh[self.ids[fresh] != own]
            places, scores = np.append(places, fresh), np.append(scores, self.rows[fresh] @ q)
            if len(places) >= k:
                bound = min(bound, self.distance(float(np.partition(scores, -k)[-k]) - slack, norm))
            if radius >= bound or radius > _FARTHEST:
                break
            wider = radius * WIDEN
            radius = wider if wider < bound else bound if bound <= _FARTHEST else min(wider, _FARTHEST * 2)
            start, end = self.windows(centre, radius)
            count += self.tally(start, low) + self.tally(high, end)
            low, high = start, end
        if len(places) > k:
            places = places[scores >= np.partition(scores, -k)[-k] - 2 * slack]
        scores = np.add.accumulate(self.rows[places] * q, axis=1)[:, -1] if len(places) else np.zeros(0)
        best = np.lexsort((self.ids[places], -scores))[:k]
        best = best[scores[best] >= theta]
        return self.ids[places[best]], scores[best], int(verified.sum())

    def distance(self, score: float, norm: float) -> float:
        """Distance on the unit sphere at which a vector has this product with the query; infinite if unknown."""
        if score == -np.inf:
            return np.inf
        return float(np.sqrt(max(1e-12, 2 - 2 * (score / norm) / self.longest)))


def _meet(block: Block, r, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What one block of queries finds in one block of vectors."""
    width = block.rows.shape[1]
    queries = np.zeros((r.q_size, width))
    queries[:, : r.q_width] = np.frombuffer(r.q_data, "<f8").reshape(r.q_size, r.q_width)
    most = np.abs(queries).max(1)
    norms = most * np.sqrt(((queries / most[:, None]) ** 2).sum(1))
    centres = (queries / norms[:, None]) @ directions(width)[0]
    rows, ids, theta = (np.frombuffer(b, t) for b, t in ((r.q_rows, "<i8"), (r.q_ids, "<i8"), (r.q_theta, "<f8")))
    for i in range(r.q_size):
        if norms[i] * block.longest * (1 + 1e-9) < theta[i]:
            continue
        found, scores, _ = block.nearest(queries[i], centres[i], norms[i], ids[i], theta[i], k)
        yield np.full(len(found), rows[i]), np.full(len(found), ids[i]), found, scores


def _found(pairs: DataFrame, blocks: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """Results of the pairs (bucket, q_block): a block of vectors goes once to each QUERY_BLOCKS blocks of queries."""

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        r = next(held.itertuples())
        block = Block(r, max(r.width, int(asked.q_width.max())))
        met = [x for q in asked.itertuples() for x in _meet(block, q, k)]
        columns = [np.concatenate(c) for c in zip(*met)] if met else [[]] * 4
        return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score"), columns)))

    group = F.expr(f"q_block div {QUERY_BLOCKS}")
    left = pairs.select("bucket", group.alias("q_group")).distinct().join(blocks, "bucket")
    right = pairs.select("q_block", F.col("bucket").alias("to"), group.alias("of_group")).join(asks, "q_block")
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism  # few rows, much work each
    held = left.repartition(tasks, "bucket", "q_group").groupBy("bucket", "q_group")
    asked = right.repartition(tasks, "to", "of_group").groupBy("to", "of_group")
    return held.cogroup(asked).applyInPandas(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: up to ``k`` nearest vectors found for each query row."""
    rows = stage(usable(vectors), "vectors")
    widest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1
    per_block = max(1, min(BLOCK_ROWS, BLOCK_VALUES // widest))
    placed = _blocked(rows.select("row", "vec_id", "v", "norm"), per_block, "vector-slices")
    blocks = stage(placed.groupBy("block").applyInPandas(_index, _BLOCK), "vector-index")
    buckets = blocks.count()
    per_ask = max(1, min(QUERY_ROWS, BLOCK_VALUES // widest))
    asking = stage(_blocked(rows.where(is_query).select("row", "vec_id", "v", "norm"), per_ask, "query-slices"), "queries")

    def ask(queries: DataFrame, name: str) -> DataFrame:
        return stage(queries.groupBy("block").applyInPandas(_ask, _ASK), name)

    # a bound from one block each, of the longer ones, which differ from query block to query block
    unbound = ask(asking.withColumn("theta", F.lit(float("-inf"))), "query-blocks")
    near = max(min(8, buckets), buckets // 8, 1)
    one = unbound.select("q_block", F.pmod("q_block", F.lit(near)).alias("bucket"))
    first = stage(_best(_found(one, blocks, unbound, k), k), "first-bounds")
    kth = first.where(F.col("rank") == k).select("row", F.col("score").alias("theta"))
    asks = ask(asking.join(kth, "row", "left").fillna(float("-inf"), ["theta"]), "bounded-query-blocks")
    named = asks.select("q_block", "q_least", F.explode(F.sequence(F.lit(0), F.lit(max(0, buckets - 1)))).alias("bucket"))
    reach = named.join(blocks.select("bucket", "longest"), "bucket")
    pairs = stage(reach.where(F.col("longest") * (1 + 1e-9) >= F.col("q_least")).select("q_block", "bucket"), "pairs")
    return _best(_found(pairs, blocks, asks, k), k).select("query_id", "rank", "vec_id", "score")
