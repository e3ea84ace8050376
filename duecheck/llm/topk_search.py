"""Exact top-k search by integer inner product: norm buckets, local thresholds, verified products.

Vectors become integers, floor(scale * x). Candidates are dealt into buckets by
length (range partitions of the norm), each stored as packed blocks. Queries
are packed likewise. A first join meets the longest block only and gives every
query a threshold: its k-th best score so far. A bucket takes part in the
second join only if |q| * (its longest norm) can reach that threshold. There,
the local cosine threshold t = theta / (|q| * l) chooses the pruning: if it is
high, the FOCUS largest coordinates of the query are multiplied first and the
rest is bounded by Cauchy and Schwarz (coordinate pruning); else vectors are
cut by length alone, which in a block sorted by norm is a prefix. What is left
is verified by the whole product. Nothing is approximate.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part. Vectors of unlike length are compared as if zeros followed the
shorter. A null id takes no part as query, nor as candidate. Rows repeated under
one id are candidates each, but not for a query of that id, and queries each. Ties go to the
smaller id. Fewer than k candidates give fewer rows; an empty table gives none.
A scaled component, or a product met on the way, beyond 64 bits ends the search.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecheck.llm.common import settings
from duecheck.sources.tables import stage

BLOCK_ROWS = 4096
QUERY_ROWS = 256
MOST_BUCKETS = 4096
FOCUS = 8
COORDINATE_FROM = 0.3
_EXACT = float(1 << 53)
_MOST = 1 << 62
_PACKED = "norm_max double, least double, ids binary, rows binary, theta binary, size int, width int, kind string, data binary"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, row, v array<long>, norm) of all vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fits = lambda c: F.when(F.abs(c * scale) < float(_MOST), F.floor(c * scale).cast("long"))
    whole = F.transform(x, lambda c: F.coalesce(fits(c), F.raise_error(F.lit("a component leaves 64 bits")).cast("long")))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(F.forall(x, finite))
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.sqrt(square).alias("norm"))
    )


def _block(pdf: pd.DataFrame) -> dict:
    """One packed block, longest vectors first, in the narrowest integers that hold it."""
    pdf = pdf.sort_values("norm", ascending=False, kind="stable")
    width = max(len(v) for v in pdf.v)
    data = np.zeros((len(pdf), width), np.int64)
    for i, v in enumerate(pdf.v):
        data[i, : len(v)] = v
    most = max(int(data.max(initial=0)), -int(data.min(initial=0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(pdf.norm > 0, pdf.theta / pdf.norm, np.where(pdf.theta > 0, np.inf, -np.inf)).min()
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return {
        "norm_max": float(pdf.norm.max()),
        "least": float(least),  # of queries: what a bucket's longest norm must reach for any of them
        "ids": pdf.vec_id.to_numpy("<i8").tobytes(),
        "rows": pdf.row.to_numpy("<i8").tobytes(),
        "theta": pdf.theta.to_numpy("<f8").tobytes(),
        "size": len(pdf),
        "width": width,
        "kind": kind,
        "data": data.astype(kind).tobytes(),
    }


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for pdf in parts:
            held = pd.concat([held, pdf], ignore_index=True) if len(held) else pdf
            while len(held) >= rows:
                yield pd.DataFrame([_block(held.iloc[:rows])])
                held = held.iloc[rows:]
        if len(held):
            yield pd.DataFrame([_block(held)])

    return vectors.select("row", "vec_id", "v", "norm", "theta").mapInPandas(pack, _PACKED)


def _matrix(size: int, width: int, kind: str, data: bytes, to: int) -> np.ndarray:
    out = np.zeros((size, to), np.int64)
    out[:, :width] = np.frombuffer(data, kind).reshape(size, width)
    return out


def _products(c: np.ndarray, doubles: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products; in doubles where no partial sum can pass 2**53. One beyond 64 bits is an error."""
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if most < _EXACT:
        return (doubles @ q.astype(np.float64)).astype(np.int64)
    if most < _MOST:
        return c @ q
    exact = c.astype(object) @ q.astype(object)
    if any(abs(x) >= 1 << 63 for x in exact):
        raise OverflowError("a score leaves 64 bits")
    return exact.astype(np.int64)


def _candidates(c: np.ndarray, norms: np.ndarray, q: np.ndarray, theta: float) -> np.ndarray:
    """Places of the vectors whose product with ``q`` may reach ``theta``."""
    if theta <= 0:
        return np.arange(len(c))
    length = float(np.sqrt((q.astype(float) ** 2).sum()))
    least = theta - 1e-9 * theta
    if length == 0 or length * norms[0] < least:
        return np.arange(0)
    if theta / (length * norms[0]) < COORDINATE_FROM or len(q) <= FOCUS:
        return np.arange(int(np.searchsorted(-norms, -least / length, "right")))
    focus = np.argpartition(-np.abs(q), FOCUS)[:FOCUS]
    head = c[:, focus].astype(float)
    q_rest = max(0.0, length**2 - float((q[focus].astype(float) ** 2).sum()))
    c_rest = np.maximum(0.0, norms**2 - (head**2).sum(1))
    bound = head @ q[focus].astype(float) + np.sqrt(q_rest * c_rest)
    return np.flatnonzero(bound >= least - 1e-6 * np.abs(bound))


def _meet(r, k: int) -> Iterator[tuple[int, int, int, int]]:
    """The best k of one candidate block for each query of one query block."""
    to = max(r.width, r.q_width)
    c = _matrix(r.size, r.width, r.kind, r.data, to)
    cids = np.frombuffer(r.ids, "<i8")
    doubles = c.astype(float)
    norms = np.sqrt((doubles**2).sum(1))
    queries = _matrix(r.q_size, r.q_width, r.q_kind, r.q_data, to)
    whose = zip(np.frombuffer(r.q_rows, "<i8"), np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_theta, "<f8"))
    for q, (row, qid, theta) in zip(queries, whose, strict=True):
        keep = _candidates(c, norms, q, theta)
        keep = keep[cids[keep] != qid]
        part = (c, doubles) if len(keep) == len(c) else (c[keep], doubles[keep])
        score = _products(*part, q)
        order = np.lexsort((cids[keep], -score))[:k]
        for i in order[score[order] >= theta]:
            yield int(row), int(qid), int(cids[keep[i]]), int(score[i])


def _found(blocks: DataFrame, queries: DataFrame, k: int, on: list[str]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [x for r in pdf.itertuples() for x in _meet(r, k)]
            yield pd.DataFrame(rows, columns=["row", "query_id", "vec_id", "score"])

    pairs = blocks.join(queries, on).select(
        "ids", "size", "width", "kind", "data", *[c for c in queries.columns if c.startswith("q_")]
    )
    return pairs.mapInPandas(run, "row long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reaching(queries: DataFrame, buckets: Column) -> DataFrame:
    """Query blocks beside the buckets whose longest vector can still reach the bound of one of their queries."""
    each = queries.withColumn("b", F.explode(buckets)).where(F.col("b.longest") * (1 + 1e-9) >= F.col("q_least"))
    return each.select("*", "b.bucket").drop("b")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer products of each query row."""
    spark = vectors.sparkSession
    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    low = F.lit(float("-inf")).alias("theta")
    with settings(spark, {rows_a_batch: "1024"}):
        ints = stage(integer_vectors(vectors, scale), "integer-vectors")
        count = max(1, min(MOST_BUCKETS, ints.count() // BLOCK_ROWS))
        dealt = ints.select("*", low).repartitionByRange(count, F.desc("norm"), "vec_id")
        blocks = stage(_packed(dealt, BLOCK_ROWS).withColumn("bucket", F.spark_partition_id()), "vector-blocks")
        reach = blocks.groupBy("bucket").agg(F.max("norm_max").alias("longest")).orderBy(F.desc("longest"), "bucket").collect()
        asking = ints.where(is_query)

        def ask(queries: DataFrame, name: str) -> DataFrame:
            packed = _packed(queries.repartition(F.col("row")), QUERY_ROWS)
            return stage(packed.select(*[F.col(c).alias(f"q_{c}") for c in packed.columns]), name)

        unbound = ask(asking.select("*", low), "unbound-queries")
    with settings(spark, {rows_a_batch: "16"}):
        # the bucket of the longest vectors, repeated for so many groups of query blocks that all cores take part
        salts = spark.sparkContext.defaultParallelism
        salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        top = blocks.where(F.col("bucket") == (reach[0]["bucket"] if reach else -1)).withColumn("salt", salted)
        dealt = unbound.withColumn("salt", F.pmod(F.xxhash64("q_rows"), F.lit(salts)).cast("int"))
        first = stage(_best(_found(top, dealt, k, ["salt"]), k), "first-bucket")
    if not reach[1:]:
        return first.select("query_id", "rank", "vec_id", "score")
    kth = first.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("theta"))
    with settings(spark, {rows_a_batch: "1024"}):
        bounded = ask(asking.join(kth, "row", "left").fillna(float("-inf"), ["theta"]), "bounded-queries")
    with settings(spark, {rows_a_batch: "16"}):
        others = F.array(*[F.struct(F.lit(r["bucket"]).alias("bucket"), F.lit(r["longest"]).alias("longest")) for r in reach[1:]])
        rest = stage(_found(blocks, reaching(bounded, others), k, ["bucket"]), "later-buckets")
    return _best(rest.unionByName(first.drop("rank")), k).select("query_id", "rank", "vec_id", "score")
