import numpy as np
import pytest
from pyspark.sql import functions as F

from duecheck.llm import topk_search


def brute(rows, queries, k):
    ints = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints[i] = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    out = set()
    for q in ints:
        if q % queries:
            continue
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def found(spark, rows, queries=5, k=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int", verifySchema=False)
    return {tuple(r) for r in topk_search.exact_topk(df, F.col("vec_id") % queries == 0, k).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.01, 1, 3])).tolist(), 0) for i in range(150)]
    rows += [(200 + i, rows[3][1], 0) for i in range(30)]
    assert found(spark, rows) == brute([r[:2] for r in rows], 5, 4)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0], 0), (1, [0.5, -1.0], 0), (2, None, 0), (3, [float("nan"), 1.0], 0),
        (4, [float("inf"), 1.0], 0), (5, [1.0], 0), (6, [], 0), (None, [9.0, 9.0], 0), (7, [None, 1.0], 0),
        (10, [1e9, 1e9], 0),
    ]
    assert found(spark, rows) == brute([r[:2] for r in rows], 5, 4)


def test_empty(spark):
    assert found(spark, []) == set()


def test_buckets_out_of_reach_are_not_joined(spark):
    queries = spark.createDataFrame([(b"a", 5.0), (b"b", float("-inf")), (b"c", 0.5)], "q_rows binary, q_least double")
    buckets = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(n).alias("longest")) for i, n in enumerate((9.0, 1.0, 0.1))])
    got = {(bytes(r.q_rows), r.bucket) for r in topk_search.reaching(queries, buckets).collect()}
    assert got == {(b"a", 0), (b"b", 0), (b"b", 1), (b"b", 2), (b"c", 0), (b"c", 1)}


def test_short_vectors_prune_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * (5 if i < 40 else 0.01)).tolist(), 0) for i in range(160)]
    joined, reaching = [], topk_search.reaching
    monkeypatch.setattr(topk_search, "reaching", lambda q, b: joined.append((q.count() * (len(rows) // 16 - 1), reaching(q, b).count())) or reaching(q, b))
    assert found(spark, rows) == brute([r[:2] for r in rows], 5, 4)
    assert joined and joined[0][1] < joined[0][0]


@pytest.mark.parametrize("rows", [[(0, [3e9, 3e9]), (1, [3e9, 2e9])], [(0, [1e30]), (1, [1.0])]])
def test_what_leaves_64_bits_is_an_error(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.exact_topk(df, F.col("vec_id") == 0, 3).collect()


def test_large_products_are_exact(spark):
    df = spark.createDataFrame([(0, [4e8, 1.0]), (1, [5e3, 3.0]), (2, [-5e3, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk_search.exact_topk(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert got == [(1, 1024 * 1024 * (4 * 10**8 * 5000 + 3)), (2, 1024 * 1024 * (-4 * 10**8 * 5000 + 2))]
