import math
from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from duecheck.llm import ann_collision, queries

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every, k):
    """Exact neighbours, products summed in the order of components."""
    kept = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        kept.append((i, [float(x) for x in v]))
    width = max((len(v) for _, v in kept), default=0)
    ids = np.array([i for i, _ in kept], np.int64)
    data = np.zeros((len(kept), width))
    for n, (_, v) in enumerate(kept):
        data[n, : len(v)] = v
    out = defaultdict(list)
    for n, (i, _) in enumerate(kept):
        if i % every:
            continue
        score = np.add.accumulate(data * data[n], axis=1)[:, -1]
        others = np.flatnonzero(ids != i)
        best = others[np.lexsort((ids[others], -score[others]))][:k]
        out[i].append([(int(ids[j]), float(score[j])) for j in best])
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, wanted):
    whole = [(q, v) for q, lists in wanted.items() for v, _ in lists[0]]
    return sum(v in {x for x, _ in got[q]} for q, v in whole) / len(whole)


def test_threshold_fits_its_statement():
    p = 2 * NormalDist().cdf(ann_collision.HALF_WIDTH) - 1
    m, least = ann_collision.PROJECTIONS, ann_collision.COLLISIONS
    missed = sum(math.comb(m, x) * p**x * (1 - p) ** (m - x) for x in range(least))
    assert missed < 0.006


def test_query_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = found(queries.queries()["op11_nearest"](spark, SMALL))
    wanted = brute(rows, 20, 20)
    assert set(got) == set(wanted) and all(len(v) == 20 for v in got.values())
    assert recall(got, wanted) >= 0.98
    exact = {q: dict(lists[0]) for q, lists in brute(rows, 20, len(rows)).items()}
    assert all(exact[q][v] == s for q, found_ in got.items() for v, s in found_)
    assert all(f == sorted(f, key=lambda x: (-x[1], x[0])) for f in got.values())


@pytest.mark.parametrize("lengths", [(1.0,), (0.01, 1.0, 30.0)])
def test_many_blocks(spark, monkeypatch, lengths):
    """Clusters, many copies of one vector, unlike lengths; several blocks, so that bounds and pruning work."""
    monkeypatch.setattr(ann_collision, "BLOCK_ROWS", 200)
    monkeypatch.setattr(ann_collision, "QUERY_ROWS", 20)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    data = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 24))
    data *= rng.choice(lengths, 1500)[:, None]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(data)]
    rows += [(2000 + i, rows[7][1]) for i in range(600)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got, wanted = found(ann_collision.nearest(df, F.col("vec_id") % 20 == 0, 10)), brute(rows, 20, 10)
    assert set(got) == set(wanted) and all(len(v) == 10 for v in got.values())
    assert recall(got, wanted) >= 0.97


def test_odd_vectors(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [
        (0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []),
        (None, [9.0, 9.0]), (7, [None, 1.0]), (8, [0.0, 0.0]), (10, [1e18, 1e18]), (20, [1e-30, 0.0]), (30, [0.5, -1.0]), (5, [2.0]),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA, verifySchema=False)
    got = found(ann_collision.nearest(df, F.col("vec_id") % 10 == 0, 4))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == {q: lists[0] for q, lists in brute(rows, 10, 4).items()}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_repeated_queries_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = ann_collision.nearest(df, F.col("vec_id") == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 3.0), (0, 1, 1, 4.0)]
    assert ann_collision.nearest(df.limit(0), F.col("vec_id") == 0, 5).collect() == []
    assert ann_collision.nearest(df, F.col("vec_id") == 99, 5).collect() == []
