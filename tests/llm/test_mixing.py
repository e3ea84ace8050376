import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from duecheck.llm import mixing, queries

SMALL = "/root/testdata/sf0.01"


def by_hand(sizes, weights):
    """Targets by raising one common level until all words are given out."""
    total, caps = 1.5 * sum(sizes), [2 * s for s in sizes]
    low, high = 0.0, total + 1
    for _ in range(200):
        level = (low + high) / 2
        given = sum(min(c, w * level) for c, w in zip(caps, weights))
        low, high = (level, high) if given < total else (low, level)
    return [min(c, w * high) for c, w in zip(caps, weights)]


def targets(spark, sizes, weights):
    rows = [(n, s) for n, s in enumerate(sizes)]
    found = mixing.with_targets(spark.createDataFrame(rows, "rank long, size long"), (3, 1, 2))
    return [r.target for r in found.orderBy("rank").collect()]


def test_targets(spark):
    for sizes in ([10, 10, 10], [1000, 1, 50, 0, 7], [5], [0, 0], []):
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        got = targets(spark, sizes, weights)
        assert np.allclose(got, by_hand(sizes, weights), atol=1e-6)
        assert all(t <= 2 * s for t, s in zip(got, sizes))


def test_quotas_are_exact_and_even():
    quotas = mixing.shard_quotas([1000, 10, 333, 0], 7, 3)
    assert quotas.sum(0).tolist() == [1000, 10, 333, 0]
    assert quotas.sum(1).max() - quotas.sum(1).min() <= 3
    assert (quotas == mixing.shard_quotas([1000, 10, 333, 0], 7, 3)).all()
    draws = [mixing.shard_quotas([60, 40], 2, s)[0, 0] for s in range(400)]
    assert abs(np.mean(draws) - 30) < 0.5 and abs(np.var(draws) - 50 * 0.6 * 0.4 * 50 / 99) < 1.2


@pytest.mark.parametrize("leaf, off", [(4096, 0.01), (24, 0.03)])
def test_query_against_hand_count(spark, monkeypatch, leaf, off):
    """With small leaves the cells are cut several times, but have fewer documents to fill the rest with."""
    monkeypatch.setattr(mixing, "LEAF", leaf)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").toPandas()
    docs["size"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text]
    run = queries.queries()["op6_source_mixing"]
    got = run(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    again = run(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[["doc_id", "taken"]].equals(again[["doc_id", "taken"]])
    got = got.merge(docs[["doc_id", "size", "source"]], on="doc_id", suffixes=("", "_own"))
    assert len(got) == len(docs) and (got["size"] == got.size_own).all()
    per = docs.groupby("source")["size"].sum().sort_index()
    wanted = dict(zip(per.index, by_hand(per.tolist(), [(3, 1, 2)[i % 3] for i in range(len(per))])))
    for source, part in got.groupby("source"):
        assert (part.source_size == per[source]).all() and np.allclose(part.target, wanted[source])
        assert abs(part.taken.sum() - wanted[source]) <= off * wanted[source]
    assert (got.taken <= 2 * got["size"]).all() and (got.shards.map(len) * got["size"] == got.taken).all()


def test_odd_rows(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, None, 2), (3, "", "y", 3), (4, "w " * 90_000, None, 4)]
    rows += [(10 + i, "q r s t", "z", 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.report(docs, shards=4).collect()
    assert len(got) == len(rows)
    assert Counter(r["size"] for r in got) == Counter([2, 2, 0, 0, 90_000] + [4] * 60)
    mixed = mixing.mixed(docs, shards=4)
    assert mixed.columns == docs.columns
    taken = defaultdict(int)
    for r in got:
        taken[r.doc_id] += r.taken
    for r in mixed.collect():
        taken[r.doc_id] -= len((r.text or "").split())
    assert set(taken.values()) == {0}
    assert mixing.report(docs.limit(0)).collect() == []
    assert all(r.taken == 0 for r in mixing.report(docs.where("text = '' or text is null")).collect())


@pytest.mark.parametrize("rows", [0, 40])
def test_reruns_agree_however_the_input_is_split(spark, tmp_path, rows):
    """Also with repeated rows, and with rows in another order; the mixed documents come out alike, in order."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.limit(rows)).unionByName(docs.limit(rows // 2))
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    docs.repartition(7).write.parquet(f"{tmp_path}/seven")
    seen, drawn = [], []
    for name, size in (("one", "128m"), ("one", "64k"), ("seven", "16k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = spark.read.parquet(f"{tmp_path}/{name}")
            seen.append(Counter(map(tuple, mixing.report(read).select("doc_id", "taken", F.col("shards").cast("string")).collect())))
            drawn.append([r.doc_id for r in mixing.mixed(read, shards=5).collect()])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2] and drawn[0] == drawn[1] == drawn[2]
    assert sum(seen[0].values()) == 1000 + rows + rows // 2


def test_many_small_sources(spark):
    """More sources than groups; what is dealt adds up to what is taken."""
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 500}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.report(docs, shards=11).toPandas()
    assert (got.shards.map(len) * got["size"] == got.taken).all() and (got.taken <= 2 * got["size"]).all()
    per_shard = Counter(s for shards in got.shards for s in shards)
    assert set(per_shard) == set(range(11))
    assert mixing.mixed(docs, shards=11).count() == got.shards.map(len).sum()


def test_draws_beyond_numpy():
    rng = np.random.default_rng(4)
    draws = [mixing._hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(3000)]
    assert abs(np.mean(draws) - 750) < 1.5 and abs(np.std(draws) - np.sqrt(1000 * 0.75 * 0.25)) < 0.7
    assert mixing._hypergeometric(rng, 2 * 10**9, 10, 2 * 10**9) in range(2 * 10**9 - 10, 2 * 10**9 + 1)
    assert mixing.shard_quotas([2 * 10**9, 5, 10**9], 3, 1).sum(0).tolist() == [2 * 10**9, 5, 10**9]


def test_a_last_cell_is_filled_well():
    rng = np.random.default_rng(8)
    for _ in range(200):
        sizes = rng.integers(0, 60, rng.integers(1, 40))
        left = int(rng.integers(0, sizes.sum() + 2))
        taken = mixing.filled(sizes, left)
        gap = left - int(sizes[taken].sum())
        assert gap >= 0 and not taken[sizes == 0].any()
        rest = sizes[~taken & (sizes > 0)]
        assert not (rest <= gap).any()
        assert all(a >= b or b - a > gap for b in rest for a in sizes[taken])
