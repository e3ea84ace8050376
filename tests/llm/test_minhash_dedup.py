import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duecheck.llm import minhash_dedup as near
from duecheck.llm import queries, words
from duecheck.sources.tables import noted

SMALL = "/root/testdata/sf0.01"


def word_list(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text)


def counted(text):
    w = word_list(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_similarity(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def closed(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_shingles_against_plain_counts(spark):
    texts = [None, "", "?!", "a b", "A b", "a b c d e", "a b c d e f a b c d e", "é ü a-b_c d", "x " * 3000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).collect()]
    hashed, whose, prints = near.shingles(*words.text_bytes(pa.array(texts)))
    seen, by_text = {}, defaultdict(Counter)
    for h, w in zip(hashed.tolist(), whose.tolist()):
        by_text[w][h] += 1
    for i, t in enumerate(texts):
        assert sorted(by_text[i].values()) == sorted(counted(t).values())
        w = word_list(t)
        for k, s in enumerate([tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []):
            assert seen.setdefault(s, hashed[whose == i][k]) == hashed[whose == i][k]
    assert len(set(seen.values())) == len(seen)
    prints = [tuple(p) for p in prints.tolist()]
    assert prints[0] == prints[1] != prints[2] and prints[3] == prints[4] != prints[5]


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(4)
    for overlap in (0.5, 0.8, 0.95):
        agreed, wanted = [], []
        for _ in range(12):
            h = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
            weight = rng.choice([1.0, 1.25, 2.3, 5.0], 400)
            a, b = rng.random(400) < (1 + overlap) / 2, rng.random(400) < (1 + overlap) / 2
            other = np.where(rng.random(400) < 0.1, weight * 2, weight)
            keys = [near.samples(h[m], np.zeros(m.sum(), np.int64), w[m], 1)[0] for m, w in ((a, weight), (b, other))]
            agreed.append(np.mean(keys[0] == keys[1]))
            wanted.append(near.similarity((h[a], weight[a]), (h[b], other[b])))
        assert abs(np.mean(agreed) - np.mean(wanted)) < 0.04


def test_components_against_union_find(spark):
    rng = np.random.default_rng(8)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 580)]
    links = spark.createDataFrame(pairs, "a long, b long")
    roots = closed(pairs, 600)
    got = {r.row: r.component for r in near.components(links).collect()}
    assert got == {i: roots[i] for p in pairs for i in p if p[0] != p[1]}
    assert near.components(links.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op1_minhash_dedup"])
def test_query_against_all_pairs(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    rows = queries.queries()[name](spark, SMALL).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert len(rows) == len(docs)
    bags = [counted(t) for t in docs.text]
    holders = defaultdict(list)
    for i, b in enumerate(bags):
        for k in b:
            holders[k].append(i)
    shared = {(i, j) for held in holders.values() for n, j in enumerate(held) for i in held[:n]}
    similar = {p: plain_similarity(bags[p[0]], bags[p[1]]) for p in shared}
    classes = rows.class_id.tolist()
    sure = [p for p, s in similar.items() if s >= 0.83]
    assert len(sure) > 50 and all(classes[a] == classes[b] for a, b in sure)
    loose = closed([p for p, s in similar.items() if s >= 0.77], len(docs))
    for i in range(len(docs)):
        first = docs.doc_id.tolist().index(classes[i])
        assert loose[i] == loose[first]
    assert rows.kept.sum() == len(set(classes)) and (rows.kept == (rows.index == rows.class_id)).all()


def test_a_chain_and_a_hot_group(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    rows, chain = [], list(base)
    for n in range(12):  # each like the one before, the ends unlike
        rows.append((n, " ".join(chain)))
        chain[15 * n] = f"new{n}"
        chain[15 * n + 1] = f"newer{n}"
    hot = [f"h{i}" for i in range(150)]
    for n in range(300):
        text = list(hot)
        text[int(rng.integers(150))] = f"edit{n}"
        rows.append((100 + n, " ".join(text)))
    rows += [(1000 + n, "q " * 3 + " ".join(f"u{n}x{i}" for i in range(60))) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.near_dedup(docs).collect()}
    assert {got[n] for n in range(12)} == {0}
    assert {got[100 + n] for n in range(300)} == {100}
    assert all(got[1000 + n] == 1000 + n for n in range(20))


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "?!", 3), (4, "?!", 4), (None, "a b", 5), (6, "A  b", 6), (6, "a b", 7), (8, "z " * 80_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_row int")
    got = near.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == Counter(
        [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (None, 6, 3), (6, 6, 3), (6, 6, 3), (8, 8, 1)]
    )
    assert sum(r.kept for r in got) == 4
    left = near.kept(docs)
    assert left.columns == docs.columns and left.count() == 4
    assert near.near_dedup(docs.limit(0)).collect() == [] and near.kept(docs.limit(0)).collect() == []
    assert near.near_dedup(docs.where(F.col("text") == "")).count() == 1


def test_a_hot_group_in_parts_stores_few_tables(spark):
    hot = [f"h{i}" for i in range(150)]
    rows = []
    for n in range(400):  # near copies of each other in chains of edits, so links are many steps long
        hot[n % 150] = f"edit{n}"
        rows.append((n, " ".join(hot)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with noted() as stored:
        got = near.near_dedup(docs).collect()
    assert len(stored) <= 22, [s.rsplit("/", 1)[1] for s in stored]
    assert {r.class_id for r in got} == {0}


def test_contraction_in_short_runs(spark):
    rng = np.random.default_rng(9)
    pairs = {(max(p), min(p)) for p in rng.integers(0, 60, (90, 2)).tolist() if p[0] != p[1]}
    edges = spark.createDataFrame([(u, v, False) for u, v in sorted(pairs)], "u long, v long, fresh boolean").coalesce(1)
    got = near._contracted(edges, 7).collect()
    assert closed([(r.u, r.v) for r in got], 60) == closed(pairs, 60)
    assert any(r.fresh for r in got) and all(r.u > r.v for r in got)
    settled = spark.createDataFrame([(u, u % 5, False) for u in range(5, 60)], "u long, v long, fresh boolean")
    got = near._contracted(settled, 7).distinct().collect()
    assert sorted(map(tuple, got)) == [(u, u % 5, False) for u in range(5, 60)]
