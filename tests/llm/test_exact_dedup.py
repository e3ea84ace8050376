import hashlib

from duecheck.llm import exact_dedup

ROWS = [
    (5, "a  b", 1), (3, "a b", 2), (None, "a\tb", 3), (3, "a b", 4),
    (7, None, 5), (8, "", 6), (9, " ", 7), (10, "x" * 300_000, 8), (11, "x" * 300_000, 9),
]
SCHEMA = "doc_id long, text string, digest int"


def test_groups_ties_and_nulls(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.exact_dedup(docs).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.digest, []).append(r)
    same = by_text[hashlib.sha256(b"a b").hexdigest()]
    assert [(r.keep_id, r.group_size) for r in same] == [(3, 4)] * 4
    assert [r.doc_id for r in same if r.kept] == [3]
    assert [r.doc_id for r in by_text[hashlib.sha256(b"").hexdigest()] if r.kept] == [7]
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == 4


def test_kept_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = exact_dedup.kept(docs)
    assert left.columns == docs.columns
    assert sorted(r.digest for r in left.collect()) == [2, 5, 7, 8]


def test_a_digest_of_two_texts_is_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(c.cast("string"), 1, 1))
    docs = spark.createDataFrame([(1, "ax"), (2, "ay"), (3, "ax"), (4, "b")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(docs).collect() == []
    assert exact_dedup.kept(docs).collect() == []
