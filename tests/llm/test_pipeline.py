from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from duecheck.llm import quality_gam, queries
from duecheck.llm.common import fold, table
from duecheck.llm.sentencepiece_nbest import Vocabulary, decode_ids

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table after each stage, each run on what the one before kept."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = table(spark, SMALL, "documents")
    out = [docs.toPandas()]
    for n, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SMALL).write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:-1])
    assert list(stages[-1].columns)[: len(stages[0].columns)] == list(stages[0].columns)


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(stages[1].doc_id)
    known = stages[0][stages[0].doc_id.isin(labels.index)].doc_id
    good = [d for d in known if labels[d] == 1]
    bad = [d for d in known if labels[d] == 0]
    assert sum(d in kept for d in good) >= 0.99 * len(good) and sum(d in kept for d in bad) < 0.2 * len(bad)
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    scores = quality_gam.score(docs, model).collect()
    assert kept == {r.doc_id for r in scores if r.score >= 0.3}


def test_one_of_each_group_stays(stages):
    texts = [" ".join(t.split()) for t in stages[1].text]
    assert len(stages[2]) == len(set(texts))
    assert set(stages[3].doc_id) <= set(stages[2].doc_id) and len(stages[3]) < len(stages[2])


def test_mix_and_pieces(stages):
    drawn = Counter(stages[4].doc_id)
    assert set(drawn) <= set(stages[3].doc_id) and max(drawn.values()) <= 2
    assert Counter(stages[5].doc_id) == drawn
    words = stages[4].text.map(lambda t: len(t.split())).sum() / stages[3].text.map(lambda t: len(t.split())).sum()
    assert 1.4 < words < 1.55
    vocabulary = Vocabulary.read()
    for r in stages[5].itertuples():
        assert decode_ids(vocabulary, r.ids) == r.text and r.n_pieces == len(r.ids)


def test_run_is_the_stages(spark, stages):
    got = queries.queries()["pipeline"](spark, SMALL).select("doc_id", "n_pieces").toPandas()
    assert Counter(zip(got.doc_id, got.n_pieces)) == Counter(zip(stages[-1].doc_id, stages[-1].n_pieces))


ROWS = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, None, None, None, None), (2, "", "en", None, 0), (3, "é " * 100_000, "fr", "t", 9)]


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd rows", "no rows"])
def test_every_stage_takes_odd_tables(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, row string, best int"
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema)
    for name, function in corpus_pipeline.STAGES:
        got = function(spark, docs, SMALL)
        if name == "sentencepiece":
            got = got.select(*[F.col(c) for c in ("doc_id", "text", "ids")])
        else:
            assert got.columns == docs.columns
        assert (got.count() > 0) == bool(rows)
