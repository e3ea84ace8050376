import numpy as np
import pyarrow as pa

from duecheck.llm import quality_gam, queries, words

DATA = "/root/testdata/sf0.1"
ODD = [None, "", " \n\t ", "a", "é" * 50_000, "WORD " * 40_000, "$$$ ### |", "x\n\ny\n\n", "a b a b a b", "🙂🙂"]


def plain(text: str) -> dict[str, float]:
    """Some of the features, counted the slow way."""
    text = text or ""
    found = [w for w in text.replace("\v", " ").replace("\f", " ").split() if w]
    lines = [x.split() for x in text.split("\n") if x.split()]
    n, size = max(1, len(found)), max(1, len(text.encode()))
    pairs = list(zip(found, found[1:]))
    return {
        "log_bytes": np.log1p(len(text.encode())),
        "log_words": np.log1p(len(found)),
        "upper": sum("A" <= c <= "Z" for c in text) / size,
        "wide": sum(len(c.encode()) for c in text if ord(c) > 127) / size,
        "bars": text.count("|") / size,
        "distinct": len(set(found)) / n if found else 1,
        "top_word": max((found.count(w) for w in set(found)), default=0) / n,
        "repeats": sum(a == b for a, b in pairs) / n,
        "repeated_pairs": 1 - len(set(pairs)) / len(pairs) if pairs else 0,
        "word_length": sum(len(w.encode()) for w in found) / n,
        "words_a_line": len(found) / max(1, len(lines)),
        "repeated_lines": 1 - len({tuple(x) for x in lines}) / len(lines) if lines else 0,
    }


def test_features_against_plain_counts(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    got = quality_gam.features(*words.text_bytes(pa.array(texts)))
    for row, text in zip(got, texts, strict=True):
        for name, value in plain(text).items():
            assert np.isclose(row[quality_gam.FEATURES.index(name)], value), (name, text[:40] if text else text)


def test_fit_learns_a_shape_and_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((np.abs(x[:, 0] - 0.5) < 0.25) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.8


def test_held_out_rows(spark):
    from pyspark.sql import functions as F

    rows = queries.queries()["op4_quality_gam"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    found = rows.where("held_out").join(labels, "doc_id").where(F.col("quality").isNotNull()).toPandas()
    assert len(found) > 500
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert (good.predicted == 1).mean() > 0.995 and (bad.predicted == 0).mean() > 0.95
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)] + [(None, "a", 1), (1, "", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id long, quality int")
    model = quality_gam.train(docs, labels, labels.doc_id.isNotNull())
    got = quality_gam.score(docs, model, "s").collect()
    assert len(got) == len(ODD) + 2 and {r.s for r in got} == {0.5}
    only = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    model = quality_gam.train(docs, only, only.doc_id > 0)
    assert all(r.s > 0.5 for r in quality_gam.score(docs, model, "s").collect())
    assert quality_gam.score(docs.limit(0), model, "s").collect() == []
