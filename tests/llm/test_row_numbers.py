"""Results when the splits of the input change between two scans, as when an executor is lost."""

from itertools import count

import pytest

from duecheck.llm import common, exact_dedup, minhash_dedup, mixing

BYTES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, tmp_path, monkeypatch):
    """Stored documents whose scan is cut anew after each stored table."""
    rows = [(i, " ".join(f"w{i % 150}x{n}" for n in range(40)), "abc"[i % 150 % 3]) for i in range(300)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made.repartition(12, "doc_id").write.parquet(f"{tmp_path}/documents")
    turn = count()

    def shifting(df, name, stage=common.stage if hasattr(common, "stage") else exact_dedup.stage):
        out = stage(df, name)
        spark.conf.set(BYTES, "1g" if next(turn) % 2 else "1k")
        return out

    for module in (common, exact_dedup, minhash_dedup, mixing):
        monkeypatch.setattr(module, "stage", shifting, raising=False)
    before = {k: spark.conf.get(k) for k in (BYTES, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield spark.read.parquet(f"{tmp_path}/documents")
    spark.conf.unset("spark.sql.files.minPartitionNum")
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("module", [exact_dedup, minhash_dedup])
def test_one_of_each_group_is_kept(docs, module):
    kept = module.kept(docs).collect()
    assert sorted(r.doc_id for r in kept) == list(range(150))
