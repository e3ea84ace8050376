"""Joins beyond the broadcast limit, with a third of all rows on one key."""

import pytest
from pyspark.sql import functions as F

from duecheck.operators import detect
from duecheck.operators.joins import HOT_SHARE, hot_join, hot_keys
from duecheck.sources.tables import stage


@pytest.fixture(scope="module")
def large(spark):
    """3,000 rows on key 0, 3,000 without key, the rest spread over 3,000 keys; copies among them."""
    n = F.col("id")
    k = F.when(n < 3000, F.lit(0)).when(n >= 6000, n % 3000 + 1)
    return stage(spark.range(9000).select(k.alias("k"), (n % 7).alias("v")), "large")


@pytest.fixture(scope="module")
def small(spark):
    return stage(spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")), "small")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_the_plain_join(large, small, shuffled, how):
    found = hot_join(large, small, ["k"], how)
    plain = large.join(small, ["k"], how).select(*found.columns)
    assert found.exceptAll(plain).isEmpty()
    assert plain.exceptAll(found).isEmpty()


def test_spread_by_columns_gives_the_same_rows(large, small, shuffled):
    found = hot_join(large, small, ["k"], spread=["v"], counted_on=large)
    plain = large.join(small, ["k"]).select(*found.columns)
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_hot_keys_are_few_and_cut_small(large):
    rows = hot_keys(large, ["k"], 100).collect()
    assert [(r["k"], r["_pieces"]) for r in rows] == [(0, 34)]
    assert hot_keys(large, ["k"]).count() <= HOT_SHARE


def test_hot_key_is_spread_over_tasks(large, small, shuffled):
    found = hot_join(large, small, ["k"], share=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_piece" in plan and "SortMergeJoin" in plan


def test_small_side_is_broadcast(large, small):
    plan = hot_join(large, small, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_piece" not in plan


def test_other_join_types_are_refused(large, small):
    with pytest.raises(ValueError):
        hot_join(large, small, ["k"], "full_outer")


def test_lines_that_need_no_clause_are_dealt_out(spark, ws, shuffled):
    """Rate leaks join no clause; beyond the broadcast limit, and without adaptive splitting, no task gets them all."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = detect.line_leaks(ws["volume_billing"], ws["volume_terms"], ws["volume_meta"])
        per_task = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(per_task) == 16 and per_task[-1] <= 3 * per_task[8]
