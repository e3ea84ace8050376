"""Checks right after a load."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecheck.sources.snapshots import snapshot


def load_audit(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Rows per table beside the expected count (table_name, expected)."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return _beside(reduce(DataFrame.unionByName, counts), expected)


def _beside(found: DataFrame, expected: DataFrame) -> DataFrame:
    return found.join(expected, "table_name", "left").select(
        "table_name",
        "row_count",
        "expected",
        F.col("row_count").eqNullSafe(F.col("expected")).alias("as_expected"),
    )


def load_audit_from_log(spark: SparkSession, paths: dict[str, str], expected: DataFrame) -> DataFrame:
    """:func:`load_audit` of versioned tables: the counts are those taken while the rows were written, no data is read."""
    counted = [(name, sum(snapshot(spark, path).rows.values())) for name, path in paths.items()]
    found = spark.createDataFrame(counted, "table_name string, row_count long")
    return _beside(found, expected)


def document_profile(contracts: DataFrame) -> DataFrame:
    """Count and lengths: a shredded document shows as many short texts."""
    chars = F.length("contract_text")
    return contracts.agg(
        F.count("*").alias("n_contracts"),
        F.avg(chars).alias("avg_chars"),
        F.min(chars).cast("long").alias("min_chars"),
    )


def document_sample(contracts: DataFrame, n: int = 3, chars: int = 120) -> DataFrame:
    """Heads of the first ``n`` documents by customer."""
    head = F.substring("contract_text", 1, chars).alias("contract_head")
    return contracts.orderBy("customer_id").limit(n).select("customer_id", "customer_name", head)
