"""Checks on extracted terms and on their fit with billing."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecheck.operators.detect import LEAK_TYPES
from duecheck.schemas import RATE


def arm_rows(frame: DataFrame, arm: str) -> DataFrame:
    return frame.where(F.col("extraction_method") == arm)


def bad_terms(terms: DataFrame) -> DataFrame:
    """Terms without product or without a positive rate; expect none."""
    return terms.where(
        F.col("product").isNull() | F.col("contract_rate").isNull() | (F.col("contract_rate") <= 0)
    )


def bad_clauses(meta: DataFrame) -> DataFrame:
    """Accounts whose discount or minimum is stated but unusable, so not checked; expect none."""
    return meta.where(F.col("discount_pct").isNull() | F.col("min_monthly_commit").isNull())


def uncovered_billing(
    billing: DataFrame, terms: DataFrame, arm: str, ignore: Sequence[str] = ()
) -> DataFrame:
    """Billed (customer, product) pairs that the arm has no term for.

    The rate check skips such lines without a word. ``ignore`` lists products
    that no contract prices, such as true-up lines.
    """
    pairs = billing.where(~F.col("product").isin(list(ignore))) if ignore else billing
    # Distinct pairs are as small as the terms, whatever one pair weighs in billing.
    return pairs.select("customer_id", "customer_name", "product").distinct().join(
        arm_rows(terms, arm).select("customer_id", "product"), ["customer_id", "product"], "left_anti"
    )


def coverage(terms: DataFrame) -> DataFrame:
    """Customers and term rows by arm."""
    # Counting per customer first keeps one arm's rows from meeting in one task.
    return (
        terms.groupBy("extraction_method", "customer_id")
        .agg(F.count("*").alias("n"))
        .groupBy("extraction_method")
        .agg(F.count("customer_id").alias("customers"), F.sum("n").alias("term_rows"))
    )


def term_disagreements(
    terms: DataFrame, arm_a: str, arm_b: str, tolerance: str = "0.0001"
) -> DataFrame:
    """Terms that one arm lacks or that the arms price differently."""
    keys = ["customer_id", "product"]
    a = arm_rows(terms, arm_a).select(*keys, F.col("contract_rate").alias("rate_a"), F.lit(1).alias("in_a"))
    b = arm_rows(terms, arm_b).select(*keys, F.col("contract_rate").alias("rate_b"), F.lit(1).alias("in_b"))
    zero = F.lit(0).cast(RATE)
    gap = F.abs(F.coalesce("rate_a", zero) - F.coalesce("rate_b", zero))
    label = (
        F.when(F.col("in_a").isNull(), F.lit(f"{arm_b} only"))
        .when(F.col("in_b").isNull(), F.lit(f"{arm_a} only"))
        .otherwise(F.lit("rate differs"))
    )
    return (
        a.join(b, keys, "full_outer")
        .where(F.col("in_a").isNull() | F.col("in_b").isNull() | (gap > F.lit(tolerance).cast(RATE)))
        .select(*keys, "rate_a", "rate_b", label.alias("disagreement"))
    )


_CLAUSES = {
    "discount_pct": "disc",
    "discount_valid_through": "expiry",
    "min_monthly_commit": "min",
}


def clause_comparison(meta: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """Account clauses of two arms side by side."""
    sides = [
        arm_rows(meta, arm).select(
            "customer_id", *[F.col(c).alias(f"{short}_{side}") for c, short in _CLAUSES.items()]
        )
        for arm, side in ((arm_a, "a"), (arm_b, "b"))
    ]
    return sides[0].join(sides[1], "customer_id")


def clause_listing(meta: DataFrame, arm: str) -> DataFrame:
    return arm_rows(meta, arm).orderBy("customer_id")


def count_tripwire(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Count and sum per arm and type against an expected range of counts.

    A sum alone hides a lost filter: rows billed right add nothing to it.
    ``expected``: detected_by, leak_type, at_least, at_most.
    """
    keys = ["detected_by", "leak_type"]
    found = findings.groupBy(*keys).agg(
        F.count("*").alias("found"), F.sum("estimated_recovery").alias("total_recovery")
    )
    count = F.coalesce("found", F.lit(0))
    return found.join(expected, keys, "full_outer").select(
        *keys,
        count.alias("found"),
        F.coalesce("total_recovery", F.lit(0).cast("decimal(28,2)")).alias("total_recovery"),
        F.coalesce(count.between(F.col("at_least"), F.col("at_most")), F.lit(False)).alias("in_range"),
    )


def unknown_types(answer_key: DataFrame) -> DataFrame:
    """Leak types in the key that no detector branch produces."""
    return answer_key.select("leak_type").distinct().where(~F.col("leak_type").isin(LEAK_TYPES))


def duplicate_terms(terms: DataFrame) -> DataFrame:
    """(arm, customer, product) with several terms: each multiplies the findings."""
    keys = ["extraction_method", "customer_id", "product"]
    return terms.groupBy(*keys).agg(F.count("*").alias("n_terms")).where("n_terms > 1")


def duplicate_lines(billing: DataFrame) -> DataFrame:
    """(customer, month, product) with several billing lines."""
    keys = ["customer_id", "month", "product"]
    return billing.groupBy(*keys).agg(F.count("*").alias("n_lines")).where("n_lines > 1")
