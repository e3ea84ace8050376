"""Scoring of findings against an answer key, by leak identity."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecheck.functions.numeric import half_up, ratio, whole
from duecheck.operators.joins import hot_join
from duecheck.schemas import IDENTITY, MONEY


def detectors(findings: DataFrame) -> DataFrame:
    """Arms that have written findings."""
    return findings.where(F.col("detected_by").isNotNull()).select("detected_by").distinct()


def found_leaks(findings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct identities per arm: a leak reported twice is one leak."""
    return (
        findings.where(F.col("detected_by").isNotNull())
        .select("detected_by", *scope, *IDENTITY)
        .distinct()
    )


def key_per_detector(
    answer_key: DataFrame,
    findings: DataFrame | None = None,
    arms: Sequence[str] | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """The key once per arm, so that every miss belongs to an arm.

    Naming ``arms`` also covers an arm without any finding. Otherwise the arms
    are those of ``findings``, read as one array value: no join is needed.
    """
    if arms is not None:
        names = F.array(*[F.lit(a) for a in arms])
    else:
        names = detectors(findings).agg(F.collect_list("detected_by")).scalar()
    return answer_key.select(F.explode(names).alias("detected_by"), *scope, *IDENTITY)


def verdicts(
    findings: DataFrame,
    answer_key: DataFrame,
    arms: Sequence[str] | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """TP, FP or FN per arm and identity.

    Presence is carried as a flag, so a finding without a customer is still a
    false alarm and not a miss.
    """
    keys = ["detected_by", *scope, *IDENTITY]
    found = found_leaks(findings, scope).withColumn("in_found", F.lit(True))
    truth = key_per_detector(answer_key, findings, arms, scope).withColumn("in_key", F.lit(True))
    outcome = (
        F.when(F.col("in_found") & F.col("in_key"), F.lit("TP"))
        .when(F.col("in_found"), F.lit("FP"))
        .otherwise(F.lit("FN"))
    )
    return found.join(truth, keys, "full_outer").select(*keys, outcome.alias("outcome"))


def _count(*outcomes: str) -> Column:
    return F.count_if(F.col("outcome").isin(*outcomes))


def scorecard(verdict: DataFrame, by: Sequence[str] = ("detected_by",)) -> DataFrame:
    """Counts, precision, recall and F1; a share over nothing is NULL."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return (
        verdict.groupBy(*by)
        .agg(
            _count("TP").alias("true_positives"),
            _count("FP").alias("false_positives"),
            _count("FN").alias("false_negatives"),
        )
        .select(
            *by,
            "true_positives",
            "false_positives",
            "false_negatives",
            (tp + fp).alias("total_reported"),
            (tp + fn).alias("total_actual"),
            ratio(tp, tp + fp).alias("precision"),
            ratio(tp, tp + fn).alias("recall"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        )
        .orderBy(F.desc_nulls_first("f1"), *by)
    )


def scorecard_by_type(verdict: DataFrame) -> DataFrame:
    card = scorecard(verdict, ["detected_by", "leak_type"])
    return card.select(
        "detected_by",
        "leak_type",
        F.col("true_positives").alias("tp"),
        F.col("false_positives").alias("fp"),
        F.col("false_negatives").alias("fn"),
        "precision",
        "recall",
    ).orderBy("detected_by", F.desc("fn"), "leak_type")


def misses(verdict: DataFrame, answer_key: DataFrame) -> DataFrame:
    """Leaks of the key that an arm did not report, with what they were worth."""
    missed = verdict.where(F.col("outcome") == "FN").drop("outcome")
    planted = answer_key.select(
        *IDENTITY,
        "customer_name",
        F.col("estimated_recovery").alias("missed_dollars"),
        F.col("detail").alias("what_was_planted"),
    )
    return missed.join(planted, IDENTITY).select(
        "detected_by",
        "leak_type",
        "customer_name",
        "month",
        "product",
        "missed_dollars",
        "what_was_planted",
    ).orderBy(F.desc_nulls_first("missed_dollars"), "detected_by", "leak_type", "customer_name", "month", "product")


def _findings_with(findings: DataFrame, verdict: DataFrame, outcome: str, how: str) -> DataFrame:
    """Findings of one outcome. An identity may hold many findings, hence hot_join."""
    chosen = verdict.where(F.col("outcome") == outcome).drop("outcome")
    return hot_join(findings, chosen, ["detected_by", *IDENTITY], how)


def false_alarms(verdict: DataFrame, findings: DataFrame, chars: int = 120) -> DataFrame:
    """Reported leaks that the key does not hold, with the start of their evidence."""
    return _findings_with(findings, verdict, "FP", "left_semi").select(
        "detected_by",
        "leak_type",
        "customer_name",
        "month",
        "product",
        F.col("estimated_recovery").alias("claimed_dollars"),
        F.substring("evidence", 1, chars).alias("claimed_evidence"),
    ).orderBy(F.desc_nulls_first("claimed_dollars"), "detected_by", "leak_type", "customer_name", "month", "product")


def _matched(verdict: DataFrame, findings: DataFrame, answer_key: DataFrame) -> DataFrame:
    """Findings of true positives beside the key's dollars (claimed, actual)."""
    confirmed = verdict.where(F.col("outcome") == "TP").join(
        answer_key.select(*IDENTITY, F.col("estimated_recovery").cast(MONEY).alias("actual")), IDENTITY
    )
    return hot_join(
        findings.withColumn("claimed", F.col("estimated_recovery").cast(MONEY)),
        confirmed.select("detected_by", *IDENTITY, "actual"),
        ["detected_by", *IDENTITY],
        sized_by=[verdict, answer_key],
    )


def dollar_accuracy(verdict: DataFrame, findings: DataFrame, answer_key: DataFrame) -> DataFrame:
    """Claimed against actual dollars on true positives, per arm and type.

    The mean is over findings, so one large leak does not hide the error on
    small ones. Each error is taken to a millionth of a percent and the mean
    to one decimal, all on whole numbers.
    """
    gap = whole(F.abs(F.col("claimed") - F.col("actual")) * 100)
    error = half_up(gap * 100_000_000, whole(F.col("actual") * 100))
    return (
        _matched(verdict, findings, answer_key)
        .withColumn("error", error.cast("decimal(20,0)"))
        .groupBy("detected_by", "leak_type")
        .agg(
            F.count("*").alias("leaks_scored"),
            F.sum("claimed").alias("detected_total"),
            F.sum("actual").alias("actual_total"),
            F.sum("error").alias("error"),
            F.count("error").alias("n_error"),
        )
        .select(
            "detected_by",
            "leak_type",
            "leaks_scored",
            "detected_total",
            "actual_total",
            (F.col("detected_total") - F.col("actual_total")).alias("dollar_error"),
            (half_up(F.col("error"), F.col("n_error") * 100_000) / F.lit(10)).alias("mean_abs_pct_error"),
        )
        .orderBy("detected_by", F.abs("dollar_error").desc_nulls_first(), "leak_type")
    )


def confirmed_leaks(verdict: DataFrame, answer_key: DataFrame) -> DataFrame:
    """True positives with the key's dollars."""
    return (
        verdict.where(F.col("outcome") == "TP")
        .drop("outcome")
        .join(answer_key.select(*IDENTITY, F.col("estimated_recovery").cast(MONEY).alias("actual")), IDENTITY)
    )


def confirmed_value(verdict: DataFrame, answer_key: DataFrame) -> DataFrame:
    """Confirmed leaks and dollars per arm and type with subtotals.

    ``level`` is 0 for a row per type, 1 for an arm's total, 3 for the grand
    total; it tells a subtotal from a NULL name.
    """
    return (
        confirmed_leaks(verdict, answer_key)
        .rollup("detected_by", "leak_type")
        .agg(
            F.grouping_id().cast("long").alias("level"),
            F.count("*").alias("confirmed_leaks"),
            F.sum("actual").alias("recoverable_dollars"),
        )
        .orderBy(F.asc_nulls_last("detected_by"), F.desc_nulls_first("recoverable_dollars"), F.desc("level"), "leak_type")
    )


def confirmed_total(verdict: DataFrame, answer_key: DataFrame, arm: str) -> DataFrame:
    chosen = verdict.where(F.col("detected_by") == arm)
    zero = F.lit(0).cast("decimal(28,2)")
    return confirmed_leaks(chosen, answer_key).agg(
        F.coalesce(F.sum("actual"), zero).alias("recoverable_dollars")
    )


def arm_counts(verdict: DataFrame, arm: str) -> DataFrame:
    return verdict.where(F.col("detected_by") == arm).agg(
        _count("TP").alias("tp"),
        _count("FP").alias("fp"),
        _count("FN").alias("fn"),
        F.count("*").alias("total"),
    )
