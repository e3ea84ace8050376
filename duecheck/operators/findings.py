"""Findings: labelled, identified candidates that keep their reviewed memos."""

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecheck import schemas
from duecheck.functions.hashing import stable_id
from duecheck.operators.joins import hot_join
from duecheck.schemas import ARM_IDENTITY, IDENTITY, MONEY
from duecheck.sources.snapshots import Snapshot, read_table, replace_parts

# Labels of the known arms; any other method is prefixed.
ARM_LABELS = {"regex_baseline": "sql_baseline", "json_terms": "json_terms"}


def arm_label(method: Column) -> Column:
    label = F.concat(F.lit("sql_"), method)
    for known, name in ARM_LABELS.items():
        label = F.when(method == known, F.lit(name)).otherwise(label)
    return label


def label_arms(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("detected_by", arm_label(F.col("extraction_method"))).drop(
        "extraction_method"
    )


def latest_memos(previous: DataFrame) -> DataFrame:
    """One memo per arm and leak identity, the newest where there are several."""
    return (
        previous.where(F.col("draft_memo").isNotNull())
        .groupBy(*ARM_IDENTITY)
        .agg(F.max(F.struct("created_at", "draft_memo"))["draft_memo"].alias("draft_memo"))
    )


def build_findings(
    candidates: DataFrame,
    previous: DataFrame | None = None,
    run_at: datetime | None = None,
    unchanged: DataFrame | None = None,
) -> DataFrame:
    """Findings of this run, with the memos of the previous one re-attached.

    Memos are matched on the arm and the leak's identity; a memo whose leak is
    gone has nothing to match and is dropped. With a ``previous`` run the
    candidates should be a stored table, see :func:`hot_join`. ``unchanged``
    are findings that still hold and were not detected again.
    """
    labelled = label_arms(candidates)
    if unchanged is not None:
        labelled = labelled.unionByName(unchanged.select(*labelled.columns))
    if previous is None:
        found = labelled.withColumn("draft_memo", F.lit(None).cast("string"))
    else:
        # One identity may carry many findings (lines billed twice), hence hot_join.
        spread = [] if unchanged is None else [*ARM_IDENTITY, "evidence"]
        found = hot_join(labelled, latest_memos(previous), ARM_IDENTITY, "left", spread=spread)
    identity = [F.col(c) for c in ARM_IDENTITY]
    return (
        found.withColumn("finding_id", stable_id(*identity))
        .withColumn("created_at", F.lit(run_at).cast("timestamp_ntz"))
        .select(*schemas.FINDINGS.fieldNames())
    )


def read_findings(spark: SparkSession, path: str, at: Snapshot | None = None) -> DataFrame:
    """The findings at ``path``; a table from before the arm column has NULL there."""
    return read_table(spark, path, schemas.FINDINGS, "detected_by", at)


def write_findings(
    findings: DataFrame | Callable[[Snapshot], DataFrame], path: str, arms: Sequence[str], spark: SparkSession | None = None
) -> DataFrame:
    """Replace the findings of ``arms`` at ``path``; other arms are untouched.

    One write and one log entry: findings that carry memos may read from
    ``path``, and after a failure the old state, with all its memos, is still
    the one read. Findings that follow from the stored ones are given as a
    function of the snapshot, so that they are made again, and no memo is lost,
    if another writer was first with one of the arms.
    """
    given = isinstance(findings, DataFrame)
    session = findings.sparkSession if given else spark
    replace_parts(session, path, "detected_by", arms, (lambda _: findings) if given else findings)
    return read_findings(session, path)


def memo_survival(findings: DataFrame) -> DataFrame:
    """Findings and kept memos per arm."""
    return (
        findings.where(F.col("detected_by").isNotNull())
        .groupBy("detected_by")
        .agg(F.count("*").alias("findings"), F.count("draft_memo").alias("memos_preserved"))
    )


def totals_by_type(findings: DataFrame) -> DataFrame:
    return (
        findings.where(F.col("detected_by").isNotNull())
        .groupBy("detected_by", "leak_type")
        .agg(F.count("*").alias("found"), F.sum("estimated_recovery").alias("total_recovery"))
        .orderBy("detected_by", F.desc_nulls_first("total_recovery"), "leak_type")
    )


def top_findings(findings: DataFrame, arm: str, n: int = 2, chars: int | None = 90) -> DataFrame:
    """The ``n`` most valuable findings per leak type.

    There are few types, so their rows must not meet in one task each: Spark
    keeps the first n of every input partition before the shuffle
    (WindowGroupLimit). Identity breaks ties, which makes the choice repeatable.
    """
    order = [F.desc_nulls_last("estimated_recovery"), *[F.asc(c) for c in IDENTITY], F.asc("evidence")]
    place = F.row_number().over(Window.partitionBy("leak_type").orderBy(*order))
    evidence = F.col("evidence") if chars is None else F.substring("evidence", 1, chars)
    return (
        findings.where(F.col("detected_by") == arm)
        .withColumn("place", place)
        .where(F.col("place") <= n)
        .withColumn("evidence", evidence)
        .orderBy("leak_type", "place")
        .drop("place")
    )


def run_counts(findings: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: findings of all arms and memos carried over into this run."""
    counts = findings.where(F.col("detected_by").isNotNull()).agg(F.count("*").alias("findings"))
    memos = kept.agg(F.count("draft_memo").alias("memos_preserved"))
    return counts.select("findings", memos.scalar().alias("memos_preserved"))


def run_report(findings: DataFrame, kept: DataFrame) -> DataFrame:
    return run_counts(findings, kept).select(
        F.concat(
            F.lit("reconcile: "),
            F.col("findings").cast("string"),
            F.lit(" findings over all arms, "),
            F.col("memos_preserved").cast("string"),
            F.lit(" memo(s) kept"),
        ).alias("report")
    )


def duplicate_findings(findings: DataFrame) -> DataFrame:
    """Identities reported by one arm more than once; they weigh more in dollar reports."""
    return findings.groupBy(*ARM_IDENTITY).agg(F.count("*").alias("n")).where("n > 1")


def overlapping_leaks(findings: DataFrame) -> DataFrame:
    """Account months with both a missing charge and a minimum shortfall.

    Invoicing the first may remove the second, so their dollars overlap.
    """
    kinds = F.col("leak_type")
    missing = F.sum(F.when(kinds == "missing_charge", F.col("estimated_recovery")))
    short = F.sum(F.when(kinds == "minimum_commitment_leak", F.col("estimated_recovery")))
    return (
        findings.groupBy("detected_by", "customer_id", "month")
        .agg(missing.cast(MONEY).alias("missing_charge"), short.cast(MONEY).alias("minimum_shortfall"))
        .where(F.col("missing_charge").isNotNull() & F.col("minimum_shortfall").isNotNull())
    )
