"""Evaluation over many seeds as one job: the seed is a column and joins every key."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecheck.operators.detect import detect_leaks
from duecheck.operators.evaluate import scorecard, verdicts
from duecheck.operators.extract import REGEX_ARM, extract_meta_regex, extract_terms_regex
from duecheck.operators.findings import ARM_LABELS, label_arms
from duecheck.sources.snapshots import read_table, replace_table
from duecheck.sources.tables import stage

SCOPE = ("seed",)


def evaluate_seeds(contracts: DataFrame, billing: DataFrame, answer_key: DataFrame) -> DataFrame:
    """Extract, detect and score every seed's corpus: true and false positives, misses.

    The tables carry ``seed``; the key is read by the scoring step only.
    """
    terms = stage(extract_terms_regex(contracts, SCOPE), "sweep-terms")
    meta = stage(extract_meta_regex(contracts, SCOPE), "sweep-meta")
    findings = label_arms(detect_leaks(billing, terms, meta, scope=SCOPE))
    verdict = verdicts(findings, answer_key, arms=[ARM_LABELS[REGEX_ARM]], scope=SCOPE)
    return scorecard(verdict, SCOPE).select(
        "seed",
        F.col("total_actual").alias("leaks_planted"),
        F.col("true_positives").alias("tp"),
        F.col("false_positives").alias("fp"),
        F.col("false_negatives").alias("fn"),
    )


def stamp(sweep: DataFrame, run_at: datetime) -> DataFrame:
    """The sweep's rows with the time of the run, as stored."""
    return sweep.withColumn("run_at", F.lit(run_at).cast("timestamp_ntz"))


def write_sweep(sweep: DataFrame, path: str) -> DataFrame:
    """Replace the whole sweep table: a row of an older run is worse than none."""
    replace_table(sweep, path)
    return read_table(sweep.sparkSession, path, sweep.schema)
