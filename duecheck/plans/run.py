"""The callable runs over a stored findings table: reconcile, draft, run.

Extraction is not part of a run: contracts change more rarely than billing.
"""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecheck.operators.changes import account_fingerprints, changed_accounts
from duecheck.operators.detect import MINIMUM_SLACK, RATE_FACTOR, detect_leaks
from duecheck.operators.evaluate import arm_counts, confirmed_total, verdicts
from duecheck.operators.findings import (
    ARM_LABELS,
    build_findings,
    read_findings,
    run_report,
    write_findings,
)
from duecheck.operators.joins import hot_join
from duecheck.operators.memos import attach_memos, draft_templates, undrafted
from duecheck.schemas import MONEY
from duecheck.sources.snapshots import ConcurrentChange, Snapshot, exists, read_table, replace_table, snapshot
from duecheck.sources.tables import stage


def _previous(spark: SparkSession, path: str, at: Snapshot) -> DataFrame | None:
    return read_findings(spark, path, at) if exists(spark, path) else None


def reconcile(
    billing: DataFrame,
    terms: DataFrame,
    meta: DataFrame,
    findings_path: str,
    arms: Sequence[str] = tuple(ARM_LABELS.values()),
    run_at: datetime | None = None,
) -> DataFrame:
    """Rebuild the findings of ``arms`` and keep their memos; one-row report."""
    spark = billing.sparkSession
    candidates = stage(detect_leaks(billing, terms, meta), "candidates")

    def rebuilt(at: Snapshot) -> DataFrame:
        return build_findings(candidates, _previous(spark, findings_path, at), run_at)

    stored = write_findings(rebuilt, findings_path, arms, spark)
    return run_report(stored, stored.where(F.col("detected_by").isin(list(arms))))


def reconcile_changes(
    billing: DataFrame,
    terms: DataFrame,
    meta: DataFrame,
    findings_path: str,
    arms: Sequence[str] = tuple(ARM_LABELS.values()),
    run_at: datetime | None = None,
    attempts: int = 5,
) -> DataFrame:
    """What :func:`reconcile` does, detecting again only in accounts that changed since the last such run.

    Every leak follows from the lines, terms and clauses of one account. Their
    fingerprints are stored in ``<findings_path>_accounts``, with the rules they
    were checked by; the inputs are read once for new fingerprints, and accounts
    whose fingerprint is another, new or gone are detected again. Findings of
    all others are carried over with their memos. Fingerprints are stored after
    the findings: a run that fails between the two is only repeated. If another
    run was first with the fingerprints, this one starts again from those.
    """
    spark = billing.sparkSession
    state_path = f"{findings_path}_accounts"
    seen = stage(account_fingerprints({"billing": billing, "terms": terms, "meta": meta}, _rules(arms)), "fingerprints")
    for attempt in range(attempts):
        base = snapshot(spark, state_path)
        known = exists(spark, state_path) and exists(spark, findings_path)
        before = read_table(spark, state_path, seen.schema, at=base) if known else seen.limit(0)
        changed = stage(changed_accounts(before, seen), "changed-accounts")
        parts = [stage(hot_join(t, changed, ["customer_id"], "left_semi"), "changed-inputs") for t in (billing, terms, meta)]
        candidates = stage(detect_leaks(*parts), "candidates")

        def merged(at: Snapshot) -> DataFrame:
            previous = _previous(spark, findings_path, at)
            if not known:
                return build_findings(candidates, previous, run_at)
            own = previous.where(F.col("detected_by").isin(list(arms)))
            return build_findings(candidates, previous, run_at, hot_join(own, changed, ["customer_id"], "left_anti"))

        stored = write_findings(merged, findings_path, arms, spark)
        try:
            replace_table(seen, state_path, base)
        except ConcurrentChange:
            if attempt == attempts - 1:
                raise
            continue
        return run_report(stored, stored.where(F.col("detected_by").isin(list(arms))))
    raise AssertionError("unreachable")


def _rules(arms: Sequence[str]) -> str:
    """What besides an account's rows decides its findings; another value detects all accounts again."""
    return f"rate below {RATE_FACTOR}, minimum less {MINIMUM_SLACK}, arms {sorted(arms)}"


def draft(spark: SparkSession, findings_path: str, arm: str, memos: DataFrame | None = None) -> DataFrame:
    """Fill the empty memos of one arm; one-row report.

    ``memos`` (finding_id, memo) are outside answers; without them the template
    writes each memo. A memo that exists is never replaced.
    """
    was_empty = []

    def drafted(at: Snapshot) -> DataFrame:
        before = read_findings(spark, findings_path, at).where(F.col("detected_by") == arm)
        was_empty.append(undrafted(before, arm).agg(F.count("*").alias("n")).scalar())
        return draft_templates(before, arm) if memos is None else attach_memos(before, memos)

    stored = write_findings(drafted, findings_path, [arm], spark)
    left = undrafted(stored, arm).agg(F.count("*").alias("left"))
    return left.select(
        F.concat(
            F.lit("draft: "),
            (was_empty[-1] - F.col("left")).cast("string"),
            F.lit(f" memo(s) written for {arm}, "),
            F.col("left").cast("string"),
            F.lit(" still empty"),
        ).alias("report")
    )


def run(
    billing: DataFrame,
    terms: DataFrame,
    meta: DataFrame,
    answer_key: DataFrame,
    findings_path: str,
    arm: str,
    arms: Sequence[str] = tuple(ARM_LABELS.values()),
    run_at: datetime | None = None,
) -> DataFrame:
    """Reconcile, draft and score one arm; one-row report.

    The answer key reaches the scoring step only.
    """
    spark = billing.sparkSession
    reconciled = reconcile(billing, terms, meta, findings_path, arms, run_at)
    drafted = draft(spark, findings_path, arm)
    verdict = stage(verdicts(read_findings(spark, findings_path), answer_key, arms), "verdict")
    dollars = confirmed_total(verdict, answer_key, arm).scalar()
    return arm_counts(verdict, arm).select(
        F.concat(
            reconciled.scalar(),
            F.lit(" | "),
            drafted.scalar(),
            F.lit(" | "),
            *[F.concat(F.lit(f"{name}="), F.col(name).cast("string"), F.lit(" ")) for name in ("tp", "fp", "fn")],
            F.lit("usd="),
            dollars.cast(MONEY).cast("string"),
        ).alias("report")
    )
