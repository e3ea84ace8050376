"""Verdicts, shares and dollar reports on hand-made findings."""

from decimal import Decimal

from frames import finding, findings, key, tuples
from pyspark.sql import functions as F

from duecheck.operators import evaluate, report

A = (1, "2026-01", "A", "rate_leak")
B = (2, "2026-01", "A", "rate_leak")
C = (3, "2026-01", "A", "missing_charge")


def test_key_against_itself_is_perfect(ws):
    perfect = ws["answer_key"].withColumn("detected_by", F.lit("x"))
    card = evaluate.scorecard(evaluate.verdicts(perfect, ws["answer_key"])).first()
    n = ws["answer_key"].count()
    assert card["true_positives"] == n and card["false_positives"] == card["false_negatives"] == 0
    assert card["precision"] == card["recall"] == card["f1"] == 1.0


def test_misses_and_false_alarms(spark):
    found = findings(
        spark,
        finding("x", *A, "10"),
        finding("x", *A, "10"),  # twice is once
        finding("x", 9, "2026-01", "A", "rate_leak", "5"),
        finding("y", *B, "5"),
    )
    planted = key(spark, (*A, "11"), (*B, "5"), (*C, "7"))
    verdict = evaluate.verdicts(found, planted)
    assert tuples(verdict, "detected_by", "customer_id", "outcome") == [
        ("x", 1, "TP"),
        ("x", 2, "FN"),
        ("x", 3, "FN"),
        ("x", 9, "FP"),
        ("y", 1, "FN"),
        ("y", 2, "TP"),
        ("y", 3, "FN"),
    ]
    cards = {r["detected_by"]: r for r in evaluate.scorecard(verdict).collect()}
    assert (cards["x"]["precision"], cards["x"]["recall"], cards["x"]["f1"]) == (0.5, 0.3333, 0.4)
    assert (cards["y"]["precision"], cards["y"]["recall"], cards["y"]["f1"]) == (1.0, 0.3333, 0.5)
    assert tuples(evaluate.misses(verdict, planted).where("detected_by = 'x'"), "missed_dollars") == [
        (Decimal("5.00"),),
        (Decimal("7.00"),),
    ]
    assert tuples(evaluate.false_alarms(verdict, found), "detected_by", "claimed_dollars") == [
        ("x", Decimal("5.00"))
    ]
    # Dollars are per finding: the repeated finding weighs twice.
    dollars = evaluate.dollar_accuracy(verdict, found, planted).where("detected_by = 'x'").first()
    assert (dollars["leaks_scored"], dollars["detected_total"], dollars["actual_total"]) == (2, 20, 22)
    assert dollars["dollar_error"] == -2 and dollars["mean_abs_pct_error"] == 9.1


def test_named_arm_without_findings_gets_its_misses(spark):
    found = findings(spark, finding("x", *A, "10"))
    planted = key(spark, (*A, "11"))
    assert "silent" not in [r[0] for r in evaluate.detectors(found).collect()]
    verdict = evaluate.verdicts(found, planted, ["x", "silent"])
    card = evaluate.scorecard(verdict).where("detected_by = 'silent'").first()
    assert card["false_negatives"] == 1 and card["precision"] is None and card["recall"] == 0.0


def test_null_identity_never_matches_and_stays_a_false_alarm(spark):
    found = findings(spark, finding("x", None, "2026-01", "A", "rate_leak", "1"))
    planted = key(spark, (None, "2026-01", "A", "rate_leak", "1"))
    verdict = evaluate.verdicts(found, planted)
    assert sorted(r["outcome"] for r in verdict.collect()) == ["FN", "FP"]


def test_no_findings_at_all(spark):
    found = findings(spark)
    planted = key(spark, (*A, "11"))
    assert evaluate.verdicts(found, planted).count() == 0
    assert evaluate.confirmed_total(evaluate.verdicts(found, planted), planted, "x").first()[0] == 0


def test_rollup_levels(spark):
    found = findings(spark, finding("x", *A, "10"), finding("x", *C, "1"))
    planted = key(spark, (*A, "11"), (*C, "7"))
    rows = evaluate.confirmed_value(evaluate.verdicts(found, planted), planted)
    assert sorted((r["level"], r["recoverable_dollars"]) for r in rows.collect()) == [
        (0, Decimal("7.00")),
        (0, Decimal("11.00")),
        (1, Decimal("18.00")),
        (3, Decimal("18.00")),
    ]


def test_rank_over_all_rows_with_many_ties(spark):
    values = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") % 97).alias("v")
    )
    ranks = {r["v"]: r["r"] for r in report.global_rank(values, "v", "r", 16).collect()}
    everything = [r["v"] for r in values.collect()]
    assert ranks == {v: 1 + sum(w > v for w in everything) for v in set(everything)}


def test_ranking_by_estimate_and_by_confirmed_value_differ(spark):
    found = findings(spark, finding("x", *A, "100"), finding("x", *C, "10"))
    planted = key(spark, (*A, "20"), (*C, "70"))
    confirmed = evaluate.confirmed_leaks(evaluate.verdicts(found, planted), planted)
    ranked = report.customer_ranking(found, confirmed, "x")
    assert tuples(ranked, "customer_id", "estimated_rank", "confirmed_rank") == [(1, 1, 2), (3, 2, 1)]


def test_selection(spark):
    found = findings(spark, finding("x", *A, "10"), finding("x", *B, "5"), finding("x", *C, "1"))
    row = report.selection_total(found, "x", ["rate_leak"], ["C2"]).first()
    assert (row["shown"], row["findings"], row["dollars"]) == (1, 3, Decimal("5.00"))
    assert report.selection(found, "x", None, ["C1", "C3"]).count() == 2


def test_reports_come_in_order(spark):
    found = findings(
        spark,
        finding("x", *A, "10"),
        finding("x", 9, "2026-01", "A", "rate_leak", "5"),
        finding("x", 8, "2026-01", "A", "rate_leak", "6"),
        finding("y", *B, "5"),
        finding("y", *C, "8"),
        finding("z", 7, "2026-01", "A", "rate_leak", "1"),
    )
    planted = key(spark, (*A, "11"), (*B, "5"), (*C, "7"))
    verdict = evaluate.verdicts(found, planted)
    rows = lambda df, *columns: [tuple(r) for r in df.select(*columns).collect()]
    # F1 falls; nothing scored (z has no hit: 0) comes last, an undefined share would come first.
    assert [r[0] for r in rows(evaluate.scorecard(verdict), "detected_by")] == ["y", "x", "z"]
    assert rows(evaluate.scorecard_by_type(verdict), "detected_by", "leak_type")[:2] == [("x", "missing_charge"), ("x", "rate_leak")]
    missed = rows(evaluate.misses(verdict, planted), "missed_dollars")
    assert missed == sorted(missed, reverse=True)
    claimed = rows(evaluate.false_alarms(verdict, found), "claimed_dollars")
    assert claimed == [(6,), (5,), (1,)]
    assert rows(evaluate.dollar_accuracy(verdict, found, planted), "detected_by", "dollar_error") == [("x", -1), ("y", 1), ("y", 0)]
    assert rows(evaluate.confirmed_value(verdict, planted), "detected_by", "level") == [
        ("x", 1), ("x", 0), ("y", 1), ("y", 0), ("y", 0), (None, 3),
    ]


def test_facets_count_under_the_other_choice(spark):
    found = findings(
        spark,
        finding("x", 1, "2026-01", "A", "rate_leak", "1.50"),
        finding("x", 1, "2026-02", "A", "missing_charge", "2"),
        finding("x", 2, "2026-01", "A", "rate_leak", "4"),
        finding("x", 3, "2026-01", "A", "stale_discount", "8"),
        finding("y", 1, "2026-01", "A", "rate_leak", "99"),
    )
    columns = ("facet", "option", "findings", "dollars", "chosen")
    got = {tuple(r) for r in report.facets(found, "x", ["rate_leak", "stale_discount"], ["C1"]).select(*columns).collect()}
    assert got == {
        ("leak_type", "rate_leak", 1, Decimal("1.50"), True),
        ("leak_type", "missing_charge", 1, Decimal("2.00"), False),
        ("leak_type", "stale_discount", 0, Decimal("0.00"), True),
        ("customer_name", "C1", 1, Decimal("1.50"), True),
        ("customer_name", "C2", 1, Decimal("4.00"), False),
        ("customer_name", "C3", 1, Decimal("8.00"), False),
        ("total", None, 1, Decimal("1.50"), True),
    }
    free = report.facets(found, "x")
    assert free.where("facet = 'total'").first()["findings"] == 4 and free.where("not chosen").isEmpty()
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Exchange") == 1
