"""Labels, memo carry-over, idempotent rebuilds and the callable runs."""

from datetime import datetime

from frames import billing, finding, findings, key, line, meta, terms, tuples
from pyspark.sql import functions as F

from duecheck.operators import detect, memos
from duecheck.operators import findings as f
from duecheck.plans import run

OLD, NEW = datetime(2026, 1, 1), datetime(2026, 2, 1)


def candidates(spark):
    lines = billing(spark, line(1, "2026-01", "A", 10, "4"), line(2, "2026-01", "A", 10, "4"))
    return detect.rate_leaks(lines, terms(spark, (1, "A", "5"), (2, "A", "5")))


def test_labels(spark):
    names = spark.createDataFrame([("regex_baseline",), ("json_terms",), ("ocr",)], "m string")
    assert tuples(names, f.arm_label(F.col("m"))) == [("json_terms",), ("sql_baseline",), ("sql_ocr",)]


def test_memos_follow_identity(spark):
    previous = findings(
        spark,
        finding("sql_baseline", 1, "2026-01", "A", "rate_leak", "9", "older", OLD),
        finding("sql_baseline", 1, "2026-01", "A", "rate_leak", "9", "newer", NEW),
        finding("sql_baseline", 7, "2026-01", "A", "rate_leak", "9", "leak is gone", NEW),
        finding("json_terms", 2, "2026-01", "A", "rate_leak", "9", "other arm", NEW),
        finding("sql_baseline", 2, "2026-01", "A", "rate_leak", "9", None, NEW),
    )
    built = f.build_findings(candidates(spark), previous)
    assert [(r["customer_id"], r["draft_memo"]) for r in built.orderBy("customer_id").collect()] == [
        (1, "newer"),
        (2, None),
    ]


def test_identifiers_are_stable_and_distinct(spark):
    first = tuples(f.build_findings(candidates(spark)), "finding_id")
    assert first == tuples(f.build_findings(candidates(spark)), "finding_id")
    assert len(set(first)) == 2


def scenario(spark):
    lines = billing(
        spark,
        line(1, "2026-01", "A", 10, "4", amount="40"),
        line(1, "2026-02", "A", 10, "5", amount="50"),
        line(1, "2026-02", "B", 5, "2", amount="10"),
    )
    rates = terms(spark, (1, "A", "5"), (1, "B", "2"))
    clauses = meta(spark, (1, "0", None, "45"))
    planted = key(
        spark,
        (1, "2026-01", "A", "rate_leak", "10"),
        (1, "2026-01", "B", "missing_charge", "12"),
        (1, "2026-01", "(account minimum)", "minimum_commitment_leak", "5"),
        (1, "2026-06", "A", "missing_charge", "3"),
    )
    return lines, rates, clauses, planted


def test_runs_are_idempotent_and_keep_edited_memos(spark, tmp_path):
    lines, rates, clauses, planted = scenario(spark)
    path = str(tmp_path / "findings")
    first = run.run(lines, rates, clauses, planted, path, "sql_baseline").first()["report"]
    assert first == (
        "reconcile: 3 findings over all arms, 0 memo(s) kept | draft: 3 memo(s) written for "
        "sql_baseline, 0 still empty | tp=3 fp=0 fn=1 usd=27.00"
    )
    edited = f.read_findings(spark, path).withColumn(
        "draft_memo",
        F.when(F.col("leak_type") == "rate_leak", F.lit("edited by hand")).otherwise(F.col("draft_memo")),
    )
    f.write_findings(edited, path, ["sql_baseline"])
    before = tuples(f.read_findings(spark, path), "finding_id", "draft_memo")
    second = run.run(lines, rates, clauses, planted, path, "sql_baseline").first()["report"]
    assert "3 memo(s) kept | draft: 0 memo(s) written" in second
    assert tuples(f.read_findings(spark, path), "finding_id", "draft_memo") == before
    assert f.read_findings(spark, path).where("draft_memo = 'edited by hand'").count() == 1


def test_reconcile_leaves_a_foreign_arm_alone(spark, tmp_path):
    lines, rates, clauses, _ = scenario(spark)
    path = str(tmp_path / "findings")
    f.write_findings(
        findings(spark, finding("sql_ocr", 5, "2026-01", "A", "rate_leak", "1", "mine", NEW)), path, ["sql_ocr"]
    )
    run.reconcile(lines, rates, clauses, path)
    rows = f.read_findings(spark, path).where("detected_by = 'sql_ocr'").collect()
    assert [r["draft_memo"] for r in rows] == ["mine"]


def test_outside_answers_fill_only_empty_memos(spark, tmp_path):
    path = str(tmp_path / "findings")
    stored = f.write_findings(
        findings(
            spark,
            finding("a", 1, "2026-01", "A", "rate_leak", "1", "kept", NEW),
            finding("a", 2, "2026-01", "A", "rate_leak", "1"),
            finding("a", 3, "2026-01", "A", "rate_leak", "1"),
        ),
        path,
        ["a"],
    )
    ids = {r["customer_id"]: r["finding_id"] for r in stored.collect()}
    answers = spark.createDataFrame(
        [(ids[1], "ignored"), (ids[2], "answer"), (ids[2], "answer")], "finding_id string, memo string"
    )
    report = run.draft(spark, path, "a", answers).first()["report"]
    assert report == "draft: 1 memo(s) written for a, 1 still empty"
    got = {r["customer_id"]: r["draft_memo"] for r in f.read_findings(spark, path).collect()}
    assert got == {1: "kept", 2: "answer", 3: None}


def test_template_memos_keep_every_rule(ws):
    drafted = memos.draft_templates(ws["findings"], "sql_baseline")
    assert memos.undrafted(drafted, "sql_baseline").isEmpty()
    assert memos.undrafted(drafted, "json_terms").count() == memos.undrafted(ws["findings"], "json_terms").count()
    for check in (memos.preamble_breaches, memos.caveat_breaches, memos.style_breaches):
        assert check(drafted, "sql_baseline").isEmpty()


def test_memo_checks_see_breaches(spark):
    opened = "MEMO: subject\nRecommended action: go."
    rows = findings(
        spark,
        finding("a", 1, "m", "A", "rate_leak", "1", "Here is a memo\nRecommended action: go."),
        finding("a", 2, "m", "A", "missing_charge", "1", opened),
        finding("a", 3, "m", "A", "missing_charge", "1", opened.replace("subject", "ESTIMATED units")),
        finding("a", 4, "m", "A", "rate_leak", "1", "memo: " + "word " * 130 + "\nRecommended action: go."),
        finding("a", 5, "m", "A", "rate_leak", "1", "MEMO: we apologise\nThe end."),
    )
    assert tuples(memos.preamble_breaches(rows, "a"), "customer_id") == [(1,)]
    assert tuples(memos.caveat_breaches(rows, "a"), "customer_id") == [(2,)]
    assert tuples(memos.style_breaches(rows, "a"), "customer_id", "too_long", "no_closing", "apologises") == [
        (4, True, False, False),
        (5, False, True, True),
    ]
