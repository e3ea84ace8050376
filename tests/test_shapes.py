"""Plans: what must not and what must appear in them."""

import pytest
from frames import SMALL

from duecheck.operators import detect, evaluate, extract, findings, report
from duecheck.plans.queries import queries

QUERIES = queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d9_detect_leaks", "volume_detect_leaks", "e4_verdicts", "r7_customer_ranking", "g7_evaluate_seeds"])
def test_no_pairing_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert node not in text


def test_extraction_is_map_only(ws):
    for df in (extract.extract_terms_regex(ws["contracts"]), extract.extract_meta_regex(ws["contracts"])):
        assert "Exchange" not in plan(df)


def test_top_per_type_is_cut_before_the_shuffle(ws):
    text = plan(findings.top_findings(ws["findings"], "sql_baseline"))
    shuffle = text.index("Exchange hashpartitioning")
    assert text.index("WindowGroupLimit") < shuffle < text.rindex("WindowGroupLimit")


def test_top_customers_is_a_top_k(ws):
    assert "TakeOrderedAndProject" in plan(report.top_customers(ws["findings"], "sql_baseline"))


def test_rate_check_reads_only_its_columns(ws):
    text = plan(detect.rate_leaks(ws["billing"], ws["terms"]))
    assert "amount_billed" not in text and "Exchange hashpartitioning" not in text


def test_months_are_shared_between_the_two_month_checks(spark, ws, shuffled):
    found = detect.detect_leaks(ws["billing"], ws["terms"], ws["meta"])
    found.write.format("noop").mode("overwrite").save()
    found.collect()
    assert "ReusedExchange" in plan(found)


def test_arm_filter_reaches_the_partition(spark, ws, tmp_path):
    stored = findings.write_findings(ws["findings"], str(tmp_path / "f"), ["sql_baseline", "json_terms"])
    text = stored.where("detected_by = 'json_terms'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(detected_by" in text


def test_verdict_join_has_one_shuffle_per_side(ws):
    text = plan(evaluate.verdicts(ws["findings"], ws["answer_key"], ["sql_baseline", "json_terms"]))
    assert text.count("Exchange hashpartitioning") == 2


def test_each_clause_pattern_runs_once_a_row(ws):
    assert plan(extract.extract_terms_regex(ws["contracts"])).count("regexp_extract") <= 2
    assert plan(extract.extract_meta_regex(ws["contracts"])).count("regexp_extract") <= 3
