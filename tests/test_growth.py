"""Work that must grow no faster than the tables: few rows shuffled, sets of fixed size, compiled rows."""

from decimal import Decimal

from frames import billing, terms
from pyspark.sql import functions as F

from duecheck.operators import detect
from duecheck.operators.joins import HOT_SLOTS, hot_join, hot_keys
from duecheck.plans import corpus
from duecheck.sources import csv


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_without_a_hot_key_no_key_is_shuffled(spark, tmp_path):
    """Keys are counted in hot slots only; before, every distinct key was shuffled to be counted."""
    spark.range(3 * HOT_SLOTS).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t"))
    text = plan(hot_keys(spark.read.parquet(str(tmp_path / "t")), ["k"]))
    assert "hashpartitioning(_slot" in text and "LeftSemi" in text
    assert hot_keys(spark.read.parquet(str(tmp_path / "t")), ["k"]).isEmpty()


def test_hot_and_cold_keys_of_one_slot(spark):
    """A slot is hot by one of its keys, or by none of them alone."""
    rows = spark.range(2000).select(F.when(F.col("id") < 900, F.lit(-1)).otherwise(F.col("id") % 500).alias("k"))
    assert [(r["k"], r["_pieces"]) for r in hot_keys(rows, ["k"], 100).collect()] == [(-1, 45)]
    joined = hot_join(rows, rows.distinct(), ["k"], share=100)
    assert joined.count() == 2000


def test_lines_are_not_shuffled_by_customer_month_and_product(ws, shuffled):
    """Months are kept as sets in longs; before, every line was shuffled once for usage and once for totals."""
    text = plan(detect.detect_leaks(ws["billing"], ws["terms"], ws["meta"]))
    assert "partial_bit_or" in text and "partial_collect_list" not in text
    grouped = [x for x in text.splitlines() if "Exchange hashpartitioning(customer_id" in x and "month" in x]
    assert grouped and not any("product" in x for x in grouped)


def test_sets_of_more_months_than_a_long_has_bits(spark):
    """150 months, every seventh without A, and a line without a month."""
    months = [f"{1990 + n // 12}-{n % 12 + 1:02}" for n in range(150)]
    line = lambda n, m, p: (f"{n}{p}", 1, "C", m, p, 10, Decimal("5"), Decimal("0"), Decimal("50"))
    rows = [line(n, m, "B") for n, m in enumerate(months)] + [line(n, m, "A") for n, m in enumerate(months) if n % 7]
    lines = billing(spark, *rows, line("x", None, "A"))
    found = detect.missing_charges(lines, terms(spark, (1, "A", "5"), (1, "B", "5")))
    absent = {(r["product"], r["month"]) for r in found.collect()}
    assert absent == {("A", m) for m in months[::7]} | {("A", None), ("B", None)}
    named = detect.missing_charges(lines, terms(spark, (1, "A", "5")), [*months, "2030-01"])
    assert {r["month"] for r in named.collect()} == {*months[::7], "2030-01"}


def test_invoice_lines_are_spelled_out_in_compiled_code(ws):
    """Lines become rows first; before, each was formatted inside a lambda."""
    text = plan(corpus.billing(ws["account_months"]))
    assert "format_string" not in text and "transform(" not in text


def test_records_are_put_together_once(ws, tmp_path):
    """Before, all lines were sorted and collected again for the few records that move between blocks."""
    csv.write_csv(ws["contracts"], str(tmp_path / "c"))
    read = csv.read_contracts(ws.spark, str(tmp_path / "c"))
    assert "collect_list(struct(place" not in plan(read)
    assert read.exceptAll(ws["contracts"]).isEmpty() and ws["contracts"].exceptAll(read).isEmpty()


def test_lines_that_fail_nothing_go_before_arrays_are_built(ws):
    """Before, every joined line got an array of its failed tests, built without compiled code."""
    text = detect.line_leaks(ws["billing"], ws["terms"], ws["meta"])._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("filter(array(") :]
    tests = [x for x in below.splitlines()[1:] if "Filter" in x or "Join" in x]
    assert any("rate_floor" in x and "stale_from" in x and " OR " in x for x in tests)


def test_a_response_is_drawn_once_a_product(ws):
    """Before, a product's slip was drawn once more for every comparison with it."""
    text = corpus.model_responses(ws["accounts"])._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("concat_ws(|, resp, ") == 1
