"""Read model of the reports: small aggregates and ordered lists."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecheck.functions.numeric import ratio
from duecheck.operators.evaluate import detectors, scorecard
from duecheck.operators.joins import hot_join
from duecheck.schemas import IDENTITY, MONEY
from duecheck.sources.tables import stage


def _by_value():
    """Most valuable first. Identity splits a value that very many findings share."""
    return [F.desc_nulls_first("estimated_recovery"), *[F.asc(c) for c in IDENTITY], F.asc("evidence")]


def _of_arm(frame: DataFrame, arm: str) -> DataFrame:
    return frame.where(F.col("detected_by") == arm)


def arm_list(findings: DataFrame) -> DataFrame:
    return detectors(findings).orderBy("detected_by")


def headline_score(verdict: DataFrame, arm: str) -> DataFrame:
    card = scorecard(_of_arm(verdict, arm))
    return card.select(
        F.col("true_positives").alias("tp"),
        F.col("false_positives").alias("fp"),
        F.col("false_negatives").alias("fn"),
        "precision",
        "recall",
    )


def headline_money(findings: DataFrame, answer_key: DataFrame, arm: str) -> DataFrame:
    """Detected and confirmed dollars of the findings that the key holds."""
    key = answer_key.select(*IDENTITY, F.col("estimated_recovery").cast(MONEY).alias("actual"))
    matched = hot_join(
        _of_arm(findings, arm).select(*IDENTITY, F.col("estimated_recovery").cast(MONEY).alias("claimed")),
        key,
        IDENTITY,
    )
    # Per customer first, so that the distinct count is a plain count.
    return (
        matched.groupBy("customer_id")
        .agg(F.sum("claimed").alias("claimed"), F.sum("actual").alias("actual"))
        .agg(
            F.sum("claimed").alias("detected_total"),
            F.sum("actual").alias("confirmed_total"),
            F.count("customer_id").alias("customers"),
        )
    )


def findings_list(findings: DataFrame, arm: str) -> DataFrame:
    return (
        _of_arm(findings, arm)
        .orderBy(*_by_value())
        .select("customer_name", "month", "product", "leak_type", "estimated_recovery", "evidence")
    )


def by_type(findings: DataFrame, arm: str) -> DataFrame:
    return (
        _of_arm(findings, arm)
        .groupBy("leak_type")
        .agg(F.sum("estimated_recovery").alias("dollars"), F.count("*").alias("leaks"))
        .orderBy(F.desc("dollars"), "leak_type")
    )


def top_customers(findings: DataFrame, arm: str, n: int = 8) -> DataFrame:
    """Customers by estimated dollars; :func:`customer_ranking` is the fair ranking."""
    return (
        _of_arm(findings, arm)
        .groupBy("customer_name")
        .agg(F.sum("estimated_recovery").alias("dollars"))
        .orderBy(F.desc("dollars"), "customer_name")
        .limit(n)
    )


def global_rank(values: DataFrame, column: str, alias: str, slices: int | None = None) -> DataFrame:
    """Distinct non-NULL values of ``column`` with their descending rank over all rows.

    A rank over everything would put all rows into one task. Equal values are
    combined first; the distinct ones are range-partitioned into slices, ranked
    inside their slice, and moved by the number of rows in the slices above.
    The slices are stored, so both steps see the same cuts.
    """
    if slices is None:
        slices = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(slices, F.desc(column))
    sliced = stage(ranged.withColumn("slice", F.spark_partition_id()), f"rank-{alias}")
    # One row per slice.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("slice")
        .agg(F.sum("n").alias("rows"))
        .select("slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    higher = Window.partitionBy("slice").orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("inside", F.coalesce(F.sum("n").over(higher), F.lit(0)))
        .join(F.broadcast(offsets), "slice")
        .select(column, (F.col("offset") + F.col("inside") + 1).alias(alias))
    )


def customer_ranking(
    findings: DataFrame, confirmed: DataFrame, arm: str, slices: int | None = None
) -> DataFrame:
    """Customers with estimated and confirmed dollars and the rank by each.

    ``confirmed``: the rows of confirmed_leaks. The two orders differ, since
    missing charges are estimates; the confirmed one decides who comes first.
    """
    estimated = (
        _of_arm(findings, arm).groupBy("customer_id").agg(F.sum("estimated_recovery").alias("estimated"))
    )
    actual = _of_arm(confirmed, arm).groupBy("customer_id").agg(F.sum("actual").alias("confirmed"))
    totals = stage(
        estimated.join(actual, "customer_id", "full_outer").fillna(0, ["estimated", "confirmed"]),
        "customer-totals",
    )
    ranked = totals
    for column, alias in (("estimated", "estimated_rank"), ("confirmed", "confirmed_rank")):
        # Many customers may share one total, hence hot_join.
        ranks = global_rank(totals, column, alias, slices)
        ranked = hot_join(
            ranked,
            ranks,
            [column],
            sized_by=[totals],
            counted_on=totals,
            spread=["customer_id"],
        )
    return ranked.select("customer_id", "estimated", "confirmed", "estimated_rank", "confirmed_rank")


def selection(
    findings: DataFrame,
    arm: str,
    types: Sequence[str] | None = None,
    customers: Sequence[str] | None = None,
) -> DataFrame:
    """Findings of the chosen leak types and customers; None chooses all."""
    chosen = _of_arm(findings, arm)
    if types is not None:
        chosen = chosen.where(F.col("leak_type").isin(list(types)))
    if customers:
        chosen = chosen.where(F.col("customer_name").isin(list(customers)))
    return chosen


def selection_total(
    findings: DataFrame,
    arm: str,
    types: Sequence[str] | None = None,
    customers: Sequence[str] | None = None,
) -> DataFrame:
    """Shown rows and dollars of a selection, beside the rows of the arm."""
    shown = F.lit(True)
    if types is not None:
        shown = shown & F.col("leak_type").isin(list(types))
    if customers:
        shown = shown & F.col("customer_name").isin(list(customers))
    zero = F.lit(0).cast(MONEY)
    return _of_arm(findings, arm).agg(
        F.count_if(shown).alias("shown"),
        F.count("*").alias("findings"),
        F.coalesce(F.sum(F.when(shown, F.col("estimated_recovery"))), zero).alias("dollars"),
    )


def facets(
    findings: DataFrame,
    arm: str,
    types: Sequence[str] | None = None,
    customers: Sequence[str] | None = None,
) -> DataFrame:
    """Options of both choices with what each would show, and the total: one pass, one aggregate by grouping sets.

    An option of one facet is counted under the choice made in the other one;
    options that this leaves without a finding stay listed. ``chosen`` tells
    whether an option is part of the selection. The total has no option.
    """
    in_types = F.lit(True) if types is None else F.col("leak_type").isin(list(types))
    in_customers = F.col("customer_name").isin(list(customers)) if customers else F.lit(True)
    rows = _of_arm(findings, arm).select(
        "leak_type", "customer_name", "estimated_recovery", in_types.alias("in_types"), in_customers.alias("in_customers")
    )
    by_type, by_customer = F.grouping("leak_type") == 0, F.grouping("customer_name") == 0

    def counts(prefix: str, shown: Column) -> list[Column]:
        dollars = F.coalesce(F.sum(F.when(shown, F.col("estimated_recovery"))), F.lit(0).cast(MONEY))
        return [F.count_if(shown).alias(f"{prefix}_n"), dollars.alias(f"{prefix}_d")]

    found = rows.groupingSets([["leak_type"], ["customer_name"], []], "leak_type", "customer_name").agg(
        F.when(by_type, "leak_type").when(by_customer, "customer_name").otherwise("total").alias("facet"),
        *counts("t", F.col("in_customers")),
        *counts("c", F.col("in_types")),
        *counts("all", F.col("in_types") & F.col("in_customers")),
        F.max("in_types").alias("type_chosen"),
        F.max("in_customers").alias("customer_chosen"),
    )

    def of_facet(by_type: Column, by_customer: Column, total: Column) -> Column:
        return F.when(F.col("facet") == "leak_type", by_type).when(F.col("facet") == "customer_name", by_customer).otherwise(total)

    return found.select(
        "facet",
        of_facet(F.col("leak_type"), F.col("customer_name"), F.lit(None)).alias("option"),
        of_facet(F.col("t_n"), F.col("c_n"), F.col("all_n")).alias("findings"),
        of_facet(F.col("t_d"), F.col("c_d"), F.col("all_d")).alias("dollars"),
        of_facet(F.col("type_chosen"), F.col("customer_chosen"), F.lit(True)).alias("chosen"),
    )


def memo_list(findings: DataFrame, arm: str) -> DataFrame:
    """Drafted memos under a display label, most valuable first."""
    label = F.concat_ws(
        " · ",
        "customer_name",
        "month",
        "product",
        F.concat(F.lit("$"), F.format_number(F.col("estimated_recovery").cast(MONEY), 2)),
    )
    return (
        _of_arm(findings, arm)
        .where(F.col("draft_memo").isNotNull())
        .orderBy(*_by_value())
        .select(
            label.alias("label"),
            "customer_name",
            "month",
            "product",
            "leak_type",
            "estimated_recovery",
            "evidence",
            "draft_memo",
        )
    )


def arm_table(verdict: DataFrame) -> DataFrame:
    """Arms side by side."""
    return (
        scorecard(verdict)
        .select(
            "detected_by",
            F.col("true_positives").alias("found"),
            F.col("false_negatives").alias("missed"),
            F.col("false_positives").alias("false_alarms"),
            "precision",
            "recall",
        )
        .orderBy("detected_by")
    )


def top_memos(findings: DataFrame, arm: str, n: int = 5) -> DataFrame:
    order = [F.desc_nulls_last("estimated_recovery"), *[F.asc(c) for c in IDENTITY], F.asc("evidence")]
    return (
        _of_arm(findings, arm)
        .orderBy(*order)
        .limit(n)
        .select("customer_name", "month", "product", "leak_type", "estimated_recovery", "draft_memo")
    )


def sweep_table(sweep: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sweep.select(
        "seed",
        "leaks_planted",
        F.col("fp").alias("false_alarms"),
        F.col("fn").alias("missed"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    ).orderBy("seed")


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """Data sets without any error, and the range of planted leaks."""
    return sweep.agg(
        F.count_if(F.col("fp") + F.col("fn") == 0).alias("clean"),
        F.count("*").alias("datasets"),
        F.min("leaks_planted").alias("min_planted"),
        F.max("leaks_planted").alias("max_planted"),
    )
