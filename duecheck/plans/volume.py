"""Order lines as billing: a large corpus without an answer key.

A line is an invoice line of its order's customer, its part's type is the
product, and the contract rate is the customer's mean billed rate for that
product, so that about half of the lines fall below it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecheck.functions.hashing import hash32
from duecheck.functions.numeric import half_up, whole
from duecheck.operators.extract import REGEX_ARM
from duecheck.operators.joins import hot_join
from duecheck.plans.corpus import DISCOUNTS, _rate
from duecheck.schemas import MONEY, PCT
from duecheck.sources.tables import spread

DISCOUNT_END = "1998-03-15"
MINIMUMS = [0, 0, 20_000, 50_000]


def billing(lineitem: DataFrame, orders: DataFrame, part: DataFrame, customer: DataFrame) -> DataFrame:
    price_c = F.round(F.col("l_extendedprice") * 100).cast("long")
    units = F.round("l_quantity").cast("long")
    placed = lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("p_partkey"),
        units.alias("units"),
        price_c.alias("price_c"),
        F.round(F.col("l_discount") * 100).cast("int").alias("pct"),
        F.monotonically_increasing_id().alias("place"),
    )
    lines = hot_join(
        spread(placed, "place"),
        part.select("p_partkey", F.col("p_type").alias("product")),
        ["p_partkey"],
        spread=["place"],
    )
    headers = hot_join(
        orders.select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_custkey").alias("c_custkey"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        ),
        customer.select("c_custkey", "c_name"),
        ["c_custkey"],
    )
    joined = hot_join(
        lines,
        headers,
        ["l_orderkey"],
        sized_by=[orders, customer],
        counted_on=lineitem,
        spread=["place"],
    )
    invoice = F.concat_ws("-", F.lit("INV"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rate_e4 = half_up(F.col("price_c") * 100, F.col("units"))
    amount = (F.col("price_c").cast("decimal(18,0)") / 100).cast(MONEY)
    return joined.select(
        invoice.alias("invoice_id"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        "month",
        "product",
        F.col("units"),
        _rate(rate_e4).alias("unit_rate_billed"),
        F.col("pct").cast(PCT).alias("discount_pct_applied"),
        amount.alias("amount_billed"),
    )


def terms(lines: DataFrame) -> DataFrame:
    """The mean billed rate of each (customer, product) as its contract rate."""
    e4 = whole(F.col("unit_rate_billed") * 10_000)
    return (
        lines.groupBy("customer_id", "customer_name", "product")
        .agg(half_up(F.sum(e4), F.count("*")).alias("e4"))
        .select(
            "customer_id",
            "customer_name",
            "product",
            _rate(F.col("e4")).alias("contract_rate"),
            F.lit(REGEX_ARM).alias("extraction_method"),
        )
    )


def meta(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")

    def choice(options: list[int], what: str):
        return F.get(F.array(*[F.lit(o) for o in options]), (hash32(what, key) % len(options)).cast("int"))

    return customer.select(
        key.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        choice(DISCOUNTS, "disc").cast(PCT).alias("discount_pct"),
        choice(MINIMUMS, "min").cast(MONEY).alias("min_monthly_commit"),
        F.lit(REGEX_ARM).alias("extraction_method"),
    ).withColumn(
        "discount_valid_through",
        F.when(F.col("discount_pct") > 0, F.to_date(F.lit(DISCOUNT_END))),
    )
