"""Small literal tables for the tests."""

from datetime import date
from decimal import Decimal

from duecheck import schemas
from duecheck.schemas import MONEY, PCT, RATE

SMALL = "/root/testdata/sf0.001"
ARM = "regex_baseline"
TERMS = f"customer_id long, customer_name string, product string, contract_rate {RATE}, extraction_method string"
META = (
    f"customer_id long, customer_name string, discount_pct {PCT}, discount_valid_through date,"
    f" min_monthly_commit {MONEY}, extraction_method string"
)


def line(customer, month, product, units, rate, pct="0", amount="0", invoice=None):
    invoice = invoice or f"{customer}/{month}/{product}"
    return (
        invoice,
        customer,
        f"C{customer}",
        month,
        product,
        units,
        Decimal(rate),
        Decimal(pct),
        Decimal(amount),
    )


def billing(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.BILLING)


def terms(spark, *rows, arm=ARM):
    """rows: (customer, product, rate) or (customer, product, rate, arm)."""
    return spark.createDataFrame(
        [(r[0], f"C{r[0]}", r[1], Decimal(r[2]), r[3] if len(r) > 3 else arm) for r in rows], TERMS
    )


def meta(spark, *rows, arm=ARM):
    """rows: (customer, pct, end, minimum) or with an arm."""
    return spark.createDataFrame(
        [
            (
                r[0],
                f"C{r[0]}",
                Decimal(r[1]),
                date.fromisoformat(r[2]) if r[2] else None,
                Decimal(r[3]),
                r[4] if len(r) > 4 else arm,
            )
            for r in rows
        ],
        META,
    )


def finding(arm, customer, month, product, kind, dollars, memo=None, day=None, evidence="e"):
    identity = f"{arm}/{customer}/{month}/{product}/{kind}"
    return (
        identity,
        customer,
        f"C{customer}",
        month,
        product,
        kind,
        Decimal(dollars),
        evidence,
        memo,
        day,
        arm,
    )


def findings(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.FINDINGS)


def key(spark, *rows):
    """rows: (customer, month, product, leak type, dollars)."""
    return spark.createDataFrame(
        [(r[0], f"C{r[0]}", r[1], r[2], r[3], Decimal(r[4]), "planted") for r in rows], schemas.ANSWER_KEY
    )


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
