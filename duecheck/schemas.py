"""Declared schemas of the domain tables and the type names used inside.

Money and rates are decimals: sums of decimals do not depend on the order in
which tasks deliver them, sums of doubles do. Input keeps its digits (RATE,
AMOUNT, PCT); only a recovery is rounded, once, to MONEY. The widths are such
that units * rate * percentage stays exact.
"""

from pyspark.sql import types as T

RATE_DIGITS = 10
RATE = f"decimal(18,{RATE_DIGITS})"
AMOUNT = "decimal(20,6)"
MONEY = "decimal(18,2)"
PCT = "decimal(7,4)"
UNITS = "decimal(11,0)"

_RATE = T.DecimalType(18, RATE_DIGITS)
_AMOUNT = T.DecimalType(20, 6)
_MONEY = T.DecimalType(18, 2)
_PCT = T.DecimalType(7, 4)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


BILLING = _struct(
    ("invoice_id", T.StringType()),
    ("customer_id", T.LongType()),
    ("customer_name", T.StringType()),
    ("month", T.StringType()),
    ("product", T.StringType()),
    ("units", T.LongType()),
    ("unit_rate_billed", _RATE),
    ("discount_pct_applied", _PCT),
    ("amount_billed", _AMOUNT),
)

CONTRACTS = _struct(
    ("customer_id", T.LongType()),
    ("customer_name", T.StringType()),
    ("contract_text", T.StringType()),
)

ANSWER_KEY = _struct(
    ("customer_id", T.LongType()),
    ("customer_name", T.StringType()),
    ("month", T.StringType()),
    ("product", T.StringType()),
    ("leak_type", T.StringType()),
    ("estimated_recovery", _MONEY),
    ("detail", T.StringType()),
)

# What a structured model response holds, below its envelope.
RESPONSE_TERMS = _struct(
    (
        "products",
        T.ArrayType(_struct(("product", T.StringType()), ("contract_rate", _RATE))),
    ),
    ("discount_pct", _PCT),
    ("discount_valid_through", T.StringType()),
    ("min_monthly_commit", _AMOUNT),
)

RESPONSE_ENVELOPE = _struct(
    (
        "structured_output",
        T.ArrayType(_struct(("raw_message", RESPONSE_TERMS), ("type", T.StringType()))),
    ),
)

FINDINGS = _struct(
    ("finding_id", T.StringType()),
    ("customer_id", T.LongType()),
    ("customer_name", T.StringType()),
    ("month", T.StringType()),
    ("product", T.StringType()),
    ("leak_type", T.StringType()),
    ("estimated_recovery", _MONEY),
    ("evidence", T.StringType()),
    ("draft_memo", T.StringType()),
    ("created_at", T.TimestampNTZType()),
    ("detected_by", T.StringType()),
)

SWEEP = _struct(
    ("seed", T.LongType()),
    ("leaks_planted", T.LongType()),
    ("tp", T.LongType()),
    ("fp", T.LongType()),
    ("fn", T.LongType()),
    ("run_at", T.TimestampNTZType()),
)

# A leak's identity; dollars are not part of it.
IDENTITY = ["customer_id", "month", "product", "leak_type"]
ARM_IDENTITY = ["detected_by", *IDENTITY]
