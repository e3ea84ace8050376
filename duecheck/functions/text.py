"""Clause patterns and text captures."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The clause wordings the regex arm recognises.
PRICED_LINE = "- **%billed at%"
PRODUCT_PATTERN = r"\*\*(.+?)\*\*"
RATE_PATTERN = r"billed at \$([0-9](?:[0-9.,]*[0-9])?)"
DISCOUNT_PATTERN = r"promotional discount of ([0-9](?:[0-9.,]*[0-9])?)%"
EXPIRY_PATTERN = r"valid only through ([0-9]{4}-[0-9]{2}-[0-9]{2})"
MINIMUM_PATTERN = r"minimum monthly spend of \$([0-9](?:[0-9.,]*[0-9])?)"
TERM_PATTERN = r"(?i)\b(?:runs from|term:) ([0-9]{4}-[0-9]{2}-[0-9]{2}) (?:to|through) ([0-9]{4}-[0-9]{2}-[0-9]{2})"
AMOUNT_FORM = r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$"


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture group, by default the first, of the first match, NULL where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def try_date(text: Column) -> Column:
    """ISO date, NULL where the text is not one."""
    return F.try_to_date(text, "yyyy-MM-dd")


def iso(date: Column) -> Column:
    """YYYY-MM-DD."""
    return date.cast("string")


def month_end(month: Column) -> Column:
    """Last day of a ``YYYY-MM`` month, NULL where the text is not a month."""
    return F.last_day(F.concat(month, F.lit("-01")).try_cast("date"))


def number(value: Column, kind: str) -> Column:
    """A number spelled with the fixed count of decimals of ``kind``."""
    return value.cast(kind).cast("string")


def digits(written: Column) -> Column:
    """A written amount without its thousands separators; NULL if it is no number."""
    return F.when(written.rlike(AMOUNT_FORM), F.regexp_replace(written, ",", ""))


def fitted(digits: Column, kind: str) -> Column:
    """Digits as ``kind``; NULL if they are more than it holds."""
    narrow = digits.try_cast(kind)
    surplus = digits.rlike(r"\.[0-9]{18}[0-9]*[1-9]")
    return F.when((digits.try_cast("decimal(38,18)") == narrow) & ~surplus, narrow)


def exact(written: Column, kind: str) -> Column:
    """A written amount, thousands separated or not, as ``kind``; NULL if it is no number or has more digits."""
    return fitted(digits(written), kind)


def plain(value: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(value.cast("string"), r"\.?0+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))
