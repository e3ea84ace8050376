"""Repeatable pseudo-random whole numbers and stable identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str) -> Column:
    """First 32 bits of an md5 over the parts; strings are literals."""
    cells = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    head = F.substring(F.md5(F.concat_ws("|", *cells)), 1, 8)
    return F.conv(head, 16, 10).cast("long")


def stable_id(*parts: Column) -> Column:
    """Identifier that is the same on every rerun and retry.

    NULL parts are spelled out, since concat_ws would skip them and let two
    different rows share an identifier.
    """
    cells = [F.coalesce(p.cast("string"), F.lit("∅")) for p in parts]
    return F.sha2(F.concat_ws("|", *cells), 256)
