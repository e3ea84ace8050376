"""Which accounts changed between two runs, by fingerprints of all their rows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW = (1 << 32) - 1


def account_fingerprints(tables: dict[str, DataFrame], rules: str, key: str = "customer_id") -> DataFrame:
    """One row per account: rows and sums of two 64-bit hashes over its rows in all ``tables``, and the ``rules``.

    Sums do not depend on the order of rows and count repeated ones. They are
    combined before the shuffle, so a hot account is one row per task. Hashes
    are summed in halves of 32 bits, which cannot overflow below 2**31 rows.
    Rows without an account belong to none.
    """

    def hashed(name: str, df: DataFrame) -> DataFrame:
        columns = [F.col(c) for c in sorted(df.columns)]
        h1, h2 = F.xxhash64(F.lit(name), *columns), F.xxhash64(*columns, F.lit(name))
        halves = [h for h in (h1, h2) for h in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW)))]
        return df.select(key, *[h.alias(f"h{i}") for i, h in enumerate(halves)])

    rows = reduce(DataFrame.unionByName, [hashed(name, df) for name, df in sorted(tables.items())])
    sums = [F.sum(f"h{i}").alias(f"h{i}") for i in range(4)]
    return (
        rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"), *sums).withColumn("rules", F.lit(rules))
    )


def changed_accounts(before: DataFrame, now: DataFrame, key: str = "customer_id") -> DataFrame:
    """Accounts that are new, gone, or have another fingerprint."""
    return (
        before.unionByName(now)
        .groupBy(*now.columns)
        .agg(F.count("*").alias("n"))
        .where("n = 1")
        .select(key)
        .distinct()
    )
