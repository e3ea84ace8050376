"""What the operators of this subpackage share: input tables, folds, a bounded filter, connected classes."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecheck.sources.tables import stage

FILTER_WORDS = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker holds of long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the tables stored within; what was there before comes back in any case."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def numbered(docs: DataFrame, name: str, columns: str = "*") -> DataFrame:
    """(row, doc): rows under a number that is stored with them, as a later scan may be split in another way."""
    doc = F.struct(*columns.split(", ")).alias("doc")
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), doc), name)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def split_by(
    rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str
) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``wanted``, rows whose key is surely not).

    A bitmap of 2**24 bits is broadcast: at most 2**18 rows of 16 bytes, however
    large ``wanted`` is. It only spares a shuffle; the exact join comes after.
    """
    place = F.pmod(F.xxhash64(F.col(wanted_key)), F.lit(64 * FILTER_WORDS))
    words = (
        wanted.select(place.alias("p"))
        .groupBy(F.expr("p div 64").alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("_bits"))
    )
    marked = rows.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(64 * FILTER_WORDS)))
    holds = F.expr("_own div 64 = _word and (shiftright(_bits, cast(_own % 64 as int)) & 1L) = 1L")
    within = marked.join(F.broadcast(words), holds, "left_semi").drop("_own")
    outside = marked.join(F.broadcast(words), holds, "left_anti").drop("_own")
    return within, outside
