"""Quoted multi-line CSV in and out, and the full-refresh loads."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecheck import schemas
from duecheck.sources.snapshots import read_table, replace_table
from duecheck.sources.tables import stage

# escape='"' makes a doubled quote inside a field part of the field. Without
# column pruning a wrong number of fields fails on any action; a wrong type
# fails once its column is read, and a load reads them all.
_READ = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "mode": "FAILFAST",
    "columnPruning": False,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
_WRITE = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "quoteAll": True,
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _checked(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns of a table read as text; a number that its type cannot hold exactly ends the read.

    The message names the row. Nothing is rounded on the way in.
    """
    row = F.to_json(F.struct(*[F.col(f.name) for f in schema.fields]))

    def typed(field: T.StructField) -> Column:
        written = F.col(field.name)
        if not isinstance(field.dataType, (T.DecimalType, T.LongType, T.IntegerType)):
            return written.cast(field.dataType).alias(field.name)
        given = F.trim(written)
        held = given.try_cast(field.dataType)
        surplus = given.rlike(r"\.[0-9]{18}[0-9]*[1-9]") | (given.try_cast("decimal(38,18)") != held)
        fits = written.isNull() | F.coalesce(held.isNotNull() & ~surplus, F.lit(False))
        wrong = F.concat(F.lit(f"{field.name} does not fit {field.dataType.simpleString()} in "), row)
        return F.when(fits, held).otherwise(F.raise_error(wrong).cast(field.dataType)).alias(field.name)

    return raw.select(*[typed(f) for f in schema.fields])


def _numbered_lines(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """Physical lines with file, start of their block of bytes, place and number of quotes; blocks are read apart."""
    reader = spark.read.option("lineSep", "\n")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
        F.regexp_count("value", F.lit('"')).alias("quotes"),
    )


def _records(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """The text of each record but the header's, whatever blocks its lines lie in.

    A line starts a record if the quotes before it in its file pair up. Whether
    they do at the start of a block follows from a running sum over the counts
    of the blocks, one small row each; within the block, from a running sum over
    its lines. Records are put together in their block and stored. Only the last
    one of each block moves, to meet the lines that continue it in later blocks.
    """
    lines = _numbered_lines(spark, path, pattern)
    upto = (Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(in_file.rowsBetween(*upto)), F.lit(0))
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n")).select("file", "block", before.alias("before"))
    in_block = Window.partitionBy("file", "block").orderBy("place")
    known = F.coalesce("before", F.raise_error(F.lit("a file was cut into other blocks while it was read")).cast("long"))
    quotes = known + F.coalesce(F.sum("quotes").over(in_block.rowsBetween(*upto)), F.lit(0))
    marked = (
        lines.join(blocks, ["file", "block"], "left")
        .withColumn("starts", quotes % 2 == 0)
        .where(~(F.col("starts") & F.col("line").isin("", "\r")))  # a blank line between records
        .withColumn("record", F.sum(F.col("starts").cast("int")).over(in_block))
    )
    together = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["text"]), "\n")
    inside = stage(
        marked.groupBy("file", "block", "record").agg(
            together(F.collect_list(F.struct("place", F.col("line").alias("text")))).alias("text")
        ),
        "csv-records",
    )
    # One row per block, and numbers only: the stored records are not sorted once more to find the last.
    lasts = F.broadcast(inside.groupBy("file", "block").agg(F.max("record").alias("last")))
    placed = inside.join(lasts, ["file", "block"])
    moves = (F.col("record") == F.col("last")) | (F.col("record") == 0)
    owner = F.max(F.when(F.col("record") > 0, F.col("block"))).over(Window.partitionBy("file").orderBy("block", "record"))
    moved = (
        placed.where(moves)
        .withColumn("owner", owner)
        .groupBy("file", "owner")
        .agg(together(F.collect_list(F.struct("block", "record", "text"))).alias("text"), F.max("record").alias("record"))
        .select(F.col("owner").alias("block"), "record", "text")
    )
    found = placed.where(~moves).select("block", "record", "text").unionByName(moved)
    return found.where("not (block = 0 and record = 1)").select(F.regexp_replace("text", r"\r\z", "").alias("text"))


def _well_quoted(text: Column) -> Column:
    """The text of a record; quotes that do not enclose a whole field end the read, as they hide where records start."""
    rest = F.regexp_replace(text, '"[^"]*"', "\x01")
    wrong = rest.rlike('[^,\x01]\x01|\x01[^,\x01]|"|\n')
    return F.when(~wrong, text).otherwise(F.raise_error(F.concat(F.lit("quotes inside a field without quotes: "), text)))


def _split_multi_line(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None) -> DataFrame:
    """Records with newlines inside fields, read by as many tasks as the files have blocks."""
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    options = {k: str(v) for k, v in _READ.items() if k not in ("header", "columnPruning")} | {"multiLine": "true"}
    parsed = F.from_csv(_well_quoted(F.col("text")), ddl, options)
    # a generated row, unlike a projected one, is parsed whole whatever is read of it
    return _records(spark, path, pattern).select(F.inline(F.array(parsed)))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Strict CSV read; empty fields, quoted or not, are NULL.

    Files with newlines inside fields need ``multi_line``. All files are split:
    a large one is read by many tasks. Records end with a newline, or a carriage
    return and a newline; a file's first record is its header. Line breaks
    inside fields are kept as they are.
    """
    if multi_line:
        return _checked(_split_multi_line(spark, path, schema, pattern), schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    reader = spark.read.schema(text).options(**_READ)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return _checked(reader.csv(path), schema)


def write_csv(df: DataFrame, path: str) -> None:
    """One part file per partition, every field quoted."""
    df.write.mode("overwrite").options(**_WRITE).csv(path)


def read_billing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    return read_csv(spark, path, schemas.BILLING, pattern)


def read_contracts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    return read_csv(spark, path, schemas.CONTRACTS, pattern, multi_line=True)


def read_answer_key(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The answer key; only scoring functions accept it."""
    return read_csv(spark, path, schemas.ANSWER_KEY, pattern)


# Lines of one account and product lie together, so that sums over them shrink
# before they are shuffled.
BILLING_ORDER = ["customer_id", "product", "month", "invoice_id"]


def refresh(df: DataFrame, path: str, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Replace the table at ``path`` by ``df`` and return the stored table.

    The new rows become the table by one entry in its log, once all of them are
    written; a bad row, or a failure on the way, leaves the old table. With
    ``cluster_by`` the rows are parsed once into a table aside, and the files
    hold ranges of these columns; the place of a row is the last of them, so
    neither a hot key nor copies fill one file.
    """
    rows = df
    if cluster_by:
        placed = stage(df, "load").withColumn("_place", F.monotonically_increasing_id())
        ranges = [*cluster_by, "_place"]
        rows = placed.repartitionByRange(*ranges).sortWithinPartitions(*ranges).drop("_place")
    replace_table(rows, path)
    return read_table(df.sparkSession, path, df.schema)


def identified(billing: DataFrame) -> DataFrame:
    """Billing whose lines all have an invoice, an account and a month ``YYYY-MM``; any other line ends the load."""
    good = F.col("invoice_id").isNotNull() & F.col("customer_id").isNotNull()
    good = good & F.coalesce(F.col("month").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.lit(False))
    wrong = F.concat(F.lit("no invoice, account or month in "), F.to_json(F.struct(*billing.columns)))
    return billing.withColumn("invoice_id", F.when(good, F.col("invoice_id")).otherwise(F.raise_error(wrong)))


def load_billing(spark: SparkSession, source: str, target: str, pattern: str | None = None) -> DataFrame:
    return refresh(identified(read_billing(spark, source, pattern)), target, BILLING_ORDER)


def load_contracts(spark: SparkSession, source: str, target: str, pattern: str | None = None) -> DataFrame:
    return refresh(read_contracts(spark, source, pattern), target)


def load_answer_key(spark: SparkSession, source: str, target: str, pattern: str | None = None) -> DataFrame:
    return refresh(read_answer_key(spark, source, pattern), target)


def export_memos(memos: DataFrame, path: str) -> None:
    """CSV export of a memo list without its display label."""
    write_csv(memos.drop("label"), path)
