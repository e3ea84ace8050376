"""Exact dedup with DataFrame functions only: local, salted, then global winners, by full content.

Texts are equal when they are identical after each run of ASCII white space
became one space; a null text counts as empty.

A first pass counts digests. A digest held by one row needs no comparison.
Rows of all other digests are compared by their whole normalised text three
times: within a task (partial aggregation), within a salted group, and between
the winners of the salts. So no group of copies, however large, meets in one
task before it has shrunk to at most SALTS rows. A digest that turns out to
hold several texts (a collision) is joined back by text, all others by digest.

Defined results: empty and null texts are copies of each other. Rows alike in
doc_id and text are copies like any others, exactly one of them is kept. A null
doc_id loses against any other; a group of null ids only has a null keep_id and
still keeps one row. Other columns are ignored here, and carried by ``kept``.
An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecheck.llm.common import numbered, split_by
from duecheck.sources.tables import stage

SALTS = 32


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space each; single spaces need no replacement."""
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def _order() -> Column:
    """Smallest doc_id first, null ids last, then the place in the table."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))


def _rows(whole: DataFrame) -> DataFrame:
    """(row, doc_id, text, digest) of numbered documents."""
    placed = whole.select("row", "doc.doc_id", normalised(F.col("doc.text")).alias("text"))
    return placed.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))


def _shrink(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def groups(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per document: row, doc_id, digest; one row per repeated text: digest, text, first, n, texts)."""
    found = _rows(whole)
    placed = stage(found.select("row", "doc_id", "digest"), "digests")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    repeated = (
        placed.withColumn("salt", salt)
        .groupBy("digest", "salt")
        .agg(F.count("*").alias("n"))
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("wanted"))
    )
    repeated = stage(repeated, "repeated-digests")
    candidates, _ = split_by(found, F.col("digest"), repeated, "wanted")
    single = candidates.select(
        "digest", "text", salt.alias("salt"), _order().alias("first"), F.lit(1).cast("long").alias("n")
    )
    salted = _shrink(single, ["digest", "text", "salt"])
    whole = _shrink(salted, ["digest", "text"])
    per_digest = whole.groupBy("digest").agg(
        F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n")
    )
    alone = stage(per_digest, "digest-groups")
    return placed, alone


def _colliding(whole: DataFrame, digests: DataFrame) -> DataFrame:
    """The groups of digests that several texts share, by text."""
    rows = _rows(whole).join(digests.select("digest"), "digest", "left_semi")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    single = rows.select(
        "digest", "text", salt.alias("salt"), _order().alias("first"), F.lit(1).cast("long").alias("n")
    )
    whole = _shrink(_shrink(single, ["digest", "text", "salt"]), ["digest", "text"])
    return rows.select("row", "digest", "text").join(whole, ["digest", "text"]).select("row", "first", "n")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, digest."""
    return _dedup(numbered(docs, "dedup-texts", "doc_id, text"))


def _dedup(whole: DataFrame) -> DataFrame:
    placed, found = groups(whole)
    plain = found.where("texts = 1").select("digest", "first", "n")
    clashes = found.where("texts > 1")
    joined = placed.join(plain, "digest", "left")
    if not clashes.isEmpty():
        by_text = _colliding(whole, clashes).withColumnsRenamed({"first": "first_", "n": "n_"})
        joined = (
            joined.join(by_text, "row", "left")
            .withColumn("first", F.coalesce("first_", "first"))
            .withColumn("n", F.coalesce("n_", "n"))
        )
    alone = F.col("first").isNull()
    return joined.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        "digest",
    )


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only rows that may belong to a dropped copy are shuffled with their texts.
    """
    whole = numbered(docs, "dedup-documents")
    lost = stage(_dedup(whole).where(~F.col("kept")).select(F.col("row").alias("lost")), "copies")
    maybe, sure = split_by(whole, F.col("row"), lost, "lost")
    checked = maybe.join(lost, F.col("row") == F.col("lost"), "left_anti")
    return sure.select("doc.*").unionByName(checked.select("doc.*"))
