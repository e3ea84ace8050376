"""A corpus pipeline: classify, drop copies and near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written and
read again as the next one's docs. All but the last return the columns of
documents. Stages handle nulls, repeated rows and empty tables as the operators
state; a rejected, dropped or undrawn document is gone for all later stages, and
a document the mix draws twice is there twice.

A stage's result is stored before the next stage is called: a stage removes the
intermediate tables of the one before it from the shared folder.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecheck.llm import exact_dedup, minhash_dedup, mixing, quality_gam, sentencepiece_nbest
from duecheck.llm.common import fold, table
from duecheck.sources.tables import drop_tables, noted, stage

#: Folders of the intermediate tables of the latest stage.
_LEFT: list[str] = []


def tidy(function):
    """A stage that removes what the one before it left in the shared folder, unless ``docs`` still reads from it."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rsplit("/", 1)[0].removeprefix("file:").replace("//", "/") for f in docs.inputFiles()}
        if not any(folder.removeprefix("file:").replace("//", "/") in read for folder in _LEFT):
            drop_tables(spark, _LEFT)
            _LEFT.clear()
        with noted() as stored:
            out = function(spark, docs, sf_dir)
        _LEFT.extend(stored)
        return out

    return run_stage


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, trained on the labelled documents, does not reject."""
    usable = fold(F.col("doc_id"), 5) != 0
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"), usable)
    whole = docs.select("text", F.struct("*").alias("doc"))
    scored = quality_gam.score(whole, model, "score")
    return scored.where(F.col("score") >= quality_gam.THRESHOLD).select("doc.*")


@tidy
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of equal texts."""
    return exact_dedup.kept(docs)


@tidy
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return minhash_dedup.kept(docs)


@tidy
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw sources to their targets."""
    return mixing.mixed(docs)


@tidy
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces: n_pieces, ids and the score of the best segmentation, scores of the N best."""
    whole = docs.select("text", F.struct("*").alias("doc"))
    found = sentencepiece_nbest.encode(whole).withColumn("best", F.col("segmentations")[0])
    own = ("n_pieces", "ids", "score", "scores")  # a document's columns of these names give way
    return found.select(
        *[F.col("doc")[c].alias(c) for c in docs.columns if c not in own],
        F.size("best.ids").cast("long").alias("n_pieces"),
        F.col("best.ids").alias("ids"),
        F.col("best.score").alias("score"),
        F.col("segmentations.score").alias("scores"),
    )


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", source_mix),
    ("sentencepiece", pieces),
]

#: SQL can express neither the classifier nor the sampling; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
