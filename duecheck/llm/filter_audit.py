"""Filter interaction audit: what every filter removes in every order, by contingency tensor contractions.

FILTERS are failure conditions of a text. One pass finds which a document fails;
after that only counts matter: documents per part, failed filters and labels.
The counts of a part make a tensor of 2x2x2x2x2 (passed or failed, an axis per
filter), one for all documents, one for good and one for toxic ones. Each step of
each order is then a contraction: along an axis, ``einsum`` takes the passing
layer, the failing layer or both. All 120 orders of a part are read from three
tensors, however many documents they count.

Filter E needs the whole table: a text fails it if an equal text has a smaller
doc_id. Rows are counted per text and part with partial aggregation, so a text
that a third of all rows repeat is a few rows by the time it meets itself; the
rows that hold the smallest id of their text pass, all others fail.

Defined results: a null text is empty; a null part is the empty string, and one
part with it. A row with a null doc_id has no smaller id, so it passes E, has no
label, and makes no other row fail. Rows repeated under one id are documents
each and pass E together. A document is good (toxic) if any of its label rows
says so; labels without a document count nowhere. Other columns are ignored. An
empty table gives no rows.
"""

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecheck.sources.tables import stage

NAMES = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PCT = 50
MOST_CAPITALS_PCT = 3
SYMBOLS = r"[#$%&*|]"
_SPACES = " \t\n\x0b\x0c\r"
#: What a contraction takes of an axis: passing, failing or both.
_PASS, _FAIL, _ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
_ROW = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> dict[str, Column]:
    """Filters A to D as failure conditions of one text."""
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    count = F.size(words)
    capitals = F.regexp_count(whole, F.lit("[A-Z]"))
    return {
        "A": count < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < count * LEAST_DISTINCT_PCT,
        "C": capitals * 100 > F.char_length(whole) * MOST_CAPITALS_PCT,
        "D": whole.rlike(SYMBOLS),
    }


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with good and toxic. Rows of null ids match no label and are dealt by hash instead."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    met = rows.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left")
    nameless = rows.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    return met.unionByName(nameless).fillna(0, ["good", "toxic"])


def cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """part, cell (bits of failed filters, A the highest), n, good, toxic: the non-zero entries of the tensors."""
    text = F.coalesce("text", F.lit(""))
    bits = sum(
        (F.when(c, 1 << (len(NAMES) - 1 - NAMES.index(name))).otherwise(0) for name, c in failures(F.col("text")).items()),
        F.lit(0),
    )
    rows = docs.select(
        "doc_id",
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        bits.alias("bits"),
    )
    counted = _labelled(stage(rows, "filter-flags"), labels).groupBy("digest", "doc_id", "part", "bits", "good", "toxic").agg(F.count("*").alias("n"))
    # per text and part: all rows, and how many of them hold the smallest id
    per_part = stage(
        counted.groupBy("digest", "part", "bits", "good", "toxic").agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        ),
        "filter-texts",
    )
    least = per_part.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = per_part.join(least, "digest").select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("bits").alias("cell"), passing.alias("n")),
            F.struct((F.col("bits") + 1).alias("cell"), (F.col("n") - passing).alias("n")),
        )).alias("c"),
    )
    return split.groupBy("part", F.col("c.cell").alias("cell")).agg(
        F.sum("c.n").alias("n"),
        F.sum(F.col("c.n") * F.col("good")).alias("good"),
        F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"),
    )


def _selectors() -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """(order, step, filter) of all steps, and per count what it takes of each axis: arrays of (step, axis, 2)."""
    n = len(NAMES)
    steps, taken = [], {"kept": [], "removed": [], "failing": [], "unique": []}
    for order in permutations(range(n)):
        for step, i in enumerate(order):
            before = order[:step]
            steps.append(("".join(NAMES[a] for a in order), step + 1, i))
            taken["kept"].append([_PASS if a in before or a == i else _ALL for a in range(n)])
            taken["removed"].append([_PASS if a in before else _FAIL if a == i else _ALL for a in range(n)])
            taken["failing"].append([_FAIL if a == i else _ALL for a in range(n)])
            taken["unique"].append([_FAIL if a == i else _PASS for a in range(n)])
    return steps, {name: np.array(axes) for name, axes in taken.items()}


def contract(tensors: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """Per tensor and step the sum over what the step takes of each axis."""
    return np.einsum("tabcde,sa,sb,sc,sd,se->ts", tensors, *np.moveaxis(selectors, 1, 0))


def audit_part(tensors: np.ndarray) -> pd.DataFrame:
    """All steps of all orders from the tensors of one part: all documents, good ones, toxic ones."""
    steps, taken = _selectors()
    out = pd.DataFrame(steps, columns=["filter_order", "step", "filter"])
    out["kept"] = contract(tensors[:1], taken["kept"])[0]
    out["removed"], out["good_lost"], out["toxic_lost"] = contract(tensors, taken["removed"])
    out["redundant"] = contract(tensors[:1], taken["failing"])[0] - out.removed
    out["unique_fails"] = contract(tensors[:1], taken["unique"])[0]
    out["shapley"] = out.groupby("filter").removed.transform("sum")
    return out


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """One row per part, order of the filters and step."""

    def contracted(pdf: pd.DataFrame) -> pd.DataFrame:
        tensors = np.zeros((3, 2 ** len(NAMES)), np.int64)
        tensors[:, pdf.cell.to_numpy()] = pdf[["n", "good", "toxic"]].to_numpy().T
        steps = audit_part(tensors.reshape(3, *[2] * len(NAMES)))
        return steps.assign(part=pdf.part.iloc[0])[[c.split()[0] for c in _ROW.split(", ")]]

    found = cells(docs, labels, F.col("lang") if part is None else part)
    return found.groupBy("part").applyInPandas(contracted, _ROW)
