"""License scans with DataFrame functions only: ordered signature rules behind a keyword prefilter.

Most texts hold none of a few anchors and are passed over. For the others, only
rules all of whose keywords occur are matched (``license_rules``, some hundreds
of expressions). All matches become detections with places. A detection is
suppressed if one of at least its rank contains it: a longer one of the same or
a higher priority, or one of the same place with a higher priority or an earlier
rule. A guess (priority 5) yields to all that overlap it. What is left gives the labels. Beside the rules, the places of the base
phrases are found word by word. One pass over the texts, no shuffle.

Defined results: a null text counts as empty: no words, no labels, score 0, null
places. Words are longest runs of ASCII letters and digits and all characters
beyond ASCII. Every input row, repeated or without an id, gives one row.
"""

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecheck.llm.license_rules import ANCHORS, CC_BY, Rule, rules

BASE = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
BASE_WEIGHT = 0.5
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literal(found: list[Rule]) -> Column:
    """The rules as one constant."""
    rows = [
        {"n": r.order, "l": r.label, "p": r.priority, "k": r.keywords, "x": r.pattern, "w": r.weight} for r in found
    ]
    return F.from_json(
        F.lit(json.dumps(rows)), "array<struct<n:int,l:string,p:int,k:array<string>,x:string,w:double>>"
    )


def _places(label: str) -> Column:
    """Starts of a base phrase among ``words``."""
    same = " and ".join(f"get(words, i + {n}) = '{w}'" for n, w in enumerate(BASE[label]))
    return F.expr(f"filter(sequence(0, size(words) - 1), i -> {same})")


_HITS = """filter(transform(filter(rules, r -> forall(r.k, k -> contains(lower_text, k))),
  r -> named_struct('r', r, 'm', regexp_extract_all(lower_text, r.x, 0), 's', split(lower_text, r.x, -1))), h -> size(h.m) > 0)"""
# A match starts after the pieces before it and the matches before it.
_SPANS = """flatten(transform(hits, h -> transform(h.m, (x, i) -> named_struct(
  'start', aggregate(slice(h.s, 1, i + 1), 0, (a, y) -> a + length(y)) + aggregate(slice(h.m, 1, i), 0, (a, y) -> a + length(y)),
  'size', length(x), 'label', h.r.l, 'priority', h.r.p, 'rule', h.r.n, 'weight', h.r.w))))"""
_ALIVE = """filter(spans, d -> not exists(spans, e -> e.start <= d.start and e.start + e.size >= d.start + d.size and (
  (e.size > d.size and e.priority <= d.priority) or (e.size = d.size and (e.priority < d.priority
    or (e.priority = d.priority and e.rule < d.rule)))) or (d.priority = 5 and e.priority < 5
  and e.start < d.start + d.size and d.start < e.start + e.size)))"""


def scan(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, places of the base phrases, and the surviving detections of every row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    anchored = reduce(or_, [F.lower("t").contains(a) for a in ANCHORS])
    cc_by = F.lower("t").contains("cc") & F.lower("t").rlike(CC_BY)
    spread = F.lower("t").contains("general") & F.lower("t").contains("public")  # phrases may span lines
    marked = texts.select(
        "doc_id",
        F.regexp_count("t", F.lit(_WORD)).cast("long").alias("n_words"),
        F.when(anchored | cc_by | spread, F.translate("t", _UPPER, _LOWER)).alias("lower_text"),
    )
    present = F.col("lower_text").isNotNull()
    constant = marked.withColumn("rules", _literal(rules() if found is None else found))
    hits = constant.select(
        "doc_id",
        "n_words",
        F.when(present, F.regexp_extract_all("lower_text", F.lit(_WORD), F.lit(0))).alias("words"),
        F.when(present, F.expr(_HITS)).alias("hits"),
    )
    spans = hits.select(
        "doc_id",
        "n_words",
        F.when(F.size("words") > 0, F.struct(*[_places(x).alias(x) for x in BASE])).alias("base"),
        F.when(F.size("hits") > 0, F.expr(_SPANS)).alias("spans"),
    )
    return spans.select(
        "doc_id",
        "n_words",
        *[F.coalesce(F.col("base")[x], F.array().cast("array<int>")).alias(x) for x in BASE],
        F.coalesce(F.expr(_ALIVE), F.array().cast(spans.schema["spans"].dataType)).alias("detections"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and places of the base phrases, labels and a score."""
    base = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(x)) for x in BASE]))
    places = scanned.select(
        "doc_id", "n_words", F.concat(*[F.col(x) for x in BASE]).alias("places"), base.alias("base"), "detections"
    )
    labels = F.array_distinct(F.concat("base", F.col("detections.label")))
    weight = F.coalesce(F.array_max("detections.weight"), F.lit(0.0))
    return places.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(weight, F.when(F.size("base") > 0, F.lit(BASE_WEIGHT)).otherwise(0.0)).alias("score"),
    )
