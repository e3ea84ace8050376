"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecheck.llm import (
    ann_collision,
    exact_dedup,
    filter_audit,
    hmm_lm,
    license_scan,
    minhash_dedup,
    mixing,
    quality_gam,
    secret_scan,
    sentencepiece_nbest,
    spelling_groups,
    token_counts,
    topk_search,
)
from duecheck.llm.common import fold, table


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash_dedup.near_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, folder, "documents")))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = sentencepiece_nbest.encode(docs, round_trip="round_trip", without=["text"])
    return found.select(
        "doc_id",
        F.size(F.col("segmentations")[0]["ids"]).cast("long").alias("n_pieces"),
        F.col("segmentations")[0]["ids"].alias("ids"),
        F.col("segmentations.score").alias("scores"),
        F.transform("segmentations", lambda s: F.xxhash64(s["ids"])).alias("id_hashes"),
        "round_trip",
    )


def op4_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality_gam.train(docs, table(spark, folder, "labels"), ~held_out)
    return quality_gam.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= quality_gam.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_hmm_lm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 10) == 0
    found = hmm_lm.score_texts(table(spark, folder, "documents"), ~held_out)
    return found.withColumn("held_out", ~F.col("trained")).drop("trained")


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op8_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk_search.exact_topk(vectors, F.col("vec_id") % 100 == 0)


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, folder, "documents")))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, folder, "documents"))


def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann_collision.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups.group_variants(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_dedup,
        op2_license_scan,
        op3_sentencepiece,
        op4_quality_gam,
        op5_hmm_lm,
        op6_source_mixing,
        op7_exact_dedup,
        op8_topk_search,
        op9_secret_scan,
        op10_token_counts,
        op11_nearest,
        op12_filter_audit,
        op13_spelling_groups,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


OP7_SQL = r"""WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)"""

OP8_SQL = """WITH x AS (
  SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
e AS (
  SELECT vec_id, floor(1024 * x)::bigint AS x, i FROM x
  WHERE vec_id NOT IN (SELECT vec_id FROM x WHERE vec_id IS NOT NULL AND (x IS NULL OR NOT isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::bigint AS score FROM e q JOIN e c ON q.i = c.i
  WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::integer AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""


OP12_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, [len(ws) < 200,
      100 * len(list_distinct(ws)) < 50 * len(ws),
      100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
      regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, k AS step, instr('ABCDE', filter_order[k]) AS i
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE length(filter_order) = 5),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
m AS (
  SELECT part, filter_order, step, i, n, good, bad, fails[i] AS fail,
    list_bool_or([false] || [fails[instr('ABCDE', filter_order[j])] FOR j IN range(1, step)]) AS gone,
    len([x FOR x IN fails IF x]) = 1 AS alone FROM g, s),
r AS (
  SELECT part, filter_order, step, i, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END)::bigint AS removed,
    sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN fail AND alone THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END)::bigint AS good_lost,
    sum(CASE WHEN NOT gone AND fail THEN bad ELSE 0 END)::bigint AS toxic_lost FROM m GROUP BY ALL)
SELECT * EXCLUDE (i), sum(removed) OVER (PARTITION BY part, i)::bigint AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    found = {"op7_exact_dedup": OP7_SQL, "op8_topk_search": OP8_SQL, "op12_filter_audit": OP12_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
