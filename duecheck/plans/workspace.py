"""The stored domain tables that the registered queries share.

Each table is derived from the tables of one data folder, written once per
session to the shared folder, and read back by every query that needs it.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecheck.functions.hashing import hash32
from duecheck.operators import detect, evaluate, extract, findings, memos
from duecheck.plans import corpus, sweep, volume
from duecheck.schemas import ARM_IDENTITY
from duecheck.sources.tables import stage

ARMS = list(findings.ARM_LABELS.values())
ARM = ARMS[0]
RUN_AT = datetime(2026, 7, 31)


class Workspace:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = stage(_BUILDERS[name](self), name)
        return self._stored[name]


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]


def _terms(ws: Workspace) -> DataFrame:
    return extract.extract_terms_regex(ws["contracts"]).unionByName(
        extract.terms_from_responses(ws["responses"])
    )


def _meta(ws: Workspace) -> DataFrame:
    return extract.extract_meta_regex(ws["contracts"]).unionByName(
        extract.meta_from_responses(ws["responses"])
    )


def previous_findings(found: DataFrame) -> DataFrame:
    """An earlier state of the findings: some reviewed, some twice, some since gone."""
    draw = hash32("memo", *[F.col(c) for c in ARM_IDENTITY])

    def state(month, memo, day: int, chosen):
        return F.when(
            chosen,
            F.array(
                F.struct(
                    month.alias("month"),
                    memo.alias("draft_memo"),
                    F.lit(datetime(2026, 7, day)).cast("timestamp_ntz").alias("created_at"),
                )
            ),
        ).otherwise(F.array())

    about = F.concat(F.col("product"), F.lit(" in "), F.col("month"))
    current = F.col("month")
    states = F.concat(
        state(current, F.concat(F.lit("Reviewed: "), about), 20, draw % 3 == 0),
        state(current, F.concat(F.lit("First draft: "), about), 10, draw % 9 == 0),
        state(current, F.lit(None).cast("string"), 20, draw % 3 != 0),
        state(F.lit("2025-12"), F.concat(F.lit("Long gone: "), about), 20, draw % 5 == 0),
    )
    columns = found.columns
    return found.withColumn("s", F.explode(states)).drop("month", "draft_memo", "created_at").select(
        "*", "s.*"
    ).select(columns)


_BUILDERS = {
    "accounts": lambda ws: corpus.accounts(ws.raw("customer")),
    "contracts": lambda ws: corpus.contracts(ws["accounts"]),
    "responses": lambda ws: corpus.model_responses(ws["accounts"]),
    "account_months": lambda ws: corpus.account_months(ws["accounts"]),
    "billing": lambda ws: corpus.billing(ws["account_months"]),
    "answer_key": lambda ws: corpus.answer_key(ws["account_months"]),
    "terms": _terms,
    "meta": _meta,
    "candidates": lambda ws: detect.detect_leaks(ws["billing"], ws["terms"], ws["meta"]),
    "findings": lambda ws: findings.build_findings(ws["candidates"], run_at=RUN_AT),
    "previous": lambda ws: previous_findings(ws["findings"]),
    "reviewed": lambda ws: findings.build_findings(ws["candidates"], ws["previous"], RUN_AT),
    "drafted": lambda ws: memos.draft_templates(ws["reviewed"], ARM),
    "verdict": lambda ws: evaluate.verdicts(ws["findings"], ws["answer_key"]),
    "seed_accounts": lambda ws: corpus.accounts(ws.raw("customer"), corpus.SEEDS),
    "seed_months": lambda ws: corpus.account_months(ws["seed_accounts"]),
    "seed_contracts": lambda ws: corpus.contracts(ws["seed_accounts"]),
    "seed_billing": lambda ws: corpus.billing(ws["seed_months"]),
    "seed_key": lambda ws: corpus.answer_key(ws["seed_months"]),
    "sweep": lambda ws: sweep.evaluate_seeds(ws["seed_contracts"], ws["seed_billing"], ws["seed_key"]),
    "volume_billing": lambda ws: volume.billing(
        ws.raw("lineitem"), ws.raw("orders"), ws.raw("part"), ws.raw("customer")
    ),
    "volume_terms": lambda ws: volume.terms(ws["volume_billing"]),
    "volume_meta": lambda ws: volume.meta(ws.raw("customer")),
}
