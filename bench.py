"""Time the headline queries; prints one JSON line.

Shared tables are derived and stored first, each under ``store_<name>``. Then
every query runs RUNS times, all of its rows consumed; the median counts. The
value is the sum of both, so that no work is left out; ``queries_only`` and
``stored_only`` give the parts.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from duecheck.plans.queries import queries
from duecheck.plans.workspace import workspace

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

STORED = [
    "accounts",
    "account_months",
    "contracts",
    "responses",
    "billing",
    "answer_key",
    "terms",
    "meta",
    "candidates",
    "findings",
    "previous",
    "reviewed",
    "drafted",
    "verdict",
    "seed_contracts",
    "seed_billing",
    "seed_key",
    "volume_billing",
    "volume_terms",
    "volume_meta",
]
HEADLINE = [
    "x8_extract_terms_regex",
    "x9_extract_meta_regex",
    "x14_usable_terms",
    "v4_term_disagreements",
    "d1_rate_leak",
    "d2_stale_discount",
    "d6_missing_charge",
    "d7_minimum_shortfall",
    "d9_detect_leaks",
    "volume_billing",
    "volume_detect_leaks",
    "m3_memo_carry_over",
    "m6_top_findings",
    "e4_verdicts",
    "e5_scorecard",
    "e9_dollar_accuracy",
    "e10_confirmed_value",
    "k5_template_memos",
    "r7_customer_ranking",
    "g3_billing",
    "g7_evaluate_seeds",
    "o1_reconcile",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    ws = workspace(spark, FOLDER)
    for name in STORED:
        start = time.perf_counter()
        ws[name]
        seconds[f"store_{name}"] = round(time.perf_counter() - start, 3)
    registered = queries()
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            registered[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    queries_only = sum(seconds[name] for name in HEADLINE)
    stored_only = sum(seconds[f"store_{name}"] for name in STORED)
    print(
        json.dumps(
            {
                "metric": "headline queries (sum of medians) and the stored tables they read",
                "value": round(queries_only + stored_only, 3),
                "unit": "sec",
                "queries_only": round(queries_only, 3),
                "stored_only": round(stored_only, 3),
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
