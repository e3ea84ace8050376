"""The registered queries: one per operator, each over whole tables."""

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecheck import schemas
from duecheck.operators import detect, evaluate, extract, findings, memos, quality, report
from duecheck.plans import corpus, run, sweep, volume
from duecheck.plans.workspace import ARM, ARMS, RUN_AT, Workspace, workspace
from duecheck.schemas import IDENTITY
from duecheck.sources import audit, csv, tables

REGEX, RESPONSES = extract.REGEX_ARM, extract.RESPONSE_ARM
_QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}


def query(function: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    _QUERIES[function.__name__] = function
    return function


def present(df: DataFrame) -> DataFrame:
    """Types that every SQL engine shows alike: double, long, string, boolean."""
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("long")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function):
        return lambda spark, folder: present(function(workspace(spark, folder)))

    return {name: bind(function) for name, function in _QUERIES.items()}


def _fresh_path(ws: Workspace, name: str) -> str:
    return f"{tables.scratch_dir(ws.spark)}/out/{name}-{uuid.uuid4().hex[:8]}"


def _plain(found: DataFrame) -> DataFrame:
    return found.drop("created_at")


# --- sources and sinks -------------------------------------------------------


@query
def s1_csv_source(ws):
    path = _fresh_path(ws, "contracts-csv")
    csv.write_csv(ws["contracts"], path)
    return csv.read_contracts(ws.spark, path)


@query
def s2_load_billing(ws):
    source = _fresh_path(ws, "billing-csv")
    csv.write_csv(ws["billing"], source)
    return csv.load_billing(ws.spark, source, _fresh_path(ws, "billing"), "part-*.csv")


@query
def s3_load_contracts(ws):
    source = _fresh_path(ws, "contracts-csv")
    csv.write_csv(ws["contracts"], source)
    stored = csv.load_contracts(ws.spark, source, _fresh_path(ws, "contracts"), "part-*.csv")
    return stored.select("customer_id", "customer_name", F.md5("contract_text").alias("text_md5"))


@query
def s4_load_answer_key(ws):
    source = _fresh_path(ws, "key-csv")
    csv.write_csv(ws["answer_key"], source)
    return csv.load_answer_key(ws.spark, source, _fresh_path(ws, "key"), "part-*.csv")


@query
def s5_load_audit(ws):
    names = ["billing", "contracts", "answer_key"]
    kinds = {"billing": schemas.BILLING, "contracts": schemas.CONTRACTS, "answer_key": schemas.ANSWER_KEY}
    loaded = {}
    for name in names:
        source = _fresh_path(ws, f"{name}-csv")
        csv.write_csv(ws[name], source)
        loaded[name] = csv.read_csv(ws.spark, source, kinds[name], multi_line=name == "contracts")
    written = [ws[n].agg(F.count("*").alias("expected")).withColumn("table_name", F.lit(n)) for n in names]
    return audit.load_audit(loaded, reduce(DataFrame.unionByName, written))


@query
def s12_load_audit_from_log(ws):
    """Counts observed while the loads wrote, beside counts of what was to be loaded."""
    loads = {"billing": csv.load_billing, "contracts": csv.load_contracts, "answer_key": csv.load_answer_key}
    paths = {name: _fresh_path(ws, name) for name in loads}
    for name, load in loads.items():
        source = _fresh_path(ws, f"{name}-csv")
        csv.write_csv(ws[name], source)
        load(ws.spark, source, paths[name])
    written = [ws[n].agg(F.count("*").alias("expected")).withColumn("table_name", F.lit(n)) for n in loads]
    return audit.load_audit_from_log(ws.spark, paths, reduce(DataFrame.unionByName, written))


@query
def s6_document_profile(ws):
    return audit.document_profile(ws["contracts"])


@query
def s7_document_sample(ws):
    return audit.document_sample(ws["contracts"])


@query
def s8_replace_arm(ws):
    path = _fresh_path(ws, "findings")
    findings.write_findings(ws["findings"], path, ARMS)
    only_rates = ws["findings"].where(F.col("leak_type") == detect.RATE_LEAK)
    return _plain(findings.write_findings(only_rates, path, [ARM]))


@query
def s9_memo_export(ws):
    path = _fresh_path(ws, "memos-csv")
    listed = report.memo_list(ws["drafted"], ARM)
    csv.export_memos(listed, path)
    return csv.read_csv(ws.spark, path, listed.drop("label").schema, multi_line=True)


@query
def s10_csv_writers(ws):
    path = _fresh_path(ws, "key-csv")
    csv.write_csv(ws["answer_key"], path)
    return csv.read_answer_key(ws.spark, path)


@query
def s11_sweep_sink(ws):
    path = _fresh_path(ws, "sweep")
    sweep.write_sweep(sweep.stamp(ws["sweep"].withColumn("fn", F.lit(0).cast("long")), RUN_AT), path)
    return sweep.write_sweep(sweep.stamp(ws["sweep"], RUN_AT), path).drop("run_at")


# --- extraction --------------------------------------------------------------


@query
def x1_split_lines(ws):
    return extract.split_lines(ws["contracts"])


@query
def x2_priced_lines(ws):
    return extract.priced_lines(ws["contracts"])


@query
def x3_product_capture(ws):
    lines = extract.split_lines(ws["contracts"])
    return lines.select("customer_id", "line_no", extract.product_of(F.col("line")).alias("product"))


@query
def x4_rate_capture(ws):
    lines = extract.split_lines(ws["contracts"])
    return lines.select("customer_id", "line_no", extract.rate_of(F.col("line")).alias("contract_rate"))


@query
def x5_discount_clause(ws):
    clause = extract.discount_of(F.col("contract_text"))
    return ws["contracts"].select("customer_id", clause.alias("discount_pct"))


@query
def x6_expiry_clause(ws):
    clause = extract.expiry_of(F.col("contract_text"))
    return ws["contracts"].select("customer_id", clause.alias("discount_valid_through"))


@query
def x7_minimum_clause(ws):
    clause = extract.minimum_of(F.col("contract_text"))
    return ws["contracts"].select("customer_id", clause.alias("min_monthly_commit"))


@query
def x8_extract_terms_regex(ws):
    return extract.extract_terms_regex(ws["contracts"])


@query
def x9_extract_meta_regex(ws):
    return extract.extract_meta_regex(ws["contracts"])


@query
def x10_extraction_requests(ws):
    return extract.extraction_requests(ws["contracts"])


@query
def x11_land_responses(ws):
    return extract.land_responses(ws["responses"], _fresh_path(ws, "responses"))


@query
def x12_open_envelope(ws):
    return extract.open_envelope(ws["responses"]).select(
        "customer_id",
        F.size("terms.products").alias("n_products"),
        "terms.discount_pct",
        "terms.discount_valid_through",
        "terms.min_monthly_commit",
    )


@query
def x13_flatten_products(ws):
    return extract.flatten_products(extract.open_envelope(ws["responses"]))


@query
def x14_usable_terms(ws):
    return extract.terms_from_responses(ws["responses"])


@query
def x15_meta_from_responses(ws):
    return extract.meta_from_responses(ws["responses"])


# --- checks on terms and billing ---------------------------------------------


@query
def v1_bad_terms(ws):
    return quality.bad_terms(extract.flatten_products(extract.open_envelope(ws["responses"])))


@query
def v2_uncovered_billing(ws):
    return quality.uncovered_billing(ws["billing"], ws["terms"], RESPONSES, [corpus.TRUE_UP])


@query
def v3_coverage(ws):
    return quality.coverage(ws["terms"])


@query
def v4_term_disagreements(ws):
    return quality.term_disagreements(ws["terms"], REGEX, RESPONSES)


@query
def v5_clause_comparison(ws):
    return quality.clause_comparison(ws["meta"], REGEX, RESPONSES)


@query
def v6_clause_listing(ws):
    return quality.clause_listing(ws["meta"], REGEX)


@query
def v7_count_tripwire(ws):
    planted = F.count("*")
    expected = (
        ws["answer_key"]
        .groupBy("leak_type")
        .agg(planted.alias("at_least"), planted.alias("at_most"))
        .withColumn("detected_by", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    )
    return quality.count_tripwire(ws["findings"], expected)


@query
def v8_unknown_types(ws):
    # A key that also holds a type of its own for account minimums trued up late.
    kind = F.when(F.col("product") == detect.ACCOUNT_MINIMUM, F.lit("late_true_up"))
    return quality.unknown_types(ws["answer_key"].withColumn("leak_type", F.coalesce(kind, "leak_type")))


@query
def v9_duplicate_lines(ws):
    return quality.duplicate_lines(ws["volume_billing"])


@query
def v10_duplicate_terms(ws):
    return quality.duplicate_terms(ws["terms"].unionByName(quality.arm_rows(ws["terms"], RESPONSES)))


@query
def v11_bad_clauses(ws):
    return quality.bad_clauses(ws["meta"])


@query
def v12_unreadable_responses(ws):
    return extract.unreadable_responses(ws["responses"])


# --- detection ---------------------------------------------------------------


@query
def d1_rate_leak(ws):
    return detect.rate_leaks(ws["billing"], ws["terms"])


@query
def d2_stale_discount(ws):
    return detect.stale_discounts(ws["billing"], ws["terms"], ws["meta"])


@query
def d3_account_grid(ws):
    return detect.account_grid(ws["billing"], ws["terms"])


@query
def d4_unbilled_cells(ws):
    return detect.unbilled_cells(ws["billing"], ws["terms"])


@query
def d5_usage_baseline(ws):
    return detect.usage_baseline(ws["billing"])


@query
def d6_missing_charge(ws):
    return detect.missing_charges(ws["billing"], ws["terms"])


@query
def d6_missing_charge_by_calendar(ws):
    return detect.missing_charges(ws["billing"], ws["terms"], corpus.MONTHS)


@query
def d6_missing_by_term(ws):
    """Months of each account's own agreement, up to the last month that any account was billed in."""
    span = ws["billing"].agg(F.min("month").alias("first"), F.max("month").alias("last")).first()
    months = detect.contract_months(extract.contract_periods(ws["contracts"]), span["first"], span["last"])
    return detect.missing_charges(ws["billing"], ws["terms"], months)


@query
def d7_minimum_shortfall(ws):
    return detect.minimum_shortfalls(ws["billing"], ws["meta"])


@query
def d8_evidence(ws):
    return ws["candidates"].select("extraction_method", *IDENTITY, "evidence")


@query
def d9_detect_leaks(ws):
    return detect.detect_leaks(ws["billing"], ws["terms"], ws["meta"])


@query
def volume_billing(ws):
    return volume.billing(ws.raw("lineitem"), ws.raw("orders"), ws.raw("part"), ws.raw("customer"))


@query
def volume_terms(ws):
    return volume.terms(ws["volume_billing"])


@query
def volume_rate_leak(ws):
    return detect.rate_leaks(ws["volume_billing"], ws["volume_terms"])


@query
def volume_stale_discount(ws):
    return detect.stale_discounts(ws["volume_billing"], ws["volume_terms"], ws["volume_meta"])


@query
def volume_usage_baseline(ws):
    return detect.usage_baseline(ws["volume_billing"])


@query
def volume_missing_charge(ws):
    return detect.missing_charges(ws["volume_billing"], ws["volume_terms"])


@query
def volume_minimum_shortfall(ws):
    return detect.minimum_shortfalls(ws["volume_billing"], ws["volume_meta"])


@query
def volume_detect_leaks(ws):
    return detect.detect_leaks(ws["volume_billing"], ws["volume_terms"], ws["volume_meta"])


@query
def volume_totals(ws):
    found = detect.detect_leaks(ws["volume_billing"], ws["volume_terms"], ws["volume_meta"])
    return findings.totals_by_type(findings.label_arms(found))


# --- findings ----------------------------------------------------------------


@query
def m1_arm_labels(ws):
    return findings.label_arms(
        ws["terms"].unionByName(quality.arm_rows(ws["terms"], REGEX).withColumn("extraction_method", F.lit("table_ocr")))
    ).select("customer_id", "product", "detected_by")


@query
def m2_rebuild_findings(ws):
    path = _fresh_path(ws, "findings")
    findings.write_findings(ws["previous"], path, ARMS)
    fresh = findings.build_findings(ws["candidates"], run_at=RUN_AT)
    return _plain(findings.write_findings(fresh, path, ARMS))


@query
def m10_concurrent_writers(ws):
    """While one writer makes the rows of an arm, another replaces the other arm."""
    path = _fresh_path(ws, "findings")
    findings.write_findings(ws["previous"], path, ARMS)

    def interrupted(at):
        findings.write_findings(ws["findings"], path, ARMS[1:])
        return ws["findings"]

    return _plain(findings.write_findings(interrupted, path, ARMS[:1], ws.spark))


@query
def m11_findings_without_arm(ws):
    """A table from before the arm column, then an arm written beside it."""
    path = _fresh_path(ws, "findings")
    old = ws["findings"].where(F.col("detected_by") == ARM)
    old.drop("detected_by", "draft_memo").write.parquet(path)
    return _plain(findings.write_findings(ws["findings"], path, ARMS[1:]))


@query
def m3_memo_carry_over(ws):
    return _plain(findings.build_findings(ws["candidates"], ws["previous"], RUN_AT))


@query
def m4_memo_survival(ws):
    return findings.memo_survival(ws["reviewed"])


@query
def m5_totals_by_type(ws):
    return findings.totals_by_type(ws["findings"])


@query
def m6_top_findings(ws):
    return _plain(findings.top_findings(ws["findings"], ARM))


@query
def m7_run_counts(ws):
    return findings.run_counts(ws["reviewed"], ws["reviewed"])


@query
def m8_duplicate_findings(ws):
    return findings.duplicate_findings(
        findings.label_arms(detect.rate_leaks(ws["volume_billing"], ws["volume_terms"]))
    )


@query
def m9_overlapping_leaks(ws):
    return findings.overlapping_leaks(ws["findings"])


# --- scoring -----------------------------------------------------------------


@query
def e1_detectors(ws):
    return evaluate.detectors(ws["findings"])


@query
def e2_found_leaks(ws):
    return evaluate.found_leaks(ws["findings"].unionByName(ws["reviewed"]))


@query
def e3_key_per_detector(ws):
    return evaluate.key_per_detector(ws["answer_key"], ws["findings"])


@query
def e4_verdicts(ws):
    return evaluate.verdicts(ws["findings"], ws["answer_key"])


@query
def e5_scorecard(ws):
    return evaluate.scorecard(ws["verdict"])


@query
def e6_scorecard_by_type(ws):
    return evaluate.scorecard_by_type(ws["verdict"])


@query
def e7_misses(ws):
    return evaluate.misses(ws["verdict"], ws["answer_key"])


@query
def e8_false_alarms(ws):
    return evaluate.false_alarms(ws["verdict"], ws["findings"])


@query
def e9_dollar_accuracy(ws):
    return evaluate.dollar_accuracy(ws["verdict"], ws["findings"], ws["answer_key"])


@query
def e10_confirmed_value(ws):
    return evaluate.confirmed_value(ws["verdict"], ws["answer_key"])


@query
def e11_confirmed_total(ws):
    return evaluate.confirmed_total(ws["verdict"], ws["answer_key"], ARM)


@query
def e12_arm_counts(ws):
    return evaluate.arm_counts(ws["verdict"], ARMS[1])


# --- memos -------------------------------------------------------------------


@query
def k1_undrafted(ws):
    return memos.undrafted(ws["reviewed"], ARM).drop("created_at", "draft_memo")


@query
def k2_guidance(ws):
    return ws["findings"].select("finding_id", memos.guidance(F.col("leak_type")).alias("guidance"))


@query
def k3_memo_requests_long(ws):
    return memos.memo_requests(ws["reviewed"], ARM, "long")


@query
def k4_memo_requests_short(ws):
    return memos.memo_requests(ws["reviewed"], ARM, "short")


@query
def k5_template_memos(ws):
    return memos.template_memos(ws["reviewed"], ARM)


@query
def k6_attach_memos(ws):
    answers = memos.template_memos(ws["findings"], ARM)
    return memos.attach_memos(ws["reviewed"], answers).select("detected_by", "finding_id", "draft_memo")


@query
def k7_memo_coverage(ws):
    return memos.memo_coverage(ws["reviewed"], ARM)


@query
def k8_preamble_breaches(ws):
    return memos.preamble_breaches(ws["drafted"], ARM)


@query
def k9_caveat_breaches(ws):
    return memos.caveat_breaches(ws["drafted"], ARM)


@query
def k10_style_breaches(ws):
    return memos.style_breaches(ws["drafted"], ARM)


@query
def k11_best_memos(ws):
    return memos.best_memos(ws["drafted"], ARM)


@query
def k12_reset_memos(ws):
    path = _fresh_path(ws, "findings")
    stored = findings.write_findings(ws["drafted"], path, ARMS)
    return _plain(findings.write_findings(memos.reset_memos(stored, ARM), path, [ARM]))


# --- reports -----------------------------------------------------------------


@query
def r1_arm_list(ws):
    return report.arm_list(ws["findings"])


@query
def r2_headline_score(ws):
    return report.headline_score(ws["verdict"], ARMS[1])


@query
def r3_headline_money(ws):
    return report.headline_money(ws["findings"], ws["answer_key"], ARM)


@query
def r4_findings_list(ws):
    return report.findings_list(ws["findings"], ARM)


@query
def r5_by_type(ws):
    return report.by_type(ws["findings"], ARM)


@query
def r6_top_customers(ws):
    return report.top_customers(ws["findings"], ARM)


@query
def r7_customer_ranking(ws):
    confirmed = evaluate.confirmed_leaks(ws["verdict"], ws["answer_key"])
    return report.customer_ranking(ws["findings"], confirmed, ARM)


@query
def r8_selection_total(ws):
    return report.selection_total(ws["findings"], ARM, [detect.RATE_LEAK, detect.MISSING_CHARGE])


@query
def r8_selection(ws):
    return _plain(report.selection(ws["findings"], ARM, [detect.STALE_DISCOUNT, detect.MINIMUM_LEAK]))


CUSTOMERS = ["Customer#000000001", "Customer#000000004", "Customer#000000010"]


@query
def r8_customers(ws):
    return _plain(report.selection(ws["findings"], ARM, customers=CUSTOMERS))


@query
def r8_facets(ws):
    return report.facets(ws["findings"], ARM, [detect.RATE_LEAK, detect.MISSING_CHARGE], CUSTOMERS)


@query
def r9_memo_list(ws):
    return report.memo_list(ws["drafted"], ARM)


@query
def r10_arm_table(ws):
    return report.arm_table(ws["verdict"])


@query
def r11_top_memos(ws):
    return report.top_memos(ws["drafted"], ARM)


@query
def r12_sweep_table(ws):
    return report.sweep_table(ws["sweep"])


@query
def r13_sweep_summary(ws):
    return report.sweep_summary(ws["sweep"])


# --- corpus and sweep --------------------------------------------------------


@query
def g1_true_terms(ws):
    return corpus.true_terms(corpus.accounts(ws.raw("customer")))


@query
def g2_contracts(ws):
    return corpus.contracts(corpus.accounts(ws.raw("customer")))


@query
def g3_billing(ws):
    return corpus.billing(corpus.account_months(corpus.accounts(ws.raw("customer"))))


@query
def g4_answer_key(ws):
    return corpus.answer_key(corpus.account_months(corpus.accounts(ws.raw("customer"))))


@query
def g5_true_up_months(ws):
    keys = ["customer_id", "month"]
    short = detect.minimum_shortfalls(ws["billing"], ws["meta"]).select(*keys).distinct()
    lines = ws["billing"].where(F.col("product") == corpus.TRUE_UP).select(*keys, "amount_billed")
    return lines.join(short.withColumn("hit", F.lit(True)), keys, "left").select(
        *keys, "amount_billed", F.col("hit").isNotNull().alias("flagged")
    )


@query
def g6_generation_summary(ws):
    return corpus.generation_summary(ws["answer_key"])


@query
def g7_evaluate_seeds(ws):
    return sweep.evaluate_seeds(ws["seed_contracts"], ws["seed_billing"], ws["seed_key"])


# --- callable runs -----------------------------------------------------------


def _stored_previous(ws: Workspace) -> str:
    path = _fresh_path(ws, "findings")
    findings.write_findings(ws["previous"], path, ARMS)
    return path


@query
def o1_reconcile(ws):
    return run.reconcile(ws["billing"], ws["terms"], ws["meta"], _stored_previous(ws), run_at=RUN_AT)


@query
def o4_reconcile_changes(ws):
    """A run before every fifth account got its present lines and every seventh its terms, then one that follows."""
    path = _fresh_path(ws, "findings")
    findings.write_findings(ws["previous"], path, ARMS)
    key = F.col("customer_id")
    rate = F.when(key % 5 == 0, F.col("unit_rate_billed") * 2).otherwise(F.col("unit_rate_billed"))
    earlier = ws["billing"].withColumn("unit_rate_billed", rate.cast(schemas.RATE))
    run.reconcile_changes(earlier, ws["terms"].where(key % 7 != 0), ws["meta"], path, run_at=RUN_AT)
    run.reconcile_changes(ws["billing"], ws["terms"], ws["meta"], path, run_at=RUN_AT)
    return _plain(findings.read_findings(ws.spark, path)).drop("draft_memo")


@query
def o2_draft(ws):
    path = _fresh_path(ws, "findings")
    findings.write_findings(ws["reviewed"], path, ARMS)
    return run.draft(ws.spark, path, ARM)


@query
def o3_run(ws):
    return run.run(
        ws["billing"],
        ws["terms"],
        ws["meta"],
        ws["answer_key"],
        _stored_previous(ws),
        ARM,
        run_at=RUN_AT,
    )
