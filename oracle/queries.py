"""The oracle of each registered query."""

from duecheck.operators import extract, memos
from oracle.ctes import GUIDANCE, MEMO, amount, quote, select

CAND = "customer_id, customer_name, month, product, extraction_method, leak_type, estimated_recovery::double AS estimated_recovery, evidence"
CHOSEN = "('Customer#000000001', 'Customer#000000004', 'Customer#000000010')"
FIND = "finding_id, customer_id, customer_name, month, product, leak_type, estimated_recovery::double AS estimated_recovery, evidence"
TERM = "customer_id, customer_name, product, contract_rate::double AS contract_rate, extraction_method"
META = """customer_id, customer_name, discount_pct::double AS discount_pct,
  discount_valid_through::varchar AS discount_valid_through, min_monthly_commit::double AS min_monthly_commit, extraction_method"""
BILL = """invoice_id, customer_id, customer_name, month, product, units::bigint AS units,
  unit_rate_billed::double AS unit_rate_billed, discount_pct_applied::double AS discount_pct_applied,
  amount_billed::double AS amount_billed"""
KEY = "customer_id, customer_name, month, product, leak_type, estimated_recovery::double AS estimated_recovery, detail"
ID = "detected_by, customer_id, month, product, leak_type"
SAME_LEAK = "USING (customer_id, month, product, leak_type)"


def share(top: str, bottom: str) -> str:
    return f"((2 * 10000 * ({top}) + ({bottom})) // nullif(2 * ({bottom}), 0)) / 10000.0::double"


TP, FP, FN = (f"count(*) FILTER (outcome = '{o}')" for o in ("TP", "FP", "FN"))
PRECISION = share(TP, f"{TP} + {FP}")
RECALL = share(TP, f"{TP} + {FN}")
F1 = share(f"2 * {TP}", f"2 * {TP} + {FP} + {FN}")
SHOWN = "customer_id, customer_name, month, product"
TOP = "row_number() OVER (PARTITION BY leak_type ORDER BY estimated_recovery DESC, customer_id, month, product, leak_type, evidence)"
FACTS = """chr(10) || 'Customer: ' || customer_name || chr(10) || 'Period: ' || month || chr(10) || 'Product: ' || product
  || chr(10) || 'Leak type: ' || leak_type || chr(10) || '{label}: $' || estimated_recovery || chr(10) || 'Evidence: ' || evidence"""
REQUEST_LONG = (
    f"{quote(memos._LONG_INTRO)} || {FACTS.format(label='Amount')} || chr(10) || chr(10) "
    f"|| 'Kind: ' || {GUIDANCE} || chr(10) || chr(10) || {quote(memos._LONG_RULES)}"
)
REQUEST_SHORT = (
    f"{quote(memos._SHORT_INTRO)} || CASE WHEN leak_type = 'missing_charge' THEN {quote(memos._SHORT_CAVEAT)} ELSE '' END "
    f"|| chr(10) || {FACTS.format(label='Amount')}"
)

_SQL = {
    # Sources and sinks: what was stored is what was written.
    "s1_csv_source": "SELECT customer_id, customer_name, contract_text FROM contracts",
    "s2_load_billing": f"SELECT {BILL} FROM billing",
    "s3_load_contracts": "SELECT customer_id, customer_name, md5(contract_text) AS text_md5 FROM contracts",
    "s4_load_answer_key": f"SELECT {KEY} FROM answer_key",
    "s5_load_audit": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) AS expected, true AS as_expected FROM {t}"
        for t in ("billing", "contracts", "answer_key")
    ),
    "s12_load_audit_from_log": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) AS expected, true AS as_expected FROM {t}"
        for t in ("billing", "contracts", "answer_key")
    ),
    "s6_document_profile": """SELECT count(*) AS n_contracts, avg(length(contract_text)) AS avg_chars,
  min(length(contract_text))::bigint AS min_chars FROM contracts""",
    "s7_document_sample": """SELECT customer_id, customer_name, left(contract_text, 120) AS contract_head
FROM contracts ORDER BY customer_id LIMIT 3""",
    "s8_replace_arm": f"""SELECT {FIND}, NULL::varchar AS draft_memo, detected_by FROM findings
WHERE detected_by <> 'sql_baseline' OR leak_type = 'rate_leak'""",
    "s9_memo_export": """SELECT customer_name, month, product, leak_type, estimated_recovery::double AS estimated_recovery,
  evidence, draft_memo FROM drafted WHERE detected_by = 'sql_baseline' AND draft_memo IS NOT NULL""",
    "s10_csv_writers": f"SELECT {KEY} FROM answer_key",
    "s11_sweep_sink": "SELECT seed, leaks_planted, tp, fp, fn FROM sweep",
    # Extraction
    "x1_split_lines": "SELECT customer_id, customer_name, line_no, line FROM doc_lines",
    "x2_priced_lines": """SELECT customer_id, customer_name, line_no, line FROM doc_lines
WHERE line LIKE '- **%billed at%'""",
    "x3_product_capture": """SELECT customer_id, line_no, nullif(regexp_extract(line, '\\*\\*(.+?)\\*\\*', 1), '') AS product
FROM doc_lines""",
    "x4_rate_capture": f"""SELECT customer_id, line_no,
  {amount('line', 'billed at [$]', 'decimal(18,6)')}::double AS contract_rate FROM doc_lines""",
    "x5_discount_clause": "SELECT customer_id, discount_pct::double AS discount_pct FROM rx_meta",
    "x6_expiry_clause": "SELECT customer_id, discount_valid_through::varchar AS discount_valid_through FROM rx_meta",
    "x7_minimum_clause": "SELECT customer_id, min_monthly_commit::double AS min_monthly_commit FROM rx_meta",
    "x8_extract_terms_regex": f"SELECT {TERM} FROM rx_terms",
    "x9_extract_meta_regex": f"SELECT {META} FROM rx_meta",
    "x10_extraction_requests": f"""SELECT customer_id, customer_name, {quote(extract.EXTRACTION_INSTRUCTION)} || chr(10) || chr(10)
  || '--- CONTRACT ---' || chr(10) || contract_text AS prompt, {quote(extract.RESPONSE_JSON_SCHEMA)} AS response_schema
FROM contracts""",
    "x11_land_responses": "SELECT customer_id, customer_name, response FROM responses",
    "x12_open_envelope": """SELECT a.customer_id, coalesce(n, 0) AS n_products, discount::double AS discount_pct,
  stated_end AS discount_valid_through, minimum::double AS min_monthly_commit
FROM answers a LEFT JOIN (SELECT customer_id, count(*) AS n FROM heard GROUP BY 1) p ON p.customer_id = a.customer_id""",
    "x13_flatten_products": """SELECT customer_id, customer_name, product, contract_rate::double AS contract_rate FROM heard""",
    "x14_usable_terms": f"SELECT {TERM} FROM js_terms",
    "x15_meta_from_responses": f"SELECT {META} FROM js_meta",
    # Checks
    "v1_bad_terms": """SELECT customer_id, customer_name, product, contract_rate::double AS contract_rate FROM heard
WHERE product IS NULL OR contract_rate IS NULL OR contract_rate <= 0""",
    "v2_uncovered_billing": """SELECT customer_id, customer_name, product FROM billing
WHERE product <> '(true-up)' AND (customer_id, product) NOT IN (SELECT (customer_id, product) FROM js_terms) GROUP BY ALL""",
    "v3_coverage": """SELECT extraction_method, count(DISTINCT customer_id) AS customers, count(*) AS term_rows
FROM terms GROUP BY 1""",
    "v4_term_disagreements": """SELECT customer_id, product, max(a)::double AS rate_a, max(b)::double AS rate_b,
  CASE WHEN count(a) = 0 THEN 'json_terms only' WHEN count(b) = 0 THEN 'regex_baseline only' ELSE 'rate differs' END
    AS disagreement
FROM (SELECT customer_id, product, contract_rate AS a, NULL AS b FROM rx_terms
  UNION ALL SELECT customer_id, product, NULL, contract_rate FROM js_terms)
GROUP BY ALL HAVING count(*) = 1 OR max(a) - max(b) NOT BETWEEN -0.0001 AND 0.0001""",
    "v5_clause_comparison": """SELECT customer_id, a.discount_pct::double AS disc_a, b.discount_pct::double AS disc_b,
  a.discount_valid_through::varchar AS expiry_a, b.discount_valid_through::varchar AS expiry_b,
  a.min_monthly_commit::double AS min_a, b.min_monthly_commit::double AS min_b
FROM rx_meta a JOIN js_meta b USING (customer_id)""",
    "v6_clause_listing": f"SELECT {META} FROM rx_meta",
    "v7_count_tripwire": """SELECT coalesce(f.detected_by, k.detected_by) AS detected_by,
  coalesce(f.leak_type, k.leak_type) AS leak_type, coalesce(n, 0) AS found, coalesce(total, 0)::double AS total_recovery,
  coalesce(coalesce(n, 0) = planted, false) AS in_range
FROM (SELECT detected_by, leak_type, count(*) AS n, sum(estimated_recovery) AS total FROM findings GROUP BY ALL) f
FULL OUTER JOIN (SELECT d.detected_by, leak_type, count(*) AS planted FROM answer_key
  CROSS JOIN (VALUES ('sql_baseline'), ('json_terms')) d(detected_by) GROUP BY ALL) k
ON k.detected_by = f.detected_by AND k.leak_type = f.leak_type""",
    "v8_unknown_types": """SELECT DISTINCT 'late_true_up' AS leak_type FROM answer_key WHERE product = '(account minimum)'""",
    "v9_duplicate_lines": """SELECT customer_id, month, product, count(*) AS n_lines FROM vol_billing
GROUP BY ALL HAVING count(*) > 1""",
    "v10_duplicate_terms": """SELECT extraction_method, customer_id, product, 2 * count(*) AS n_terms FROM js_terms GROUP BY ALL""",
    "v11_bad_clauses": f"SELECT {META} FROM meta WHERE discount_pct IS NULL OR min_monthly_commit IS NULL",
    "v12_unreadable_responses": """SELECT customer_id, customer_name FROM responses
WHERE NOT json_valid(response) OR json_extract(response, '$.structured_output[0].raw_message') IS NULL""",
    # Detection
    "d1_rate_leak": f"SELECT {CAND} FROM rate_leak",
    "d2_stale_discount": f"SELECT {CAND} FROM stale_discount",
    "d3_account_grid": "SELECT customer_id, month, product, extraction_method FROM grid",
    "d4_unbilled_cells": """SELECT customer_id, month, product, extraction_method FROM grid
WHERE (customer_id, month, product) NOT IN (SELECT (customer_id, month, product) FROM billing)""",
    "d5_usage_baseline": """SELECT customer_id, product, avg(units) AS avg_units, count(*) AS n_months FROM billing GROUP BY ALL""",
    "d6_missing_charge": f"SELECT {CAND} FROM missing_charge",
    "d6_missing_charge_by_calendar": f"SELECT {CAND} FROM missing_by_calendar",
    "d6_missing_by_term": f"SELECT {CAND} FROM missing_by_calendar",
    "d7_minimum_shortfall": f"SELECT {CAND} FROM minimum_leak",
    "d8_evidence": "SELECT extraction_method, customer_id, month, product, leak_type, evidence FROM candidates",
    "d9_detect_leaks": f"SELECT {CAND} FROM candidates",
    "volume_billing": f"SELECT {BILL} FROM vol_billing",
    "volume_terms": f"SELECT {TERM} FROM vol_terms",
    "volume_rate_leak": f"SELECT {CAND} FROM vol_rate_leak",
    "volume_stale_discount": f"SELECT {CAND} FROM vol_stale_discount",
    "volume_usage_baseline": """SELECT customer_id, product, avg(units) AS avg_units, count(*) AS n_months
FROM vol_billing GROUP BY ALL""",
    "volume_missing_charge": f"SELECT {CAND} FROM vol_missing_charge",
    "volume_minimum_shortfall": f"SELECT {CAND} FROM vol_minimum_leak",
    "volume_detect_leaks": f"SELECT {CAND} FROM vol_candidates",
    "volume_totals": """SELECT 'sql_baseline' AS detected_by, leak_type, count(*) AS found,
  sum(estimated_recovery)::double AS total_recovery FROM vol_candidates GROUP BY ALL""",
    # Findings
    "m1_arm_labels": """SELECT customer_id, product, CASE extraction_method WHEN 'regex_baseline' THEN 'sql_baseline'
  ELSE extraction_method END AS detected_by FROM terms
UNION ALL SELECT customer_id, product, 'sql_table_ocr' FROM rx_terms""",
    "m2_rebuild_findings": f"SELECT {FIND}, NULL::varchar AS draft_memo, detected_by FROM findings",
    "m10_concurrent_writers": f"SELECT {FIND}, NULL::varchar AS draft_memo, detected_by FROM findings",
    "m11_findings_without_arm": f"""SELECT {FIND}, NULL::varchar AS draft_memo,
  CASE WHEN detected_by <> 'sql_baseline' THEN detected_by END AS detected_by FROM findings""",
    "m3_memo_carry_over": f"SELECT {FIND}, draft_memo, detected_by FROM reviewed",
    "m4_memo_survival": """SELECT detected_by, count(*) AS findings, count(draft_memo) AS memos_preserved
FROM reviewed GROUP BY 1""",
    "m5_totals_by_type": """SELECT detected_by, leak_type, count(*) AS found, sum(estimated_recovery)::double AS total_recovery
FROM findings GROUP BY ALL""",
    "m6_top_findings": f"""SELECT {FIND.replace(', evidence', ', left(evidence, 90) AS evidence')}, NULL::varchar AS draft_memo, detected_by
FROM findings WHERE detected_by = 'sql_baseline' QUALIFY {TOP} <= 2""",
    "m7_run_counts": "SELECT count(*) AS findings, count(draft_memo) AS memos_preserved FROM reviewed",
    "m8_duplicate_findings": """SELECT 'sql_baseline' AS detected_by, customer_id, month, product, leak_type, count(*) AS n
FROM vol_rate_leak GROUP BY ALL HAVING count(*) > 1""",
    "m9_overlapping_leaks": """SELECT detected_by, customer_id, month,
  sum(estimated_recovery) FILTER (leak_type = 'missing_charge')::double AS missing_charge,
  sum(estimated_recovery) FILTER (leak_type = 'minimum_commitment_leak')::double AS minimum_shortfall
FROM findings GROUP BY ALL HAVING missing_charge IS NOT NULL AND minimum_shortfall IS NOT NULL""",
    # Scoring
    "e1_detectors": "SELECT DISTINCT detected_by FROM findings",
    "e2_found_leaks": f"SELECT DISTINCT {ID} FROM findings",
    "e3_key_per_detector": """SELECT d.detected_by, customer_id, month, product, leak_type FROM answer_key
CROSS JOIN (SELECT DISTINCT detected_by FROM findings) d""",
    "e4_verdicts": f"SELECT {ID}, outcome FROM verdict",
    "e5_scorecard": f"""SELECT detected_by, {TP} AS true_positives, {FP} AS false_positives, {FN} AS false_negatives,
  {TP} + {FP} AS total_reported, {TP} + {FN} AS total_actual, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1
FROM verdict GROUP BY 1""",
    "e6_scorecard_by_type": f"""SELECT detected_by, leak_type, {TP} AS tp, {FP} AS fp, {FN} AS fn,
  {PRECISION} AS precision, {RECALL} AS recall FROM verdict GROUP BY 1, 2""",
    # Stated from findings and key alone: what an arm that found anything did not find.
    "e7_misses": """SELECT arm.detected_by, k.leak_type, k.customer_name, k.month, k.product,
  k.estimated_recovery::double AS missed_dollars, k.detail AS what_was_planted
FROM answer_key k CROSS JOIN (SELECT DISTINCT detected_by FROM findings) arm
LEFT JOIN (SELECT DISTINCT detected_by, customer_id, month, product, leak_type FROM findings) f
  ON f.detected_by = arm.detected_by AND f.customer_id = k.customer_id AND f.month = k.month
    AND f.product = k.product AND f.leak_type = k.leak_type
WHERE f.detected_by IS NULL""",
    "e8_false_alarms": """SELECT detected_by, leak_type, customer_name, month, product,
  estimated_recovery::double AS claimed_dollars, left(evidence, 120) AS claimed_evidence
FROM findings WHERE (customer_id, month, product, leak_type) NOT IN
  (SELECT (customer_id, month, product, leak_type) FROM answer_key)""",
    "e9_dollar_accuracy": f"""SELECT detected_by, leak_type, count(*) AS leaks_scored, sum(claimed)::double AS detected_total,
  sum(actual)::double AS actual_total, sum(claimed - actual)::double AS dollar_error,
  ((2 * sum(err) + 100000 * count(err)) // (200000 * count(err)))::bigint / 10.0::double AS mean_abs_pct_error
FROM (SELECT detected_by, leak_type, f.estimated_recovery AS claimed, k.estimated_recovery AS actual,
    (2 * abs((claimed - actual) * 100)::bigint * 100000000 + (actual * 100)::bigint) // nullif(2 * (actual * 100)::bigint, 0) AS err
  FROM findings f JOIN answer_key k {SAME_LEAK})
GROUP BY 1, 2""",
    "e10_confirmed_value": f"""SELECT detected_by, leak_type, grouping(detected_by, leak_type)::bigint AS level,
  count(*) AS confirmed_leaks, sum(estimated_recovery)::double AS recoverable_dollars
FROM answer_key JOIN verdict {SAME_LEAK} WHERE outcome = 'TP' GROUP BY ROLLUP (detected_by, leak_type)""",
    "e11_confirmed_total": f"""SELECT coalesce(sum(estimated_recovery), 0)::double AS recoverable_dollars
FROM answer_key JOIN verdict {SAME_LEAK} WHERE outcome = 'TP' AND detected_by = 'sql_baseline'""",
    "e12_arm_counts": f"""SELECT {TP} AS tp, {FP} AS fp, {FN} AS fn, count(*) AS total FROM verdict
WHERE detected_by = 'json_terms'""",
    # Memos
    "k1_undrafted": f"""SELECT {FIND}, detected_by FROM reviewed
WHERE detected_by = 'sql_baseline' AND draft_memo IS NULL""",
    "k2_guidance": f"SELECT finding_id, {GUIDANCE} AS guidance FROM findings",
    "k3_memo_requests_long": f"""SELECT finding_id, {REQUEST_LONG} AS request FROM reviewed
WHERE detected_by = 'sql_baseline' AND draft_memo IS NULL""",
    "k4_memo_requests_short": f"""SELECT finding_id, {REQUEST_SHORT} AS request FROM reviewed
WHERE detected_by = 'sql_baseline' AND draft_memo IS NULL""",
    "k5_template_memos": f"""SELECT finding_id, {MEMO} AS memo FROM reviewed
WHERE detected_by = 'sql_baseline' AND draft_memo IS NULL""",
    "k6_attach_memos": "SELECT detected_by, finding_id, draft_memo FROM drafted",
    "k7_memo_coverage": """SELECT count(*) AS findings, count(draft_memo) AS drafted, count(*) - count(draft_memo) AS still_empty,
  ((2 * sum(length(draft_memo)) + count(draft_memo)) // (2 * count(draft_memo)))::bigint AS avg_memo_chars
FROM reviewed WHERE detected_by = 'sql_baseline'""",
    "k8_preamble_breaches": f"""SELECT {SHOWN}, left(draft_memo, 80) AS starts_with FROM drafted
WHERE detected_by = 'sql_baseline' AND lower(left(draft_memo, 5)) <> 'memo:'""",
    "k9_caveat_breaches": f"""SELECT {SHOWN}, estimated_recovery::double AS estimated_recovery FROM drafted
WHERE detected_by = 'sql_baseline' AND leak_type = 'missing_charge'
  AND NOT regexp_matches(draft_memo, '(?i)estimat|confirm|verify|unknown')""",
    "k10_style_breaches": f"""SELECT * FROM (SELECT {SHOWN},
  len(regexp_split_to_array(trim(draft_memo), '\\s+')) >= 130 AS too_long,
  NOT starts_with(string_split(rtrim(draft_memo), chr(10))[-1], 'Recommended action:') AS no_closing,
  regexp_matches(draft_memo, '(?i)\\b(apolog\\w*|sorry|regret)\\b') AS apologises
FROM drafted WHERE detected_by = 'sql_baseline' AND draft_memo IS NOT NULL) c WHERE too_long OR no_closing OR apologises""",
    "k11_best_memos": f"""SELECT leak_type, customer_name, month, product, estimated_recovery::double AS estimated_recovery, draft_memo
FROM drafted WHERE detected_by = 'sql_baseline' QUALIFY {TOP} = 1""",
    "k12_reset_memos": f"""SELECT {FIND}, CASE WHEN detected_by <> 'sql_baseline' THEN draft_memo END AS draft_memo, detected_by
FROM drafted""",
    # Reports
    "r1_arm_list": "SELECT DISTINCT detected_by FROM findings",
    "r2_headline_score": f"""SELECT {TP} AS tp, {FP} AS fp, {FN} AS fn, {PRECISION} AS precision, {RECALL} AS recall
FROM verdict WHERE detected_by = 'json_terms'""",
    "r3_headline_money": f"""SELECT sum(f.estimated_recovery)::double AS detected_total,
  sum(k.estimated_recovery)::double AS confirmed_total, count(DISTINCT customer_id) AS customers
FROM findings f JOIN answer_key k {SAME_LEAK} WHERE detected_by = 'sql_baseline'""",
    "r4_findings_list": """SELECT customer_name, month, product, leak_type, estimated_recovery::double AS estimated_recovery, evidence
FROM findings WHERE detected_by = 'sql_baseline' ORDER BY estimated_recovery DESC""",
    "r5_by_type": """SELECT leak_type, sum(estimated_recovery)::double AS dollars, count(*) AS leaks FROM findings
WHERE detected_by = 'sql_baseline' GROUP BY 1 ORDER BY 2 DESC""",
    "r6_top_customers": """SELECT customer_name, sum(estimated_recovery)::double AS dollars FROM findings
WHERE detected_by = 'sql_baseline' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""",
    "r7_customer_ranking": f"""SELECT customer_id, estimated::double AS estimated, confirmed::double AS confirmed,
  rank() OVER (ORDER BY estimated DESC) AS estimated_rank, rank() OVER (ORDER BY confirmed DESC) AS confirmed_rank
FROM (SELECT coalesce(a.customer_id, c.customer_id) AS customer_id, coalesce(estimated, 0) AS estimated,
    coalesce(confirmed, 0) AS confirmed
  FROM (SELECT customer_id, sum(estimated_recovery) AS estimated FROM findings
        WHERE detected_by = 'sql_baseline' GROUP BY 1) a
  FULL OUTER JOIN (SELECT customer_id, sum(estimated_recovery) AS confirmed FROM answer_key JOIN verdict {SAME_LEAK}
        WHERE outcome = 'TP' AND detected_by = 'sql_baseline' GROUP BY 1) c ON c.customer_id = a.customer_id) t""",
    "r8_selection_total": """SELECT count(*) FILTER (leak_type IN ('rate_leak', 'missing_charge')) AS shown, count(*) AS findings,
  coalesce(sum(estimated_recovery) FILTER (leak_type IN ('rate_leak', 'missing_charge')), 0)::double AS dollars
FROM findings WHERE detected_by = 'sql_baseline'""",
    "r8_selection": f"""SELECT {FIND}, NULL::varchar AS draft_memo, detected_by FROM findings
WHERE detected_by = 'sql_baseline' AND leak_type IN ('stale_discount', 'minimum_commitment_leak')""",
    "r8_customers": f"""SELECT {FIND}, NULL::varchar AS draft_memo, detected_by FROM findings
WHERE detected_by = 'sql_baseline' AND customer_name IN {CHOSEN}""",
    "r8_facets": f"""SELECT * FROM (WITH f AS (SELECT *, leak_type IN ('rate_leak', 'missing_charge') AS t, customer_name IN {CHOSEN} AS c
  FROM findings WHERE detected_by = 'sql_baseline')
SELECT 'leak_type' AS facet, leak_type AS option, count(*) FILTER (c) AS findings,
  coalesce(sum(estimated_recovery) FILTER (c), 0)::double AS dollars, bool_or(t) AS chosen FROM f GROUP BY leak_type
UNION ALL SELECT 'customer_name', customer_name, count(*) FILTER (t), coalesce(sum(estimated_recovery) FILTER (t), 0)::double,
  bool_or(c) FROM f GROUP BY customer_name
UNION ALL SELECT 'total', NULL, count(*) FILTER (t AND c), coalesce(sum(estimated_recovery) FILTER (t AND c), 0)::double, true FROM f)""",
    "r9_memo_list": """SELECT customer_name || ' · ' || month || ' · ' || product || ' · $'
    || format('{:,.2f}', estimated_recovery::double) AS label,
  customer_name, month, product, leak_type, estimated_recovery::double AS estimated_recovery, evidence, draft_memo
FROM drafted WHERE detected_by = 'sql_baseline' AND draft_memo IS NOT NULL""",
    "r10_arm_table": f"""SELECT detected_by, {TP} AS found, {FN} AS missed, {FP} AS false_alarms, {PRECISION} AS precision,
  {RECALL} AS recall FROM verdict GROUP BY 1""",
    "r11_top_memos": """SELECT customer_name, month, product, leak_type, estimated_recovery::double AS estimated_recovery, draft_memo
FROM (SELECT * FROM drafted WHERE detected_by = 'sql_baseline'
  ORDER BY drafted.estimated_recovery DESC, customer_id, month, product, leak_type, evidence LIMIT 5) t""",
    "r12_sweep_table": f"""SELECT seed, leaks_planted, fp AS false_alarms, fn AS missed, {share('tp', 'tp + fp')} AS precision,
  {share('tp', 'tp + fn')} AS recall FROM sweep""",
    "r13_sweep_summary": """SELECT count(*) FILTER (fp + fn = 0) AS clean, count(*) AS datasets,
  min(leaks_planted) AS min_planted, max(leaks_planted) AS max_planted FROM sweep""",
    # Corpus and sweep
    "g1_true_terms": """SELECT customer_id, customer_name, product,
  (rate_e4::decimal(18,0) * 0.0001)::decimal(18,4)::double AS contract_rate FROM truth""",
    "g2_contracts": "SELECT customer_id, customer_name, contract_text FROM contracts",
    "g3_billing": f"SELECT {BILL} FROM billing",
    "g4_answer_key": f"SELECT {KEY} FROM answer_key",
    "g5_true_up_months": """SELECT b.customer_id, b.month, b.amount_billed::double AS amount_billed,
  EXISTS (SELECT 1 FROM minimum_leak m WHERE m.customer_id = b.customer_id AND m.month = b.month) AS flagged
FROM billing b WHERE b.product = '(true-up)'""",
    "g6_generation_summary": """SELECT leak_type, count(*) AS planted, sum(estimated_recovery)::double AS dollars
FROM answer_key GROUP BY ROLLUP (leak_type)""",
    "g7_evaluate_seeds": "SELECT seed, leaks_planted, tp, fp, fn FROM sweep",
    # Callable runs
    "o1_reconcile": """SELECT 'reconcile: ' || count(*) || ' findings over all arms, ' || count(draft_memo)
  || ' memo(s) kept' AS report FROM reviewed""",
    "o4_reconcile_changes": f"SELECT {FIND}, detected_by FROM findings",
    "o2_draft": """SELECT 'draft: ' || count(*) FILTER (draft_memo IS NULL) || ' memo(s) written for sql_baseline, 0 still empty'
  AS report FROM reviewed WHERE detected_by = 'sql_baseline'""",
    "o3_run": f"""SELECT r.part || ' | ' || d.part || ' | tp=' || s.tp || ' fp=' || s.fp || ' fn=' || s.fn
  || ' usd=' || c.dollars AS report
FROM (SELECT 'reconcile: ' || count(*) || ' findings over all arms, ' || count(draft_memo) || ' memo(s) kept' AS part
      FROM reviewed) r,
  (SELECT 'draft: ' || count(*) FILTER (draft_memo IS NULL) || ' memo(s) written for sql_baseline, 0 still empty' AS part
   FROM reviewed WHERE detected_by = 'sql_baseline') d,
  (SELECT {TP} AS tp, {FP} AS fp, {FN} AS fn FROM verdict WHERE detected_by = 'sql_baseline') s,
  (SELECT coalesce(sum(estimated_recovery), 0)::decimal(18,2) AS dollars FROM answer_key JOIN verdict {SAME_LEAK}
   WHERE outcome = 'TP' AND detected_by = 'sql_baseline') c""",
}


def oracle_sql() -> dict[str, str]:
    return {name: select(sql) for name, sql in _SQL.items()}
