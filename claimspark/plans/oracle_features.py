"""The SQL twins of the feature, join, training and monitoring queries: brute force where the library uses a pattern."""

from __future__ import annotations

from claimspark.functions.scalars import PRIOR_AUTH
from claimspark.operators.features import NUMERIC
from claimspark.plans.oracle import LABEL, with_claims

ERA = "era AS (SELECT c.claim_id, c.payer_name, CAST(l_shipdate AS DATE) AS payment_date, CASE WHEN l_returnflag = 'R' THEN 'denied' ELSE 'paid' END AS status FROM lineitem JOIN claims c ON c.claim_id = 'CLM-' || CAST(l_orderkey AS STRING))"
ENC = "enc AS (SELECT o_custkey AS acc, o_orderkey AS encounter_id, CAST(o_orderdate AS DATE) AS encounter_date, o_orderpriority AS admitting_department FROM orders)"
LINKED = "linked AS (SELECT c.claim_id, c.patient_account_number, c.submission_date, (SELECT arg_min(e.encounter_id, (-(e.encounter_date - DATE '1970-01-01')) * 1000000000 + e.encounter_id) FROM enc e WHERE e.acc = c.patient_account_number AND e.encounter_date < c.submission_date) AS encounter_id FROM claims c)"
CONTRACTS = "k AS (SELECT * FROM (VALUES ('AUTOMOBILE', DATE '1992-01-01', DATE '1996-12-31', TRUE), ('AUTOMOBILE', DATE '1995-06-01', NULL, FALSE), ('BUILDING', DATE '1994-01-01', NULL, TRUE), ('FURNITURE', DATE '1992-01-01', DATE '1993-12-31', TRUE), ('FURNITURE', DATE '1993-06-01', DATE '1995-12-31', TRUE)) t(payer_name, a, b, stop_loss))"
PREFIXES = "x AS (SELECT * FROM (VALUES ('BRAND#1', 1), ('BRAND#12', 2), ('BRAND#2', 1), ('BRAND#34', 3), ('BRAND#5', 6)) t(prefix, weight))"


def flags(column: str, names: dict[str, str]) -> str:
    return ", ".join(f"CAST(lower(trim(coalesce({column}, ''))) = '{k}' AS INTEGER) AS {n}" for k, n in names.items())


CLAIM_LEVEL = (
    "SELECT claim_id, CAST(coalesce(dayofyear(submission_date), 0) AS INTEGER) AS claim_submission_date_doy, CAST(coalesce(month(submission_date), 0) AS INTEGER) AS claim_submission_date_month, "
    "CAST(coalesce(year(submission_date) - year(date_of_birth) - CASE WHEN month(submission_date) * 100 + day(submission_date) < month(date_of_birth) * 100 + day(date_of_birth) THEN 1 ELSE 0 END, -1) AS INTEGER) AS patient_age, "
    "CASE upper(trim(coalesce(gender, ''))) WHEN 'M' THEN 1 WHEN 'F' THEN 0 ELSE -1 END AS gender, "
    + ", ".join([
        flags("insurance_type", {"medicare": "ins_type_medicare", "medicaid": "ins_type_medicaid", "commercial": "ins_type_commercial", "tricare": "ins_type_tricare", "champva": "ins_type_champva", "other": "ins_type_other"}),
        flags("claim_type", {"professional": "claim_type_professional", "institutional": "claim_type_institutional"}),
        flags("admission_type", {"emergency": "adm_type_emergency", "elective": "adm_type_elective", "urgent": "adm_type_urgent", "trauma": "adm_type_trauma"}),
        flags("admission_source", {"physician referral": "adm_src_physician_referral", "transfer from hospital": "adm_src_transfer_hospital", "transfer from snf": "adm_src_transfer_snf", "emergency room": "adm_src_er", "court/law enforcement": "adm_src_court_law", "not available": "adm_src_not_available"}),
    ])
    + " FROM claims"
)
# Trailing windows by a range join, and the population by day.
DAYS = "days AS (SELECT submission_date AS d, CAST(COUNT(*) FILTER (adjudication_outcome IN ('denied','paid')) AS BIGINT) AS k, CAST(COUNT(*) FILTER (adjudication_outcome = 'denied') AS BIGINT) AS x FROM claims GROUP BY 1)"
POP = "pop AS (SELECT a.d, CAST(SUM(b.x) AS DOUBLE) / NULLIF(SUM(b.k), 0) AS rate FROM days a JOIN days b ON b.d BETWEEN a.d - 90 AND a.d GROUP BY 1)"


def trailing(name: str, keys: list[str], source: str = "claims") -> str:
    """(claim_id, k, x, v): known, denied and all claims of the key in the 90 days up to the claim; counted by key and day first."""
    cols = ", ".join(keys)
    on = " AND ".join(f"h.{c} IS NOT DISTINCT FROM c.{c}" for c in keys)
    return (
        f"{name}_d AS (SELECT {cols}, submission_date AS d, COUNT(*) FILTER (adjudication_outcome IN ('denied','paid')) AS k, COUNT(*) FILTER (adjudication_outcome = 'denied') AS x, COUNT(*) AS v FROM {source} GROUP BY ALL), "
        f"{name} AS (SELECT c.claim_id, CAST(SUM(h.k) AS BIGINT) AS k, CAST(SUM(h.x) AS BIGINT) AS x, CAST(SUM(h.v) AS BIGINT) AS v FROM {source} c JOIN {name}_d h ON {on} AND h.d BETWEEN c.submission_date - 90 AND c.submission_date GROUP BY 1)"
    )


TYPED = "typed AS (SELECT claim_id, payer_name, submission_date, lower(adjudication_outcome) AS adjudication_outcome, coalesce(lower(claim_type), '') AS type FROM claims)"
PROVIDER = (
    "SELECT c.claim_id, CASE WHEN p.k >= 30 THEN CAST(p.x AS DOUBLE) / p.k ELSE coalesce(pop.rate, 0.0) END AS provider_historical_denial_rate, "
    "CASE WHEN p.k > 30 THEN CAST(p.x - CASE WHEN adjudication_outcome = 'denied' THEN 1 ELSE 0 END AS DOUBLE) / (p.k - CASE WHEN adjudication_outcome IN ('denied','paid') THEN 1 ELSE 0 END) ELSE coalesce(pop.rate, 0.0) END AS billing_provider_id_encoded, "
    "p.v AS provider_claim_volume FROM claims c JOIN p USING (claim_id) LEFT JOIN pop ON pop.d = c.submission_date"
)
PAYER = (
    "SELECT c.claim_id, CASE WHEN p.k >= 50 THEN CAST(p.x AS DOUBLE) / p.k ELSE coalesce(pop.rate, 0.5) END AS payer_historical_denial_rate, CASE WHEN q.k >= 50 THEN CAST(q.x AS DOUBLE) / q.k ELSE coalesce(pop.rate, 0.5) END AS payer_historical_denial_rate_by_type, "
    "CAST(coalesce(c.submission_date - (SELECT max(e.payment_date) FROM paid e WHERE e.payer_name = c.payer_name AND e.payment_date <= c.submission_date), (SELECT CASE WHEN count(*) > 0 THEN 0 ELSE -1 END FROM paid e WHERE e.payer_name = c.payer_name)) AS INTEGER) AS days_since_last_payment, "
    "CAST(EXISTS (SELECT 1 FROM k WHERE k.payer_name = c.payer_name AND k.stop_loss AND k.a <= c.submission_date AND (k.b IS NULL OR c.submission_date <= k.b)) AS INTEGER) AS payer_contract_stop_loss "
    "FROM claims c JOIN p USING (claim_id) JOIN q USING (claim_id) LEFT JOIN pop ON pop.d = c.submission_date"
)
PAID = "paid AS (SELECT DISTINCT payer_name, payment_date FROM era WHERE status = 'paid')"
LINEAR = "greatest(least(0 + coalesce(CAST(comorbidity_risk_score AS DOUBLE), 0) * CAST(0.05 AS DOUBLE) + coalesce(CAST(mentions_lack_of_pre_auth AS DOUBLE), 0) * CAST(0.3 AS DOUBLE) + coalesce(documents_medical_necessity, 0) * CAST(0.4 AS DOUBLE), 1), 0)"
LABELLED = "lab AS (SELECT claim_id, submission_date, CASE adjudication_outcome WHEN 'denied' THEN 1 ELSE 0 END AS label, predicted_denial_score AS score FROM claims WHERE adjudication_outcome IN ('denied','paid'))"
CUM = "cum AS (SELECT submission_date AS d, SUM(COUNT(*)) OVER (ORDER BY submission_date) AS c, SUM(COUNT(*)) OVER () AS n FROM lab GROUP BY 1)"
SPLIT = "s AS (SELECT claim_id, submission_date, label, CASE WHEN submission_date < (SELECT min(d) FROM cum WHERE c > n - ceil(n * 0.2)) THEN 'train' ELSE 'test' END AS split FROM lab)"
TIER = "CASE WHEN {0} < 0.80 THEN 'urgent' WHEN {0} < 0.85 THEN 'degradation' ELSE 'none' END"
KNOWN = "adjudication_outcome IN ('denied','paid')"

SQL: dict[str, str] = {
    "claim_level_features": with_claims([], CLAIM_LEVEL),
    "provider_features": with_claims([DAYS, POP, trailing("p", ["provider_npi"])], PROVIDER),
    "payer_features": with_claims([DAYS, POP, TYPED, trailing("p", ["payer_name"], "typed"), trailing("q", ["payer_name", "type"], "typed"), ERA, PAID, CONTRACTS], PAYER),
    "unknown_payers": with_claims([CONTRACTS], "SELECT DISTINCT payer_name FROM claims WHERE payer_name NOT IN (SELECT payer_name FROM k)"),
    "anchored_provider_rates": with_claims(["w AS (SELECT * FROM claims WHERE submission_date BETWEEN DATE '1998-03-01' - 90 AND DATE '1998-03-01')", f"g AS (SELECT provider_npi, COUNT(*) FILTER ({KNOWN}) AS known, COUNT(*) FILTER (adjudication_outcome = 'denied') AS denied, COUNT(*) AS volume FROM w GROUP BY 1)"], f"SELECT *, CASE WHEN known >= 30 THEN CAST(denied AS DOUBLE) / known ELSE (SELECT coalesce(CAST(COUNT(*) FILTER (adjudication_outcome = 'denied') AS DOUBLE) / NULLIF(COUNT(*) FILTER ({KNOWN}), 0), 0) FROM w) END AS rate FROM g"),
    "encounter_link": with_claims([ENC, LINKED], "SELECT *, CAST(encounter_id IS NULL AS INTEGER) AS ehr_null_match_flag FROM linked"),
    "encounter_attach": with_claims([ENC, LINKED], "SELECT l.claim_id, l.encounter_id, e.encounter_date, e.admitting_department FROM linked l LEFT JOIN enc e ON e.encounter_id = l.encounter_id"),
    "outcome_link": with_claims([ERA, "last AS (SELECT claim_id, payment_date, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY payment_date DESC, status DESC) AS n FROM era) z WHERE n = 1)", "st AS (SELECT claim_id, payer_name, adjudication_outcome FROM claims WHERE claim_status = 'Active')"], "SELECT coalesce(st.claim_id, last.claim_id) AS claim_id, st.payer_name, coalesce(last.status, st.adjudication_outcome) AS adjudication_outcome, last.payment_date AS adjudication_timestamp FROM st FULL JOIN last ON st.claim_id = last.claim_id"),
    "score_writeback": with_claims([], f"SELECT claim_id, claim_status, CASE WHEN claim_status = 'Active' THEN {LINEAR} ELSE predicted_denial_score END AS predicted_denial_score FROM claims"),
    "score_run_stats": with_claims([], "SELECT COUNT(*) AS active, COUNT(*) AS scored, COUNT(*) FILTER (score_quality_flag = 'degraded') AS degraded, CAST(0 AS BIGINT) AS failed FROM claims WHERE claim_status = 'Active'"),
    "feature_upsert": with_claims([], "SELECT claim_id, CASE WHEN comorbidity_risk_score < 6 THEN payer_name END AS payer_name, CASE WHEN comorbidity_risk_score < 4 THEN denial_reason END AS denial_reason, CASE WHEN comorbidity_risk_score >= 4 THEN department END AS department FROM claims"),
    "deleted_rows": with_claims([], "SELECT claim_id, claim_status FROM claims WHERE claim_status <> 'Active'"),
    "procedure_vectors": with_claims(["bits AS (SELECT DISTINCT 'CLM-' || CAST(l_orderkey AS STRING) AS claim_id, l_partkey % 40 AS i FROM lineitem)", "r AS (SELECT unnest(range(25)) AS i)"], "SELECT c.claim_id, string_agg(CASE WHEN b.i IS NULL THEN '0' ELSE '1' END, '' ORDER BY r.i) AS bits FROM claims c CROSS JOIN r LEFT JOIN bits b ON b.claim_id = c.claim_id AND b.i = r.i GROUP BY 1"),
    "comorbidity_scores": with_claims([PREFIXES, "codes AS (SELECT DISTINCT 'CLM-' || CAST(l_orderkey AS STRING) AS claim_id, upper(p_brand) AS code FROM lineitem JOIN part ON p_partkey = l_partkey)", "best AS (SELECT DISTINCT claim_id, arg_max(prefix, length(prefix)) AS prefix FROM codes JOIN x ON starts_with(code, prefix) GROUP BY claim_id, code)"], "SELECT c.claim_id, CAST(coalesce(SUM(x.weight), 0) AS INTEGER) AS comorbidity_risk_score FROM claims c LEFT JOIN best b ON b.claim_id = c.claim_id LEFT JOIN x ON x.prefix = b.prefix GROUP BY 1"),
    "prefix_matches": with_claims([PREFIXES], "SELECT claim_id, upper(principal_icd10) AS code, arg_max(prefix, length(prefix)) AS prefix, arg_max(weight, length(prefix)) AS weight FROM claims JOIN x ON starts_with(upper(principal_icd10), prefix) GROUP BY 1, 2"),
    "provider_lookups": with_claims([], "SELECT claim_id, CASE provider_npi WHEN 'NPI-0' THEN 'T0' WHEN 'NPI-1' THEN 'T1' WHEN 'NPI-2' THEN 'T2' ELSE 'UNKNOWN' END AS provider_specialty_code, CASE WHEN provider_npi IN ('NPI-2', 'NPI-3') THEN 101 ELSE 100 END AS facility_bed_size FROM claims"),
    "filtered_claims": with_claims([], "SELECT claim_id, payer_name, predicted_denial_score FROM claims WHERE payer_name IN ('BUILDING', 'FURNITURE') AND claim_type = 'Professional' AND predicted_denial_score BETWEEN 0.2 AND 0.8 AND submission_date BETWEEN DATE '1994-01-01' AND DATE '1997-06-30'"),
    "missing_features": with_claims([], "SELECT claim_id, CASE WHEN date_of_birth IS NULL OR provider_npi IS NULL OR denial_reason IS NULL THEN 'degraded' END AS score_quality FROM claims"),
    "prepared_notes": "WITH n AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS t FROM conversations WHERE regexp_matches(coalesce(text, ''), '\\S') GROUP BY 1), w AS (SELECT conv_id, array_to_string(([x FOR x IN regexp_split_to_array(t, '\\s+') IF x <> ''])[1:10000], ' ') AS t FROM n) SELECT conv_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM w",
    "phrase_flags": "SELECT doc_id, CAST(coalesce(regexp_matches(text, '(?i)licensed\\s+under|released\\s+under\\s+the|all\\s+rights'), FALSE) AS INTEGER) AS flag FROM documents",
    "necessity_scores": "SELECT vec_id, round_even(greatest(least(list_sum([CAST(abs(x) AS DOUBLE) FOR x IN embedding]) / len(embedding), 1), 0), 4) AS score FROM embeddings",
    "training_window": with_claims([LABELLED], "SELECT claim_id, submission_date, label FROM lab WHERE submission_date BETWEEN DATE '1998-03-01' - 90 AND DATE '1998-03-01'"),
    "temporal_split": with_claims([LABELLED, CUM, SPLIT], "SELECT claim_id, label, split FROM s"),
    "temporal_split3": with_claims([LABELLED, CUM], "SELECT claim_id, CASE WHEN submission_date < (SELECT min(d) FROM cum WHERE c > floor(n * 0.7)) THEN 'train' WHEN submission_date < (SELECT min(d) FROM cum WHERE c > floor(n * 0.85)) THEN 'validation' ELSE 'test' END AS split FROM lab"),
    "split_statistics": with_claims([LABELLED, CUM, SPLIT], "SELECT split, COUNT(*) AS total, AVG(label) AS denied_share, min(submission_date) AS first, max(submission_date) AS last FROM s GROUP BY 1"),
    "class_weights": with_claims([LABELLED, "g AS (SELECT CAST(SUM(label) AS BIGINT) AS denied, COUNT(*) AS n FROM lab)"], "SELECT denied, n, CASE WHEN denied > 0 AND CAST(denied AS DOUBLE) / n < 0.05 THEN CAST(n - denied AS DOUBLE) / denied ELSE CAST(1 AS DOUBLE) END AS weight FROM g"),
    "model_metrics": with_claims(
        [
            LABELLED, "m AS (SELECT COUNT(*) FILTER (score >= 0.5 AND label = 1) AS tp, COUNT(*) FILTER (score >= 0.5 AND label = 0) AS fp, COUNT(*) FILTER (score < 0.5 AND label = 1) AS fn, COUNT(*) FILTER (score < 0.5 AND label = 0) AS tn FROM lab)",
            "pr AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall FROM m)",
            "v AS (SELECT score, SUM(label) AS p, COUNT(*) - SUM(label) AS n FROM lab GROUP BY 1)", "u AS (SELECT *, SUM(p) OVER w AS pu, SUM(n) OVER w AS nu FROM v WINDOW w AS (ORDER BY score DESC))",
            "bins AS (SELECT COUNT(*) AS n, AVG(score) AS s, AVG(label) AS y FROM lab GROUP BY least(CAST(floor(score * 10 + 1e-9) AS INTEGER), 9))",
        ],
        "SELECT tp, fp, fn, tn, precision, recall, 2 * precision * recall / (precision + recall) AS f1, (SELECT SUM(n * (pu - p + p / CAST(2 AS DOUBLE))) / (CAST(SUM(p) AS DOUBLE) * SUM(n)) FROM u) AS auc_roc, (SELECT SUM(p * CAST(pu AS DOUBLE) / (pu + nu)) / SUM(p) FROM u) AS auc_pr, (SELECT SUM(n * abs(s - y)) / SUM(n) FROM bins) AS ece FROM pr",
    ),
    "monitoring_record": with_claims(["w AS (SELECT predicted_denial_score >= 0.5 AS p, adjudication_outcome = 'denied' AS y FROM claims WHERE submission_date > DATE '1998-03-01' - 30 AND submission_date <= DATE '1998-03-01' AND adjudication_outcome IN ('denied','paid'))", "g AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (p) AS predicted_denials, COUNT(*) FILTER (p AND y) AS true_positives, COUNT(*) FILTER (p AND NOT y) AS false_positives FROM w)", "h AS (SELECT *, CASE WHEN total >= 30 AND predicted_denials > 0 THEN CAST(true_positives AS DOUBLE) / predicted_denials END AS rolling_precision FROM g)"], f"SELECT *, {TIER.format('rolling_precision')} AS alert_tier, DATE '1998-03-01' AS as_of, CASE WHEN rolling_precision < 0.8 THEN 'active' ELSE 'inactive' END AS retraining FROM h"),
    "precision_history": with_claims([f"d AS (SELECT submission_date AS scored_date, COUNT(*) AS n, COUNT(*) FILTER (predicted_denial_score >= 0.5) AS p, COUNT(*) FILTER (predicted_denial_score >= 0.5 AND adjudication_outcome = 'denied') AS tp FROM claims WHERE {KNOWN} GROUP BY 1)", "w AS (SELECT a.scored_date, CAST(SUM(b.n) AS BIGINT) AS total, CASE WHEN SUM(b.n) >= 30 AND SUM(b.p) > 0 THEN CAST(SUM(b.tp) AS DOUBLE) / SUM(b.p) END AS rolling_precision FROM d a JOIN d b ON b.scored_date > a.scored_date - 30 AND b.scored_date <= a.scored_date GROUP BY 1)"], f"SELECT *, {TIER.format('rolling_precision')} AS alert_tier FROM w"),
    "retention_check": with_claims([], "SELECT min(submission_date) AS oldest, COUNT(submission_date) AS dated, DATE '1998-03-01' - 90 AS threshold, min(submission_date) < DATE '1998-03-01' - 90 AND COUNT(submission_date) >= 2 AS alert FROM claims"),
    "failure_streaks": "WITH r AS (SELECT o_custkey AS model, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'P' THEN 'Archived' ELSE 'Staging' END AS stage FROM orders), s AS (SELECT a.*, (SELECT COUNT(*) FROM r b WHERE b.model = a.model AND b.run_id <= a.run_id AND b.stage = 'Failed' AND b.run_id > coalesce((SELECT max(c.run_id) FROM r c WHERE c.model = a.model AND c.run_id <= a.run_id AND c.stage = 'Staging'), -1)) AS streak FROM r a) SELECT *, stage = 'Failed' AND streak >= 3 AS escalate FROM s",
}

READY = "SELECT claim_id, submission_date, claim_status, adjudication_outcome, documents_medical_necessity, mentions_lack_of_pre_auth FROM claims"

LINES = "lines AS (SELECT 'CLM-' || CAST(l_orderkey AS STRING) AS claim_id, l_partkey % 40 AS i, upper(p_brand) AS code, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN part ON p_partkey = l_partkey)"
SQL["clinical_features"] = with_claims(
    [
        LINES, PREFIXES, "per AS (SELECT claim_id, COUNT(*) AS n, max(d) AS d FROM lines GROUP BY 1)", "best AS (SELECT DISTINCT claim_id, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT claim_id, code FROM lines) z JOIN x ON starts_with(code, prefix) GROUP BY claim_id, code)",
        "com AS (SELECT claim_id, CAST(SUM(weight) AS INTEGER) AS w FROM best JOIN x USING (prefix) GROUP BY 1)", "bits AS (SELECT DISTINCT claim_id, i FROM lines WHERE i < 25)", "r AS (SELECT unnest(range(25)) AS i)",
        "vec AS (SELECT c.claim_id, string_agg(CASE WHEN b.i IS NULL THEN '0' ELSE '1' END, '' ORDER BY r.i) AS v FROM claims c CROSS JOIN r LEFT JOIN bits b ON b.claim_id = c.claim_id AND b.i = r.i GROUP BY 1)",
        "cat AS (SELECT claim_id, submission_date, CASE WHEN CAST(substring(principal_icd10, 7) AS INTEGER) % 2 = 0 THEN CAST(substring(principal_icd10, 7) AS INTEGER) % 12 ELSE 0 END AS k FROM claims)",
    ],
    "SELECT cat.claim_id, coalesce(k, 0) AS principal_dx_ccs_category, CAST(coalesce(per.n, 0) AS INTEGER) AS secondary_dx_count, CAST(CASE WHEN per.d IS NULL THEN -1 ELSE greatest(per.d - submission_date, 0) END AS INTEGER) AS length_of_stay, "
    "coalesce(com.w, 0) AS comorbidity_risk_score, vec.v AS procedure_vector, CASE WHEN k IN (2, 4, 6, 8) AND substring(vec.v, k + 1, 2) = '00' THEN 1 ELSE 0 END AS diagnosis_procedure_mismatch FROM cat JOIN vec USING (claim_id) LEFT JOIN per USING (claim_id) LEFT JOIN com USING (claim_id)",
)
GROUPS = ("claim_level_features", "provider_features", "payer_features", "clinical_features", "provider_lookups")
SQL["feature_table"] = f"SELECT * FROM ({with_claims([], READY)}) a" + "".join(f" JOIN ({SQL[k]}) {k} USING (claim_id)" for k in GROUPS)
STEPS = " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0) * CAST({i / 4096!r} AS DOUBLE)" for i, c in enumerate(NUMERIC))
MISSING = " OR ".join(f"{c} IS NULL" for c in NUMERIC)
SQL["scored_claims"] = (
    f"SELECT claim_id, round(greatest(least({STEPS}, 1), 0), 6) AS predicted_denial_score, CASE WHEN {MISSING} THEN 'degraded' END AS score_quality_flag, "
    f"CAST(NULL AS STRING) AS score_error FROM ({SQL['feature_table']}) t"
)
SQL["leave_last_out_rates"] = with_claims(
    [f"w AS (SELECT *, CASE WHEN adjudication_outcome = 'denied' THEN 1 ELSE 0 END AS x FROM claims WHERE submission_date BETWEEN DATE '1995-06-30' - 90 AND DATE '1995-06-30' AND {KNOWN})", "o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY provider_npi ORDER BY submission_date DESC, claim_id DESC) AS nth, COUNT(*) OVER (PARTITION BY provider_npi) AS n FROM w)"],
    "SELECT provider_npi, CASE WHEN max(n) > 3 THEN CAST(SUM(x) FILTER (nth > 1) AS DOUBLE) / (max(n) - 1) ELSE (SELECT AVG(x) FROM w) END AS rate FROM o GROUP BY 1",
)
SQL["imputed_features"] = with_claims([], "SELECT claim_id, CASE WHEN comorbidity_risk_score = 3 THEN 0 ELSE comorbidity_risk_score END AS comorbidity_risk_score, CASE WHEN length_of_stay > 4 THEN documents_medical_necessity ELSE 0 END AS documents_medical_necessity FROM claims")
SQL["claim_risk"] = with_claims([], f"SELECT claim_id, predicted_denial_score >= 0.6 AS predicted_denial, CASE WHEN predicted_denial_score >= 0.6 THEN charge_amount ELSE 0 END AS revenue_at_risk, {LABEL} AS confusion FROM claims")
NOTES = SQL["prepared_notes"].removesuffix("SELECT conv_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM w").removeprefix("WITH ")
PHRASES = "|".join(PRIOR_AUTH).replace("'", "''")
SQL["note_flags"] = with_claims([NOTES], f"SELECT claim_id, CAST(coalesce(regexp_matches(w.t, '(?i){PHRASES}'), FALSE) AS INTEGER) AS mentions_lack_of_pre_auth, CASE WHEN w.t IS NULL THEN 1 ELSE 0 END AS nlp_flag FROM claims LEFT JOIN w ON claim_id = 'CLM-' || CAST(conv_id AS STRING)")
SQL["gate_decision"] = f"SELECT precision, ece, CASE WHEN precision >= 0.9 AND ece <= 0.05 THEN 'Staging' ELSE 'Failed' END AS stage FROM ({SQL['model_metrics']}) m"
SQL["metric_comparison"] = f"WITH m AS ({SQL['split_statistics']}) SELECT split AS version, 'denied_share' AS metric, denied_share AS value FROM m UNION ALL SELECT split, 'total', CAST(total AS DOUBLE) FROM m"
SQL["run_health"] = with_claims([], "SELECT submission_date AS run_ts, COUNT(*) AS minutes, COUNT(predicted_denial_score) AS scored, COUNT(score_quality_flag) AS failed, COUNT(*) > 5 AS sla_breach FROM claims GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
