"""The SQL twins of the analytical queries, each over the claims view as a common table expression."""

from __future__ import annotations

from claimspark.plans.views import CLAIMS_SQL

CLAIMS = f"claims AS (SELECT * FROM ({CLAIMS_SQL}) c)"


def n(condition: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def money(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def mean(c: str, scale: int = 4) -> str:
    return f"(CAST(SUM(CAST({c} AS DECIMAL(18,{scale}))) AS DOUBLE) / NULLIF(COUNT({c}), 0))"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0))"


D, P, KNOWN = n("adjudication_outcome = 'denied'"), n("adjudication_outcome = 'paid'"), "adjudication_outcome IN ('denied','paid')"
PENDING, DEGRADED = n("adjudication_outcome = 'pending'"), n("score_quality_flag = 'degraded'")
SCORE, CHARGE, RISK = mean("predicted_denial_score"), mean("charge_amount", 2), money("revenue_at_risk")
DENIED_MONEY = money("CASE WHEN adjudication_outcome = 'denied' THEN charge_amount ELSE 0 END")
BAND = "CASE " + " ".join(f"WHEN predicted_denial_score < {(i + 1) / 10} THEN '{i / 10}–{(i + 1) / 10}'" for i in range(9)) + " ELSE '0.9–1.0' END"
LABEL = (
    "CASE WHEN predicted_denial_score >= 0.5 AND adjudication_outcome = 'denied' THEN 'TP' WHEN predicted_denial_score >= 0.5 AND adjudication_outcome = 'paid' THEN 'FP' "
    "WHEN predicted_denial_score < 0.5 AND adjudication_outcome = 'denied' THEN 'FN' WHEN predicted_denial_score < 0.5 AND adjudication_outcome = 'paid' THEN 'TN' ELSE 'Unknown' END"
)
DAILY = f"daily AS (SELECT submission_date AS dt, COUNT(*) AS total_claims, {D} AS denied, {P} AS paid, {money('charge_amount')} AS total_charges, {DENIED_MONEY} AS denied_charges, {RISK} AS risk FROM claims GROUP BY 1)"
MONTH = "CAST(DATE_TRUNC('month', submission_date) AS DATE)"


def running(c: str, over: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) OVER ({over}) AS DOUBLE)"


def integer(window: str) -> str:
    return f"CAST({window} AS INTEGER)"


COHORT = (
    f"m AS (SELECT {MONTH} AS month, payer_name, claim_type, COUNT(*) AS claims, {D} AS denials, {money('charge_amount')} AS total_charge, {RISK} AS revenue_risk, {SCORE} AS avg_denial_score, {mean('documents_medical_necessity')} AS avg_necessity_score FROM claims GROUP BY 1, 2, 3), "
    f"r AS (SELECT *, {ratio('denials', 'claims')} AS denial_rate, LAG(claims) OVER w AS prev_month_claims, LAG(denials) OVER w AS prev_month_denials FROM m WINDOW w AS (PARTITION BY payer_name, claim_type ORDER BY month))"
)
PAYERS = f"p AS (SELECT payer_name, COUNT(*) AS total_claims, {D} AS denied, {SCORE} AS avg_score, {RISK} AS revenue_at_risk, {CHARGE} AS avg_charge FROM claims GROUP BY 1)"
SPECIALTIES = f"s AS (SELECT provider_specialty, COUNT(*) AS total_claims, {D} AS denied, {mean('comorbidity_risk_score')} AS avg_comorbidity, {mean('length_of_stay')} AS avg_los, {RISK} AS revenue_at_risk, {mean('documents_medical_necessity')} AS avg_necessity FROM claims GROUP BY 1)"
WORKLIST = "claim_id, submission_date, payer_name, provider_specialty, provider_state, claim_type, admission_type, CAST(coalesce(year(submission_date) - year(date_of_birth) - CASE WHEN month(submission_date) * 100 + day(submission_date) < month(date_of_birth) * 100 + day(date_of_birth) THEN 1 ELSE 0 END, -1) AS INTEGER) AS patient_age, comorbidity_risk_score, length_of_stay, charge_amount, predicted_denial_score AS denial_score, documents_medical_necessity, mentions_lack_of_pre_auth, score_quality_flag, adjudication_outcome"

#: name: (more common table expressions, the query)
TEXTS: dict[str, tuple[list[str], str]] = {
    "kpi_summary": ([], f"SELECT COUNT(*) AS total_claims, {D} AS total_denied, {P} AS total_paid, {PENDING} AS total_pending, {ratio(D, n(KNOWN))} AS overall_denial_rate, {SCORE} AS avg_denial_score, {n('predicted_denial_score >= 0.5')} AS high_risk_count, {CHARGE} AS avg_charge_amount, {money('charge_amount')} AS total_charge_amount, CAST({DEGRADED} AS DOUBLE) * 100 / NULLIF(COUNT(*), 0) AS degraded_scores_pct FROM claims"),
    "daily_denial_trend": ([DAILY], f"SELECT dt, total_claims, denied, paid, {ratio('denied', 'denied + paid')} AS denial_rate, AVG({ratio('denied', 'denied + paid')}) OVER (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d_denial_rate, AVG({ratio('denied', 'denied + paid')}) OVER (ORDER BY dt ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_30d_denial_rate, total_charges, {running('total_charges', 'ORDER BY dt')} AS cumulative_charges FROM daily"),
    "denial_by_payer": ([f"p AS (SELECT payer_name, COUNT(*) AS total_claims, {D} AS denied, {P} AS paid, {SCORE} AS avg_risk_score, {DENIED_MONEY} AS denied_charges, {money('charge_amount')} AS total_charges FROM claims GROUP BY 1)"], f"SELECT *, {ratio('denied', 'denied + paid')} AS denial_rate, denied_charges * 100 / NULLIF(total_charges, 0) AS denied_charges_pct, {integer('RANK() OVER (ORDER BY ' + ratio('denied', 'denied + paid') + ' DESC NULLS LAST)')} AS denial_rank FROM p"),
    "denial_by_specialty": ([f"p AS (SELECT provider_specialty, COUNT(*) AS total_claims, {D} AS denied, {SCORE} AS avg_risk_score, {DENIED_MONEY} AS denied_charges FROM claims GROUP BY 1)"], f"SELECT *, {ratio('denied', 'total_claims')} AS denial_rate, {integer('RANK() OVER (ORDER BY ' + ratio('denied', 'total_claims') + ' DESC NULLS LAST)')} AS rank FROM p"),
    "denial_reasons": ([f"p AS (SELECT denial_reason, COUNT(*) AS count, {money('charge_amount')} AS total_charges, {CHARGE} AS avg_charge, {SCORE} AS avg_risk_score FROM claims WHERE denial_reason IS NOT NULL GROUP BY 1)"], "SELECT *, CAST(count AS DOUBLE) * 100 / SUM(count) OVER () AS pct_of_total FROM p"),
    "risk_score_distribution": ([], f"SELECT CAST(FLOOR(predicted_denial_score * 10) AS DOUBLE) / 10 AS score_bucket, COUNT(*) AS total, {D} AS actual_denied, {P} AS actual_paid, {PENDING} AS pending, {CHARGE} AS avg_charge FROM claims GROUP BY 1"),
    "monthly_mom_analysis": ([f"m AS (SELECT {MONTH} AS month, COUNT(*) AS total_claims, {D} AS denied, {P} AS paid, {money('charge_amount')} AS total_charges FROM claims GROUP BY 1)", f"r AS (SELECT *, {ratio('denied', 'denied + paid')} AS denial_rate FROM m)", "l AS (SELECT *, LAG(denial_rate) OVER (ORDER BY month) AS prev_denial_rate, LAG(total_claims) OVER (ORDER BY month) AS prev_total_claims FROM r)"], "SELECT *, denial_rate - prev_denial_rate AS denial_rate_mom_delta, CAST(total_claims - prev_total_claims AS DOUBLE) * 100 / NULLIF(prev_total_claims, 0) AS claims_volume_pct_change FROM l"),
    "provider_performance": ([f"p AS (SELECT provider_npi, provider_specialty, provider_state, COUNT(*) AS total_claims, {D} AS denied, {SCORE} AS avg_risk_score, {money('charge_amount')} AS total_charges, {DENIED_MONEY} AS denied_charges FROM claims GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3)", f"r AS (SELECT *, {ratio('denied', 'total_claims')} AS denial_rate, coalesce(provider_npi, '~') || '|' || coalesce(provider_specialty, '~') || '|' || coalesce(provider_state, '~') AS tie FROM p)"], "SELECT provider_npi, provider_specialty, provider_state, total_claims, denied, avg_risk_score, total_charges, denied_charges, denial_rate, denial_rate_percentile FROM (SELECT *, PERCENT_RANK() OVER (ORDER BY denial_rate) AS denial_rate_percentile FROM r) x ORDER BY denial_rate DESC NULLS LAST, tie LIMIT 20"),
    "payer_claimtype_crosstab": ([], "SELECT payer_name, " + ", ".join(f"AVG(CASE WHEN lower(claim_type) = '{k}' AND {KNOWN} THEN CASE WHEN adjudication_outcome = 'denied' THEN 1.0 ELSE 0.0 END END) AS {k}_denial_rate" for k in ("professional", "institutional")) + f", COUNT(*) AS total_claims, {D} AS total_denied FROM claims GROUP BY 1"),
    "high_risk_claims": ([], f"SELECT {WORKLIST} FROM claims WHERE predicted_denial_score >= 0.7 AND adjudication_outcome = 'pending' ORDER BY predicted_denial_score DESC, claim_id LIMIT 100"),
    "calibration_analysis": ([f"b AS (SELECT CAST(FLOOR(predicted_denial_score * 10) AS DOUBLE) / 10 AS bin_lower, COUNT(*) AS n_samples, {SCORE} AS mean_predicted, {ratio(D, 'COUNT(*)')} AS actual_denial_fraction FROM claims WHERE {KNOWN} GROUP BY 1)"], f"SELECT *, bin_lower + CAST(0.1 AS DOUBLE) AS bin_upper, ABS(mean_predicted - actual_denial_fraction) AS calibration_gap, CAST(n_samples AS DOUBLE) / SUM(n_samples) OVER () AS bin_weight FROM b"),
    "admission_type_analysis": ([], f"SELECT admission_type, COUNT(*) AS total_claims, {D} AS denied, {ratio(D, 'COUNT(*)')} AS denial_rate, {CHARGE} AS avg_charge, {SCORE} AS avg_risk_score, {mean('length_of_stay')} AS avg_los, {mean('comorbidity_risk_score')} AS avg_comorbidity FROM claims GROUP BY 1"),
    "cumulative_revenue_at_risk": ([DAILY], f"SELECT dt, denied_charges AS daily_denied_charges, total_charges AS daily_total_charges, {running('denied_charges', 'ORDER BY dt')} AS cumulative_denied_charges, {running('total_charges', 'ORDER BY dt')} AS cumulative_total_charges FROM daily"),
    "state_denial_heatmap": ([], f"SELECT provider_state AS state, COUNT(*) AS total_claims, {D} AS denied, {ratio(D, 'COUNT(*)')} AS denial_rate, {money('charge_amount')} AS total_charges, {DENIED_MONEY} AS denied_charges FROM claims GROUP BY 1"),
    "nlp_feature_impact": ([f"q AS (SELECT *, {integer('NTILE(4) OVER (ORDER BY documents_medical_necessity, claim_id)')} AS necessity_quartile FROM claims)"], f"SELECT necessity_quartile, mentions_lack_of_pre_auth, COUNT(*) AS total, {D} AS denied, {ratio(D, 'COUNT(*)')} AS denial_rate, {mean('documents_medical_necessity')} AS avg_necessity_score, {SCORE} AS avg_risk_score FROM q WHERE {KNOWN} GROUP BY 1, 2"),
    "confusion_matrix_stats": ([f"l AS (SELECT {LABEL} AS k FROM claims WHERE {KNOWN})", "c AS (SELECT " + ", ".join(f"CAST(COALESCE(SUM(CASE WHEN k = '{x.upper()}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {x}" for x in ("tp", "fp", "tn", "fn")) + ", COUNT(*) AS total FROM l)", "m AS (SELECT *, tp / CAST(GREATEST(tp + fp, 1) AS DOUBLE) AS precision, tp / CAST(GREATEST(tp + fn, 1) AS DOUBLE) AS recall, (tp + tn) / CAST(GREATEST(total, 1) AS DOUBLE) AS accuracy FROM c)"], "SELECT *, 2 * precision * recall / GREATEST(precision + recall, 1e-9) AS f1 FROM m"),
    "payer_cohort_analysis": (["o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY payer_name ORDER BY submission_date, claim_id) AS seq FROM claims)"], f"SELECT CASE WHEN seq = 1 THEN 'First Claim' ELSE 'Repeat Claim' END AS cohort, COUNT(*) AS total, {D} AS denied, {ratio(D, 'COUNT(*)')} AS denial_rate, {CHARGE} AS avg_charge FROM o WHERE {KNOWN} GROUP BY 1"),
    "comorbidity_denial_analysis": ([], f"SELECT CASE WHEN comorbidity_risk_score = 0 THEN '0 (None)' WHEN comorbidity_risk_score BETWEEN 1 AND 2 THEN '1-2 (Low)' WHEN comorbidity_risk_score BETWEEN 3 AND 5 THEN '3-5 (Moderate)' ELSE '6+ (High)' END AS comorbidity_group, COUNT(*) AS total_claims, {D} AS denied, {ratio(D, 'COUNT(*)')} AS denial_rate, {CHARGE} AS avg_charge, {SCORE} AS avg_risk_score FROM claims WHERE {KNOWN} GROUP BY 1"),
    "rolling_denial_trend": ([DAILY], f"SELECT dt AS day, total_claims, denied AS denied_claims, {ratio('denied', 'total_claims')} AS daily_denial_rate, AVG({ratio('denied', 'total_claims')}) OVER (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d_denial_rate, {running('risk', 'ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW')} AS rolling_7d_revenue_risk, total_charges AS total_charge, risk AS revenue_at_risk FROM daily"),
    "payer_ranking": ([PAYERS], f"SELECT *, {integer('RANK() OVER (ORDER BY denied DESC)')} AS denial_rank, PERCENT_RANK() OVER (ORDER BY denied DESC) AS denial_pct_rank, {integer('DENSE_RANK() OVER (ORDER BY revenue_at_risk DESC)')} AS risk_rank, {integer('NTILE(4) OVER (ORDER BY denied DESC, payer_name)')} AS denial_quartile FROM p"),
    "monthly_cohort": ([COHORT], f"SELECT *, {ratio('claims - COALESCE(prev_month_claims, claims)', 'prev_month_claims')} AS mom_claims_change, {ratio('denials - COALESCE(prev_month_denials, denials)', 'prev_month_denials')} AS mom_denial_change FROM r"),
    "high_risk_decile": ([f"s AS (SELECT *, PERCENT_RANK() OVER (ORDER BY predicted_denial_score) AS score_pctrank, PERCENT_RANK() OVER (ORDER BY charge_amount) AS charge_pctrank, {integer('NTILE(10) OVER (ORDER BY predicted_denial_score DESC, claim_id)')} AS score_decile, {running('revenue_at_risk', 'PARTITION BY payer_name')} AS payer_total_risk FROM claims)"], "SELECT claim_id, submission_date, payer_name, provider_specialty, principal_icd10, diagnosis_description, charge_amount, predicted_denial_score, score_decile, score_pctrank, charge_pctrank, revenue_at_risk, payer_total_risk, mentions_lack_of_pre_auth, documents_medical_necessity, denial_reason FROM s WHERE score_decile = 1 ORDER BY predicted_denial_score DESC, charge_amount DESC, claim_id LIMIT 200"),
    "specialty_analysis": ([SPECIALTIES], f"SELECT *, {ratio('denied', 'total_claims')} AS denial_rate, {integer('RANK() OVER (ORDER BY denied DESC)')} AS denial_rank, {running('revenue_at_risk', 'ORDER BY revenue_at_risk DESC, provider_specialty NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS cumulative_revenue_risk FROM s"),
    "model_performance": ([f"p AS (SELECT {LABEL} AS classification, COUNT(*) AS count, {money('charge_amount')} AS total_charge, {RISK} AS revenue_at_risk FROM claims GROUP BY 1)"], "SELECT *, CAST(count AS DOUBLE) * 100 / SUM(count) OVER () AS pct_of_total FROM p"),
    "icd10_hotspots": ([f"p AS (SELECT principal_icd10, diagnosis_description, COUNT(*) AS total, {D} AS denied, {SCORE} AS avg_score, {RISK} AS revenue_at_risk FROM claims GROUP BY 1, 2)"], f"SELECT *, {ratio('denied', 'total')} AS denial_rate, {integer('RANK() OVER (ORDER BY denied DESC)')} AS denial_rank, revenue_at_risk * 100 / NULLIF({running('revenue_at_risk', '')}, 0) AS pct_total_risk FROM p"),
    "score_bucket_distribution": ([], f"SELECT {BAND} AS score_bucket, COUNT(*) AS total, {D} AS actual_denied, {ratio(D, 'COUNT(*)')} AS actual_denial_rate FROM claims GROUP BY 1"),
    "provider_summary": ([f"p AS (SELECT provider_specialty, department, COUNT(*) AS claims, {D} AS denied, {CHARGE} AS avg_charge, {RISK} AS total_risk FROM claims GROUP BY 1, 2)"], f"SELECT *, {ratio('denied', 'claims')} AS denial_rate, FIRST_VALUE(provider_specialty) OVER (PARTITION BY department ORDER BY denied DESC, provider_specialty NULLS LAST) AS highest_risk_specialty_in_dept, {running('total_risk', 'PARTITION BY department')} AS dept_total_risk FROM p"),
    "preauth_impact": ([], f"SELECT mentions_lack_of_pre_auth, COUNT(*) AS total, {D} AS denied, {ratio(D, 'COUNT(*)')} AS denial_rate, {CHARGE} AS avg_charge, {RISK} AS revenue_at_risk FROM claims GROUP BY 1"),
    "payer_stats": ([f"p AS (SELECT payer_name, COUNT(claim_id) AS total_claims, {D} AS total_denied, {n('predicted_denial_score >= 0.5')} AS total_predicted_denied, {CHARGE} AS avg_charge, {RISK} AS total_revenue_at_risk, {SCORE} AS avg_denial_score FROM claims GROUP BY 1)"], f"SELECT *, {ratio('total_denied', 'total_claims')} AS actual_denial_rate, {ratio('total_predicted_denied', 'total_claims')} AS predicted_denial_rate FROM p"),
    "denial_reason_stats": ([], f"SELECT denial_reason, COUNT(claim_id) AS count, {CHARGE} AS avg_charge FROM claims WHERE adjudication_outcome = 'denied' AND denial_reason IS NOT NULL GROUP BY 1"),
    "executive_kpis": ([], f"SELECT COUNT(*) AS total, {D} AS denied, {n('predicted_denial_score >= 0.5')} AS pred_denied, {RISK} AS revenue_risk, {SCORE} AS avg_score, COALESCE({ratio(n('predicted_denial_score >= 0.5 AND adjudication_outcome = ' + repr('denied')), n('predicted_denial_score >= 0.5 AND ' + KNOWN))}, 0) AS precision, {ratio(D, 'COUNT(*)')} AS denial_rate FROM claims"),
    "monthly_rollup": ([], f"SELECT strftime(submission_date, '%Y-%m') AS month_str, COUNT(*) AS total_claims, {D} AS total_denials, {money('charge_amount')} AS total_charge, {RISK} AS revenue_risk, {ratio(D, 'COUNT(*)')} AS denial_rate FROM claims GROUP BY 1"),
    "score_histogram": ([], "SELECT CAST(FLOOR(predicted_denial_score * 40) AS DOUBLE) / 40 AS bin, adjudication_outcome, COUNT(*) AS count FROM claims GROUP BY 1, 2"),
    "preset_rolling_7d": ([DAILY], f"SELECT dt AS day, total_claims AS total, denied, AVG({ratio('denied', 'total_claims')}) OVER (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d_rate FROM daily"),
    "preset_top_payers": ([PAYERS], f"SELECT payer_name, total_claims AS claims, revenue_at_risk, {ratio('denied', 'total_claims')} AS denial_rate FROM p ORDER BY revenue_at_risk DESC, payer_name LIMIT 5"),
    "preset_payer_quartiles": ([PAYERS], f"SELECT payer_name, denied, {integer('RANK() OVER (ORDER BY denied DESC)')} AS denial_rank, {integer('NTILE(4) OVER (ORDER BY denied DESC, payer_name)')} AS quartile FROM p"),
    "preset_monthly_change": ([f"m AS (SELECT {MONTH} AS month, COUNT(*) AS claims, {D} AS denied FROM claims GROUP BY 1)", "l AS (SELECT *, LAG(denied) OVER (ORDER BY month) AS prev_denied FROM m)"], f"SELECT *, {ratio('denied', 'claims')} AS denial_rate, {ratio('denied - prev_denied', 'prev_denied')} AS mom_change FROM l"),
    "preset_score_calibration": ([], f"SELECT CAST(FLOOR(predicted_denial_score * 10) AS DOUBLE) / 10 AS score_bin, COUNT(*) AS claims, {D} AS actual_denied, {ratio(D, 'COUNT(*)')} AS actual_denial_rate FROM claims GROUP BY 1"),
    "preset_high_risk": ([f"s AS (SELECT claim_id, payer_name, provider_specialty, charge_amount, predicted_denial_score, PERCENT_RANK() OVER (ORDER BY predicted_denial_score) AS pct_rank, {integer('NTILE(10) OVER (ORDER BY predicted_denial_score DESC, claim_id)')} AS risk_decile FROM claims)"], "SELECT * FROM s WHERE risk_decile = 1 ORDER BY predicted_denial_score DESC, claim_id LIMIT 50"),
    "preset_cumulative_risk": ([SPECIALTIES], f"SELECT provider_specialty, revenue_at_risk AS specialty_risk, {running('revenue_at_risk', 'ORDER BY revenue_at_risk DESC, provider_specialty NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS cumulative_risk FROM s"),
    "preset_icd10_top_payer": ([f"e AS (SELECT principal_icd10, payer_name, COUNT(*) AS n, {D} AS d FROM claims GROUP BY 1, 2)", "t AS (SELECT *, FIRST_VALUE(payer_name) OVER (PARTITION BY principal_icd10 ORDER BY d DESC, payer_name) AS top_payer FROM e)"], f"SELECT principal_icd10, CAST(SUM(n) AS BIGINT) AS total, CAST(SUM(d) AS BIGINT) AS denied, top_payer, {ratio('SUM(d)', 'SUM(n)')} AS denial_rate FROM t GROUP BY principal_icd10, top_payer"),
}


def with_claims(parts: list[str], query: str) -> str:
    return f"WITH {', '.join([CLAIMS, *parts])} {query}"


def analytics_sql() -> dict[str, str]:
    return {name: with_claims(parts, query) for name, (parts, query) in TEXTS.items()}
