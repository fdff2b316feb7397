"""Named analytical queries over the claims view. Each takes claims and returns a DataFrame; values are not rounded, present() rounds them.

Two denominators of denial rates are kept apart: known claims (denied and paid) and all claims.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.scalars import age_years
from claimspark.plans.views import cut
from claimspark.plans.windows import global_rank

BANDS = ("0.0–0.1", "0.1–0.2", "0.2–0.3", "0.3–0.4", "0.4–0.5", "0.5–0.6", "0.6–0.7", "0.7–0.8", "0.8–0.9", "0.9–1.0")


def number(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def is_outcome(value: str) -> Column:
    return F.col("adjudication_outcome") == value


def denied() -> Column:
    return number(is_outcome("denied"))


def paid() -> Column:
    return number(is_outcome("paid"))


def known() -> Column:
    return F.col("adjudication_outcome").isin("denied", "paid")


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0))


def money(c: Column | str) -> Column:
    """An exact sum of amounts in cents, as a double."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def mean(c: str, scale: int = 4) -> Column:
    """A mean that doesn't depend on the order of rows: values count to ``scale`` decimals."""
    return F.sum(F.col(c).cast(f"decimal(18,{scale})")).cast("double") / F.nullif(F.count(c), F.lit(0))


def denied_money() -> Column:
    return money(F.when(is_outcome("denied"), F.col("charge_amount")).otherwise(F.lit(0.0)))


def score_band(c: str = "predicted_denial_score") -> Column:
    out = F.when(F.col(c) < 0.1, BANDS[0])
    for i in range(1, 9):
        out = out.when(F.col(c) < (i + 1) / 10, BANDS[i])
    return out.otherwise(BANDS[9])


def score_bin(c: str = "predicted_denial_score", bins: int = 10) -> Column:
    return F.floor(F.col(c) * bins).cast("double") / float(bins)


def comorbidity_group(c: str = "comorbidity_risk_score") -> Column:
    return F.when(F.col(c) == 0, "0 (None)").when(F.col(c).between(1, 2), "1-2 (Low)").when(F.col(c).between(3, 5), "3-5 (Moderate)").otherwise("6+ (High)")


def predicted(threshold: float = 0.5) -> Column:
    return F.col("predicted_denial_score") >= threshold


def confusion_label(threshold: float = 0.5) -> Column:
    p = predicted(threshold)
    return F.when(p & is_outcome("denied"), "TP").when(p & is_outcome("paid"), "FP").when(~p & is_outcome("denied"), "FN").when(~p & is_outcome("paid"), "TN").otherwise("Unknown")


def with_risk(claims: DataFrame, threshold: float = 0.5) -> DataFrame:
    return claims.withColumns({"predicted_denial": predicted(threshold), "revenue_at_risk": F.when(predicted(threshold), F.col("charge_amount")).otherwise(F.lit(0.0))})


def filter_claims(claims: DataFrame, payers: list[str] = (), types: list[str] = (), low: float | None = None, high: float | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The global filters; an empty list or None filters nothing."""
    tests = [F.col("payer_name").isin(*payers)] * bool(payers) + [F.col("claim_type").isin(*types)] * bool(types)
    tests += [F.col("predicted_denial_score") >= low] * (low is not None) + [F.col("predicted_denial_score") <= high] * (high is not None)
    tests += [F.col("submission_date") >= F.lit(first).cast("date")] * (first is not None) + [F.col("submission_date") <= F.lit(last).cast("date")] * (last is not None)
    for t in tests:
        claims = claims.filter(t)
    return claims


def present(df: DataFrame) -> DataFrame:
    """df with rates, scores, shares and gaps rounded to 4 decimals, money, percentages and averages to 2."""
    four = re.compile(r"rate|score|gap|fraction|weight|predicted|precision|recall|f1|accuracy|change|delta|percentile|pct_rank|necessity")
    return df.select(*(F.round(f"`{c}`", 4 if four.search(c) and not c.endswith("_pct") else 2).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _by(rows: DataFrame, /, *keys: str, **values: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*(v.alias(k) for k, v in values.items()))


def _last(name: str, *rest: str) -> list[Column]:
    return [F.col(name).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in rest)]


# Queries with known claims as denominator


def kpi_summary(claims: DataFrame) -> DataFrame:
    return claims.agg(
        F.count("*").alias("total_claims"), denied().alias("total_denied"), paid().alias("total_paid"), number(is_outcome("pending")).alias("total_pending"),
        ratio(denied(), number(known())).alias("overall_denial_rate"), mean("predicted_denial_score").alias("avg_denial_score"), number(predicted()).alias("high_risk_count"),
        mean("charge_amount", 2).alias("avg_charge_amount"), money("charge_amount").alias("total_charge_amount"),
        (number(F.col("score_quality_flag") == "degraded").cast("double") * 100 / F.nullif(F.count("*"), F.lit(0))).alias("degraded_scores_pct"),
    )


def _daily(claims: DataFrame) -> DataFrame:
    """One row a day: few enough for windows over all of them."""
    return _by(claims.withColumn("dt", F.col("submission_date").cast("date")), "dt", total_claims=F.count("*"), denied=denied(), paid=paid(), total_charges=money("charge_amount"), denied_charges=denied_money(), risk=money("revenue_at_risk"))


def daily_denial_trend(claims: DataFrame) -> DataFrame:
    by_day = Window.orderBy(F.col("dt").asc_nulls_last())
    rate = ratio(F.col("denied"), F.col("denied") + F.col("paid"))
    rows = _daily(claims).withColumn("denial_rate", rate)
    rolling = lambda n: F.avg("denial_rate").over(by_day.rowsBetween(-n + 1, 0))
    running = F.sum(F.col("total_charges").cast("decimal(18,2)")).over(by_day).cast("double")
    return rows.select("dt", "total_claims", "denied", "paid", "denial_rate", rolling(7).alias("rolling_7d_denial_rate"), rolling(30).alias("rolling_30d_denial_rate"), "total_charges", running.alias("cumulative_charges")).orderBy("dt")


def denial_by_payer(claims: DataFrame) -> DataFrame:
    rows = _by(claims, "payer_name", total_claims=F.count("*"), denied=denied(), paid=paid(), avg_risk_score=mean("predicted_denial_score"), denied_charges=denied_money(), total_charges=money("charge_amount"))
    rows = rows.withColumn("denial_rate", ratio(F.col("denied"), F.col("denied") + F.col("paid")))
    rows = rows.withColumns({"denied_charges_pct": F.col("denied_charges") * 100 / F.nullif("total_charges", F.lit(0.0)), "denial_rank": F.rank().over(Window.orderBy(F.col("denial_rate").desc_nulls_last()))})
    return rows.orderBy(*_last("denial_rate", "payer_name"))


def denial_by_specialty(claims: DataFrame) -> DataFrame:
    rows = _by(claims, "provider_specialty", total_claims=F.count("*"), denied=denied(), avg_risk_score=mean("predicted_denial_score"), denied_charges=denied_money())
    rows = rows.withColumn("denial_rate", ratio(F.col("denied"), F.col("total_claims")))
    return rows.withColumn("rank", F.rank().over(Window.orderBy(F.col("denial_rate").desc_nulls_last()))).orderBy(*_last("denial_rate", "provider_specialty"))


def denial_reasons(claims: DataFrame) -> DataFrame:
    rows = _by(claims.filter("denial_reason is not null"), "denial_reason", count=F.count("*"), total_charges=money("charge_amount"), avg_charge=mean("charge_amount", 2), avg_risk_score=mean("predicted_denial_score"))
    return rows.withColumn("pct_of_total", F.col("count").cast("double") * 100 / F.sum("count").over(Window.partitionBy())).orderBy(*_last("count", "denial_reason"))


def risk_score_distribution(claims: DataFrame) -> DataFrame:
    rows = claims.withColumn("score_bucket", score_bin())
    return _by(rows, "score_bucket", total=F.count("*"), actual_denied=denied(), actual_paid=paid(), pending=number(is_outcome("pending")), avg_charge=mean("charge_amount", 2)).orderBy("score_bucket")


def monthly_mom_analysis(claims: DataFrame) -> DataFrame:
    rows = _by(claims.withColumn("month", F.trunc("submission_date", "month")), "month", total_claims=F.count("*"), denied=denied(), paid=paid(), total_charges=money("charge_amount"))
    by_month = Window.orderBy(F.col("month").asc_nulls_last())
    rows = rows.withColumn("denial_rate", ratio(F.col("denied"), F.col("denied") + F.col("paid")))
    rows = rows.withColumns({"prev_denial_rate": F.lag("denial_rate").over(by_month), "prev_total_claims": F.lag("total_claims").over(by_month)})
    return rows.withColumns({"denial_rate_mom_delta": F.col("denial_rate") - F.col("prev_denial_rate"), "claims_volume_pct_change": (F.col("total_claims") - F.col("prev_total_claims")).cast("double") * 100 / F.nullif("prev_total_claims", F.lit(0))}).orderBy("month")


def payer_claimtype_crosstab(claims: DataFrame) -> DataFrame:
    rate = lambda kind: F.avg(F.when((F.lower("claim_type") == kind) & known(), F.when(is_outcome("denied"), 1.0).otherwise(0.0)))
    return _by(claims, "payer_name", professional_denial_rate=rate("professional"), institutional_denial_rate=rate("institutional"), total_claims=F.count("*"), total_denied=denied()).orderBy(*_last("total_denied", "payer_name"))


def calibration_analysis(claims: DataFrame) -> DataFrame:
    rows = _by(claims.filter(known()).withColumn("bin_lower", score_bin()), "bin_lower", n_samples=F.count("*"), mean_predicted=mean("predicted_denial_score"), d=denied())
    actual = ratio(F.col("d"), F.col("n_samples"))
    return rows.select("bin_lower", (F.col("bin_lower") + 0.1).alias("bin_upper"), "n_samples", "mean_predicted", actual.alias("actual_denial_fraction"), F.abs(F.col("mean_predicted") - actual).alias("calibration_gap"), ratio(F.col("n_samples"), F.sum("n_samples").over(Window.partitionBy())).alias("bin_weight")).orderBy("bin_lower")


def nlp_feature_impact(claims: DataFrame) -> DataFrame:
    needed = ["claim_id", "documents_medical_necessity", "mentions_lack_of_pre_auth", "predicted_denial_score", "adjudication_outcome"]
    ranked = global_rank(cut(claims.select(*needed)), "documents_medical_necessity", "claim_id", ntiles=4, prefix="necessity_").withColumnRenamed("necessity_ntile", "necessity_quartile")
    return _by(ranked.filter(known()), "necessity_quartile", "mentions_lack_of_pre_auth", total=F.count("*"), denied=denied(), denial_rate=ratio(denied(), F.count("*")), avg_necessity_score=mean("documents_medical_necessity"), avg_risk_score=mean("predicted_denial_score")).orderBy("necessity_quartile", "mentions_lack_of_pre_auth")


def confusion_matrix_stats(claims: DataFrame, threshold: float = 0.5) -> DataFrame:
    label = confusion_label(threshold)
    rows = claims.filter(known()).agg(*(F.coalesce(number(label == k.upper()), F.lit(0)).alias(k) for k in ("tp", "fp", "tn", "fn")), F.count("*").alias("total"))
    one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    rows = rows.withColumns({"precision": F.col("tp") / one(F.col("tp") + F.col("fp")), "recall": F.col("tp") / one(F.col("tp") + F.col("fn")), "accuracy": (F.col("tp") + F.col("tn")) / one(F.col("total"))})
    return rows.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def payer_cohort_analysis(claims: DataFrame) -> DataFrame:
    """First against later claims of each payer. The first is found by a least value, not by numbering a payer's claims."""
    first = claims.groupBy("payer_name").agg(F.min(F.struct("submission_date", "claim_id")).alias("first")).select(F.col("payer_name").alias("_payer"), F.col("first.claim_id").alias("_first"))
    rows = claims.join(first, F.col("payer_name").eqNullSafe(F.col("_payer")))
    rows = rows.withColumn("cohort", F.when(F.col("claim_id") == F.col("_first"), "First Claim").otherwise("Repeat Claim"))
    return _by(rows.filter(known()), "cohort", total=F.count("*"), denied=denied(), denial_rate=ratio(denied(), F.count("*")), avg_charge=mean("charge_amount", 2))


def comorbidity_denial_analysis(claims: DataFrame) -> DataFrame:
    rows = claims.filter(known()).withColumn("comorbidity_group", comorbidity_group())
    out = _by(rows, "comorbidity_group", total_claims=F.count("*"), denied=denied(), denial_rate=ratio(denied(), F.count("*")), avg_charge=mean("charge_amount", 2), avg_risk_score=mean("predicted_denial_score"), least=F.min("comorbidity_risk_score"))
    return out.orderBy("least").drop("least")


# Queries with all claims as denominator


def provider_performance(claims: DataFrame, top_n: int = 20) -> DataFrame:
    keys = ["provider_npi", "provider_specialty", "provider_state"]
    rows = _by(claims, *keys, total_claims=F.count("*"), denied=denied(), avg_risk_score=mean("predicted_denial_score"), total_charges=money("charge_amount"), denied_charges=denied_money()).filter("total_claims >= 3")
    rows = rows.withColumn("denial_rate", ratio(F.col("denied"), F.col("total_claims")))
    rows = rows.withColumn("tie", F.concat_ws("|", *(F.coalesce(k, F.lit("~")) for k in keys)))
    ranked = global_rank(rows, "denial_rate", "tie").withColumnRenamed("percent_rank", "denial_rate_percentile")
    return ranked.orderBy(F.col("denial_rate").desc_nulls_last(), "tie").limit(top_n).drop("tie")


def high_risk_claims(claims: DataFrame, threshold: float = 0.70, limit: int = 100) -> DataFrame:
    age = age_years(F.col("date_of_birth"), F.col("submission_date")).alias("patient_age")
    columns = ["claim_id", "submission_date", "payer_name", "provider_specialty", "provider_state", "claim_type", "admission_type", age, "comorbidity_risk_score", "length_of_stay", "charge_amount", F.col("predicted_denial_score").alias("denial_score"), "documents_medical_necessity", "mentions_lack_of_pre_auth", "score_quality_flag", "adjudication_outcome"]
    rows = claims.filter((F.col("predicted_denial_score") >= threshold) & is_outcome("pending"))
    return rows.orderBy(F.col("predicted_denial_score").desc(), "claim_id").limit(limit).select(*columns)


def admission_type_analysis(claims: DataFrame) -> DataFrame:
    return _by(claims, "admission_type", total_claims=F.count("*"), denied=denied(), denial_rate=ratio(denied(), F.count("*")), avg_charge=mean("charge_amount", 2), avg_risk_score=mean("predicted_denial_score"), avg_los=mean("length_of_stay"), avg_comorbidity=mean("comorbidity_risk_score")).orderBy(*_last("denial_rate", "admission_type"))


def cumulative_revenue_at_risk(claims: DataFrame) -> DataFrame:
    by_day = Window.orderBy(F.col("dt").asc_nulls_last())
    running = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).over(by_day).cast("double")
    return _daily(claims).select("dt", F.col("denied_charges").alias("daily_denied_charges"), F.col("total_charges").alias("daily_total_charges"), running("denied_charges").alias("cumulative_denied_charges"), running("total_charges").alias("cumulative_total_charges")).orderBy("dt")


def state_denial_heatmap(claims: DataFrame) -> DataFrame:
    return _by(claims.withColumnRenamed("provider_state", "state"), "state", total_claims=F.count("*"), denied=denied(), denial_rate=ratio(denied(), F.count("*")), total_charges=money("charge_amount"), denied_charges=denied_money()).orderBy(*_last("denial_rate", "state"))


def rolling_denial_trend(claims: DataFrame) -> DataFrame:
    week = Window.orderBy(F.col("dt").asc_nulls_last()).rowsBetween(-6, 0)
    rows = _daily(claims).withColumn("daily_denial_rate", ratio(F.col("denied"), F.col("total_claims")))
    return rows.select(F.col("dt").alias("day"), "total_claims", F.col("denied").alias("denied_claims"), "daily_denial_rate", F.avg("daily_denial_rate").over(week).alias("rolling_7d_denial_rate"), F.sum(F.col("risk").cast("decimal(18,2)")).over(week).cast("double").alias("rolling_7d_revenue_risk"), F.col("total_charges").alias("total_charge"), F.col("risk").alias("revenue_at_risk")).orderBy("day")


def payer_ranking(claims: DataFrame) -> DataFrame:
    rows = _by(claims, "payer_name", total_claims=F.count("*"), denied=denied(), avg_score=mean("predicted_denial_score"), revenue_at_risk=money("revenue_at_risk"), avg_charge=mean("charge_amount", 2))
    most = Window.orderBy(F.col("denied").desc())
    return rows.withColumns({"denial_rank": F.rank().over(most), "denial_pct_rank": F.percent_rank().over(most), "risk_rank": F.dense_rank().over(Window.orderBy(F.col("revenue_at_risk").desc())), "denial_quartile": F.ntile(4).over(Window.orderBy(F.col("denied").desc(), F.col("payer_name")))}).orderBy("denial_rank", "payer_name")


def monthly_cohort(claims: DataFrame) -> DataFrame:
    rows = _by(claims.withColumn("month", F.trunc("submission_date", "month")), "month", "payer_name", "claim_type", claims=F.count("*"), denials=denied(), total_charge=money("charge_amount"), revenue_risk=money("revenue_at_risk"), avg_denial_score=mean("predicted_denial_score"), avg_necessity_score=mean("documents_medical_necessity"))
    own = Window.partitionBy("payer_name", "claim_type").orderBy("month")
    rows = rows.withColumns({"denial_rate": ratio(F.col("denials"), F.col("claims")), "prev_month_claims": F.lag("claims").over(own), "prev_month_denials": F.lag("denials").over(own)})
    change = lambda c: (F.col(c) - F.coalesce(f"prev_month_{c}", c)).cast("double") / F.nullif(f"prev_month_{c}", F.lit(0))
    return rows.withColumns({"mom_claims_change": change("claims"), "mom_denial_change": change("denials")}).orderBy(F.col("month").desc(), "payer_name", "claim_type")


def high_risk_decile(claims: DataFrame, outstanding_only: bool = False, limit: int = 200) -> DataFrame:
    rows = claims.filter(is_outcome("paid") | F.col("adjudication_outcome").isNull()) if outstanding_only else claims
    risk = rows.groupBy("payer_name").agg(money("revenue_at_risk").alias("payer_total_risk")).withColumnRenamed("payer_name", "_payer")
    columns = ["claim_id", "submission_date", "payer_name", "provider_specialty", "principal_icd10", "diagnosis_description", "charge_amount", "predicted_denial_score", "revenue_at_risk", "mentions_lack_of_pre_auth", "documents_medical_necessity", "denial_reason"]
    # each rank from two columns only, so that their plans stand side by side and don't grow into each other
    narrow = cut(rows.select("claim_id", "predicted_denial_score", "charge_amount"))
    rank = lambda value, **how: global_rank(narrow.select("claim_id", value), value, "claim_id", **how)
    top = rank("predicted_denial_score", descending=True, ntiles=10).filter("ntile = 1").select("claim_id", F.col("ntile").alias("score_decile"))
    score = rank("predicted_denial_score").select("claim_id", F.col("percent_rank").alias("score_pctrank"))
    charge = rank("charge_amount").select("claim_id", F.col("percent_rank").alias("charge_pctrank"))
    ranked = rows.select(*columns).join(top, "claim_id").join(score, "claim_id").join(charge, "claim_id")
    out = ranked.join(risk, F.col("payer_name").eqNullSafe(F.col("_payer"))).drop("_payer")
    return out.orderBy(F.col("predicted_denial_score").desc(), F.col("charge_amount").desc(), "claim_id").limit(limit)


def specialty_analysis(claims: DataFrame) -> DataFrame:
    rows = _by(claims, "provider_specialty", total_claims=F.count("*"), denied=denied(), avg_comorbidity=mean("comorbidity_risk_score"), avg_los=mean("length_of_stay"), revenue_at_risk=money("revenue_at_risk"), avg_necessity=mean("documents_medical_necessity"))
    running = Window.orderBy(F.col("revenue_at_risk").desc(), F.col("provider_specialty").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"denial_rate": ratio(F.col("denied"), F.col("total_claims")), "denial_rank": F.rank().over(Window.orderBy(F.col("denied").desc())), "cumulative_revenue_risk": F.sum(F.col("revenue_at_risk").cast("decimal(18,2)")).over(running).cast("double")}).orderBy("denial_rank", "provider_specialty")


def model_performance(claims: DataFrame) -> DataFrame:
    rows = _by(claims.withColumn("classification", confusion_label()), "classification", count=F.count("*"), total_charge=money("charge_amount"), revenue_at_risk=money("revenue_at_risk"))
    return rows.withColumn("pct_of_total", F.col("count").cast("double") * 100 / F.sum("count").over(Window.partitionBy())).orderBy("classification")


def icd10_hotspots(claims: DataFrame) -> DataFrame:
    rows = _by(claims, "principal_icd10", "diagnosis_description", total=F.count("*"), denied=denied(), avg_score=mean("predicted_denial_score"), revenue_at_risk=money("revenue_at_risk"))
    all_risk = F.sum(F.col("revenue_at_risk").cast("decimal(18,2)")).over(Window.partitionBy()).cast("double")
    return rows.withColumns({"denial_rate": ratio(F.col("denied"), F.col("total")), "denial_rank": F.rank().over(Window.orderBy(F.col("denied").desc())), "pct_total_risk": F.col("revenue_at_risk") * 100 / F.nullif(all_risk, F.lit(0.0))}).orderBy("denial_rank", "principal_icd10", "diagnosis_description")


def score_bucket_distribution(claims: DataFrame) -> DataFrame:
    return _by(claims.withColumn("score_bucket", score_band()), "score_bucket", total=F.count("*"), actual_denied=denied(), actual_denial_rate=ratio(denied(), F.count("*"))).orderBy("score_bucket")


def provider_summary(claims: DataFrame) -> DataFrame:
    rows = _by(claims, "provider_specialty", "department", claims=F.count("*"), denied=denied(), avg_charge=mean("charge_amount", 2), total_risk=money("revenue_at_risk"))
    own = Window.partitionBy("department")
    return rows.withColumns({"denial_rate": ratio(F.col("denied"), F.col("claims")), "highest_risk_specialty_in_dept": F.first("provider_specialty").over(own.orderBy(F.col("denied").desc(), F.col("provider_specialty").asc_nulls_last())), "dept_total_risk": F.sum(F.col("total_risk").cast("decimal(18,2)")).over(own).cast("double")}).orderBy("department", F.col("denied").desc())


def preauth_impact(claims: DataFrame) -> DataFrame:
    return _by(claims, "mentions_lack_of_pre_auth", total=F.count("*"), denied=denied(), denial_rate=ratio(denied(), F.count("*")), avg_charge=mean("charge_amount", 2), revenue_at_risk=money("revenue_at_risk")).orderBy(F.col("mentions_lack_of_pre_auth").desc())


# Tables behind the pages


def payer_stats(claims: DataFrame) -> DataFrame:
    rows = _by(claims, "payer_name", total_claims=F.count("claim_id"), total_denied=denied(), total_predicted_denied=number(predicted()), avg_charge=mean("charge_amount", 2), total_revenue_at_risk=money("revenue_at_risk"), avg_denial_score=mean("predicted_denial_score"))
    return rows.withColumns({"actual_denial_rate": ratio(F.col("total_denied"), F.col("total_claims")), "predicted_denial_rate": ratio(F.col("total_predicted_denied"), F.col("total_claims"))}).orderBy(*_last("total_revenue_at_risk", "payer_name"))


def denial_reason_stats(claims: DataFrame) -> DataFrame:
    return _by(claims.filter(is_outcome("denied") & F.col("denial_reason").isNotNull()), "denial_reason", count=F.count("claim_id"), avg_charge=mean("charge_amount", 2)).orderBy(*_last("count", "denial_reason"))


def executive_kpis(claims: DataFrame) -> DataFrame:
    tp, fp = number(predicted() & is_outcome("denied")), number(predicted() & is_outcome("paid"))
    return claims.agg(F.count("*").alias("total"), denied().alias("denied"), number(predicted()).alias("pred_denied"), money("revenue_at_risk").alias("revenue_risk"), mean("predicted_denial_score").alias("avg_score"), F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision"), ratio(denied(), F.count("*")).alias("denial_rate"))


def monthly_rollup(claims: DataFrame) -> DataFrame:
    rows = monthly_cohort(claims).withColumn("month_str", F.date_format("month", "yyyy-MM"))
    out = rows.groupBy("month_str").agg(F.sum("claims").alias("total_claims"), F.sum("denials").alias("total_denials"), money("total_charge").alias("total_charge"), money("revenue_risk").alias("revenue_risk"))
    return out.withColumn("denial_rate", F.col("total_denials").cast("double") / F.when(F.col("total_claims") == 0, 1).otherwise(F.col("total_claims"))).orderBy("month_str")


def score_histogram(claims: DataFrame, bins: int = 40) -> DataFrame:
    return claims.groupBy(score_bin(bins=bins).alias("bin"), "adjudication_outcome").agg(F.count("*").alias("count")).orderBy("bin", "adjudication_outcome")


def model_comparison(metrics: DataFrame, id_col: str = "version") -> DataFrame:
    """(version, metric, value) from one row a version."""
    return metrics.unpivot([id_col], [c for c in metrics.columns if c != id_col], "metric", "value")


# Presets of the SQL page


def preset_rolling_7d(claims: DataFrame) -> DataFrame:
    return rolling_denial_trend(claims).select("day", F.col("total_claims").alias("total"), F.col("denied_claims").alias("denied"), F.col("rolling_7d_denial_rate").alias("rolling_7d_rate"))


def preset_top_payers(claims: DataFrame, n: int = 5) -> DataFrame:
    return _by(claims, "payer_name", claims=F.count("*"), revenue_at_risk=money("revenue_at_risk"), denial_rate=ratio(denied(), F.count("*"))).orderBy(*_last("revenue_at_risk", "payer_name")).limit(n)


def preset_payer_quartiles(claims: DataFrame) -> DataFrame:
    return payer_ranking(claims).select("payer_name", "denied", "denial_rank", F.col("denial_quartile").alias("quartile"))


def preset_monthly_change(claims: DataFrame) -> DataFrame:
    rows = _by(claims.withColumn("month", F.trunc("submission_date", "month")), "month", claims=F.count("*"), denied=denied())
    rows = rows.withColumns({"denial_rate": ratio(F.col("denied"), F.col("claims")), "prev_denied": F.lag("denied").over(Window.orderBy("month"))})
    return rows.withColumn("mom_change", ratio(F.col("denied") - F.col("prev_denied"), F.col("prev_denied"))).orderBy("month")


def preset_score_calibration(claims: DataFrame) -> DataFrame:
    return _by(claims.withColumn("score_bin", score_bin()), "score_bin", claims=F.count("*"), actual_denied=denied(), actual_denial_rate=ratio(denied(), F.count("*"))).orderBy("score_bin")


def preset_high_risk(claims: DataFrame, limit: int = 50) -> DataFrame:
    rows = cut(claims.select("claim_id", "payer_name", "provider_specialty", "charge_amount", "predicted_denial_score"))
    rows = global_rank(rows, "predicted_denial_score", "claim_id")
    rows = global_rank(rows, "predicted_denial_score", "claim_id", descending=True, ntiles=10, prefix="down_").filter("down_ntile = 1")
    return rows.withColumnsRenamed({"percent_rank": "pct_rank", "down_ntile": "risk_decile"}).drop("down_percent_rank").orderBy(F.col("predicted_denial_score").desc(), "claim_id").limit(limit)


def preset_cumulative_risk(claims: DataFrame) -> DataFrame:
    return specialty_analysis(claims).select("provider_specialty", F.col("revenue_at_risk").alias("specialty_risk"), F.col("cumulative_revenue_risk").alias("cumulative_risk")).orderBy(F.col("specialty_risk").desc())


def preset_icd10_top_payer(claims: DataFrame) -> DataFrame:
    each = _by(claims, "principal_icd10", "payer_name", n=F.count("*"), d=denied())
    top = F.min(F.struct((-F.col("d")).alias("d"), F.col("payer_name")))["payer_name"]
    rows = each.groupBy("principal_icd10").agg(F.sum("n").alias("total"), F.sum("d").alias("denied"), top.alias("top_payer"))
    return rows.withColumn("denial_rate", ratio(F.col("denied"), F.col("total"))).orderBy(*_last("denied", "principal_icd10"))


QUERIES = (
    kpi_summary, daily_denial_trend, denial_by_payer, denial_by_specialty, denial_reasons, risk_score_distribution, monthly_mom_analysis, provider_performance, payer_claimtype_crosstab, high_risk_claims,
    calibration_analysis, admission_type_analysis, cumulative_revenue_at_risk, state_denial_heatmap, nlp_feature_impact, confusion_matrix_stats, payer_cohort_analysis, comorbidity_denial_analysis,
    rolling_denial_trend, payer_ranking, monthly_cohort, high_risk_decile, specialty_analysis, model_performance, icd10_hotspots, score_bucket_distribution, provider_summary, preauth_impact,
    payer_stats, denial_reason_stats, executive_kpis, monthly_rollup, score_histogram,
    preset_rolling_7d, preset_top_payers, preset_payer_quartiles, preset_monthly_change, preset_score_calibration, preset_high_risk, preset_cumulative_risk, preset_icd10_top_payer,
)


def run_all(claims: DataFrame) -> dict[str, DataFrame]:
    """The ten queries of the analytics page, over one written copy of the view."""
    claims = cut(claims)
    names = (rolling_denial_trend, payer_ranking, monthly_cohort, high_risk_decile, specialty_analysis, model_performance, icd10_hotspots, score_bucket_distribution, provider_summary, preauth_impact)
    return {f.__name__: f(claims) for f in names}
