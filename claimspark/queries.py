"""The registered queries of the claims library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions import scalars as S
from claimspark.operators import analytics, features, monitoring, notes, scoring, training
from claimspark.plans import exchange, intake, models, windows
from claimspark.plans.joins import keyed_upsert, longest_prefix
from claimspark.plans.oracle import analytics_sql
from claimspark.plans.oracle_features import NUMERIC, SQL
from claimspark.plans.views import claims_view, cut, shared_checkpoints, stored, table

Query = Callable[[SparkSession, str], DataFrame]

WEIGHTS = {"comorbidity_risk_score": 0.05, "mentions_lack_of_pre_auth": 0.3, "documents_medical_necessity": 0.4}
CONTRACTS = [("AUTOMOBILE", "1992-01-01", "1996-12-31", True), ("AUTOMOBILE", "1995-06-01", None, False), ("BUILDING", "1994-01-01", None, True), ("FURNITURE", "1992-01-01", "1993-12-31", True), ("FURNITURE", "1993-06-01", "1995-12-31", True)]
PREFIXES = [("BRAND#1", 1), ("BRAND#12", 2), ("BRAND#2", 1), ("BRAND#34", 3), ("BRAND#5", 6)]


def contracts(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CONTRACTS, "payer_name string, a string, b string, stop_loss boolean")
    return rows.select("payer_name", F.col("a").cast("date").alias("start"), F.col("b").cast("date").alias("end"), "stop_loss")


def era(spark: SparkSession, sf_dir: str, claims: DataFrame | None = None) -> DataFrame:
    """Remittances: a line's payer is that of its order, its shipping date the payment date; returned lines are denied."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("payment_date"), F.when(F.col("l_returnflag") == "R", "denied").otherwise("paid").alias("status"))
    claims = (claims_view(spark, sf_dir) if claims is None else claims).select("claim_id", "payer_name")
    return lines.withColumn("claim_id", F.concat(F.lit("CLM-"), F.col("l_orderkey").cast("string"))).join(claims, "claim_id").select("claim_id", "payer_name", "payment_date", "status")


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as their encounters."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("patient_account_number"), F.col("o_orderkey").alias("encounter_id"), F.col("o_orderdate").cast("date").alias("encounter_date"), F.col("o_orderpriority").alias("admitting_department"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("claim_id", F.concat(F.lit("CLM-"), F.col("l_orderkey").cast("string")))


def claim_level_features(spark, sf_dir):
    return features.claim_level(claims_view(spark, sf_dir))


def provider_features(spark, sf_dir):
    return features.provider(claims_view(spark, sf_dir)).drop("provider_npi")


def payer_features(spark, sf_dir):
    return features.payer(claims_view(spark, sf_dir), era(spark, sf_dir), contracts(spark))


def unknown_payers(spark, sf_dir):
    return features.unknown_payers(claims_view(spark, sf_dir), contracts(spark))


def anchored_provider_rates(spark, sf_dir):
    return windows.anchored_rates(claims_view(spark, sf_dir), "provider_npi", "1998-03-01", 30, 0.0)


def encounter_link(spark, sf_dir):
    return features.link_encounters(claims_view(spark, sf_dir).select("claim_id", "patient_account_number", "submission_date"), encounters(spark, sf_dir))


def encounter_attach(spark, sf_dir):
    rows = features.attach_encounters(encounter_link(spark, sf_dir), encounters(spark, sf_dir))
    return rows.select("claim_id", "encounter_id", "encounter_date", "admitting_department")


def outcome_link(spark, sf_dir):
    store = claims_view(spark, sf_dir).filter("claim_status = 'Active'").select("claim_id", "payer_name", "adjudication_outcome")
    rows = era(spark, sf_dir).select("claim_id", F.col("status").alias("adjudication_status"), F.col("payment_date").alias("processed"))
    return features.link_outcomes(store, rows)


def score_writeback(spark, sf_dir):
    claims = claims_view(spark, sf_dir)
    store = claims.select("claim_id", "claim_status", "predicted_denial_score")
    return scoring.write_scores(store, scoring.linear_score(scoring.active(claims), WEIGHTS).select("claim_id", "predicted_denial_score"))


def score_run_stats(spark, sf_dir):
    scored = scoring.linear_score(scoring.active(claims_view(spark, sf_dir)), WEIGHTS)
    return scoring.run_stats(scored)


def feature_upsert(spark, sf_dir):
    claims = claims_view(spark, sf_dir)
    store = claims.filter("comorbidity_risk_score < 6").select("claim_id", "payer_name", "denial_reason")
    new = claims.filter("comorbidity_risk_score >= 4").select("claim_id", F.lit(None).cast("string").alias("denial_reason"), "department")
    return keyed_upsert(store, new, "claim_id")


def deleted_rows(spark, sf_dir):
    claims = claims_view(spark, sf_dir)
    return scoring.delete_rows(claims, scoring.active(claims)).select("claim_id", "claim_status")


def procedure_vectors(spark, sf_dir):
    codes = _lines(spark, sf_dir).select("claim_id", (F.col("l_partkey") % 40).cast("string").alias("cpt"))
    table_ = spark.range(30).select(F.col("id").cast("string").alias("cpt"), F.col("id").cast("int").alias("idx"))
    out = features.procedure_vector(claims_view(spark, sf_dir), codes, table_)
    return out.select("claim_id", F.array_join("procedure_vector", "").alias("bits"))


def comorbidity_scores(spark, sf_dir):
    brands = _lines(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("claim_id", F.col("p_brand").alias("code"))
    return features.comorbidity(claims_view(spark, sf_dir), brands, spark.createDataFrame(PREFIXES, "prefix string, weight int"))


def prefix_matches(spark, sf_dir):
    codes = claims_view(spark, sf_dir).filter("principal_icd10 is not null").select("claim_id", S.norm_icd10(F.col("principal_icd10")).alias("code"))
    # a code is matched once, not once a claim
    matched = longest_prefix(codes.select("code").distinct(), "code", spark.createDataFrame(PREFIXES, "prefix string, weight int"))
    return codes.join(matched, "code").select("claim_id", "code", "prefix", "weight")


def _provider_tables(spark):
    taxonomy = spark.range(10).select(F.concat(F.lit("NPI-"), F.col("id").cast("string")).alias("npi"), F.when(F.col("id") < 3, F.concat(F.lit("T"), F.col("id").cast("string"))).when(F.col("id") == 3, F.lit("  ")).alias("code"))
    facility = spark.range(4).select(F.concat(F.lit("NPI-"), F.col("id").cast("string")).alias("npi"), (F.lit(100) + (F.col("id") / 2).cast("int")).alias("bed_size"))
    return taxonomy, facility


def provider_lookups(spark, sf_dir):
    return features.provider_facility(claims_view(spark, sf_dir), *_provider_tables(spark))


def filtered_claims(spark, sf_dir):
    return analytics.filter_claims(claims_view(spark, sf_dir), ["BUILDING", "FURNITURE"], ["Professional"], 0.2, 0.8, "1994-01-01", "1997-06-30").select("claim_id", "payer_name", "predicted_denial_score")


def missing_features(spark, sf_dir):
    columns = ("date_of_birth", "provider_npi", "denial_reason")
    return claims_view(spark, sf_dir).select("claim_id", features.quality_flag(columns).alias("score_quality"))


def prepared_notes(spark, sf_dir):
    rows = notes.prepare_notes(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])
    return rows.select("conv_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def phrase_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.phrase_flag(F.col("text"), (r"licensed\s+under", r"released\s+under\s+the", r"all\s+rights")).alias("flag"))


def necessity_scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.necessity_score(F.transform("embedding", lambda x: F.abs(x))).alias("score"))


def _labelled(spark, sf_dir):
    return training.labelled(claims_view(spark, sf_dir)).select("claim_id", "submission_date", "label", F.col("predicted_denial_score").alias("score"))


def training_window(spark, sf_dir):
    rows = training.labelled(claims_view(spark, sf_dir)).filter(training.in_window("1998-03-01", 90))
    return rows.select("claim_id", "submission_date", "label")


def temporal_split(spark, sf_dir):
    return training.temporal_split(_labelled(spark, sf_dir)).select("claim_id", "label", "split")


def temporal_split3(spark, sf_dir):
    return training.temporal_split3(_labelled(spark, sf_dir)).select("claim_id", "split")


def split_statistics(spark, sf_dir):
    return training.split_stats(training.temporal_split(_labelled(spark, sf_dir)))


def class_weights(spark, sf_dir):
    return training.class_weight(_labelled(spark, sf_dir))


def model_metrics(spark, sf_dir):
    return training.evaluate(_labelled(spark, sf_dir))


def _scored(spark, sf_dir):
    return claims_view(spark, sf_dir).withColumn("scored_date", F.col("submission_date"))


def monitoring_record(spark, sf_dir):
    return monitoring.monitor(_scored(spark, sf_dir), "1998-03-01")


def precision_history(spark, sf_dir):
    return monitoring.precision_history(_scored(spark, sf_dir))


def retention_check(spark, sf_dir):
    return monitoring.retention_check(_scored(spark, sf_dir), "1998-03-01")


def failure_streaks(spark, sf_dir):
    """Orders of a customer as training runs: F failed, P archived, O staged."""
    stage = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "P", "Archived").otherwise("Staging")
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("run_id"), stage.alias("stage"))
    return monitoring.failure_streak(runs)


def feature_table(spark, sf_dir):
    """All 37 numeric features, the specialty and the procedure vector."""
    # what no feature is made of, and what the clinical features replace, isn't stored
    view = claims_view(spark, sf_dir).drop("patient_account_number", "provider_specialty", "provider_state", "department", "diagnosis_description", "charge_amount", "predicted_denial_score", "denial_reason", "score_quality_flag", "revenue_at_risk", *features.CLINICAL)
    codes = _codes_of_claims(spark, sf_dir)
    claims = stored(view.join(codes, "claim_id", "left").withColumns({"principal_icd10_code": F.col("principal_icd10"), "admission_date": F.col("submission_date")}))

    def within(rows: DataFrame) -> DataFrame:
        rows = features.clinical_rows(rows, claims, *_clinical_tables(spark, sf_dir)).withColumn("procedure_vector", F.array_join("procedure_vector", ""))
        return features.bed_size(features.specialty(rows, taxonomy), facility)

    taxonomy, facility = _provider_tables(spark)
    carried = (*codes.columns[1:], "principal_icd10_code", "admission_date", "provider_npi")
    return features.feature_table(claims, era(spark, sf_dir, claims), contracts(spark), within=within, carried=carried)


def scored_claims(spark, sf_dir):
    """The whole table through the scorer, with a model that is a function of the 37 features: each counts its place in 4,096ths."""
    steps = np.arange(len(features.NUMERIC)) / 4096
    scored = scoring.score(feature_table(spark, sf_dir), lambda x: x @ steps)
    return scored.select("claim_id", F.round("predicted_denial_score", 6).alias("predicted_denial_score"), "score_quality_flag", "score_error")


def _codes_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as diagnoses, part numbers as procedures, the last shipping date as the discharge."""
    lines = _lines(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("claim_id").agg(F.collect_list("p_brand").alias("secondary_icd10_codes"), F.collect_list((F.col("l_partkey") % 40).cast("string")).alias("cpt_codes"), F.max(F.col("l_shipdate").cast("date")).alias("discharge_date"))


def _clinical_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ccs, procedures, prefixes, expected) for these codes."""
    brands = table(spark, sf_dir, "part").select(S.norm_icd10(F.col("p_brand")).alias("icd10")).distinct()
    ccs = brands.withColumn("category", F.substring("icd10", 7, 9).cast("int") % 12).filter("category % 2 = 0")
    cpt = spark.range(30).select(F.col("id").cast("string").alias("cpt"), F.col("id").cast("int").alias("idx"))
    expected = spark.range(2, 10, 2).select(F.col("id").cast("int").alias("category"), F.array(F.col("id").cast("int"), F.col("id").cast("int") + 1).alias("indices"))
    return ccs, cpt, spark.createDataFrame(PREFIXES, "prefix string, weight int"), expected


def clinical_features(spark, sf_dir):
    heads = claims_view(spark, sf_dir).select("claim_id", F.col("principal_icd10").alias("principal_icd10_code"), F.col("submission_date").alias("admission_date"))
    claims = cut(heads.join(_codes_of_claims(spark, sf_dir), "claim_id", "left"))  # read twice
    out = features.clinical(claims, *_clinical_tables(spark, sf_dir))
    return out.withColumn("procedure_vector", F.array_join("procedure_vector", ""))


def leave_last_out_rates(spark, sf_dir):
    return windows.leave_last_out(claims_view(spark, sf_dir), "provider_npi", ["submission_date", "claim_id"], "1995-06-30", 3)


def imputed_features(spark, sf_dir):
    rows = claims_view(spark, sf_dir).select("claim_id", F.nullif("comorbidity_risk_score", F.lit(3)).alias("comorbidity_risk_score"), F.when(F.col("length_of_stay") > 4, F.col("documents_medical_necessity")).alias("documents_medical_necessity"))
    return features.impute(rows)


def claim_risk(spark, sf_dir):
    rows = analytics.with_risk(claims_view(spark, sf_dir), 0.6)
    return rows.select("claim_id", "predicted_denial", "revenue_at_risk", analytics.confusion_label().alias("confusion"))


def note_flags(spark, sf_dir):
    """Conversations as the notes of claims."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("CLM-"), F.col("conv_id").cast("string")).alias("claim_id"), "turn", "text")
    out = notes.note_features(claims_view(spark, sf_dir), turns, order=("turn",))
    return out.select("claim_id", "mentions_lack_of_pre_auth", "nlp_flag")


def gate_decision(spark, sf_dir):
    return model_metrics(spark, sf_dir).select("precision", "ece", S.gate_stage(F.col("precision"), F.col("ece")).alias("stage"))


def metric_comparison(spark, sf_dir):
    rows = split_statistics(spark, sf_dir).select(F.col("split").alias("version"), "denied_share", F.col("total").cast("double").alias("total"))
    return analytics.model_comparison(rows)


def run_health(spark, sf_dir):
    """A day's claims as a run that takes a minute a claim."""
    runs = claims_view(spark, sf_dir).groupBy(F.col("submission_date").alias("run_ts")).agg(F.count("*").alias("minutes"), F.count("predicted_denial_score").alias("scored"), F.count("score_quality_flag").alias("failed"))
    return monitoring.pipeline_health(runs, 5)


def training_run(spark, sf_dir):
    """Test metrics and gate of a model of all features, with set parameters instead of a search."""
    shared_checkpoints(spark)
    return training.run_training(feature_table(spark, sf_dir), list(NUMERIC), "1995-07-31", min_records=20, params={"maxDepth": 3, "maxIter": 5}).metrics


MORE = (
    clinical_features, scored_claims, leave_last_out_rates, imputed_features, claim_risk, note_flags, gate_decision, metric_comparison, run_health, training_run,
    claim_level_features, provider_features, payer_features, unknown_payers, anchored_provider_rates, encounter_link, encounter_attach, outcome_link, score_writeback, score_run_stats, feature_upsert, deleted_rows,
    procedure_vectors, comorbidity_scores, prefix_matches, provider_lookups, filtered_claims, missing_features, prepared_notes, phrase_flags, necessity_scores, training_window, temporal_split, temporal_split3,
    split_statistics, class_weights, model_metrics, monitoring_record, precision_history, retention_check, failure_streaks, feature_table,
)


def _over_claims(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(claims_view(spark, sf_dir))


def queries() -> dict[str, Query]:
    over_features = {f.__name__: lambda spark, sf_dir, f=f: f(feature_table(spark, sf_dir)) for f in models.OVER_FEATURES}
    return {f.__name__: _over_claims(f) for f in analytics.QUERIES} | {f.__name__: f for f in (*MORE, *intake.QUERIES, *exchange.QUERIES, *models.QUERIES)} | over_features


def oracle_sql() -> dict[str, str]:
    places = " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0) * {i}" for i, c in enumerate(NUMERIC))
    vectors = f"SELECT claim_id, CAST({len(NUMERIC)} AS INTEGER) AS n, round(({places}) / 4096, 6) AS total FROM ({SQL['feature_table']}) t"
    return analytics_sql() | SQL | intake.SQL | exchange.SQL | models.SQL | {"scored_by_probability": SQL["scored_claims"], "assembled_vectors": vectors}
