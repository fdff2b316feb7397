"""Files that partner systems exchange, and stores kept by day or version: each query writes them from the star schema and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scalars import to_pretty_json
from claimspark.operators import analytics, features, scoring, training
from claimspark.plans.oracle import TEXTS, with_claims
from claimspark.plans.oracle_features import SQL as FEATURES
from claimspark.plans.views import claims_view, new_folder, register_views, run_sql, table
from claimspark.sources import ehr
from claimspark.sources.store import ClaimStore
from claimspark.streaming.incremental import fold_outcomes, linked_store, stream_outcomes


def _write_lines(rows: DataFrame, path: str, mode: str = "error", compression: str = "none") -> str:
    """One JSON document a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).option("compression", compression).text(path)
    return path


def _resource(kind: str, key: Column, start: Column, patient: Column) -> Column:
    reference = F.concat(F.lit("Patient/"), patient.cast("string")).alias("reference")
    fields = F.lit(kind).alias("resourceType"), key.cast("string").alias("id"), F.struct(start.alias("start")).alias("period"), F.struct(reference).alias("subject")
    return F.struct(F.struct(*fields).alias("resource"))


def bundle_encounters(spark, sf_dir):
    """A bundle for each order: an encounter and its patient. Some lack an id and some a date; read, then through the sink of encounters in two batches, one of them tried again."""
    key, patient, out = F.col("o_orderkey"), F.col("o_custkey"), new_folder(spark, "bundles")
    start = F.when(key % 19 == 3, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    entries = F.array(_resource("Encounter", F.when(key % 17 != 5, key), start, patient), _resource("Patient", patient, start, patient))
    _write_lines(table(spark, sf_dir, "orders").select(F.lit("Bundle").alias("resourceType"), entries.alias("entry")), f"{out}/in")
    rows = ehr.read_fhir_bundles(spark, f"{out}/in", multi_line=False)
    for half in (0, 1):
        ehr.write_ehr(rows.filter(F.crc32("encounter_id") % 2 == half), f"{out}/encounters", str(half))
    ehr.write_ehr(rows.filter(F.crc32("encounter_id") % 2 == 1), f"{out}/encounters", "1")  # tried again
    return spark.read.parquet(f"{out}/encounters").select("encounter_id", "encounter_date", "patient_account_number")


def remittance_lines(spark, sf_dir):
    """A remittance for each order, with its lines as claims; some have no date that can be read."""
    denied = F.col("l_returnflag") == "R"
    status = F.when(denied, "denied").otherwise("paid").alias("adjudication_status")
    claim = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), status, F.when(~denied, F.col("l_extendedprice")).alias("paid_amount"), F.when(denied, "returned").alias("denial_reason"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("day"), F.collect_list(claim).alias("claims"))
    date = F.when(F.col("l_orderkey") % 21 == 4, "unknown").otherwise(F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss"))
    path = _write_lines(rows.select(date.alias("transaction_date"), F.concat(F.lit("P"), F.col("l_orderkey") % 7).alias("payer_id"), "claims"), new_folder(spark, "remittances"))
    return ehr.read_era(spark, path, multi_line=False)


def partial_records(spark, sf_dir):
    """Claims as encounter records that have no column for race, with the names of what they lack."""
    fields = {
        "age": F.year("date_of_birth"), "sex": F.col("gender"), "ethnicity": F.when(F.col("length_of_stay") % 3 != 0, "known"), "vitals": F.when(F.col("charge_amount") >= 100000, "taken"),
        "lab_results": F.col("denial_reason"), "problem_list": F.col("principal_icd10"), "medications": F.col("admission_type"), "admitting_department": F.col("department"),
        "admitting_physician_id": F.col("provider_npi"), "length_of_stay_days": F.nullif("length_of_stay", F.lit(0)),
    }
    rows = claims_view(spark, sf_dir).select("claim_id", *(c.alias(name) for name, c in fields.items()))
    return ehr.partial_ehr_flag(rows).select("claim_id", "partial_ehr_flag")


def _notes(spark, sf_dir) -> DataFrame:
    """Turns of conversations as notes of four types, one of them unknown."""
    kind = F.element_at(F.array(*map(F.lit, (" Discharge_Summary ", "progress_note", "OPERATIVE_REPORT", "letter"))), (F.col("turn") % 4 + 1).cast("int"))
    visit = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int"))
    day = F.when(F.col("conv_id") % 3 != 0, F.date_add(visit, 1))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind.alias("note_type"), visit.alias("encounter_date"), day.alias("note_date"))
    return rows.withColumns({"note_datetime": F.when(F.col("conv_id") % 2 == 0, F.lit("2024-06-01 10:00:00").cast("timestamp")), "author_id": F.when(F.col("turn") % 2 == 0, F.lit("A"))})


def clinical_notes(spark, sf_dir):
    rows = ehr.normalize_notes(_notes(spark, sf_dir))
    return rows.select("conv_id", "turn", "note_type", "note_date", F.date_format("note_datetime", "yyyy-MM-dd HH:mm").alias("written"), "author_id")


def attached_notes(spark, sf_dir):
    """Claims with the notes of the conversation that has their order's key."""
    notes = ehr.normalize_notes(_notes(spark, sf_dir)).withColumnRenamed("conv_id", "encounter_id")
    linked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("encounter_id"))
    rows = features.attach_notes(linked, notes, order=("turn",), columns=("note_type", "author_id"))
    return rows.select("claim_id", F.array_join(F.transform("clinical_notes", lambda n: F.concat_ws(":", n["note_type"], n["author_id"])), ",").alias("notes"))


def replaced_days(spark, sf_dir):
    """Orders counted by month; the months of one year are written once more, tenfold."""
    out = new_folder(spark, "days")
    counts = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("day")).agg(F.count("*").alias("n"))
    scoring.write_by_day(counts, out, "day")
    scoring.write_by_day(counts.filter("year(day) = 1995").withColumn("n", F.col("n") * 10), out, "day")
    return spark.read.parquet(out).select("day", "n")


MIGRATIONS = {
    ("1.0", "2.0"): lambda df: df.withColumn("total", F.col("total") + 1),
    ("2.0", "3.0"): lambda df: df.withColumn("total", F.col("total") * 2),
}


def migrated_rows(spark, sf_dir):
    """Orders of four schema versions and of none, at version 3.0 or in quarantine."""
    key = F.col("o_orderkey")
    version = F.when(key % 5 == 0, "1.0").when(key % 5 == 1, "2.0").when(key % 5 == 2, "3.0").when(key % 5 == 3, "0.5")
    rows = table(spark, sf_dir, "orders").select(key.cast("string").alias("claim_id"), F.col("o_totalprice").alias("total"), version.alias("schema_version"))
    good, bad = scoring.migrate(rows, MIGRATIONS, "3.0")
    return good.unionByName(bad, allowMissingColumns=True).select("claim_id", "total", "schema_version", "embedded_version", "current_version")


def stored_lines(spark, sf_dir):
    """Orders as JSON lines, some cut off and some blank: the rows, and the text of those that can't be read."""
    key = F.col("o_orderkey")
    whole = F.to_json(F.struct(key.cast("string").alias("claim_id"), F.col("o_totalprice").alias("total")))
    out = new_folder(spark, "lines")
    table(spark, sf_dir, "orders").select(F.when(key % 23 == 9, F.substring(whole, 1, 10)).when(key % 29 == 1, "  ").otherwise(whole).alias("value")).write.text(out)
    good, bad = scoring.read_rows(spark, out, "claim_id string, total double")
    return good.withColumn("rejected", F.lit(None).cast("string")).unionByName(bad.toDF("rejected"), allowMissingColumns=True)


def pretty_customers(spark, sf_dir):
    return to_pretty_json(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey")))


def ad_hoc_totals(spark, sf_dir):
    """A text of a user over the registered view."""
    text = "SELECT payer_name, claim_type, count(*) AS n, max(predicted_denial_score) AS top FROM {claims} GROUP BY ALL"
    return run_sql(spark, text, register_views(spark, sf_dir))


def exported_claims(spark, sf_dir):
    columns, out = "claim_id string, payer_name string, charge_amount double, denial_reason string", new_folder(spark, "csv")
    analytics_rows = claims_view(spark, sf_dir).select("claim_id", "payer_name", "charge_amount", "denial_reason")
    ehr.export_csv(analytics_rows, out)
    return spark.read.schema(columns).option("header", True).csv(out)


def lake_months(spark, sf_dir):
    """Orders in the lake's raw layer, in two batches, filed under the first day of their month."""
    lake = ehr.LakeLayout(new_folder(spark, "lake"))
    rows = table(spark, sf_dir, "orders").withColumn("ingestion_date", F.trunc("o_orderdate", "month"))
    for batch in ("1", "2", "1"):  # the first is tried again
        lake.write(rows.filter(F.col("o_orderkey") % 2 == int(batch) - 1), "raw", batch=batch)
    return spark.read.parquet(lake.path("raw")).groupBy("year", "month", "day").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))


def page_rows(spark, sf_dir):
    """How many rows each query of the analytics page has."""
    out = None
    for name, rows in analytics.run_all(claims_view(spark, sf_dir)).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("query"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def presented_payers(spark, sf_dir):
    return analytics.present(analytics.payer_stats(claims_view(spark, sf_dir)))


def widened_window(spark, sf_dir):
    """Labelled claims of 60 days, or of 720 where these are under 20."""
    return training.select_window(claims_view(spark, sf_dir), "1998-03-01", 20, 60, 720).select("claim_id", "submission_date", "label")


def _remittances(spark, sf_dir) -> list[DataFrame]:
    """Three parts of remittances, each row twice: those of the last years first, and the oldest last."""
    status = F.when(F.col("l_returnflag") == "R", "denied").otherwise("paid").alias("adjudication_status")
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("CLM-"), F.col("l_orderkey")).alias("claim_id"), status, F.col("l_shipdate").alias("processed"))
    parts = ("processed >= '1997-01-01'", "processed >= '1994-01-01' and processed < '1997-01-01'", "processed < '1994-01-01'")
    return [lines.unionAll(lines).filter(part) for part in parts]


def _streamed(spark, sf_dir, out: str, after) -> None:  # noqa: ANN001
    """The remittances through the stream, part by part, and ``after`` each of them. Their files are written once, where the stream finds them, and compressed."""
    for number, part in enumerate(_remittances(spark, sf_dir)):
        _write_lines(part, f"{out}/era", "append", "gzip")
        stream_outcomes(spark, f"{out}/era", f"{out}/changes", f"{out}/checkpoint", files_per_batch=3 + number).awaitTermination()
        after()


def _active(spark, sf_dir, *columns: str) -> DataFrame:
    return claims_view(spark, sf_dir).filter("claim_status = 'Active'").select("claim_id", "payer_name", "adjudication_outcome", *columns)


def streamed_outcomes(spark, sf_dir):
    """Remittances, each sent twice and the oldest last, streamed in many batches beside the store of active claims."""
    out = new_folder(spark, "outcomes")
    _active(spark, sf_dir).write.parquet(f"{out}/store")
    _streamed(spark, sf_dir, out, lambda: None)
    rows = linked_store(spark, f"{out}/store", f"{out}/changes")
    return rows.select("claim_id", "payer_name", "adjudication_outcome", F.to_date("adjudication_timestamp").alias("day"))


def folded_outcomes(spark, sf_dir):
    """The same remittances, merged into a stored table of the active claims after each part, once more than there is need."""
    out = new_folder(spark, "folded")
    store = ClaimStore.create(_active(spark, sf_dir, "claim_status"), f"{out}/table", buckets=8)
    _streamed(spark, sf_dir, out, lambda: fold_outcomes(spark, store, f"{out}/changes"))
    fold_outcomes(spark, store, f"{out}/changes")
    return store.rows().select("claim_id", "payer_name", "adjudication_outcome", F.to_date("adjudication_timestamp").alias("day"))


def stored_features(spark, sf_dir):
    """Claims of low risk in a stored table; those of some risk merged into it, with a column that it lacks."""
    claims = claims_view(spark, sf_dir)
    old = claims.filter("comorbidity_risk_score < 6").select("claim_id", "payer_name", "denial_reason")
    store = ClaimStore.create(old, new_folder(spark, "features"), status="payer_name", buckets=16)
    store.upsert(claims.filter("comorbidity_risk_score >= 4").select("claim_id", F.lit(None).cast("string").alias("denial_reason"), "department"))
    return store.rows()


def stored_deletes(spark, sf_dir):
    """A stored table without the claims that were active."""
    store = ClaimStore.create(claims_view(spark, sf_dir).select("claim_id", "claim_status"), new_folder(spark, "deletes"), buckets=16)
    store.delete(store.scan("Active"))
    return store.rows()


def stored_scores(spark, sf_dir):
    """Scores of the stored table's active claims, written back into it."""
    claims = claims_view(spark, sf_dir)
    store = ClaimStore.create(claims.select("claim_id", "claim_status", "predicted_denial_score"), new_folder(spark, "scores"), buckets=16)
    features_of = claims.select("claim_id", "comorbidity_risk_score", "documents_medical_necessity", "mentions_lack_of_pre_auth")
    weights = {"comorbidity_risk_score": 0.05, "mentions_lack_of_pre_auth": 0.3, "documents_medical_necessity": 0.4}
    store.write_scores(scoring.linear_score(store.scan("Active").drop("predicted_denial_score").join(features_of, "claim_id"), weights))
    return store.rows()


def stored_active(spark, sf_dir):
    """The active claims of a stored table, from the folders of that status."""
    columns = ("claim_id", "payer_name", "claim_status", "charge_amount")
    return ClaimStore.create(claims_view(spark, sf_dir).select(*columns), new_folder(spark, "active"), buckets=16).scan("Active")


QUERIES = (
    bundle_encounters, remittance_lines, partial_records, clinical_notes, attached_notes, replaced_days, migrated_rows, stored_lines, pretty_customers,
    ad_hoc_totals, exported_claims, lake_months, page_rows, presented_payers, widened_window, streamed_outcomes,
    folded_outcomes, stored_features, stored_deletes, stored_scores, stored_active,
)

_PAGE = ("rolling_denial_trend", "payer_ranking", "monthly_cohort", "high_risk_decile", "specialty_analysis", "model_performance", "icd10_hotspots", "score_bucket_distribution", "provider_summary", "preauth_impact")
_NOTES = """n AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'discharge_summary' WHEN 1 THEN 'progress_note' ELSE 'operative_report' END AS note_type,
    DATE '2024-01-01' + CAST(conv_id % 300 AS INTEGER) + CASE WHEN conv_id % 3 <> 0 THEN 1 ELSE 0 END AS note_date,
    CASE turn % 2 WHEN 0 THEN 'A' ELSE 'UNKNOWN' END AS author_id FROM conversations WHERE turn % 4 <> 3)"""

SQL = {
    "bundle_encounters": """SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id, CAST(o_orderdate AS DATE) AS encounter_date, CAST(o_custkey AS VARCHAR) AS patient_account_number
        FROM orders WHERE o_orderkey % 17 <> 5 AND o_orderkey % 19 <> 3""",
    "remittance_lines": """SELECT 'P' || CAST(l_orderkey % 7 AS VARCHAR) AS payer_id, CASE WHEN l_orderkey % 21 <> 4 THEN CAST(MAX(l_shipdate) OVER (PARTITION BY l_orderkey) AS DATE) END AS payment_date,
        CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS claim_id, CASE WHEN l_returnflag = 'R' THEN 'denied' ELSE 'paid' END AS adjudication_status,
        CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS paid_amount, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS denial_reason FROM lineitem""",
    "partial_records": with_claims([], """SELECT claim_id, nullif(concat_ws(',', CASE WHEN date_of_birth IS NULL THEN 'age' END, CASE WHEN gender IS NULL THEN 'sex' END,
        'race', CASE WHEN length_of_stay % 3 = 0 THEN 'ethnicity' END, CASE WHEN charge_amount < 100000 THEN 'vitals' END, CASE WHEN denial_reason IS NULL THEN 'lab_results' END,
        CASE WHEN principal_icd10 IS NULL THEN 'problem_list' END, CASE WHEN admission_type IS NULL THEN 'medications' END,
        CASE WHEN department IS NULL THEN 'admitting_department' END, CASE WHEN provider_npi IS NULL THEN 'admitting_physician_id' END,
        CASE WHEN coalesce(length_of_stay, 0) = 0 THEN 'length_of_stay_days' END), '') AS partial_ehr_flag FROM claims"""),
    "clinical_notes": f"""WITH {_NOTES} SELECT conv_id, turn, note_type, note_date,
        CASE conv_id % 2 WHEN 0 THEN '2024-06-01 10:00' ELSE strftime(note_date, '%Y-%m-%d') || ' 00:00' END AS written, author_id FROM n""",
    "attached_notes": f"""WITH {_NOTES} SELECT o_orderkey AS claim_id, coalesce(string_agg(note_type || ':' || author_id, ',' ORDER BY turn, note_type), '') AS notes
        FROM orders LEFT JOIN n ON conv_id = o_orderkey GROUP BY 1""",
    "replaced_days": """SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS day, COUNT(*) * CASE WHEN year(MIN(o_orderdate)) = 1995 THEN 10 ELSE 1 END AS n FROM orders GROUP BY 1""",
    "migrated_rows": """SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, CASE o_orderkey % 5 WHEN 0 THEN (o_totalprice + 1) * 2 WHEN 1 THEN o_totalprice * 2 WHEN 2 THEN o_totalprice END AS total,
        CASE WHEN o_orderkey % 5 < 3 THEN '3.0' END AS schema_version, CASE o_orderkey % 5 WHEN 3 THEN '0.5' END AS embedded_version, CASE WHEN o_orderkey % 5 > 2 THEN '3.0' END AS current_version FROM orders""",
    "stored_lines": """SELECT CASE WHEN o_orderkey % 23 <> 9 THEN CAST(o_orderkey AS VARCHAR) END AS claim_id, CASE WHEN o_orderkey % 23 <> 9 THEN o_totalprice END AS total,
        CASE WHEN o_orderkey % 23 = 9 THEN '{"claim_id' END AS rejected FROM orders WHERE o_orderkey % 23 = 9 OR o_orderkey % 29 <> 1""",
    "pretty_customers": """SELECT '{' || chr(10) || '  "c_custkey" : ' || CAST(c_custkey AS VARCHAR) || ',' || chr(10) || '  "c_mktsegment" : "' || c_mktsegment || '",' || chr(10)
        || '  "c_nationkey" : ' || coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'null') || chr(10) || '}' AS json FROM customer""",
    "ad_hoc_totals": with_claims([], "SELECT payer_name, claim_type, COUNT(*) AS n, MAX(predicted_denial_score) AS top FROM claims GROUP BY 1, 2"),
    "exported_claims": with_claims([], "SELECT claim_id, payer_name, charge_amount, denial_reason FROM claims"),
    "lake_months": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(1 AS INTEGER) AS day, COUNT(*) AS n,
        CAST(SUM(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1, 2""",
    "page_rows": " UNION ALL ".join(f"SELECT '{name}' AS query, COUNT(*) AS n FROM ({with_claims(*TEXTS[name])}) x" for name in _PAGE),
    "presented_payers": f"""SELECT payer_name, total_claims, total_denied, total_predicted_denied, round(avg_charge, 2) AS avg_charge, round(total_revenue_at_risk, 2) AS total_revenue_at_risk,
        round(avg_denial_score, 4) AS avg_denial_score, round(actual_denial_rate, 4) AS actual_denial_rate, round(predicted_denial_rate, 4) AS predicted_denial_rate FROM ({with_claims(*TEXTS["payer_stats"])}) x""",
    "widened_window": with_claims(
        ["l AS (SELECT claim_id, submission_date, CASE adjudication_outcome WHEN 'denied' THEN 1 ELSE 0 END AS label, DATE '1998-03-01' - submission_date AS age FROM claims WHERE adjudication_outcome IN ('denied', 'paid'))",
         "w AS (SELECT CASE WHEN COUNT(*) FILTER (age BETWEEN 0 AND 60) >= 20 THEN 60 ELSE 720 END AS days FROM l)"],
        "SELECT claim_id, submission_date, CAST(label AS INTEGER) AS label FROM l, w WHERE age BETWEEN 0 AND days"),
    "streamed_outcomes": with_claims(
        ["s AS (SELECT claim_id, payer_name, adjudication_outcome FROM claims WHERE claim_status = 'Active')",
         "e AS (SELECT 'CLM-' || CAST(l_orderkey AS VARCHAR) AS claim_id, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_returnflag = 'R' THEN 'denied' ELSE 'paid' END AS status FROM lineitem)",
         "t AS (SELECT claim_id, MAX(day) AS day, arg_max(status, CAST(day AS VARCHAR) || status) AS status FROM e GROUP BY 1)"],
        "SELECT coalesce(s.claim_id, t.claim_id) AS claim_id, payer_name, coalesce(status, adjudication_outcome) AS adjudication_outcome, day FROM s FULL JOIN t ON s.claim_id = t.claim_id"),
    "stored_active": with_claims([], "SELECT claim_id, payer_name, claim_status, charge_amount FROM claims WHERE claim_status = 'Active'"),
}
# the same rows, whether frames are merged or a stored table
SQL |= {"folded_outcomes": SQL["streamed_outcomes"], "stored_features": FEATURES["feature_upsert"], "stored_deletes": FEATURES["deleted_rows"], "stored_scores": FEATURES["score_writeback"]}
