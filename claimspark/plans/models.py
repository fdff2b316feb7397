"""Queries about training, scoring and notes, each with a model, an encoder or an order that SQL can follow."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scalars import parse_ts_date
from claimspark.operators import features, notes, scoring, training
from claimspark.plans.oracle import with_claims
from claimspark.plans.oracle_features import CLAIM_LEVEL, ENC, LABELLED, LINKED
from claimspark.plans.views import claims_view, cut, table
from claimspark.sources.ehr import STRUCTURED, partial_ehr_flag

WEIGHTS = {"comorbidity_risk_score": 0.25, "documents_medical_necessity": 2.0, "length_of_stay": 0.0625, "mentions_lack_of_pre_auth": 0.5}


class Steps:
    """A classifier over all features in their order: each counts its place in 4,096ths."""

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        p = x @ (np.arange(x.shape[1]) / 4096)
        return np.stack([1 - p, p], axis=1)


def scored_by_probability(table_: DataFrame) -> DataFrame:
    """The whole feature table through a model with probabilities of two classes."""
    scored = scoring.score(table_, Steps())
    return scored.select("claim_id", F.round("predicted_denial_score", 6).alias("predicted_denial_score"), "score_quality_flag", "score_error")


def assembled_vectors(table_: DataFrame) -> DataFrame:
    """The vector of all features of each claim: its length, and the sum of its values, each times its place."""
    values = vector_to_array("features")
    total = F.aggregate(F.zip_with(values, F.sequence(F.lit(0), F.size(values) - 1), lambda v, i: v * i), F.lit(0.0), lambda a, x: a + x)
    return training.assemble(table_).select("claim_id", F.size(values).alias("n"), F.round(total / 4096, 6).alias("total"))


def flagged_claim_features(spark, sf_dir):
    """Claims with what their encounters lack and whether they have one, through the claim-level features."""
    claims = claims_view(spark, sf_dir)
    visits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_account_number"), F.col("o_orderkey").alias("encounter_id"), F.col("o_orderdate").cast("date").alias("encounter_date"), F.col("o_orderpriority").alias("admitting_department"))
    linked = features.attach_encounters(features.link_encounters(claims, visits), visits)
    rows = features.claim_level(partial_ehr_flag(linked.withColumns({c: F.lit("known") for c in STRUCTURED if c not in ("admitting_department", "race")})))
    return rows.select("claim_id", "patient_age", "partial_ehr_flag", "ehr_null_match_flag")


def linear_importance(spark, sf_dir):
    """What the exchange of each feature costs a fixed linear model. The order of the exchange goes by the order's key."""
    names = list(WEIGHTS)
    rows = training.labelled(claims_view(spark, sf_dir)).withColumn("_k", F.regexp_extract("claim_id", r"(\d+)", 1).cast("long"))
    rows = cut(rows.select("label", "_k", *(F.col(c).cast("double").alias(c) for c in names)))
    mixed = training.exchanged(rows, names, F.col("_k") % 5, F.struct((F.col("_k") * 7919) % 10007, "_k"))
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return training.importance_of(mixed.withColumn("score", total)).select("feature", F.round("importance", 6).alias("importance"))


def training_windows(spark, sf_dir):
    """What the choice of a training window goes by, for a window that suffices, one that is widened, and one that halts the run."""
    claims, out = claims_view(spark, sf_dir), None
    for as_of, least, days, wide in WINDOWS:
        one = training.window_record(claims, as_of, least, days, wide).select(F.lit(least).alias("least"), "*")
        out = one if out is None else out.unionAll(one)
    return out


WINDOWS = (("1996-06-30", 1, 365, 720), ("1998-08-02", 20, 10, 2500), ("1996-06-30", 1_000_000_000, 90, 180))


def scoring_runs(spark, sf_dir):
    """A run over the active claims with a model and one without."""
    claims = claims_view(spark, sf_dir)
    names = tuple(WEIGHTS)
    return scoring.run_record(claims, lambda x: x.sum(axis=1) / 64, names).unionAll(scoring.run_record(claims, None, names))


def parsed_days(spark, sf_dir):
    """Order dates written in five ways, three of them timestamps with zones, one cut short, one with a month too many."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(key % 5 == 0, day).when(key % 5 == 1, F.concat(day, F.lit("T23:30:00+05:00"))).when(key % 5 == 2, F.concat(day, F.lit(" 01:02:03.5Z"))).when(key % 5 == 3, F.substring(day, 1, 7)).otherwise(F.concat(F.substring(day, 1, 5), F.lit("13-01")))
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_ts_date(text).alias("day"))


def _letters(text: str) -> list[float]:
    if "zz" in text:
        raise ValueError("two z")
    return [len(text) / 16, text.count("e") / 16, text.count(" ") / 16]


def note_embeddings(spark, sf_dir):
    """Each turn of a conversation through an encoder of three numbers, which refuses some texts."""
    out = notes.embed(table(spark, sf_dir, "conversations").filter("text is not null"), lambda: _letters, dimension=3)
    return out.select("conv_id", "turn", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(3)), "embedding_error")


QUERIES = (flagged_claim_features, linear_importance, training_windows, scoring_runs, parsed_days, note_embeddings)
OVER_FEATURES = (scored_by_probability, assembled_vectors)

_MIXED = ", ".join(f"coalesce(lag({c}) OVER w, last_value({c}) OVER (PARTITION BY k % 5 ORDER BY (k * 7919) % 10007, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS o_{c}" for c in WEIGHTS)
_SCORE = lambda f: " + ".join(["0.0", *(f"CAST({'o_' * (c == f)}{c} AS DOUBLE) * CAST({w!r} AS DOUBLE)" for c, w in WEIGHTS.items())])
_ALL = " UNION ALL ".join(f"SELECT '{f}' AS feature, label, {_SCORE(f)} AS score FROM m" for f in ("", *WEIGHTS))
_WINDOW = lambda as_of, least, days, wide: (
    f"SELECT CAST({least} AS INTEGER) AS least, near, far, excluded, CAST(CASE WHEN near >= {least} THEN {days} WHEN far >= {least} THEN {wide} END AS INTEGER) AS days, near < {least} AND far < {least} AS halted FROM ("
    f"SELECT COUNT(*) FILTER (age BETWEEN 0 AND {days} AND known) AS near, COUNT(*) FILTER (age BETWEEN 0 AND {wide} AND known) AS far, COUNT(*) FILTER (age BETWEEN 0 AND {wide} AND NOT known) AS excluded "
    f"FROM (SELECT DATE '{as_of}' - submission_date AS age, adjudication_outcome IN ('denied', 'paid') AS known FROM claims) a) b"
)

SQL = {
    "flagged_claim_features": with_claims([ENC, LINKED, f"f AS ({CLAIM_LEVEL})"], """SELECT f.claim_id, patient_age, CASE WHEN e.admitting_department IS NULL THEN 'race,admitting_department' ELSE 'race' END AS partial_ehr_flag,
        CAST(l.encounter_id IS NULL AS INTEGER) AS ehr_null_match_flag FROM f JOIN linked l USING (claim_id) LEFT JOIN enc e ON e.encounter_id = l.encounter_id"""),
    "linear_importance": with_claims(
        [LABELLED, "t AS (SELECT c.*, label, CAST(substring(c.claim_id, 5) AS BIGINT) AS k FROM claims c JOIN lab USING (claim_id))", f"m AS (SELECT *, {_MIXED} FROM t WINDOW w AS (PARTITION BY k % 5 ORDER BY (k * 7919) % 10007, k))",
         f"s AS ({_ALL})", "r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY score) + (COUNT(*) OVER (PARTITION BY feature, score) - 1) / CAST(2 AS DOUBLE) AS place FROM s)",
         "a AS (SELECT feature, (SUM(place) FILTER (label = 1) - CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) * (COUNT(*) FILTER (label = 1) + 1) / 2) / (CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) * COUNT(*) FILTER (label = 0)) AS area FROM r GROUP BY 1)"],
        "SELECT feature, round((SELECT area FROM a WHERE feature = '') - area, 6) AS importance FROM a WHERE feature <> ''"),
    "training_windows": with_claims([], " UNION ALL ".join(_WINDOW(*w) for w in WINDOWS)),
    "scoring_runs": with_claims([f"x AS (SELECT *, {' OR '.join(f'{c} IS NULL' for c in WEIGHTS)} AS lacks FROM claims WHERE claim_status = 'Active')"], """SELECT 'done' AS status, COUNT(*) AS active, COUNT(*) AS scored,
        COUNT(*) FILTER (lacks) AS degraded, CAST(0 AS BIGINT) AS failed FROM x UNION ALL SELECT 'blocked', COUNT(*), 0, 0, 0 FROM x"""),
    "parsed_days": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "note_embeddings": """SELECT conv_id, turn, CASE WHEN NOT bad THEN length(text) / CAST(16 AS DOUBLE) END AS e0, CASE WHEN NOT bad THEN (length(text) - length(replace(text, 'e', ''))) / CAST(16 AS DOUBLE) END AS e1,
        CASE WHEN NOT bad THEN (length(text) - length(replace(text, ' ', ''))) / CAST(16 AS DOUBLE) END AS e2, CASE WHEN bad THEN 'two z' END AS embedding_error
        FROM (SELECT *, contains(text, 'zz') AS bad FROM conversations WHERE text IS NOT NULL) c""",
}
