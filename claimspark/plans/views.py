"""The canonical claims view over the star schema, and the stand-ins for notes, encounters, remittances and reference tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: One text for Spark and for the SQL oracle. Money and rates are doubles, dates are dates.
CLAIMS_SQL = """
WITH li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines, MIN(l_suppkey) AS suppkey, MIN(l_partkey) AS partkey,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret
  FROM lineitem GROUP BY l_orderkey
), base AS (
  SELECT o.o_orderkey, o.o_custkey, CAST(o.o_orderdate AS DATE) AS submission_date,
    c.c_mktsegment AS payer_name, o.o_totalprice AS charge_amount, o.o_orderpriority, o.o_orderstatus,
    COALESCE(li.n_ret, 0) AS n_ret, li.suppkey, p.p_type, p.p_brand, p.p_name, n.n_name, r.r_name,
    CAST((o.o_orderkey * 7919 + CASE o.o_orderstatus WHEN 'F' THEN 2500 ELSE 0 END) % 10000 AS DOUBLE)
      / CAST(10000 AS DOUBLE) AS score
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = li.partkey
  LEFT JOIN supplier s ON s.s_suppkey = li.suppkey
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
)
SELECT 'CLM-' || CAST(o_orderkey AS STRING) AS claim_id, o_custkey AS patient_account_number,
  submission_date, payer_name,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Institutional' ELSE 'Professional' END AS claim_type,
  'NPI-' || CAST(suppkey % 10 AS STRING) AS provider_npi, p_type AS provider_specialty,
  n_name AS provider_state, r_name AS department, p_brand AS principal_icd10, p_name AS diagnosis_description,
  charge_amount, score AS predicted_denial_score,
  CASE o_orderstatus WHEN 'F' THEN 'denied' WHEN 'O' THEN 'paid' ELSE 'pending' END AS adjudication_outcome,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS denial_reason,
  CASE WHEN o_orderkey % 33 = 0 THEN 'degraded' END AS score_quality_flag,
  CAST(o_orderkey % 9 AS INT) AS comorbidity_risk_score, CAST(o_custkey % 14 AS INT) AS length_of_stay,
  CAST((o_custkey * 6007) % 10001 AS DOUBLE) / CAST(10000 AS DOUBLE) AS documents_medical_necessity,
  CASE WHEN n_ret >= 2 THEN 1 ELSE 0 END AS mentions_lack_of_pre_auth,
  CASE WHEN score >= 0.5 THEN charge_amount ELSE CAST(0 AS DOUBLE) END AS revenue_at_risk,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Emergency' WHEN '2-HIGH' THEN 'Urgent' WHEN '3-MEDIUM' THEN 'Elective'
    WHEN '5-LOW' THEN 'trauma' END AS admission_type,
  CASE o_orderkey % 8 WHEN 0 THEN 'Physician Referral' WHEN 1 THEN 'Transfer from Hospital' WHEN 2 THEN 'Transfer from SNF'
    WHEN 3 THEN ' emergency room ' WHEN 4 THEN 'Court/Law Enforcement' WHEN 5 THEN 'Not Available' WHEN 6 THEN 'Walk-in' END AS admission_source,
  CASE payer_name WHEN 'AUTOMOBILE' THEN 'Medicare' WHEN 'BUILDING' THEN 'MEDICAID' WHEN 'FURNITURE' THEN 'Commercial'
    WHEN 'HOUSEHOLD' THEN 'TriCare' ELSE 'Self-Pay' END AS insurance_type,
  CASE o_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'm' WHEN 2 THEN 'U' END AS gender,
  CASE WHEN o_custkey % 17 <> 0 THEN CAST(DATE '1930-01-01' + CAST((o_custkey * 37) % 23000 AS INT) AS DATE) END AS date_of_birth,
  CASE WHEN o_orderkey % 10 < 3 THEN 'Active' ELSE 'Submitted' END AS claim_status
FROM base
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims, from the tables below sf_dir, without touching the session's catalog of views."""
    return spark.sql(CLAIMS_SQL_OVER, **{name: table(spark, sf_dir, name) for name in TABLES})


def register_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers the claims as the temporary view ``claims`` and returns them."""
    claims = claims_view(spark, sf_dir)
    claims.createOrReplaceTempView("claims")
    return claims


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names; a temporary one where that is unset and all runs in one process (tests)."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        known = spark.conf.get("spark.checkpoint.dir", None)
        if not known and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(known or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"


def cut(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder, for plans that would read it several times."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once as compressed columns below the shared folder, for large rows that several plans read; unlike cut(), it is computed
    once for that, keeps no partitions and lets plans read some of the columns."""
    path = new_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_sql(spark: SparkSession, sql: str, claims: DataFrame) -> DataFrame:
    """Ad-hoc SQL over claims, which the text names ``{claims}``."""
    return spark.sql(sql, claims=claims)


def _over(sql: str) -> str:
    """The view's text with each base table as a parameter."""
    import re

    return re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", sql)


CLAIMS_SQL_OVER = _over(CLAIMS_SQL)
