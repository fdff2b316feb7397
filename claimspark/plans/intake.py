"""Claim intake over the star schema: an X12 837 interchange for each customer, with one claim an order, and its way through the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.plans.views import new_folder, stored, table
from claimspark.sources import edi

# Fixed by the format: the first segment without its first letter, up to its control number.
HEAD = "SA*00*          *00*          *ZZ*CLAIMS         *ZZ*PAYER          *240101*1200*^*00501*"


def _seg(*elements) -> Column:
    """A segment of texts (parts of the format) and columns."""
    cells = [F.lit(e) if isinstance(e, str) else F.coalesce(e.cast("string"), F.lit("")) for e in elements]
    return F.concat(F.concat_ws("*", *cells), F.lit("~"))


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def _service(line: Column, institutional: Column) -> Column:
    code = F.concat(F.lit("HC:"), F.lpad((line["l_partkey"] % 100000).cast("string"), 5, "0"), F.lit("99"))
    amount, units = line["l_extendedprice"].cast("decimal(18,2)"), line["l_quantity"]
    two = _seg("SV2", line["l_linenumber"] * 45, code, amount, "UN", units)
    one = _seg("SV1", code, amount, "UN", units, "11", "", "1")
    return F.concat(_seg("LX", line["l_linenumber"]), F.when(institutional, two).otherwise(one), _seg("DTP", "472", "D8", _day(line["l_shipdate"])))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders, each with its lines; what is shuffled is numbers and days, and texts are made of them after the last shuffle."""
    fields = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(fields)).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority").join(lines, "o_orderkey", "left")
    return orders.withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))


def _claim() -> Column:
    """The segments of an order's claim."""
    key = F.col("o_orderkey")
    institutional = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    principal = F.when(key % 9 != 4, F.concat(F.lit("ABK:I"), F.lpad((key % 1000).cast("string"), 3, "0")))
    others = F.transform("lines", lambda x: F.concat(F.lit("ABF:D"), x["l_partkey"].cast("string")))
    return F.concat(
        _seg("CLM", key, F.col("o_totalprice").cast("decimal(18,2)"), "", "", F.when(institutional, "11:B:1").otherwise("A:B:1")),
        _seg("DTP", "435", "D8", _day(F.col("o_orderdate"))),
        F.concat(F.concat_ws("*", F.lit("HI"), principal, others), F.lit("~")),
        F.array_join(F.transform("lines", lambda x: _service(x, institutional)), ""),
    )


def _names() -> Column:
    """The segments of provider and subscriber, which stand before a customer's claims."""
    cust = F.col("o_custkey")
    return F.concat(
        _seg("HL", "1", "", "20", "1"),
        _seg("NM1", "85", "2", "CLINIC", "", "", "", "", "XX", F.when(cust % 5 == 2, "12345").otherwise((cust + 1000000000).cast("string"))),
        _seg("N3", F.concat(cust.cast("string"), F.lit(" MAIN ST"))), _seg("N4", "SPRINGFIELD", "IL", "62701"), _seg("HL", "2", "1", "22", "0"),
        _seg("NM1", "IL", "1", "DOE", "JO", "", "", "", "MI", F.concat(F.lit("M"), F.lpad(cust.cast("string"), 9, "0"))),
        _seg("DMG", "D8", _day(F.date_add(F.lit("1930-01-01").cast("date"), (cust * 37 % 23000).cast("int"))), F.when(cust % 3 == 0, "f").when(cust % 3 == 1, "M")),
        _seg("NM1", "PR", "2", "PAYER", "", "", "", "", "PI", F.when(cust % 19 != 3, F.concat(F.lit("P"), (cust % 7).cast("string")))),
    )


def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, loops): the segments of each customer's claims, those of provider and subscriber before them."""
    orders = _orders(spark, sf_dir).repartition("o_custkey")
    files = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", _claim().alias("text")))).alias("claims"))
    return files.select("o_custkey", F.concat(_names(), F.array_join(F.transform("claims", lambda x: x["text"]), "")).alias("loops"))


def interchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, content). Some files break a rule of the envelope and some claims lack a required field; half use other delimiters."""
    cust = F.col("o_custkey")
    number = F.lpad(cust.cast("string"), 9, "0")
    content = F.concat(
        _seg(F.concat(F.when(cust % 13 == 5, "X").otherwise("I"), F.lit(HEAD), number, F.lit("*0*P*:"))), _seg("GS", "HC"), _seg("ST", "837", number), F.col("loops"),
        _seg("SE", "1", number), _seg("GE", "1"), F.when(cust % 11 == 0, "").otherwise(_seg("IEA", "1", number)),
    )
    delimiters = F.when(cust % 2 == 0, "|\n").otherwise("*~")
    content = F.when(cust % 23 == 7, "  ").otherwise(F.call_function("translate", content, F.lit("*~"), delimiters))
    return _loops(spark, sf_dir).select(F.concat(F.lit("customer-"), cust.cast("string")).alias("file_name"), content.alias("content"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interchanges(), written once, as files are: the readers refer to the content many times."""
    return stored(interchanges(spark, sf_dir))


def one_interchange(spark: SparkSession, sf_dir: str) -> str:
    """The path of one file with the claims of all customers; as any one file, it is written by one task."""
    out = new_folder(spark, "interchange")
    number = F.lit("000000001")
    head, tail = F.concat(_seg(F.concat(F.lit("I" + HEAD), number, F.lit("*0*P*:"))), _seg("GS", "HC"), _seg("ST", "837", number)), F.concat(_seg("SE", "1", number), _seg("GE", "1"), _seg("IEA", "1", number))
    around = spark.range(2).select(F.when(F.col("id") == 0, -1).otherwise((1 << 62)).alias("o_custkey"), F.lit(0).alias("n"), F.lit(0).alias("o_orderkey"), F.when(F.col("id") == 0, head).otherwise(tail).alias("text"))
    names = table(spark, sf_dir, "orders").select("o_custkey").distinct().select("o_custkey", F.lit(0).alias("n"), F.lit(0).alias("o_orderkey"), _names().alias("text"))
    # ordered claim by claim, so that no shuffle brings a customer's together before
    rows = around.unionByName(names).unionByName(_orders(spark, sf_dir).select("o_custkey", F.lit(1).alias("n"), "o_orderkey", _claim().alias("text")))
    # the writer ends each row with the terminator
    rows.orderBy("o_custkey", "n", "o_orderkey", "text").select(F.expr("substring(text, 1, length(text) - 1)").alias("value")).coalesce(1).write.option("lineSep", "~").text(out)
    return out


def _sinks(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The four sinks of all interchanges, below the shared folder; the raw one is where their content is written."""
    return edi.ingest_files(interchanges(spark, sf_dir), new_folder(spark, "intake"), "2024-01-01", "tables")


def envelope_checks(spark, sf_dir):
    rows = edi.validate_envelope(_files(spark, sf_dir))
    terminator = F.when(F.col("terminator") == "\n", "newline").otherwise(F.col("terminator"))
    return rows.select("file_name", "is_valid", "segment_ref", "description", "element", terminator.alias("terminator"))


def ingested_claims(spark, sf_dir):
    """The parsed sink, a row for each claim that has all required fields."""
    return _claim_columns(spark.read.parquet(_sinks(spark, sf_dir)["parsed"]), "file_name")


def _claim_columns(rows: DataFrame, *more: str) -> DataFrame:
    amounts = F.expr("aggregate(service_lines, cast(0 as decimal(28,2)), (a, x) -> cast(a + x.charge_amount as decimal(28,2)))")
    return rows.select(
        *more, "patient_account_number", "provider_npi", "payer_id", "member_id", "gender", "date_of_birth", "claim_type", "admission_date", "discharge_date", "billing_provider_street", "billing_provider_state",
        "principal_icd10_code", F.concat_ws(",", "secondary_icd10_codes").alias("secondary_codes"), F.col("charge_amount").cast("double").alias("charge_amount"),
        F.coalesce(F.size("service_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(amounts, F.lit(0)).cast("double").alias("lines_amount"),
    )


def ingested_lines(spark, sf_dir):
    """The service lines of all claims of valid files, before the check of required fields."""
    valid = edi.validate_envelope(_files(spark, sf_dir)).filter("is_valid")
    return _line_columns(edi.claims_of_files(valid))


def _line_columns(claims: DataFrame) -> DataFrame:
    rows = claims.select("patient_account_number", F.explode("service_lines").alias("l"))
    return rows.select("patient_account_number", "l.revenue_code", "l.cpt_hcpcs_code", "l.service_date", F.col("l.charge_amount").cast("double").alias("charge_amount"), F.col("l.units_of_service").cast("long").alias("units"))


def huge_interchange_claims(spark, sf_dir):
    """One file with all customers' claims through its sinks, split by Spark and numbered chunk by chunk."""
    paths = edi.ingest_huge(spark, one_interchange(spark, sf_dir), new_folder(spark, "huge"), "2024-01-01")
    return _claim_columns(spark.read.parquet(paths["parsed"]))


def huge_interchange_lines(spark, sf_dir):
    """The service lines of all claims of that file."""
    return _line_columns(edi.claims_of_segments(edi.read_segments(spark, one_interchange(spark, sf_dir))))


def ingest_rejects(spark, sf_dir):
    """The reject sink, with how often each file breaks each rule."""
    schema = "file_name string, error_type string, segment_ref string, field_name string, claim_segment_ref string"
    rows = spark.read.schema(schema).json(_sinks(spark, sf_dir)["rejects"])
    return rows.groupBy("file_name", "error_type", "segment_ref", "field_name").agg(F.count("*").alias("n"))


def ingest_sinks(spark, sf_dir):
    """Rows of the raw and quarantine sinks by sink and by what was wrong."""
    paths = _sinks(spark, sf_dir)
    raw = spark.read.parquet(paths["raw"]).select(F.lit("raw").alias("sink"), F.concat_ws(" ", *edi.RETENTION).alias("note"))
    bad = spark.read.parquet(paths["quarantine"]).select(F.lit("quarantine").alias("sink"), F.concat_ws(" ", "segment_ref", "description").alias("note"))
    return raw.unionAll(bad).groupBy("sink", "note").agg(F.count("*").alias("n"))


QUERIES = (envelope_checks, ingested_claims, ingested_lines, ingest_rejects, ingest_sinks, huge_interchange_claims, huge_interchange_lines)

_FILES = """files AS (SELECT DISTINCT o_custkey AS k, 'customer-' || CAST(o_custkey AS VARCHAR) AS file_name,
    CASE WHEN o_custkey % 23 = 7 THEN '' WHEN o_custkey % 13 = 5 THEN 'ISA' WHEN o_custkey % 11 = 0 THEN 'IEA' END AS ref,
    CASE WHEN o_custkey % 23 = 7 THEN 'empty file' WHEN o_custkey % 13 = 5 THEN 'does not begin with ISA' WHEN o_custkey % 11 = 0 THEN 'IEA is missing' END AS description
    FROM orders)"""
_CLAIMS = """c AS (SELECT o.*, file_name, k % 5 = 2 AS no_npi, k % 19 = 3 AS no_payer, o_orderkey % 9 = 4 AS no_code,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS inst FROM orders o JOIN files ON k = o_custkey WHERE ref IS NULL)"""

SQL = {
    "envelope_checks": f"""WITH {_FILES} SELECT file_name, ref IS NULL AS is_valid, ref AS segment_ref, description,
        CASE WHEN coalesce(ref, 'IEA') = 'IEA' THEN CASE k % 2 WHEN 0 THEN '|' ELSE '*' END END AS element,
        CASE WHEN coalesce(ref, 'IEA') = 'IEA' THEN CASE k % 2 WHEN 0 THEN 'newline' ELSE '~' END END AS terminator FROM files""",
    "ingested_claims": f"""WITH {_FILES}, {_CLAIMS}, l AS (SELECT l_orderkey, COUNT(*) AS n, SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS amount,
        string_agg('D' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS codes FROM lineitem GROUP BY 1)
        SELECT file_name, CAST(o_orderkey AS VARCHAR) AS patient_account_number, CAST(o_custkey + 1000000000 AS VARCHAR) AS provider_npi,
        'P' || CAST(o_custkey % 7 AS VARCHAR) AS payer_id, 'M' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS member_id,
        CASE o_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'U' END AS gender, DATE '1930-01-01' + CAST(o_custkey * 37 % 23000 AS INTEGER) AS date_of_birth,
        CASE WHEN inst THEN 'institutional' ELSE 'professional' END AS claim_type, CAST(o_orderdate AS DATE) AS admission_date, CAST(NULL AS DATE) AS discharge_date,
        CAST(o_custkey AS VARCHAR) || ' MAIN ST' AS billing_provider_street, 'IL' AS billing_provider_state,
        'I' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS principal_icd10_code, coalesce(codes, '') AS secondary_codes,
        CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS charge_amount, coalesce(n, 0) AS n_lines, coalesce(CAST(amount AS DOUBLE), 0) AS lines_amount
        FROM c LEFT JOIN l ON l_orderkey = o_orderkey WHERE NOT (no_npi OR no_payer OR no_code)""",
    "ingested_lines": f"""WITH {_FILES}, {_CLAIMS} SELECT CAST(o_orderkey AS VARCHAR) AS patient_account_number,
        CASE WHEN inst THEN lpad(CAST(l_linenumber * 45 AS VARCHAR), CAST(greatest(4, length(CAST(l_linenumber * 45 AS VARCHAR))) AS INTEGER), '0') END AS revenue_code,
        lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') AS cpt_hcpcs_code, CAST(l_shipdate AS DATE) AS service_date,
        CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) AS charge_amount, CAST(l_quantity AS BIGINT) AS units FROM c JOIN lineitem ON l_orderkey = o_orderkey""",
    "ingest_rejects": f"""WITH {_FILES}, {_CLAIMS}, m AS (SELECT file_name, 'provider_npi' AS field_name FROM c WHERE no_npi UNION ALL
        SELECT file_name, 'payer_id' FROM c WHERE no_payer UNION ALL SELECT file_name, 'principal_icd10_code' FROM c WHERE no_code)
        SELECT file_name, 'MISSING_REQUIRED_FIELD' AS error_type, 'CLM' AS segment_ref, field_name, COUNT(*) AS n FROM m GROUP BY 1, 4
        UNION ALL SELECT file_name, 'INVALID_ENVELOPE', ref, NULL, 1 FROM files WHERE ref IS NOT NULL""",
    "ingest_sinks": f"""WITH {_FILES} SELECT 'raw' AS sink, 'regulatory 7 HIPAA / CMS 7-year raw EDI retention 7' AS note, COUNT(*) AS n FROM files
        UNION ALL SELECT 'quarantine', ref || ' ' || description, COUNT(*) FROM files WHERE ref IS NOT NULL GROUP BY 2""",
}
# the same claims and lines, from the customers of all files
_ALL = _CLAIMS.replace("WHERE ref IS NULL", "")
SQL |= {
    "huge_interchange_claims": SQL["ingested_claims"].replace(_CLAIMS, _ALL).replace("SELECT file_name, CAST(o_orderkey", "SELECT CAST(o_orderkey"),
    "huge_interchange_lines": SQL["ingested_lines"].replace(_CLAIMS, _ALL),
}
