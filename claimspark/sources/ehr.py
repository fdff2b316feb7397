"""Encounter bundles, remittances and notes: JSON files to flat rows; the lake's layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.scalars import missing_list

STRUCTURED = ("age", "sex", "race", "ethnicity", "vitals", "lab_results", "problem_list", "medications", "admitting_department", "admitting_physician_id", "length_of_stay_days")
BUNDLE = "entry array<struct<resource: struct<resourceType: string, id: string, period: struct<start: string, end: string>, subject: struct<reference: string>>>>"
ERA = "transaction_date string, payer_id string, claims array<struct<claim_id: string, adjudication_status: string, paid_amount: double, denial_reason: string>>"
NOTE_TYPES = ("discharge_summary", "progress_note", "operative_report")


def read_fhir_bundles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(encounter_id, encounter_date, patient_account_number) of Encounter entries with an id and a readable start.

    ``multi_line``: a bundle a file; otherwise a bundle a line, so that large files are split.
    """
    each = spark.read.schema(BUNDLE).option("multiLine", multi_line).json(path).select(F.explode("entry.resource").alias("r")).filter("r.resourceType = 'Encounter' and r.id is not null")
    account = F.element_at(F.split("r.subject.reference", "/"), -1)
    rows = each.select(F.col("r.id").alias("encounter_id"), F.try_to_date(F.substring("r.period.start", 1, 10), "yyyy-MM-dd").alias("encounter_date"), account.alias("patient_account_number"))
    return rows.filter("encounter_date is not null")


def write_ehr(df: DataFrame, path: str, batch: str = "0") -> None:
    """Partitioned by batch and date; the account is too fine a key for folders and stays a sorted column.

    A batch that is written again replaces what it wrote, and nothing of other batches. The number of partitions is given, as
    many small days would otherwise be gathered in one task, which writes a file for each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(parts, "encounter_date").sortWithinPartitions("patient_account_number")
    rows.write.mode("overwrite").partitionBy("encounter_date").parquet(f"{path}/batch=b{batch}")


def read_era(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(payer_id, payment_date, claim_id, adjudication_status, paid_amount, denial_reason), a row for each claim of a remittance."""
    rows = spark.read.schema(ERA).option("multiLine", multi_line).json(path).select("payer_id", F.try_to_date(F.substring("transaction_date", 1, 10), "yyyy-MM-dd").alias("payment_date"), F.explode("claims").alias("c"))
    return rows.select("payer_id", "payment_date", "c.*")


def partial_ehr_flag(df: DataFrame) -> DataFrame:
    """df with the names of the structured fields that a record lacks; those that df has no column for are lacking everywhere."""
    here = df.withColumns({c: F.lit(None).cast("string") for c in STRUCTURED if c not in df.columns})
    return here.withColumn("partial_ehr_flag", missing_list(here, list(STRUCTURED))).select(*df.columns, "partial_ehr_flag")


def normalize_notes(notes: DataFrame) -> DataFrame:
    """Notes of a known type (by value or by name), with date, time and author filled in. Needs encounter_date."""
    kind = F.lower(F.trim("note_type"))
    date = F.coalesce("note_date", "encounter_date")
    return notes.withColumn("note_type", kind).filter(kind.isin(*NOTE_TYPES)).withColumns({"note_date": date, "note_datetime": F.coalesce("note_datetime", date.cast("timestamp")), "author_id": F.coalesce("author_id", F.lit("UNKNOWN"))})


class LakeLayout:
    """Paths of a lake, with dates as partitions."""

    def __init__(self, base: str) -> None:
        self.base = base.rstrip("/")

    def path(self, layer: str, date: str | None = None) -> str:
        """The folder of a layer, or of one day (yyyy-mm-dd) in it."""
        if date is None:
            return f"{self.base}/{layer}"
        year, month, day = date.split("-")
        return f"{self.base}/{layer}/year={year}/month={int(month):02d}/day={int(day):02d}"

    def write(self, df: DataFrame, layer: str, date: str = "ingestion_date", batch: str = "0") -> None:
        """Files the rows under their dates; a batch that is written again replaces its own folders of these dates, and no others."""
        parts = {"year": F.date_format(date, "yyyy"), "month": F.date_format(date, "MM"), "day": F.date_format(date, "dd"), "batch": F.lit(f"b{batch}")}
        df.withColumns(parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self.path(layer))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
