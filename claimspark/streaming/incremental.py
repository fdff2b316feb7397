"""The two duties with an arrival deadline as structured streams over the same transforms.

Each stream has a name of its own, kept in its checkpoint folder, and what a batch writes is named by stream and batch: a
batch that is tried again replaces its own, and another stream, or one begun anew, replaces nothing of others.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimspark.operators.features import link_outcomes
from claimspark.sources import files
from claimspark.sources.edi import ingest_files
from claimspark.sources.store import ClaimStore

PROGRESS = "files long, quarantined long, claims long, rejects long, ingestion_date string"


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream with this checkpoint folder; a new folder is a new stream."""
    return files.once(spark, f"{checkpoint}/claimspark/name", uuid4().hex[:12])


def stream_edi(spark: SparkSession, landing: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Ingests each file of the landing folder once, with quarantine and rejects, as far as files are there.

    At most ``files_per_batch`` files make a batch, so a backlog of any size is worked off in parts of a set size. A batch keeps
    the date of its first try. When its sinks are written, it leaves a row of PROGRESS below ``out/progress``.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(landing)
    rows = source.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "ISO-8859-1").alias("content"))
    name = stream_name(spark, checkpoint)

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        today = session.sql("select cast(current_date() as string)").first()[0]
        date = files.once(session, f"{checkpoint}/claimspark/dates/{number}", today)
        paths = ingest_files(df, out, date, f"{name}-{number}")
        own = lambda kind: f"{paths[kind]}/ingestion_date={date}/batch=b{name}-{number}"
        read = lambda kind: session.read.format("json" if kind == "rejects" else "parquet").schema("file_name string").load(own(kind))
        counts = (read(kind).count() if files.names(session, own(kind)) else 0 for kind in ("raw", "quarantine", "parsed", "rejects"))
        row = session.createDataFrame([(*counts, date)], PROGRESS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/stream={name}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REMITTANCE = "claim_id string, adjudication_status string, processed timestamp"


def stream_outcomes(spark: SparkSession, era: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Collects remittances (claim_id, adjudication_status, processed) below out: of each batch the last of each claim.

    No watermark drops a row: a remittance counts by its time, whenever it comes, and repeats of one fall together when the
    outcomes are read, so the batches may come in any order. A batch's work grows with the batch and not with the store.
    linked_store() reads the store with the outcomes, fold_outcomes() merges them into it.
    """
    name = stream_name(spark, checkpoint)
    rows = spark.readStream.schema(REMITTANCE).option("maxFilesPerTrigger", files_per_batch).json(era).filter("claim_id is not null")

    def batch(df: DataFrame, number: int) -> None:
        _last_outcomes(df).write.mode("overwrite").parquet(f"{out}/stream={name}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last_outcomes(rows: DataFrame) -> DataFrame:
    """The last remittance of each claim by its time; of several at once the one whose status is greatest."""
    return rows.groupBy("claim_id").agg(F.max(F.struct("processed", "adjudication_status")).alias("x")).select("claim_id", "x.adjudication_status", "x.processed")


def linked_store(spark: SparkSession, store: str, out: str) -> DataFrame:
    """The store with the outcomes that streams collected below out: of each claim the last one by its time, whichever batch it came in."""
    return link_outcomes(spark.read.parquet(store), spark.read.schema(REMITTANCE).parquet(f"{out}/stream=*/batch=*"))


def fold_outcomes(spark: SparkSession, store: ClaimStore, out: str) -> int:
    """Merges the outcomes below out that the stored table doesn't have yet into it, and returns how many batches these are.

    The table's version remembers the batches that it holds, so a call that is tried again, or that comes when nothing is new,
    changes nothing. An outcome is set where it is later than the stored one, or as late with a greater status; claims that
    the table lacks become rows.
    """
    marks = store.current().marks
    fresh, paths = {}, []
    for folder in files.names(spark, out):
        if folder.startswith("stream="):
            known = marks.get(folder, -1)
            numbers = [int(b.split("=")[1]) for b in files.names(spark, f"{out}/{folder}") if b.startswith("batch=")]
            whole = sorted(n for n in numbers if n > known and "_SUCCESS" in files.names(spark, f"{out}/{folder}/batch={n}"))
            if whole:
                fresh[folder] = whole[-1]
                paths += [f"{out}/{folder}/batch={n}" for n in whole]
    if paths:
        last = _last_outcomes(spark.read.schema(REMITTANCE).parquet(*paths))
        rank = F.struct(F.col("processed").alias("at"), F.col("adjudication_status").alias("status"))
        new = last.select("claim_id", F.col("adjudication_status").alias("adjudication_outcome"), F.col("processed").alias("adjudication_timestamp"), rank.alias("adjudication_rank"))
        store.upsert(new, marks=fresh, newer="adjudication_rank")
    return len(paths)
