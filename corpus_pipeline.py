"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, then the mix. Each stage takes (spark, docs, sf_dir).

In every stage: repeated rows are rows of their own and are treated alike; columns beyond those of ``documents`` are carried
along, whatever their names, except that line dedup replaces those named ``n_lines`` and ``n_removed``, and the mix returns
its own columns; an empty table gives an empty result. Each stage's docstring says what nulls, empty texts and ties come to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import lines, mixing, quality, simhash, tiling
from claimspark.llm.common import shared_dir, table
from claimspark.llm.queries import LINE_SITES


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the Bradley-Terry model accepts; it learns from labels of documents in ``docs`` outside the held-out rows.

    Null text scores as an empty one; a score equal to the threshold is accepted; without a pair of labels all are accepted.
    A null id is judged like any other and never trains.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), allowed=quality.may_train("doc_id")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; n_chars follows the text.

    Null text stays null, and so does its n_chars; null sources are one site; blank lines stay. Of documents that share a
    line the one with the least id keeps it, and a row with a null id only where all its rows have none.
    """
    out = lines.remove_boilerplate(docs, min_sites=LINE_SITES)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints within two bits, or five-word shingles alike by 0.8.

    The least id stays, with all rows that have it. Null and blank texts have fingerprint zero and are one group; rows with
    a null id stay only in a group of such rows.
    """
    return simhash.keep_first(docs, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no benchmark item. Null and empty texts leak none, and null or empty items are leaked by none."""
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much the mix takes of each document. Null text has size 0 and gives nothing; a null source is a source of its own, the last.

    Documents of a source are laid out by a seeded hash of id and text, ties by the row's number.
    """
    return mixing.mix(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

#: The fitted model, the fingerprints and the seeded order of the mix have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written to the shared folder before the next begins."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}"
    made = spark.range(1).select(F.expr("uuid()")).first()[0]
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{made}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
