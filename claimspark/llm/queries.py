"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import crosstok, hardneg, jpeg, licenses, lines, lm, mainhtml, mixing, quality, secret_scan, simhash, tiling, warc
from claimspark.llm.common import cut, shared_dir, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(licenses.background_paragraphs(docs))).withColumnRenamed("id", "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), allowed=quality.may_train("doc_id"))
    out = quality.scores(docs, model)
    return out.select(F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much closer each document is to conversations than to the documents at large."""
    return lm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")).withColumnRenamed("id", "doc_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.sha2(secret_scan.span_text(F.col("spans"), tuple(secret_scan.BASE)), 256)
    spans = secret_scan.span_text(F.col("spans"), tuple(secret_scan.KINDS))
    spread = ("n_live", "n_shared", "n_example", "most_repos", "most_owners")
    return out.select(F.col("id").alias("doc_id"), *map(number, secret_scan.BASE), base.alias("base_sha256"), spans.alias("spans"), *spread)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(jpeg.with_media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "tiles")


#: Well below the number of sources, as a passage in 20 documents is on under 10 sources where one source holds a third of
#: them; at sf0.1, 5,481 different lines are on 2 of the 20 sources, 294 on 3, 31 on 4 and 43 on 5 to 9.
LINE_SITES = 5


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=LINE_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("text_md5"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), spread AS (
  SELECT trim(line, ' ') AS line, min(doc_id) AS keeper FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(0))) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.line IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM lines l LEFT JOIN spread s ON trim(l.line, ' ') = s.line
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS n_kept_chars, md5(text) AS text_md5 FROM done
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.range(1).select(F.expr("uuid()")).first()[0]
    path = f"{shared_dir(spark)}/warc-{made}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    out = warc.resolve(cut(warc.decode(warc.reassemble(warc.read_records(spark, path)))))
    return out.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers").cast("long").alias("refers_to"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS keeper FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.keeper IS NULL OR f.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.keeper <> p.page_id THEN f.keeper END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("source")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)
    return out.drop("anchor", "positive")


#: Every pair of anchor and row, by definition.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT * FROM (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id
  WHERE NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
) WHERE rank <= 10
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.alignment(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_licenses, op2_quality, op3_simhash, op4_lm_score, op5_secrets, op6_media, op7_decontaminate, op8_line_dedup, op9_warc, op10_mix, op11_hard_negatives, op12_alignment, op13_html)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": OP8_SQL, "op9_warc": OP9_SQL, "op11_hard_negatives": OP11_SQL}
