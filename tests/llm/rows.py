"""Small documents with the awkward cases: nulls, blanks, repeats, long texts, clashing column names."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
    T.StructField("fp", T.LongType()), T.StructField("row", T.LongType()), T.StructField("__line_key", T.StringType()), T.StructField("a.b", T.StringType()),
])

PROSE = "the quick brown fox jumps over the lazy dog and runs through the green field while birds sing in the tall old trees"


def awkward(spark, more=()):
    texts = [None, "", "   \n\t ", "a", "a b", PROSE, PROSE, PROSE.upper(), "éàè ñ 漢字 𝒳 " * 3, "x " * 30_000, "word" * 20_000, PROSE + "\n\n" + PROSE[::-1], *more]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "clash", 7, 7, "k", "dot") for i, t in enumerate(texts)]
    rows += [rows[5], (None, PROSE, *[None] * 8), (None,) * 10]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
