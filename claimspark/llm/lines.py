"""Removal of boilerplate lines that spread over many sites.

A HyperLogLog sketch of the sites is kept for each line's hash; sketches merge by aggregation. Lines whose estimate is
clearly at or above ``min_sites`` are boilerplate; those near the threshold get exact distinct counts. The document with
the least id keeps its boilerplate lines, every other document loses them, so that no content is lost from the whole.

Lines are compared without surrounding blanks; blank lines are never removed. Where at most ``send_lines`` lines are
boilerplate, their hashes are sent to the tasks and lines are dropped where they stand, without a shuffle of texts; beyond
that, the places of the bad lines are joined to the documents.

Defined results: null text stays null; null sites count as one site; rows with a null id keep boilerplate only where all its
rows have null ids; repeated rows are treated alike; input columns may have any names but ``n_lines`` and ``n_removed``,
which are added (columns of these names in the input are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import cut


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("key"), F.hash(text_col, id_col).alias("key2")]


def _line_hash(line: Column) -> Column:
    """The two hashes of a line without its surrounding blanks; null for a blank line."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row for each document with text: its keys, id, site hash and the hashes of each line."""
    hashed = F.transform(F.split(F.col(text_col), "\n"), _line_hash)
    return docs.filter(F.col(text_col).isNotNull()).select(*_keys(id_col, text_col), F.col(id_col).alias("_id"), F.xxhash64(site_col).alias("_site"), hashed.alias("_lines"))


def boilerplate(rows: DataFrame, min_sites: int, lg_k: int = 12, margin: float = 4.0, send_near: int = 500_000) -> DataFrame:
    """(a, b, keeper): the line hashes on at least ``min_sites`` sites, with the least id that has them. rows: id, site and line of each occurrence."""
    sketched = rows.groupBy("a", "b").agg(F.hll_sketch_agg("_site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"), F.min("_id").alias("keeper"))
    spread = sketched.filter(F.col("n") >= min_sites).select("a", "b", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
    error = margin * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = cut(spread.filter(F.col("sites") >= low))
    near = spread.filter(F.col("sites") <= high)
    sites, wanted = rows.select("a", "b", "_site"), near.select("a", "b")
    # few lines go to the rows; many meet what is left of these, a row for each line and site
    of_near = sites.join(F.broadcast(wanted), ["a", "b"], "left_semi").distinct() if near.count() <= send_near else sites.distinct().join(wanted, ["a", "b"], "left_semi")
    exact = of_near.groupBy("a", "b").count().filter(F.col("count") >= min_sites)
    return spread.filter(F.col("sites") > high).select("a", "b", "keeper").union(near.join(exact.select("a", "b"), ["a", "b"]).select("a", "b", "keeper"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, send_lines: int = 20_000) -> DataFrame:
    """docs with boilerplate lines taken out of ``text_col``, and the columns ``n_lines`` and ``n_removed`` with their numbers added."""
    inside = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    id_, text = F.col(f"doc.`{id_col}`"), F.col(f"doc.`{text_col}`")
    per_doc = cut(line_hashes(docs, id_col, text_col, site_col))
    rows = per_doc.select("key", "key2", "_id", "_site", F.posexplode("_lines").alias("_at", "_line")).filter("_line is not null")
    rows = rows.select("key", "key2", "_id", "_site", "_at", "_line.a", "_line.b")
    found = cut(boilerplate(rows, min_sites))
    lines = F.split(text, "\n")
    few = found.select("a", F.xxhash64("a", "keeper").alias("keeps")).limit(send_lines + 1).collect()
    if len(few) <= send_lines:
        # as text, for thousands of values are slow to build one by one; ``line`` is the lambda's, ``i`` the document's id
        gone, kept = (", ".join(str(r[c]) for r in few) for c in ("a", "keeps"))
        bad = f"trim(line) <> '' and xxhash64(trim(line)) in ({gone}) and xxhash64(xxhash64(trim(line)), i) not in ({kept})"
        named = inside.select("doc", id_.alias("i"), lines.alias("lines"))
        left = F.expr(f"filter(lines, line -> not ({bad}))") if few else F.col("lines")
        marked = named.select("doc", "lines", left.alias("left"))
    else:
        hits = rows.join(found, ["a", "b"]).filter(~F.col("_id").eqNullSafe(F.col("keeper")))
        places = hits.groupBy("key", "key2").agg(F.collect_set("_at").alias("places"))
        keyed = inside.select("doc", F.xxhash64(id_, text).alias("key"), F.hash(text, id_).alias("key2"))
        good = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("places", F.array().cast("array<int>")))
        marked = keyed.join(places, ["key", "key2"], "left").select("doc", lines.alias("lines"), F.transform(good, lambda i: F.get(lines, i)).alias("left"))
    number = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    whole = F.when(F.size("lines") == F.size("left"), text).otherwise(F.array_join("left", "\n"))
    columns = [whole.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed") or c == text_col]
    return marked.select(*columns, number("lines").alias("n_lines"), (number("lines") - number("left")).alias("n_removed"))
