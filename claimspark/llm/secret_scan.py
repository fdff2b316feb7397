"""Secret scans with corpus-wide ownership frequency.

Candidate spans are found in every text; each candidate's value is hashed, and the hashes are counted by distinct
repositories and owners over the whole corpus. A value that one owner holds in few repositories looks live; one that many
owners carry, or that is copied over many repositories, is an example; anything between is shared. Everything is DataFrame expressions: positions come from the lengths of the pieces between matches.

Base kinds: ``assign`` (a keyword, an assignment sign and a value of 8 or more characters), ``access`` (AKIA key ids of 16 or
more) and ``hex`` (32 or more hex digits). Added kinds: ``pem`` (private key headers), ``token`` (prefixed service tokens)
and ``jwt``. A private key's value is its header with the body up to the end line, white space left out, though its span is
the header alone. Spans of different kinds may overlap. Defined results: null text is empty and has no spans; repeated rows get
one row each, and count once for a repository; null owners or repositories count as one owner or repository of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import cut

#: kind: (pattern, the group that holds the value, least length of that group). Fixed values; letters of keywords in either case, ASCII only.
BASE = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
ADDED = {
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "token": ("(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|glpat-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
    "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
}
KINDS = {**BASE, **ADDED}
#: The header of a private key and, looked ahead to, the text up to the next five dashes.
PEM_BODY = ADDED["pem"][0] + "(?=([^-]*+(?:-(?!----)[^-]*+)*+))"


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, at, kind, end, value>> of one kind: the pieces that split() leaves between matches give the starts."""
    pattern, group, least = KINDS[kind]
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    if kind == "pem":
        values = F.zip_with(hits, F.regexp_extract_all(text, F.lit(PEM_BODY), F.lit(1)), lambda h, body: F.concat(h, F.regexp_replace(body, r"\s+", "")))
    lengths = F.zip_with(F.transform(gaps, F.length), F.transform(hits, F.length), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    laid = F.aggregate(lengths, zero, lambda acc, x: F.struct((acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"), F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("end")))).alias("spans")))["spans"]
    joined = F.zip_with(laid, values, lambda s, v: F.struct(s["start"].alias("start"), F.lit(list(KINDS).index(kind)).alias("at"), F.lit(kind).alias("kind"), s["end"].alias("end"), v.alias("value")))
    return F.filter(joined, lambda s: F.length(s["value"]) >= least)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, row, owner, repo, spans) for each row; spans are in order of start, then kind as listed."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(owner_col).alias("owner"), F.xxhash64(*repo_cols).alias("repo"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<struct<start:int,at:int,kind:string,end:int,value:string>>)")
    # few texts hold any candidate; the others are passed over after one search for each kind
    each = [F.when(F.col("text").rlike(KINDS[k][0]), _spans(F.col("text"), k)).otherwise(none) for k in KINDS]
    found = F.array_sort(F.concat(*each))
    return rows.select("id", F.monotonically_increasing_id().alias("row"), "owner", "repo", found.alias("spans"))


def ownership(found: DataFrame, example_owners: int = 3, example_repos: int = 6, live_repos: int = 2) -> DataFrame:
    """(hash, n_repos, n_owners, n_uses, verdict) of each candidate value, over the whole corpus.

    Repeats within a repository fall together before they are dealt out by hash, so a value that fills the corpus costs its
    hash one row a repository. ``verdict``: example from ``example_owners`` owners or ``example_repos`` repositories on; live
    for one owner with at most ``live_repos`` repositories; else shared.
    """
    values = found.select("owner", "repo", F.explode("spans").alias("span")).select(F.sha2(F.col("span.value"), 256).alias("hash"), "owner", "repo")
    per_repo = values.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    out = per_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_uses"))
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    verdict = F.when(copied, "example").when((F.col("n_owners") == 1) & (F.col("n_repos") <= live_repos), "live").otherwise("shared")
    return out.withColumn("verdict", verdict)


VERDICTS = ("live", "shared", "example")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), **limits: int) -> DataFrame:
    """(id, spans, n_live, n_shared, n_example, most_repos, most_owners) for each row of docs; the last two are 0 without candidates."""
    found = cut(find_secrets(docs, id_col, text_col, owner_col, repo_cols))
    verdicts = ownership(found, **limits)
    each = found.select("row", F.explode("spans").alias("span")).select("row", F.sha2(F.col("span.value"), 256).alias("hash")).groupBy("row", "hash").agg(F.count("*").alias("n"))
    count = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n"))).alias(f"n_{v}")
    spread = [F.max("n_repos").alias("most_repos"), F.max("n_owners").alias("most_owners")]
    judged = each.join(verdicts, "hash").groupBy("row").agg(*map(count, VERDICTS), *spread)
    numbers = [*(f"n_{v}" for v in VERDICTS), "most_repos", "most_owners"]
    return found.join(judged, "row", "left").select("id", "spans", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers))


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    mine = F.filter(spans, lambda s: reduce(lambda a, b: a | b, [s["kind"] == k for k in kinds]))
    return F.array_join(F.transform(mine, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
