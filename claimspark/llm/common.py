"""What several corpus operators share: lineage cuts, Arrow text access, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from math import ceil
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process (tests); else it raises."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not known:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df written to the shared folder as Parquet, and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/saved-{uuid4()}"
    df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """At most ``bound`` rows of df, those first by a hash of ``key``; ties in the hash fall to the smaller key.

    Rows are thinned by the hash to about twice the bound where they are, so the one task that orders them reads few.
    """
    n, place = df.count(), F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if n > 2 * bound:
        df = df.filter(place < int((1 << 40) * (2 * bound + 100) / n))
    return df.orderBy(place, key).limit(bound)


def least_count(counted: DataFrame, most: int, least: int = 1) -> int:
    """The smallest number, ``least`` or above, that at most ``most`` rows of counted reach in column n; to an eighth of a power of two above 4096."""
    sizes = counted.select("n").filter(F.col("n") >= least)
    # one row for each count below 4096, one for each eighth of a power of two above
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n") * 8) / 8)) + 1)
    rows = sizes.groupBy(level.cast("long").alias("level")).count().orderBy(F.desc("level")).collect()
    total = 0
    for r in rows:
        total += r["count"]
        if total > most:
            return r["level"] + 1 if r["level"] < 4096 else int(2 ** (round(np.log2(r["level"]) * 8 + 1) / 8)) + 1
    return least


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``rows`` rows each, so that what is made of a batch's texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8_rows(column: pa.Array) -> Iterator[bytes]:
    """The values of a string or binary column as UTF-8 bytes, null as empty, without decoding."""
    column = column.cast(pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def least_of_component(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the least one that the links (i, j) reach."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: within each partition, every node to the least node that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[batch.column(c).to_numpy() for c in "uv"] for batch in batches]
        if ends:
            u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            least = least_of_component(len(nodes), at[: len(u)], at[len(u) :])
            far = np.flatnonzero(least != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[least[far]])], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 40, part_rows: int = 200_000) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v), both longs; root is the component's least node.

    Tasks contract ``part_rows`` edges each; if that is more than one task, what is left alternates large-star and small-star rounds (Kiveris et al., 2014); each round is two shuffles with map-side minima, so a
    hub costs a group no more than one row a task, and the joins back are sort-merge joins that Spark splits when skewed.
    Nodes without edges don't appear; an empty input gives an empty result; repeated edges and loops are harmless.
    """

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        return row["n"], row["h"]

    at = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    parts = ceil(at.count() / part_rows)
    at = cut(_contracted(at.coalesce(max(1, parts))))
    before = mark(at) if parts > 1 else (0, None)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        at = cut(small)
        now = mark(at)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
