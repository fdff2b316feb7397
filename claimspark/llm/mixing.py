"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule is the golden-ratio point frac((t + 1) * 0.618...), mapped through the cumulative target weights to a
source. The r-th slot of a source takes the r-th block of that source whole: its documents in the order of a seeded hash,
cut into blocks of equal length, and run through once more when they are used up. What a document is taken is the sum over
the slots that take its blocks, so the points alone decide how much a source gives: its blocks differ from its weight by the
discrepancy of the points, a few blocks, and by blocks cut short at a source's end. A slot whose source has been run through
``most`` times stays empty. Blocks have ``block_words`` words, fewer where sources are small: a mean source has at least
``least_blocks``.

Positions and ranks are prefix sums in two levels (totals of hash ranges or schedule ranges, then rows within one), so that
a source with most of the rows doesn't meet in one task; a range has about the square root of all rows, 4,096 at least.

Defined results: null text has size 0, and documents of size 0 are taken 0 times; a null source is a source of its own,
last in order; repeated rows count each, and one hash range holds all copies of a row with one id and text; an empty table,
or one without words, gives targets of 0.
"""

from __future__ import annotations

from math import ceil, isqrt, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import cut, word_count

#: The golden ratio's fraction in 64ths of a bit: points are whole multiples of it, modulo one.
GOLDEN = 0x9E3779B97F4A7C15
_SPLIT = 1 << 20


def _range_rows(rows: int, range_rows: int | None) -> int:
    return range_rows or max(4096, isqrt(rows))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: weights repeat over the sources by code point, null last.

    Together the targets are ``share`` of all words, but none passes ``most`` times its source; the excess goes to the
    others by weight until none is above. That level is found by sorting sources by the ratio of size to weight: the
    smallest ratios reach their limit first. The rows here are one a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1).cast("double")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # with the sources before this one at their limit, what is left is shared by weight; the first that fits ends the limits
    level = (F.col("total") * share - most * F.coalesce(F.sum("source_size").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = per.withColumn("w", w).withColumns({"total": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    rows = rows.withColumns({"level": level, "nth": F.row_number().over(by_ratio)})
    fits = F.col("level") * F.col("w") <= most * F.col("source_size")
    rows = rows.withColumn("at", F.min(F.when(fits, F.struct("nth", "level"))).over(everything)["level"])
    return rows.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("source_size") * most, F.coalesce(F.col("at") * F.col("w"), F.col("source_size") * most)).alias("target"))


def _before(df: DataFrame, keys: list[str], bucket: str, value: Column, order: list[Column], name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows before each one, by ``keys`` in the order of ``bucket`` and then ``order``."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    along = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(bucket) == F.col("_bucket")]
    return rows.join(base, on).withColumn(name, F.col("_base") + F.col("_own")).drop("_own", "_base", "_bucket", *(f"_{k}" for k in keys))


def schedule(quotas: DataFrame, slots: int, range_rows: int | None = None) -> DataFrame:
    """(slot, source, rank): ``slots`` golden-ratio points through the cumulative ``weight`` of quotas (one row a source).

    Bands of the cumulative weights and points meet by the cell of [0, 1) that they lie in, an equal join.
    """
    cells = 1 << max(12, (4 * quotas.count()).bit_length())
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = quotas.filter("weight > 0").withColumns({"to": F.sum("weight").over(order), "all": F.sum("weight").over(everything)})
    bands = ends.select("source", (F.col("to") / F.col("all")).alias("to")).withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("to")), F.lit(0.0)))
    cell = lambda c: F.least(F.lit(cells - 1), F.floor(c * cells))
    bands = bands.select("source", "from", "to", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))).alias("cell"))
    # frac((t + 1) * ratio) of t + 1 = a * 2^20 + b, from the exact fractions of both steps: products stay small
    step, leap = GOLDEN / 2**64, (GOLDEN * _SPLIT % 2**64) / 2**64
    t = F.col("id") + 1
    point = (F.shiftright(t, 20) * F.lit(leap) + (t % _SPLIT) * F.lit(step)) % 1.0
    size = _range_rows(slots, range_rows)
    points = quotas.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.col("id") / size).cast("long").alias("range"), point.alias("u"))
    placed = points.withColumn("cell", cell(F.col("u"))).join(bands, "cell").filter((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to")))
    return _before(placed, ["source"], "range", F.lit(1), [F.col("slot")], "rank").select("slot", "source", "rank")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block_words: int = 128,
    least_blocks: int = 1024,
    seed: int = 11,
    range_rows: int | None = None,
    small_sources: int = 10_000,
) -> DataFrame:
    """(id, size, source, source_size, target, taken, first_slot) for each row of docs; first_slot is null where nothing is taken."""
    at = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), at.alias("_at"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    bits = max(0, min(40, ceil(log2(max(1, n / _range_rows(n, range_rows))))))
    goals = cut(targets(rows, weights, share, float(most)))
    mean = goals.filter("source_size > 0").agg(F.avg("source_size")).first()[0] or 0
    length = max(1, min(block_words, int(mean // least_blocks)))
    # a source's blocks have one length, the last one at most that; its weight is its target in blocks
    long = F.ceil(F.col("source_size") / F.greatest(F.lit(1), F.round(F.col("source_size") / length)))
    quotas = goals.withColumn("long", F.greatest(F.lit(1), long).cast("long"))
    quotas = cut(quotas.withColumns({"blocks": F.ceil(F.col("source_size") / F.col("long")), "weight": F.col("target") / F.col("long")}))
    known = quotas.agg(F.count("*").alias("n"), F.sum("weight").alias("slots")).first()
    few = F.broadcast if known["n"] <= small_sources else lambda df: df
    q = quotas.select(F.col("source").alias("q_source"), "source_size", "target", "long", "blocks")
    same = F.col("source").eqNullSafe(F.col("q_source"))
    # the slots of each block, one for each run through its source
    slots = schedule(quotas.select("source", "weight"), ceil(known["slots"] or 0), range_rows)
    taking = slots.join(few(q), same).filter(F.col("rank") < most * F.col("blocks"))
    per_block = taking.groupBy(F.col("source").alias("b_source"), (F.col("rank") % F.col("blocks")).alias("b_block")).agg(F.count("*").alias("runs"), F.min("slot").alias("slot"))
    # the documents' places in their sources, and the stretch of each block that a document fills
    bucket = F.shiftright("_at", 64 - bits) if bits else F.lit(0).cast("long")
    laid = _before(rows.filter("size > 0").withColumn("bucket", bucket), ["source"], "bucket", F.col("size"), [F.col("_at"), F.col("id"), F.col("row")], "start")
    laid = laid.join(few(q.select("q_source", "long")), same).withColumn("end", F.col("start") + F.col("size"))
    block = lambda c: (c / F.col("long")).cast("long")
    piece = laid.select("row", "source", "start", "end", "long", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))).alias("block"))
    words = F.least(F.col("end"), (F.col("block") + 1) * F.col("long")) - F.greatest(F.col("start"), F.col("block") * F.col("long"))
    met = piece.join(per_block, piece["source"].eqNullSafe(per_block["b_source"]) & (piece["block"] == per_block["b_block"]))
    taken = met.groupBy("row").agg(F.sum(words * F.col("runs")).alias("taken"), F.min("slot").alias("first_slot"))
    out = rows.join(few(q), same).join(taken, "row", "left")
    return out.select("id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
