"""Join patterns: as-of by one sort, intervals, keyed upserts, longest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, value: Column, name: str, strict: bool) -> DataFrame:
    """left with ``name``: ``value`` of the latest right row of the same keys before left_date (or on it, unless strict).

    The distinct keys and dates of left are stacked with the right rows and sorted once by key and date, so a key has two rows a
    date there however many rows it has, and what is found is joined back by key and date: one key's rows are spread by date.
    Right rows of one key and date must be reduced to one before. Null keys or dates match nothing.
    """
    ends = [*(f"_{k}" for k in keys), "_at"]
    named = lambda df, date: df.filter(F.col(date).isNotNull()).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(date).alias("_at"), "*")
    marks = named(right, right_date).select(*ends, F.lit(1 if strict else -1).alias("_side"), F.struct(value.alias("v")).alias("_value"))
    asked = named(left, left_date).dropna(subset=ends).select(*ends).distinct()
    rows = asked.select(*ends, F.lit(0).alias("_side"), F.lit(None).cast(marks.schema["_value"].dataType).alias("_value")).unionByName(marks)
    over = Window.partitionBy(*ends[:-1]).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.col("_value")["v"], ignorenulls=True).over(over)
    found = rows.withColumn("_found", last).filter("_side = 0").select(*ends, "_found")
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(left_date) == F.col("_at")]
    return left.join(found, on, "left").withColumn(name, F.col("_found")).drop(*ends, "_found")


def any_interval(left: DataFrame, ranges: DataFrame, key: str, date: str, flag: str, name: str) -> DataFrame:
    """left with ``name``: 1 if any range of the key that covers the date, ends included and open ends allowed, has its flag.

    A sweep line: each flagged range opens on its first day and closes on the day after its last; these changes, summed by key
    and day, are stacked with the days asked for, and a running sum by key tells how many ranges are open. So a key has two
    rows a day there, however many of its ranges overlap.
    """
    key_, at = F.col(key).alias("_key"), F.col(date).alias("_at")
    flagged = ranges.filter(F.col(flag).cast("int") == 1).filter(F.col(key).isNotNull() & F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("start") <= F.col("end"))))
    opened, closed = flagged.select(key_, F.col("start").cast("date").alias("_at"), F.lit(1).alias("_change")), flagged.filter(F.col("end").isNotNull()).select(key_, F.date_add("end", 1).alias("_at"), F.lit(-1).alias("_change"))
    changes = opened.unionAll(closed).groupBy("_key", "_at").agg(F.sum("_change").alias("_change"), F.lit(0).alias("_day"))
    days = left.select(key_, at).distinct().dropna().select("_key", F.col("_at").cast("date").alias("_at"), F.lit(0).cast("long").alias("_change"), F.lit(1).alias("_day"))
    open_ = F.sum("_change").over(Window.partitionBy("_key").orderBy("_at", "_day").rowsBetween(Window.unboundedPreceding, 0))
    hits = changes.unionByName(days).withColumn("_open", open_).filter("_day = 1 and _open > 0").select("_key", "_at", F.lit(1).alias("_hit"))
    return left.join(hits, (F.col(key) == F.col("_key")) & (F.col(date) == F.col("_at")), "left").withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_key", "_at", "_hit")


def keyed_upsert(store: DataFrame, new: DataFrame, key: str, insert: bool = True) -> DataFrame:
    """store with the columns of new set where its key is present, nulls included; other columns and rows stay.

    With insert, keys only in new become rows with nulls elsewhere; without, they are left out. Keys are unique on both sides.
    """
    fresh = new.select(F.col(key).alias("_key"), F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key))
    rows = store.join(fresh, F.col(key) == F.col("_key"), "full_outer" if insert else "left")
    chosen = [F.coalesce(key, "_key").alias(key)]
    chosen += [(F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in new.columns else F.col(c)).alias(c) for c in store.columns if c != key]
    chosen += [F.col(f"_new_{c}").alias(c) for c in new.columns if c not in store.columns]
    return rows.select(*chosen)


def longest_prefix(codes: DataFrame, code: str, prefixes: DataFrame, least: int = 3) -> DataFrame:
    """codes with ``prefix`` and ``weight`` of the longest listed prefix of each code; codes without one are left out.

    prefixes (prefix, weight) is a reference table; Spark broadcasts it by its size.
    """
    lengths = F.when(F.length(code) >= least, F.sequence(F.length(code), F.lit(least)))
    each = codes.select("*", F.explode(F.transform(lengths, lambda n: F.substring(F.col(code), F.lit(1), n))).alias("prefix"))
    keys = codes.columns
    return each.join(prefixes, "prefix").groupBy(*keys).agg(F.max_by(F.struct("prefix", "weight"), F.length("prefix")).alias("_best")).select(*keys, "_best.prefix", "_best.weight")
