"""Plan patterns with windows: trailing rates by day, leave-one-out rates, and global ranks without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.plans.views import cut

DAYS = 90


def day_number(date: str | Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def trailing_counts(claims: DataFrame, keys: list[str], date: str = "submission_date", outcome: str = "adjudication_outcome", days: int = DAYS) -> DataFrame:
    """(keys, date, known, denied, volume) over [date - days, date], both ends included, for each key and day with claims.

    Claims are counted by day first, so a window holds at most one row a day.
    """
    daily = claims.filter(F.col(date).isNotNull()).groupBy(*keys, date).agg(
        F.sum(F.when(F.col(outcome).isin("paid", "denied"), 1).otherwise(0)).alias("known"),
        F.sum(F.when(F.col(outcome) == "denied", 1).otherwise(0)).alias("denied"),
        F.count("*").alias("volume"),
    )
    over = Window.partitionBy(*keys).orderBy(day_number(date)).rangeBetween(-days, 0)
    return daily.select(*keys, date, *(F.sum(c).over(over).alias(c) for c in ("known", "denied", "volume")))


def population_rates(claims: DataFrame, default: float, date: str = "submission_date", outcome: str = "adjudication_outcome", days: int = DAYS) -> DataFrame:
    """(date, population): the share of denied among known claims in the trailing window; one row a day of history."""
    by_day = trailing_counts(claims.withColumn("_all", F.lit(0)), ["_all"], date, outcome, days)
    share = F.coalesce(F.col("denied").cast("double") / F.nullif(F.col("known"), F.lit(0)), F.lit(default))
    return by_day.select(F.col(date).alias("_date"), share.alias("population"))


def trailing_rate(claims: DataFrame, keys: list[str], least: int, default: float, name: str, date: str = "submission_date", outcome: str = "adjudication_outcome", days: int = DAYS) -> DataFrame:
    """claims with ``name`` (own rate from ``least`` known claims on, else the population's) and ``name``_known, _denied, _volume and _population."""
    counts = trailing_counts(claims, keys, date, outcome, days)
    counts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(date).alias("_day"), *(F.col(c).alias(f"{name}_{c}") for c in ("known", "denied", "volume")))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(date) == F.col("_day")]
    # the population has a row for each day of history, some tens of thousands at most
    rows = claims.join(counts, on, "left").join(F.broadcast(population_rates(claims, default, date, outcome, days)), F.col(date) == F.col("_date"), "left")
    own = F.col(f"{name}_denied").cast("double") / F.nullif(F.col(f"{name}_known"), F.lit(0))
    everyone = F.coalesce("population", F.lit(default))
    rows = rows.withColumns({name: F.when(F.col(f"{name}_known") >= least, own).otherwise(everyone), f"{name}_population": everyone})
    return rows.drop("_day", "_date", "population", *(f"_{k}" for k in keys))


def trailing_cube(claims: DataFrame, sets: dict[str, tuple[str, ...]], counts: dict[str, Column], date: str = "submission_date", days: int = DAYS, send_rows: int = 200_000) -> DataFrame:
    """claims with {set}_{count}: for each set of keys the sums of ``counts`` over [date - days, date]; the empty set is everyone.

    Claims are summed by all keys and day once. From these cells come the sums by each set and day (grouping sets), and one
    window over all of them. Sets with at most ``send_rows`` keys and days are sent to the claims; where one has more, all sets
    are joined to the cells, and these once to the claims. A claim without a date has nulls.
    """
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    cells = cut(claims.groupBy(*keys, date).agg(*(F.sum(c).alias(name) for name, c in counts.items())))
    daily = cells.filter(F.col(date).isNotNull()).groupingSets([[*map(F.col, s), F.col(date)] for s in sets.values()], *keys, date)
    daily = daily.agg(F.grouping_id().alias("_set"), *(F.sum(F.col(c)).alias(f"_{c}") for c in counts))
    over = Window.partitionBy("_set", *keys).orderBy(day_number(date)).rangeBetween(-days, 0)
    sums = cut(daily.select("_set", *keys, date, *(F.sum(f"_{c}").over(over).alias(c) for c in counts)))
    sizes = {r["_set"]: r["count"] for r in sums.groupBy("_set").count().collect()}  # a row for each set
    small = max(sizes.values(), default=0) <= send_rows
    out = claims if small else cells.drop(*counts)
    for name, mine in sets.items():
        number = sum(1 << (len(keys) - i) for i, k in enumerate(keys) if k not in mine)  # a bit for each key that is summed over
        found = sums.filter(F.col("_set") == number).select(*(F.col(k).alias(f"_{k}") for k in mine), F.col(date).alias("_date"), *(F.col(c).alias(f"{name}_{c}") for c in counts))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in mine] + [F.col(date) == F.col("_date")]
        out = out.join(F.broadcast(found) if sizes.get(number, 0) <= send_rows else found, on, "left").drop("_date", *(f"_{k}" for k in mine))
    if small:
        return out
    ends = [*keys, date]
    named = out.withColumnsRenamed({k: f"_{k}" for k in ends})
    return claims.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ends]).drop(*(f"_{k}" for k in ends))


def leave_one_out(name: str, least: int = 30, outcome: str = "adjudication_outcome") -> Column:
    """From trailing_rate() columns: the rate of the other claims where more than ``least`` are known, else the population's."""
    own_known = F.col(outcome).isin("paid", "denied").cast("int")
    own_denied = F.coalesce((F.col(outcome) == "denied").cast("int"), F.lit(0))
    others = F.col(f"{name}_known") - F.coalesce(own_known, F.lit(0))
    rest = (F.col(f"{name}_denied") - own_denied).cast("double") / F.nullif(others, F.lit(0))
    return F.when(F.col(f"{name}_known") > least, rest).otherwise(F.col(f"{name}_population"))


def anchored_rates(claims: DataFrame, key: str, anchor: str, least: int, default: float, days: int = DAYS, date: str = "submission_date", outcome: str = "adjudication_outcome") -> DataFrame:
    """(key, known, denied, volume, rate) in the one window that ends at ``anchor``, for the nightly batch."""
    day = F.to_date(F.lit(anchor))
    inside = claims.filter(F.col(date).between(F.date_sub(day, days), day))
    sums = lambda df: df.agg(F.sum(F.col(outcome).isin("paid", "denied").cast("int")).alias("known"), F.sum((F.col(outcome) == "denied").cast("int")).alias("denied"), F.count("*").alias("volume"))
    population = sums(inside).select(F.coalesce(F.col("denied").cast("double") / F.nullif(F.col("known"), F.lit(0)), F.lit(default)).alias("population"))
    per = sums(inside.groupBy(key)).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("known", "denied")})
    own = F.col("denied").cast("double") / F.nullif(F.col("known"), F.lit(0))
    return per.crossJoin(F.broadcast(population)).withColumn("rate", F.when(F.col("known") >= least, own).otherwise(F.col("population"))).drop("population")


def leave_last_out(claims: DataFrame, key: str, order: list[str], anchor: str, least: int = 30, days: int = DAYS, date: str = "submission_date", outcome: str = "adjudication_outcome") -> DataFrame:
    """(key, rate): all known claims of the window but the last in ``order``; for keys with more than ``least`` known, else the population's rate."""
    day = F.to_date(F.lit(anchor))
    known = claims.filter(F.col(date).between(F.date_sub(day, days), day) & F.col(outcome).isin("paid", "denied")).withColumn("_d", (F.col(outcome) == "denied").cast("int"))
    population = known.agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("population"))
    per = known.groupBy(key).agg(F.count("*").alias("n"), F.sum("_d").alias("d"), F.max_by("_d", F.struct(*order)).alias("last"))
    rate = F.when(F.col("n") > least, (F.col("d") - F.col("last")).cast("double") / (F.col("n") - 1)).otherwise(F.col("population"))
    return per.crossJoin(F.broadcast(population)).select(key, rate.alias("rate"))


def in_order(df: DataFrame, order: list[Column], rows_a_part: int = 500_000) -> DataFrame:
    """df, stored in ``order``, with ``_part`` (its stretch of that order) and ``_at`` (its place in the stretch, from 0).

    Spark samples the whole order, ties included, for stretches of about equal numbers of rows, so one value that most rows
    share is spread like any other where the order goes on to a key. There are as many as the rows ask for, and no fewer than
    shuffles have.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_a_part))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))


def running(rows: DataFrame, sums: dict[str, Column], by: tuple[str, ...] = (), include: bool = True) -> DataFrame:
    """From in_order() rows: with the sums over all rows of the same ``by`` up to each one, or before it.

    A scan in two levels: within a stretch, and over the totals of stretches, a row for each stretch and value of ``by`` in it.
    """
    names = {name: f"_sum_{name}" for name in sums}
    within = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    before = Window.partitionBy(*(by or (F.lit(0),))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *by).agg(*(F.sum(c).alias(names[n]) for n, c in sums.items()))
    starts = totals.select(F.col("_part").alias("_p"), *(F.col(b).alias(f"_{b}") for b in by), *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in names.values()))
    met = rows.join(starts, [F.col("_part") == F.col("_p"), *(F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by)])
    return met.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(names[n]) for n, c in sums.items()}).drop("_p", *(f"_{b}" for b in by), *names.values())


def global_rank(df: DataFrame, value: str, tie: str, descending: bool = False, ntiles: int | None = None, prefix: str = "") -> DataFrame:
    """df with ``prefix``percent_rank of ``value`` and, if asked for, ``prefix``ntile, ordered by ``value`` then ``tie`` over all rows.

    Rows lie in stretches of the whole order, ties included, and the stretches' counts give each its offset. The rank of a value
    is its least row: that of its rows in the stretch, or, for the first value of a stretch, which may have begun before,
    that of all its rows; there are no more of these than stretches. Nulls of ``value`` come last.
    """
    at = F.col(value)
    rows = in_order(df, [at.desc_nulls_last() if descending else at.asc_nulls_last(), F.col(tie)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = cut(rows.groupBy("_part").agg(F.count("*").alias("count"), F.min_by(F.struct(at.alias("v")), "_at").alias("first")))
    offsets = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(everything).alias("_n"))
    rows = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("_row", F.col("_at") + F.col("_before") + 1)
    firsts = totals.select(F.col("first.v").alias("_value")).distinct()
    long = rows.join(F.broadcast(firsts), at.eqNullSafe(F.col("_value"))).groupBy("_value").agg(F.min("_row").alias("_begin"))
    rows = rows.withColumn("_least", F.min("_row").over(Window.partitionBy("_part", value)))
    rows = rows.join(F.broadcast(long), at.eqNullSafe(F.col("_value")), "left").withColumn("_rank", F.coalesce("_begin", "_least"))
    out = {f"{prefix}percent_rank": F.when(F.col("_n") > 1, (F.col("_rank") - 1).cast("double") / (F.col("_n") - 1)).otherwise(F.lit(0.0))}
    if ntiles:
        small, extra, row = F.floor(F.col("_n") / ntiles), F.col("_n") % ntiles, F.col("_row") - 1
        head = extra * (small + 1)
        out[f"{prefix}ntile"] = F.when(row < head, F.floor(row / (small + 1)) + 1).otherwise(extra + F.floor((row - head) / F.greatest(small, F.lit(1))) + 1).cast("int")
    return rows.withColumns(out).drop("_part", "_at", "_p", "_before", "_n", "_row", "_value", "_begin", "_least", "_rank")
