"""Model metrics, rolling precision, retention and failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.scalars import alert_tier
from claimspark.plans.windows import day_number, in_order, running

KNOWN = "adjudication_outcome in ('denied', 'paid')"


def _number(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def binary_metrics(scored: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """precision, recall and f1 at a threshold, 0 where a denominator is."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    rows = scored.agg(_number(p & y).alias("tp"), _number(p & ~y).alias("fp"), _number(~p & y).alias("fn"), _number(~p & ~y).alias("tn"))
    over = lambda a, b: F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))
    rows = rows.withColumns({"precision": over(F.col("tp"), F.col("tp") + F.col("fp")), "recall": over(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def _curve(scored: DataFrame, score: str, label: str, by: tuple[str, ...]) -> DataFrame:
    """For each distinct score of ``by`` its positives and negatives, and those with a higher or equal score; one row a distinct score.

    Distinct scores lie in stretches of their order, about as many in each, wherever in [0, 1] they are; sums run within these,
    and the stretches' totals give each its start.
    """
    per = scored.filter(F.col(label).isin(0, 1)).groupBy(*by, F.col(score).alias("s")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    rows = in_order(per, [*(F.col(b).asc() for b in by), F.col("s").desc_nulls_last()])
    return running(rows, {"pos_up": F.col("pos"), "neg_up": F.col("neg")}, by)


def auc_roc(scored: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Ties count half; 0 with one class only. One row, or one for each value of ``by``."""
    area = F.sum(F.col("neg") * ((F.col("pos_up") - F.col("pos")).cast("double") + F.col("pos") / F.lit(2.0)))
    return _curve(scored, score, label, by).groupBy(*by).agg(F.coalesce(area / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0)), F.lit(0.0)).alias("auc_roc"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """The step sum of precision over the gains in recall; 0 with one class only. One row, or one for each value of ``by``."""
    precision = F.col("pos_up").cast("double") / (F.col("pos_up") + F.col("neg_up"))
    area = F.when(F.sum("neg") > 0, F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos"), F.lit(0)))
    return _curve(scored, score, label, by).groupBy(*by).agg(F.coalesce(area, F.lit(0.0)).alias("auc_pr"))


def ece(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins; the last one holds its right end. Edges are those of i / bins."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + F.when(F.col(score) >= e, 1).otherwise(0)
    per = scored.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(label).alias("y"))
    return per.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("ece"))


def monitor(store: DataFrame, as_of: str, days: int = 30, least: int = 30, threshold: float = 0.5, date: str = "scored_date") -> DataFrame:
    """The monitoring record of a day: rows scored in (as_of - days, as_of] with a known outcome."""
    day = F.lit(as_of).cast("date")
    rows = store.filter((F.col(date) > F.date_sub(day, days)) & (F.col(date) <= day) & F.col("predicted_denial_score").isNotNull() & F.expr(KNOWN))
    p, y = F.col("predicted_denial_score") >= threshold, F.col("adjudication_outcome") == "denied"
    out = rows.agg(F.count("*").alias("total"), _number(p).alias("predicted_denials"), _number(p & y).alias("true_positives"), _number(p & ~y).alias("false_positives"))
    precision = F.when((F.col("total") >= least) & (F.col("predicted_denials") > 0), F.col("true_positives").cast("double") / F.col("predicted_denials"))
    out = out.withColumn("rolling_precision", precision).withColumn("alert_tier", alert_tier(F.col("rolling_precision")))
    return out.withColumns({"as_of": day, "retraining": F.when(F.col("alert_tier") == "urgent", "active").otherwise("inactive")})


def precision_history(store: DataFrame, days: int = 30, least: int = 30, threshold: float = 0.5, date: str = "scored_date") -> DataFrame:
    """monitor()'s precision for each day with scored rows: daily counts, then one window over days."""
    p, y = F.col("predicted_denial_score") >= threshold, F.col("adjudication_outcome") == "denied"
    daily = store.filter(F.col("predicted_denial_score").isNotNull() & F.expr(KNOWN) & F.col(date).isNotNull()).groupBy(date).agg(F.count("*").alias("n"), _number(p).alias("p"), _number(p & y).alias("tp"))
    over = Window.orderBy(day_number(date)).rangeBetween(-days + 1, 0)
    rows = daily.select(date, *(F.sum(c).over(over).alias(c) for c in ("n", "p", "tp")))
    precision = F.when((F.col("n") >= least) & (F.col("p") > 0), F.col("tp").cast("double") / F.col("p"))
    return rows.select(date, F.col("n").alias("total"), precision.alias("rolling_precision"), alert_tier(precision).alias("alert_tier"))


def retention_check(store: DataFrame, today: str, days: int = 90, date: str = "scored_date") -> DataFrame:
    """oldest, threshold and whether to alert: the oldest dated row is before the threshold, and at least two are dated."""
    limit = F.date_sub(F.lit(today).cast("date"), days)
    rows = store.agg(F.min(date).alias("oldest"), F.count(date).alias("dated")).withColumn("threshold", limit)
    return rows.withColumn("alert", F.coalesce((F.col("dated") >= 2) & (F.col("oldest") < F.col("threshold")), F.lit(False)))


def failure_streak(runs: DataFrame, threshold: int = 3, key: str = "model", order: str = "run_id") -> DataFrame:
    """runs with ``streak`` of failures so far and ``escalate``. A run that is neither Failed nor Archived resets; Archived does neither."""
    failed, reset = F.col("stage") == "Failed", ~F.col("stage").isin("Failed", "Archived")
    up = Window.partitionBy(key).orderBy(order)
    rows = runs.withColumn("_island", F.sum(F.when(reset, 1).otherwise(0)).over(up))
    rows = rows.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy(order)))
    return rows.withColumn("escalate", failed & (F.col("streak") >= threshold)).drop("_island")


def pipeline_health(runs: DataFrame, limit: int = 240) -> DataFrame:
    """The last run, with whether it broke its time limit. runs: run_ts, minutes, scored, failed."""
    return runs.orderBy(F.col("run_ts").desc()).limit(1).withColumn("sla_breach", F.col("minutes") > limit)
