"""Training windows, labels, temporal splits and boosted trees."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.scalars import gate_stage
from claimspark.operators.features import NUMERIC, impute
from claimspark.operators.monitoring import auc_roc, average_precision, binary_metrics, ece
from claimspark.plans.views import cut


class InsufficientDataError(ValueError):
    """Fewer labelled rows than a model needs."""


def in_window(as_of: str, days: int, date: str = "submission_date") -> Column:
    day = F.lit(as_of).cast("date")
    return F.col(date).between(F.date_sub(day, days), day)


def labelled(df: DataFrame, outcome: str = "adjudication_outcome") -> DataFrame:
    return df.withColumn("label", F.when(F.col(outcome) == "denied", 1).when(F.col(outcome) == "paid", 0)).filter("label is not null")


def select_window(df: DataFrame, as_of: str, min_records: int = 1000, days: int = 90, wide: int = 180) -> DataFrame:
    """Labelled rows of the window, widened when it has fewer than min_records; InsufficientDataError if that isn't enough."""
    found = window_record(df, as_of, min_records, days, wide).first()
    if found["halted"]:
        raise InsufficientDataError(f"{found['far']} labelled rows in {wide} days, {min_records} needed")
    return labelled(df).filter(in_window(as_of, found["days"]))


def window_record(df: DataFrame, as_of: str, min_records: int = 1000, days: int = 90, wide: int = 180, outcome: str = "adjudication_outcome") -> DataFrame:
    """One row, what select_window() goes by: ``near`` and ``far`` labelled rows of both windows, ``excluded`` rows of the wide one
    that have no label, the ``days`` of the window chosen (null if none), and whether training is ``halted``."""
    known = F.col(outcome).isin("denied", "paid")
    number = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    rows = df.agg(number(in_window(as_of, days) & known).alias("near"), number(in_window(as_of, wide) & known).alias("far"), number(in_window(as_of, wide) & ~F.coalesce(known, F.lit(False))).alias("excluded"))
    chosen = F.when(F.col("near") >= min_records, days).when(F.col("far") >= min_records, wide)
    return rows.withColumns({"days": chosen, "halted": chosen.isNull()})


def _cuts(df: DataFrame, at: dict[str, Column], date: str) -> DataFrame:
    """One row: for each name the first date with more rows up to it than the index given in terms of ``n``."""
    daily = df.groupBy(date).count()
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = daily.withColumns({"cum": F.sum("count").over(Window.orderBy(date)), "n": F.sum("count").over(everything)})
    return rows.agg(*(F.min(F.when(F.col("cum") > index, F.col(date))).alias(name) for name, index in at.items()))


def temporal_split(df: DataFrame, test: float = 0.2, date: str = "submission_date") -> DataFrame:
    """df with ``split``: train before the cut date, test from it on; the cut's whole day is in test."""
    cut = _cuts(df, {"_cut": F.col("n") - F.ceil(F.col("n") * test)}, date)
    return df.crossJoin(F.broadcast(cut)).withColumn("split", F.when(F.col(date) < F.col("_cut"), "train").otherwise("test")).drop("_cut")


def temporal_split3(df: DataFrame, train: float = 0.7, validation: float = 0.15, date: str = "submission_date") -> DataFrame:
    cuts = _cuts(df, {"_a": F.floor(F.col("n") * train), "_b": F.floor(F.col("n") * (train + validation))}, date)
    split = F.when(F.col(date) < F.col("_a"), "train").when(F.col(date) < F.col("_b"), "validation").otherwise("test")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", split).drop("_a", "_b")


def split_stats(df: DataFrame, date: str = "submission_date") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("total"), F.avg("label").alias("denied_share"), F.min(date).alias("first"), F.max(date).alias("last"))


def class_weight(df: DataFrame) -> DataFrame:
    """One row: paid / denied where denied rows are under 5 % and there are some, else 1."""
    rows = df.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("denied"), F.count("*").alias("n"))
    share = F.col("denied").cast("double") / F.nullif("n", F.lit(0))
    return rows.select("denied", "n", F.when((share > 0) & (share < 0.05), (F.col("n") - F.col("denied")).cast("double") / F.col("denied")).otherwise(F.lit(1.0)).alias("weight"))


def assembler(features: list[str] | tuple[str, ...] = NUMERIC, output: str = "_features") -> VectorAssembler:
    """The stage that makes one vector of the features, in their order; nulls become NaN."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep")


def assemble(df: DataFrame, features: list[str] | tuple[str, ...] = NUMERIC, output: str = "features") -> DataFrame:
    """df with the vector of its features, nulls as 0."""
    return assembler(features, output).transform(impute(df, tuple(features)))


def fit(train: DataFrame, features: list[str], weight: float = 1.0, **params) -> PipelineModel:  # noqa: ANN003
    rows = train.withColumn("_weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    trees = GBTClassifier(labelCol="label", featuresCol="_features", weightCol="_weight", seed=7, **params)
    return Pipeline(stages=[assembler(features), trees]).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df).withColumn("score", F.greatest(F.least(vector_to_array("probability")[1], F.lit(1.0)), F.lit(0.0)))
    return out.drop("_features", "rawPrediction", "probability", "prediction")


def search(train: DataFrame, validation: DataFrame, features: list[str], trials: int = 50, seed: int = 1, threads: int = 4, weight: float = 1.0, errors: list[tuple[dict, str]] | None = None) -> tuple[dict, float]:
    """(parameters, precision) of the best of ``trials`` random settings. A trial that fails counts 0, and its setting and reason go to ``errors``; if all fail, the last reason is raised."""
    failed = [] if errors is None else errors
    draw = random.Random(seed)
    settings = [{"maxDepth": draw.randint(3, 8), "maxIter": draw.randint(10, 60), "stepSize": round(10 ** draw.uniform(-2, -0.5), 4), "subsamplingRate": round(draw.uniform(0.6, 1.0), 2), "minInstancesPerNode": draw.randint(1, 20)} for _ in range(trials)]

    def run(params: dict) -> float:
        try:
            return binary_metrics(predict(fit(train, features, weight, **params), validation)).first()["precision"]
        except Exception as e:
            failed.append((params, f"{type(e).__name__}: {e}"))
            return 0.0

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(run, settings))
    if trials and len(failed) >= trials:
        raise RuntimeError(f"all {trials} trials failed; the last one: {failed[-1][1]}")
    best = max(range(trials), key=lambda i: (found[i], -i))
    return settings[best], found[best]


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: precision, recall, f1, auc_roc, auc_pr, ece. The scores are computed once."""
    scored = cut(scored.select("score", "label"))
    out = binary_metrics(scored).crossJoin(F.broadcast(auc_roc(scored))).crossJoin(F.broadcast(average_precision(scored)))
    return out.crossJoin(F.broadcast(ece(scored)))


def exchanged(test: DataFrame, features: list[str], group: Column, order: Column) -> DataFrame:
    """test once as it is (``feature`` null), and once for each feature with that feature's values exchanged between rows.

    Each row takes the value of the row before it in ``order`` within its ``group``, the first one that of the last.
    """
    w = Window.partitionBy(group).orderBy(order)
    values = F.struct(*features)
    last = F.last(values).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = test.withColumn("_other", F.coalesce(F.lag(values).over(w), last)).withColumn("feature", F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, features))))
    return rows.withColumns({f: F.when(F.col("feature") == f, F.col(f"_other.{f}")).otherwise(F.col(f)) for f in features}).drop("_other")


def importance_of(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(feature, importance) from exchanged() rows with scores: how much of the area under the curve each exchange costs; one job for all."""
    areas = cut(auc_roc(scored, score, label, ("feature",)))
    base = areas.filter("feature is null").select(F.col("auc_roc").alias("_base"))
    return areas.filter("feature is not null").crossJoin(F.broadcast(base)).select("feature", (F.col("_base") - F.col("auc_roc")).alias("importance"))


def permutation_importance(model: PipelineModel, test: DataFrame, features: list[str], top: int = 20, seed: int = 3) -> DataFrame:
    """(feature, importance): the loss of AUC when a feature's values are exchanged between rows by a seeded shuffle. A row for each
    row and feature is scored, in one pass whatever the number of features."""
    numbered = cut(test.select("label", *features, F.monotonically_increasing_id().alias("_i")))
    groups = max(64, numbered.count() // 10_000)
    mixed = exchanged(numbered, features, F.pmod(F.xxhash64("_i", F.lit(seed)), F.lit(groups)), F.xxhash64(F.lit(seed + 1), "_i"))
    return importance_of(predict(model, mixed)).orderBy(F.col("importance").desc(), "feature").limit(top)


@dataclass(frozen=True)
class TrainingRun:
    """What a run gives: the model, its parameters, one row of test metrics with the gate's ``stage``, and the importances."""

    model: PipelineModel
    params: dict
    metrics: DataFrame
    importance: DataFrame


def run_training(df: DataFrame, features: list[str], as_of: str, min_records: int = 1000, trials: int = 50, params: dict | None = None, top: int = 20) -> TrainingRun:
    """Window, split by date, class weight, search (unless ``params`` are given), final fit, and metrics on the test rows.

    InsufficientDataError where the wide window has too few labelled rows. The split rows are checkpointed, as each trial reads them.
    """
    rows = temporal_split3(impute(select_window(df, as_of, min_records), tuple(features)))
    rows = rows.select("label", "split", *features).checkpoint()
    part = lambda name: rows.filter(F.col("split") == name)
    weight = class_weight(part("train")).first()["weight"]
    chosen = search(part("train"), part("validation"), features, trials, weight=weight)[0] if params is None else params
    model = fit(part("train"), features, weight, **chosen)
    metrics = evaluate(predict(model, part("test"))).withColumn("stage", gate_stage(F.col("precision"), F.col("ece")))
    return TrainingRun(model, chosen, metrics, permutation_importance(model, part("test"), features, top))
