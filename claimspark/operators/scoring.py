"""Batch scoring of active claims, write-back, run statistics, and versions of feature rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scalars import clamp01
from claimspark.operators.features import NUMERIC, impute, quality_flag
from claimspark.plans.joins import keyed_upsert


class PipelineBlockedError(RuntimeError):
    """There is no model to score with."""


def active(store: DataFrame) -> DataFrame:
    return store.filter(F.col("claim_status") == "Active")


def scan_active(store: DataFrame) -> DataFrame:
    return active(store)


def get_row(store: DataFrame, claim_id: str) -> DataFrame:
    return store.filter(F.col("claim_id") == claim_id)


def delete_rows(store: DataFrame, ids: DataFrame) -> DataFrame:
    """store without the claims in ids (claim_id)."""
    return store.join(ids.select("claim_id").distinct(), "claim_id", "left_anti")


def call_model(model: object) -> Callable[[pd.DataFrame], pd.Series]:
    """One call for models with predict_proba, predict, or that are functions."""
    if hasattr(model, "predict_proba"):
        return lambda x: pd.Series(model.predict_proba(x.to_numpy())[:, 1], x.index)
    if hasattr(model, "predict"):
        return lambda x: pd.Series(model.predict(x.to_numpy()), x.index)
    return lambda x: pd.Series(model(x.to_numpy()), x.index)


def score(claims: DataFrame, model: object, features: tuple[str, ...] = NUMERIC) -> DataFrame:
    """claims with ``predicted_denial_score`` in [0, 1], ``score_quality_flag`` and ``score_error``.

    A batch that the model refuses is tried row by row; a row that it refuses has a null score and the reason.
    """
    if model is None:
        raise PipelineBlockedError("no production model")
    rows = impute(claims.withColumn("score_quality_flag", quality_flag(features)), features).drop("predicted_denial_score", "score_error")
    sent = claims.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # any callable, lambdas too

    # of a wide row only the features go to Python and the score comes back
    @F.pandas_udf("score double, error string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = call_model(cloudpickle.loads(sent.value))
        for x in batches:
            try:
                yield pd.DataFrame({"score": predict(x).astype(float), "error": None})
            except Exception:
                found = []
                for i in range(len(x)):
                    try:
                        found.append((float(predict(x.iloc[i : i + 1]).iloc[0]), None))
                    except Exception as e:
                        found.append((None, str(e) or type(e).__name__))
                yield pd.DataFrame({"score": pd.array([s for s, _ in found], "Float64"), "error": [e for _, e in found]})

    out = rows.withColumn("_s", run(F.struct(*(F.col(c).cast("double").alias(c) for c in features))))
    score = F.nanvl(F.col("_s.score"), F.lit(None).cast("double"))
    return out.withColumns({"score_error": F.col("_s.error"), "predicted_denial_score": F.when(score.isNotNull(), clamp01(score))}).drop("_s")


def run_record(store: DataFrame, model: object, features: tuple[str, ...] = NUMERIC) -> DataFrame:
    """One row about a scoring run over the active claims: ``status`` blocked without a model, else done; active, scored, degraded, failed."""
    claims = active(store)
    try:
        scored, status = score(claims, model, features), "done"
    except PipelineBlockedError:
        nothing = {"predicted_denial_score": F.lit(None).cast("double"), "score_quality_flag": F.lit(None).cast("string")}
        return run_stats(claims.withColumns(nothing)).select(F.lit("blocked").alias("status"), "active", "scored", "degraded", F.lit(0).cast("long").alias("failed"))
    return run_stats(scored).select(F.lit(status).alias("status"), "active", "scored", "degraded", "failed")


def linear_score(claims: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A deterministic scorer of column expressions, for checks."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
    return claims.withColumn("predicted_denial_score", clamp01(total))


def write_scores(store: DataFrame, scored: DataFrame) -> DataFrame:
    """store with the scores of rows that have one; unknown claims are left out."""
    columns = [c for c in ("claim_id", "predicted_denial_score", "score_quality_flag", "model_version", "scoring_timestamp") if c in scored.columns]
    return keyed_upsert(store, scored.filter("predicted_denial_score is not null").select(*columns), "claim_id", insert=False)


def run_stats(scored: DataFrame) -> DataFrame:
    done = F.col("predicted_denial_score").isNotNull()
    number = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return scored.agg(F.count("*").alias("active"), number(done).alias("scored"), number(done & (F.col("score_quality_flag") == "degraded")).alias("degraded"), number(~done).alias("failed"))


def stamp_version(df: DataFrame, version: str) -> DataFrame:
    return df.withColumn("schema_version", F.lit(version))


Migration = Callable[[DataFrame], DataFrame]


def migration_path(registry: dict[tuple[str, str], Migration], start: str, goal: str) -> list[tuple[str, str]] | None:
    """Hops from start to goal: a direct one if there is one, else the first registered from each version; None without a path."""
    path, at, seen = [], start, {start}
    while at != goal:
        hop = (at, goal) if (at, goal) in registry else next((h for h in registry if h[0] == at and h[1] not in seen), None)
        if hop is None:
            return None
        path.append(hop)
        at = hop[1]
        seen.add(at)
    return path


def migrate(df: DataFrame, registry: dict[tuple[str, str], Migration], current: str) -> tuple[DataFrame, DataFrame]:
    """(rows at the current version, quarantine of rows whose version has no path). The versions are few and known to the driver."""
    versions = [r[0] for r in df.select("schema_version").distinct().collect()]
    paths = {v: migration_path(registry, v, current) if v is not None else None for v in versions}
    out = df.filter(F.col("schema_version") == current)
    for v in sorted(v for v, p in paths.items() if p):
        rows = df.filter(F.col("schema_version") == v)
        for hop in paths[v]:
            rows = stamp_version(registry[hop](rows), hop[1])
        out = out.unionByName(rows, allowMissingColumns=True)
    lost = [v for v, p in paths.items() if p is None and v is not None]
    bad = df.filter(F.col("schema_version").isin(*lost) | F.col("schema_version").isNull()) if lost else df.filter(F.col("schema_version").isNull())
    return out, bad.select("claim_id", F.col("schema_version").alias("embedded_version"), F.lit(current).alias("current_version"))


def read_rows(spark, path: str, schema: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(rows, rejects) of JSON lines; a line that can't be read is a reject with its text."""
    from pyspark.sql import types

    fields = types.StructType.fromDDL(schema + ", _corrupt_record string")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", fields, {"mode": "PERMISSIVE"}).alias("row"))
    bad = F.col("row._corrupt_record").isNotNull()
    return rows.filter(~bad).select("row.*").drop("_corrupt_record"), rows.filter(bad).select("row._corrupt_record")


def write_by_day(df: DataFrame, path: str, date: str) -> None:
    """Replaces the days that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
