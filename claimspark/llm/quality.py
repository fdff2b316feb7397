"""Document quality by Bradley-Terry pairwise ranking.

A preference pair says that one document is better than another. The score of a document is linear in features of its whole
text, and is learned by logistic loss on the feature differences of such pairs. A threshold is then set at a quantile of the
training scores (by default the share of label 0 among them), and scores are shifted so that it lies at ``cut_at``.

Defined results: null text counts as empty and is scored like any other; labels that are null are not used, and of repeated
labels of one document the highest counts; without labels of both kinds no preference is known, and every score is
``cut_at``; an empty table gives an empty result. Only text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import bounded_sample, saved

FEATURES = ("log_words", "log_lines", "word_length", "long_words", "distinct", "repeated", "upper", "digits", "symbols", "bars", "shouts", "line_repeats", "stops", "letters")
SYMBOLS = "#$%&*~^@<>{}[]\\+="


def features(text: str) -> list[float]:
    """FEATURES of one text, each between 0 and a small number."""
    words = text.split()
    n, m = max(len(text), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = sum(map(str.__eq__, words, words[1:])) / m
    digits = sum(map(text.count, "0123456789")) / n
    symbols = sum(map(text.count, SYMBOLS)) / n
    return [
        log1p(len(words)) / 10, log1p(len(lines)) / 10, min(n / m, 40) / 10, sum(len(w) > 15 for w in words) / m, len(set(words)) / m, sqrt(repeated),
        sum(map(str.isupper, words)) / m, sqrt(digits), sqrt(symbols), sqrt(min(1, text.count("|") / m)), sqrt(min(1, text.count("!") / m)),
        1 - len(set(lines)) / max(len(lines), 1), sqrt(min(1, (text.count(".") + text.count(",")) / m)), sum(map(str.isalpha, words)) / m,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    cut_at: float

    def score(self, text: str) -> float:
        raw = float(((np.array(features(text)) - self.mean) / self.scale) @ self.weight) - self.threshold
        return 1 / (1 + exp(-max(-30.0, min(30.0, raw + log(self.cut_at / (1 - self.cut_at))))))


def fit_pairs(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """The Bradley-Terry weights of rows ``better[i]`` preferred to ``worse[i]``, by Newton's method."""
    diff = better - worse
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        gradient = -(diff.T @ p) / len(diff) + penalty * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed: Column, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``bound`` rows, of labelled documents that are first by a hash of the id, in that order.

    Where such documents are repeated, the rows themselves are sampled again by a hash, before any comes to the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    known = bounded_sample(known.filter(allowed), F.col(id_col), bound)
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    chosen = texts.join(F.broadcast(known), id_col).select(F.xxhash64(id_col).alias("at"), F.col("_label").alias("label"), F.col("_text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(x) for x in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("label"), found], names=["at", "label", "x"])

    found = saved(chosen.mapInArrow(run, "at long, label int, x array<double>"))
    rows = bounded_sample(found, F.struct("at", "label", "x"), bound).toPandas()
    rows["key"] = rows["x"].map(tuple)
    rows = rows.sort_values(["at", "label", "key"])
    return np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["label"].to_numpy(int)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", allowed: Column | None = None, bound: int = 20_000, pairs: int = 60_000, reject: float | None = None, cut_at: float = 0.7, seed: int = 7) -> Model:
    """A model from at most ``bound`` labelled rows among those ``allowed``, ``pairs`` preference pairs and the quantile ``reject``."""
    x, y = training_rows(docs, labels, id_col, text_col, label_col, F.lit(True) if allowed is None else allowed, bound)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = len(FEATURES)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, cut_at)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    draw = np.random.default_rng(seed)
    w = fit_pairs(z[draw.choice(good, pairs)], z[draw.choice(bad, pairs)])
    raw = z @ w
    share = len(bad) / len(y) if reject is None else reject
    return Model(mean, scale, w, float(np.quantile(raw, share)), cut_at)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.score(x) for x in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["id", "score"])

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the model's cut, with all their columns."""
    cut_at = model.cut_at

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py() or "") >= cut_at for x in texts], pa.bool_())

    return docs.filter(good(F.col(text_col)))


def held_out(id_col: str) -> Column:
    """Rows kept for evaluation: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_train(id_col: str) -> Column:
    return ~held_out(id_col)
