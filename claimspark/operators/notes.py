"""Features of clinical notes: text preparation, embeddings by a pluggable encoder, and the defaults."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scalars import PRIOR_AUTH, necessity_score, phrase_flag
from claimspark.plans.windows import in_order, running

TOKENS = 10_000
DIMENSION = 768
HELD = 256  # vectors that a Python worker holds at once


def prepare_notes(notes: DataFrame, key: str, order: list[str], text: str = "text", most: int = TOKENS) -> DataFrame:
    """(key, text): the notes of a key in order, blank ones left out, cut to ``most`` tokens joined by one space.

    Tokens are counted along each key's notes first, in stretches of the whole order and over these, and notes that begin beyond
    the cut are dropped where they are; so at most ``most`` notes of a key are gathered, and a key of any size is spread.
    """
    tokens = F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")
    rows = notes.filter(F.col(text).rlike(r"\S")).select(key, *order, F.col(text).alias("_sort"), F.slice(tokens, 1, most).alias("_tokens"))
    rows = in_order(rows, [F.col(key), *map(F.col, order), F.col("_sort")])
    early = running(rows, {"_before": F.size("_tokens")}, (key,), include=False).filter(F.col("_before") < most)
    kept = early.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "_at", "_tokens"))).alias("_n"))
    return kept.select(key, F.concat_ws(" ", F.slice(F.flatten(F.transform("_n", lambda n: n["_tokens"])), 1, most)).alias(text))


def hash_encoder(dimension: int = DIMENSION) -> Callable[[str], np.ndarray]:
    """A stand-in for a language model: a vector drawn from the text's digest."""
    return lambda text: np.random.default_rng(int.from_bytes(hashlib.md5(text.encode()).digest()[:8])).random(dimension, np.float32)


def encoded(batches: Iterator[pd.Series], encode: Callable[[str], np.ndarray], dimension: int) -> Iterator[pd.DataFrame]:
    """(embedding, error) of each text, in frames of ``HELD`` rows at most."""
    for texts in (t[i : i + HELD] for t in batches for i in range(0, len(t), HELD)):
        rows = []
        for t in texts:
            try:
                v = np.asarray(encode(t), np.float32)
                rows.append((v, None) if v.shape == (dimension,) else (None, f"dimension {v.shape}"))
            except Exception as e:  # one bad text must not fail the batch
                rows.append((None, str(e) or type(e).__name__))
        yield pd.DataFrame(rows, columns=["embedding", "error"])


def embed(df: DataFrame, load: Callable[[], Callable[[str], np.ndarray]] = hash_encoder, text: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """df with ``embedding`` and ``embedding_error`` (null if none); ``load`` makes the encoder, once a Python worker's task."""

    @F.pandas_udf("embedding array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return encoded(batches, load(), dimension)

    return df.withColumn("_e", run(F.col(text))).withColumns({"embedding": F.col("_e.embedding"), "embedding_error": F.col("_e.error")}).drop("_e")


def note_features(claims: DataFrame, notes: DataFrame, load: Callable = hash_encoder, order: tuple[str, ...] = ("note_datetime",), patterns: tuple[str, ...] = PRIOR_AUTH, model: str = "hash-encoder", version: str = "1", dimension: int = DIMENSION) -> DataFrame:
    """(claim_id, documents_medical_necessity, mentions_lack_of_pre_auth, clinical_text_embedding, nlp_flag, model, version).

    Flag 0: encoded; 1: no notes; 2: the encoder failed on this row. For 1 and 2 the defaults 0.5, 0 and zeros hold.
    """
    texts = embed(prepare_notes(notes, "claim_id", list(order)), load, dimension=dimension)
    rows = claims.select("claim_id").join(texts, "claim_id", "left")
    fine = F.col("embedding").isNotNull()
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimension)
    return rows.select(
        "claim_id", F.when(fine, necessity_score(F.col("embedding"))).otherwise(F.lit(0.5)).alias("documents_medical_necessity"), F.when(fine, phrase_flag(F.col("text"), patterns)).otherwise(F.lit(0)).alias("mentions_lack_of_pre_auth"),
        F.coalesce("embedding", zeros).alias("clinical_text_embedding"), F.when(F.col("text").isNull(), 1).when(~fine, 2).otherwise(0).alias("nlp_flag"), F.lit(model).alias("nlp_model"), F.lit(version).alias("nlp_model_version"),
    )
