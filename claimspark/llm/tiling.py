"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become arrays of token hashes (lower-cased runs of letters and digits). Runs of ``seed``
tokens that an item shares with a text join the two; running Karp-Rabin then marks the longest matches that don't overlap,
again and again, down to ``seed`` tokens, in any order of the passages. Of equally long matches the one that begins first
in the item is marked first, then the one first in the text. An item leaks when the marked tokens reach ``coverage`` of it.

Both sides stay in Spark: a bitmap of fixed size tells which seeds can be an item's, texts send only such seeds and the
stretches around them, and a join by seed makes the pairs of texts and items. A tile of n tokens has n - seed + 1 seeds, so
an item that leaks of n tokens shares at least coverage * n / seed of its seeds; each item leaves its most frequent seeds out of the join,
as many as can be spared, so that a phrase of many items and texts makes no pairs by itself. Equal texts are tiled once.

Defined results: null or blank texts and items have no tokens and match nothing; an item shorter than the seed must occur
whole; repeated rows of either side are compared each; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import saved, slices, utf8_rows

_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
_PLACE_BITS = 24


def _byte_table() -> np.ndarray:
    """For each byte 0 where it stands between tokens, else its value with A-Z lower-cased; bytes of other scripts are letters."""
    return np.array([ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else i * (i >= 128) for i in range(256)], np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def token_hashes_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of UTF-8 text as 64-bit hashes, from prefix sums of a polynomial in its bytes, and where each begins."""
    value = _byte_table()[np.frombuffer(text, np.uint8)]
    inside = np.concatenate(([0], (value > 0).view(np.int8), [0]))
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return np.empty(0, np.uint64), start
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * _powers(len(value), _BASE), dtype=np.uint64)))
    inverse = _powers(len(value), pow(_BASE, -1, 1 << 64))
    hashed = (prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64)
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(_MIX)
    hashed ^= hashed >> np.uint64(32)
    return np.maximum(hashed, np.uint64(1)), start  # zero ends a stretch of tokens


def token_hashes(text: bytes) -> np.ndarray:
    return token_hashes_of(text)[0]


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` tokens (rolling Karp-Rabin, by prefix sums)."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * _powers(len(tokens), _BASE), dtype=np.uint64)))
    return (prefix[size:] - prefix[:-size]) * _powers(n, pow(_BASE, -1, 1 << 64))


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (pattern start, text start, length) of at least ``least`` tokens: longest matches first, none overlapping another."""
    free_p, free_t, tiles = np.ones(len(pattern), bool), np.ones(len(text), bool), []

    def open_runs(hashed: np.ndarray, free: np.ndarray, size: int) -> np.ndarray:
        used = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(used[size:] == used[: len(used) - size]) if len(hashed) else np.empty(0, np.int64)

    def meet(size: int) -> bool:
        """Whether a run of this length is free and the same on both sides; if so, one of every smaller length is too."""
        hash_p, hash_t = windows(pattern, size), windows(text, size)
        return bool(np.isin(hash_t[open_runs(hash_t, free_t, size)], hash_p[open_runs(hash_p, free_p, size)]).any())

    most = min(len(pattern), len(text))
    while most >= least and meet(least):
        size, past = least, most + 1  # the longest such run, by halving
        while past - size > 1:
            middle = (size + past) // 2
            size, past = (middle, past) if meet(middle) else (size, middle)
        hash_p, hash_t = windows(pattern, size), windows(text, size)
        at_t = open_runs(hash_t, free_t, size)
        where: dict[int, list[int]] = {}
        in_p = open_runs(hash_p, free_p, size)
        for t in at_t[np.isin(hash_t[at_t], hash_p[in_p])].tolist():
            where.setdefault(int(hash_t[t]), []).append(t)
        for p in in_p.tolist():
            for t in where.get(int(hash_p[p]), ()):
                if free_p[p : p + size].all() and free_t[t : t + size].all() and (pattern[p : p + size] == text[t : t + size]).all():
                    free_p[p : p + size] = free_t[t : t + size] = False
                    tiles.append((p, t, size))
                    break
        most = size - 1
    return tiles


def _runs(free: np.ndarray) -> list[tuple[int, int]]:
    turn = np.diff(np.concatenate(([0], free.view(np.int8), [0])))
    return list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True))


def _seeds(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` tokens, others for each size."""
    return (windows(tokens, size) ^ np.uint64(size)) * np.uint64(_MIX)


def _place(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - _PLACE_BITS)).astype(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.view(np.int64)))


def item_seeds(benchmark: DataFrame, item_id: str, item_text: str, seed: int) -> DataFrame:
    """(key, item, tokens, size, seeds) of each item with tokens: its seeds are of ``size`` tokens, one for each place."""
    items = benchmark.select(F.monotonically_increasing_id().alias("key"), F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    long = T.ArrayType(T.LongType())
    schema = T.StructType([items.schema["key"], items.schema["item"], T.StructField("tokens", long), T.StructField("size", T.IntegerType()), T.StructField("seeds", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [token_hashes(x) for x in utf8_rows(batch.column("text"))]
            some = np.flatnonzero([len(t) > 0 for t in tokens])
            tokens = [tokens[i] for i in some]
            sizes = [min(seed, len(t)) for t in tokens]
            seeds = [_seeds(t, k) for t, k in zip(tokens, sizes, strict=True)]
            kept = batch.take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("item"), _lists(tokens), pa.array(sizes, pa.int32()), _lists(seeds)], names=schema.names)

    return saved(items.mapInArrow(run, schema))


def _seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for each place of ``seed`` values, in words of 64; its size is fixed."""
    place = F.shiftrightunsigned("seed", 64 - _PLACE_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - _PLACE_BITS}) & 63 as int))")
    rows = seeds.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (_PLACE_BITS - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _stretches(tokens: np.ndarray, sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct seeds of a text that may be an item's, and the tokens of runs of these, each run ended by a zero."""
    seen, found = np.zeros(len(tokens), bool), []
    for size in sizes:
        hashed = _seeds(tokens, size)
        place = _place(hashed)
        at = np.flatnonzero(bits[place >> 6] >> (place & 63) & 1)
        found.append(hashed[at])
        for k in range(size):
            seen[at + k] = True
    parts = [x for a, b in _runs(seen) for x in (tokens[a:b], np.zeros(1, np.uint64))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64), np.concatenate(parts) if parts else np.empty(0, np.uint64)


def leaking_texts(texts: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", seed: int = 5, coverage: float = 0.8) -> DataFrame:
    """(text_key, text_key2, item, coverage, tiles) for each different text of ``texts`` (column text) and each item that it leaks."""
    items = item_seeds(benchmark, item_id, item_text, seed)
    by_seed = items.select("key", F.size("tokens").alias("n"), F.explode("seeds").alias("seed")).groupBy("key", "n", "seed").agg(F.count("*").alias("places"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    bitmap = texts.sparkSession.sparkContext.broadcast(_seed_bitmap(by_seed))
    keyed = texts.select("text", *text_keys(F.col("text")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in slices(batches):
            found = [_stretches(token_hashes(x), sizes, bits) for x in utf8_rows(batch.column("text"))]
            some = np.flatnonzero([len(s) > 0 for s, _ in found])
            kept = batch.take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("text_key"), kept.column("text_key2"), *(_lists([found[i][c] for i in some]) for c in (0, 1))], names=["text_key", "text_key2", "seeds", "tokens"])

    keys = ["text_key", "text_key2"]
    hits = saved(keyed.mapInArrow(search, "text_key long, text_key2 int, seeds array<long>, tokens array<long>").dropDuplicates(keys))
    use = hits.select(F.explode("seeds").alias("seed")).join(by_seed.select("seed").distinct(), "seed", "left_semi").groupBy("seed").agg(F.count("*").alias("uses"))
    # tiles have at least so many places of the item; the most frequent seeds, with fewer places together, can be spared
    least = F.ceil((F.lit(coverage) * F.col("n") - 1e-9) / F.least(F.lit(seed), F.col("n")))
    often_first = Window.partitionBy("key").orderBy(F.desc("uses"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    joined = saved(by_seed.join(use, "seed").withColumn("so_far", F.sum("places").over(often_first)).filter(F.col("so_far") >= least).select("seed", "key"))
    pairs = hits.select(*keys, F.explode("seeds").alias("seed")).join(joined, "seed").select(*keys, "key").distinct()
    items_of = items.select("key", "item", F.col("tokens").alias("pattern"), "size")
    met = pairs.join(items_of, "key").join(hits.select(*keys, "tokens"), keys).select(*keys, "item", "pattern", "size", "tokens")
    schema = T.StructType([met.schema["text_key"], met.schema["text_key2"], met.schema["item"], T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType())])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, share, tiles = [], [], []
            for k, size in enumerate(batch.column("size").to_pylist()):
                pattern, tokens = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in ("pattern", "tokens"))
                # tiles can't cover more than the shared seeds do
                shared = np.flatnonzero(np.isin(windows(pattern, size), windows(tokens, size)))
                if len(np.unique(shared[:, None] + np.arange(size))) >= coverage * len(pattern):
                    found = greedy_tiles(pattern, tokens, size)
                    if (c := sum(n for _, _, n in found) / len(pattern)) >= coverage:
                        at.append(k), share.append(c), tiles.append(len(found))
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in schema.names[:3]), pa.array(share, pa.float64()), pa.array(tiles, pa.int32())], names=schema.names)

    return saved(met.mapInArrow(tile, schema))


def text_keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("text_key"), F.hash(text).alias("text_key2")]


def _few(leaks: DataFrame, send_rows: int) -> DataFrame:
    return F.broadcast(leaks) if leaks.count() <= send_rows else leaks


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", send_rows: int = 500_000, **options) -> DataFrame:  # noqa: ANN003
    """(id, item, coverage, tiles) for each pair of a document and an item that it leaks. Only ids and hashes of texts are shuffled, and at most ``send_rows`` leaks are sent to the tasks."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    leaks = leaking_texts(rows.select("text"), benchmark, **options)
    return rows.select("id", *text_keys(F.col("text"))).join(_few(leaks, send_rows), ["text_key", "text_key2"]).select("id", "item", "coverage", "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", send_rows: int = 500_000, **options) -> DataFrame:  # noqa: ANN003
    """docs without those that leak an item; all columns stay. Up to ``send_rows`` leaking texts no row is moved."""
    text = F.col(f"`{text_col}`").cast("string")
    bad = leaking_texts(docs.select(text.alias("text")), benchmark, **options).select(F.col("text_key").alias("_bad"), F.col("text_key2").alias("_bad2")).distinct()
    key, key2 = text_keys(text)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), key, key2)
    clean = whole.join(_few(bad, send_rows), (F.col("text_key") == F.col("_bad")) & (F.col("text_key2") == F.col("_bad2")), "left_anti")
    return clean.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
