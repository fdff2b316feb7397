"""Hard negatives for contrastive training: exact search through an inverted multi-index.

Vectors are cut into two halves with a codebook each, and a pair of codewords is a cell. For an anchor, the inner product of
a half with any vector of a codeword is at most that with the codeword plus the half's length times the codeword's radius
(the greatest distance of a row from it); the sum of two such bounds holds for all rows of a cell. A multi-sequence heap
visits cells by falling bound, and stops once the bound is below what still can enter the result.

Cells lie in blocks of bounded size, large cells in several. Each anchor first asks the blocks of its best cells, which gives
a floor; then all blocks that hold a cell whose bound reaches the floor, in tasks of one block and at most ``chunk`` anchors,
where the heap runs over the block's cells. So results are exact however loose the bounds are: vectors without structure
cost a pass over all blocks, never a wrong row. Positives are found first, then the windows that their scores set.

Fitted on a sample: the codebooks (``sample`` rows at most, by a hash of the row). Sent to the tasks: codebooks, radii and the
block of each cell, at most 65,536 cells.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part, nor do vectors of another
length than most have (of equally many, the longest). Repeated rows are rows of their own, so a copy of an anchor can be its
positive, and each copy of an anchor has rows of its own. Equal scores go by id, null ids last. An anchor without positives,
or a window without rows, has no rows; so has an empty table. Scores that don't fit a long raise an error. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import bounded_sample, saved

CODEWORDS = 256
FOUND = "anchor long, slot int, score long, id long, row long"


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(row, id, label, q), stored: the rows that take part, each with a number of its own and its components as whole numbers."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    known = known.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    known = known.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))
    known = saved(known)
    common = known.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return known.filter(F.size("q") == (common["n"] if common else 0))


def codebook(vectors: np.ndarray, size: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``size`` means of the vectors, fewer if they are."""
    draw = np.random.default_rng(seed)
    means = vectors[draw.choice(len(vectors), min(size, len(vectors)), replace=False)].astype(float)
    for _ in range(rounds):
        near = nearest(vectors, means)
        for k in range(len(means)):
            if (near == k).any():
                means[k] = vectors[near == k].mean(axis=0)
    return means


def nearest(vectors: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.argmin((means**2).sum(axis=1) - 2 * (vectors @ means.T), axis=1)


def heap_order(high: np.ndarray, low: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs of two falling sequences, by falling sum."""
    heap = [(-(high[0] + low[0]), 0, 0)] if len(high) and len(low) else []
    while heap:
        total, i, j = heappop(heap)
        yield -total, i, j
        if j + 1 < len(low):
            heappush(heap, (-(high[i] + low[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(high):
            heappush(heap, (-(high[i + 1] + low[0]), i + 1, 0))


@dataclass(frozen=True)
class Index:
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    size: int  # codewords of the second half
    cells: dict[int, tuple[int, int, int]]  # first block, number of blocks, number of rows
    blocks: int
    exact: bool  # whether floats hold every score

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.books[0].shape[1]
        return q[:, :at].astype(float), q[:, at:].astype(float)

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each row of q and codeword of either half, what no row of the codeword exceeds; scores are whole, so half a point covers rounding."""
        out = []
        for half, book, radius in zip(self.halves(q), self.books, self.radii, strict=True):
            length = np.sqrt((half**2).sum(axis=1))[:, None]
            out.append(half @ book.T + length * radius + 0.25 + 1e-9 * length * (radius + np.sqrt((book**2).sum(axis=1))))
        return out

    def blocks_of(self, high: np.ndarray, low: np.ndarray, floor: float, rows: float) -> list[int]:
        """The blocks of the cells that the heap visits until the bound is below floor or ``rows`` rows are covered."""
        orders, found, covered = (np.argsort(-high, kind="stable"), np.argsort(-low, kind="stable")), set(), 0
        for bound, i, j in heap_order(high[orders[0]], low[orders[1]]):
            if bound < floor or covered >= rows:
                break
            if at := self.cells.get(int(orders[0][i]) * self.size + int(orders[1][j])):
                found.update(range(at[0], at[0] + at[1]))
                covered += at[2]
        return sorted(found)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def build(known: DataFrame, sample: int, cell_rows: int) -> tuple[Index, DataFrame]:
    """The index, and the rows with their block, stored."""
    n, least, most, width = known.agg(F.count("*"), F.min(F.array_min("q")), F.max(F.array_max("q")), F.max(F.size("q"))).first()
    peak, width = max(abs(least or 0), abs(most or 0)), width or 0
    if 100 * width * peak * peak >= 1 << 63:
        raise ArithmeticError(f"percentages of inner products of {width} components up to {peak} don't fit a long")
    drawn = _matrix(bounded_sample(known, F.col("row"), sample).select("q").toArrow()["q"]).astype(float)
    number, at = min(CODEWORDS, max(1, round(sqrt(n / cell_rows)))), width // 2
    books = tuple(codebook(x, number) if len(x) else np.zeros((1, x.shape[1])) for x in (drawn[:, :at], drawn[:, at:]))
    size = len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q")).astype(float)
            out = []
            for x, book in zip((q[:, :at], q[:, at:]), books, strict=True):
                code = nearest(x, book) if len(x) else np.zeros(0, np.int64)
                out += [code, np.sqrt(((x - book[code]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)]
            added = [pa.array((out[0] * size + out[2]).astype(np.int64)), pa.array(out[1]), pa.array(out[3])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "cell", "near", "far"])

    coded = saved(known.mapInArrow(run, "row long, id long, label long, q array<long>, cell long, near double, far double"))
    counted = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("near"), F.max("far").alias("far")).orderBy("cell").collect()
    radii = (np.zeros(len(books[0])), np.zeros(size))
    block_rows, cells, blocks, filled = min(16_384, max(1_024, n // 64)), {}, 0, 0
    for r in counted:
        u, v = divmod(r["cell"], size)
        radii[0][u], radii[1][v] = max(radii[0][u], r["near"]), max(radii[1][v], r["far"])
        if filled and filled + r["n"] > block_rows:
            blocks, filled = blocks + 1, 0
        parts = ceil(r["n"] / block_rows)
        cells[r["cell"]] = (blocks, parts, r["n"])
        blocks, filled = (blocks + parts, 0) if parts > 1 else (blocks, filled + r["n"])
    blocks += filled > 0
    places = coded.sparkSession.createDataFrame([(c, f, p) for c, (f, p, _) in cells.items()], "cell long, first int, parts int")
    block = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    dealt = coded.join(F.broadcast(places), "cell").select("row", "id", "label", "q", "cell", block.alias("block"))
    return Index(books, radii, size, cells, blocks, width * peak * peak < 1 << 53), saved(dealt)


def _best(score: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k by falling score, then id, then row."""
    if len(score) > k:
        there = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        there = np.arange(len(score))
    return there[np.lexsort((row[there], ident[there], -score[there]))][:k]


def _search_block(index: Index, rows: dict[str, np.ndarray], anchors: dict[str, np.ndarray], windows: list[list[tuple[int, int, int]]], k: int, same: bool) -> Iterator[tuple]:
    """(anchor, slot, score, id, row): for each anchor and window (slot, low, high) the block's first k rows with low <= score <= high."""
    order = np.argsort(rows["cell"], kind="stable")
    rows = {c: x[order] for c, x in rows.items()}
    kind = float if index.exact else np.int64
    vectors, asked = rows["q"].astype(kind), anchors["q"].astype(kind)
    cells, starts = np.unique(rows["cell"], return_index=True)
    ends = np.append(starts[1:], len(order))
    place = {int(c): (int(s), int(e)) for c, s, e in zip(cells, starts, ends, strict=True)}
    here = [np.unique(cells // index.size), np.unique(cells % index.size)]
    bounds = [b[:, h] for b, h in zip(index.bounds(anchors["q"]), here, strict=True)]
    orders = [np.argsort(-b, axis=1, kind="stable") for b in bounds]
    for a in range(len(asked)):
        found = [[slot, low, high, *(np.zeros(0, np.int64) for _ in range(3))] for slot, low, high in windows[a]]
        sequences = [b[a][o[a]] for b, o in zip(bounds, orders, strict=True)]
        names = [h[o[a]] for h, o in zip(here, orders, strict=True)]
        for bound, i, j in heap_order(*sequences):
            floor = min((w[1] for w in found), default=bound + 1)
            if bound < floor:
                break
            if not (at := place.get(int(names[0][i]) * index.size + int(names[1][j]))):
                continue
            score = vectors[at[0] : at[1]] @ asked[a]
            fits = (score >= floor) & ((rows["label"][at[0] : at[1]] == anchors["label"][a]) == same) & (rows["row"][at[0] : at[1]] != anchors["row"][a])
            fits = np.flatnonzero(fits)
            if not len(fits):
                continue
            score = score[fits].astype(np.int64)
            for w in found:
                into = np.flatnonzero((score >= w[1]) & (score <= w[2]))
                if len(into):
                    new = at[0] + fits[into]
                    both = [np.concatenate(x) for x in ((w[3], score[into]), (w[4], rows["key"][new]), (w[5], rows["row"][new]))]
                    best = _best(*both, k)
                    w[3:] = [x[best] for x in both]
                    if len(best) == k:
                        w[1] = max(w[1], int(w[3][-1]))
        for slot, _, _, score, ident, row in found:
            yield from zip([int(anchors["row"][a])] * len(score), [slot] * len(score), score.tolist(), ident.tolist(), row.tolist(), strict=True)


NO_ID = (1 << 63) - 1
ALL = 1 << 62


def ask(index: Index, rows: DataFrame, anchors: DataFrame, k: int, same: bool, chunk: int, first_rows: float | None = None) -> DataFrame:
    """(anchor, slot, score, id, row), stored: the first k rows of each anchor's windows, from all blocks that can hold one, or
    from those of the best cells with ``first_rows`` rows. anchors: (row, label, q, slots, lows, highs)."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lows = [min(x, default=None) for x in batch.column("lows").to_pylist()]
            bounds = index.bounds(_matrix(batch.column("q")))
            to = [index.blocks_of(high, low, floor, first_rows or float("inf")) if floor is not None else [] for high, low, floor in zip(*bounds, lows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int32()))], names=[*batch.schema.names, "blocks"])

    chunks = max(1, ceil(anchors.count() / chunk))
    columns = "row long, label long, q array<long>, slots array<int>, lows array<long>, highs array<long>"
    sent = anchors.select("row", "label", "q", "slots", "lows", "highs").mapInArrow(route, f"{columns}, blocks array<int>")
    sent = sent.withColumn("block", F.explode("blocks")).drop("blocks").withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    parts = min(4096, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.blocks * chunks))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            data = {c: right[c].to_numpy() for c in ("row", "label", "cell")} | {"q": _matrix(right["q"])}
            data["key"] = right["id"].fill_null(NO_ID).to_numpy()
            asked = {c: left[c].to_numpy() for c in ("row", "label")} | {"q": _matrix(left["q"])}
            windows = [list(zip(*w, strict=True)) for w in zip(*(left[c].to_pylist() for c in ("slots", "lows", "highs")), strict=True)]
            out = list(_search_block(index, data, asked, windows, k, same))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "slot", "score", "id", "row"])

    met = sent.repartition(parts, "block", "chunk").groupBy("block", "chunk").cogroup(dealt.repartition(parts, "block", "chunk").groupBy("block", "chunk")).applyInArrow(search, FOUND)
    place = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return saved(met.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k))


def _raised(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """anchors, the low end of each window raised to its k-th score so far."""
    kth = found.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    low = F.transform("slots", lambda s, i: F.greatest(F.get("lows", i), F.coalesce(F.try_element_at("kth", s), F.get("lows", i))))
    return anchors.join(kth.withColumnRenamed("anchor", "row"), "row", "left").withColumn("lows", low).drop("kth")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10,
    percent: tuple[int, int] = (30, 90), sample: int = 10_000, cell_rows: int = 256, chunk: int = 16_384, first_rows: int = 4_096,
) -> DataFrame:
    """(anchor, anchor_id, positive, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``. For each anchor and each of its ``positives`` first rows of the same label,
    the ``negatives`` first rows of another label whose score is between the two percentages of the positive's.
    """
    known = prepared(rows, id_col, vector_col, F.col("label") if label is None else label, scale)
    index, dealt = build(known, sample, cell_rows)
    anchors = dealt.filter(is_anchor).select("row", "id", "label", "q")
    asked = anchors.withColumns({"slots": F.array(F.lit(0)), "lows": F.array(F.lit(-ALL)), "highs": F.array(F.lit(ALL))})
    first = ask(index, dealt, asked, positives, True, chunk, first_rows)
    pairs = ask(index, dealt, _raised(asked, first, positives), positives, True, chunk)

    # 100 n >= a p and 100 n <= b p, in whole numbers; an empty window isn't asked
    low = F.expr(f"-((-score * {percent[0]} - pmod(-score * {percent[0]}, 100)) div 100)")
    high = F.expr(f"(score * {percent[1]} - pmod(score * {percent[1]}, 100)) div 100")
    edges = pairs.withColumns({"low": low, "high": high}).filter("low <= high")
    edges = edges.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").alias("slot"), "low", "high")).alias("w"))
    windows = anchors.join(edges.withColumnRenamed("anchor", "row"), "row").select("row", "label", "q", *(F.col(f"w.{c}").alias(f"{c}s") for c in ("slot", "low", "high")))
    windows = saved(windows)
    first = ask(index, dealt, windows, negatives, False, chunk, first_rows)
    found = ask(index, dealt, _raised(windows, first, negatives), negatives, False, chunk)

    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    pairs = pairs.select("anchor", F.col("rank").alias("slot"), own("id").alias("positive_id"), F.col("row").alias("positive"), F.col("score").alias("positive_score"))
    found = found.select("anchor", "slot", "rank", own("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = found.join(pairs, ["anchor", "slot"]).join(named, "anchor")
    return out.select("anchor", "anchor_id", "positive", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
