"""Hard negatives against all pairs, on clustered, repeated, tied and awkward vectors."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm import hardneg

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("id", T.StringType()), T.StructField("a.b", T.StringType()), T.StructField("block", T.LongType()),
])


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", "x", 7) for i, v, y in rows], SCHEMA)


def plain(rows, every=100, k=5, m=10):
    """All pairs, by definition; (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), with repeats."""
    width = Counter(len(v) for _, v, y in rows if v is not None).most_common(1)[0][0]
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if y is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for a, (i, q, y) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = [(sum(x * z for x, z in zip(q, r, strict=True)), j, u) for b, (j, r, u) in enumerate(ok) if b != a]
        for p in sorted((s for s in scored if s[2] == y), key=key)[:k]:
            fits = sorted((s for s in scored if s[2] != y and 30 * p[0] <= 100 * s[0] <= 90 * p[0]), key=key)[:m]
            out += [(i, p[1], rank, n[1], p[0], n[0]) for rank, n in enumerate(fits, 1)]
    return Counter(out)


def got(spark, rows, **options):
    out = hardneg.hard_negatives(table(spark, rows), F.col("id") % 100 == 0, **options)
    return Counter(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("options", [{}, {"cell_rows": 4, "chunk": 3, "first_rows": 20}, {"sample": 30, "cell_rows": 1}])
def test_against_all_pairs(spark, options):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(1400)]
    rows += [(1400 + i, [0.5] * 8, i % 3) for i in range(300)]  # ties at one point
    rows += [(2000, [0.0] * 8, 1), (2100, [-0.5] * 8, 2), (None, rows[3][1], 2), (None, rows[3][1], None), (2200, None, 1), (2201, [None] + [1.0] * 7, 1)]
    rows += [(2300, [float("nan")] * 8, 1), (2301, [float("inf")] * 8, 1), (2400, [1.0] * 3, 1), (2500, [], 1), rows[0], rows[0], rows[100]]
    assert got(spark, rows, **options) == plain(rows)


def test_small_and_empty_tables(spark):
    assert got(spark, []) == Counter()
    assert got(spark, [(100, [1.0, 2.0], 1)]) == Counter()
    assert got(spark, [(100, [], 1), (1, [], 1), (2, [], 2)]) == plain([(100, [], 1), (1, [], 1), (2, [], 2)])
    rows = [(100, [3.0], 1), (200, [2.0], 1), (1, [1.0], 2), (2, [1.5], 2), (3, [1.5], 3), (4, [-9.0], 2)]
    assert got(spark, rows) == plain(rows)
    with pytest.raises(ArithmeticError):
        got(spark, [(100, [1e30], 1), (1, [1e30], 1)])


def test_cells_are_certified_and_pruned():
    """Visits stop early on clustered vectors, and no cell left out holds a score above the floor."""
    rng = np.random.default_rng(2)
    x = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) for c in rng.normal(size=(20, 8)) * 40])).astype(np.int64)
    books = tuple(hardneg.codebook(h.astype(float), 12) for h in (x[:, :4], x[:, 4:]))
    codes = [hardneg.nearest(h.astype(float), b) for h, b in zip((x[:, :4], x[:, 4:]), books, strict=True)]
    radii = tuple(np.array([np.sqrt(((h[c == k] - b[k]) ** 2).sum(axis=1)).max(initial=0) for k in range(len(b))]) for h, b, c in zip((x[:, :4], x[:, 4:]), books, codes, strict=True))
    cell = codes[0] * len(books[1]) + codes[1]
    index = hardneg.Index(books, radii, len(books[1]), {int(c): (n, 1, int((cell == c).sum())) for n, c in enumerate(np.unique(cell))}, len(np.unique(cell)), True)
    asked, visited = x[::100], 0
    for q, high, low in zip(asked, *index.bounds(asked), strict=True):
        floor = int(np.sort(x @ q)[-10])
        seen = set(index.blocks_of(high, low, floor, float("inf")))
        assert {index.cells[int(c)][0] for c in cell[x @ q >= floor]} <= seen
        visited += len(seen)
    assert visited < 0.6 * len(asked) * index.blocks


def test_heap_order():
    rng = np.random.default_rng(1)
    high, low = (np.sort(rng.normal(size=n))[::-1] for n in (7, 11))
    sums = [s for s, _, _ in hardneg.heap_order(high, low)]
    assert sums == sorted(sums, reverse=True) and len(sums) == 77
    assert list(hardneg.heap_order(high[:0], low)) == []
