"""SimHash near-duplicates with a Gray-order hierarchical index.

Each text gets a 64-bit fingerprint over its word shingles. Distinct fingerprints are linked when few bits differ. The index
factors masked bit patterns into its upper nodes: any two fingerprints within ``distance`` bits agree on at least two of
``distance + 2`` bit blocks, so every pair of blocks gives one mask, and the masked value is a node that Spark's shuffle
deals to a task. Below it, a task sorts the node's fingerprints by Gray rank, which puts equal bit prefixes side by side,
and descends four bits at a time over pairs of nodes; a pair whose accumulated differences pass the limit is pruned with
everything below it. A node with more than ``node_limit`` fingerprints is not descended in one task: its fingerprints are
dealt again by all values one flipped bit away, which finds the same links in groups of bounded size.

Few changed words move more than two bits of a short text's fingerprint. With ``similarity`` (a Jaccard similarity of
five-word shingles), all pairs of texts that are alike by it are linked too, by their exact sets of shingle hashes. Shingles
have one order, with those of many texts last; two sets that alike share one of the first ``prefix_length`` shingles, so a
shuffle by these brings each such pair together. Pairs are first made along stars and chains of each shingle's texts; after
these links are components, only texts of different components are paired in full, so a group of copies doesn't make all
its pairs. Every candidate is verified on the full sets, in joins.

Defined results: null or blank text has fingerprint zero and is linked like any other; repeated rows get one row each; an
empty table gives an empty result; a null id keeps its row, and takes the component of its fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import connected_components, cut, least_of_component, slices, utf8_rows

SEED = 42
_CHUNK = 1 << 20
_BITMAP = 1 << 15
_PLACES = 4096
SET_SHINGLE = 5


def _bit_table() -> np.ndarray:
    return ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of UTF-8 text: A-Z lower-cased, words between ASCII spaces, each shingle hashed by XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    size = min(shingle, len(words))
    starts, hashed = [0, *ends[: len(words) - size]], xxhash.xxh64_intdigest
    total, bits, n = np.zeros(64, np.int64), _bit_table(), len(starts)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : at + _CHUNK], ends[at + size - 1 :], strict=False)
        lanes = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in spans), "<u8").view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            total[8 * lane : 8 * lane + 8] += np.bincount(lanes[:, lane], minlength=256) @ bits
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of the shingles of SET_SHINGLE words (of all words where there are fewer), sorted; none without words."""
    words = text.lower().split()
    size, hashed = min(SET_SHINGLE, len(words)), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.int64)
    shingles = (b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return np.unique(np.fromiter((hashed(x, SEED) for x in shingles), np.uint64).view(np.int64))


def least_overlap(n: int, similarity: float) -> int:
    """The least number of shingles that a set of n shares with any set that is alike."""
    return ceil(similarity * n - 1e-9)


def _occupied(found: np.ndarray) -> bytes:
    places = np.zeros(_PLACES, bool)
    places[found & (_PLACES - 1)] = True
    return np.packbits(places).tobytes()


def prefix_length(n: int, similarity: float) -> int:
    return n - least_overlap(n, similarity) + 1 if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None, late: np.ndarray | None = None) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. With ``similarity`` also text_key, and of the set of shingles its key, its size n, its first shingles and the places that it occupies of _PLACES.

    ``late`` lists the shingles that come last in the order, the later the further back.
    """
    wide = similarity is not None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text")) if wide else rows
    more = [T.StructField(c, T.LongType()) for c in ("text_key", "key", "n")] + [T.StructField("first", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())]
    schema = T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())] + wide * more)
    late = np.zeros(0, np.int64) if late is None else late
    sorter = np.argsort(late)
    known = late[sorter]

    def leading(found: np.ndarray) -> np.ndarray:
        place = np.zeros(len(found), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            place = np.where(known[at] == found, sorter[at] + 1, 0)
        return found[np.lexsort((found, place))][: prefix_length(len(found), similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, shingle) for x in utf8_rows(batch.column("text"))], np.uint64)
            columns = [batch.column("id"), pa.array(found.view(np.int64))]
            if wide:
                sets = [shingle_set(x) for x in utf8_rows(batch.column("text"))]
                key = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                columns += [batch.column("text_key"), pa.array(key), pa.array([len(x) for x in sets], pa.int64()), pa.array(map(leading, sets), pa.list_(pa.int64())), pa.array(map(_occupied, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def frequent_shingles(docs: DataFrame, text_col: str, share: int = 16, least: int = 4, most: int = 100_000) -> np.ndarray:
    """The most frequent shingles of a sample of the texts, rarer ones first. They only settle the order of shingles: any order finds the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in utf8_rows(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text))], names=["shingle"])

    sample = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    counted = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= least)
    rows = counted.orderBy(F.desc("count"), "shingle").limit(most).select("shingle").collect()
    return np.array([r["shingle"] for r in rows], np.int64)[::-1].copy()


def near_pairs(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of distinct fingerprints of one group with at most ``distance`` differing bits, by a descent in Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    order = np.lexsort((rank, group))
    g, value, n = group[order], fp[order], len(order)
    new_group = np.append(True, g[1:] != g[:-1])
    start = np.flatnonzero(new_group)
    a = b = np.arange(len(start))
    apart = np.zeros(len(start), np.int64)
    for shift in range(60, -1, -4):
        prefix = value >> np.uint64(shift)
        below = np.flatnonzero(new_group | np.append(True, prefix[1:] != prefix[:-1]))
        first = np.searchsorted(below, start)
        count = np.append(first[1:], len(below)) - first
        ways = count[a] * count[b]
        pick = np.repeat(np.arange(len(a)), ways)
        step = np.arange(len(pick)) - np.repeat(np.cumsum(ways) - ways, ways)
        across = count[b][pick]
        x, y = first[a][pick] + step // across, first[b][pick] + step % across
        differ = apart[pick] + np.bitwise_count((prefix[below][x] ^ prefix[below][y]) & np.uint64(15)).astype(np.int64)
        keep = (x <= y) & (differ <= distance)
        a, b, apart, start = x[keep], y[keep], differ[keep], below
    linked = a < b
    assert n == len(start), "fingerprints of a group must be distinct"
    return order[a[linked]], order[b[linked]]


def hamming_links(values: DataFrame, distance: int = 2, node_limit: int = 4096, chunk: int = 65536) -> DataFrame:
    """Edges (u, v) between the distinct longs ``fp`` that join all within ``distance`` bits of each other.

    Within a node only a star per component is returned, so the edges grow with the nodes' sizes, not with their squares.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    blocks = distance + 2
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    masks = [part[i] | part[j] for i, j in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    nodes = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("node")) for i, m in enumerate(signed)))
    dealt = values.select("fp", F.explode(nodes).alias("at")).select("at.mask", "at.node", "fp")
    heavy = cut(dealt.groupBy("mask", "node").count().filter(F.col("count") > node_limit).drop("count"))
    links = []
    if not heavy.isEmpty():
        # Two values are within 2 bits just when some value is at most one flip from both; within 1, when one is a flip of the other.
        one = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
        mask = F.element_at(F.array(*map(F.lit, signed)), F.col("mask") + 1)
        flips = F.array_compact(F.array(F.col("fp"), *(F.when(mask.bitwiseAND(bit) == 0, F.col("fp").bitwiseXOR(bit)) for bit in one)))
        spread = dealt.join(heavy, ["mask", "node"], "left_semi").select("fp", F.explode(flips).alias("near")).distinct()
        if distance == 2:
            hub = spread.groupBy("near").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("near", "v")
        else:
            hub = values.select(F.col("fp").alias("near"), F.col("fp").alias("v"))
        links.append(spread.join(hub, "near").filter("fp <> v").select(F.col("fp").alias("u"), "v"))
        dealt = dealt.join(heavy, ["mask", "node"], "left_anti")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def descend(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            group = np.cumsum(change) - 1
            many = np.bincount(group)[group] > 1
            if many.any():
                fp, group = rows[many, 2], group[many]
                order = np.argsort(fp, kind="stable")  # so that the least position of a component is its least fingerprint
                fp, group = fp[order], group[order]
                root = least_of_component(len(fp), *near_pairs(group, fp.view(np.uint64), distance))
                far = root != np.arange(len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[root[far]])], names=["u", "v"])

        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(3)], axis=1))
            size += len(held[-1])
            if size >= chunk:
                rows = np.concatenate(held)
                starts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
                last = int(starts[-1]) if len(starts) else 0  # the last group may go on in the next batch
                yield from descend(rows[:last]) if last else ()
                held, size = [rows[last:]], len(rows) - last
        if size:
            yield from descend(np.concatenate(held))

    dealt = dealt.repartition("mask", "node").sortWithinPartitions("mask", "node")
    links.append(dealt.mapInArrow(index, "u long, v long"))
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _may_be_alike(n: Column, m: Column, i: Column, j: Column, similarity: float) -> Column:
    """Whether sets of sizes n and m whose first common shingle is at places i and j can be alike."""
    return F.least(n - i, m - j) * (1 + similarity) >= similarity * (n + m) - 1e-9


def sharing(sets: DataFrame, chunk: int = 65536) -> DataFrame:
    """(h, key, n, i) of the leading shingles h that several sets have, with the key, n and i of two others: the least by a hash and the one before."""
    columns = ("h", "key", "n", "i")
    dealt = sets.select("key", "n", F.posexplode("first").alias("i", "h")).select("h", "key", "n", F.col("i").cast("long").alias("i"))
    names = [*columns, *(f"{c}_{k}" for k in (1, 2) for c in columns[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def several(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.append(True, rows[1:, 0] != rows[:-1, 0])
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new)[group]
            many = np.bincount(group)[group] > 1
            before = np.maximum(np.arange(len(rows)) - 1, start)
            out = np.concatenate([rows, rows[start, 1:], rows[before, 1:]], axis=1)[many]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in out.T], names=names)

        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in columns], axis=1))
            size += len(held[-1])
            if size >= chunk:
                rows = np.concatenate(held)
                starts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
                last = int(starts[-1]) if len(starts) else 0  # the last group may go on in the next batch
                yield from several(rows[:last]) if last else ()
                held, size = [rows[last:]], len(rows) - last
        if size:
            yield from several(np.concatenate(held))

    return dealt.repartition("h").withColumn("place", F.xxhash64("key", "h")).sortWithinPartitions("h", "place").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def possible(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that may be alike: a shingle at a place that the other set leaves free is not in that set. No pair that is alike is lost."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n = {c: batch.column(f"n_{c}").to_numpy() for c in "ab"}
            bits = {c: np.frombuffer(b"".join(batch.column(f"bits_{c}").to_pylist()), np.uint64).reshape(batch.num_rows, _PLACES // 64) for c in "ab"}
            most = [n[c] - np.bitwise_count(bits[c] & ~bits[d]).sum(axis=1, dtype=np.int64) for c, d in ("ab", "ba")]
            keep = np.flatnonzero(np.minimum(*most) * (1 + similarity) >= similarity * (n["a"] + n["b"]) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in "ab"], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, text_col: str, sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose full sets of shingles are alike."""

    pairs = cut(possible(sets, pairs, similarity))
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    needed = cut(sets.join(needed, "key", "left_semi").select("key", "text_key"))
    # a bitmap of fixed size, so that few other texts are taken apart and shuffled; the join settles it
    place = F.pmod("text_key", F.lit(64 * _BITMAP))
    words = needed.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(text_key & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    bitmap = np.zeros(_BITMAP, np.int64)
    for r in words:
        bitmap[r["at"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = np.mod(batch.column("text_key").to_numpy(), 64 * _BITMAP)
            few = batch.take(pa.array(np.flatnonzero((bitmap[at >> 6] >> (at & 63)) & 1)))
            found = pa.array([shingle_set(x) for x in utf8_rows(few.column("text"))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([few.column("text_key"), found], names=["text_key", "found"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    full = cut(texts.mapInArrow(run, "text_key long, found array<long>").dropDuplicates(["text_key"]).join(needed, "text_key").select("key", "found"))
    side = lambda c: full.select(F.col("key").alias(c), F.col("found").alias(f"found_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("found_a", "found_b"))
    return both.filter(common * (1 + similarity) >= similarity * (F.size("found_a") + F.size("found_b")) - 1e-9).select("a", "b")


def similar_components(docs: DataFrame, text_col: str, marked: DataFrame, links: DataFrame, similarity: float, send_rows: int = 1_000_000) -> DataFrame:
    """connected_components of ``links`` and of all fingerprints whose texts have sets of shingles alike by ``similarity``."""
    # one row of each set: only the other rows' numbers are shuffled, and sent where they are at most send_rows
    numbered = marked.withColumn("row", F.monotonically_increasing_id())
    least = numbered.groupBy("key").agg(F.min("row").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    extra = cut(numbered.select("key", "row").join(least, "key").filter("row <> least").select("row"))
    sets = numbered.join(F.broadcast(extra) if extra.count() <= send_rows else extra, "row", "left_anti").drop("row")
    own = sets.select("key", "fp")
    same = marked.select("key", F.col("fp").alias("u")).distinct().join(own, "key").filter("u <> fp").select("u", F.col("fp").alias("v"))
    end = lambda c, name: own.select(F.col("key").alias(c), F.col("fp").alias(name))
    edges = lambda pairs: pairs.join(end("a", "u"), "a").join(end("b", "v"), "b").select("u", "v")
    shared = cut(sharing(sets))
    # a few candidates of each key: they only have to make most of the components, not all links
    beside = F.array(*(F.struct(*(F.col(f"{c}_{k}").alias(c) for c in ("key", "n", "i"))) for k in (1, 2)))
    starts = shared.select("key", "n", "i", "h", F.explode(beside).alias("to")).filter(F.col("key") != F.col("to.key")).filter(_may_be_alike(F.col("n"), F.col("to.n"), F.col("i"), F.col("to.i"), similarity))
    chosen = starts.groupBy("key").agg(*(F.min_by("to.key", F.xxhash64("h", "to.key", F.lit(k))).alias(f"to_{k}") for k in range(3)))
    tries = chosen.select("key", F.explode(F.array_distinct(F.array("to_0", "to_1", "to_2"))).alias("to"))
    near = edges(verified(docs, text_col, sets, cut(tries.select(F.least("key", "to").alias("a"), F.greatest("key", "to").alias("b")).distinct()), similarity))
    reached = connected_components(links.union(same).union(near))
    roots = own.join(reached.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", F.coalesce("root", "fp").alias("root"))
    open_ = shared.select("h", "key", "n", "i").join(roots, "key")
    mixed = open_.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
    left = cut(open_.join(mixed, "h"))
    right = left.select("h", *(F.col(c).alias(f"{c}_2") for c in ("key", "n", "i", "root")))
    across = left.join(right, (left["h"] == right["h"]) & (F.col("root") < F.col("root_2")) & _may_be_alike(F.col("n"), F.col("n_2"), F.col("i"), F.col("i_2"), similarity))
    pairs = cut(across.select(F.col("key").alias("a"), F.col("key_2").alias("b")).distinct())
    if pairs.isEmpty():
        return reached
    return connected_components(reached.select(F.col("node").alias("u"), F.col("root").alias("v")).union(edges(verified(docs, text_col, sets, pairs, similarity))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3, node_limit: int = 4096, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the least id among all fingerprints reachable by links."""
    late = None if similarity is None else frequent_shingles(docs, text_col)
    marked = cut(fingerprints(docs, id_col, text_col, shingle, similarity, late))
    own = marked.groupBy("fp").agg(F.min("id").alias("first"))
    links = hamming_links(own.select("fp"), distance, node_limit)
    found = connected_components(links) if similarity is None else similar_components(docs, text_col, marked, links, similarity)
    reached = found.select(F.col("node").alias("fp"), "root")
    classes = own.join(reached, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", send_rows: int = 1_000_000, **options: float) -> DataFrame:
    """docs (which have no column _gone_id) with one document of each component, that with the least id; all columns stay. Rows whose id is null stay only in a component of such rows. No text is moved while at most ``send_rows`` ids go."""
    found = cut(near_duplicates(docs, id_col, text_col, **options).select("id", F.col("id").eqNullSafe(F.col("component_id")).alias("first")))
    gone = cut(found.groupBy("id").agg(F.max("first").alias("first")).filter("not first").select(F.col("id").alias("_gone_id")))
    gone = F.broadcast(gone) if gone.count() <= send_rows else gone
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]), "left_anti")
