"""Cross-entropy difference of a target and a background language model (Moore and Lewis, 2010).

Both models are bigram models over one shared vocabulary: all words that occur at least twice in the two corpora together,
and one word for those that occur once. They are smoothed alike, by absolute discounting with a discount of one:
p(w|v) = (max(c(v,w) - 1, 0) + types(v) p(w)) / c(v), where types(v) is the number of different words after v, words that
occur once counting each, and p(w) = (c(w) + add) / (N + add words); after a word never seen before, or outside the
vocabulary, p(w) stands. So p(.|v) sums to one for every v, and a pair of words seen once tells nothing that the single words
don't: a document that is in its own background, as all are here, isn't known to it by heart. Counts cover both corpora
whole. The score is the mean difference of the losses per token; low means like the target.

Tokens are lower-cased runs of ASCII letters and digits and of all other non-ASCII characters. Texts are stored in blocks of
about ``_BLOCK`` tokens. A block sends its different words, then its different pairs, sorted and packed, to the buckets that
they fall to, which follow the input in number. A bucket adds up what all blocks sent and answers each with the counts of
what it sent, in the same order, so that no key goes along; a block scores its texts from its answers. So a pair is shuffled
once a block, about three bytes, and comes back as less than one; neither vocabulary nor pairs have a bound, and none are
sent to all tasks. The pairs of the words that occur most often are dealt over several buckets each (at most ``hot_words``
words, of over an eighth of a bucket's tokens); only the sums of these words are sent. ``hot_words`` doesn't change results;
``hot_pairs`` bounded the pairs that were sent to the tasks and has no effect.

Defined results: null or blank text has 0 tokens and null scores; an empty target gives a model in which all words are
equally likely; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import saved, slices, utf8_rows
from claimspark.llm.tiling import token_hashes_of

START, OTHER, FIRST = 0, 1, 2  # ids: before the first token, a word that occurs once, the first of the vocabulary
_BLOCK = 1 << 20  # tokens and texts of a block
_BUCKET = 1 << 21  # words or tokens of a bucket, about
_BITS = 1 << 26  # places that the hashes of words fall to; a bucket of words is a run of them
_TOP = np.uint64(1 << 63)  # set in the hash of every word, so that as longs they are in the same order
_HEAD = "<IB"
_NONE = np.zeros(0, np.int64)


def _documents(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each token within these, hash of each token) for stretches of about ``most`` bytes of the column."""
    held, size, at = [], 0, 0
    texts = list(utf8_rows(pc.utf8_lower(column.cast(pa.large_string()))))
    for k, text in enumerate(texts, 1):
        held.append(text)
        size += len(text) + 1
        if size >= most or k == len(texts):
            begins = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
            hashed, start = token_hashes_of(b" ".join(held))
            yield at, len(held), np.searchsorted(begins, start, "right") - 1, hashed | _TOP
            held, size, at = [], 0, k


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of longs, compressed together: of each the first bytes of all, then the second bytes, as far as any is set."""
    heads, planes = [bytes([len(columns)])], []
    for x in columns:
        x = np.ascontiguousarray(x).view(np.uint64)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        heads.append(struct.pack(_HEAD, len(x), width))
        planes.append(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return b"".join([*heads, pa.compress(b"".join(planes), codec="zstd", asbytes=True)])


def _unpack(data: bytes) -> list[np.ndarray]:
    size = struct.calcsize(_HEAD)
    heads = [struct.unpack_from(_HEAD, data, 1 + i * size) for i in range(data[0])]
    planes = np.frombuffer(pa.decompress(data[1 + len(heads) * size :], sum(n * width for n, width in heads), codec="zstd"), np.uint8)
    out, at = [], 0
    for n, width in heads:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = planes[at : at + n * width].reshape(width, n).T
        out.append(x.view(np.int64)[:, 0])
        at += n * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """What each of the sorted longs adds to the one before; their cumulative sum gives them back."""
    return np.diff(x, prepend=np.zeros(1, np.int64))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column."""
    return np.append(True, np.any([x[1:] != x[:-1] for x in columns], axis=0))[: len(columns[0])]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([_NONE, *parts])


def _blocks(texts: DataFrame, text_col: str, ids: T.DataType, id_col: str | None, side: int) -> DataFrame:
    """Blocks of the texts of side 0 (target) or 1, which is the remainder of their number: ids, figures, packed words and tokens."""
    number = (F.monotonically_increasing_id() * 2 + side).alias("block")
    rows = texts.select(number, (F.col(id_col) if id_col else F.lit(None).cast(ids)).alias("id"), F.col(text_col).cast("string").alias("text"))
    names, most = ["block", "ids", "n", "texts", "n_words", "words", "tokens"], _BLOCK

    def block(held: list[tuple]) -> pa.RecordBatch:
        numbers, of, sizes, hashed = zip(*held, strict=True)
        of, sizes = pa.concat_arrays(of), np.concatenate(sizes)
        words, local, count = np.unique(np.concatenate(hashed), return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.int64)  # frequent words have small numbers
        rank[np.argsort(-count, kind="stable")] = np.arange(len(words))
        values = [[numbers[0]], None, [len(local)], [int((sizes > 0).sum())], [len(words)], [_pack(_steps(words.view(np.int64)), count)], [_pack(sizes, count, rank[local])]]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of) if x is None else pa.array(x) for x in values]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for at, many, row, hashed in _documents(batch.column("text")):
                part = batch.slice(at, many)
                held.append((part.column("block")[0].as_py(), part.column("id"), np.bincount(row, minlength=many), hashed))
                size += many + len(hashed)
                if size >= most:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    kinds = [T.LongType(), T.ArrayType(ids), *[T.LongType()] * 3, *[T.BinaryType()] * 2]
    return rows.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in zip(names, kinds, strict=True)]))


_SENT = "bucket int, block long, data binary"


def _sent(bucket: list[int], block: list[int | None], data: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "data"])


def _dealt(block: int, bucket: np.ndarray, keys: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, with the keys that fall to it and how often each occurs; bucket is sorted, and keys within it."""
    begins = np.flatnonzero(_runs(bucket))
    ends = np.append(begins[1:], len(bucket))[: len(begins)]
    data = [_pack(_steps(keys[a:z]), count[a:z]) for a, z in zip(begins, ends, strict=True)]
    return _sent(bucket[begins].tolist(), [block] * len(begins), data)


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int], list[np.ndarray]]:
    """The different keys that blocks sent to a bucket, their counts on both sides; the blocks and the places of what each sent."""
    blocks = table["block"].to_pylist()
    steps, counts = zip(*(_unpack(x.as_py()) for x in table["data"]), strict=True)
    keys, at = np.unique(np.concatenate([np.cumsum(x) for x in steps]), return_inverse=True)
    sizes, count = [len(x) for x in steps], np.concatenate(counts)
    side = np.repeat(np.array(blocks) & 1, sizes)
    n = [np.bincount(at, count * (side == i), len(keys)).astype(np.int64) for i in (0, 1)]
    return keys, np.stack(n), blocks, np.split(at, np.cumsum(sizes)[:-1])


def _word_counts(blocks: DataFrame, buckets: int, least: int) -> DataFrame:
    """To each block, for each bucket: places in the vocabulary and counts of the words that it sent. For each bucket a row
    without a block: words of the vocabulary, totals and words that occur once on both sides, words of over ``least`` tokens."""
    bits = _BITS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                steps, count = _unpack(data.as_py())
                words = np.cumsum(steps)
                place = (words.view(np.uint64) << np.uint64(1)) >> np.uint64(65 - bits.bit_length())
                yield _dealt(block, place.astype(np.int64) * buckets // bits, words, count)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        _, n, blocks, places = _met(table)
        both = n.sum(axis=0)
        rank = np.cumsum(both > 1)
        data = [_pack(_steps(rank[at]), *n[:, at]) for at in places]
        hot = np.flatnonzero(both > least)
        data.append(_pack(np.array([rank[-1], *n.sum(axis=1), *n[:, both == 1].sum(axis=1)]), rank[hot], both[hot]))
        return pa.Table.from_batches([_sent([key[0].as_py()] * len(data), [*blocks, None], data)])

    return blocks.select("block", "words").mapInArrow(ask, _SENT).groupBy("bucket").applyInArrow(answer, _SENT)


@dataclass(frozen=True)
class Whole:
    """What is known of all words together, and how pairs are dealt."""

    first: np.ndarray  # for each bucket of words, the id before its first word's
    width: int  # ids
    once: np.ndarray  # words that occur once, on both sides
    total: np.ndarray  # tokens smoothed
    buckets: int  # of pairs
    hot: np.ndarray  # sorted ids
    ways: np.ndarray  # buckets over which the pairs of each are dealt

    def bucket(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Runs of v; hot words' go on to as many buckets as they have ways, by runs of w."""
        hit, at = _found(self.hot, v)
        ways = np.ones(len(v), np.int64)
        ways[hit] = self.ways[at]
        return (v * self.buckets // self.width + w * ways // self.width) % self.buckets


def _found(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x has a value of the sorted array, and the places of these values there."""
    if not len(known):
        return _NONE, _NONE
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    hit = np.flatnonzero(known[at] == x)
    return hit, at[hit]


def _whole(answers: DataFrame, buckets: int, tokens: int, texts: int, least: int, hot_words: int, add: float) -> Whole:
    known, figures, hot = np.zeros(buckets, np.int64), np.zeros(4, np.int64), []
    for row in answers.filter("block is null").select("bucket", "data").collect():
        sums, *found = _unpack(bytes(row["data"]))
        known[row["bucket"]] = sums[0]
        figures += sums[1:]
        hot.append((row["bucket"], *found))
    if known.sum() + FIRST >= 1 << 31:
        raise ValueError("a pair of words must fit in a long: the vocabulary has over 2,147,483,645 words")
    first = FIRST - 1 + np.cumsum(known) - known
    ids = _joined([first[b] + rank for b, rank, _ in hot])
    count = _joined([n for *_, n in hot])
    most = np.argsort(-count, kind="stable")[:hot_words]
    ids, count = ids[most], count[most]
    if texts > least:
        ids, count = np.append(ids, START), np.append(count, texts)
    order, parts = np.argsort(ids), max(1, -(-tokens // _BUCKET))
    return Whole(first, FIRST + int(known.sum()), figures[2:] + 0.0, figures[:2] + add * (known.sum() + 1), parts, ids[order], np.minimum(-(-count[order] // least), parts))


@dataclass(frozen=True)
class Block:
    """A block that met its answers."""

    number: int
    ids: pa.Array
    sizes: np.ndarray  # tokens of each text
    words: np.ndarray  # of each token, the place among the block's words
    known: np.ndarray  # whether each word is of the vocabulary
    n: np.ndarray  # counts of each word on both sides
    after: np.ndarray  # tokens after a word of the vocabulary or at the start of a text
    pairs: np.ndarray  # different pairs of these with the word before, by bucket: v * width + w
    at: np.ndarray  # the pair of each
    bucket: np.ndarray
    answers: list[list[np.ndarray]]  # by bucket


def _block(table: pa.Table, whole: Whole) -> Block:
    kind, bucket = table["kind"].to_numpy(), table["bucket"].to_numpy()
    order = np.lexsort([bucket, kind])
    data = [_unpack(table["data"][int(i)].as_py()) for i in order]
    asked, met = int((kind == 1).sum()) + 1, bucket[order]
    sizes, count, rank = data[0]
    ids = _joined([whole.first[b] + np.cumsum(x[0]) for b, x in zip(met[1:asked], data[1:asked], strict=True)])
    n = np.stack([_joined([x[i] for x in data[1:asked]]) for i in (1, 2)])
    known = n.sum(axis=0) > 1
    words = np.argsort(-count, kind="stable")[rank]
    w = np.where(known, ids, OTHER)[words]
    v = np.roll(w, 1)
    v[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    after = np.flatnonzero(v != OTHER)
    pairs, at = np.unique(v[after] * whole.width + w[after], return_inverse=True)
    to = whole.bucket(pairs // whole.width, pairs % whole.width)
    by = np.argsort(to, kind="stable")
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    own = int(order[0])
    return Block(table["block"][own].as_py(), table["ids"][own].values, sizes, words, known, n, after, pairs[by], back[at], to[by], data[asked:])


def _pair_counts(met: DataFrame, whole: Whole) -> DataFrame:
    """To each block of side 1, for each bucket: counts of the pairs that it sent, zero where a side has none that counts, and
    counts and types of the words before, a row for each. For each bucket a row without a block: these sums of hot words."""

    def ask(table: pa.Table) -> pa.Table:
        b = _block(table, whole)
        return pa.Table.from_batches([_dealt(b.number, b.bucket, b.pairs, np.bincount(b.at, minlength=len(b.pairs)))])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        pairs, n, blocks, places = _met(table)
        v, other = pairs // whole.width, pairs % whole.width == OTHER  # so many words that occur once
        begins = np.flatnonzero(_runs(v))
        sums = np.add.reduceat(np.concatenate([n, np.where(other, n, n > 0)]), begins, axis=1)
        n[:, other] = 0
        n[n < 2] = 0
        group = np.cumsum(_runs(v)) - 1
        asked = [(block, at) for block, at in zip(blocks, places, strict=True) if block & 1]
        data = [_pack(*n[:, at], *sums[:, group[at][_runs(group[at])]]) for _, at in asked]
        hit, hot = _found(whole.hot, v[begins])
        data.append(_pack(hot, *sums[:, hit]))
        return pa.Table.from_batches([_sent([key[0].as_py()] * len(data), [*(block for block, _ in asked), None], data)])

    return met.groupBy("block").applyInArrow(ask, _SENT).groupBy("bucket").applyInArrow(answer, _SENT)


def _losses(b: Block, whole: Whole, hot: np.ndarray, add: float) -> np.ndarray:
    """The losses of each text's tokens together, a row for target and background."""
    v = b.pairs // whole.width
    group = np.cumsum(_runs(v, b.bucket)) - 1
    count = [_joined([x[i] for x in b.answers]) for i in (0, 1)]
    sums = np.stack([_joined([x[i] for x in b.answers]) for i in range(2, 6)])[:, group]
    hit, at = _found(whole.hot, v)
    sums[:, hit] = hot[:, at]
    word = np.empty(len(b.pairs), np.int64)
    word[b.at] = b.words[b.after]
    text = np.repeat(np.arange(len(b.sizes)), b.sizes)
    out = []
    for i in (0, 1):
        p = (np.where(b.known, b.n[i], whole.once[i]) + add) / whole.total[i]
        log_p = np.log(p)
        seen, types = sums[i], sums[i + 2]
        more = np.log(np.where(seen > 0, types / np.maximum(seen, 1), 1.0))
        many = np.flatnonzero(count[i])
        more[many] += np.log1p((count[i][many] - 1) / (types[many] * p[word[many]]))
        loss = -log_p[b.words]
        loss[b.after] -= more[b.at]
        out.append(np.bincount(text, loss, len(b.sizes)))
    return np.stack(out)


def score(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    hot_words: int = 1 << 19, hot_pairs: int = 1 << 19, add: float = 0.5,
) -> DataFrame:
    """(id, n_tokens, ce_target, ce_background, ce_difference) for each row of docs; docs are the background too."""
    of = docs.select(F.col(id_col)).schema[0].dataType
    blocks = saved(_blocks(target, target_text, of, None, 0).union(_blocks(docs, text_col, of, id_col, 1)))
    tokens, texts, n_words = (x or 0 for x in blocks.agg(F.sum("n"), F.sum("texts"), F.sum("n_words")).first())
    least, buckets = max(1, _BUCKET // 8), min(_BITS, max(1, -(-n_words // _BUCKET)))

    def answers(found: DataFrame, kind: int) -> DataFrame:
        return found.filter("block is not null").select("block", F.lit(kind).alias("kind"), "bucket", "data", F.lit(None).cast(T.ArrayType(of)).alias("ids"))

    words = saved(_word_counts(blocks, buckets, least))
    whole = _whole(words, buckets, tokens, texts, least, hot_words, add)
    met = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("tokens").alias("data"), "ids").union(answers(words, 1))
    pairs = saved(_pair_counts(met, whole))
    hot = np.zeros((4, len(whole.hot)), np.int64)
    for row in pairs.filter("block is null").select("data").collect():
        at, *sums = _unpack(bytes(row["data"]))
        hot[:, at] += np.stack(sums)

    def run(table: pa.Table) -> pa.Table:
        b = _block(table, whole)
        none = b.sizes == 0
        t, back = _losses(b, whole, hot, add) / np.maximum(b.sizes, 1)
        figures = (pa.array(x, mask=none) for x in (t, back, t - back))
        return pa.Table.from_arrays([b.ids, pa.array(b.sizes), *figures], names=out.names)

    out = T.StructType([T.StructField("id", of), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("ce_target", "ce_background", "ce_difference"))])
    return met.union(answers(pairs, 2)).filter("block % 2 = 1").groupBy("block").applyInArrow(run, out)
