"""Two tokenizers' tokens of the same texts, aligned by the bytes that they cover.

Texts are shuffled whole, so that each distinct text is encoded and aligned once and its rows only counted. A text's links
(pairs of token occurrences whose byte ranges overlap) are stored as pairs of ids with their number in the text; a pair's
count over the corpus weighs each text by its number of rows. Counts of the ``hot_pairs`` most frequent pairs are sent to
the tasks; the links of the others are joined to their counts by pair, so every count is exact at any size. The measures go
back to the rows by the text's SHA-256; texts that hold over 1/1024 of all rows, so at most 1,024 of them, are sent to
the rows, the others joined.

The first tokenizer is a byte-level BPE file (its ids are read from that file; ``tiktoken`` runs it, and ``tokenizers`` the
texts with a run of 1,000 white-space characters, on which the former overflows its stack), the second a SentencePiece
model that puts a space before the text. Files are read on the executors, where they must be.

Defined results: null and empty texts, and texts whose tokens don't join to the space and the text, have zeros and an empty
``groups_sha256``, and count no pairs; strings of special tokens are ordinary text. Every row of docs has a row, rows with
null or repeated ids too. Of pairs with the same count all are a B id's highest. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import least_count, saved, slices

#: Where public vocabularies lie on every machine.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how byte-level BPE cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_SPACE = re.compile(r"\s{1000}")
_TEXT_CHARS = 1 << 20
_HELD = 1 << 22
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class ByteTokens:
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        special, letters = {t["content"] for t in known["added_tokens"]}, _letters()
        vocabulary = known["model"]["vocab"]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = tiktoken.Encoding("byte-level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.slow.encode(" " + t, add_special_tokens=False).ids if _LONG_SPACE.search(t) else self.fast.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizers(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(path_a), PieceTokens(path_b)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of weights of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _written(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids in decimal, each with its mark behind it, and how many characters each takes."""
    digits = np.zeros((len(ids), 11), np.uint8)
    length = np.ones(len(ids), np.int64)
    for power in range(1, 10):
        length += ids >= 10**power
    width = int(length.max(initial=1)) + 1
    rest = ids.copy()
    for back in range(width - 1):  # the last digit first
        place = length - 1 - back
        rows = np.flatnonzero(place >= 0)
        digits[rows, place[rows]] = rest[rows] % 10 + ord("0")
        rest //= 10
    digits[np.arange(len(ids)), length] = marks
    digits = digits[:, :width]
    return digits[np.arange(width) <= length[:, None]].tobytes(), length + 1


def align(texts: list[str], a: ByteTokens, b: PieceTokens) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(measures, digests, ends, pairs, numbers): n_a, n_b, n_groups and n_links by text, the digest of its groups, and the pairs
    a * size + b of all texts, one after the other, with how many links of the text have each; ends tells where a text's pairs end."""
    coded_a, coded_b = a.encode(texts), b.encode(texts)
    measures, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    good = [k for k, t in enumerate(texts) if t and (whole := b" " + t.encode()) == b"".join(map(a.bytes.__getitem__, coded_a[k])) and whole == b"".join(map(b.bytes.__getitem__, coded_b[k]))]
    if not good:
        return measures, digests, np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = [np.fromiter(chain.from_iterable(c[k] for k in good), np.int64) for c in (coded_a, coded_b)]
    number = [np.array([len(c[k]) for k in good]) for c in (coded_a, coded_b)]
    end = [np.cumsum(np.array([len(x) for x in t.bytes])[ids]) for t, ids in zip((a, b), joined, strict=True)]
    cuts = np.sort(np.concatenate(end), kind="stable")
    cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]  # each piece between two cuts is one link
    at = [np.searchsorted(e, cuts) for e in end]
    common = (end[0][at[0]] == cuts) & (end[1][at[1]] == cuts)
    text_of = np.searchsorted(end[0][np.cumsum(number[0]) - 1], cuts)
    group = np.append(0, np.cumsum(common)[:-1])
    groups = [group[np.searchsorted(cuts, e)] for e in end]  # of each token
    n = len(joined[0]) + len(joined[1])
    ids, marks = np.zeros(n, np.int64), np.zeros(n, np.uint8)
    for side, (own, other, mark) in enumerate(((*groups, "|"), (*groups[::-1], ";"))):
        place = np.arange(len(own)) + np.searchsorted(other, own, "right" if side else "left")
        ids[place] = joined[side]
        marks[place] = np.where(np.append(own[1:] != own[:-1], True), ord(mark), ord(","))
    characters, taken = _written(ids, marks)
    bounds = np.append(0, np.cumsum(taken))[np.append(0, np.cumsum(number[0] + number[1]))]
    measures[good] = np.stack([*number, np.bincount(text_of[common], minlength=len(good)), np.bincount(text_of, minlength=len(good))], axis=1)
    for k, (start, stop) in zip(good, zip(bounds, bounds[1:]), strict=True):
        digests[k] = hashlib.sha256(characters[start : stop - 1]).hexdigest()
    size = len(b.bytes)
    span = len(a.bytes) * size
    keys, numbers = np.unique(np.array(good)[text_of] * span + joined[0][at[0]] * size + joined[1][at[1]], return_counts=True)
    return measures, digests, np.searchsorted(keys, (np.arange(len(texts)) + 1) * span), keys % span, numbers


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts exceed _TEXT_CHARS bytes together."""
    for batch in slices(batches, 512):
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TEXT_CHARS, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def distinct_alignments(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """(digest, n, n_a, n_b, n_groups, n_links, groups_sha256, pairs, numbers) of each distinct text that isn't empty, stored; n is its number of rows."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    texts = texts.select("text", "n", F.unhex(F.sha2("text", 256)).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        for batch in _by_size(batches):
            measures, digests, ends, pairs, numbers = align(batch.column("text").to_pylist(), a, b)
            offsets = pa.array(np.append(0, ends), pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((pairs, pa.int64()), (numbers, pa.int32())))
            out = [batch.column("digest"), batch.column("n"), *(pa.array(measures[:, i].copy()) for i in range(4)), pa.array(digests, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(out, names=["digest", "n", *MEASURES[:4], "groups_sha256", "pairs", "numbers"])

    schema = "digest binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, numbers array<int>"
    return saved(texts.mapInArrow(run, schema), compression="zstd")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, number) of all pairs of a batch."""
    pairs, numbers = batch.column("pairs"), batch.column("numbers")
    row = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
    return row, pairs.flatten().to_numpy(), numbers.flatten().to_numpy().astype(np.int64)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, top), stored: how many links of the corpus have the pair, and whether no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (keys, weights)], names=["pair", "n"])

        for batch in slices(batches, 512):
            row, pair, number = _lists(batch)
            keys, weights = summed(np.concatenate([keys, pair]), np.concatenate([weights, number * batch.column("n").to_numpy()[row]]))
            if len(keys) > _HELD:
                yield from out()
                keys, weights = keys[:0], weights[:0]
        yield from out()

    counted = saved(aligned.select("n", "pairs", "numbers").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    id_b = (F.col("pair") % size_b).alias("b")
    best = counted.groupBy(id_b).agg(F.max("n").alias("most"))  # at most a row for each id of the vocabulary
    return saved(counted.withColumn("b", id_b).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("top")))


def link_sums(aligned: DataFrame, counts: DataFrame, hot_pairs: int) -> DataFrame:
    """(digest, n_best, count_sum) of each stored text."""
    least = least_count(counts.select("n"), hot_pairs)
    hot = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    keys, n, top = (hot[c].to_numpy()[order] for c in ("pair", "n", "top"))
    rows = aligned.select("digest", "pairs", "numbers")

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        row, pair, number = _lists(batch)
        at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
        return row, pair, number, at, keys[at] == pair if len(keys) else np.zeros(len(pair), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            row, _, number, at, here = found(batch)
            # in whole numbers: a float would round sums beyond 2^53
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if len(keys):
                np.add.at(best, row, number * (here & top[at]))
                np.add.at(total, row, number * np.where(here, n[at], 0))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(best), pa.array(total)], names=["digest", "n_best", "count_sum"])

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            row, pair, number, _, here = found(batch)
            away = np.flatnonzero(~here)
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(row[away])), pa.array(pair[away]), pa.array(number[away])], names=["digest", "pair", "number"])

    out = rows.mapInArrow(sums, "digest binary, n_best long, count_sum long")
    if counts.count() == len(keys):
        return out
    rare = rows.mapInArrow(cold, "digest binary, pair long, number long").join(counts.filter(F.col("n") < least), "pair")
    best, total = F.sum(F.when(F.col("top"), F.col("number")).otherwise(0)), F.sum(F.col("number") * F.col("n"))
    return out.unionByName(rare.groupBy("digest").agg(best.alias("n_best"), total.alias("count_sum"))).groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, hot_pairs: int = 1 << 19) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs."""
    path_a, path_b = f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"
    aligned = distinct_alignments(docs, path_a, path_b, text_col)
    sums = link_sums(aligned, pair_counts(aligned, len(tokenizers(path_a, path_b)[1].bytes)), hot_pairs)
    found = saved(aligned.drop("pairs", "numbers").join(sums, "digest"))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.col(text_col).cast("string"), 256)).alias("digest"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = F.col("n") * 1024 > total
    hot = F.broadcast(found.filter(many).drop("n"))
    values = [*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")]
    common = rows.join(hot, "digest").select("id", *values)
    others = rows.join(hot.select("digest"), "digest", "left_anti").join(found.filter(~many).drop("n"), "digest", "left")
    return common.unionByName(others.select("id", *values))
