"""Alignment of two tokenizers against a plain reading of its definition, token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from claimspark.llm import crosstok, queries
from tests.llm.rows import PROSE, awkward, empty

A, B = f"{crosstok.TOKENIZERS}/byte_bpe_50k.json", f"{crosstok.TOKENIZERS}/piece_bpe_32k.model"
EXTRA = ["<|endoftext|> </s> <s> <unk>", "x" * 3000, " " * 5000 + "a", "\n" * 1500, "tab\tand\r\n", "12345 67,89 don't", " nb​sp ﻿", "á ﬁ Ⅷ ㍿", "▁ literal ▁▁", "\x00\x01", "é" * 40]


def plain(texts):
    """The measures of each text, from tokens' bytes and byte ranges one at a time; the first tokenizer by its own library."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    names = {**slow.get_vocab()}
    letters = crosstok._letters()
    bytes_a = {i: bytes(letters[c] for c in p) for p, i in names.items() if p != "<|endoftext|>"}
    model = crosstok.PieceTokens(B).model
    aligned, counts = {}, Counter()
    for text, n in Counter(texts).items():
        if not text:
            continue
        a, b = slow.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        whole = (" " + text).encode()
        parts = [bytes_a[i] for i in a], [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if any(b"".join(p) != whole for p in parts):
            continue
        spans = []
        for p in parts:
            at, out = 0, []
            for x in p:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        inside = lambda k, low, high: ",".join(str(i) for i, (s, e) in zip((a, b)[k], spans[k]) if low <= s and e <= high)
        groups = ";".join(f"{inside(0, low, high)}|{inside(1, low, high)}" for low, high in zip([0, *ends], ends)) if len(whole) < 4000 else None
        links, j = Counter(), 0
        for i, (s, e) in zip(a, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links[i, b[k]] += 1
                k += 1
        aligned[text] = (len(a), len(b), len(ends), links, groups)
        for pair, k in links.items():
            counts[pair] += k * n
    best = Counter()
    for (_, i), k in counts.items():
        best[i] = max(best[i], k)
    out = {}
    for text, (n_a, n_b, n_groups, links, groups) in aligned.items():
        sums = sum(k for p, k in links.items() if counts[p] == best[p[1]]), sum(k * counts[p] for p, k in links.items())
        out[text] = (n_a, n_b, n_groups, sum(links.values()), *sums, groups and hashlib.sha256(groups.encode()).hexdigest())
    return out


def check(texts, rows):
    want = plain(list(texts.values()) if isinstance(texts, dict) else texts)
    none = (0, 0, 0, 0, 0, 0, "")
    for text, row in rows:
        measures = want.get(text, none)
        got = tuple(row[c] for c in (*crosstok.MEASURES, "groups_sha256"))
        assert got[:6] == measures[:6] and measures[6] in (None, got[6]), (text or "")[:40]


@pytest.mark.parametrize("hot", [1 << 19, 40, 0])
def test_against_plain_alignment(spark, hot):
    docs = awkward(spark, [*EXTRA, *EXTRA[:4], PROSE + " more"])
    texts = [r.text for r in docs.collect()]
    got = crosstok.alignment(docs, hot_pairs=hot).collect()
    assert len(got) == len(texts)
    known = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    check(texts, [(known[r.id], r) for r in got if r.id is not None])
    assert sorted(r.n_a > 0 for r in got if r.id is None) == [False, True]


def test_the_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_alignment(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    check(docs, [(docs[r.doc_id], r) for r in got])


def test_a_text_of_most_rows_and_empty_tables(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, concat('text ', id), 'the same text') text")
    got = crosstok.alignment(docs).collect()
    assert len(got) == 3000 and len({(r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got if r.id % 3}) == 1
    want = plain([r.text for r in docs.collect()])["the same text"]
    assert next(tuple(r)[1:] for r in got if r.id == 1) == want
    assert crosstok.alignment(empty(spark)).count() == 0


def test_both_libraries_agree():
    a = crosstok.ByteTokens(A)
    rng = np.random.default_rng(3)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(points[i]) for i in rng.integers(0, len(points) if k % 2 else 700, 60)) for k in range(500)] + [t for t in EXTRA if not crosstok._LONG_SPACE.search(t)]
    assert a.encode(texts) == [a.slow.encode(" " + t, add_special_tokens=False).ids for t in texts]
