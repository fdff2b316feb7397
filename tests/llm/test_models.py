"""Quality, licence and language models, and the pipeline."""

import math
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimspark.llm import licenses, lm, quality, queries
from claimspark.llm.common import table

from .rows import PROSE, awkward, empty


def test_pairs_learn_the_order():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 3))
    strength = x @ np.array([2.0, -1.0, 0.0])
    i, j = draw.integers(400, size=(2, 5000))
    better = draw.random(5000) < 1 / (1 + np.exp(strength[j] - strength[i]))
    w = quality.fit_pairs(np.where(better[:, None], x[i], x[j]), np.where(better[:, None], x[j], x[i]))
    assert np.allclose(w, [2, -1, 0], atol=0.25)


def test_held_out_accuracy(spark, sf):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    rows = [r for r in queries.op2_quality(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_awkward_rows(spark):
    docs, labels = awkward(spark), spark.createDataFrame([(5, 1), (9, 0), (5, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.scores(docs, model).count() == docs.count()
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 5 in [r["doc_id"] for r in kept.collect()]
    assert {r["score"] for r in quality.scores(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.7}
    assert quality.scores(empty(spark), model).collect() == []


def test_licences(spark):
    notice = licenses.NOTICES["MIT"][0]
    docs = awkward(spark, [f"{PROSE}\n{notice}", "Licensed under the Apache License,   Version 2.0\nLicensed under CC BY-NC 4.0.", "the licence of poets is a license to version the general public"])
    model = licenses.train([PROSE, "some other words that are not about rights at all"] * 40)
    rows = {r["id"]: r for r in licenses.scan(docs, model).collect() if r["id"] is not None}
    assert rows[12]["family"] == "MIT" and rows[12]["confirmed"] and (rows[12]["paragraph_start"], rows[12]["paragraph_end"]) == (len(PROSE) + 1, len(PROSE) + 1 + len(notice))
    assert rows[13]["families"] == ["Apache-2.0", "CC-BY-NC"] and not rows[14]["confirmed"]
    assert all(rows[i]["family"] is None for i in range(12))
    assert licenses.scan(empty(spark), model).collect() == [] and licenses.background_paragraphs(empty(spark)) == []


MIT = licenses.NOTICES["MIT"][2]


@pytest.mark.parametrize("mark", ["", "// ", "# ", " * ", "-- "])
def test_a_wrapped_notice_is_confirmed(spark, mark):
    wrapped = "\n".join(mark + x for x in textwrap.wrap(MIT, 72))
    text = f"{mark}Copyright the authors\n{mark.rstrip()}\n{wrapped}\n\n{PROSE}\n{PROSE}"
    docs = spark.createDataFrame([(1, text), (2, f"{PROSE}\n{PROSE}"), (3, "zzz qqq\ncode prior on"), (4, "zzz qqq")], "doc_id long, text string")
    rows = {r["id"]: r for r in licenses.scan(docs, licenses.train([PROSE, "some other words that are not about rights at all"] * 40)).collect()}
    assert rows[1]["family"] == "MIT" and rows[1]["confirmed"] and rows[1]["families"] == ["MIT"]
    assert text[rows[1]["paragraph_start"] : rows[1]["paragraph_end"]] == wrapped
    assert rows[2]["family"] is None and rows[3]["probability"] >= rows[4]["probability"]


def test_short_templates_and_further_families_are_confirmed(spark):
    texts = [
        "Copyright 2020 Acme Inc. All rights reserved.", "(c) Acme. All rights reserved worldwide, always.", "some rights are reserved and all of the rights are not",
        *(licenses.NOTICES[f][-1] for f in ("ISC", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense")), "// Copyright Acme\n// All rights\n// reserved.",
    ]
    rows = {r["id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.train([PROSE, "some other words that are not about rights at all"] * 40)).collect()}
    assert [(rows[i]["family"], rows[i]["confirmed"]) for i in (0, 1)] == [("Proprietary", True)] * 2 and not rows[2]["confirmed"]
    assert [(rows[i]["family"], rows[i]["confirmed"]) for i in range(3, 8)] == [(f, True) for f in ("ISC", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense")]
    assert rows[8]["family"] == "Proprietary" and rows[8]["confirmed"]


def test_few_rows_train_however_often_they_are_repeated(spark):
    docs = spark.createDataFrame([(i % 9, f"{PROSE} {i % 9}") for i in range(450)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    x, y = quality.training_rows(docs, labels, "doc_id", "text", "quality", F.lit(True), 6)
    assert x.shape == (6, len(quality.FEATURES)) and len(y) == 6
    assert quality.training_rows(docs, labels, "doc_id", "text", "quality", F.lit(True), 10_000)[0].shape[0] == 450


def test_licences_equal_a_plain_reading_of_the_model(spark):
    """Features, probabilities and the choice of a paragraph, from the weights by their definition."""
    model = licenses.train([PROSE, "some other words that are not about rights at all"] * 40)
    texts = [PROSE, f"{PROSE}\n{MIT}", "Released under the MIT license.\nAll rights reserved.", "", None, "the public licence", f"// {MIT[:90]}\n// {MIT[90:]}", "All rights reserved."]

    def probabilities(line):
        words = re.findall(r"\w+", line.lower())
        there = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)} & set(model.index)
        z = [(model.bias[k] + sum(model.weights[model.index[g], k] for g in there) / max(1, len(there)) ** 0.5) / model.temperature for k in range(len(model.families))]
        return [math.exp(x - max(z)) / sum(math.exp(y - max(z)) for y in z) for x in z]

    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        lines = (texts[r["id"]] or "").split("\n")
        likely = [(max(p[:-1]), model.families[p.index(max(p))]) for p in map(probabilities, lines) if p.index(max(p)) < len(p) - 1 and max(p) >= 0.7]
        if not r["confirmed"]:
            assert r["family"] == (max(likely, key=lambda x: x[0])[1] if likely else None)
            want = max(likely, key=lambda x: x[0])[0] if likely else max(1 - probabilities(x)[-1] for x in [*lines, ""])
            assert abs(r["probability"] - want) < 1e-9
        assert {f for _, f in likely} <= set(r["families"])


def test_quality_scores_equal_their_definition(spark):
    rows = [(i, " ".join([PROSE, "#" * (i % 7), "word, " * (i % 5)])) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 < 3)) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    z = lambda t: sum((x - m) / s * w for x, m, s, w in zip(quality.features(t or ""), model.mean, model.scale, model.weight, strict=True))
    known = sorted(z(t) for _, t in rows[:60])
    at = sum(i % 7 >= 3 for i in range(60)) / 60 * 59
    threshold = known[int(at)] + (at - int(at)) * (known[int(at) + 1] - known[int(at)])
    assert abs(model.threshold - threshold) < 1e-9
    for r in quality.scores(docs, model).collect():
        assert abs(r["score"] - 1 / (1 + math.exp(-(z(dict(rows)[r["id"]]) - threshold) - math.log(0.7 / 0.3)))) < 1e-9
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, model).collect()) == sorted(i for i, t in rows if z(t) >= threshold - 1e-12)


def test_licences_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    marks = {"Apache-2.0": "Apache License", "MIT": "MIT License", "GPL": "General Public License", "CC-BY-NC": "CC BY-NC", "Proprietary": "All rights reserved"}
    texts = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").collect()}
    for r in queries.op1_licenses(spark, d).collect():
        assert set(r["families"]) == {f for f, m in marks.items() if m in texts[r["doc_id"]]}


def slow_models(docs, target, add=0.5):
    """p(w | v) under the target's and the background's model, by their definition; None is the word for all that occur once."""
    words = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    both = [[words(x) for x in rows] for rows in (target, docs)]
    total = Counter(w for rows in both for x in rows for w in x)
    known = {w for w, n in total.items() if n >= 2}
    one = [Counter(w if w in known else None for x in rows for w in x) for rows in both]
    two = [Counter(p for x in rows for p in zip(["<s>", *x], x, strict=False)) for rows in both]
    after = [Counter(), Counter()]
    types = [Counter(), Counter()]
    for i in (0, 1):
        for (v, _), n in two[i].items():
            after[i][v] += n
            types[i][v] += 1

    def p(i, w, v):
        alone = (one[i][w if w in known else None] + add) / (sum(one[i].values()) + add * (len(known) + 1))
        return (max(two[i][v, w] - 1, 0) + types[i][v] * alone) / after[i][v] if after[i][v] and (v in known or v == "<s>") else alone

    return p, both[1], known


def slow_lm(docs, target):
    p, rows, _ = slow_models(docs, target)
    mean = lambda i, x: round(sum(-math.log(p(i, w, v)) for v, w in zip(["<s>", *x], x, strict=False)) / len(x), 9) if x else None
    return sorted(((len(x), mean(0, x), mean(1, x)) for x in rows), key=str)


LM_TARGET = [PROSE, "a b a b", None, "the quick brown fox", "a b c d a b"]


def test_each_history_sums_to_one(spark):
    docs = [r["text"] for r in awkward(spark, ["a b a b a c", "the quick fox"]).collect()]
    p, _, known = slow_models(docs, LM_TARGET)
    assert len(known) > 20
    for i in (0, 1):
        assert all(abs(sum(p(i, w, v) for w in [*known, None]) - 1) < 1e-9 for v in ["<s>", None, *known])


def test_lm_scores_equal_brute_force(spark):
    docs = awkward(spark, ["a b a b a c", "the quick fox", PROSE + " a b"])
    target = spark.createDataFrame([(x,) for x in LM_TARGET], "text string")
    texts = [r["text"] for r in docs.collect()]
    for size, hot in ((1 << 16, 1 << 19), (1 << 16, 0), (9, 3), (0, 0)):
        got = lm.score(docs, target, hot_words=size, hot_pairs=hot).collect()
        figures = [(r["n_tokens"], *(None if r[c] is None else round(r[c], 9) for c in ("ce_target", "ce_background"))) for r in got]
        assert sorted(figures, key=str) == slow_lm(texts, LM_TARGET)
    alone = lm.score(docs, target.limit(0)).collect()
    assert len(alone) == len(texts) and len({round(r["ce_target"], 9) for r in alone if r["n_tokens"]}) == 1
    assert lm.score(empty(spark), target).collect() == []


def test_rare_words_and_pairs_count_whatever_is_sent(spark, monkeypatch):
    """Random texts over a long tail of words; a bitmap of 64 bits lets nearly all words pass."""
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in draw.zipf(1.3, size=n) % 3000) for n in draw.integers(0, 60, size=80)]
    target = [" ".join(f"w{i}" for i in draw.zipf(1.3, size=50) % 3000) for _ in range(20)]
    docs, rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    want = slow_lm(texts, target)
    for size, hot, bits in ((20, 5, 1 << 26), (0, 0, 1 << 6)):
        monkeypatch.setattr(lm, "_BITS", bits)
        got = lm.score(docs, rows, hot_words=size, hot_pairs=hot).collect()
        assert sorted(((r["n_tokens"], *(None if r[c] is None else round(r[c], 9) for c in ("ce_target", "ce_background"))) for r in got), key=str) == want


def zipf_texts(draw, n, most, words):
    return [" ".join(f"w{i}" for i in draw.zipf(1.3, size=k) % words) for k in draw.integers(0, most, size=n)]


def test_words_and_pairs_meet_whatever_the_blocks_and_buckets(spark, monkeypatch):
    """Many small blocks and buckets, so that frequent words are dealt over several of these; ids are strings."""
    draw = np.random.default_rng(7)
    texts, target = zipf_texts(draw, 80, 60, 3000), zipf_texts(draw, 20, 50, 3000)
    docs = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts)], "doc_id string, text string")
    rows = spark.createDataFrame([(x,) for x in target], "text string")
    want = slow_lm(texts, target)
    for block, bucket, hot in ((100, 64, 1 << 19), (1, 200, 2), (100, 64, 0)):
        monkeypatch.setattr(lm, "_BLOCK", block)
        monkeypatch.setattr(lm, "_BUCKET", bucket)
        got = lm.score(docs, rows, hot_words=hot).collect()
        assert sorted(((r["n_tokens"], *(None if r[c] is None else round(r[c], 9) for c in ("ce_target", "ce_background"))) for r in got), key=str) == want
        assert sorted(r["id"] for r in got) == sorted(f"d{i}" for i in range(80))


def test_lm_shuffles_no_row_for_each_pair(spark):
    """100,000 tokens and nearly as many pairs; blocks send theirs together, so no task holds a row for each."""
    draw, jvm = np.random.default_rng(8), spark.sparkContext._jvm
    texts = [" ".join(f"w{i}" for i in draw.integers(20_000, size=500)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    written = lambda: sum(s.shuffleWriteRecords() for s in (x.apply(i) for x in [stages()] for i in range(x.size())))
    before = written()
    assert len(lm.score(docs, docs.limit(20)).collect()) == 200
    assert written() - before < 2_000


def test_documents_that_occur_twice_are_told_apart(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in draw.integers(60, size=40)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:30]])), "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(f"w{i}" for i in draw.integers(60, size=400)),)], "text string")
    loss = {r["id"]: r["ce_background"] for r in lm.score(docs, target).collect()}
    assert np.mean([loss[i] for i in range(30)]) < np.mean([loss[i] for i in range(30, 300)]) - 0.05


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    columns = docs.columns
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] == counts[1] >= counts[2] >= counts[3] > 0.6 * 200
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == counts[3]
    key = lambda df: sorted(map(str, df.select("doc_id", "size", "target", "taken").collect()))
    assert key(corpus_pipeline.run(spark, sf)) == key(last)


def test_stages_take_awkward_rows(spark, sf):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() > 0 and (stage is corpus_pipeline.mixing_stage or out.columns == docs.columns)
        stage(spark, empty(spark), sf).collect()


def test_pipeline_takes_awkward_and_empty_tables(spark, sf, tmp_path):
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        d = tmp_path / name
        docs.write.parquet(str(d / "documents.parquet"))
        for other in ("labels", "benchmark"):
            table(spark, sf, other).write.parquet(str(d / f"{other}.parquet"))
        rows = corpus_pipeline.run(spark, str(d)).collect()
        assert (len(rows) > 0) == (name == "awkward") and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_quality_without_pairs_accepts_all(spark):
    docs = awkward(spark)
    for labels in ([], [(5, 1), (9, 1)], [(None, None)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert quality.keep_good(docs, model).count() == docs.count()


def test_queries_take_awkward_and_empty_tables(spark, sf, tmp_path):
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        d = tmp_path / name
        docs.write.parquet(str(d / "documents.parquet"))
        for other in ("labels", "benchmark", "conversations"):
            table(spark, sf, other).write.parquet(str(d / f"{other}.parquet"))
        for op in (queries.op1_licenses, queries.op2_quality, queries.op4_lm_score, queries.op6_media, queries.op7_decontaminate, queries.op8_line_dedup, queries.op10_mix):
            rows = op(spark, str(d)).collect()
            assert op is queries.op7_decontaminate or len(rows) == docs.count()
