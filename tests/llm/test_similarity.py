"""SimHash, line dedup, decontamination and the mix against brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from claimspark.llm import lines, mixing, queries, simhash, tiling
from claimspark.llm.common import connected_components, table

from .rows import PROSE, awkward, empty


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashed = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def classes(pairs, links):
    root = {i: i for i in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in pairs}


def test_fingerprints_and_components(spark, sf, tmp_path):
    docs = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).filter("length(text) < 50000 or text is null")
    path = str(tmp_path / "sf")
    docs.write.parquet(f"{path}/documents.parquet")
    for d in (path, sf):
        prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in table(spark, d, "documents").collect()}
        ids = sorted(prints)
        want = classes(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
        got = queries.op3_simhash(spark, d).collect()
        assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints
        assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_in_dense_and_random_groups(spark, limit):
    draw = random.Random(3)
    base = draw.getrandbits(64)
    values = {draw.getrandbits(64) for _ in range(200)} | {base ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(150)} | {base ^ draw.getrandbits(3) << 61 for _ in range(8)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [(r["u"], r["v"]) for r in simhash.hamming_links(df, 2, limit).collect()]
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    want = classes(signed, [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if near(a, b)])
    assert classes(signed, edges) == want
    assert len(edges) <= 70 * len(signed)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 301), (300, 301)]
    for size in (200_000, 7):
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), part_rows=size).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def shingles_of_five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_similar_texts_meet_and_others_do_not(spark):
    """Groups of changed copies, one of them large, and texts of the same words in other orders."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for group in range(30):
        first = draw.choices(words, k=draw.randrange(60, 600))
        for _ in range(300 if group == 0 else 3):
            copy = list(first)
            copy[draw.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        texts.append(" ".join(draw.sample(first, len(first))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df, similarity=0.8).collect()}
    sets = list(map(shingles_of_five, texts))
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(sets)) for j in range(i)]
    alike = [got[i] == got[j] for i, j, x in pairs if x >= 0.8]
    assert len(alike) > 1000 and sum(alike) >= 0.9 * len(alike)
    assert not any(got[i] == got[j] for i, j, x in pairs if x < 0.3)


def test_recall_of_similar_texts_on_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    sets = {r["doc_id"]: shingles_of_five(r["text"]) for r in docs.collect()}
    ids = sorted(sets)
    alike = [got[a] == got[b] for n, a in enumerate(ids) for b in ids[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(alike) >= 0.9 * len(alike)


def test_all_similar_texts_are_linked_and_no_others(spark):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    passage = draw.choices(words, k=40)
    texts = []
    for _ in range(120):
        first = draw.choices(words, k=draw.randrange(6, 120)) + passage
        for _ in range(3):
            copy = list(first)
            for _ in range(draw.randrange(1, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    hub = draw.choices(words, k=60)
    texts += [" ".join([*hub[:i], draw.choice(words), *hub[i + 1 :]]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df, similarity=0.8).collect()}
    sets = list(map(shingles_of_five, texts))
    prints = [simhash.fingerprint(x.encode()) for x in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 2
    assert classes(range(len(texts)), [(i, j) for i, j in got.items() if i != j]) == classes(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j)])


def test_similar_texts_of_awkward_rows(spark):
    df = awkward(spark)
    assert simhash.near_duplicates(df, similarity=0.8).count() == df.count()
    assert simhash.keep_first(df, similarity=0.8).columns == df.columns
    assert simhash.keep_first(empty(spark), similarity=0.8).count() == 0


def test_keep_first_keeps_one_of_each_group(spark):
    docs = awkward(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and 6 not in ids and 7 not in ids and 0 in ids and 1 not in ids
    assert simhash.keep_first(empty(spark)).collect() == []


def slow_lines(rows, least):
    sites, keeper = defaultdict(set), {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(r["source"])
                if r["doc_id"] is not None:
                    keeper[line.strip(" ")] = min(keeper.get(line.strip(" "), r["doc_id"]), r["doc_id"])
    gone = lambda r, x: x.strip(" ") and len(sites[x.strip(" ")]) >= least and keeper.get(x.strip(" ")) != r["doc_id"]
    return sorted(((r["doc_id"], None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if not gone(r, x))) for r in rows), key=str)


@pytest.mark.parametrize(("least", "send"), [(1, 2000), (2, 2000), (2, 0), (3, 2000), (3, 1)])
def test_line_removal_equals_brute_force(spark, least, send):
    more = ["footer\nown one", " footer \n\nown two\nfooter", "own three\nfooter", "footer", "a\nb\nfooter\nb"]
    docs = awkward(spark, more)
    for name in ("__line_bad", "__lines", "key", "lines", "doc", "places", "a"):
        docs = docs.withColumn(name, F.lit(f"data of {name}"))
    out = lines.remove_boilerplate(docs, min_sites=least, send_lines=send)
    assert set(docs.columns) <= set(out.columns)
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    assert sorted(map(str, out.select(others).collect())) == sorted(map(str, docs.select(others).collect()))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == slow_lines(docs.collect(), least)
    assert lines.remove_boilerplate(empty(spark)).collect() == []


def test_line_removal_on_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    out = lines.remove_boilerplate(docs, min_sites=5)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == slow_lines(docs.collect(), 5)


def test_pipeline_removes_a_passage_of_few_sources(spark):
    draw = random.Random(5)
    rows = [(i, f"own text {i}\nthe passage that many documents share" if i % 2 else f"own text {i}", "en", "hot" if draw.random() < 0.6 else f"s{draw.randrange(7)}", 0) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert 5 <= len({r[3] for r in rows if r[0] % 2}) < 10
    kept = [r["doc_id"] for r in corpus_pipeline.line_stage(spark, docs, "").collect() if "passage" in r["text"]]
    assert kept == [1]


def slow_tokens(text):
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_tiles(p, t, least):
    """Greedy string tiling by trying all pairs of positions."""
    free_p, free_t, covered = [True] * len(p), [True] * len(t), 0
    while True:
        best = 0, 0, 0
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        for k in range(n):
            free_p[i + k] = free_t[j + k] = False
        covered += n


def test_tiles_equal_brute_force():
    draw = random.Random(4)
    for _ in range(60):
        p = [draw.randrange(4) for _ in range(draw.randrange(1, 30))]
        t = [draw.randrange(4) for _ in range(draw.randrange(1, 40))]
        got = tiling.greedy_tiles(np.array(p, np.uint64), np.array(t, np.uint64), 3)
        for a, b, n in got:
            assert p[a : a + n] == t[b : b + n] and n >= 3
        assert sum(n for _, _, n in got) == slow_tiles(p, t, 3)


def test_tiles_of_a_long_shuffled_item_are_found_fast():
    import time

    rng = np.random.default_rng(4)
    sentences = [rng.integers(1, 1 << 40, rng.integers(8, 60)).astype(np.uint64) for _ in range(150)]
    whole, other = np.concatenate(sentences), np.concatenate([sentences[i] for i in rng.permutation(150)])
    start = time.time()
    tiles = tiling.greedy_tiles(whole, other, 5)
    assert time.time() - start < 5 and sum(n for _, _, n in tiles) == len(whole) > 4_000


def test_decontamination(spark, sf, tmp_path):
    items = table(spark, sf, "benchmark").collect()
    words = items[3]["text"].split()
    mixed = "x y z " + " ".join(words[len(words) // 2 :]).upper() + " filler words here " + " ".join(words[: len(words) // 2])
    docs = awkward(spark, [f"before {items[0]['text']} after", mixed, " ".join(words[:6])])
    bench = spark.createDataFrame([(r["item_id"], r["text"]) for r in items] + [(900, None), (901, " "), (902, "zyx")], "item_id long, text string")
    found = {(r["id"], r["item"]) for r in tiling.contaminated(docs, bench).collect()}
    assert found == {(12, items[0]["item_id"]), (13, items[3]["item_id"])}
    assert {(r["id"], r["item"]) for r in tiling.contaminated(docs, bench, send_rows=0).collect()} == found
    kept = tiling.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert tiling.contaminated(empty(spark), bench).collect() == [] and tiling.contaminated(docs, bench.limit(0)).collect() == []


def test_decontamination_with_common_and_repeated_phrases_equals_brute_force(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    common = draw.choices(words, k=9)
    items = [" ".join(draw.choice([["x"] * 40, common, []]) + draw.choices(words, k=draw.randrange(4, 20)) + draw.choice([common, []])) for _ in range(30)] + ["x " * 85 + " ".join(words[:15])]
    texts = ["x " * 85, " ".join(common), ""]
    for _ in range(60):
        parts = [draw.choice(items).split() for _ in range(2)]
        cut = [p[draw.randrange(len(p)) :] + p[: draw.randrange(len(p))] for p in parts]
        texts.append(" ".join([*cut[0], *draw.choices(words, k=5), *cut[1], *common]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    share = lambda p, t: slow_tiles(p, t, min(5, len(p))) / len(p)
    want = {(i, j): share(p.split(), t.split()) for i, t in enumerate(texts) for j, p in enumerate(items)}
    want = {k: round(v, 9) for k, v in want.items() if v >= 0.8}
    assert len(want) > 20 and {(r["id"], r["item"]): round(r["coverage"], 9) for r in tiling.contaminated(docs, bench).collect()} == want


def test_decontamination_of_the_table_equals_brute_force(spark, sf):
    items = [(r["item_id"], slow_tokens(r["text"])) for r in table(spark, sf, "benchmark").collect()]
    want = set()
    for r in table(spark, sf, "documents").collect():
        tokens = slow_tokens(r["text"])
        grams = {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}
        for i, p in items:
            hit = {k for k in range(len(p) - 4) if tuple(p[k : k + 5]) in grams}
            if len({k + j for k in hit for j in range(5)}) >= 0.8 * len(p) and slow_tiles(p, tokens, 5) >= 0.8 * len(p):
                want.add((r["doc_id"], i))
    assert {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, sf).collect()} == want


def slow_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, capped = {}, set()
    left = 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = left - sum(2 * sizes[s] for s in capped)
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > 2 * sizes[s] + 1e-9]
        if not over:
            return {**{s: 2.0 * sizes[s] for s in capped}, **{s: rest * w[s] / sum(w[x] for x in free) for s in free}}
        capped |= set(over)


def hashed_order(docs, seed=11):
    """Ids, sizes, sources and texts of docs in the mix's order."""
    rows = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("at")).collect()
    return sorted(rows, key=lambda r: (r["at"], r["doc_id"] is not None, r["doc_id"] or 0))


def slow_mix(docs, block, least_blocks=1024):
    """The mix by its definition: every point of the schedule in turn takes the next block of the source it falls on."""
    placed, sizes = defaultdict(list), defaultdict(int)
    for n, r in enumerate(hashed_order(docs)):
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        placed[r["source"]] += [n] * size
        sizes[r["source"]] += size
    goal = slow_targets(dict(sizes))
    full = [x for x in sizes.values() if x]
    length = max(1, min(block, int(sum(full) / max(1, len(full)) // least_blocks)))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    long = {s: max(1, math.ceil(sizes[s] / max(1, math.floor(sizes[s] / length + 0.5)))) for s in names}
    blocks = {s: [placed[s][i : i + long[s]] for i in range(0, sizes[s], long[s])] for s in names}
    weight = {s: goal[s] / long[s] for s in names}
    total, taken, first, rank = sum(weight.values()), defaultdict(int), {}, defaultdict(int)
    for t in range(math.ceil(total - 1e-9)):
        u, low = ((t + 1) * mixing.GOLDEN % 2**64) / 2**64, 0.0
        for s in names:
            if low <= u * total < low + weight[s]:
                if rank[s] < 2 * len(blocks[s]):
                    for n in blocks[s][rank[s] % len(blocks[s])]:
                        taken[n] += 1
                        first.setdefault(n, t)
                rank[s] += 1
                break
            low += weight[s]
    return goal, sorted(((r["doc_id"], taken[n], first.get(n)) for n, r in enumerate(hashed_order(docs))), key=str)


@pytest.mark.parametrize("options", [{}, {"block_words": 64, "least_blocks": 4}, {"block_words": 7, "least_blocks": 1, "range_rows": 20}])
def test_mix_equals_the_schedule_played_slot_by_slot(spark, sf, options):
    for docs in (awkward(spark), table(spark, sf, "documents")):
        docs = docs.filter("length(text) < 50000 or text is null").dropDuplicates(["doc_id", "text"])
        rows = mixing.mix(docs, **options).collect()
        goal, want = slow_mix(docs, options.get("block_words", 128), options.get("least_blocks", 1024))
        assert sorted(((r["id"], r["taken"], r["first_slot"]) for r in rows), key=str) == want
        for s, t in goal.items():
            assert {round(r["target"], 3) for r in rows if r["source"] == s} == {round(t, 3)}


def test_mix_is_near_its_targets(spark, sf):
    for docs in (awkward(spark), table(spark, sf, "documents")):
        out = mixing.mix(docs)
        rows = out.collect()
        taken = defaultdict(int)
        for r in rows:
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        sizes = {r["source"]: r["source_size"] for r in rows if r["source_size"]}
        block = max(1, sum(sizes.values()) // len(sizes) // 1024)
        for r in rows:
            assert abs(taken[r["source"]] - r["target"]) <= max(3 * block, 0.01 * r["target"])
        key = lambda r: (str(r["id"]), r["size"], str(r["source"]), r["taken"], r["first_slot"])
        assert sorted(map(key, rows), key=str) == sorted(map(key, out.collect()), key=str)


def test_mix_comes_through_its_schedule(spark, sf, monkeypatch):
    docs, true = table(spark, sf, "documents"), mixing.schedule
    taken = lambda: sum(r["taken"] for r in mixing.mix(docs).collect())
    whole = taken()
    monkeypatch.setattr(mixing, "schedule", lambda *a: true(*a).filter("slot % 2 = 0"))
    assert 0 < taken() < whole
    monkeypatch.setattr(mixing, "schedule", lambda *a: true(*a).limit(0))
    assert taken() == 0


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2


def test_schedule_is_even(spark):
    quotas = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 20.0), ("d", 0.0)], "source string, weight double")
    rows = mixing.schedule(quotas, 1000, range_rows=64).orderBy("slot").collect()
    seen = defaultdict(int)
    for n, r in enumerate(rows, 1):
        assert r["slot"] == n - 1 and r["rank"] == seen[r["source"]]
        seen[r["source"]] += 1
        assert all(abs(seen[s] - n * w) < 6 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


def test_word_count_is_of_ascii_blanks(spark):
    docs = spark.createDataFrame([(1, "a b c d\x1f e", "s")], "doc_id long, text string, source string")
    assert mixing.mix(docs).first()["size"] == 3
    assert PROSE and docs.select(F.lit(1)).count() == 1
