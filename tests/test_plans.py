"""Plan patterns under skew: the rows are those of brute force, and no task gets what one key or value holds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators import monitoring, notes, training
from claimspark.plans import joins, windows

D = datetime.date(2024, 1, 1)


def day(n):
    return D + datetime.timedelta(days=n)


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_with_one_value_on_most_rows(spark, descending):
    rows = spark.range(9000).selectExpr("concat('c', id) k", "case when id % 10 < 9 then 0.5 when id % 50 = 9 then null else id / 9000 end v")
    got = {r["k"]: (r["percent_rank"], r["ntile"]) for r in windows.global_rank(rows, "v", "k", descending, ntiles=7).collect()}
    order = f"v {'desc' if descending else 'asc'} nulls last"
    want = rows.selectExpr("k", f"percent_rank() over (order by {order}) p", f"ntile(7) over (order by {order}, k) n").collect()
    assert got == {r["k"]: (r["p"], r["n"]) for r in want}
    held = [r["count"] for r in windows.in_order(rows, [F.col("v"), F.col("k")]).groupBy("_part").count().collect()]
    assert len(held) == 4 and max(held) < 2 * 9000 / 4
    assert windows.global_rank(rows.limit(0), "v", "k", ntiles=3).collect() == []
    assert [r["percent_rank"] for r in windows.global_rank(rows.limit(1), "v", "k").collect()] == [0.0]


def test_running_sums_over_stretches(spark):
    rows = spark.range(500).selectExpr("id", "id % 3 g", "cast(id * 37 % 11 as int) x")
    for by in ((), ("g",)):
        ordered = windows.in_order(rows, [*map(F.col, by), F.col("id")])
        for include in (True, False):
            got = {r["id"]: r["s"] for r in windows.running(ordered, {"s": F.col("x")}, by, include).collect()}
            assert got == {i: sum(j * 37 % 11 for j in range(i + include) if not by or j % 3 == i % 3) for i in range(500)}


def test_asof_of_one_account_with_half_of_all_rows(spark):
    draw = random.Random(1)
    left = [(i, "hot" if i % 2 else f"a{i % 40}", day(draw.randrange(400)) if i % 29 else None) for i in range(2000)] + [(9000, None, D)]
    right = sorted({(k, day(draw.randrange(400))) for k in ["hot"] * 150 + [f"a{i}" for i in range(0, 40, 3)] * 5})
    a = spark.createDataFrame(left, "id int, k string, d date")
    b = spark.createDataFrame([(k, d, f"{k}@{d}" if d.day % 7 else None) for k, d in right], "k string, e date, v string")
    for strict in (True, False):
        found = joins.asof(a, b, ["k"], "d", "e", F.col("v"), "got", strict)
        assert found.columns == ["id", "k", "d", "got"]
        want = {}
        for i, k, d in left:
            past = [f"{x}@{e}" for x, e in right if d and x == k and (e < d or e == d and not strict) and e.day % 7]
            want[i] = past[-1] if past else None
        assert {r["id"]: r["got"] for r in found.collect()} == want
    asked = a.filter("d is not null and k is not null").select("k", "d").distinct()
    assert asked.groupBy("k").count().agg(F.max("count")).first()[0] <= 400  # what meets in a window, however many rows the account has


def test_ten_thousand_overlapping_contracts(spark):
    draw = random.Random(2)
    ranges = []
    for i in range(10_000):
        start = draw.randrange(-50, 300)
        end = None if i % 5000 == 4998 else day(start + draw.randrange(-2, 60))
        ranges.append(("p" if i % 3 else "q", day(start) if i % 97 else None, end, i % 2 == 0 if i % 11 else None))
    sparse = [("r", day(10), day(12), True), ("r", day(12), day(12), True), ("r", day(20), day(19), True), ("r", day(30), None, False), (None, day(1), None, True)]
    left = [(i, ("p", "q", "r", None)[i % 4], day(i // 4) if i % 101 else None) for i in range(1200)]
    r = spark.createDataFrame(ranges + sparse, "k string, start date, end date, f boolean")
    a = spark.createDataFrame(left, "id int, k string, d date")
    got = {x["id"]: x["hit"] for x in joins.any_interval(a, r, "k", "d", "f", "hit").collect()}
    assert got == {i: int(any(k is not None and k == x and f and s and d and s <= d and (e is None or d <= e) for x, s, e, f in ranges + sparse)) for i, k, d in left}
    days = a.select("k", "d").distinct().dropna()
    assert days.groupBy("k").count().agg(F.max("count")).first()[0] <= 300  # days and changes of a key meet in a window, contracts don't


def test_curves_of_bunched_scores(spark):
    draw = random.Random(3)
    rows = [(0.5 + draw.randrange(4000) * 1e-8, draw.randrange(2)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "score double, label int")
    below, area = 0.0, 0.0
    negatives = sorted(s for s, y in rows if not y)
    import bisect

    for s, y in rows:
        if y:
            low, high = bisect.bisect_left(negatives, s), bisect.bisect_right(negatives, s)
            area += low + (high - low) / 2
    below = area / (len(negatives) * (len(rows) - len(negatives)))
    assert monitoring.auc_roc(df).first()[0] == pytest.approx(below, abs=1e-12)
    per = df.groupBy("score").count()
    held = [r["count"] for r in windows.in_order(per, [F.col("score").desc()]).groupBy("_part").count().collect()]
    assert len(held) == 4 and max(held) < 2 * sum(held) / 4
    both = df.withColumn("m", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("score", F.when(F.col("m") == "a", F.col("score")).otherwise(1 - F.col("score")))
    by = {r["m"]: r["auc_roc"] for r in monitoring.auc_roc(both, by=("m",)).collect()}
    assert by["a"] == pytest.approx(below, abs=1e-12) and by["b"] == pytest.approx(1 - below, abs=1e-12)
    one = {r["m"]: r["auc_pr"] for r in monitoring.average_precision(both, by=("m",)).collect()}
    assert one["a"] == pytest.approx(monitoring.average_precision(df).first()[0], abs=1e-12)


def test_a_key_with_most_notes(spark):
    hot = spark.range(60_000).selectExpr("'hot' k", "cast(id as int) t", "if(id % 5 = 0, '  ', concat('word', id, ' and  more')) text")
    few = spark.createDataFrame([("a", 2, "two  three"), ("a", 1, "one"), ("b", 1, " \n"), ("c", None, "late " * 30), ("c", 1, None), ("c", 0, "early")], "k string, t int, text string")
    got = {r["k"]: r["text"] for r in notes.prepare_notes(hot.union(few), "k", ["t"], most=25).collect()}
    words = [w for i in range(60_000) if i % 5 for w in (f"word{i}", "and", "more")]
    assert got == {"hot": " ".join(words[:25]), "a": "one two three", "c": " ".join(["late"] * 25)}


def test_importance_is_one_pass(spark):
    rows = spark.range(400).selectExpr("id", "cast(id % 2 as int) label", "cast(id % 2 as double) + rand(1) / 4 a", "rand(2) b", "1.0D c")
    names = ["a", "b", "c"]
    mixed = training.exchanged(rows, names, F.col("id") % 3, F.col("id")).collect()
    assert len(mixed) == 1600
    base = {r["id"]: r for r in mixed if r["feature"] is None}
    for r in mixed:
        if r["feature"]:
            before = r["id"] - 3 if r["id"] >= 3 else max(i for i in range(400) if i % 3 == r["id"] % 3)
            assert all(r[c] == (base[before] if c == r["feature"] else base[r["id"]])[c] for c in names)
    found = {r["feature"]: r["importance"] for r in training.importance_of(training.exchanged(rows, names, F.col("id") % 3, F.col("id")).withColumn("score", F.col("a"))).collect()}
    assert found["a"] > 0.2 and found["b"] == found["c"] == 0.0


def test_trailing_sums_of_several_keys(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice("ab") if i % 7 else None, draw.choice("xyz"), day(draw.randrange(200)) if i % 31 else None, draw.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, p string, q string, submission_date date, n int")
    sets = {"all": (), "p": ("p",), "pq": ("p", "q")}
    within = lambda a, b: a and b and 0 <= (a - b).days <= 90
    want = {}
    for i, p, q, d, _ in rows:
        near = [r for r in rows if within(d, r[3])]
        same = {"all": near, "p": [r for r in near if r[1] == p], "pq": [r for r in near if (r[1], r[2]) == (p, q)]}
        want[i] = tuple(sum(r[4] for r in x) if d else None for x in same.values())
    for send in (200_000, 10):
        found = windows.trailing_cube(df, sets, {"n_sum": F.col("n")}, send_rows=send)
        assert {r["id"]: tuple(r[f"{s}_n_sum"] for s in sets) for r in found.collect()} == want


def test_claims_of_files_are_assembled_without_a_shuffle_of_segments(spark):
    """Blocks of whole files are cut within their rows; those of split files need one shuffle, and both give the same claims, whatever a claim holds."""
    from claimspark.sources import edi
    from tests.test_fixtures import claim_file

    odd = claim_file().replace("LX*2~", "NM1*82*1*DOC~NM1*85*2*OTHER*****XX*9999999999~N3*9 SIDE~REF*6P*NOT~").replace("CLM*A2", "~ clm *A2").replace("HI*ABK:I10*", "HI~HI*ABF:Z1:x*BK*")
    files = spark.createDataFrame([("odd", odd), ("fine", claim_file()), ("blank", claim_file()[:106])], "file_name string, content string")
    rows = edi.with_delimiters(files)
    blocks = edi.file_blocks(rows)
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    told = lambda df: sorted(str(sorted(r.asDict(recursive=True).items())) for r in df.collect())
    got = told(edi.claims_of_blocks(blocks))
    assert got == told(edi.assemble_claims(edi.explode_segments(rows))) and len(got) == 4
    claims = {(r["file_name"], r["patient_account_number"]): r for r in edi.claims_of_blocks(blocks).collect()}
    # a provider named within a claim counts from that claim on, with the address that follows it
    assert {claims["odd", a]["provider_npi"] for a in ("A1", "A2")} == {"9999999999"} and claims["odd", "A1"]["billing_provider_street"] == "9 SIDE" and claims["odd", "A1"]["billing_provider_city"] is None
    assert claims["odd", "A1"]["secondary_icd10_codes"] == ["Z1", "E119", "I500"] and claims["odd", "A1"]["principal_icd10_code"] == "" and claims["odd", "A1"]["group_number"] is None


@pytest.mark.parametrize("size", [1, 3000, 1 << 22])
def test_claims_of_files_are_told_where_their_rows_are(spark, monkeypatch, size):
    """Without a shuffle, and as from shuffled segments, whatever files are read at once."""
    from claimspark.sources import edi
    from tests.test_fixtures import claim_file

    fine = claim_file()
    odd = fine.replace("LX*2~", "NM1*82*1*DOC~NM1*85*2*OTHER*****XX*9999999999~N3*9 SIDE~REF*6P*NOT~").replace("CLM*A2", "~ clm *A2").replace("HI*ABK:I10*", "HI~HI*ABF:Z1:x*BK*")
    texts = {
        "odd": odd, "fine": fine, "blank": fine[:106], "other": fine.replace("*", "|").replace("~", "\n"), "mixed": odd.replace("*", "|"), "early": fine.replace("GS*HC~", "GS*HC~CLM*A0*7~SV1*HC:1~"),
        "bare": fine.replace("SV2*450", "SV2*").replace("DTP*472*D8*20240104", "DTP*472*D8*2024~DTP*472*D8*20240102").replace("HI*", "HJ*"), "late": fine.replace("SE*1", "HL*4*3*23*0~NM1*QC*1*KID*A~REF*6P*G7~CLM*A3*1~SE*1"),
    }
    rows = edi.with_delimiters(spark.createDataFrame(list(texts.items()), "file_name string, content string").coalesce(1))
    monkeypatch.setattr(edi, "BYTES", size)
    claims = edi.claims_of_files(rows)
    assert "Exchange" not in claims._jdf.queryExecution().executedPlan().toString()
    told = lambda df: sorted(str(sorted(r.asDict(recursive=True).items())) for r in df.collect())
    got = told(claims)
    assert got == told(edi.assemble_claims(edi.explode_segments(rows))) and len(got) == 16


def test_service_lines_of_interchanges_need_no_shuffle_of_claims(spark, sf):
    from claimspark.plans import intake

    assert "Exchange" not in intake.ingested_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_segments_that_an_envelope_needs(spark):
    """A name counts in all forms that a segment has once it is trimmed, and in no others."""
    from claimspark.sources import edi
    from tests.test_fixtures import claim_file

    text = claim_file()
    forms = {"GS*HC~": True, " \n GS*HC~": True, "GS~": True, "GS \t~": True, "~GS*~": True, "GSX*HC~": False, "GS *HC~": False, "gs*HC~": False, "X*GS*~": False, "XGS*HC~": False}
    rows = [(f"{i}", text.replace("GS*HC~", form)) for i, form in enumerate(forms)] + [("end", text.replace("IEA*1~", "") + " IEA \n")]
    got = {r["file_name"]: (r["is_valid"], r["segment_ref"]) for r in edi.validate_envelope(spark.createDataFrame(rows, "file_name string, content string")).collect()}
    assert got == {**{f"{i}": (fine, None if fine else "GS") for i, fine in enumerate(forms.values())}, "end": (True, None)}


def test_prefixes_are_matched_once_a_code(spark, sf):
    """No aggregation by claim: what is grouped for the longest prefix are the distinct codes."""
    from claimspark import queries

    plan = queries.prefix_matches(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "max_by" in line]
    assert groups and not any("claim_id" in line for line in groups)


def test_codes_of_claims_are_looked_up_in_their_rows(spark, sf, monkeypatch):
    from claimspark import queries
    from claimspark.operators import features

    plan = queries.feature_table(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(claim_id" not in plan
    want = sorted(map(tuple, queries.clinical_features(spark, sf).collect()))
    assert any(r[4] > 0 for r in want)
    monkeypatch.setattr(features, "MAP_CODES", 0)  # more codes than that: joined
    assert sorted(map(tuple, queries.clinical_features(spark, sf).collect())) == want


def test_vectors_are_held_few_at_a_time():
    import numpy as np
    import pandas as pd

    from claimspark.operators import notes

    frames = list(notes.encoded(iter([pd.Series([str(i) for i in range(1000)])]), lambda t: np.full(2, float(t)) if t != "7" else np.zeros(3), 2))
    assert max(len(f) for f in frames) <= notes.HELD
    rows = [r for f in frames for r in f.itertuples(index=False)]
    assert [r.error for r in rows if r.error] == ["dimension (3,)"] and rows[7].embedding is None
    assert all(r.embedding.dtype == np.float32 and r.embedding.tolist() == [i, i] for i, r in enumerate(rows) if i != 7)


def test_interchanges_sort_without_a_comparator(spark, sf):
    from claimspark.plans import intake

    plan = intake._loops(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
