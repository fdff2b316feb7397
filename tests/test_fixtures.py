"""Hand-made rows for what the tables don't show: boundaries, sentinels, files and streams."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark import queries
from claimspark.functions import reference
from claimspark.functions import scalars as S
from claimspark.operators import features, monitoring, notes, scoring, training
from claimspark.plans import views, windows
from claimspark.plans.joins import asof, keyed_upsert
from claimspark.sources import edi, ehr
from claimspark.streaming import incremental

D = dt.date


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    s, d = (lambda x: F.lit(x).cast("string")), (lambda x: F.lit(x).cast("date"))
    assert one(spark, *(S.pad4(s(x)) for x in ("450", "0", None, "00012", "12345"))) == ("0450", "0000", "0000", "0012", "12345")
    assert one(spark, *(S.npi_ok(s(x)) for x in ("1234567890", "123", None, "12345678901"))) == (True, False, False, False)
    assert one(spark, *(S.x12_date(s(x)) for x in ("20240229", "20230229", "2024", None))) == (D(2024, 2, 29), None, None, None)
    assert [str(x) for x in one(spark, *(S.x12_amount(s(x)) for x in ("12.345", "x", None)))] == ["12.35", "None", "None"]
    assert one(spark, *(S.x12_units(s(x)) for x in ("3", "-2", "2.9", "x"))) == (3, 0, 2, None)
    assert one(spark, *(S.age_years(d(a), d(b)) for a, b in (("2000-02-29", "2023-02-28"), ("2000-02-29", "2023-03-01"), ("2000-06-01", "2020-06-01"), (None, "2020-01-01"), ("2021-01-01", "2020-06-01")))) == (22, 23, 20, -1, -1)
    assert one(spark, *(S.gender_code(s(x)) for x in ("M", " f ", "U", "", None))) == (1, 0, -1, -1, -1)
    assert one(spark, *(S.length_of_stay(d(a), d(b)) for a, b in ((None, None), ("2024-01-01", None), ("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-01")))) == (-2, -1, 4, 0)
    assert one(spark, *S.date_features(d("2024-12-31")), *S.date_features(d(None))) == (366, 12, 0, 0)
    assert one(spark, *(S.parse_ts_date(s(x)) for x in ("2024-06-15", "2024-06-15T23:30:00+05:00", "2024-06-15 01:02:03.5", "2024-13-01", "15/06/2024", None))) == (D(2024, 6, 15),) * 3 + (None,) * 3
    assert one(spark, *(S.phrase_flag(s(x)) for x in ("No Prior  Authorization on file", "PREAUTH needed", "author", None))) == (1, 1, 0, 0)
    assert one(spark, *(S.alert_tier(F.lit(x).cast("double")) for x in (0.79, 0.80, 0.85, None))) == ("urgent", "degradation", "none", "none")
    assert one(spark, S.gate_stage(F.lit(0.9), F.lit(0.05)), S.gate_stage(F.lit(0.89), F.lit(0.0))) == ("Staging", "Failed")
    assert one(spark, S.norm_icd10(s(" e10.21 ")), S.code5(s(" 9921399 "))) == ("E1021", "99213")


def window_claims(spark, *groups):
    rows, i = [], 0
    for npi, outcome, n in groups:
        for _ in range(n):
            rows.append((f"c{i}", npi, D(2024, 6, 1), outcome, i))
            i += 1
    return spark.createDataFrame(rows, "claim_id string, provider_npi string, submission_date date, adjudication_outcome string, seq int")


def test_anchored_rates_and_thresholds(spark):
    at = "2024-06-15"
    rate = lambda df, least=30, default=0.0: {r["provider_npi"]: r["rate"] for r in windows.anchored_rates(df, "provider_npi", at, least, default).collect()}
    assert rate(window_claims(spark, ("a", "denied", 29), ("b", "denied", 5), ("b", "paid", 45)))["a"] == pytest.approx(34 / 79)
    assert rate(window_claims(spark, ("a", "denied", 15), ("a", "paid", 15)))["a"] == 0.5
    assert rate(window_claims(spark, ("a", "pending", 3)), default=0.5)["a"] == 0.5
    assert rate(window_claims(spark, ("a", "pending", 3)))["a"] == 0.0
    last = lambda df: {r["provider_npi"]: r["rate"] for r in windows.leave_last_out(df, "provider_npi", ["seq"], at).collect()}
    assert last(window_claims(spark, ("a", "paid", 11), ("a", "denied", 20), ("b", "denied", 1), ("b", "paid", 49)))["a"] == pytest.approx(19 / 30)
    assert last(window_claims(spark, ("a", "denied", 30), ("b", "denied", 5), ("b", "paid", 15)))["a"] == pytest.approx(0.7)


def test_trailing_window_ends_are_inside(spark):
    rows = [(str(k), "a", D(2024, 6, 15) - dt.timedelta(days=k), "denied") for k in (0, 90, 91)]
    df = spark.createDataFrame(rows, "claim_id string, provider_npi string, submission_date date, adjudication_outcome string")
    got = {r["claim_id"]: r["r_known"] for r in windows.trailing_rate(df, ["provider_npi"], 1, 0.0, "r").collect()}
    assert got == {"0": 2, "90": 2, "91": 1}


def test_clinical(spark):
    schema = "claim_id string, principal_icd10_code string, secondary_icd10_codes array<string>, cpt_codes array<string>, admission_date date, discharge_date date"
    rows = [("1", "I21.0", ["I50", "e10.21", "E102"], ["93454", " 93000 "], None, None), ("2", "i21.9", ["I21", "I22", None], ["99213"], D(2024, 1, 1), D(2024, 1, 3)), ("3", None, None, None, None, D(2024, 1, 1)), ("4", "zz", [], [], None, None)]
    r = {x["claim_id"]: x for x in features.clinical(spark.createDataFrame(rows, schema), reference.ccs(spark), reference.procedures(spark), reference.charlson(spark), reference.expected(spark)).collect()}
    assert [r[k]["principal_dx_ccs_category"] for k in "1234"] == [100, 100, 0, 0]
    assert [r[k]["comorbidity_risk_score"] for k in "1234"] == [3, 2, 0, 0]
    assert [r[k]["diagnosis_procedure_mismatch"] for k in "1234"] == [0, 1, 0, 0]
    assert [r[k]["length_of_stay"] for k in "1234"] == [-2, 2, -1, -2]
    assert [sum(r[k]["procedure_vector"]) for k in "1234"] == [2, 1, 0, 0] and len(r["3"]["procedure_vector"]) == 25
    assert [r[k]["secondary_dx_count"] for k in "1234"] == [3, 3, 0, 0]


def test_asof_and_upsert(spark):
    left = spark.createDataFrame([(1, "a", D(2024, 1, 5)), (2, "a", D(2024, 1, 3)), (3, None, D(2024, 1, 9)), (4, "a", None)], "id int, k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 3), "x"), ("a", D(2024, 1, 1), "w"), (None, D(2024, 1, 1), "n")], "k string, d date, v string")
    for strict, want in ((True, {1: "x", 2: "w", 3: None, 4: None}), (False, {1: "x", 2: "x", 3: None, 4: None})):
        assert {r["id"]: r["got"] for r in asof(left, right, ["k"], "d", "d", F.col("v"), "got", strict).collect()} == want
    store = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "claim_id string, x string, y int")
    new = spark.createDataFrame([("2", None), ("3", "c")], "claim_id string, x string")
    assert sorted(map(tuple, keyed_upsert(store, new, "claim_id").collect())) == [("1", "a", 1), ("2", None, 2), ("3", "c", None)]
    assert sorted(map(tuple, keyed_upsert(store, new, "claim_id", insert=False).collect())) == [("1", "a", 1), ("2", None, 2)]


def test_monitoring(spark):
    def store(tp, fp, tn, day=D(2024, 6, 10)):
        return spark.createDataFrame([(0.9, "denied", day)] * tp + [(0.9, "paid", day)] * fp + [(0.1, "paid", day)] * tn + [(0.9, "pending", day)], "predicted_denial_score double, adjudication_outcome string, scored_date date")

    at = lambda df: tuple(monitoring.monitor(df, "2024-06-15").select("rolling_precision", "alert_tier", "retraining").first())
    assert at(store(20, 5, 25)) == (0.8, "degradation", "inactive")
    assert at(store(20, 5, 4)) == (None, "none", "inactive") and at(store(0, 0, 40)) == (None, "none", "inactive")
    assert at(store(79, 21, 0)) == (0.79, "urgent", "active")
    assert at(store(40, 0, 0, D(2024, 5, 16)))[0] is None and at(store(40, 0, 0, D(2024, 5, 17)))[0] == 1.0
    dates = lambda *days: spark.createDataFrame([(D(2024, 6, 15) - dt.timedelta(days=k),) for k in days], "scored_date date")
    assert [monitoring.retention_check(dates(*x), "2024-06-15").first()["alert"] for x in ((120, 1), (10, 1), (90, 1), (120,))] == [True, False, False, False]
    runs = spark.createDataFrame([("m", i, s) for i, s in enumerate(["Failed", "Archived", "Failed", "Failed", "Staging", "Failed"])], "model string, run_id int, stage string")
    assert [(r["streak"], r["escalate"]) for r in monitoring.failure_streak(runs).orderBy("run_id").collect()] == [(1, False), (1, False), (2, False), (3, True), (0, False), (1, False)]


def test_metrics_and_training(spark):
    rows = spark.createDataFrame([(0.3, 1), (0.6, 0), (0.7, 1), (1.0, 1), (0.3, 0)], "score double, label int")
    r = training.evaluate(rows).first()
    assert (r["precision"], r["recall"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3)) and r["auc_roc"] == pytest.approx(4.5 / 6)
    assert training.evaluate(rows.filter("label = 1")).first()["auc_roc"] == 0.0
    days = [D(2024, 1, 1 + i // 10) for i in range(100)]
    df = spark.createDataFrame([(str(i), d, "denied" if i % 5 == 0 else "paid", float(i % 5 == 0) + i / 1000) for i, d in enumerate(days)], "claim_id string, submission_date date, adjudication_outcome string, x double")
    split = training.temporal_split(training.labelled(df))
    assert {(r["split"], r["total"]) for r in training.split_stats(split).collect()} == {("train", 80), ("test", 20)}
    with pytest.raises(training.InsufficientDataError):
        training.select_window(df, "2024-01-31", 101)
    assert training.select_window(df, "2024-01-31", 100).count() == 100
    model = training.fit(split.filter("split = 'train'"), ["x"], maxIter=2, maxDepth=2)
    assert training.evaluate(training.predict(model, split.filter("split = 'test'"))).first()["auc_roc"] == 1.0
    assert training.permutation_importance(model, split, ["x"]).first()["importance"] > 0.2
    assert training.search(split, split, ["x"], trials=1)[1] == 1.0
    assert training.evaluate(rows.filter("label = 1")).first()["auc_pr"] == 0.0 and training.evaluate(rows.filter("label = 0")).first()["auc_pr"] == 0.0
    errors = []
    with pytest.raises(RuntimeError, match="all 2 trials failed"):
        training.search(split, split, ["absent"], trials=2, errors=errors)
    assert len(errors) == 2 and "maxDepth" in errors[0][0]


def test_training_run(spark, sf):
    r = queries.training_run(spark, sf).first()
    assert r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0 and 0 <= r["auc_roc"] <= 1 and r["stage"] in ("Staging", "Failed")


def test_curve_sums_across_ranges(spark):
    rows = spark.createDataFrame([(s / 10_000, int(s % 3 == 0)) for s in range(0, 10_000, 7)] + [(None, 1)], "score double, label int")
    seen = sorted(((r["score"] if r["score"] is not None else -1, r["label"]) for r in rows.collect()), reverse=True)
    neg = [s for s, y in seen if not y]
    want = sum(sum(n < s for n in neg) for s, y in seen if y) / (len(neg) * (len(seen) - len(neg)))
    assert abs(monitoring.auc_roc(rows).first()["auc_roc"] - want) < 1e-12


class Picky:
    def predict(self, x):
        if (x > 5).any():
            raise ValueError("too large")
        return x[:, 0]


def test_scoring_and_versions(spark):
    df = spark.createDataFrame([("1", 0.4), ("2", 9.0), ("3", None), ("4", -2.0)], "claim_id string, a double")
    got = {r["claim_id"]: (r["predicted_denial_score"], r["score_quality_flag"], r["score_error"]) for r in scoring.score(df, Picky(), ("a",)).collect()}
    assert got == {"1": (0.4, None, None), "2": (None, None, "too large"), "3": (0.0, "degraded", None), "4": (0.0, None, None)}
    with pytest.raises(scoring.PipelineBlockedError):
        scoring.score(df, None, ("a",))
    old = scoring.stamp_version(df, "0.9").unionByName(scoring.stamp_version(df.limit(1), "0.1"))
    good, bad = scoring.migrate(old, {("0.9", "1.0"): lambda d: d.withColumn("b", F.lit(1))}, "1.0")
    assert {(r["schema_version"], r["b"]) for r in good.collect()} == {("1.0", 1)} and bad.count() == 1
    assert scoring.migration_path({("a", "b"): None, ("b", "a"): None}, "a", "c") is None


def test_notes(spark):
    rows = [("1", 2, "second note"), ("1", 1, "  first\n\nprior auth "), ("1", 3, None), ("2", 1, "boom"), ("3", 1, " "), ("3", 2, "\n\t"), ("4", 1, "\n")]
    df = spark.createDataFrame(rows, "claim_id string, note_datetime int, text string")
    assert {r["claim_id"]: r["text"] for r in notes.prepare_notes(df, "claim_id", ["note_datetime"], most=3).collect()} == {"1": "first prior auth", "2": "boom"}

    def load():
        def encode(text):
            if text == "boom":
                raise RuntimeError("no")
            return [0.25, 0.75]

        return encode

    got = {r["claim_id"]: r for r in notes.note_features(spark.createDataFrame([("1",), ("2",), ("3",)], "claim_id string"), df, load, dimension=2).collect()}
    assert [(got[k]["documents_medical_necessity"], got[k]["mentions_lack_of_pre_auth"], got[k]["nlp_flag"]) for k in "123"] == [(0.5, 1, 0), (0.5, 0, 2), (0.5, 0, 1)]


ISA = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *240101*1200*^*00501*000000001*0*P*:~"


def claim_file(*, npi="1234567890", payer="PAY1", principal="ABK:I10"):
    loops = ""
    for n, (name, dob, who) in enumerate((("DOE", "19800101", payer), ("ROE", "19900202", "PAY2")), 1):
        loops += f"HL*{n + 1}*1*22*0~NM1*IL*1*{name}*JO****MI*M{n}~DMG*D8*{dob}*F~NM1*PR*2*X*****PI*{who}~CLM*A{n}*100.5***11:B:1~DTP*435*D8*20240103~HI*{principal}*ABF:E119*ABF:I500~LX*1~SV1*HC:99213*60.25*UN*2~DTP*472*D8*20240104~LX*2~SV2*450*HC:93000*40*UN*1~DTP*472*D8*20240105~"
    return ISA + f"GS*HC~ST*837~HL*1**20*1~NM1*85*2*CLINIC*****XX*{npi}~N3*1 MAIN~N4*TOWN*NY*10001~{loops}SE*1~GE*1~IEA*1~"


def test_all_diagnoses_of_a_long_segment_are_read(spark):
    text = claim_file().replace("*ABF:E119*ABF:I500", "".join(f"*ABF:E{i:03d}" for i in range(90)))
    files = spark.createDataFrame([("long", text)], "file_name string, content string")
    rows = edi.assemble_claims(edi.explode_segments(edi.validate_envelope(files).filter("is_valid"))).collect()
    assert rows and all(r["secondary_icd10_codes"] == [f"E{i:03d}" for i in range(90)] for r in rows)


def test_rows_that_cannot_be_read_and_days_replaced(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"claim_id": "1", "a": 2}\n{"claim_id": \n\n{"claim_id": "3"}\n')
    good, bad = scoring.read_rows(spark, str(tmp_path / "rows.json"), "claim_id string, a int")
    assert sorted(map(tuple, good.collect())) == [("1", 2), ("3", None)] and [r[0] for r in bad.collect()] == ['{"claim_id": ']
    days = lambda *rows: spark.createDataFrame([(D(2024, 1, d), n) for d, n in rows], "day date, n int")
    out = str(tmp_path / "days")
    scoring.write_by_day(days((1, 1), (2, 2)), out, "day")
    scoring.write_by_day(days((2, 5), (2, 6)), out, "day")
    assert sorted((r["n"], str(r["day"])) for r in spark.read.parquet(out).collect()) == [(1, "2024-01-01"), (5, "2024-01-02"), (6, "2024-01-02")]
    assert scoring.get_row(good, "3").count() == 1 and scoring.get_row(good, "9").count() == 0


def test_ad_hoc_sql_and_imputed_arrays(spark, sf):
    claims = views.register_views(spark, sf)
    assert spark.sql("select count(*) from claims").first()[0] == views.run_sql(spark, "select * from {claims}", claims).count() > 0
    row = features.impute(spark.createDataFrame([(None, None)], "patient_age int, v array<int>")).first()
    assert (row["patient_age"], row["v"]) == (0, [])


def test_payer_outcomes_in_any_case(spark):
    rows = [(str(i), "p", "professional", D(2024, 1, 1), "DENIED" if i % 2 else "Paid") for i in range(60)]
    claims = spark.createDataFrame(rows, "claim_id string, payer_name string, claim_type string, submission_date date, adjudication_outcome string")
    era = spark.createDataFrame([("p", D(2023, 12, 30), "paid")], "payer_name string, payment_date date, status string")
    contracts = spark.createDataFrame([("p", D(2023, 1, 1), None, True)], "payer_name string, start date, end date, stop_loss boolean")
    got = {tuple(r)[1:] for r in features.payer(claims, era, contracts).collect()}
    assert got == {(0.5, 0.5, 2, 1)}


def test_claim_files(spark, tmp_path):
    assert len(ISA) == 106
    files = {"good": claim_file(), "nopayer": claim_file(payer=""), "cut": ISA[:50], "empty": "  ", "noiea": claim_file().replace("IEA*1~", ""), "nogs": claim_file().replace("GS*HC~", ""), "other": "hello", "latin": claim_file().replace("DOE", "DO\xcb")}
    (tmp_path / "in").mkdir()
    for name, text in files.items():
        (tmp_path / "in" / name).write_bytes(text.encode("latin-1"))
    paths = edi.ingest_edi(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-01")
    before = {k: spark.read.format("json" if k == "rejects" else "parquet").load(p).count() for k, p in paths.items()}
    assert edi.ingest_edi(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-01") == paths  # a retry doubles nothing
    assert before == {k: spark.read.format("json" if k == "rejects" else "parquet").load(p).count() for k, p in paths.items()}
    bad = {r["file_name"]: r["segment_ref"] for r in spark.read.parquet(paths["quarantine"]).collect()}
    assert bad == {"cut": "ISA", "empty": "", "noiea": "IEA", "nogs": "GS", "other": "ISA"}
    rows = {r["patient_account_number"]: r for r in spark.read.parquet(paths["parsed"]).filter("file_name = 'good'").collect()}
    a, b = rows["A1"], rows["A2"]
    assert (a["payer_id"], b["payer_id"], a["patient_last_name"], b["patient_last_name"], b["date_of_birth"]) == ("PAY1", "PAY2", "DOE", "ROE", D(1990, 2, 2))
    assert a["secondary_icd10_codes"] == ["E119", "I500"] and a["principal_icd10_code"] == "I10" and a["billing_provider_city"] == "TOWN" and a["claim_type"] == "institutional"
    assert [(x["revenue_code"], x["cpt_hcpcs_code"], x["service_date"], float(x["charge_amount"]), x["units_of_service"]) for x in a["service_lines"]] == [(None, "99213", D(2024, 1, 4), 60.25, 2), ("0450", "93000", D(2024, 1, 5), 40.0, 1)]
    rejects = spark.read.json(paths["rejects"])
    assert {(r["file_name"], r["field_name"]) for r in rejects.filter("error_type = 'MISSING_REQUIRED_FIELD'").collect()} == {("nopayer", "payer_id")}
    assert spark.read.parquet(paths["raw"]).count() == len(files)
    query = incremental.stream_edi(spark, str(tmp_path / "in"), str(tmp_path / "streamed"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/streamed/parsed").count() == spark.read.parquet(paths["parsed"]).count()


def test_bundles_remittances_and_stream(spark, tmp_path):
    entry = lambda **r: {"resource": {"resourceType": "Encounter", "subject": {"reference": "Patient/9"}, **r}}
    bundle = {"entry": [entry(id="e1", period={"start": "2024-01-02T10:00:00Z"}), entry(period={"start": "2024-01-02"}), entry(id="e2"), entry(id="e3", period={"start": "soon"}), {"resource": {"resourceType": "Patient", "id": "p"}}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    assert [tuple(r) for r in ehr.read_fhir_bundles(spark, str(tmp_path / "b.json")).collect()] == [("e1", D(2024, 1, 2), "9")]
    (tmp_path / "e.json").write_text(json.dumps({"transaction_date": "2024-02-01", "payer_id": "P", "claims": [{"claim_id": "1", "adjudication_status": "paid", "paid_amount": 5.0}]}))
    assert ehr.read_era(spark, str(tmp_path / "e.json")).first()["payment_date"] == D(2024, 2, 1)
    spark.createDataFrame([("1", "pending"), ("2", "paid")], "claim_id string, adjudication_outcome string").write.parquet(str(tmp_path / "store"))
    (tmp_path / "era").mkdir()
    line = json.dumps({"claim_id": "1", "adjudication_status": "denied", "processed": "2024-01-01T00:00:00Z"})
    (tmp_path / "era" / "x.json").write_text(f"{line}\n{line}\n" + line.replace('"1"', '"7"') + "\n")
    run = lambda: incremental.stream_outcomes(spark, str(tmp_path / "era"), str(tmp_path / "o"), str(tmp_path / "cp")).awaitTermination(120)
    linked = lambda: sorted((r["claim_id"], r["adjudication_outcome"]) for r in incremental.linked_store(spark, str(tmp_path / "store"), str(tmp_path / "o")).collect())
    run()
    assert linked() == [("1", "denied"), ("2", "paid"), ("7", "denied")]
    (tmp_path / "era" / "y.json").write_text(line.replace("denied", "paid").replace("2024-01-01", "2024-01-03") + "\n")
    run()
    assert linked() == [("1", "paid"), ("2", "paid"), ("7", "denied")]
    assert ehr.LakeLayout("/lake/").path("raw", "2024-1-5") == "/lake/raw/year=2024/month=01/day=05"
    flagged = ehr.partial_ehr_flag(spark.createDataFrame(pd.DataFrame({"age": [1, 2], "sex": ["F", None]})))
    lacking = [c for c in ehr.STRUCTURED if c not in ("age", "sex")]
    assert [r["partial_ehr_flag"] for r in flagged.collect()] == [",".join(lacking), ",".join(["sex", *lacking])] and flagged.columns == ["age", "sex", "partial_ehr_flag"]
