"""The stored table of claims, and the streams that write in batches: what is read back, what is left alone, what a crash does."""

import datetime
import json
import os
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimspark.operators import features
from claimspark.sources import edi, ehr, files
from claimspark.sources.store import ClaimStore, StoreConflictError
from claimspark.streaming import incremental

from .test_fixtures import claim_file

ROWS = [(f"C{i}", "Active" if i % 3 == 0 else None if i % 3 == 1 else "", i) for i in range(200)]
SCHEMA = "claim_id string, claim_status string, n int"


def contents(store):
    return sorted(map(tuple, store.rows().collect()), key=str)


def data_files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_merges_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    store = ClaimStore.create(spark.createDataFrame([*ROWS, (None, "Active", 1)], SCHEMA), path, buckets=8)
    assert contents(store) == sorted(ROWS, key=str)
    before = data_files(path)
    new = spark.createDataFrame([("C5", "Active", -5), ("X1", "Active", 7), (None, None, 1)], SCHEMA)
    store.upsert(new)
    want = {r[0]: r for r in ROWS} | {"C5": ("C5", "Active", -5), "X1": ("X1", "Active", 7)}
    assert contents(store) == sorted(want.values(), key=str)
    touched = {r[0] for r in new.filter("claim_id is not null").select(F.pmod(F.xxhash64("claim_id"), F.lit(8))).collect()}
    used = {str(Path(f.removeprefix("file://")).relative_to(path)) for f in store.rows().inputFiles()}
    assert {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched} == used & before  # untouched files keep their names
    store.delete(spark.createDataFrame([("C5",), ("C6",), ("nobody",), (None,)], "claim_id string"))
    del want["C5"], want["C6"]
    assert contents(store) == sorted(want.values(), key=str)
    store.upsert(spark.createDataFrame([("C7", 0.5), ("Z", 0.1)], "claim_id string, predicted_denial_score double"), insert=False)
    assert {r["claim_id"]: r["predicted_denial_score"] for r in store.rows().filter("predicted_denial_score is not null").collect()} == {"C7": 0.5}
    assert store.rows().count() == len(want) and store.vacuum(keep=1) > 0
    assert contents(store) == sorted([(*r, 0.5 if r[0] == "C7" else None) for r in want.values()], key=str) and store.vacuum(keep=1) == 0


def test_a_writer_that_dies_or_is_slower_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store = ClaimStore.create(spark.createDataFrame(ROWS, SCHEMA), path, buckets=4)
    new = spark.createDataFrame([("C1", "Active", -1)], SCHEMA)

    def dies(*args):
        raise OSError("lost")

    monkeypatch.setattr(files, "create_text", dies)
    with pytest.raises(OSError, match="lost"):
        store.upsert(new)
    monkeypatch.undo()
    assert contents(store) == sorted(ROWS, key=str)
    Path(path, "log", "00000002.json").write_text('{"number": 2, "key')  # a version's file cut short
    assert contents(store) == sorted(ROWS, key=str)
    with pytest.raises(StoreConflictError):
        store.upsert(new)  # the number is taken
    os.remove(Path(path, "log", "00000002.json"))
    old = store.current()
    store.upsert(new)
    with pytest.raises(StoreConflictError):
        store._write(old, new, [0])
    assert store.rows().filter("n = -1").count() == 1 and store.rows().count() == len(ROWS)


def test_empty_tables_and_all_rows_deleted(spark, tmp_path):
    store = ClaimStore.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), buckets=4)
    assert store.rows().collect() == [] and store.get("C1").collect() == [] and store.scan().collect() == []
    store.upsert(spark.createDataFrame(ROWS[:3], SCHEMA))
    store.delete(store.rows())
    assert store.rows().collect() == [] and store.rows().columns == ["claim_id", "claim_status", "n"]
    with pytest.raises(FileNotFoundError):
        ClaimStore(spark, str(tmp_path / "none")).rows()


def read_rows(df):
    """How many rows the scans of df's plan gave, and how many files they read."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), [0, 0]
    nodes = [plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            out = [out[0] + node.metrics().apply("numOutputRows").value(), out[1] + node.metrics().apply("numFiles").value()]
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return tuple(out)


def test_get_and_scan_pass_over_files(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("concat('C', id) claim_id", "if(id % 10 = 0, 'Active', 'Closed') claim_status", "id n")
    store = ClaimStore.create(rows, str(tmp_path / "t"), buckets=8)
    total = len(data_files(tmp_path / "t"))
    assert [r["n"] for r in store.get("C777").collect()] == [777]
    n, read = read_rows(store.get("C777"))
    assert n < 8_000 and read <= 2 < total
    absent = [read_rows(store.get(f"C{i}x"))[0] for i in range(1000, 1010)]  # between the least and the greatest key
    assert absent == [0] * 10
    n, read = read_rows(store.scan("Active"))
    assert n == 4_000 and read <= total / 2


def outcomes(rows):
    return "\n".join(json.dumps({"claim_id": c, "adjudication_status": s, "processed": f"2024-01-{d:02d}T00:00:00Z"}) for c, s, d in rows) + "\n"


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_in_batches_of_any_order(spark, tmp_path, seed):
    """Two and three batches, late rows last, ties and repeats: the rows of the batch query, linked and merged."""
    draw = random.Random(seed)
    rows = [(f"C{draw.randrange(25)}", draw.choice(["paid", "denied"]), draw.randrange(1, 28)) for _ in range(120)]
    rows += rows[:20]
    if seed == 0:
        rows.sort(key=lambda r: -r[2])
    stored = spark.createDataFrame([(f"C{i}", "Active", "pending") for i in range(0, 30, 2)], "claim_id string, claim_status string, adjudication_outcome string")
    stored.write.parquet(str(tmp_path / "store"))
    table = ClaimStore.create(stored, str(tmp_path / "table"), buckets=4)
    (tmp_path / "era").mkdir()
    parts = 2 + seed % 2
    for k in range(parts):
        (tmp_path / "era" / f"{k}.json").write_text(outcomes(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]))
        incremental.stream_outcomes(spark, str(tmp_path / "era"), str(tmp_path / "o"), str(tmp_path / "cp")).awaitTermination(120)
        assert incremental.fold_outcomes(spark, table, str(tmp_path / "o")) == 1
    assert incremental.fold_outcomes(spark, table, str(tmp_path / "o")) == 0
    era = spark.read.schema(incremental.REMITTANCE).json(str(tmp_path / "era"))
    columns = ["claim_id", "claim_status", "adjudication_outcome", "adjudication_timestamp"]
    want = sorted(map(str, features.link_outcomes(stored, era).select(columns).collect()))
    assert sorted(map(str, incremental.linked_store(spark, str(tmp_path / "store"), str(tmp_path / "o")).select(columns).collect())) == want
    assert sorted(map(str, table.rows().select(columns).collect())) == want


def test_another_stream_replaces_nothing(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"era{k}").mkdir()
        (tmp_path / f"era{k}" / "x.json").write_text(outcomes([(f"C{k}", "paid", 3)]))
        incremental.stream_outcomes(spark, str(tmp_path / f"era{k}"), str(tmp_path / "o"), str(tmp_path / f"cp{k}")).awaitTermination(120)
    assert sorted(r["claim_id"] for r in spark.read.parquet(f"{tmp_path}/o/stream=*/batch=*").collect()) == ["C0", "C1"]


def sinks(spark, out):
    read = lambda kind, form: sorted(str(r.asDict()) for r in spark.read.format(form).load(f"{out}/{kind}").drop("batch", "ingestion_ts", "ingestion_date", "failure_timestamp").collect())
    return [read("raw", "parquet"), read("parsed", "parquet"), read("quarantine", "parquet"), read("rejects", "json")]


def test_a_backlog_in_batches_and_a_crash_between_two_sinks(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in range(10):
        text = claim_file(payer="") if i == 3 else "hello" if i == 7 else claim_file()
        (tmp_path / "in" / f"f{i}").write_bytes(text.encode("latin-1"))
    edi.ingest_edi(spark, str(tmp_path / "in"), str(tmp_path / "whole"), "2024-01-01")
    run = lambda: incremental.stream_edi(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=3)
    calls, split = [], edi.split_required

    def dies(claims):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")  # the second batch has its raw and quarantine sinks
        return split(claims)

    monkeypatch.setattr(edi, "split_required", dies)
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination(120)
    dates = sorted((tmp_path / "cp" / "claimspark" / "dates").glob("[0-9]*"))
    dates[1].write_text("2024-02-03")  # as if the first try had been on another day
    for crc in (tmp_path / "cp" / "claimspark" / "dates").glob(".*.crc"):
        crc.unlink()
    for folder in (tmp_path / "out").glob("*/ingestion_date=*/batch=*-1"):
        folder.parent.parent.joinpath("ingestion_date=2024-02-03").mkdir(exist_ok=True)
        folder.rename(folder.parent.parent / "ingestion_date=2024-02-03" / folder.name)
    run().awaitTermination(120)
    assert sinks(spark, tmp_path / "out") == sinks(spark, tmp_path / "whole")
    progress = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/progress").select("batch", "files", "quarantined", "rejects", "ingestion_date").collect()))
    assert [p[1] for p in progress] == [3, 3, 3, 1] and sum(p[2] for p in progress) == 1 and sum(p[3] for p in progress) >= 2
    assert str(progress[1][4]) == "2024-02-03"


def test_encounters_and_lake_batches_are_replaced(spark, tmp_path):
    day = lambda d: datetime.date(2024, 1, d)
    rows = lambda *x: spark.createDataFrame([(i, day(d), "p") for i, d in x], "encounter_id string, encounter_date date, patient_account_number string")
    path = str(tmp_path / "e")
    ehr.write_ehr(rows(("a", 1), ("b", 2)), path, "1")
    ehr.write_ehr(rows(("c", 2)), path, "2")
    ehr.write_ehr(rows(("a", 1), ("b", 3)), path, "1")
    assert sorted((r["encounter_id"], r["encounter_date"]) for r in spark.read.parquet(path).collect()) == [("a", day(1)), ("b", day(3)), ("c", day(2))]
    lake = ehr.LakeLayout(str(tmp_path / "lake"))
    for batch in ("1", "2", "1"):
        lake.write(rows((batch, 4)).withColumn("ingestion_date", F.col("encounter_date")), "raw", batch=batch)
    assert sorted(r["encounter_id"] for r in spark.read.parquet(lake.path("raw", "2024-1-4")).collect()) == ["1", "2"]


def claims_of(rows):
    return sorted(str(r.asDict(recursive=True)) for r in rows.drop("batch", "ingestion_date").collect())


@pytest.mark.parametrize("size", [150, 400, 100_000])
def test_huge_files_give_the_rows_of_small_ones(spark, tmp_path, size):
    """The same files read whole and split at any byte, with loops that reach over many splits; other delimiters, broken envelopes."""
    many = claim_file()
    body = many[many.index("HL*") : many.index("SE*")]
    texts = {"one": many, "many": many.replace(body, body * 7), "lines": many.replace(body, body * 3).replace("*", "|").replace("~", "\n"), "noiea": many.replace("IEA*1~", ""), "nopayer": claim_file(payer=""), "latin": many.replace("DOE", "DO\xcb")}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode("latin-1"))
    whole = edi.ingest_edi(spark, str(tmp_path / "in"), str(tmp_path / "whole"), "2024-01-01")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        split = edi.ingest_huge(spark, str(tmp_path / "in"), str(tmp_path / "split"), "2024-01-01")
        chunks = edi.read_segments(spark, str(tmp_path / "in")).groupBy("file_name").agg(F.countDistinct("chunk").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (max(r["n"] for r in chunks) > 5) == (size < 1000)
    assert claims_of(spark.read.parquet(split["parsed"])) == claims_of(spark.read.parquet(whole["parsed"]))
    rejects = lambda p: claims_of(spark.read.json(p).drop("failure_timestamp"))
    assert rejects(split["rejects"]) == rejects(whole["rejects"])
    assert [(r["file_name"], r["segment_ref"]) for r in spark.read.parquet(split["quarantine"]).collect()] == [("noiea", "IEA")]


def test_huge_files_shuffle_only_blocks_that_a_batch_cuts(spark, tmp_path, monkeypatch):
    text = claim_file()
    body = text[text.index("HL*") : text.index("SE*")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text(text.replace(body, body * 100))
    shuffled, real = [], edi.gathered_blocks
    monkeypatch.setattr(edi, "gathered_blocks", lambda rows: (shuffled.append(rows.count()), real(rows))[1])
    paths = edi.ingest_huge(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-01")
    assert shuffled[0] * 20 < spark.read.parquet(paths["raw"]).count()
    assert spark.read.parquet(paths["parsed"]).count() == 100 * body.count("CLM*")


def test_claims_of_huge_files_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    """Loops cut anywhere are told by what each stretch of rows has of them; claims are joined to these without a shuffle, or with one, with the same result."""
    text = claim_file()
    body = text[text.index("HL*") : text.index("SE*")]
    more = body.replace("HL*3", "N3*9 ELSE~N4*FAR*TX*7~HL*9*3*23*0~NM1*QC*1*KID*A~HL*3").replace("LX*2", "NM1*85*2*OTHER*****XX*9999999999~N3*9 SIDE~LX*2")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text(text.replace(body, body.replace("N3*1 MAIN~", "") + body[body.index("CLM") :] * 3 + more * 2 + body))
    want = claims_of(edi.claims_of_files(edi.with_delimiters(edi.read_edi(spark, str(tmp_path / "in")))))
    assert want == claims_of(edi.assemble_claims(edi.explode_segments(edi.with_delimiters(edi.read_edi(spark, str(tmp_path / "in"))))))
    for key, value in (("files.maxPartitionBytes", 700), ("files.openCostInBytes", 1), ("autoBroadcastJoinThreshold", -1)):
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        raw = edi.read_segments(spark, str(tmp_path / "in"))
        for rows in (500_000, -1):
            monkeypatch.setattr(edi, "SEND_ROWS", rows, raising=False)
            claims = edi.claims_of_segments(raw)
            plan = claims._jdf.queryExecution().executedPlan().toString()
            assert bool(re.search(r"hashpartitioning\(file_name#\d+, (prov|sub)#", plan)) == (rows < 0)
            assert claims_of(claims) == want
    finally:
        for key in ("files.maxPartitionBytes", "files.openCostInBytes", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{key}")


def test_contents_are_stored_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text(claim_file(payer=""))
    (tmp_path / "in" / "g").write_text(claim_file())
    monkeypatch.setattr(edi, "stored", lambda df: pytest.fail("stored beside the sinks"))
    paths = edi.ingest_edi(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-01")
    assert spark.read.parquet(paths["parsed"]).count() == 3 and spark.read.json(paths["rejects"]).count() == 1
    assert not list((tmp_path / "out" / "rejects").glob("*/*/*.json")) and list((tmp_path / "out" / "rejects").glob("*/*/*.json.gz"))


def test_pieces_end_where_rows_do_not_follow():
    import pyarrow as pa

    at, begins, texts = [0, 1, 2, 3, 5, 6, 7, 8], [False, True, False, True, False, True, False, True], ["a", "B", "", "C", "d", "E", "f", "G"]
    columns = {"file_name": ["f"] * 8, "element": ["*"] * 8, "chunk": pa.array([0] * 8, pa.int64()), "at": pa.array(at, pa.int64()), "text": texts, "filled": [t != "" for t in texts], "begins": begins}
    (got,) = edi._pieces([pa.RecordBatch.from_pydict(columns), pa.RecordBatch.from_pydict(columns).slice(2, 1)])
    assert [(r["pos"], r["whole"], r["texts"]) for r in got.to_pylist()] == [(0, False, ["a"]), (1, True, ["B"]), (3, False, ["C"]), (5, False, ["d"]), (6, True, ["E", "f"]), (8, False, ["G"])]


def test_chunks_of_whole_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("f", claim_file()), ("g", claim_file(payer="") * 1)], "file_name string, content string")
    want = claims_of(edi.assemble_claims(edi.explode_segments(edi.with_delimiters(rows))))
    monkeypatch.setattr(edi, "CHUNK", 4)
    segments = edi.explode_segments(edi.with_delimiters(rows))
    assert segments.groupBy("file_name", "chunk").count().agg(F.max("count")).first()[0] == 4
    assert claims_of(edi.assemble_claims(segments)) == want


def test_streamed_remittances_are_written_once_and_compressed(spark, tmp_path, sf):
    from claimspark.plans import exchange

    calls = []
    exchange._streamed(spark, sf, str(tmp_path / "o"), lambda: calls.append(1))
    texts = [p for p in tmp_path.rglob("part-*") if p.suffix in (".txt", ".json", ".gz")]
    assert calls == [1, 1, 1] and texts and {(p.parent.name, p.suffix) for p in texts} == {("era", ".gz")}
    rows = spark.read.json(str(tmp_path / "o" / "era"))
    assert rows.count() == 2 * spark.read.parquet(f"{sf}/lineitem.parquet").count()
