"""X12 837 files to claims: delimiters, envelope checks, segments, loops and lines, rejects, and the sinks.

Segments are gathered in blocks, each begun by an HL or a CLM segment: a CLM's block is a whole claim, so its dates, diagnoses and
lines are read within its row. Providers and subscribers come before claims, or reach over blocks: the few segments that tell them
are numbered by running counts in file order, and claims find them by those numbers, so no parser state is carried.
Fields go to the loop that holds them: patient, payer and member to the subscriber loop of the claim, service dates to the line
that they stand in.

Files come in two ways. Small ones are a row each and are read where that row is, all loops included (``claims_of_files``). A huge one
is read by its terminator as line separator, so Spark splits it as it splits any text (``claims_of_segments``). Both are read as
columns in batches: what begins and ends in a batch is told there. The blocks that a batch cuts are put together by a shuffle of their
segments, each to the chunk in which its block begins (``CHUNK`` segments of a split at most), and the loops that it cuts from a few
rows for each batch, numbered over one row of totals a batch. ``assemble_claims`` does the same for segments in any order, by windows
over them: a scan in two levels, within a chunk, and over one row of totals for each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from claimspark.functions.scalars import code5, npi_ok, pad4, sex, trim0, x12_amount, x12_date, x12_units
from claimspark.plans.views import stored
from claimspark.sources.files import names, read_head

CHUNK = 50_000
SEND_ROWS = 500_000
BYTES = 1 << 22
# How long raw files are kept, and by what rule.
RETENTION = {"retention_policy": "regulatory", "retention_years": 7, "retention_rule": "HIPAA / CMS 7-year raw EDI retention", "purge_after_years": 7}
REQUIRED = ("provider_npi", "payer_id", "patient_account_number", "principal_icd10_code")
ENVELOPE = ("ISA", "GS", "ST", "SE", "GE", "IEA")
ISA_PARTS = 17  # the name and 16 elements
BLANKS = " \t\n\x0b\f\r"
BEGINS = ("HL", "CLM")  # the segments that begin a block
SEGMENTS = "file_name string, element string, terminator string, chunk long, at long, text string"
LINE = pa.struct([("revenue", pa.string()), ("code", pa.string()), ("days", pa.list_(pa.string())), ("amount", pa.string()), ("units", pa.string())])
PROVIDER = ("provider_npi", *(f"billing_provider_{c}" for c in ("street", "city", "state", "zip")))
# which segment of a subscriber's loop tells a field, the field's name and its place in the segment
SUBSCRIBER = (("PR", "payer_id", 9), ("IL", "patient_last_name", 3), ("IL", "patient_first_name", 4), ("IL", "member_id", 9), ("6P", "group_number", 2), ("DMG", "date_of_birth", 2), ("DMG", "gender", 3))
# what _read_pieces() gives: texts as they stand in the segments
READ = pa.schema([
    *((c, pa.string()) for c in ("kind", "file_name")), *((c, pa.int64()) for c in ("chunk", "pos", "run", "nth", "prov", "sub", "clm")), *((c, pa.bool_()) for c in ("prov_open", "sub_open", "within")),
    *((c, pa.string()) for c in ("account", "amount", "facility")), *((f"d{q}", pa.list_(pa.string())) for q in ("291", "292", "435", "096")), ("principal", pa.string()), ("secondary", pa.list_(pa.string())),
    ("lines", pa.list_(LINE)), *((c, pa.string()) for c in (*PROVIDER, *(c for _, c, _ in SUBSCRIBER), "element")), ("texts", pa.list_(pa.string())), *((c, pa.string()) for c in ("loop", "field", "value", "needs", "nm1")),
])
ROWS = 1 << 33  # monotonically_increasing_id() counts the rows of a partition below this


def read_edi(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_name, content) of whole files, decoded as Latin-1. Spark's reader passes over files of no bytes; those of blanks only are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "ISO-8859-1").alias("content"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, element, terminator, chunk, at, text) of huge files, a row for each segment, not trimmed; decoded as Latin-1.

    The driver reads the first 106 bytes of each file, which tell its delimiters; files that don't begin with a whole ISA segment
    are left out (read_edi() and the quarantine are for them). Then files with the same terminator are read together, split
    where Spark splits text; ``chunk`` is a split's first byte, one more for each CHUNK segments of it, and ``at`` grows within it.
    The rows are stored once, so that all who read them find the same numbers.
    """
    return stored(_segment_rows(spark, path))


def _segment_rows(spark: SparkSession, path: str) -> DataFrame:
    """read_segments(), not stored."""
    found: dict[str, list[tuple[str, str]]] = {}
    for name in names(spark, path) or [""]:
        place = f"{path}/{name}" if name else path
        head = read_head(spark, place, 106).decode("latin-1") if not name.startswith(("_", ".")) else ""
        if len(head) == 106 and head.startswith("ISA"):
            found.setdefault(head[105], []).append((place, head[3]))
    out = None
    for terminator, some in found.items():
        # lineSep is one character; the text source hands bytes on as they are
        raw = spark.read.option("lineSep", terminator).text([p for p, _ in some])
        rows = raw.select("_metadata.file_name", F.lit(terminator).alias("terminator"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("at"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("text"))
        heads = spark.createDataFrame([(p.rsplit("/", 1)[-1], e) for p, e in some], "file_name string, element string")
        chunk = F.col("chunk") + F.floor(F.col("at") % ROWS / CHUNK)
        rows = rows.join(F.broadcast(heads), "file_name").select("file_name", "element", "terminator", chunk.alias("chunk"), "at", "text")
        out = rows if out is None else out.unionAll(rows)
    return out if out is not None else spark.createDataFrame([], SEGMENTS)


def check_segments(raw: DataFrame) -> DataFrame:
    """(file_name, is_valid, segment_ref, description) of files as read_segments() gives them, by the rules of validate_envelope()."""
    rows = raw.select("file_name", "chunk", "at", "element", _bare(F.col("text")).alias("text")).filter("text <> ''").withColumn("name", _name(F.col("text")))
    parts = F.length("text") - F.length(F.call_function("translate", "text", "element", F.lit(""))) + 1
    found = [F.max((F.col("name") == n).cast("int")).alias(n) for n in ENVELOPE]
    chunks = rows.filter("name <> ''").groupBy("file_name", "chunk").agg(F.min_by(parts, F.col("at")).alias("n"), *found)
    per = chunks.groupBy("file_name").agg(F.min_by("n", "chunk").alias("n"), *(F.max(n).alias(n) for n in ENVELOPE))
    broken = lambda test, ref, text: F.when(test, F.struct(F.lit(ref).alias("ref"), F.lit(text).alias("text")))
    first = F.coalesce(broken(F.col("n") != ISA_PARTS, "ISA", "ISA has the wrong number of elements"), *(broken(F.col(n) == 0, n, f"{n} is missing") for n in ENVELOPE))
    return per.withColumn("_b", first).select("file_name", F.col("_b").isNull().alias("is_valid"), F.col("_b.ref").alias("segment_ref"), F.col("_b.text").alias("description"))


def _pieces(batches: Iterator[pa.RecordBatch], files: bool = False) -> Iterator[pa.RecordBatch]:
    """Segments to pieces: from one that begins a block to the next, or to where rows stop following each other; ``run`` numbers these
    stretches. ``whole`` are those that begin a block and end where the next begins. With ``files``, a file begins where ``at`` is 0."""
    for b in batches:
        chunk, at, begins = (b.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "at", "begins"))
        name = b.column("file_name").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        apart = (name[1:] != name[:-1]) | (chunk[1:] != chunk[:-1]) | (at[1:] != at[:-1] + 1)
        if files:
            apart |= at[1:] == 0
        filled = b.column("filled").to_numpy(zero_copy_only=False)
        run = np.cumsum(np.concatenate([np.zeros(min(len(at), 1), bool), apart]))[filled]
        kept, begins = b.filter(pa.array(filled)), begins[filled]
        if not kept.num_rows:
            continue
        starts = np.flatnonzero(begins | np.concatenate([[True], run[1:] != run[:-1]]))
        ended = np.concatenate([run[starts][1:] == run[starts][:-1], [False]])
        texts = pa.ListArray.from_arrays(pa.array(np.append(starts, kept.num_rows), pa.int32()), kept.column("text"))
        heads = [kept.column(c).take(pa.array(starts)) for c in ("file_name", "element", "chunk", "at")]
        # runs of blank rows only have no pieces
        runs = np.cumsum(np.concatenate([[False], run[starts][1:] != run[starts][:-1]]))
        yield pa.RecordBatch.from_arrays([*heads, pa.array(begins[starts] & ended), texts, pa.array(runs)], names=["file_name", "element", "chunk", "pos", "whole", "texts", "run"])


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The claims of whole files, those of some BYTES of content at once, one terminator after the other."""
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b.column("content")).to_numpy(zero_copy_only=False))
        ends = np.unique(np.append(np.flatnonzero(np.diff(sizes // BYTES)) + 1, b.num_rows))
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            files = b.slice(start, end - start)
            for terminator in pc.unique(files.column("terminator")).to_pylist():
                some = files.filter(pc.equal(files.column("terminator"), terminator))
                texts = pc.split_pattern(some.column("content"), terminator)
                starts = texts.offsets.to_numpy()
                file = np.repeat(np.arange(some.num_rows), np.diff(starts))
                at = np.arange(len(file)) - starts[file]
                columns = {"file_name": some.column("file_name").take(pa.array(file)), "element": some.column("element").take(pa.array(file)), "chunk": np.zeros(len(file), int), "at": at, "text": texts.values}
                yield from _read(pa.RecordBatch.from_pydict(columns), True)


def _read_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What CHUNK segments or a few more tell, in rows of the kinds claim, cut, fact, run and piece."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= CHUNK:
            yield from _read(_joined(held), False)
            held = []
    if sum(h.num_rows for h in held):
        yield from _read(_joined(held), False)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _read(batch: pa.RecordBatch, whole: bool) -> Iterator[pa.RecordBatch]:
    """READ rows of a batch of segments, one element separator after the other."""
    elements = pc.unique(batch.column("element")).to_pylist()
    for element in elements:
        some = batch if len(elements) == 1 else batch.filter(pc.equal(batch.column("element"), element))
        text = pc.utf8_trim(some.column("text"), BLANKS)
        names = pc.list_element(pc.split_pattern(text, element, max_splits=1), 0)
        columns = {c: some.column(c) for c in ("file_name", "element", "chunk", "at")}
        marked = {**columns, "text": text, "filled": pc.not_equal(text, ""), "begins": pc.is_in(pc.utf8_upper(pc.utf8_trim(names, " ")), pa.array(BEGINS))}
        for pieces in _pieces(iter([pa.RecordBatch.from_pydict(marked)]), whole):
            yield from _read_pieces(pieces, element, whole)


def _rows(n: int, **columns) -> pa.RecordBatch:  # noqa: ANN003
    """n rows of READ, null in all other columns."""
    of = lambda f: columns[f.name] if f.name in columns else pa.nulls(n, f.type)
    arrays = [a if isinstance(a := of(f), pa.Array) else pa.array([a] * n if isinstance(a, str) else a, f.type) for f in READ]
    return pa.RecordBatch.from_arrays(arrays, schema=READ)


def _lists(values: pa.Array, owner: np.ndarray, n: int, none: bool = False) -> pa.Array:
    """For each of n owners the list of its values, which stand in order of owner; with ``none``, null where there are no values."""
    counts = np.bincount(owner, minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(counts == 0)) if none else pa.ListArray.from_arrays(offsets, values)


def _first_of(segs: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """For each of n groups the first of segs that is in it, -1 where none is."""
    out = np.full(n, -1)
    out[group[segs][::-1]] = segs[::-1]
    return out


def _part(values: pa.Array, i: int) -> pa.Array:
    """The i-th of what colons part, null where there is none."""
    parts = pc.split_pattern(values, ":")
    there = pc.fill_null(pc.greater(pc.list_value_length(parts), i), False).to_numpy(zero_copy_only=False)
    at = np.where(there, parts.offsets.to_numpy()[:-1] + i, 0)
    return parts.values.take(pa.array(at, mask=~there))


def _read_pieces(pieces: pa.RecordBatch, element: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """READ rows of pieces, all segments at once.

    ``run`` numbers the stretches of rows that follow each other: whole files with ``whole``, else what this batch has of a file. A loop
    is told here where it begins and ends within its run. Of the others the claims are left ``open``, and what the run has of them
    is told in facts, by loop and field, with what must be known of the rows before (``needs``).
    """
    starts, run_of = pieces.column("texts").offsets.to_numpy()[:-1], pieces.column("run").to_numpy()
    split = pc.split_pattern(pieces.column("texts").values, element)
    at, count, cells = split.offsets.to_numpy()[:-1], np.diff(split.offsets.to_numpy()), split.values
    n = len(at)
    ends = np.append(starts[1:], n)
    piece = np.repeat(np.arange(len(starts)), ends - starts)
    run = run_of[piece]
    n_runs = run_of[-1] + 1
    run_start = starts[np.searchsorted(run_of, np.arange(n_runs))]

    def field(segs: np.ndarray, i: int) -> pa.Array:
        there = (segs >= 0) & (count[segs] > i)
        return pc.utf8_trim(cells.take(pa.array(np.where(there, at[segs] + i, 0), mask=~there)), " ")

    def among(values: pa.Array, *known: str) -> np.ndarray:
        return pc.is_in(values, pa.array(known, pa.string())).to_numpy(zero_copy_only=False)

    names = pc.utf8_upper(field(np.arange(n), 0)).dictionary_encode()
    codes, known = names.indices.to_numpy(), {name: i for i, name in enumerate(names.dictionary.to_pylist())}
    named = lambda *which: np.flatnonzero(np.isin(codes, [known[w] for w in which if w in known]))

    # loops: groups number them over all runs, the one that is open where a run begins as well
    nm1, clm, hl = named("NM1"), named("CLM"), named("HL")
    entity = field(nm1, 1)
    provs, subs = nm1[among(entity, "85")], hl[among(field(hl, 3), "22")]

    def loops(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The group of each segment, the first segment of each group, and its ordinal in the run."""
        begun = np.bincount(marks, minlength=n)
        group = np.cumsum(begun) + run
        firsts = np.sort(np.concatenate([run_start, marks]), kind="stable")
        # a run that begins with a mark has an empty group before it
        base = np.searchsorted(marks, run_start) + np.arange(n_runs)
        return group, firsts, np.arange(len(firsts)) - np.repeat(base, np.diff(np.append(base, len(firsts))))

    prov, prov_firsts, prov_nth = loops(provs)
    sub, sub_firsts, sub_nth = loops(subs)
    n_clm = np.cumsum(np.bincount(clm, minlength=n))
    clm_nth = n_clm - (n_clm[run_start] - np.isin(run_start, clm))[run]

    claim_piece = np.isin(starts, clm)
    complete = np.ones(len(starts), bool) if whole else pieces.column("whole").to_numpy(zero_copy_only=False)
    begun = np.isin(starts, np.concatenate([clm, hl]))
    inside, unknown = claim_piece[piece], (~begun & (not whole))[piece]

    last_nm1 = np.maximum.accumulate(np.where(np.bincount(nm1, minlength=n) > 0, np.arange(n), -1))
    after = last_nm1 >= run_start[run]
    is_prov = np.bincount(provs, minlength=n) > 0
    addressed = lambda name: (s := named(name))[after[s] & is_prov[last_nm1[s]]]
    outside = lambda segs: segs[~inside[segs] & ~unknown[segs]]
    ref, dmg = named("REF"), named("DMG")
    told = {"PR": nm1[among(entity, "PR")], "IL": nm1[among(entity, "IL", "QC")], "6P": ref[among(field(ref, 1), "6P")], "DMG": dmg}
    # the segment of each loop that tells a field, the field's name and its place in the segment
    of_prov = [(provs, "provider_npi", 9), (addressed("N3"), "billing_provider_street", 1), *((addressed("N4"), f"billing_provider_{c}", i) for i, c in ((1, "city"), (2, "state"), (3, "zip")))]
    of_sub = [(told[k], name, i) for k, name, i in SUBSCRIBER]
    found = {"prov": [(_first_of(segs, prov, len(prov_nth)), name, i) for segs, name, i in of_prov], "sub": [(_first_of(outside(segs), sub, len(sub_nth)), name, i) for segs, name, i in of_sub]}

    def open_loops(firsts: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Those that reach over an end of their run, or begin in a block that does."""
        return np.zeros(len(nth), bool) if whole else (nth == 0) | np.append(nth[1:] == 0, True) | ~complete[piece[firsts]]

    prov_open, sub_open = open_loops(prov_firsts, prov_nth), open_loops(sub_firsts, sub_nth)

    # claims that are whole
    mine = np.flatnonzero(claim_piece & complete)
    heads, k = starts[mine], len(mine)
    of_piece = np.full(len(starts), -1)
    of_piece[mine] = np.arange(k)
    of_claim = of_piece[piece]
    within = lambda segs: segs[of_claim[segs] >= 0]
    dtp, hi, sv = within(named("DTP")), within(named("HI")), within(named("SV1", "SV2"))
    q, day = field(dtp, 1), field(dtp, 3)
    dates = {}
    for kind in ("291", "292", "435", "096"):
        these = among(q, kind)
        dates[f"d{kind}"] = _lists(day.filter(pa.array(these)), of_claim[dtp[these]], k)
    # a service date stands after its line's segment, within the claim
    line = np.searchsorted(sv, dtp, side="right") - 1
    these = among(q, "472") & (line >= 0)
    these[these] = sv[line[these]] >= starts[piece[dtp[these]]]
    two = np.isin(sv, named("SV2"))
    either = lambda one, other: field(sv, one) if not two.any() else pc.if_else(pa.array(two), field(sv, other), field(sv, one))
    lines = pa.StructArray.from_arrays([
        pc.if_else(pa.array(two), pc.fill_null(field(sv, 1), ""), pa.scalar(None, pa.string())), _part(either(1, 2), 1), _lists(day.filter(pa.array(these)), line[these], len(sv)), either(2, 3), either(4, 5),
    ], fields=list(LINE))
    # diagnoses: all elements of an HI
    many = count[hi] - 1
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[hi] + 1, many)
    pairs, owner = cells.take(pa.array(place)), np.repeat(of_claim[hi], many)
    kind, code = pc.utf8_trim(_part(pairs, 0), " "), pc.utf8_trim(_part(pairs, 1), " ")
    principal = _first_of(np.flatnonzero(among(kind, "ABK", "BK")), owner, k)
    other = among(kind, "ABF", "BF", "DR")
    secondary = _lists(code.filter(pa.array(other)), owner[other], k)
    some = np.bincount(owner, minlength=k) > 0
    secondary = pa.ListArray.from_arrays(secondary.offsets, secondary.values, mask=pa.array(~some))

    row = lambda name, which: pieces.column(name).take(pa.array(which))
    key = lambda which: {"file_name": row("file_name", which), "chunk": row("chunk", which), "pos": row("pos", which), "run": row("pos", np.searchsorted(run_of, run_of[which]))}
    prov_of, sub_of = prov[ends[mine] - 1], sub[heads]
    # a loop that no segment begins tells nothing
    value = lambda segs, nth, of, i: field(np.where(nth[of] > 0, segs[of], -1), i)
    fields = {name: value(segs, prov_nth, prov_of, i) for segs, name, i in found["prov"]} | {name: value(segs, sub_nth, sub_of, i) for segs, name, i in found["sub"]}
    yield _rows(
        k, kind="claim", **key(mine), prov=prov_nth[prov_of], sub=sub_nth[sub_of], clm=clm_nth[heads], prov_open=prov_open[prov_of], sub_open=sub_open[sub_of],
        account=field(heads, 1), amount=field(heads, 2), facility=_part(field(heads, 5), 0), **dates, principal=code.take(pa.array(np.maximum(principal, 0), mask=principal < 0)), secondary=secondary,
        lines=_lists(lines, of_claim[sv], k, none=True), **fields,
    )
    if whole:
        return

    cut = np.flatnonzero(claim_piece & ~complete)
    yield _rows(len(cut), kind="cut", **key(cut), prov=prov_nth[prov[starts[cut]]], sub=sub_nth[sub[starts[cut]]], clm=clm_nth[starts[cut]])
    parts = np.flatnonzero(~complete)
    yield _rows(len(parts), kind="piece", **key(parts), element=element, texts=row("texts", parts))

    # facts: of open loops, and of the first loop what counts only if the rows before it end outside a claim, or with the provider's name
    def facts(segs: np.ndarray, nth: np.ndarray, loop: str, name: str, i: int, needs: str) -> pa.RecordBatch:
        return _rows(len(segs), kind="fact", **key(piece[segs]), nth=segs - run_start[run[segs]], **{loop: nth}, loop=loop, field=name, value=field(segs, i), needs=needs)

    for loop, nth, is_open in (("prov", prov_nth, prov_open), ("sub", sub_nth, sub_open)):
        for first, name, i in found[loop]:
            these = np.flatnonzero(is_open & (first >= 0))
            yield facts(first[these], nth[these], loop, name, i, "")
    none = np.zeros(n_runs, int)
    for name, columns in (("N3", ((1, "street"),)), ("N4", ((1, "city"), (2, "state"), (3, "zip")))):
        first = _first_of((s := named(name))[~after[s]], run, n_runs)
        for i, c in columns:
            yield facts(first[first >= 0], none[first >= 0], "prov", f"billing_provider_{c}", i, "nm1")
    for k_, name, i in SUBSCRIBER:
        first = _first_of(told[k_][unknown[told[k_]]], run, n_runs)
        yield facts(first[first >= 0], none[first >= 0], "sub", name, i, "outside")

    run_end = np.append(run_start[1:], n) - 1
    here = after[run_end]
    entities = pa.array(np.where(here, np.searchsorted(nm1, last_nm1[run_end]), 0), mask=~here)
    last_begun = np.maximum.accumulate(np.where(begun, np.arange(len(starts)), -1))[piece[run_end]]
    has = last_begun >= piece[run_start]
    yield _rows(
        n_runs, kind="run", **key(piece[run_start]), prov=prov_nth[prov[run_end]], sub=sub_nth[sub[run_end]], clm=clm_nth[run_end],
        nm1=entity.take(entities), within=pa.array(claim_piece[last_begun], mask=~has),
    )


def claims_of_files(files: DataFrame) -> DataFrame:
    """As assemble_claims(), from whole files with their delimiters: a file's loops and claims are told where its row is, without a shuffle."""
    read = files.filter("terminator is not null").select("file_name", "element", "terminator", "content").mapInArrow(_read_whole, from_arrow_schema(READ))
    return _finished(_typed(read, "clm", *PROVIDER, *(c for _, c, _ in SUBSCRIBER)).withColumn("date_of_birth", x12_date(F.col("date_of_birth"))))


def claims_of_segments(raw: DataFrame) -> DataFrame:
    """As assemble_claims(), from the rows of read_segments().

    Blocks and loops that begin and end in one batch are told in the task that reads it. Of the other blocks, two at most for each
    stretch of rows in a batch, the segments are shuffled; of the other loops, what each stretch tells of them, some rows each. What
    was before a stretch comes from a window over one row a stretch. Claims are not shuffled while these few rows can be sent to them.
    """
    # stored once: what is whole in a batch depends on where batches end
    read = stored(raw.select("file_name", "element", "chunk", "at", "text").mapInArrow(_read_split, from_arrow_schema(READ)))
    before = Window.partitionBy("file_name").orderBy("chunk", "run").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("prov", "sub", "clm")}
    carried = {**sums, "_nm1": F.last("nm1", ignorenulls=True).over(before), "_within": F.coalesce(F.last("within", ignorenulls=True).over(before), F.lit(False))}
    carry = _sent(read.filter("kind = 'run'").select("file_name", "chunk", "run", *(c.alias(name) for name, c in carried.items())))

    def placed(kind: str) -> DataFrame:
        """Rows of the kind, their loops and claims numbered within the file."""
        return read.filter(F.col("kind") == kind).join(carry, ["file_name", "chunk", "run"]).withColumns({c: F.col(c) + F.col(f"_{c}") for c in ("prov", "sub", "clm")})

    facts = placed("fact").filter("needs = '' or (needs = 'nm1' and _nm1 = '85') or (needs = 'outside' and not _within)")
    place, told = F.struct("chunk", "run", "nth"), {"prov": PROVIDER, "sub": [c for _, c, _ in SUBSCRIBER]}
    first = lambda c: F.min_by("value", F.when(F.col("field") == c, place)).alias(f"_{c}")
    loops = {loop: _sent(facts.filter((F.col("loop") == loop) & (F.col(loop) > 0)).groupBy("file_name", loop).agg(*map(first, fields))) for loop, fields in told.items()}

    whole = _typed(placed("claim"), "prov", "sub", "clm", "prov_open", "sub_open", *told["prov"], *told["sub"])
    cut = read.filter("kind = 'piece'").select("file_name", "element", "chunk", F.col("pos").alias("_at"), F.posexplode("texts").alias("_i", "_s"))
    cut = cut.select("file_name", "chunk", (F.col("_at") + F.col("_i")).alias("pos"), F.split("_s", _quoted("element")).alias("e")).withColumn("seg_id", F.upper(F.trim(F.get("e", F.lit(0)))))
    mended = stored(_contents(gathered_blocks(cut))).filter("inside").select("file_name", "chunk", "pos", "claim.*", _named().alias("_named"))
    # a provider that is named within the claim counts for it
    mended = mended.join(placed("cut").select("file_name", "chunk", "pos", "prov", "sub", "clm"), ["file_name", "chunk", "pos"]).withColumn("prov", F.col("prov") + F.col("_named"))
    rows = whole.unionByName(mended.drop("chunk", "pos", "_named").withColumns({"prov_open": F.lit(True), "sub_open": F.lit(True)}), allowMissingColumns=True)
    for loop, fields in told.items():
        rows = rows.join(loops[loop], ["file_name", loop], "left").withColumns({c: F.when(F.col(f"{loop}_open"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields})
        rows = rows.drop(loop, f"{loop}_open", *(f"_{c}" for c in fields))
    return _finished(rows.withColumn("date_of_birth", x12_date(F.col("date_of_birth"))))


def _sent(df: DataFrame) -> DataFrame:
    """df stored, and sent to the tasks that join it unless it has more than SEND_ROWS rows."""
    rows = stored(df)
    return F.broadcast(rows) if rows.count() <= SEND_ROWS else rows


def _typed(read: DataFrame, *more: str) -> DataFrame:
    """The claims of READ rows, in the columns of _claim()."""
    day = lambda days: F.array_max(F.transform(days, lambda d: x12_date(F.substring(d, 1, 8))))
    line = lambda x: F.struct(
        F.when(x["revenue"].isNotNull(), pad4(x["revenue"])).alias("revenue_code"), code5(x["code"]).alias("cpt_hcpcs_code"), day(x["days"]).alias("service_date"),
        x12_amount(x["amount"]).alias("charge_amount"), x12_units(x["units"]).alias("units_of_service"),
    )
    return read.select(
        "file_name", F.col("account").alias("patient_account_number"), x12_amount(F.col("amount")).alias("charge_amount"), F.col("facility").alias("facility_code"),
        day("d291").alias("statement_period_start"), day("d292").alias("statement_period_end"), day("d435").alias("admission_date"), day("d096").alias("discharge_date"),
        F.col("principal").alias("principal_icd10_code"), F.col("secondary").alias("secondary_icd10_codes"), F.transform("lines", line).alias("service_lines"), *more,
    )


def with_delimiters(files: DataFrame) -> DataFrame:
    """files with ``element`` and ``terminator``, null unless the content begins with a whole ISA segment."""
    # not the length of the content, which is counted character by character wherever these columns are used
    usable = F.substring("content", 1, 3).eqNullSafe("ISA") & (F.length(F.substring("content", 1, 106)) == 106)
    return files.withColumns({"element": F.when(usable, F.substring("content", 4, 1)), "terminator": F.when(usable, F.substring("content", 106, 1))})


def _quoted(c: str) -> Column:
    """The character as a pattern that matches only itself."""
    alone = F.col(c).between("0", "9") | F.col(c).between("A", "Z") | F.col(c).between("a", "z")
    return F.when(alone, F.col(c)).otherwise(F.concat(F.lit("\\"), F.col(c)))


def _bare(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def _name(text: Column) -> Column:
    """What stands before the first delimiter."""
    return F.call_function("substring_index", text, F.col("element"), F.lit(1))


def _parts() -> Column:
    return F.filter(F.transform(F.split(F.col("content"), _quoted("terminator")), _bare), lambda s: s != "")


def _has_segment(name: str) -> Column:
    """Whether content has a segment of this name: at once where one follows a terminator and has elements, else by a pattern for all forms."""
    blank, end = r"[ \t\n\x0B\f\r]*", F.concat(F.lit("("), _quoted("element"), F.lit(r"|[ \t\n\x0B\f\r]*("), _quoted("terminator"), F.lit(r"|\z))"))
    pattern = F.concat(F.lit(r"(\A|"), _quoted("terminator"), F.lit(f"){blank}{name}"), end)
    return F.when(F.contains("content", F.concat("terminator", F.lit(name), "element")), True).otherwise(F.rlike("content", pattern))


def validate_envelope(files: DataFrame) -> DataFrame:
    """with_delimiters() and is_valid, segment_ref and description of the first rule that a file breaks."""
    rows = with_delimiters(files)
    first = _bare(F.call_function("substring_index", "content", "terminator", F.lit(1)))
    first = F.when(first != "", first).otherwise(F.get(_parts(), F.lit(0)))
    broken = lambda test, ref, text: F.when(test, F.struct(F.lit(ref).alias("ref"), F.lit(text).alias("text")))
    first = F.coalesce(
        broken(F.trim(F.coalesce("content", F.lit(""))) == "", "", "empty file"),
        broken(F.substring("content", 1, 3) != "ISA", "ISA", "does not begin with ISA"),
        broken(F.length(F.substring("content", 1, 106)) < 106, "ISA", "ISA is cut short"),
        broken(F.size(F.split(first, _quoted("element"))) != ISA_PARTS, "ISA", "ISA has the wrong number of elements"),
        *(broken(~_has_segment(n), n, f"{n} is missing") for n in ENVELOPE),
    )
    return rows.withColumn("_broken", first).withColumns({"is_valid": F.col("_broken").isNull(), "segment_ref": F.col("_broken.ref"), "description": F.col("_broken.text")}).drop("_broken")


def explode_segments(files: DataFrame) -> DataFrame:
    """(file_name, chunk, pos, seg_id, e): the segments in order of chunk and pos, e their elements with the name at 0."""
    each = files.select("file_name", "element", F.posexplode(_parts()).alias("pos", "_s"))
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    return each.select("file_name", chunk, F.col("pos").cast("long").alias("pos"), F.split(F.col("_s"), _quoted("element")).alias("e")).withColumn("seg_id", F.upper(F.trim(F.get("e", F.lit(0)))))


def file_blocks(files: DataFrame) -> DataFrame:
    """(file_name, chunk, pos, segments): the blocks of whole files in order of chunk and pos, cut where the file's row is."""
    rows = files.select("file_name", _quoted("element").alias("_q"), _parts().alias("_s"))
    rows = rows.select("file_name", _split_all(F.col("_s"), F.col("_q")).alias("_s"))
    rows = rows.withColumn("_at", _starts(F.col("_s"), lambda s: s["seg_id"].isin(*BEGINS), first=True))
    # the outer form: of the inner one Spark makes filters on the array, which would cut each file anew
    each = rows.select("file_name", F.explode_outer(_slices(F.col("_s"), F.col("_at"))).alias("b")).filter("b is not null")
    return each.select("file_name", F.floor(F.col("b.at") / CHUNK).alias("chunk"), F.col("b.at").cast("long").alias("pos"), F.col("b.segments").alias("segments"))


def _split_all(texts: Column, pattern: Column) -> Column:
    """The segments of texts: seg_id and their elements e, the name at 0."""
    return F.transform(F.transform(texts, lambda s: F.split(s, pattern)), lambda e: F.struct(F.upper(F.trim(F.get(e, F.lit(0)))).alias("seg_id"), e.alias("e")))


def _starts(segments: Column, test, first: bool = False) -> Column:  # noqa: ANN001
    """Where the segments stand that pass the test, from 0; with ``first``, 0 is there in any case."""
    places = F.filter(F.transform(segments, lambda s, i: F.when(test(s) | (i == 0) if first else test(s), i)), lambda i: i.isNotNull())
    return F.when(F.size(segments) > 0, places).otherwise(F.array().cast("array<int>"))


def _slices(segments: Column, starts: Column) -> Column:
    """For each start its place and the segments from there to the next."""
    end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(segments))
    return F.transform(starts, lambda at, j: F.struct(at.alias("at"), F.slice(segments, at + 1, end(j) - at).alias("segments")))


def gathered_blocks(segments: DataFrame) -> DataFrame:
    """As file_blocks(), from the rows of explode_segments(), or those of them that claims_of_segments() shuffles.

    One row a chunk tells where its first block begins; what stands before goes to the last chunk before that begins a block. So
    a block is in one chunk, and one shuffle brings its segments together.
    """
    begins = F.col("seg_id").isin(*BEGINS)
    firsts = segments.groupBy("file_name", "chunk").agg(F.min(F.when(begins, F.col("pos"))).alias("_first"))
    before = Window.partitionBy("file_name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    home = F.coalesce(F.last(F.when(F.col("_first").isNotNull(), F.col("chunk")), ignorenulls=True).over(before), F.lit(-1).cast("long"))
    # stored, so that its size is known before the join
    homes = stored(firsts.withColumn("_home", home))
    rows = segments.join(homes, ["file_name", "chunk"]).withColumn("_home", F.when(F.col("pos") >= F.col("_first"), F.col("chunk")).otherwise(F.col("_home")))
    upto = Window.partitionBy("file_name", "_home").orderBy("chunk", "pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_block", F.sum(begins.cast("long")).over(upto))
    per = rows.groupBy("file_name", "_home", "_block").agg(F.sort_array(F.collect_list(F.struct("chunk", "pos", "seg_id", "e"))).alias("_s"))
    head = F.get("_s", F.lit(0))
    return per.select("file_name", head["chunk"].alias("chunk"), head["pos"].alias("pos"), F.transform("_s", lambda s: F.struct(s["seg_id"].alias("seg_id"), s["e"].alias("e"))).alias("segments"))


def _e(i: int, e: Column | None = None) -> Column:
    return F.trim(F.get("e" if e is None else e, F.lit(i)))


def _first(test: Column, value: Column, name: str) -> Column:
    place = F.struct("chunk", "pos", "i")
    return F.min_by(F.when(test, value), F.when(test, place)).alias(name)


def _claim() -> Column:
    """The claim of a CLM's block, from its segments and the columns of _parsed(): head, diagnoses and lines in file order."""
    segments, codes, dates, starts = F.col("segments"), F.col("_codes"), F.col("_dates"), F.col("_starts")
    head = F.get(segments, F.lit(0))["e"]
    days = lambda among, q: F.array_max(F.transform(F.filter(among, lambda s: (s["seg_id"] == "DTP") & (_e(1, s["e"]) == q)), lambda s: x12_date(F.substring(_e(3, s["e"]), 1, 8))))
    of = lambda *qs: F.filter(codes, lambda c: c["q"].isin(*qs))
    part = lambda c: F.get(F.split(c, ":"), F.lit(1))

    def line(x: Column) -> Column:
        sv = F.get(x["segments"], F.lit(0))
        of_kind = lambda one, two: F.when(sv["seg_id"] == "SV1", _e(one, sv["e"])).otherwise(_e(two, sv["e"]))
        return F.struct(
            F.when(sv["seg_id"] == "SV2", pad4(_e(1, sv["e"]))).alias("revenue_code"), code5(part(of_kind(1, 2))).alias("cpt_hcpcs_code"), days(x["segments"], "472").alias("service_date"),
            x12_amount(of_kind(2, 3)).alias("charge_amount"), x12_units(of_kind(4, 5)).alias("units_of_service"),
        )

    return F.struct(
        _e(1, head).alias("patient_account_number"), x12_amount(_e(2, head)).alias("charge_amount"), F.get(F.split(_e(5, head), ":"), F.lit(0)).alias("facility_code"),
        days(dates, "291").alias("statement_period_start"), days(dates, "292").alias("statement_period_end"), days(dates, "435").alias("admission_date"), days(dates, "096").alias("discharge_date"),
        F.get(of("ABK", "BK"), F.lit(0))["code"].alias("principal_icd10_code"), F.when(F.size(codes) > 0, F.transform(of("ABF", "BF", "DR"), lambda c: c["code"])).alias("secondary_icd10_codes"),
        F.when(F.size(starts) > 0, F.transform(_slices(segments, starts), line)).alias("service_lines"),
    )


def _parsed(blocks: DataFrame) -> DataFrame:
    """blocks with ``inside`` (of a claim), and of claims the diagnosis codes, the dates and where the lines start, each found once."""
    inside, segments = F.get("segments", F.lit(0))["seg_id"] == "CLM", F.col("segments")
    named = lambda name: F.filter(segments, lambda s: s["seg_id"] == name)
    pairs = lambda s: F.transform(F.transform(F.slice(s["e"], F.lit(2), F.size(s["e"])), lambda c: F.split(c, ":")), lambda c: F.struct(F.trim(F.get(c, F.lit(0))).alias("q"), F.trim(F.get(c, F.lit(1))).alias("code")))
    return blocks.withColumns({
        "inside": inside, "_codes": F.when(inside, F.flatten(F.transform(named("HI"), pairs))), "_dates": F.when(inside, named("DTP")),
        "_starts": F.when(inside, _starts(segments, lambda s: s["seg_id"].isin("SV1", "SV2"))),
    })


def _context(segments: Column, inside: Column) -> Column:
    """What a block tells of loops: its first segment, names with addresses, and outside of claims references and demographics."""
    told = F.filter(segments, lambda s: s["seg_id"].isin(*BEGINS, "NM1", "N3", "N4") | (~inside & s["seg_id"].isin("REF", "DMG")))
    return F.transform(told, lambda s, i: F.struct(i.alias("i"), s["seg_id"].alias("seg_id"), F.when(s["seg_id"] != "CLM", s["e"]).alias("e")))


def number_segments(context: DataFrame) -> DataFrame:
    """context (file_name, chunk, pos, i, seg_id, e) with what came before each in its file: ``prov``, ``sub`` and ``clm`` (how many such
    loops have begun) and ``nm1`` (the last entity).

    Stored once, as three groupings read it.
    """
    seg = F.col("seg_id")
    marks = {"prov": (seg == "NM1") & (_e(1) == "85"), "sub": (seg == "HL") & (_e(3) == "22"), "clm": seg == "CLM"}
    upto = Window.partitionBy("file_name", "chunk").orderBy("pos", "i").rowsBetween(Window.unboundedPreceding, 0)
    counts = {c: F.sum(F.coalesce(test.cast("long"), F.lit(0))).over(upto) for c, test in marks.items()}
    rows = stored(context.withColumns({**counts, "nm1": F.last(F.when(seg == "NM1", _e(1)), ignorenulls=True).over(upto)}))

    # one row a chunk: what it adds, and from all before it what it starts with
    totals = rows.groupBy("file_name", "chunk").agg(*(F.max(c).alias(f"_{c}") for c in counts), F.max_by("nm1", F.struct("pos", "i")).alias("_nm1"))
    before = Window.partitionBy("file_name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = {**{f"_{c}": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in counts}, "_nm1": F.last("_nm1", ignorenulls=True).over(before)}
    # chunks that begin a file need nothing
    carry = totals.select("file_name", "chunk", *(c.alias(name) for name, c in carried.items())).filter("_prov > 0 or _sub > 0 or _clm > 0 or _nm1 is not null")
    met = rows.join(carry, ["file_name", "chunk"], "left")
    return stored(met.withColumns({**{c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in counts}, "nm1": F.coalesce("nm1", "_nm1")}).drop(*carried))


def assemble_claims(segments: DataFrame) -> DataFrame:
    """One row a CLM segment, with nested service lines and secondary diagnoses in file order."""
    return claims_of_blocks(gathered_blocks(segments))


def claims_of_blocks(blocks: DataFrame) -> DataFrame:
    """As assemble_claims(), from blocks."""
    # stored once, for the context and for the claims
    return _claims_of_contents(stored(_contents(blocks)))


def _contents(blocks: DataFrame, *more: str | Column) -> DataFrame:
    """(file_name, chunk, pos, inside, context, claim): what blocks tell of loops, and the claims of those that are one."""
    context, claim = _context(F.col("segments"), F.col("inside")).alias("context"), F.when(F.col("inside"), _claim()).alias("claim")
    return _parsed(blocks).select("file_name", "chunk", "pos", "inside", context, claim, *more)


def _claims_of_contents(blocks: DataFrame) -> DataFrame:
    each = blocks.select("file_name", "chunk", "pos", "inside", F.explode("context").alias("s"))
    rows = number_segments(each.select("file_name", "chunk", "pos", "inside", "s.*"))

    seg = F.col("seg_id")
    nm1 = lambda *q: (seg == "NM1") & _e(1).isin(*q)
    provider = rows.filter("prov > 0 and seg_id in ('NM1', 'N3', 'N4')").groupBy("file_name", "prov").agg(
        _first(nm1("85"), _e(9), "provider_npi"), _first((seg == "N3") & (F.col("nm1") == "85"), _e(1), "billing_provider_street"),
        *(_first((seg == "N4") & (F.col("nm1") == "85"), _e(i), f"billing_provider_{n}") for i, n in ((1, "city"), (2, "state"), (3, "zip"))),
    )
    subscriber = rows.filter("sub > 0 and not inside").groupBy("file_name", "sub").agg(
        _first(nm1("PR"), _e(9), "payer_id"), _first(nm1("IL", "QC"), _e(3), "patient_last_name"), _first(nm1("IL", "QC"), _e(4), "patient_first_name"), _first(nm1("IL", "QC"), _e(9), "member_id"),
        _first((seg == "REF") & (_e(1) == "6P"), _e(2), "group_number"), _first(seg == "DMG", x12_date(_e(2)), "date_of_birth"), _first(seg == "DMG", _e(3), "gender"),
    )
    loops = rows.filter("seg_id = 'CLM'").select("file_name", "chunk", "pos", "prov", "sub", "clm")
    # a provider that is named within the claim counts for it
    heads = blocks.filter("inside").select("file_name", "chunk", "pos", "claim.*", _named().alias("_named"))
    out = heads.join(loops, ["file_name", "chunk", "pos"]).withColumn("prov", F.col("prov") + F.col("_named")).drop("_named", "chunk", "pos")
    return _finished(out.join(provider, ["file_name", "prov"], "left").join(subscriber, ["file_name", "sub"], "left").drop("prov", "sub"))


def _named() -> Column:
    """How many providers a block names."""
    return F.size(F.filter("context", lambda s: (s["seg_id"] == "NM1") & (_e(1, s["e"]) == "85"))).cast("long")


def _finished(out: DataFrame) -> DataFrame:
    """Claims with their id, type and required fields."""
    out = out.withColumns({c: trim0(F.col(c)) for c in ("provider_npi", "payer_id", "patient_account_number", "principal_icd10_code")})
    kind = F.when(F.col("facility_code").rlike("^[0-9]{2}$"), "institutional").otherwise("professional")
    return out.withColumns({"claim_id": F.concat_ws("#", "file_name", "clm"), "gender": sex(F.col("gender")), "claim_type": kind}).drop("clm", "facility_code")


def split_required(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with all required fields, a reject row for each missing field of the others)."""
    fine = lambda c: npi_ok(F.col(c)) if c == "provider_npi" else F.coalesce(F.col(c) != "", F.lit(False))
    missing = F.array_compact(F.array(*(F.when(~fine(c), F.lit(c)) for c in REQUIRED)))
    rows = claims.withColumn("_missing", missing)
    rejects = rows.select("file_name", F.lit("MISSING_REQUIRED_FIELD").alias("error_type"), F.lit("CLM").alias("segment_ref"), F.explode("_missing").alias("field_name"), F.col("claim_id").alias("claim_segment_ref"))
    return rows.filter(F.size("_missing") == 0).drop("_missing"), rejects


def ingest_edi(spark: SparkSession, path: str, out: str, ingestion_date: str, glob: str = "*") -> dict[str, str]:
    """Reads all files below path and writes raw, parsed, quarantine and rejects below out. Once more the same day, it replaces what it wrote."""
    return ingest_files(read_edi(spark, path, glob), out, ingestion_date, hashlib.md5(f"{path}|{glob}".encode()).hexdigest()[:12])


def ingest_files(files: DataFrame, out: str, ingestion_date: str, batch: str) -> dict[str, str]:
    """The four sinks, partitioned by date and batch; a batch that is tried again replaces its own partitions and no others."""
    paths = {k: f"{out}/{k}" for k in ("raw", "parsed", "quarantine", "rejects")}
    # the sink's own rows are what is checked and read, so that contents are stored once
    checked = validate_envelope(_raw_sink(files.select("file_name", "content"), paths["raw"], ingestion_date, batch))
    invalid = checked.filter("not is_valid").select("file_name", "content", "segment_ref", "description")
    _write_sinks(_writer(paths, ingestion_date, batch), invalid, claims_of_files(checked.filter("is_valid")))
    return paths


def ingest_huge(spark: SparkSession, path: str, out: str, ingestion_date: str) -> dict[str, str]:
    """As ingest_edi(), for files that are split: the raw sink has a row for each segment, and the quarantine no content."""
    batch = hashlib.md5(path.encode()).hexdigest()[:12]
    paths = {"raw": f"{out}/raw_segments", **{k: f"{out}/{k}" for k in ("parsed", "quarantine", "rejects")}}
    raw = _raw_sink(_segment_rows(spark, path), paths["raw"], ingestion_date, batch)
    checked = stored(check_segments(raw))
    invalid = checked.filter("not is_valid").select("file_name", F.lit(None).cast("string").alias("content"), "segment_ref", "description")
    valid = raw.join(F.broadcast(checked.filter("is_valid").select("file_name")), "file_name", "left_semi")
    _write_sinks(_writer(paths, ingestion_date, batch), invalid, claims_of_segments(valid))
    return paths


def _raw_sink(rows: DataFrame, path: str, ingestion_date: str, batch: str) -> DataFrame:
    """rows as the raw sink has them, which is the batch's own folder, replaced whole."""
    folder = f"{path}/ingestion_date={ingestion_date}/batch=b{batch}"
    _kept(rows).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _kept(raw: DataFrame) -> DataFrame:
    """raw with how long it is kept, and since when."""
    return raw.withColumns({**{name: F.lit(value) for name, value in RETENTION.items()}, "ingestion_ts": F.current_timestamp()})


def _writer(paths: dict[str, str], ingestion_date: str, batch: str) -> Callable[..., None]:
    dated = {"ingestion_date": F.lit(ingestion_date).cast("date"), "batch": F.lit(f"b{batch}")}

    def write(df: DataFrame, kind: str, form: str = "parquet") -> None:
        packed = {"compression": "zstd" if form == "parquet" else "gzip"}
        df.withColumns(dated).write.mode("overwrite").options(partitionOverwriteMode="dynamic", **packed).partitionBy(*dated).format(form).save(paths[kind])

    return write


def _write_sinks(write: Callable[..., None], invalid: DataFrame, claims: DataFrame) -> None:
    """The quarantine, the parsed claims and the rejects."""
    write(invalid, "quarantine")
    good, missing = split_required(claims)
    write(good, "parsed")
    none = F.lit(None).cast("string")
    bad = invalid.select("file_name", F.lit("INVALID_ENVELOPE").alias("error_type"), "segment_ref", none.alias("field_name"), none.alias("claim_segment_ref"))
    write(bad.unionByName(missing).withColumn("failure_timestamp", F.current_timestamp()), "rejects", "json")
