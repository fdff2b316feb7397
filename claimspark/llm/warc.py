"""WARC archives: writing records, reading them back, and reassembling segmented ones.

Each page becomes a response record with an HTTP message in chunked transfer framing, or a revisit record that refers to
the response with the same payload. A block longer than ``segment_bytes`` is split: the first record has segment number 1,
the others are continuation records that name their origin and number, the last one also the total length. On reading,
continuations are grouped by origin, ordered by number, checked against the total length and joined to their first record;
then the chunked framing is decoded.

Archives are plain records, one after the other, in gzip files of at most ``records_per_file`` records below a folder all
executors share. A record's id is a hash of the page's id, address and payload, so rows that share an id and differ don't
meet; the page's id stands in a field of its own. To find equal payloads only ids and digests are shuffled; the responses
that others refer to are sent to the tasks up to ``send_rows``; beyond that, names are joined by digest, and pages to these
by name, so that the bodies of a popular page don't meet.

Defined results: null pages are empty payloads; payloads under ``least`` bytes are always responses; of equal payloads the
least page id is the response, and every row with that id; a null id has no field and comes back null, as a revisit where
another row with an id has its payload; if all ids are null, all are responses. Repeated rows get a record each, and are
read back as many. An empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import cut, utf8_rows

END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
RECORD = "file string, id string, page string, kind string, segment int, origin string, total long, refers string, digest string, block binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, send_rows: int = 200_000) -> DataFrame:
    """(id, name, url, payload, digest, refers): name is the record's, refers the name of the record that a revisit refers to, null for responses."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = rows.withColumn("name", F.sha2(F.concat_ws(" ", F.to_json(F.struct("id", "url")), "digest"), 256))
    answer = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "name"))).alias("first")
    first = rows.filter(F.length("payload") >= least).groupBy("digest").agg(answer, F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = cut(first.select("digest", "first"))
    refers = F.when((F.length("payload") >= least) & ~F.col("id").eqNullSafe(F.col("first.id")), F.col("first.name"))
    if first.count() <= send_rows:
        return rows.join(F.broadcast(first), "digest", "left").select("id", "name", "url", "payload", "digest", refers.alias("refers"))
    # names meet by digest, and pages only by their own names
    slim = rows.select("id", "name", "digest", F.substring("payload", 1, least).alias("payload")).join(first, "digest")
    named = slim.select(F.col("name").alias("_name"), refers.alias("refers")).filter("refers is not null").distinct()
    return rows.join(named, F.col("name") == F.col("_name"), "left").select("id", "name", "url", "payload", "digest", "refers")


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(parts[-1]) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += 2


def page_records(name: str, page: str | None, url: str, payload: bytes, digest: str, refers: str | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The WARC records of one page, each without the two line ends that follow a record."""
    urn = lambda x, *part: "<urn:sha256:" + ":".join([x, *map(str, part)]) + ">"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page is not None:
        common.append(("Page-ID", page))
    head = lambda fields: ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()
    content = ("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield head([("WARC-Type", "revisit"), ("WARC-Record-ID", urn(name)), *common, ("WARC-Refers-To", urn(refers)), profile, content, ("Content-Length", len(HTTP))]) + HTTP
        return
    block = HTTP + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        if k == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", urn(name)), *common]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", urn(name, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", urn(name))]
        fields += [("WARC-Segment-Number", k)] * (len(parts) > 1) + [("WARC-Segment-Total-Length", len(block))] * (1 < k == len(parts))
        yield head([*fields, content, ("Content-Length", len(part))]) + part


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 32_768, chunk_bytes: int = 8_192, records_per_file: int = 2_000, **options) -> None:  # noqa: ANN003
    """Writes a record for each row of pages below path. Records end in two line ends, which is the text writer's separator."""
    plan = plan_records(pages, **options).select("name", F.col("id").cast("string").alias("id"), F.coalesce("url", F.lit("")).alias("url"), "payload", "digest", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            small = [batch.column(c).to_pylist() for c in ("name", "id", "url", "digest", "refers")]
            for name, page, url, digest, refers, payload in zip(*small, utf8_rows(batch.column("payload")), strict=True):
                for record in page_records(name, page, url, payload, digest, refers, segment_bytes, chunk_bytes):
                    yield (record,)

    records = plan.mapInArrow(_batched(run, ["record"], [pa.binary()]), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path)


def _batched(run, names: list[str], kinds: list[pa.DataType], most: int = 1 << 21):  # noqa: ANN001, ANN202
    """The rows that run yields, the last value of each a bytes object, in batches of about ``most`` bytes."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in run(batches):
            held.append(row)
            size += len(row[-1])
            if size >= most:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of one archive; field names in lower case."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at} has another length than it says")
        at += 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, as RECORD."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for f, block in parse_records(content.as_py()):
                    segment, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    numbers = segment and int(segment), f.get("warc-segment-origin-id"), total and int(total)
                    yield name, f["warc-record-id"], f.get("page-id"), f["warc-type"], *numbers, f.get("warc-refers-to"), f.get("warc-payload-digest"), block

    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
    return files.mapInArrow(_batched(run, names, kinds), RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """(id, page, kind, refers, digest, blocks, total): one row a logical record, its blocks in order of segment numbers.

    Only segmented records are shuffled. Copies of a continuation are one; a gap in the numbers or a missing total shows as
    a null total, which decode() refuses.
    """
    part = F.struct("segment", "block", "total")
    later = records.filter("kind = 'continuation'").groupBy(F.col("origin").alias("of")).agg(F.array_sort(F.collect_set(part)).alias("parts"))
    first = records.filter("kind <> 'continuation'").select("id", "page", "kind", "refers", "digest", "segment", "block")
    same = ["id", "page", "kind", "refers", "digest"]
    whole = first.filter("segment is null").select(*same, F.array("block").alias("blocks"), F.length("block").cast("long").alias("total"))
    met = first.filter("segment is not null").join(later, F.col("id") == F.col("of"), "left")
    complete = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(2), F.size("parts") + 1)
    total = F.when(complete, F.element_at("parts", -1)["total"])
    blocks = F.concat(F.array("block"), F.coalesce(F.transform("parts", lambda p: p["block"]), F.array()))
    return whole.union(met.select(*same, blocks.alias("blocks"), total.alias("total")))


def decode(logical: DataFrame, with_payload: bool = False) -> DataFrame:
    """(id, page, kind, refers, payload_bytes, digest, stated[, payload]) of reassembled records; a wrong total length or framing raises."""
    schema = "id string, page string, kind string, refers string, payload_bytes long, digest string, stated string" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            sizes, digests, payloads = [], [], []
            for name, total, blocks in zip(batch.column("id").to_pylist(), batch.column("total").to_pylist(), batch.column("blocks"), strict=True):
                message = b"".join(x.as_py() for x in blocks)
                if total != len(message):
                    raise ValueError(f"{name}: {len(message)} bytes of {total}")
                head, _, body = message.partition(END.encode())
                payload = unchunk(body) if b"chunked" in head.lower() and body else body
                sizes.append(len(payload)), digests.append(hashlib.sha256(payload).hexdigest()), payloads.append(payload)
            stated = [x and x.removeprefix("sha256:") for x in batch.column("digest").to_pylist()]
            out = [*(batch.column(c) for c in ("id", "page", "kind", "refers")), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(stated, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(payloads, pa.binary())] * with_payload, names=[x.split()[0] for x in schema.split(", ")])

    return logical.mapInArrow(run, schema)


def resolve(decoded: DataFrame) -> DataFrame:
    """(page, payload_bytes, digest, record_type, refers): a revisit takes its payload's length from the response that it refers to; refers is that one's page."""
    answers = decoded.filter("kind = 'response'").select(F.col("id").alias("_id"), F.col("page").alias("_page"), F.col("digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = decoded.filter("kind = 'revisit'").join(answers, (F.col("refers") == F.col("_id")) & (F.col("stated") == F.col("_digest")), "left")
    whole = decoded.filter("kind = 'response'").select("page", "payload_bytes", "digest", F.col("kind").alias("record_type"), F.lit(None).cast("string").alias("refers"))
    return whole.union(revisits.select("page", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("digest"), F.col("kind").alias("record_type"), F.col("_page").alias("refers")))
