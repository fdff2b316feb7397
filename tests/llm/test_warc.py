import gzip
import hashlib

import pytest

from claimspark.llm import queries, warc

PAGES = "page_id long, url string, html string, id string, block binary"


def run(spark, rows, tmp_path, **options):
    pages = spark.createDataFrame(rows, PAGES)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, **options)
    return path, warc.resolve(warc.decode(warc.reassemble(warc.read_records(spark, path)))).collect()


def expected(rows):
    first = {}
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        keeper = first.get(p) if len(p) >= 100 else None
        again = keeper is not None and keeper != i
        out.append((None if i is None else str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", str(keeper) if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/\r\nX: 1", "é" * 300, "x", b"z"), (3, "http://b/", "é" * 300, "x", None), (9, None, "é" * 300, None, None), (4, "u", "short", None, None), (2, "u", "short", None, None),
    (7, "u", None, None, None), (8, "u", "", None, None), (10, "u", "WARC/1.1\r\n\r\n\r\n" * 60, None, None), (11, "u", "0\r\n\r\n" * 9000, None, None), (12, "u", "𝒳" * 50_000, None, None),
    (None, "u", "n" * 500, None, None), (None, "u", "N" * 40_000, None, None), (None, "v", "M" * 40_000, None, None), (14, "u", "q" * 50_000, None, None), (14, "u", "Q" * 50_000, None, None),
    (14, "u", "q" * 50_000, None, None), (None, "u", "q" * 50_000, None, None), (13, "u", "z" * 120, None, None), (13, "u", "z" * 120, None, None),
]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 1000, "chunk_bytes": 7}, {"segment_bytes": 64, "records_per_file": 3}, {"send_rows": 0}])
def test_round_trip(spark, tmp_path, options):
    _, out = run(spark, ROWS, tmp_path, **options)
    assert sorted((tuple(r) for r in out), key=str) == expected(ROWS)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_query_on_awkward_and_empty_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    text = lambda x: None if x is None else str(x)
    out = queries.op9_warc(spark, str(tmp_path / "sf")).collect()
    assert sorted(((text(r["page_id"]), *r[1:4], text(r["refers_to"])) for r in out), key=str) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path)[1] == []


def test_archives_are_records_with_segments_in_order(spark, tmp_path):
    path, _ = run(spark, ROWS, tmp_path, segment_bytes=20_000)
    seen = []
    for part in (tmp_path / "warc").glob("*.gz"):
        seen += [f for f, _ in warc.parse_records(part.read_bytes())]
        assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\n") or not gzip.decompress(part.read_bytes())
    later = [f for f in seen if f["warc-type"] == "continuation"]
    assert later and all(f["warc-segment-origin-id"] for f in later) and all("warc-refers-to" in f for f in seen if f["warc-type"] == "revisit")
    assert path


def test_a_lost_segment_is_refused(spark, tmp_path):
    path, _ = run(spark, ROWS, tmp_path, segment_bytes=5000)
    records = warc.read_records(spark, path).filter("segment is null or segment <> 3")
    with pytest.raises(Exception, match="bytes of"):
        warc.decode(warc.reassemble(records)).collect()


def test_broken_framing():
    for bad in (b"5\r\nabc", b"zz\r\n", b"3\r\nabcXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunk(bad)
    assert warc.unchunk(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        list(warc.parse_records(b"HTTP/1.1 200 OK\r\n\r\n"))
