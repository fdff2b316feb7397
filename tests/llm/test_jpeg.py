import hashlib
import random
import zlib

import numpy as np
import pytest

from claimspark.llm import jpeg, queries
from claimspark.llm.common import table

from .rows import awkward, empty


def padded(text):
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def test_round_trip_of_any_bytes():
    draw = random.Random(1)
    texts = [b"", b"a", b"\x80" * 200, bytes(range(256)) * 3, bytes(64), bytes([128]) * 63 + b"x", bytes([127]) + bytes([128]) * 40 + b"zz"]
    texts += [bytes(draw.choice([128, 128, 128, 97, 255, 0]) for _ in range(draw.randrange(700))) for _ in range(80)]
    texts += [draw.randbytes(draw.randrange(3000)) for _ in range(20)]
    images = [jpeg.parse(x) for x in jpeg.encode(texts)]
    for text, image, got in zip(texts, images, jpeg.decode(images), strict=True):
        assert jpeg.payload_of(image, got) == padded(text)
        assert image.width * image.height >= len(padded(text))


def test_a_plain_scan_without_restarts_and_with_colour():
    """A hand-packed image of two components: DC differences add up, and the thumbnail comes from the first only."""
    dc = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    table_ = bytes([0x00, *dc, *range(12)])
    counts, symbols, codes = jpeg._canonical({0: 2, 1: 2, 2: 3})
    head = b"\xff\xd8" + jpeg._marker(0xDB, b"\x00" + b"\x08" * 64) + jpeg._marker(0xC0, bytes([8, 0, 8, 0, 16, 2, 1, 0x11, 0, 2, 0x11, 0]))
    head += jpeg._marker(0xC4, table_) + jpeg._marker(0xC4, bytes([0x10, *counts, *symbols])) + jpeg._marker(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    end = format(codes[0], "02b")
    # DC size 2 is '010', its codes: size 0 '00', size 1 '010', size 2 '011'; values +3, then -1, then +2, then 0
    bits = "011" + "11" + end + "010" + "0" + end + "011" + "10" + end + "00" + end
    bits += "1" * (-len(bits) % 8)
    image = jpeg.parse(head + int(bits, 2).to_bytes(len(bits) // 8) + b"\xff\xd9")
    (got,) = jpeg.decode([image])
    assert got[:, :, 0].tolist() == [[3, -1], [5, -1]]
    assert jpeg.thumbnail(image, got).tolist() == [[131, 133]]


def test_bad_files_are_refused():
    (good,) = jpeg.encode([b"text"])
    for bad in (b"", b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2", 1), good[:40]):
        with pytest.raises((ValueError, IndexError)):
            jpeg.parse(bad)


def test_thumbnail_hash_of_flat_and_split_images():
    assert jpeg.thumbnail_hash(np.full((5, 9), 100)) == 0
    assert bin(jpeg.thumbnail_hash(np.vstack([np.zeros((8, 16)), np.ones((8, 16))]))).count("1") == 32


def test_query_equals_python(spark, sf, tmp_path):
    path = str(tmp_path / "sf")
    docs = awkward(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    for d, rows in ((path, docs.collect()), (sf, table(spark, sf, "documents").collect())):
        want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(t := (r["text"] or "").encode()), len(padded(t)), hashlib.sha256(padded(t)).hexdigest(), zlib.crc32(padded(t)[-64:])) for r in rows)
        out = queries.op6_media(spark, d).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    alike = {}
    for r in out:
        alike.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in alike.values())


def test_empty_table(spark):
    assert jpeg.media_features(jpeg.with_media(empty(spark))).collect() == []
