"""Media columns: baseline JPEG in numpy.

decode() parses markers, Huffman-decodes the scan and gives the quantised coefficients; thumbnails() keeps only the DC
coefficient of each luminance block. Many restart intervals, of one image or of several with the same tables, are decoded in
step: one numpy operation handles the next symbol of each. encode() writes grey images whose 8 x 8 blocks hold 64 payload
bytes each as coefficients (byte - 128, quantiser 1), so a payload comes back exactly; each block is a restart interval.

Defined results: null text is empty; an empty payload is 64 zero bytes; bytes that aren't a baseline JPEG raise ValueError
with the marker at fault (progressive and arithmetic coding, 12-bit samples). Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import utf8_rows

CHUNK = 8192  # blocks at a time: the arrays of a step stay in the cache
UNIT = 64
#: Code lengths of the encoder's tables, by symbol: DC sizes 0-8; AC (run, size) with run 0, end of block, and all others.
DC_LENGTH = {5: 1, 4: 3, 7: 3, 6: 4, 3: 5, 8: 5, 2: 6, 1: 7, 0: 7}
AC_LENGTH = {5: 1, 4: 3, 7: 3, 3: 4, 6: 5, 8: 5, 1: 7, 2: 7, 0: 7} | {run << 4 | size: 12 for run in range(1, 16) for size in range(1, 9)} | {0xF0: 12}


def _canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, int]]:
    """(number of codes of each length 1-16, symbols in order, code of each symbol)."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], code = code, code + 1
        counts[last - 1] += 1
    return counts, symbols, codes


_END, _LONG, _NONE = 1 << 10, 1 << 11, 1 << 12


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """What each 16 bits begin with: bits used, run << 5, flags, and from bit 16 on the coefficient + 2048.

    _END marks the end of a block, _NONE bits that no code has, and _LONG a value that goes beyond the 16 bits: there, the
    code's own length is what is used, and its size stands in place of the coefficient.
    """
    table, code, k, peek = np.full(1 << 16, _NONE, np.int64), 0, 0, np.arange(1 << 16)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            run, size = symbols[k] >> 4, symbols[k] & 15
            at = slice(code << (16 - length), (code + 1) << (16 - length))
            if length + size <= 16:
                value = (peek[at] >> (16 - length - size)) & ((1 << size) - 1)
                value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
                table[at] = (value + 2048) << 16 | run << 5 | length + size
            else:
                table[at] = size << 16 | run << 5 | _LONG | length
            if symbols[k] == 0:
                table[at] |= _END
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _header(n_bytes: int, wide: int, high: int) -> bytes:
    dht = b"".join(_marker(0xC4, bytes([kind, *counts, *symbols])) for kind, (counts, symbols, _) in ((0x00, _canonical(DC_LENGTH)), (0x10, _canonical(AC_LENGTH))))
    frame = struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + _marker(0xFE, b"bytes=%d" % n_bytes) + _marker(0xDB, b"\x00" + b"\x01" * 64) + _marker(0xC0, frame) + dht + _marker(0xDD, b"\x00\x01") + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _codes() -> tuple[np.ndarray, ...]:
    """(bits that each absolute value needs, DC codes, their lengths, AC codes, their lengths), by symbol."""
    size = np.zeros(257, np.int64)
    for s in range(1, 9):
        size[1 << (s - 1) : 1 << s] = s
    out = [size]
    for lengths in (DC_LENGTH, AC_LENGTH):
        code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s, c in _canonical(lengths)[2].items():
            code[s], length[s] = c, lengths[s]
        out += [code, length]
    return tuple(out)


class _Bits:
    """Bit strings of n blocks side by side: 32-bit words, word after word of all blocks."""

    def __init__(self, n: int, most: int) -> None:
        self.n, self.width = n, most // 32 + 3
        self.words, self.base, self.pos = np.zeros(n * self.width, np.uint64), np.arange(n), np.zeros(n, np.int64)

    def put(self, value: np.ndarray, length: np.ndarray) -> None:
        """Appends up to 33 bits to each."""
        at = (self.pos >> 5) * self.n
        at += self.base
        x = value << (64 - (self.pos & 31) - length).astype(np.uint64)
        self.words[at] |= x >> np.uint64(32)
        at += self.n
        self.words[at] |= x & np.uint64(0xFFFFFFFF)
        self.pos += length

    def aligned(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each block, their number), the last byte filled with ones."""
        pad = -self.pos & 7
        self.put(((1 << pad) - 1).astype(np.uint64), pad)
        raw = np.ascontiguousarray(self.words.reshape(self.width, self.n).T.astype(">u4")).view(np.uint8)
        return raw.reshape(self.n, 4 * self.width), self.pos >> 3


def _dense_bits(blocks: np.ndarray, codes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """_Bits.aligned() of blocks (bytes) without a zero coefficient after the first: two coefficients at a time."""
    size, dc, dc_len, ac, ac_len = codes
    v = np.arange(256) - 128
    s = size[np.abs(v)]
    extra = v + (v < 0) * ((1 << s) - 1)
    first, later = (dc[s] << s | extra).astype(np.uint64), (ac[s] << s | extra).astype(np.uint64)
    columns = np.ascontiguousarray(blocks.T)
    value, length = later[columns], (ac_len[s] + s)[columns]
    value[0], length[0] = first[columns[0]], (dc_len[s] + s)[columns[0]]
    both, bits = value[0::2] << length[1::2].astype(np.uint64) | value[1::2], length[0::2] + length[1::2]
    out = _Bits(len(blocks), 64 * 13 + 8)
    for k in range(32):
        out.put(both[k], bits[k])
    return out.aligned()


def _sparse_bits(blocks: np.ndarray, codes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """_Bits.aligned() of any blocks (bytes), with runs of zero coefficients and ends of blocks."""
    size, dc, dc_len, ac, ac_len = codes
    columns = np.ascontiguousarray(blocks.T).astype(np.int64) - 128
    last = np.where((columns != 0).any(axis=0), 63 - np.argmax(columns[::-1] != 0, axis=0), 0)
    out, run = _Bits(len(blocks), 64 * 20 + 8), np.zeros(len(blocks), np.int64)
    for k, v in enumerate(columns):
        s = size[np.abs(v)]
        extra = v + (v < 0) * ((1 << s) - 1)
        if k == 0:
            out.put((dc[s] << s | extra).astype(np.uint64), dc_len[s] + s)
        else:
            some = v != 0
            says = some | (run == 15) & (k < last)
            symbol = np.where(some, run << 4 | s, 0xF0)
            out.put(np.where(says, ac[symbol & 255] << s | extra, 0).astype(np.uint64), np.where(says, ac_len[symbol & 255] + s, 0))
            run = np.where(says, 0, run + 1)
    ended = last < 63
    out.put(np.where(ended, ac[0], 0).astype(np.uint64), np.where(ended, ac_len[0], 0))
    return out.aligned()


def _entropy(blocks: np.ndarray, tail: np.ndarray, codes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n x 64 bytes), each byte-aligned, stuffed and followed by FF and its ``tail``; and their lengths."""
    n, dense = len(blocks), (blocks[:, 1:] != 128).all(axis=1)
    length, rows = np.zeros(n, np.int64), []
    for mine, bits in ((np.flatnonzero(dense), _dense_bits), (np.flatnonzero(~dense), _sparse_bits)):
        if len(mine):
            raw, length[mine] = bits(blocks[mine], codes)
            rows.append((mine, raw))
    most = int(length.max())
    raw = np.zeros((n, most), np.uint8)
    for mine, part in rows:
        raw[mine, : part.shape[1]] = part[:, :most]
    data = raw[np.arange(most) < length[:, None]]
    stuffed = data == 255
    block = np.repeat(np.arange(n), length)
    at = np.arange(len(data)) + np.cumsum(stuffed) - stuffed + 2 * block
    whole = length + np.bincount(block[stuffed], minlength=n) + 2
    out = np.zeros(int(whole.sum()), np.uint8)
    out[at] = data
    end = np.cumsum(whole)
    out[end - 2], out[end - 1] = 255, tail
    return out, whole


def encode(texts: list[bytes]) -> list[bytes]:
    """A JPEG for each text that holds its bytes, and zero bytes up to a positive multiple of 64, as coefficients."""
    counts = np.array([max(1, -(-len(x) // UNIT)) for x in texts], np.int64)
    wide = [max(isqrt(n - 1) + 1, -(-n // 8191)) for n in counts.tolist()]
    high = [-(-n // w) for n, w in zip(counts.tolist(), wide, strict=True)]
    cells = np.array(wide, np.int64) * np.array(high, np.int64)
    end = np.cumsum(cells)
    blocks = np.full((int(end[-1]) if len(texts) else 0, UNIT), 128, np.uint8)  # blocks beyond the payload are blank
    for text, n, stop, all_ in zip(texts, counts.tolist(), end.tolist(), cells.tolist(), strict=True):
        flat = blocks[stop - all_ : stop - all_ + n].reshape(-1)
        flat[: len(text)] = np.frombuffer(text, np.uint8)
        flat[len(text) :] = 0
    tail = (np.arange(len(blocks)) - np.repeat(end - cells, cells)) % 8 + 0xD0
    tail[end - 1] = 0xD9
    codes = _codes()
    parts = [_entropy(blocks[i : i + CHUNK], tail[i : i + CHUNK], codes) for i in range(0, len(blocks), CHUNK)]
    scan = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, np.uint8)
    stop = np.concatenate(([0], np.cumsum(np.concatenate([y for _, y in parts])))) if parts else np.zeros(1, np.int64)
    return [_header(len(text), w, h) + scan[stop[e - c] : stop[e]].tobytes() for text, w, h, e, c in zip(texts, wide, high, end.tolist(), cells.tolist(), strict=True)]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical sampling, quantiser
    scan: list[tuple[int, int]] = field(default_factory=list)  # DC and AC table of each component
    data: bytes = b""

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        h, v = (1, 1) if len(self.parts) == 1 else (h, v)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def layout(self) -> tuple[tuple[int, bytes, bytes], ...]:
        """(component, DC table, AC table) of each block of a unit of the scan."""
        return tuple((k, self.tables[dc], self.tables[16 | ac]) for k, (p, (dc, ac)) in enumerate(zip(self.parts, self.scan, strict=True)) for _ in range(1 if len(self.parts) == 1 else p[1] * p[2]))


def parse(data: bytes) -> Image:
    """The markers of a baseline JPEG with one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at = Image(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        if kind == 0xC0:
            bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("samples aren't of 8 bits")
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"not a baseline image: marker {kind:#x}")
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.tables[body[0]], body = body[1:n], body[n:]
        elif kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xDD:
            image.restart = int.from_bytes(body[:2])
        elif kind == 0xFE:
            image.comment = body
        elif kind == 0xDA:
            if body[0] != len(image.parts):
                raise ValueError("more than one scan")
            image.scan = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            image.data = data[at + 2 + size :]
            return image
        at += 2 + size
    raise ValueError("no scan")


def _intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, start of each restart interval in them, the scan of each interval)."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    owner_end = np.cumsum([len(x) for x in scans])
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    ff, after = ff[after != 255], after[after != 255]
    drop = np.ones(len(data), bool)
    drop[ff + 1] = False
    marks = ff[after != 0]
    drop[marks] = False
    clean = data[drop]
    kept = np.concatenate(([0], np.cumsum(drop)))
    bounds = kept[marks + 2] if len(marks) else np.empty(0, np.int64)
    owner = np.searchsorted(owner_end, marks, "right")
    ends_scan = data[marks + 1] == 0xD9
    first = kept[np.concatenate(([0], owner_end[:-1]))]
    start = np.concatenate((first, bounds[~ends_scan]))
    who = np.concatenate((np.arange(len(scans)), owner[~ends_scan]))
    order = np.lexsort((start, who))
    return clean, start[order], who[order]


def _decode_units(clean: np.ndarray, start: np.ndarray, units: np.ndarray, layout: tuple[tuple[int, bytes, bytes], ...], tables: dict[bytes, np.ndarray]) -> np.ndarray:
    """Coefficients [interval, unit, block of the unit, 64] of the restart intervals that begin at ``start`` and have ``units`` units each."""
    padded = np.concatenate((clean, np.zeros(16, np.uint8)))
    n = len(padded) - 8
    window = np.empty(n, np.uint32)  # the 32 bits from each byte on
    for o in range(4):
        part = padded[o:]
        window[o::4] = part[: len(part) // 4 * 4].view(">u4")[: len(window[o::4])]
    half = np.array([0] + [1 << (s - 1) for s in range(1, 16)], np.int64)
    out = np.zeros((int(units.max()), len(layout), 64, len(start)), np.int32)
    flat, wide = out.reshape(-1), len(start)
    pos, pred = start.astype(np.int64) * 8, np.zeros((len(start), 1 + max(c for c, _, _ in layout)), np.int64)

    def peek(at: np.ndarray) -> np.ndarray:
        return (window[np.minimum(at >> 3, n - 1)] << (at & 7).astype(np.uint32)) >> np.uint32(16)

    def symbols(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of the table, coefficients) at these bits; moves ``at`` behind them."""
        entry = table[peek(at)]
        at += entry & 31
        value = (entry >> 16) - 2048
        if (entry & (_LONG | _NONE)).any():
            if (entry & _NONE).any():
                raise ValueError("no such Huffman code")
            far = np.flatnonzero(entry & _LONG)
            s = entry[far] >> 16
            bits = peek(at[far]).astype(np.int64) >> (16 - s)
            value[far] = np.where(bits < half[s], bits - (1 << s) + 1, bits)
            at[far] += s
        return entry, value

    for unit in range(int(units.max())):
        rows = np.flatnonzero(units > unit)
        for b, (c, dc, ac) in enumerate(layout):
            at = pos[rows]
            _, value = symbols(at, tables[dc])
            pred[rows, c] += value
            out[unit, b, 0, rows] = pred[rows, c]
            k, alive, table = np.ones(len(rows), np.int64), rows, tables[ac]
            base = (unit * len(layout) + b) * 64 * wide + alive
            while len(alive):
                entry, value = symbols(at, table)
                k += (entry >> 5) & 15
                ends = (entry & _END) > 0
                ended = bool(ends.any())
                if ended:
                    k[ends] = 63
                if k.max() > 63:
                    raise ValueError("a block has over 64 coefficients")
                cell = k * wide
                cell += base
                if ended:
                    value = np.where(ends, flat[cell], value)
                flat[cell] = value
                k += 1
                if k.max() > 63:
                    going = k < 64
                    done = ~going
                    pos[alive[done]] = at[done]
                    alive, at, k, base = alive[going], at[going], k[going], base[going]
    return out.transpose(3, 0, 1, 2)


def decode(images: list[Image]) -> list[np.ndarray]:
    """For each image its quantised coefficients [unit of the scan, block of the unit, 64], in zigzag order."""
    out: list[np.ndarray | None] = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        alike.setdefault((image.layout, image.restart), []).append(i)
    for (layout, restart), members in alike.items():
        clean, start, who = _intervals([images[i].data for i in members])
        total = np.array([images[i].mcus[0] * images[i].mcus[1] for i in members], np.int64)
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        units = np.minimum(restart, total[who] - nth * restart) if restart else total[who]
        keep = units > 0
        start, who, units = start[keep], who[keep], units[keep]
        if (np.bincount(who, units, len(members)) != total).any():
            raise ValueError("a scan has another number of restart intervals than it should")
        pieces, tables = [], {t: _lookup(list(t[:16]), list(t[16:])) for _, dc, ac in layout for t in (dc, ac)}
        for a in range(0, len(start), CHUNK):
            b = min(a + CHUNK, len(start))
            upto = start[b] if b < len(start) else len(clean)
            got = _decode_units(clean[start[a] : upto], start[a:b] - start[a], units[a:b], layout, tables)
            pieces.append(got[np.arange(got.shape[1]) < units[a:b, None]])
        rows, ends = np.concatenate(pieces), np.cumsum(total)
        for k, i in enumerate(members):
            out[i] = rows[ends[k] - total[k] : ends[k]]
    return out


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The luminance of each 8 x 8 block, 0-255, from its DC coefficient only."""
    wide, high = image.mcus
    _, h, v, q = image.parts[0]
    h, v = (1, 1) if len(image.parts) == 1 else (h, v)
    dc = coefficients[:, : h * v, 0] * int(image.quant[q][0])
    grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    return np.clip((grid + 4) // 8 + 128, 0, 255)[: -(-image.height // 8), : -(-image.width // 8)]


def thumbnail_hash(grey: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 cells of the thumbnail is lighter than their mean."""
    rows = np.arange(8) * grey.shape[0] // 8
    columns = np.arange(8) * grey.shape[1] // 8
    high, wide = (np.maximum(np.diff(np.append(at, n)), 1) for at, n in ((rows, grey.shape[0]), (columns, grey.shape[1])))
    cell = np.add.reduceat(np.add.reduceat(grey, rows, axis=0), columns, axis=1) / (high[:, None] * wide[None, :])
    return int("".join("1" if x else "0" for x in (cell > cell.mean()).ravel()), 2)


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The payload that encode() put into an image, its padding included."""
    n = int(image.comment.removeprefix(b"bytes="))
    return (coefficients.reshape(-1)[: max(1, -(-n // UNIT)) * UNIT] + 128).astype(np.uint8).tobytes()


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text stored as a JPEG."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _portions(list(utf8_rows(batch.column("text")))):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(encode(texts), pa.binary())], names=["id", "media"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("media", T.BinaryType())]))


def _portions(rows: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, rows) in runs of about ``most`` bytes."""
    first, size = 0, 0
    for i, x in enumerate(rows):
        size += len(x)
        if size >= most or i + 1 == len(rows):
            yield first, rows[first : i + 1]
            first, size = i + 1, 0


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """id and MEDIA of stored images: the payload read back, dimensions, and the hash of the DC-only thumbnail."""
    schema = T.StructType([media.schema["id"], *T.StructType.fromDDL(MEDIA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stored in _portions(list(utf8_rows(batch.column("media")))):
                images = [parse(x) for x in stored]
                rows = []
                for data, image, got in zip(stored, images, decode(images), strict=True):
                    payload, grey = payload_of(image, got), thumbnail(image, got)
                    rows.append((int(image.comment.removeprefix(b"bytes=")), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), sha256(data).hexdigest(), image.width, image.height, f"{image.width}x{image.height}:{thumbnail_hash(grey):016x}:{grey.mean():.3f}"))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return media.mapInArrow(run, schema)
