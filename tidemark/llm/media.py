"""Media columns: progressive JPEG, written and read with numpy.

A payload is stored losslessly in the unit of the format, the quantised coefficient: byte b becomes
the coefficient of magnitude category 8 whose eight additional bits are b (b for 128..255, b - 255
for 0..127). Blocks hold 63 of them as AC coefficients; chroma is subsampled two by two. The file
has a DC scan, two first AC scans for each component (spectral selection 1-5 and 6-63, with the low
bit left out) and a refining scan for each component (successive approximation).

The decoder takes any 8-bit progressive Huffman file of one or three components: it accumulates all
scans into coefficient arrays, inverse-transforms them in numpy, upsamples chroma and returns RGB.
Scans in which every coefficient has one code of one bit, as above, are read at once; others go
through a bit reader.
"""

from __future__ import annotations

import dataclasses
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import named

#: Payloads are padded with bytes 32 to a positive multiple of this.
UNIT = 192
#: Rows of MCUs that are transformed at once, to bound memory: about this many blocks.
BAND_BLOCKS = 60_000
PER_BLOCK = 63

# The zigzag order of a block's coefficients.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _transform() -> np.ndarray:
    """The 64 x 64 matrix from zigzag coefficients to a block's samples."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)
    return np.kron(c, c)[:, ZIGZAG].T.astype(np.float32)


IDCT = _transform()


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT or (UNIT if not raw else 0))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, whose code is the bit 0."""
    return _segment(0xC4, bytes([kind << 4 | number, 1, *[0] * 15, symbol]))


def _scan_head(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components)
    return _segment(0xDA, body + bytes([ss, se, ah << 4 | al]))


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes; its length is in a comment."""
    blocks = -(-len(payload) // PER_BLOCK)
    mcus = max(1, -(-blocks // 6))
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    mcus = across * down
    data = np.frombuffer(payload, np.uint8)
    grid = np.full(mcus * 6 * PER_BLOCK, 32, np.uint8)
    grid[: len(data)] = data
    grid = grid.reshape(-1, PER_BLOCK)
    parts = [(1, grid[: 4 * mcus]), (2, grid[4 * mcus : 5 * mcus]), (3, grid[5 * mcus :])]
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, 0x00),
        _table(1, 0, 0x07),
        _scan_head([1, 2, 3], 0, 0, 0, 1),
        _fill(np.zeros(6 * mcus, np.uint8)),
    ]
    for ss, se in ((1, 5), (6, 63)):
        for c, b in parts:
            out += [_scan_head([c], ss, se, 0, 1), (b[:, ss - 1 : se] >> 1).tobytes()]  # bit 0, then seven bits
    out.append(_table(1, 0, 0x00))
    for c, b in parts:
        bits = np.zeros((len(b), 64), np.uint8)  # a block ends at once, then a bit for each coefficient
        bits[:, 1:] = (b & 1) ^ (b < 128)
        out += [_scan_head([c], 1, 63, 1, 0), np.packbits(bits, axis=1).tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join(out) + b"\xff\xd9"


def _fill(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes, the last one filled up with ones."""
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


@dataclasses.dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks across and down, whole MCUs
    high: int = 0
    used_wide: int = 0  # of a scan with this component alone
    used_high: int = 0
    coefs: np.ndarray | None = None


@dataclasses.dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comments: list[bytes]


class _Bits:
    """Bits of one restart interval, most significant first; ones follow after the end."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def bit(self) -> int:
        at = self.at
        self.at = at + 1
        return self.bits[at] if at < len(self.bits) else 1

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (s := table.get((n, code))) is not None:
                return s
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _codes(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    at = 0
    while at < len(body):
        head, counts = body[at], body[at + 1 : at + 17]
        at += 17
        table, code = {}, 0
        for n, k in enumerate(counts, 1):
            for _ in range(k):
                table[n, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        yield head, table


def decode_coefficients(data: bytes) -> Image:
    """All scans of a progressive file, accumulated into each component's coefficient array."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quant, image, restart, comments = 2, {}, {}, None, 0, []
    while at + 4 <= len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                step = 128 if wide else 64
                quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + step], ">u2" if wide else np.uint8).astype(np.float32)
                k += 1 + step
        elif marker == 0xC4:
            tables.update(_codes(body))
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            image = _frame(body, quant, comments)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a progressive Huffman file")
        elif marker == 0xDA:
            n = body[0]
            chosen = [(next(c for c in image.components if c.ident == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            end = at
            while True:  # the scan ends at a marker that is neither stuffing nor a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            _scan(image, chosen, tables, restart, ss, se, approx >> 4, approx & 15, data[at:end])
            at = end
    return image


def _frame(body: bytes, quant: dict, comments: list[bytes]) -> Image:
    precision, height, width, n = struct.unpack_from(">BHHB", body)
    if precision != 8 or n not in (1, 3):
        raise ValueError("8 bits and one or three components are read")
    parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    most_h, most_v = max(c.h for c in parts), max(c.v for c in parts)
    if any(most_h % c.h or most_v % c.v for c in parts):
        raise ValueError("sampling factors whose ratio is no whole number are not read")
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    for c in parts:
        c.wide, c.high = across * c.h, down * c.v
        c.used_wide, c.used_high = -(-(-(-width * c.h // most_h)) // 8), -(-(-(-height * c.v // most_v)) // 8)
        c.coefs = np.zeros((c.high, c.wide, 64), np.int16)
    return Image(width, height, parts, quant, comments)


def _scan(image: Image, chosen: list, tables: dict, restart: int, ss: int, se: int, ah: int, al: int, raw: bytes) -> None:
    if ss and len(chosen) == 1 and not restart and _whole_scan(chosen[0][0], tables.get(0x10 | chosen[0][1] & 15), ss, se, ah, al, raw):
        return
    if not ss and not ah and all(tables.get(t >> 4) == {(1, 0): 0} for _, t in chosen):
        return  # every difference is 0
    pieces = [raw]
    if restart:
        marks = [m for m in range(0xD0, 0xD8)]
        pieces, start, k = [], 0, 0
        while (k := raw.find(b"\xff", k)) >= 0 and k + 1 < len(raw):
            if raw[k + 1] in marks:
                pieces.append(raw[start:k])
                start = k + 2
            k += 2
        pieces.append(raw[start:])
    order = list(_block_order(image, chosen))
    per = restart * (sum(c.h * c.v for c, _ in chosen) if len(chosen) > 1 else 1) if restart else len(order)
    for k, piece in enumerate(pieces):
        bits = _Bits(piece.replace(b"\xff\x00", b"\xff"))
        _interval(bits, order[k * per : (k + 1) * per], tables, ss, se, ah, al)


def _whole_scan(c: Component, table: dict | None, ss: int, se: int, ah: int, al: int, raw: bytes) -> bool:
    """Read a scan of one component at once, if each block's bits have the one form written here."""
    if c.used_wide != c.wide or c.used_high != c.high or table is None or len(table) != 1:
        return False
    (n, code), symbol = next(iter(table.items()))
    if (n, code) != (1, 0):
        return False
    data, count, band = np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8), c.wide * c.high, se - ss + 1
    flat = c.coefs.reshape(count, 64)
    if not ah and symbol == 7 and len(data) == count * band and not (data & 0x80).any():
        bits = data.astype(np.int16).reshape(count, band)
        flat[:, ss : se + 1] = np.where(bits >= 64, bits, bits - 127) << al
        return True
    if ah and symbol == 0 and (band + 1) % 8 == 0 and len(data) == count * (band + 1) // 8:
        known = flat[:, ss : se + 1]
        bits = np.unpackbits(data).reshape(count, band + 1)
        if bits[:, 0].any() or not known.all():
            return False
        known += (bits[:, 1:].astype(np.int16) << al) * np.sign(known)
        return True
    return False


def _block_order(image: Image, chosen: list) -> Iterator[tuple[int, int, np.ndarray, int]]:
    if len(chosen) == 1:
        c, t = chosen[0]
        for y in range(c.used_high):
            for x in range(c.used_wide):
                yield 0, c.ident, c.coefs[y, x], t
        return
    first = chosen[0][0]
    for my in range(first.high // first.v):
        for mx in range(first.wide // first.h):
            for k, (c, t) in enumerate(chosen):
                for y in range(c.v):
                    for x in range(c.h):
                        yield k, c.ident, c.coefs[my * c.v + y, mx * c.h + x], t


def _interval(bits: _Bits, blocks: list, tables: dict, ss: int, se: int, ah: int, al: int) -> None:
    """One restart interval by the bit reader."""
    last: dict[int, int] = {}
    run = 0  # blocks that end at once
    for _, ident, block, t in blocks:
        if not ss:
            if ah:
                block[0] |= bits.bit() << al
            else:
                last[ident] = last.get(ident, 0) + bits.signed(bits.symbol(tables[t >> 4]))
                block[0] = last[ident] << al
        elif not ah:
            if run:
                run -= 1
                continue
            k = ss
            while k <= se:
                s = bits.symbol(tables[0x10 | t & 15])
                zeros, n = s >> 4, s & 15
                if n:
                    k += zeros
                    block[k] = bits.signed(n) << al
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) - 1 + bits.take(zeros)
                    break
        else:
            run = _refine(bits, block, tables[0x10 | t & 15], ss, se, al, run)


def _refine(bits: _Bits, block: np.ndarray, table: dict, ss: int, se: int, al: int, run: int) -> int:
    one, k = 1 << al, ss

    def correct(k: int) -> None:
        if bits.bit():
            block[k] += one if block[k] > 0 else -one

    if not run:
        while k <= se:
            s = bits.symbol(table)
            zeros, n = s >> 4, s & 15
            value = 0
            if n:
                value = one if bits.bit() else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= se:
                if block[k]:
                    correct(k)
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if value and k <= se:
                block[k] = value
            k += 1
    if run:
        for j in range(k, se + 1):
            if block[j]:
                correct(j)
        run -= 1
    return run


def rgb_bands(image: Image) -> Iterator[np.ndarray]:
    """RGB tensors (rows, width, 3) of some rows of MCUs each, top to bottom."""
    parts = image.components
    most_h, most_v = max(c.h for c in parts), max(c.v for c in parts)
    rows = parts[0].high // parts[0].v
    step = max(1, BAND_BLOCKS // max(1, sum(c.wide * c.v for c in parts)))
    for top in range(0, rows, step):
        planes = []
        for c in parts:
            some = c.coefs[top * c.v : (top + step) * c.v]
            down, across = some.shape[:2]
            q = image.quant[c.quant]
            samples = (some.reshape(-1, 64) * q) @ IDCT + 128
            plane = samples.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
            if most_v > c.v:
                plane = plane.repeat(most_v // c.v, axis=0)
            if most_h > c.h:
                plane = plane.repeat(most_h // c.h, axis=1)
            planes.append(plane)
        y = np.clip(np.rint(planes[0]), 0, 255)
        if len(planes) == 1:
            rgb = np.stack([y, y, y], axis=-1)
        else:
            cb, cr = (np.clip(np.rint(p), 0, 255) - 128 for p in planes[1:])
            rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
        rgb = np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
        yield rgb[: max(0, image.height - top * 8 * most_v), : image.width]


def decode_rgb(data: bytes) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3) of a progressive file."""
    return np.concatenate(list(rgb_bands(decode_coefficients(data))))


def payload_of(image: Image) -> bytes:
    """The payload that ``encode_payload`` stored in an image's coefficients."""
    size = int(next(c for c in image.comments if c.startswith(b"payload "))[8:])
    flat = np.concatenate([c.coefs.reshape(-1, 64)[:, 1:].ravel() for c in image.components])[:size]
    return np.where(flat > 0, flat, flat + 255).astype(np.uint8).tobytes()


def to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's padded UTF-8 bytes stored as a progressive JPEG."""

    @F.pandas_udf(T.BinaryType())
    def stored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode_payload(pad(t.encode("utf-8", "surrogatepass"))))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), stored(text).alias("media"))


_READ = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("feature", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("rgb", T.BinaryType()),
])


def describe(data: bytes) -> tuple[int, str, int, str, int, int, bytes]:
    """What one stored file gives: its payload's size and digests, features of its RGB tensor, and the tensor."""
    image = decode_coefficients(data)
    payload = payload_of(image)
    sums, squares, rows = np.zeros(3, np.int64), 0, []
    for band in rgb_bands(image):
        sums += band.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        squares += int((band[..., 1].astype(np.int64) ** 2).sum())
        rows.append(band.tobytes())
    feature = f"{image.width}x{image.height}:" + ":".join(map(str, [*sums.tolist(), squares]))
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature, image.height, image.width, b"".join(rows)


def read_media(media: DataFrame) -> DataFrame:
    """Digests of the payload read back from ``media``, with the file's own, the RGB features and the
    full-resolution RGB tensor (``height, width, rgb``: row-major bytes).

    Files must not be null and must hold a payload, as ``to_media`` gives them; ``rgb_tensors`` takes
    null files and ones without a payload. Repeated rows are repeated, an empty table gives an empty one.
    """

    @F.pandas_udf(_READ)
    def read(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(f) for f in files], columns=[f.name for f in _READ])

    each = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), read("media").alias("r"))
    return each.select("doc_id", "n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32", "media_bytes", "media_sha256", "r.feature", "r.height", "r.width", "r.rgb")


def rgb_tensors(media: DataFrame) -> DataFrame:
    """``media``'s columns with ``height, width, rgb`` (row-major bytes) in place of ``media``.

    A null file gives nulls, repeated rows give repeated tensors, an empty table gives an empty one.
    Any progressive file of one or three components is read. Columns that are called height, width
    or rgb already are replaced.
    """
    kind = T.StructType(_READ.fields[4:])

    @F.pandas_udf(kind)
    def tensor(files: pd.Series) -> pd.DataFrame:
        rows = []
        for f in files:
            t = None if f is None else decode_rgb(f)
            rows.append((None, None, None) if t is None else (t.shape[0], t.shape[1], t.tobytes()))
        return pd.DataFrame(rows, columns=[f.name for f in kind]).astype({"height": "Int32", "width": "Int32"})

    others = [named(c) for c in media.columns if c not in ("media", "height", "width", "rgb")]
    whole = media.select(F.struct(F.lit(0).alias("media"), *others).alias("row"), tensor("media").alias("tensor"))
    return whole.select("row.*", "tensor.*").drop("media")


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text stored as media and read back, with its RGB tensor.

    One row for each row: a null text is empty (one unit of bytes 32), null ids stay null, equal
    texts give equal values, an empty table gives an empty one, other columns are ignored.
    """
    return read_media(to_media(docs))
