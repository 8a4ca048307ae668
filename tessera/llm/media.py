"""Media columns: Netpbm and BMP pictures to numpy arrays, area-resized tiles as NPY, difference hashes.

The resize averages areas by an integral image: each output sample is the mean over its exact, fractional source
rectangle. Decoders take Netpbm pictures, plain and binary (P1 to P6; 1, 8 and 16 bits; scaled to 8 bits if maxval is not
255), and uncompressed BMP of 8 bits (palette) or 24. A column's pictures become arrays, tiles and hashes; the query stores
each text as a PGM picture, or as a BMP where the text has an even number of bytes, and takes every feature from what the
decoders read back.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.frames import load, utf8

#: A payload's picture: this wide; its bytes are a multiple of TILE x TILE.
TILE = 24
TEXT_FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, tile binary, feature string"


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


_SPACE = re.compile(rb"(?:\s|#[^\n]*\n)*")
#: A picture may have so many samples; more is taken for a broken header.
MOST_SAMPLES = 1 << 31


def _numbers(raw: bytes, at: int, count: int) -> tuple[list[int], int]:
    """count whole numbers from a place on, with blanks and comments before each, and the place after the last."""
    out = []
    for _ in range(count):
        at = _SPACE.match(raw, at).end()
        found = re.compile(rb"\d+").match(raw, at)
        if not found or len(found[0]) > 9:
            raise ValueError("broken Netpbm header")
        out.append(int(found[0]))
        at = found.end()
    return out, at


def decode_netpbm(raw: bytes) -> np.ndarray:
    """(h, w) for P1, P2, P4 and P5, (h, w, 3) for P3 and P6, as 8 bits; black is 0. ValueError for anything else."""
    kind = raw[1:2]
    if raw[:1] != b"P" or kind not in (b"1", b"2", b"3", b"4", b"5", b"6"):
        raise ValueError("not a Netpbm picture of P1 to P6")
    bits, depth = kind in b"14", 3 if kind in b"36" else 1
    (w, h, *top), at = _numbers(raw, 2, 2 if bits else 3)
    top = top[0] if top else 1
    if not w or not h or not 0 < top < 65536 or w * h * depth > MOST_SAMPLES:
        raise ValueError("Netpbm picture without samples, or of an unknown range")
    count, shape = w * h * depth, (h, w, 3) if depth == 3 else (h, w)
    if kind in b"123":
        body = re.sub(rb"#[^\n]*", b"", raw[at:])
        digits = re.findall(rb"[01]", body) if bits else body.split()
        if len(digits) < count:
            raise ValueError("cut Netpbm picture")
        flat = np.array([int(d) for d in digits[:count]], np.int64)
    elif bits:
        stride = (w + 7) // 8
        if len(raw) - at - 1 < stride * h:
            raise ValueError("cut Netpbm picture")
        flat = np.unpackbits(np.frombuffer(raw, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)[:, :w].ravel()
    else:
        size = 2 if top > 255 else 1
        if len(raw) - at - 1 < count * size:
            raise ValueError("cut Netpbm picture")
        flat = np.frombuffer(raw, ">u2" if size == 2 else np.uint8, count, at + 1)
    if bits:
        return ((1 - flat) * 255).astype(np.uint8).reshape(shape)
    if flat.max(initial=0) > top:
        raise ValueError("sample above the picture's range")
    return (flat if top == 255 else (flat.astype(np.int64) * 255 + top // 2) // top).astype(np.uint8).reshape(shape)


def encode_bmp(samples: np.ndarray) -> bytes:
    """8 bits with a grey palette for (h, w), 24 bits for (h, w, 3)."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    rows = samples[::-1] if grey else samples[::-1, :, ::-1].reshape(h, w * 3)
    rows = np.pad(rows.astype(np.uint8), ((0, 0), (0, -rows.shape[1] % 4)))
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0) + palette + rows.tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """(h, w) for 8 bits with a grey palette, else (h, w, 3). ValueError for anything else."""
    if len(raw) < 54 or raw[:2] != b"BM":
        raise ValueError("not a BMP")
    start, header, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    if packed or bits not in (8, 24) or w <= 0 or not h or w * abs(h) * 3 > MOST_SAMPLES:
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    if header < 40 or start < 14 + header or len(raw) < start + stride * abs(h):
        raise ValueError("cut BMP")
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows.reshape(abs(h), w, 3)[:, :, ::-1]
    palette = np.frombuffer(raw, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)[:256, :3]
    if rows.max(initial=0) >= len(palette):
        raise ValueError("sample outside the BMP's palette")
    used = palette[rows]
    return used[:, :, 0] if (palette[:, :1] == palette).all() else used[:, :, ::-1]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def _cumulative(x: np.ndarray, out: int) -> np.ndarray:
    """Sums over out equal fractional parts of the first axis."""
    total = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)))
    edge = np.arange(out + 1) * (len(x) / out)
    low = np.minimum(edge.astype(np.int64), len(x) - 1)
    part = (edge - low).reshape(-1, *[1] * (x.ndim - 1))
    return np.diff(total[low] + part * (total[low + 1] - total[low]), axis=0)


def area_resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the exact source areas: (h, w) or (h, w, channels), as float64."""
    sums = np.swapaxes(_cumulative(np.swapaxes(_cumulative(x, h), 0, 1), w), 0, 1)
    return sums / (x.shape[0] * x.shape[1] / (h * w))


def grey(x: np.ndarray) -> np.ndarray:
    return x if x.ndim == 2 else (x * np.array([299, 587, 114])).sum(axis=2) / 1000


def difference_hash(x: np.ndarray) -> str:
    """64 bits: in an 8 x 9 resize, which samples are darker than their right neighbour; 16 hex digits."""
    small = np.round(area_resize(grey(x), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(x: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, x, allow_pickle=False)
    return buffer.getvalue()


def tile_of(x: np.ndarray, side: int = TILE) -> bytes:
    """The area-resized picture as an NPY of 8-bit samples."""
    return npy(np.clip(np.rint(area_resize(x, side, side)), 0, 255).astype(np.uint8))


def decode_column(frame: DataFrame, column: str, side: int = TILE, prefix: str = "") -> DataFrame:
    """Adds width, height, tile (NPY) and dhash, their names after the prefix.

    What can't be decoded, null and empty values have nulls there and the reason in media_error. The names must be new: a
    frame that has one of them is refused, so give another prefix.
    """
    shape = [("width", pa.int32()), ("height", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("media_error", pa.string())]
    new_names = [prefix + n for n, _ in shape]
    taken = sorted(set(new_names) & set(frame.columns))
    if taken:
        raise ValueError(f"the frame has columns {taken}; give another prefix")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for raw in batch.column(batch.schema.get_field_index(column)):
                try:
                    x = decode(raw.as_py() or b"")
                    rows.append({"width": x.shape[1], "height": x.shape[0], "tile": tile_of(x, side), "dhash": difference_hash(x), "media_error": None})
                except (ValueError, IndexError, struct.error, MemoryError, OverflowError) as e:
                    rows.append({"width": None, "height": None, "tile": None, "dhash": None, "media_error": str(e) or type(e).__name__})
            new = pa.RecordBatch.from_pylist(rows, schema=pa.schema(shape))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.columns], names=[*batch.schema.names, *new_names])

    ddl = ", ".join(f"`{n}` {t}" for n, t in zip(new_names, ("int", "int", "binary", "string", "string"), strict=True))
    return frame.mapInArrow(run, StructType([*frame.schema.fields, *StructType.fromDDL(ddl).fields]))


def picture_row(text: bytes) -> tuple:
    """(n_bytes, payload_bytes, payload_sha256, tail_crc32, media, tile, feature) of a text kept as a picture."""
    unit = TILE * TILE
    payload = text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, TILE)
    media = encode_pgm(samples) if len(text) % 2 else encode_bmp(samples)
    x = decode(media)
    back, tile = x.tobytes(), tile_of(x)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), media, tile, difference_hash(x) + hashlib.sha256(tile).hexdigest()[:16]


def text_pictures(docs: DataFrame) -> DataFrame:
    """Every document's text as a picture of TILE samples a row, with what is read back from it.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media (BMP for an even number of bytes, else PGM), tile
    (NPY) and feature (the difference hash and 16 digits of the tile's SHA-256). Null texts count as empty: a picture of one
    white tile. Repeated rows give repeated results; further columns are ignored; an empty table gives no rows. Results are
    held up to 4 MB, or one document.
    """
    def run(batches):  # noqa: ANN001, ANN202
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "tile", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            rows, size = [], 0
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append((id, *picture_row(text.as_py())))
                size += rows[-1][1]
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, TEXT_FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_pictures(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
