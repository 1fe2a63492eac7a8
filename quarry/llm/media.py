"""Media columns (operator 7): Netpbm and BMP decoded to numpy arrays, area-resized
by integral images, written as NPY tiles with difference hashes.

Edge cases: null content gives nulls from ``media_features``; content that is no
Netpbm or BMP picture, or is cut short, raises ``ValueError`` in the decoders and
gives a row with ``error`` set in ``media_features`` (nothing is dropped).  Null and
empty texts are stored as 64 zero bytes, very long ones as one tall picture; repeated
rows give equal values; an empty table gives an empty result; only the text (and the
id) is read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

#: Width of a payload picture, and the size of the tile that a difference hash needs.
PAYLOAD_WIDTH, TILE = 64, (8, 9)

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey picture (height, width) of bytes as binary PGM."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """(height, width, 3) RGB bytes as 24-bit BMP, or (height, width) with a grey palette."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    row = w * (1 if grey else 3)
    body = np.zeros((h, (row + 3) // 4 * 4), np.uint8)
    body[:, :row] = (pixels if grey else pixels[..., ::-1]).reshape(h, row)[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    offset = 54 + len(palette)
    u32 = lambda *xs: np.array(xs, "<i4").tobytes()
    head = b"BM" + u32(offset + body.size, 0, offset) + u32(40, w, h) + np.array([1, 8 if grey else 24], "<u2").tobytes() + u32(0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: (height, width) or, for colour, (height, width, 3); uint8, or uint16
    where the maximum is above 255.  Bitmaps give 0 for black and 1 for white."""
    kind, at, fields = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not Netpbm")
    digit = int(kind[1:])
    for _ in range(2 if digit in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise ValueError("Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    most = fields[2] if len(fields) > 2 else 1
    if not 1 <= most <= 65535:
        raise ValueError("Netpbm maximum")
    channels = 3 if digit in (3, 6) else 1
    n = w * h * channels
    dtype = np.uint8 if most < 256 else np.uint16
    if digit <= 3:
        text = re.sub(rb"#[^\n\r]*", b" ", data[at:])
        values = re.findall(rb"[01]", text) if digit == 1 else text.split()
        samples = np.array(values[:n], dtype="S").astype(np.int64) if values else np.zeros(0, np.int64)
    elif digit == 4:
        body = np.frombuffer(data, np.uint8, offset=at + 1)
        line = (w + 7) // 8
        if body.size < line * h:
            raise ValueError("Netpbm is cut short")
        samples = np.unpackbits(body[: line * h].reshape(h, line), axis=1)[:, :w].ravel()
    else:
        body = data[at + 1 :]
        width = 1 if most < 256 else 2
        samples = np.frombuffer(body[: n * width], np.uint8 if width == 1 else ">u2")
    if samples.size < n:
        raise ValueError("Netpbm is cut short")
    samples = (1 - samples if digit in (1, 4) else samples).astype(dtype)
    return samples.reshape((h, w, 3) if channels == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, bottom-up or top-down: grey
    (height, width) where a palette is grey, else RGB (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    i32 = lambda at: int.from_bytes(data[at : at + 4], "little", signed=True)
    offset, head, w, h, bits, packed = i32(10), i32(14), i32(18), i32(22), int.from_bytes(data[28:30], "little"), i32(30)
    if head < 40 or packed or bits not in (1, 4, 8, 24, 32) or w < 0:
        raise ValueError("BMP of an unsupported kind")
    down, h = h < 0, abs(h)
    line = (w * bits + 31) // 32 * 4
    if len(data) < offset + line * h:
        raise ValueError("BMP is cut short")
    rows = np.frombuffer(data, np.uint8, line * h, offset).reshape(h, line)
    rows = rows if down else rows[::-1]
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(h, w, bits // 8)[..., 2::-1].copy()
    used = i32(46) or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
    if bits == 8:
        index = rows[:, :w]
    else:
        each = np.unpackbits(rows, axis=1).reshape(h, -1, bits)
        index = (each @ (1 << np.arange(bits)[::-1])).astype(np.intp)[:, :w]
    grey = (palette == palette[:, :1]).all()
    return palette[index][..., 0].copy() if grey else palette[index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each target cell covers, from an integral image: its
    value at a border between pixels is interpolated, which weighs pixels cut by a
    border with the share that is inside.  float64 (height, width[, channels])."""
    h, w = image.shape[:2]
    if not h or not w:
        return np.zeros((height, width, *image.shape[2:]))
    total = np.zeros((h + 1, w + 1, *image.shape[2:]))
    np.cumsum(image, axis=0, dtype=np.float64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def along(a: np.ndarray, n: int, cells: int) -> np.ndarray:
        at = np.arange(cells + 1) * n / cells
        low = np.minimum(at.astype(int), n - 1)
        share = (at - low).reshape(-1, *[1] * (a.ndim - 1))
        return a[low] * (1 - share) + a[low + 1] * share

    rows = along(total, h, height)
    cells = along(rows.swapaxes(0, 1), w, width).swapaxes(0, 1)
    sums = cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]
    return sums / ((h / height) * (w / width))


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tile_of(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An 8-bit tile; values of pictures with another range are not scaled, but cut to it.
    Means are rounded to six digits first: halves are not left to the order of sums."""
    return np.clip(np.rint(np.round(area_resize(image, height, width), 6)), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hex digits: on an 8 x 9 grey tile, whether each cell is darker than
    the next on its right.  Colour is averaged over its channels."""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    cells = np.rint(area_resize(grey, *TILE) * 256)  # ties of equal areas are not left to rounding
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


FEATURES = "height int, width int, channels int, dhash string, tile binary, error string"


def media_features(content: Column, height: int = 64, width: int = 64) -> Column:
    """A struct for a binary column: size, difference hash, NPY tile of height x width."""

    @F.pandas_udf(FEATURES)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                try:
                    if data is None:
                        rows.append((None,) * 6)
                        continue
                    image = decode(bytes(data))
                    rows.append((*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, difference_hash(image), npy_bytes(tile_of(image, height, width)), None))
                except ValueError as e:
                    rows.append((None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["height", "width", "channels", "dhash", "tile", "error"]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    return features(content)


def padded(payload: bytes, unit: int = PAYLOAD_WIDTH) -> bytes:
    return payload + bytes(unit * max(1, -(-len(payload) // unit)) - len(payload))


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stored_as string, tile binary"


def stored_form(payload: bytes) -> bytes:
    """A padded payload as a picture of width 64: rows of colour, in a BMP, where its length
    is a multiple of three rows; else rows of grey, in a binary PGM."""
    samples = np.frombuffer(payload, np.uint8)
    if len(payload) % (3 * PAYLOAD_WIDTH) == 0:
        return encode_bmp(samples.reshape(-1, PAYLOAD_WIDTH, 3))
    return encode_pgm(samples.reshape(-1, PAYLOAD_WIDTH))


def stored_text(text: Column, media: bool = False) -> Column:
    """A struct for a text column (null: empty): its UTF-8 bytes, padded with zeros to a
    positive multiple of 64, as a picture (``stored_form``); then what the decoder reads
    back, its NPY tile, and as feature its difference hash and the tile's SHA-256.
    ``media``: the stored bytes too."""
    schema = STORED + (", media binary" if media else "")

    @F.pandas_udf(schema)
    def store(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept = stored_form(padded(raw))
                image = decode(kept)
                back = image.tobytes()
                tile = npy_bytes(tile_of(image, *TILE))
                feature = f"{difference_hash(image)}:{hashlib.sha256(tile).hexdigest()}"
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(kept), hashlib.sha256(kept).hexdigest(), feature, "bmp" if image.ndim == 3 else "pgm", tile)
                rows.append((*row, kept) if media else row)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return store(text)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", stored_text(F.col("text")).alias("m")).select("doc_id", "m.*")
