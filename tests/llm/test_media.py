import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import media


def test_netpbm_kinds():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P4 3 2\n\xa0\x40").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P2 2 1 300\n7 299").dtype == np.uint16
    assert media.decode(b"P3 1 1 255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 2 1 65535\n\x01\x00\x00\x02").tolist() == [[256, 2]]
    assert media.decode(b"P6 1 1 255\nabc").tolist() == [[[97, 98, 99]]]
    for broken in (b"", b"P7 1 1 1\n", b"P5 2 2 255\nabc", b"P5 x 2 255\n", b"P5 1 1 0\na", b"BMxx"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_bmp_round_trips():
    r = np.random.default_rng(1)
    for shape in ((5, 7), (4, 4), (1, 1), (3, 9, 3), (2, 2, 3)):
        image = r.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_bmp(image)) == image).all()
        if image.ndim == 2:
            assert (media.decode(media.encode_pgm(image)) == image).all()
    data = bytearray(media.encode_bmp(r.integers(0, 256, (2, 3), dtype=np.uint8)))
    up = media.decode(bytes(data))
    data[22:26] = (-2).to_bytes(4, "little", signed=True)
    assert (media.decode(bytes(data)) == up[::-1]).all()  # rows from the top


def test_bmp_of_four_bits():
    palette = b"".join(bytes((i, i, i, 0)) for i in (0, 255, 7, 9)) + bytes(48)
    body = b"\x01\x20\x00\x00"
    u32 = lambda *xs: np.array(xs, "<i4").tobytes()
    head = b"BM" + u32(118 + 4, 0, 118) + u32(40, 3, 1) + np.array([1, 4], "<u2").tobytes() + u32(0, 4, 0, 0, 0, 0)
    assert media.decode(head + palette + body).tolist() == [[0, 255, 7]]


def slow_resize(image, height, width):
    if image.ndim == 3:
        return np.stack([slow_resize(image[..., c], height, width) for c in range(image.shape[2])], axis=2)
    h, w = image.shape
    big = np.repeat(np.repeat(image.astype(float), height, 0), width, 1)  # every cell is then whole
    return big.reshape(height, h, width, w).mean(axis=(1, 3))


def test_area_resize():
    r = np.random.default_rng(2)
    for shape, size in (((7, 5), (3, 4)), ((2, 3), (8, 9)), ((1, 64), (8, 9)), ((40, 64), (8, 9)), ((3, 3), (3, 3))):
        image = r.integers(0, 256, shape)
        assert np.allclose(media.area_resize(image, *size), slow_resize(image, *size))
    assert media.area_resize(np.zeros((0, 4)), 2, 2).tolist() == [[0, 0], [0, 0]]


def test_difference_hash():
    rising = np.tile(np.arange(90, dtype=np.uint8), (80, 1))
    assert media.difference_hash(rising) == "f" * 16
    assert media.difference_hash(rising[:, ::-1]) == "0" * 16
    assert media.difference_hash(np.full((80, 90), 5, np.uint8)) == "0" * 16
    assert media.difference_hash(np.stack([rising] * 3, axis=2)) == "f" * 16


def test_features_of_a_column(spark):
    good = media.encode_bmp(np.arange(64, dtype=np.uint8).reshape(8, 8))
    rows = spark.createDataFrame([(1, good), (2, b"junk"), (3, None)], "id int, content binary")
    got = {r.id: r.f for r in rows.select("id", media.media_features(F.col("content"), 4, 2).alias("f")).collect()}
    assert (got[1].height, got[1].channels, got[1].error) == (8, 1, None)
    assert np.load(io.BytesIO(got[1].tile)).shape == (4, 2)
    assert got[2].error and got[2].tile is None and got[3].dhash is None and got[3].error is None


def brute(text):
    raw = (text or "").encode()
    padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    if len(padded) % 192:
        kept, kind = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded, "pgm"
    else:
        lines = [padded[i : i + 192] for i in range(0, len(padded), 192)]
        body = b"".join(bytes(x for j in range(0, 192, 3) for x in line[j : j + 3][::-1]) for line in reversed(lines))
        kept, kind = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 64, len(lines), 1, 24, 0, len(body), 2835, 2835, 0, 0) + body, "bmp"
    samples = np.frombuffer(padded, np.uint8).reshape(-1, 64, 3) if kind == "bmp" else np.frombuffer(padded, np.uint8).reshape(-1, 64)
    tile = io.BytesIO()
    np.save(tile, np.clip(np.rint(np.round(slow_resize(samples, *media.TILE), 6)), 0, 255).astype(np.uint8))
    grey = np.rint(slow_resize(samples.mean(axis=2) if kind == "bmp" else samples, *media.TILE) * 256)
    bits = "".join("1" if grey[y, x] < grey[y, x + 1] else "0" for y in range(8) for x in range(8))
    feature = f"{int(bits, 2):016x}:{hashlib.sha256(tile.getvalue()).hexdigest()}"
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(kept), hashlib.sha256(kept).hexdigest(), feature, kind, tile.getvalue()


def test_texts(spark, small):
    texts = [None, "", "a", "x" * 64, "x" * 65, "é" * 100_000, "a\0b", "same", "same"]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_bytes int, feature string")
    got = {r.doc_id: r.m for r in rows.select("doc_id", media.stored_text(F.col("text"), media=True).alias("m")).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[:6] == brute(t)[:6]
        assert media.decode(got[i].media).tobytes()[: got[i].n_bytes] == (t or "").encode()
        assert np.load(io.BytesIO(got[i].tile)).shape[:2] == media.TILE
    assert got[7] == got[8]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = media.op7_media_columns(spark, small).collect()
    assert len(out) == len(docs) and {r.stored_as for r in out} == {"pgm", "bmp"}
    for r in out:
        assert tuple(r)[1:] == brute(docs[r.doc_id])
    assert media.op7_media_columns(spark, small).limit(0).count() == 0
