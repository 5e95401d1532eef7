"""Headers on made bytes: formats, byte orders, truncations, and frames and crops as seen."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigate.operators import regions
from lumigate.sources import headers, images


def directory(order, entries):
    mark = b"II" if order == "<" else b"MM"
    rows = b"".join(struct.pack(order + "HHI", t, k, 1) + struct.pack(order + ("HH" if k == 3 else "I"), *((v, 0) if k == 3 else (v,))) for t, k, v in entries)
    return mark + struct.pack(order + "HIH", 42, 8, len(entries)) + rows + b"\0\0\0\0"


def jpeg(w, h, turn=None, order="<", extra=b""):
    app = b""
    if turn is not None:
        body = headers.EXIF + directory(order, [(0x010F, 3, 9), (headers.ORIENTATION, 3, turn)])
        app = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00"
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 7) + b"JFIF\0" + extra + app + b"\xff\xff" + frame[1:] + b"\xff\xda\x00\x02data"


def png(w, h, turn=None, order=">"):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"crc4"
    return headers.PNG + chunk(b"IHDR", struct.pack(">II", w, h) + b"\x08\x02\0\0\0") + (chunk(b"eXIf", directory(order, [(headers.ORIENTATION, 3, turn)])) if turn else b"") + chunk(b"IDAT", b"xyz") + chunk(b"IEND", b"")


def tiff(w, h, turn, order):
    return directory(order, [(headers.WIDTH, 4, w), (headers.HEIGHT, 3, h), (headers.ORIENTATION, 3, turn)])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("turn", range(1, 9))
def test_formats_and_byte_orders(order, turn):
    for make in (jpeg, png, tiff):
        assert headers.header(make(640, 480, turn, order)) == (640, 480, turn)


def test_no_orientation_and_wrong_ones():
    assert headers.header(jpeg(3, 4)) == (3, 4, 1) == headers.header(png(3, 4))
    assert headers.header(jpeg(3, 4, 9)) == (3, 4, 1) == headers.header(jpeg(3, 4, 0))
    assert headers.header(jpeg(3, 4, 6, extra=b"\xff\xe1\x00\x08http:/")) == (3, 4, 6)
    assert headers.header(b"GIF89a") is None and headers.header(b"") is None and headers.header(None) is None


def test_truncated_and_broken_headers_do_not_fail():
    rnd = random.Random(1)
    for data in (jpeg(640, 480, 6), png(640, 480, 6), tiff(640, 480, 6, "<"), tiff(640, 480, 6, ">")):
        for n in range(len(data)):
            headers.header(data[:n])
        for _ in range(2000):
            broken = bytearray(data)
            for _ in range(rnd.randint(1, 6)):
                broken[rnd.randrange(len(broken))] = rnd.randrange(256)
            headers.header(bytes(broken))
    assert headers.header(jpeg(640, 480, 6)[:20]) == (None, None, 1)


def test_sizes_as_seen_reach_the_plan_of_regions(spark):
    data = [(1, jpeg(300, 200, 1)), (2, jpeg(300, 200, 6)), (3, png(300, 200, 8)), (4, tiff(300, 200, 3, ">")), (5, b"no image"), (6, None)]
    sizes = headers.with_sizes(spark.createDataFrame([(i, bytearray(x) if x else None) for i, x in data], "item_id long, content binary"))
    got = {r.item_id: (r.width, r.height, r.orientation) for r in sizes.collect()}
    assert got == {1: (300, 200, 1), 2: (200, 300, 6), 3: (200, 300, 8), 4: (300, 200, 3), 5: (None, None, None), 6: (None, None, None)}
    frames = sizes.where("width is not null").withColumn("anchors", F.lit(None).cast("array<struct<x: int, y: int, w: int, h: int, score: double>>"))
    boxes = {(r.item_id, r.region_key): (r.l, r.t, r.r, r.b) for r in regions.fallback_bands(frames).collect()}
    assert boxes[1, "centre"] == (50, 0, 250, 200) and boxes[2, "centre"] == (0, 50, 200, 250)


def test_pixels_are_turned_upright():
    """Against the definition of each orientation: which corner of the picture the first stored row and column are."""
    seen = np.arange(6).reshape(2, 3, 1)
    stored = {1: seen, 2: seen[:, ::-1], 3: seen[::-1, ::-1], 4: seen[::-1], 5: seen.swapaxes(0, 1), 6: np.rot90(seen, 1), 7: np.rot90(seen, 1)[:, ::-1][::-1].swapaxes(0, 1)[::-1, :], 8: np.rot90(seen, -1)}
    stored[7] = seen[::-1, ::-1].swapaxes(0, 1)
    for turn, pixels in stored.items():
        assert (headers.upright(pixels, turn) == seen).all(), turn
    assert (headers.upright(seen, None) == seen).all()


def test_crops_are_those_of_the_picture_as_seen(spark):
    seen = np.arange(60 * 80 * 3, dtype=np.uint32).reshape(60, 80, 3).astype(np.uint8)
    stored = np.rot90(seen, 1)  # held so that it must be turned clockwise: orientation 6
    rows = [(1, (stored.shape[1], stored.shape[0], bytearray(stored.tobytes())), 6), (2, (80, 60, bytearray(seen.tobytes())), None)]
    pictures = spark.createDataFrame(rows, "item_id long, image struct<width: int, height: int, data: binary>, orientation int")
    plan = spark.createDataFrame([(i, "a", 10, 5, 70, 55) for i in (1, 2)], "item_id long, region_key string, l int, t int, r int, b int")
    got = {r.item_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in images.crop_regions(pictures, plan).collect()}
    assert (got[1] == seen[5:55, 10:70]).all() and (got[2] == got[1]).all()
