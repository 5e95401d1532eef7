"""Sizes and orientations of images from their headers: JPEG, PNG and TIFF, in both byte orders, without decoding a pixel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigate.functions.text import oriented_size

# Fixed values of the formats: markers, tags and the bytes of their numbers.
PNG = b"\x89PNG\r\n\x1a\n"
EXIF = b"Exif\x00\x00"
WIDTH, HEIGHT, ORIENTATION = 0x0100, 0x0101, 0x0112
SHORT, LONG = 3, 4
FRAME_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
ALONE = frozenset(range(0xD0, 0xD8)) | {0x01}
#: Bytes of a file that a reader needs at most, where headers come first: enough for a JPEG's metadata segments.
NEEDED = 1 << 20

Header = tuple[int | None, int | None, int]


def tags(block: bytes, wanted: tuple[int, ...]) -> dict[int, int]:
    """The wanted numbers of a tag directory's first level. What lies outside the block, or isn't a short or long, is left out."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8 or struct.unpack_from(order + "H", block, 2)[0] != 42:
        return {}
    at = struct.unpack_from(order + "I", block, 4)[0]
    if at + 2 > len(block):
        return {}
    out = {}
    for k in range(struct.unpack_from(order + "H", block, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(block):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", block, entry)
        if tag in wanted and kind in (SHORT, LONG) and count == 1 and tag not in out:
            out[tag] = struct.unpack_from(order + ("H" if kind == SHORT else "I"), block, entry + 8)[0]
    return out


def _turn(found: dict[int, int]) -> int:
    value = found.get(ORIENTATION, 1)
    return value if 1 <= value <= 8 else 1


def _jpeg(data: bytes) -> Header:
    at, turn, width, height = 2, 1, None, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            break  # not a marker: the file is broken here
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        if marker in ALONE:
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body.startswith(EXIF) and turn == 1:
            turn = _turn(tags(body[len(EXIF) :], (ORIENTATION,)))
        elif marker in FRAME_MARKERS and width is None and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
        at += 2 + max(size, 2)
    return width, height, turn


def _png(data: bytes) -> Header:
    at, turn, width, height = len(PNG), 1, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) >= 8:
            width, height = struct.unpack_from(">II", body)
        elif kind == b"eXIf":
            turn = _turn(tags(body, (ORIENTATION,)))
        elif kind == b"IEND":
            break
        at += 12 + size
    return width, height, turn


def header(data: bytes | None) -> Header | None:
    """Stored width and height (null where they aren't in the data) and orientation 1 to 8; null for other formats. No bytes make it fail."""
    if not data:
        return None
    if data[:2] == b"\xff\xd8":
        return _jpeg(data)
    if data.startswith(PNG):
        return _png(data)
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        found = tags(data, (WIDTH, HEIGHT, ORIENTATION))
        return found.get(WIDTH), found.get(HEIGHT), _turn(found)
    return None


def with_sizes(files: DataFrame, content: str = "content") -> DataFrame:
    """files with width, height (as seen: turned by the orientation) and orientation; null for what is no image. The content itself isn't passed on, only read."""
    rest = [c for c in files.columns if c not in (content, "width", "height", "orientation")]
    kinds = [pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [header(x) or (None, None, None) for x in b.column("_bytes").to_pylist()]
            columns = [pa.array([f[k] for f in found], kinds[k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *columns], [*rest, "_w", "_h", "orientation"])

    keep = files.select(*rest, F.substring(content, 1, NEEDED).alias("_bytes"))
    numbers = [T.StructField(c, T.IntegerType()) for c in ("_w", "_h", "orientation")]
    rows = keep.mapInArrow(run, T.StructType([*keep.select(*rest).schema.fields, *numbers]))
    seen = oriented_size(F.col("_w"), F.col("_h"), F.col("orientation"))
    return rows.select(*rest, seen["width"].alias("width"), seen["height"].alias("height"), "orientation")


def upright(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """Rows of pixels as they are to be seen: the eight ways that a camera may have been held."""
    turn = orientation or 1
    if turn in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels
