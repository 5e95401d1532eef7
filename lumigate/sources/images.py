"""Binary files and images: inventories, decoding with a quarantine, crops, and pluggable embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.sources.headers import upright

# File suffixes of images.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif", "webp", "tif", "tiff", "heic", "heif")
#: Bytes that a picture has fewer of: Spark's image source decodes none of 10^9 bytes or more.
LONGEST = 1_000_000_000
#: Pixels of a task that makes its images itself, and bytes of crops that leave a task or reach a model at once.
TASK_BYTES, CROP_BYTES = 1 << 30, 16 << 20
#: Rows without pixels that leave a task at once.
ROWS = 1000
#: What makes the image of a row: an expression, or a function that a task calls with the row (a dict) and that gives its pixels (rows, columns, channels).
Picture = Column | Callable[[dict], np.ndarray]


class Embedder(Protocol):
    """A model: its dimension, and unit vectors for a batch of contents (bytes, or views of them that are in one piece) or texts. Built once in each worker."""

    dim: int

    def embed(self, contents: list[bytes | memoryview]) -> np.ndarray: ...

    def embed_texts(self, texts: list[str]) -> np.ndarray: ...


def scan_inventory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, mtime, size of files under folder by suffix, whatever its case. Contents aren't read unless asked for.

    Spark's file sources pass over files of no bytes, so neither this nor `decode` lists them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = F.lower(F.col("path")).rlike(r"\.(" + "|".join(suffixes) + ")$")
    return files.where(wanted).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def decode(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(images, rejects): what the image source can decode, and the paths of what it can't.

    A file is read whole by one task, and the source fails on pictures of LONGEST bytes or more. A file that is longer itself isn't read, and is a reject.
    """
    size = F.col("_metadata.file_size")
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).where(size < LONGEST)
    good = F.col("image.width") > 0
    long = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") >= LONGEST)
    why = F.lit("can't be decoded").alias("reason")
    return images.where(good), images.where(~good).select(F.col("image.origin").alias("path"), why).unionByName(long.select("path", why))


def embed_distinct(inventory: DataFrame, embedder: Callable[[], Embedder]) -> DataFrame:
    """content_hash and vector, one for each distinct content; only keys and contents of firsts reach the model."""
    once = inventory.select("content_hash", "content").dropDuplicates(["content_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for b in batches:
            yield pd.DataFrame({"content_hash": b["content_hash"], "vector": list(model.embed([bytes(c) for c in b["content"]]).astype(float))})

    return once.mapInPandas(run, "content_hash string, vector array<double>")


def embed_prompts(prompts: DataFrame, embedder: Callable[[], Embedder]) -> DataFrame:
    """prompts (text) with vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for b in batches:
            yield b.assign(vector=list(model.embed_texts(list(b["text"])).astype(float)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{fields}, vector array<double>")


def deal(images: DataFrame, *keys: str, image: Picture | None = None, rows: DataFrame | None = None) -> DataFrame:
    """images (width and height, or image that says them), or rows in their place, by keys in tasks of about TASK_BYTES of pixels, before any pixel is made."""
    wide, high = (image["width"], image["height"]) if isinstance(image, Column) else (F.col("width"), F.col("height"))
    pixels = images.agg(F.sum(wide.cast("long") * high)).first()[0] or 0
    return (images if rows is None else rows).repartition(pixels // TASK_BYTES + 1, *keys)


def _maker(image: Picture | None) -> Callable[[dict], np.ndarray] | None:
    return None if isinstance(image, Column) else image


def _boxed(images: DataFrame, plan: DataFrame | None, image: Picture | None, *keys: str) -> DataFrame:
    """keys, what the image is made of, orientation where it is known, and _boxes (a list, which the geometry bounds) of images that have any,
    and of all those with boxes of their own.

    Pixels are never broadcast, whatever size the planner believes a column of bytes to have. An image that is made of its row (an expression or a function)
    is made after the row has been joined and dealt, so none is shuffled; one that is a column is sent once. Images with boxes of their own stay where they are.
    """
    box = ("region_key", *"ltrb")
    if plan is None:
        rows = images.withColumn("_boxes", F.transform("boxes", lambda x: F.struct(*[x[c].alias(c) for c in box]))).drop("boxes")
    else:
        boxes = plan.groupBy(*keys).agg(F.collect_list(F.struct(*box)).alias("_boxes"))
        if image is None:
            rows = images.join(boxes.hint("merge"), list(keys))
        else:
            rows = deal(images, *keys, image=image, rows=images.join(boxes, list(keys)))
    return _made(rows, image, *keys)


def _made(rows: DataFrame, image: Picture | None, *keys: str) -> DataFrame:
    """rows with the columns that `_crops` reads; an expression makes the pixels here."""
    if _maker(image):
        return rows
    image = F.col("image") if image is None else image
    turn = [F.col("orientation")] if "orientation" in rows.columns else []
    return rows.select(*keys, image["width"].alias("width"), image["height"].alias("height"), image["data"].alias("data"), *turn, "_boxes")


def _crops(make: Callable[[dict], np.ndarray] | None, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """(row, region_key, pixels) of the boxes of rows that `_boxed` gave, in lists that hold about `most` bytes with their images; a box outside has none.

    Pixels are in one piece: a box over the whole width is a view of its image, another one a copy.
    """
    held, size = [], 0
    for b in batches:
        lists = b.column("_boxes")
        boxes = zip(*[c.to_pylist() for c in lists.flatten().flatten()])
        rows = b.select([c for c in b.schema.names if c not in ("_boxes", "data")]).to_pylist()
        for i, (r, n) in enumerate(zip(rows, lists.value_lengths().to_pylist())):
            if not n:
                continue
            pixels = make(r) if make else np.frombuffer(b.column("data")[i].as_buffer(), np.uint8).reshape(r["height"], r["width"], -1)
            pixels = upright(pixels, r.get("orientation"))
            size += pixels.nbytes
            for key, left, top, right, bottom in islice(boxes, n):
                part = pixels if left is None else pixels[top:bottom, left:right]
                if part.size:
                    held.append((r, key, np.ascontiguousarray(part)))
                    size += part.nbytes
                if held and size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def crop_regions(images: DataFrame, plan: DataFrame | None = None, image: Picture | None = None, data: bool = True) -> DataFrame:
    """item_id, region_key, width, height and data of each planned box of images (item_id, image, and orientation where it is known); a box outside is dropped.

    Boxes are those of the picture as seen, so pixels are turned upright before they are cut. Without a plan they are the images' own (boxes, as
    `regions.plan_boxes` gives them), and nothing is joined; `deal` them first. image: what makes the image of a row, where images has none. data=False: crops
    are cut, but their bytes stay in the task.
    """
    make = _maker(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"item_id": pa.int64(), "region_key": pa.string(), "width": pa.int32(), "height": pa.int32()} | ({"data": pa.binary()} if data else {})
        rows = []
        for crops in _crops(make, batches, CROP_BYTES if data else 0):
            rows += [(r["item_id"], key, p.shape[1], p.shape[0], *([p.tobytes()] if data else [])) for r, key, p in crops]
            if data or len(rows) >= ROWS:
                yield _batch(rows, kinds)
                rows = []
        if rows:
            yield _batch(rows, kinds)

    return _boxed(images, plan, image, "item_id").mapInArrow(run, "item_id long, region_key string, width int, height int" + (", data binary" if data else ""))


def embed_regions(images: DataFrame, plan: DataFrame | None, cache: DataFrame, namespace: str, embedder: Callable[[], Embedder], image: Picture | None = None) -> DataFrame:
    """content_hash, namespace, region_key and vector of the planned regions that the cache (those three keys) lacks.

    images has item_id, content_hash and image, or image makes it; without a plan, also its boxes. A region of a content is cut and embedded once, whatever
    the number of its items, and what the cache has is neither cut nor embedded. Crops stay in the task that cut them.
    """
    keys = ["content_hash", "namespace", "region_key"]
    # what an image is made of goes with its boxes; an image that is a column joins those that are left
    own = [c for c in images.columns if c != "boxes"] if image is not None else ["item_id", "content_hash"]
    each = images.select(*own, F.inline("boxes")) if plan is None else plan.join(images.select(*own), "item_id")
    each = each.select(*own, F.lit(namespace).alias("namespace"), "region_key", *"ltrb")
    # merged, as the planner may take a large cache for small and broadcast it; the shuffle is that of the duplicates
    todo = each.join(cache.select(*keys).hint("merge"), keys, "left_anti").dropDuplicates(keys)
    if image is None:
        boxed = _boxed(images.select("item_id", "content_hash", "image", *[c for c in images.columns if c == "orientation"]), todo, None, "item_id", "content_hash")
    else:
        one = ("item_id", "content_hash")  # dealt by them, so that they are grouped without another shuffle
        others = [F.first(c).alias(c) for c in own if c not in one]
        rows = deal(images, *one, image=image, rows=todo).groupBy(*one).agg(*others, F.collect_list(F.struct("region_key", *"ltrb")).alias("_boxes"))
        boxed = _made(rows, image, *one)
    make = _maker(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"content_hash": pa.string(), "region_key": pa.string(), "vector": pa.list_(pa.float64())}
        model, rows = embedder(), []
        for crops in _crops(make, batches, CROP_BYTES):
            vectors = model.embed([memoryview(p.reshape(-1)).toreadonly() for _, _, p in crops]).astype(float)
            rows += [(r["content_hash"], key, v) for (r, key, _), v in zip(crops, vectors)]
            if len(rows) >= ROWS:
                yield _batch(rows, kinds)
                rows = []
        if rows:
            yield _batch(rows, kinds)

    vectors = boxed.mapInArrow(run, "content_hash string, region_key string, vector array<double>")
    return vectors.select("content_hash", F.lit(namespace).alias("namespace"), "region_key", "vector")


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, rejects): item_id and label of JSON lines, and the lines that aren't such."""
    rows = spark.read.schema("item_id long, label int, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = F.col("_bad").isNull() & F.col("item_id").isNotNull()
    return rows.where(good).drop("_bad"), rows.where(~good).select(F.col("_bad").alias("line"))


def _classes(content: bytes | memoryview) -> np.ndarray:
    """How many bytes are in each of 16 classes; only those between the least and the greatest byte are looked for."""
    found, data = np.zeros(16, np.int64), np.frombuffer(content, np.uint8)
    if data.size:
        low, high = int(data.min()) >> 4, int(data.max()) >> 4
        if low < high:
            data = data >> 4
            for k in range(low, high):
                found[k] = np.count_nonzero(data == k)
        found[high] = data.size - found.sum()
    return found


class HashEmbedder:
    """A stand-in model without weights: a unit vector from the bytes' histogram over 16 classes."""

    dim = 16

    def embed(self, contents: list[bytes | memoryview]) -> np.ndarray:
        rows = np.array([_classes(c) for c in contents], float).reshape(-1, 16)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return self.embed([t.encode() for t in texts])
