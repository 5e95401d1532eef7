"""What the operators of this subpackage share: tables, the shared folder, document keys, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Under so many keys (16 bytes and what a hash table adds: about 100 MB) a set of keys is broadcast; beyond it Spark shuffles.
BROADCAST_KEYS = 1_000_000
#: Edges that one task contracts at once (16 bytes each, and about 100 while it does).
HELD_EDGES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see. Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{tempfile.gettempdir()}/lumigate-shared"


def stored(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """df written as a table in the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumigate/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """docs less the rows whose `name` is in keys (stored, one column); docs isn't shuffled where the keys are few enough to broadcast."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, name, "left_anti")


def row_key() -> Column:
    """16 bytes, the same for rows with the same doc_id and text only; the id's length keeps ids with a bar apart."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat_ws("|", F.length(doc).cast("string"), F.col("doc_id").isNull().cast("string"), doc, F.coalesce("text", F.lit("")))))


def apart(docs: DataFrame, added: set[str]) -> list[str]:
    """The columns of docs that an operator keeps: those whose names it doesn't use for its own results."""
    return [c for c in docs.columns if c not in added]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a worker unpacks at once."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives freed memory back at its end: workers live on from task to task and from stage to stage."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it
            pass

    return inner


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def fixed_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits with those set that column's values have, modulo 2**bits. Its size doesn't grow with df."""
    at = F.pmod(F.col(column), F.lit(1 << bits))
    rows = df.select((at / 32768).cast("int").alias("part"), (at % 32768).alias("bit")).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()  # rows of 4 KB
    out = np.zeros(1 << (bits - 3), np.uint8).reshape(-1, 4096)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_bitmap(bitmap: np.ndarray, value: int, bits: int) -> bool:
    at = value % (1 << bits)
    return bool(bitmap[at >> 3] >> (at & 7) & 1)


def marked(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """in_bitmap of an array of longs."""
    at = values & ((1 << bits) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges, and the smallest node that it reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, low = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        a, b = low[u], low[v]
        apart = a != b
        if not apart.any():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while ((further := low[low]) != low).any():
            low = further


def contracted(edges: DataFrame, last: bool = False) -> DataFrame:
    """u, v: edges with the same components as edges u, v, HELD_EDGES of a task at a time: each node with the smallest that it reaches.

    last: edges are in one task and at most HELD_EDGES; smallest nodes get a row too.
    """
    kinds = [edges.schema[c].dataType.simpleString() for c in ("u", "v")]
    most = HELD_EDGES

    def run(batches):
        held, size, schema = [], 0, None

        def joined(every: bool) -> tuple[np.ndarray, np.ndarray]:
            nodes, low = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            keep = every | (nodes != low)
            return nodes[keep], low[keep]

        def given(u, v):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((u, v), schema, strict=True)], schema=schema)

        for b in batches:
            schema = b.schema
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
            size += len(b)
            if size >= most and not last:
                held = [joined(False)]
                size = len(held[0][0])
                if 2 * size > most:
                    yield given(*held[0])
                    held, size = [], 0
        if size:
            yield given(*joined(last))

    return edges.select("u", "v").mapInArrow(trimmed(run), f"u {kinds[0]}, v {kinds[1]}")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as (node, component): component is the smallest node reachable.

    Each task contracts its edges first, and again in as few tasks as hold HELD_EDGES each. Where these are several, alternating
    large-star and small-star rounds follow (Kiveris et al., 2014): every round is two grouped
    minima and joins that Spark may split when one node has very many edges, and each round's edges are
    stored in the shared folder. Nodes without edges are not in the result. Nulls are not nodes.
    """
    first = stored(contracted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")), "cc")
    tasks = max(1, -(-first.count() // HELD_EDGES))
    cur = stored(contracted(first.coalesce(tasks), tasks == 1), "cc")
    forget(first)
    if tasks == 1:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    sums = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # large-star leaves (v, m) with m < v; small-star points every lower neighbour, and u itself, at the lowest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        was, cur = cur, stored(small, "cc")
        now = cur.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.count_distinct("u").alias("d")).first()
        # every node has one edge, and one more round would not change it
        forget(was)
        if (now["n"], now["h"]) == sums:
            break
        sums = (now["n"], now["h"])
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
