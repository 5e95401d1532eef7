"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the set of its hashed words, pairs of neighbours and pairs with one or two words
between, each with the value 1/sqrt(size of the set), so that long texts count like short ones. Training
rows are dealt to a few shards; in each epoch every shard takes the common state (z and n of each
coordinate), runs FTRL-proximal over its rows with per-coordinate rates, and gives back what it added; the
means are the next state. State and what is added are stored tables, so neither passes through the driver. L1 leaves
few weights other than 0, and only those are collected and broadcast to score the corpus in one narrow pass.

The fit reads at most `Model.max_rows` labelled rows, those of the lowest hash of doc_id; scoring reads every
row and every text whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigate.llm.base import apart, forget, slices, stored, table, trimmed

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: One odd multiplier for each distance between the two words of a pair.
GAPS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
CACHE_ENTRIES = 200_000
#: Longer words are hashed each time, so that a cache has a bound in bytes.
CACHE_LENGTH = 64


@dataclass(frozen=True)
class Model:
    """bits: log2 of the number of coordinates. max_rows: the bound on rows that the fit reads."""

    bits: int = 19
    alpha: float = 20.0
    beta: float = 0.1
    l1: float = 0.2
    l2: float = 0.0
    epochs: int = 8
    shards: int = 2
    max_rows: int = 14_000
    threshold: float = 0.3


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        h = zlib.crc32(data) << 32 | zlib.adler32(data, len(data))
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = h
        return h


def features(text: str, hashes: WordHashes, bits: int) -> np.ndarray:
    """Coordinates of a text, with repeats."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) * MIX
    h ^= h >> np.uint64(29)
    parts = [h * MIX] + [(h[:-g] * m ^ h[g:]) * MIX for g, m in enumerate(GAPS, 1) if len(h) > g]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.uint32)


def weights(z: np.ndarray, n: np.ndarray, m: Model) -> np.ndarray:
    return np.where(np.abs(z) <= m.l1, 0.0, -(z - np.sign(z) * m.l1) / ((m.beta + np.sqrt(n)) / m.alpha + m.l2))


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def bias_of(z: float, n: float) -> float:
    return float(-z / (1 + np.sqrt(n)))


def ftrl_pass(rows: Iterator[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray, m: Model) -> None:
    """One pass in place; the last coordinate of z and n is the bias, which L1 leaves alone."""
    for ids, y in rows:
        x = 1 / np.sqrt(max(1, len(ids)))
        zi, ni = z[ids], n[ids]
        w = weights(zi, ni, m)
        miss = sigmoid(w.sum() * x + bias_of(z[-1], n[-1])) - y
        g = miss * x
        z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / m.alpha * w
        n[ids] = ni + g * g
        z[-1], n[-1] = z[-1] + miss - (np.sqrt(n[-1] + miss * miss) - np.sqrt(n[-1])) * bias_of(z[-1], n[-1]), n[-1] + miss * miss


PACKED = pa.schema([("shard", pa.int32()), ("ys", pa.binary()), ("sizes", pa.binary()), ("steps", pa.binary())])
ADDED = pa.schema([("shard", pa.int32()), ("at", pa.binary()), ("dz", pa.binary()), ("dn", pa.binary())])
STATE = pa.schema([("z", pa.binary()), ("n", pa.binary())])
WEIGHTS = pa.schema([("at", pa.binary()), ("w", pa.binary()), ("bias", pa.float64())])


def pack(t: pa.Table) -> pa.Table:
    """A shard as one row: its labels, sizes of feature sets, and the sets as steps between coordinates."""
    t = t.take(pa.array(np.lexsort((t.column("y").to_numpy(), t.column("turn").to_numpy()))))
    steps = t.column("steps").combine_chunks()
    at = np.frombuffer(steps.buffers()[1], np.int32)[steps.offset : steps.offset + len(steps) + 1]
    # the sets lie one after another in the column's own buffer
    whole = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(at[[0, -1]].tobytes()), steps.buffers()[2]])
    return pa.table({"shard": t.column("shard").slice(0, 1).combine_chunks(), "ys": [t.column("y").to_numpy().astype(np.int32).tobytes()], "sizes": [(np.diff(at) // 4).astype(np.int32).tobytes()], "steps": whole}, schema=PACKED)


def columns(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def shard_pass(epoch: int, m: Model):
    """What each shard adds in an epoch to the common state that its row holds (z and n, null before the first epoch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                ys, sizes, steps = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in (("ys", np.int32), ("sizes", np.int32), ("steps", np.uint32)))
                begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                held = [b.column(c)[i].as_buffer() for c in ("z", "n")]
                z0, n0 = (np.zeros((1 << m.bits) + 1) if x is None else np.frombuffer(x, np.float32).astype(np.float64) for x in held)
                z1, n1 = z0.copy(), n0.copy()
                order = np.random.default_rng(epoch).permutation(len(ys))
                ftrl_pass(((np.cumsum(steps[begin[i] : begin[i + 1]], dtype=np.int64), int(ys[i])) for i in order), z1, n1, m)
                at = np.flatnonzero((z1 != z0) | (n1 != n0)).astype(np.uint32)
                found = [pa.array([x.tobytes()], pa.binary()) for x in (at, (z1 - z0)[at].astype(np.float32), (n1 - n0)[at].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column("shard").slice(i, 1), *found], schema=ADDED)

    return trimmed(run)


def merged(m: Model):
    """The next state, from one task's rows: the state, if there is one (shard -1, dense), and what each shard adds (one row a shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        z, n = np.zeros((1 << m.bits) + 1, np.float32), np.zeros((1 << m.bits) + 1, np.float32)
        for r in sorted(rows, key=lambda r: r["shard"]):
            dz, dn = (np.frombuffer(r[c], np.float32) for c in ("dz", "dn"))
            if r["shard"] < 0:
                z[:], n[:] = dz, dn
            else:
                at = np.frombuffer(r["at"], np.uint32)
                z[at] += dz / m.shards
                n[at] += dn / m.shards
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (z, n)], schema=STATE)

    return trimmed(run)


def kept_weights(m: Model):
    """Coordinates with a weight, their weights, and the bias of a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                z, n = (np.frombuffer(r[c], np.float32) for c in ("z", "n"))
                w = weights(z[:-1], n[:-1], m)
                at = np.flatnonzero(w).astype(np.uint32)
                yield pa.RecordBatch.from_pylist([{"at": at.tobytes(), "w": w[at].astype(np.float32).tobytes(), "bias": bias_of(z[-1], n[-1])}], schema=WEIGHTS)

    return trimmed(run)


def fit(rows: DataFrame, m: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates with a weight, their weights, bias) from rows with doc_id, text and y.

    The rows are at most m.max_rows; they are shuffled once, to a row for each shard, and that table is
    what all epochs read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            steps = [np.diff(np.unique(features(t or "", hashes, m.bits)), prepend=np.uint32(0)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("turn"), b.column("y"), pa.array(steps, pa.binary())], ["shard", "turn", "y", "steps"])

    turn = F.xxhash64("doc_id", F.lit("turn"))
    coded = rows.select(F.pmod(turn, F.lit(m.shards)).cast("int").alias("shard"), turn.alias("turn"), "y", "text").mapInArrow(trimmed(encode), "shard int, turn long, y int, steps binary")
    shards = stored(coded.groupBy("shard").applyInArrow(pack, columns(PACKED)), "toxicity", "zstd")
    state = None
    for epoch in range(m.epochs):
        if state is None:
            seen = shards.withColumns({c: F.lit(None).cast("binary") for c in ("z", "n")})
        else:
            seen = shards.hint("shuffle_replicate_nl").crossJoin(state.coalesce(1))  # the state goes to the shards' tasks, and isn't broadcast
        added = stored(seen.mapInArrow(shard_pass(epoch, m), columns(ADDED)), "toxicity-added")
        rows = added if state is None else state.selectExpr("-1 as shard", "cast(null as binary) as at", "z as dz", "n as dn").union(added)
        was, state = state, stored(rows.coalesce(1).mapInArrow(merged(m), columns(STATE)), "toxicity-state")
        forget(added, *([] if was is None else [was]))
    last = state.mapInArrow(kept_weights(m), columns(WEIGHTS)).collect() if state is not None else []
    forget(shards, *([] if state is None else [state]))
    if not last:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(last[0]["at"], np.uint32), np.frombuffer(last[0]["w"], np.float32), last[0]["bias"]


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, m: Model) -> DataFrame:
    """doc_id, text and y of the labelled documents that the fit may read. The ids are at most m.max_rows, so they may be broadcast; of rows with
    one doc_id the least text counts."""
    y = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    ids = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(m.max_rows)
    # one text for each id: repeated rows would grow a shard without bound
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("y").alias("y"))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], m: Model, text: str = "text") -> DataFrame:
    """row (a struct of the columns of docs) and `score`, 0 to 1. A null or empty text has the bias alone; rows are all kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.select(F.struct(*docs.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        dense = np.zeros(1 << m.bits, np.float32)
        dense[at] = w
        hashes = WordHashes()
        for b in slices(batches):
            sums = []
            for t in pc.struct_field(b.column("row"), text).to_pylist():
                ids = np.unique(features(t or "", hashes, m.bits))
                sums.append(float(sigmoid(bias + dense[ids].astype(np.float64).sum() / np.sqrt(max(1, len(ids))))))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sums, pa.float64())], ["row", "score"])

    return keep.mapInArrow(trimmed(run), T.StructType([*keep.schema.fields, T.StructField("score", T.DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, m: Model = Model()) -> DataFrame:
    """row (a struct of the columns of docs), held_out, score and predicted (score >= m.threshold).

    Nulls: an unlabelled or null toxic trains nothing; a null text is empty; a null doc_id is scored and not
    held out. Repeated labels of one document count once, toxic if any is; of rows with one doc_id one trains. Without any
    training row the score is 0.5 everywhere.
    """
    model = fit(training_rows(docs, labels, m), m)
    found = score(docs, model, m)
    return found.select("row", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= m.threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, m: Model = Model()) -> DataFrame:
    """docs with held_out, score and predicted in place of columns with these names (see judged)."""
    results = ["held_out", "score", "predicted"]
    return judged(docs, labels, m).select(*[F.col("row").getField(c).alias(c) for c in apart(docs, set(results))], *results)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
