"""Filter interaction audit: what five filters remove in each order, by incremental streaming with retraction.

All files go through one stream in available-now micro-batches. A narrow pass gives each text the filters that it fails by itself (A
to D) and a SHA-256 key. The fifth, E, fails texts that a smaller doc_id has as well, anywhere: state keyed by text, in groups of about
GROUP texts, holds each text's smallest doc_id so far and the masks of its rows. A row with a larger id counts with E at once; when a smaller id arrives, the
masks counted without E are retracted from the counters of their parts and added again with E. Whatever the order of files
and rows, the sums end as if the smallest ids had been known. Each micro-batch writes its counter changes into a folder of its own
number, so one that runs twice after a loss counts once; a later call with the same work folder reads new files only.

The report needs counts by part and mask alone: 32 masks, the labels with each, and 600 order steps a part.

Tasks combine equal texts before the shuffle (the smallest id, and counts of the rest), so a text that a third of all rows have
comes to one row for each task and flush. State is a hundred bytes for a distinct text, in RocksDB; a micro-batch writes the groups anew that it
has rows of. A call of Python costs some milliseconds, whatever it holds, so a state for each single text would cost more than all else (measured: 1449
CPU seconds a GB). The number of groups is that of the first call's rows, kept in the work folder.

Nulls and edges: a null text is empty and equals other empty ones, a null lang is the part "", a null doc_id has no smaller id and is none, so it
never fails E; rows with equal doc_id and text don't fail E by each other. Several labels of one doc_id: any 1 counts. An empty table has
no parts and no rows. Only doc_id, text and lang are read; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.llm.base import BROADCAST_KEYS, forget, shared_dir, slices, stored, table

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Above the five bits of the mask: labels of the row.
GOOD, TOXIC = 32, 64
UPPER = bytes(range(65, 91))
NOT_UPPER = bytes(set(range(256)) - set(UPPER))
MARKS = bytes(set(range(256)) - set(b"#$%&*|"))
#: Distinct texts that a task holds (about 200 bytes each) before it gives them on.
HELD = 50_000
#: Micro-batches of a run, as files divide among them.
BATCHES = 4
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Conf of the stream: state in RocksDB, whose commits upload what changed and not whole files, and whose many small stores claim no disk in advance (4 MB each).
STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Texts in a group, on the average of the first call.
GROUP = 500
CHANGE = "part string, bits int, n long"
STATE = "keys array<binary>, ids array<long>, parts array<string>, bits array<int>, ns array<long>"


def own_mask(text: str) -> int:
    """The filters that a text fails by itself. Bytes split at the six ASCII spaces, as the words' pattern does."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    mask = BIT["A"] if len(words) < 100 else 0
    if 100 * len(set(words)) < 80 * len(words):
        mask |= BIT["B"]
    if 100 * len(raw.translate(None, NOT_UPPER)) > 10 * len(text):
        mask |= BIT["C"]
    return mask | BIT["D"] if raw.translate(None, MARKS) else mask


def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [t or "" for t in b.column("text").to_pylist()]
        keys = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(list(map(own_mask, texts)), pa.int32()), keys], ["doc_id", "part", "bits", "key"])


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text of a task: rows of its smallest id (standing), and counts of all others, which need no state."""
    names = ["key", "doc_id", "part", "bits", "n", "standing"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]

    def given(least: dict, standing: dict, settled: Counter) -> Iterator[pa.RecordBatch]:
        rows = [(k, least[k], p, b, n, True) for k, of in standing.items() for (p, b), n in of.items()] + [(k, 0, p, b, n, False) for (k, p, b), n in settled.items()]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), kinds)], names)

    least, standing, settled = {}, {}, Counter()
    for b in batches:
        for d, part, bits, key in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "bits", "key"))):
            if d is None:
                settled[key, part, bits] += 1
            elif key not in least or d < least[key]:
                for (p, x), n in standing.get(key, {}).items():
                    settled[key, p, x | BIT["E"]] += n
                least[key], standing[key] = d, {(part, bits): 1}
            elif d == least[key]:
                standing[key][part, bits] = standing[key].get((part, bits), 0) + 1
            else:
                settled[key, part, bits | BIT["E"]] += 1
        if len(least) + len(settled) > HELD:
            yield from given(least, standing, settled)
            least, standing, settled = {}, {}, Counter()
    yield from given(least, standing, settled)


def changes(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A group's changes to the counters: later rows with E, and retraction of what a smaller id makes a copy."""
    least, standing, out = {}, {}, Counter()
    for key, d, part, bits, n in zip(*state.get) if state.exists else ():
        least[key] = d
        standing.setdefault(key, {})[part, bits] = n
    for frame in frames:
        for key, d, part, bits, n, stands in zip(*(frame[c].tolist() for c in ("key", "doc_id", "part", "bits", "n", "standing"))):
            if not stands:
                out[part, bits] += n
            elif key not in least or d < least[key]:
                for (p, x), m in standing.get(key, {}).items():
                    out[p, x] -= m
                    out[p, x | BIT["E"]] += m
                least[key], standing[key] = d, {(part, bits): n}
                out[part, bits] += n
            elif d == least[key]:
                standing[key][part, bits] = standing[key].get((part, bits), 0) + n
                out[part, bits] += n
            else:
                out[part, bits | BIT["E"]] += n
    held = [(k, least[k], p, x, n) for k, of in standing.items() for (p, x), n in of.items()]
    if held:
        state.update(tuple(map(list, zip(*held))))
    rows = [(p, x, n) for (p, x), n in out.items() if n]
    yield pd.DataFrame({"part": [r[0] for r in rows], "bits": pd.array([r[1] for r in rows], "int32"), "n": pd.array([r[2] for r in rows], "int64")})


def groups(files: DataFrame, work: str) -> int:
    """The number of groups of texts, by the first call's rows (a count that Parquet's footers give)."""
    spark, path = files.sparkSession, f"{work}/groups"
    if not _there(spark, path):
        spark.createDataFrame([(max(1, files.count() // GROUP),)], "n long").write.parquet(path)
    return spark.read.parquet(path).first()["n"]


def marks(labels: DataFrame) -> DataFrame:
    """doc_id and flags of the documents with a label of 1: GOOD, TOXIC or both."""
    found = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    return found.agg((flag("quality", GOOD) + flag("toxic", TOXIC)).alias("flags"))


def counted(spark: SparkSession, path: str, labels: DataFrame, work: str, batches: int = BATCHES) -> DataFrame:
    """part, mask, n, good and toxic (rows with the label) of all documents under path that this work folder has read so far."""
    files = spark.read.parquet(path)
    each = max(1, -(-len(files.inputFiles()) // batches))
    flags = stored(marks(labels), "audit-marks")
    few = flags.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    # a pattern that only this path meets: streams take a single file by a pattern alone
    name = path.rstrip("/")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", each).parquet(f"{name[:-1]}[{name[-1]}]")
    rows = stream.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(masked, "doc_id long, part string, bits int, key binary")
    rows = rows.join(F.broadcast(flags) if few else flags, "doc_id", "left").select("doc_id", "part", F.col("bits").bitwiseOR(F.coalesce("flags", F.lit(0))).alias("bits"), "key")
    rows = rows.mapInArrow(combined, "key binary, doc_id long, part string, bits int, n long, standing boolean")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups(files, work)))).groupBy("group").applyInPandasWithState(changes, CHANGE, STATE, "update", "NoTimeout")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "bits").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{work}/changes/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = rows.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()  # raises what a batch raised
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # a folder without files has no batch, and leaves no changes
    done = spark.createDataFrame([], CHANGE) if query.lastProgress is None and not _there(spark, f"{work}/changes") else spark.read.schema(CHANGE).parquet(f"{work}/changes/*")
    mask, has = F.col("bits").bitwiseAND(31), lambda bit: F.sum(F.when(F.col("bits").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    out = stored(done.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), has(GOOD).alias("good"), has(TOXIC).alias("toxic")), "audit-counts")
    forget(flags)
    return out


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def order_steps() -> str:
    """The 600 steps of all orders, as JSON: the filters before a step, and its own, as bits."""
    out = []
    for order in itertools.permutations(FILTERS):
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(order), "step": k + 1, "prior": sum(BIT[x] for x in order[:k]), "own": BIT[f]})
    return json.dumps(out)


def report(counts: DataFrame) -> DataFrame:
    """Each part, order and step, from the counts by mask (at most 32 a part)."""
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_m"))
    steps = F.from_json(F.lit(order_steps()), "array<struct<filter_order: string, step: int, prior: int, own: int>>")
    rows = held.select("part", "_m", F.explode(steps).alias("s")).select("part", "_m", "s.*")
    zero = F.lit(0).cast("long")
    total = lambda what, of: F.aggregate(F.filter("_m", of), zero, lambda a, m: a + m[what])
    in_prior = lambda m: m["mask"].bitwiseAND(F.col("prior")) != 0
    in_own = lambda m: m["mask"].bitwiseAND(F.col("own")) != 0
    here = lambda m: in_own(m) & ~in_prior(m)
    rows = rows.select(
        "part", "filter_order", "step", "own", total("n", lambda m: ~in_own(m) & ~in_prior(m)).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: in_own(m) & in_prior(m)).alias("redundant"), total("n", lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    shapley = rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "own"]).drop("own")


def audit(spark: SparkSession, path: str, labels: DataFrame, work: str | None = None, batches: int = BATCHES) -> DataFrame:
    """The report over the Parquet files under path. With a work folder of the caller's, a later call goes on from there; else it goes."""
    own = work or f"{shared_dir(spark).rstrip('/')}/lumigate/audit-{uuid.uuid4().hex}"
    counts = counted(spark, path, labels, own, batches)
    if work is None:
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return report(counts)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


SQL = r"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
masks AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask FROM words),
flags AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, k, 1 << (ascii(o[k]) - 65) AS own, list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(o[i]) - 65))) AS p FROM orders, (SELECT unnest(range(1, 6)) AS k)),
audited AS (SELECT part, o AS filter_order, k::INT AS step, own,
  sum(CASE WHEN mask & (own | prior) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & prior <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, (SELECT *, coalesce(p, 0)::BIGINT AS prior FROM steps) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM audited"""
