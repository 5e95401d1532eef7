"""Similar items for many anchors at once: inverted lists over pivots, several probes, exact re-ranking.

Pivots are a bounded sample of the distinct vectors, spread by hash; every distinct vector goes to the list of its nearest pivot, and an anchor is
compared with the lists of its PROBES nearest pivots. Lists are packed into blocks of at most BLOCK vectors, and a hot list is several blocks; an anchor is sent
to a block once, with the names of the lists there that it probes, and its best of each block are merged by rank. Equal vectors are one entry that keeps the smallest ids, so copies of one vector
don't multiply pairs. An audit compares AUDIT anchors with all vectors; while fewer than TARGET of their true neighbours are found, the probes double, up to
all lists, which is exact.

A row's work is (number of lists + probes * list length) products: with about the root of the rows as lists, far from all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigate.functions.vector import as_double
from lumigate.operators.storage import forget, stored

#: Pivots at most: 4096 vectors of 1024 numbers are 32 MB, the size of what each task is sent.
LISTS = 4096
BLOCK = 8192
PROBES = 4
AUDIT, TARGET = 100, 0.95
#: Under so many anchors (their ids and vectors) a block's anchors are one group; more are dealt over several groups.
ANCHORS = 8192
#: Anchors whose products with pivots or with a block are held at once, and rows that leave a task at once.
SLICE, ROWS = 256, 4096


def units(rows: DataFrame) -> DataFrame:
    """item_id and vector (doubles) of rows whose embedding has a direction: no nulls, no zero vector, no number that isn't finite."""
    e = as_double(F.col("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("item_id", e.alias("vector")).where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def normalised(vectors) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in vectors])
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def pivots(entries: DataFrame, n: int) -> np.ndarray:
    """n distinct vectors by the order of a hash: at most LISTS rows come to the driver."""
    return normalised(r["vector"] for r in entries.orderBy(F.xxhash64("vector"), "entry").limit(n).select("vector").collect())


def nearest(vectors, centres: np.ndarray, probes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where each SLICE of vectors begins, and the probes nearest pivots of its vectors."""
    for at in range(0, len(vectors), SLICE):
        near = normalised(vectors[at : at + SLICE]) @ centres.T
        yield at, np.argsort(-near, axis=1, kind="stable")[:, :probes]


def listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (with vector) and list, the nearest pivot."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(list=np.concatenate([top[:, 0] for _, top in nearest(f["vector"].to_numpy(), held.value, 1)]).astype(np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", list int"
    return rows.mapInPandas(run, schema)


def packed(lengths: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each list, and how many it has: small lists share a block of at most BLOCK vectors, a longer list has blocks of its own."""
    first, many = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    blocks, free = 0, 0
    for k in range(lists):
        n = lengths.get(k, 0)
        if n > BLOCK:
            first[k], many[k], free = blocks, -(-n // BLOCK), 0
            blocks += many[k]
        elif n:
            if n > free:
                blocks, free = blocks + 1, BLOCK
            first[k], many[k], free = blocks - 1, 1, free - n
    return first, many


def sent(anchors: DataFrame, centres: np.ndarray, first: np.ndarray, many: np.ndarray, probes: int) -> DataFrame:
    """anchor, vector, block and lists: an anchor once for each block that has any of its probes nearest lists, with these."""
    held = anchors.sparkSession.sparkContext.broadcast((centres, first, many))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, first, many = held.value
        for f in frames:
            ids, vectors = f["anchor"].to_numpy(), f["vector"].to_numpy()
            for at, top in nearest(vectors, centres, probes):
                lists = top.ravel()
                times = many[lists]
                who = np.repeat(at + np.arange(len(top)), top.shape[1]).repeat(times)
                block = first[lists].repeat(times) + np.arange(times.sum()) - (np.cumsum(times) - times).repeat(times)
                lists = lists.repeat(times).astype(np.int32)
                order = np.lexsort((lists, block, who))
                who, block, lists = who[order], block[order], lists[order]
                starts = np.flatnonzero(np.append(True, (np.diff(who) != 0) | (np.diff(block) != 0))) if len(who) else np.zeros(0, int)
                ends = np.append(starts[1:], len(who))
                for k in range(0, len(starts), ROWS):
                    s, e = starts[k : k + ROWS], ends[k : k + ROWS]
                    yield pd.DataFrame({"anchor": ids[who[s]], "vector": vectors[who[s]], "block": block[s], "lists": [lists[i:j] for i, j in zip(s, e)]})

    return anchors.select("anchor", "vector").mapInPandas(run, "anchor long, vector array<double>, block long, lists array<int>")


def best(anchors, vectors, entries: np.ndarray, n: int, lists: np.ndarray | None = None, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, entry and cosine of each anchor's n nearest vectors, ties by smaller entry; of those in its wanted lists, where lists are given.

    Rounded, so that a pair has one value wherever it is computed. A SLICE of anchors is compared at once.
    """
    order = np.argsort(entries, kind="stable")
    entries, right = entries[order], normalised(vectors)[order]
    found = []
    for at in range(0, len(anchors), SLICE):
        near = np.round(np.clip(normalised(anchors[at : at + SLICE]) @ right.T, -1.0, 1.0), 12)
        if lists is not None:
            names, code = np.unique(lists[order], return_inverse=True)
            open_ = np.zeros((len(near), len(names)), bool)
            for k, own in enumerate(wanted[at : at + SLICE]):
                open_[k] = np.isin(names, own)
            near[~open_[:, code]] = -np.inf
        if near.shape[1] > n:
            least = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
            who, which = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        else:
            who, which = np.nonzero(near > -np.inf)
        value = near[who, which]
        rank = np.lexsort((which, -value, who))
        who, which, value = who[rank], which[rank], value[rank]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < n
        found.append((at + who[keep], entries[which[keep]], value[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def ranked(found: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """anchor, item_id, similarity and rank of each anchor's n best, from its n + 1 best entries or more (anchor, entry, similarity).

    An entry stands for its smallest ids; of n + 1 of them, one may be the anchor itself.
    """
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("similarity"), "entry"))
    top = found.withColumn("_r", first).where(F.col("_r") <= n + 1).drop("_r")
    rows = top.join(entries.select("entry", "ids"), "entry").select("anchor", "similarity", F.explode("ids").alias("item_id")).where("anchor <> item_id")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("similarity"), "item_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("anchor", "item_id", "similarity", "rank")


def compared(anchors: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """anchor, entry and similarity: for each anchor the n best of each of its blocks (and ties with the last by smaller entry)."""

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"anchor": [], "entry": [], "similarity": []}).astype({"anchor": "int64", "entry": "int64"})
        who, ids, near = best(left["vector"].to_numpy(), right["vector"].to_numpy(), right["entry"].to_numpy(), n, right["list"].to_numpy(), left["lists"].to_numpy())
        return pd.DataFrame({"anchor": left["anchor"].to_numpy()[who], "entry": ids, "similarity": near})

    keys = ("block", "part")
    return anchors.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(pairs, "anchor long, entry long, similarity double")


class Index:
    """entries: entry (smallest id of a distinct vector), vector, ids (its n + 1 smallest), list and block."""

    def __init__(self, items: DataFrame, n: int, lists: int | None = None) -> None:
        """items: item_id and embedding of what may be found. n: how many neighbours will be asked for at most."""
        self.n = n
        rows = units(items).withColumn("_v", F.to_binary(F.sha2(F.array_join("vector", ","), 256), F.lit("hex")))
        # the n + 1 smallest ids of each distinct vector, without gathering the others
        first = rows.select("_v", "item_id", F.row_number().over(Window.partitionBy("_v").orderBy("item_id")).alias("_r")).where(F.col("_r") <= n + 1)
        ids = first.groupBy("_v").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
        one = rows.groupBy("_v").agg(F.min_by("vector", "item_id").alias("vector"))
        self._entries = stored(one.join(ids, "_v").select(F.get("ids", F.lit(0)).alias("entry"), "vector", "ids"), "similar-entries")
        total = self._entries.count()
        self.centres = pivots(self._entries, min(LISTS, lists or isqrt(total) + 1)) if total else np.zeros((0, 1))
        if not total:
            self.entries = self._entries.withColumns({"list": F.lit(0), "block": F.lit(0).cast("long")})
            return
        rows = stored(listed(self._entries, self.centres), "similar-lists")
        lengths = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}  # at most LISTS rows
        self.first, self.many = packed(lengths, len(self.centres))
        where = rows.sparkSession.createDataFrame([(k, int(self.first[k]), int(self.many[k])) for k in lengths], "list int, _first long, _many long")
        own = F.col("_first") + F.pmod(F.xxhash64("entry"), F.col("_many"))
        self.entries = rows.join(F.broadcast(where), "list").withColumn("block", own).drop("_first", "_many")

    def near(self, anchors: DataFrame, n: int, probes: int) -> DataFrame:
        """anchor, item_id, similarity and rank: the n nearest items of each anchor (anchor, vector), itself left out."""
        spark = anchors.sparkSession
        if not len(self.centres):
            return spark.createDataFrame([], "anchor long, item_id long, similarity double, rank int")
        asked = sent(anchors, self.centres, self.first, self.many, probes)
        # a block that many anchors probe is dealt by anchor as well: each part has the block's vectors
        parts = F.broadcast(asked.groupBy("block").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("parts")))  # a row a block
        asked = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("anchor", F.lit("part")), F.col("parts")).cast("int")).drop("parts")
        blocks = self.entries.join(parts, "block").select("entry", "vector", "list", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        found = compared(asked, blocks, n + 1)
        return ranked(found, self._entries, n)

    def exact(self, anchors: DataFrame, n: int) -> DataFrame:
        """The same by comparing with every vector, for at most AUDIT anchors: they go to every task."""
        rows = anchors.limit(AUDIT).select("anchor", "vector").collect()
        held = anchors.sparkSession.sparkContext.broadcast(([r["anchor"] for r in rows], [r["vector"] for r in rows]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, vectors = held.value
            for f in frames:
                if len(f) and names:
                    who, ids, near = best(vectors, f["vector"].to_numpy(), f["entry"].to_numpy(), n + 1)
                    yield pd.DataFrame({"anchor": np.array(names)[who], "entry": ids, "similarity": near})

        return ranked(self._entries.select("entry", "vector").mapInPandas(run, "anchor long, entry long, similarity double"), self._entries, n)

    def recall(self, anchors: DataFrame, n: int, probes: int) -> float:
        """Share of AUDIT anchors' true neighbours that the probes find, by similarity: another item at the same distance is as good."""
        some = stored(anchors.orderBy(F.xxhash64("anchor", F.lit("audit")), "anchor").limit(AUDIT), "similar-audit")
        true = self.exact(some, n).groupBy("anchor").agg(F.min("similarity").alias("least"), F.count("*").alias("k"))
        hits = self.near(some, n, probes).join(F.broadcast(true), "anchor", "right")  # at most AUDIT rows
        hits = hits.groupBy("anchor").agg(F.first("k").alias("k"), F.count_if(F.col("similarity") >= F.col("least")).alias("hits"))
        got = hits.agg(F.sum(F.least("hits", "k")).alias("hits"), F.sum("k").alias("k")).first()
        forget(some)
        return 1.0 if not got["k"] else got["hits"] / got["k"]

    def audited_probes(self, anchors: DataFrame, n: int, least: float = TARGET) -> tuple[int, float]:
        """The first number of probes, doubling from PROBES on, whose recall is enough, and that recall; all lists at most."""
        probes = min(PROBES, max(len(self.centres), 1))
        while True:
            found = self.recall(anchors, n, probes)
            if found >= least or probes >= len(self.centres):
                return probes, found
            probes = min(probes * 2, len(self.centres))


def similar_to_each(shown: DataFrame, anchors: DataFrame, n: int, least: float = TARGET, lists: int | None = None) -> DataFrame:
    """anchor, item_id, similarity and rank: the n visible items nearest to each visible anchor (anchors: item_id).

    shown must be what the gate lets through: an anchor that isn't among it has no rows, nor has one without a direction.
    Ties go to the smaller item_id. Repeated anchors count once.
    """
    index = Index(shown, n, lists)
    asked = units(shown.join(anchors.select("item_id").distinct(), "item_id", "left_semi")).withColumnRenamed("item_id", "anchor")
    asked = stored(asked, "similar-anchors")
    probes, _ = index.audited_probes(asked, n, least)
    return index.near(asked, n, probes)
