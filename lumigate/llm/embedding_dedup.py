"""Near-duplicate embeddings: an HNSW graph for each shard, every shard of a label queried, cosine checked.

Vectors of a label are dealt to shards of at most about SHARD by a hash, so a label of any size is many shards. A
task builds a shard's graph. Then runs of shards meet in tasks, so that each pair of a label's shards meets once: the vectors of one are the
queries in the other's graph; beams widen until the audit passes, and what is found is compared by cosine in
double precision. A task gives for each vector the number of its links and, of the links themselves, only as
many as hold its components together. Components of all tasks are united at the end.

Vectors that are null, all zero or hold null or non-finite numbers, and those with a null label, link with
nothing; of rows with the same vec_id the first by label and vector counts; a null vec_id is one row that
links with nothing. Vectors of different lengths never link; labels may be of any type whose text tells its values apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.llm.base import components, partitions, stored, table
from lumigate.llm.hnsw import Graph, near

LEAST = 0.93
SHARD = 8192
#: A task holds up to twice so many shards, those of two runs of shard numbers, and searches each pair of them.
TOGETHER = 4
#: What single precision may hide: searched down to here, then checked in double.
SLACK = 1e-4

SHARDS = "label string, dim int, shard int, ids binary, vectors binary, sizes binary, nodes binary, links binary"


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _build(t: pa.Table, kind: str) -> pa.Table:
    ids = t.column("vec_id").to_numpy()
    order = np.argsort(ids)
    flat = t.column("embedding").combine_chunks()
    vectors = flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(ids), -1)[order]
    row = {c: t.column(c)[0].as_py() for c in ("label", "dim", "shard")} | {"ids": ids[order].astype(np.int64).tobytes(), "vectors": vectors.tobytes()} | Graph.build(unit(vectors.astype(np.float64))).dump()
    return pa.table({k: [v] for k, v in row.items()}, schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int32()), *[(k, pa.binary()) for k in ("ids", "vectors", "sizes", "nodes", "links")]]))


def held_together(found: np.ndarray, names: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to hold the components of a table of links between names and others."""
    every, at = np.unique(np.concatenate([names, others]), return_inverse=True)
    group, out = np.arange(len(every)), []
    for r in range(len(found)):
        cols = np.flatnonzero(found[r])
        if len(cols):
            mine, theirs = at[r], at[len(names) + cols]
            apart, where = np.unique(group[theirs], return_index=True)
            if len(apart) == 1 and apart[0] == group[mine]:
                continue
            for g, c in zip(apart, theirs[where], strict=True):
                if g != group[mine]:
                    out.append((int(every[mine]), int(every[c])))
            group[np.isin(group, np.append(apart, group[mine]))] = group[mine]
    return out


def _pair(mine: dict, theirs: dict, same: bool, kind: str) -> list[tuple]:
    """Rows of `searched` for the vectors of one shard as queries in the graph of another, or of its own."""
    names, others = mine["ids"], theirs["ids"]
    q, v = (x["vectors"].astype(np.float64) for x in (mine, theirs))
    found, true, hit = near(Graph.load(unit(v), theirs["sizes"], theirs["nodes"], theirs["links"]), unit(q), LEAST - SLACK, same=same)
    lq, lv = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    for i in range(len(q)):
        cols = np.flatnonzero(found[i])
        found[i, cols] = v[cols] @ q[i] / (lv[cols] * lq[i]) >= LEAST
    if same:
        found |= found.T
        np.fill_diagonal(found, False)
    counts = [(names, found.sum(1))] + ([] if same else [(others, found.sum(0))])
    rows = [(int(x), None, int(n), None) for ids, ns in counts for x, n in zip(ids, ns, strict=True) if n]
    return rows + [(x, y, 0, None) for x, y in held_together(found, names, others)] + [(None, None, true, hit)]


def _meet(kind: str):
    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        shards = []
        for r in range(len(t)):
            x = {c: t.column(c)[r].as_buffer() for c in ("ids", "vectors", "sizes", "nodes", "links")}
            ids = np.frombuffer(x["ids"], np.int64)
            shards.append(x | {"shard": t.column("shard")[r].as_py(), "ids": ids, "vectors": np.frombuffer(x["vectors"], kind).reshape(len(ids), -1)})
        shards.sort(key=lambda x: x["shard"])
        rows = []
        for x in shards:
            for y in shards:
                at = x["shard"] // TOGETHER, y["shard"] // TOGETHER
                if x["shard"] <= y["shard"] and at == (i, j):
                    rows += _pair(x, y, x is y, kind)
        return pa.table([pa.array([x[k] for x in rows], pa.int64()) for k in range(4)], names=["a", "b", "n", "hit"])

    return run


def searched(once: DataFrame) -> DataFrame:
    """Stored: a row (a, n) for the links of vector a that a task found, (a, b) for links that hold components, and (n, hit) without
    ids for each pair of shards: the true links of its audit, and how many of them the beams found."""
    spark = once.sparkSession
    kind = "f4" if once.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    inf = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("embedding", lambda x: x != 0)
    good = once.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), "embedding")
    sizes = good.groupBy("label", "dim").count().select("label", "dim", F.ceil(F.col("count") / SHARD).cast("int").alias("n"))
    dealt = good.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    shards = stored(dealt.select("vec_id", "label", "dim", "shard", "embedding").groupBy("label", "dim", "shard").applyInArrow(lambda t: _build(t, kind), SHARDS), "hnsw", "zstd")
    # tasks of TOGETHER by TOGETHER shards: a shard goes to as many as its label has shards / TOGETHER, and no pair of shards is a row
    rows = shards.join(sizes, ["label", "dim"]).withColumn("at", F.floor(F.col("shard") / TOGETHER).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TOGETHER).cast("int"))))
    rows = rows.withColumns({"i": F.least("at", "with"), "j": F.greatest("at", "with")}).drop("at", "with", "n")
    dealt = rows.repartition(4 * partitions(spark), "label", "dim", "i", "j")
    return stored(dealt.groupBy("label", "dim", "i", "j").applyInArrow(_meet(kind), "a long, b long, n long, hit long"), "links")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each vec_id."""
    once = vectors.groupBy("vec_id").agg(F.min_by(F.struct("label", "embedding"), F.struct(F.col("label").isNull(), "label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    once = stored(once, "vectors")
    met = searched(once)
    counts = met.where("a is not null and b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    comp = components(met.where("b is not null").select("a", "b")).select(F.col("node").alias("vec_id"), "component")
    out = once.select("vec_id").join(counts, "vec_id", "left").join(comp, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def recall(met: DataFrame) -> DataFrame:
    """true_links and found_links of all audits of `searched`, and recall (1 without true links)."""
    sums = met.where("a is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("true_links"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found_links"))
    return sums.withColumn("recall", F.when(F.col("true_links") > 0, F.col("found_links") / F.col("true_links")).otherwise(1.0))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT * FROM v WHERE len > 0),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM w x JOIN w y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.len * y.len) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id"""
