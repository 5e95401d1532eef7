"""Reviewer labels: folding events, pooling them across runs, and what a model may train on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels that the pool keeps, the newest by seq.
POOL = 20_000


def fold(events: DataFrame) -> DataFrame:
    """The current label of each item: that of its last event; a null label clears. Undo and redo are later events. Of equal seqs the larger label counts."""
    last = events.groupBy("item_id").agg(F.max(F.struct("seq", "label"))["label"].alias("label"))
    return last.where("label is not null")


def bulk_label(shown: DataFrame, label: int, seq: int) -> DataFrame:
    """Events that label all of a view, after seq in order of item."""
    return shown.select("item_id", F.lit(label).alias("label"), F.lit(seq + 1).cast("long").alias("seq"))


def pool_upsert(pool: DataFrame, new: DataFrame, most: int = POOL) -> DataFrame:
    """item_id, label and seq: the newest of each item, and of these the newest `most`."""
    every = pool.unionByName(new)
    return every.groupBy("item_id").agg(F.max_by(F.struct("label", "seq"), "seq").alias("e")).select("item_id", "e.*").orderBy(F.desc("seq"), "item_id").limit(most)


def pool_merge(own: DataFrame, pool: DataFrame) -> DataFrame:
    """Own labels, and pooled ones of other items."""
    return own.unionByName(pool.join(own, "item_id", "left_anti"))


def pool_prune(pool: DataFrame, inventory: DataFrame) -> DataFrame:
    return pool.join(inventory, "item_id", "left_semi")


def pool_forget(pool: DataFrame, cleared: DataFrame) -> DataFrame:
    return pool.join(cleared, "item_id", "left_anti")


def training_set(labels: DataFrame, shown: DataFrame, dim: int) -> DataFrame:
    """item_id, features and y of accepted and rejected items that are visible and of the model's dimension."""
    return shown.where(F.size("features") == dim).join(labels.where("label in (0, 1)").select("item_id", F.col("label").alias("y")), "item_id").select("item_id", "features", "y")


def signature(labels: DataFrame, layout: str) -> DataFrame:
    """A hash of all labels and the feature layout in one row, whatever their order: each label's hash is summed, none gathered."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("item_id").cast("string"), F.col("label").cast("string"))), 1, 12), 16, 10).cast("decimal(38,0)")
    return labels.where("label in (0, 1)").agg(F.count("*").alias("n"), F.sum(h).alias("h")).select(F.sha1(F.concat_ws("|", F.lit(layout), F.col("n").cast("string"), F.coalesce(F.col("h").cast("string"), F.lit("0")))).alias("signature"))


def placed(rows: DataFrame, seed: str) -> DataFrame:
    """rows with _place (from 1, in each class by a seeded md5) and _n (rows of the class).

    A class may be nearly all rows, so it is ranked in ranges of the md5's first 3 digits: counts of the ranges (4096 a class
    at most, so they are broadcast) give where each begins, and only a range is sorted by one task.
    """
    keyed = rows.withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), F.col("item_id").cast("string")))).withColumn("_range", F.substring("_key", 1, 3))
    counts = keyed.groupBy(F.col("y").alias("_y"), F.col("_range").alias("_r")).agg(F.count("*").alias("_c"))
    begins = counts.select("_y", "_r", (F.sum("_c").over(Window.partitionBy("_y").orderBy("_r")) - F.col("_c")).alias("_begin"), F.sum("_c").over(Window.partitionBy("_y")).alias("_n"))
    at = keyed.join(F.broadcast(begins), F.col("y").eqNullSafe(F.col("_y")) & (F.col("_range") == F.col("_r")))
    place = F.row_number().over(Window.partitionBy("y", "_range").orderBy("_key", "item_id")) + F.col("_begin")
    return at.withColumn("_place", place).drop("_key", "_range", "_y", "_r", "_begin")


def folds(rows: DataFrame, k: int, seed: str) -> DataFrame:
    """rows with fold: round-robin in each class after a seeded shuffle by md5."""
    return placed(rows, seed).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_n")


def split(rows: DataFrame, share: float, seed: str) -> DataFrame:
    """rows with test: each class's share, one at least, and one at least left to train on."""
    n = F.col("_n")
    take = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * share).cast("long")))
    return placed(rows, seed).withColumn("test", F.col("_place") <= take).drop("_place", "_n")
