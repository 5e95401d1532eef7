"""Filters, counts, similarity and sorts over visible items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigate.functions.vector import cosine_similarity
from lumigate.operators.similarity import units

# The place of each bucket in a sorted view.
BUCKETS = {"Likely match": 0, "Likely false positive": 1, "Likely false negative": 2, "Uncertain": 3}
OTHER_BUCKET = 20


def matches(shown: DataFrame, threshold: float) -> DataFrame:
    return shown.where(F.col("score") >= threshold)


def search(rows: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows that have the words in any of the columns, whatever their case."""
    words = words.strip().lower()
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(words))) if words else rows


def by_label(rows: DataFrame, mode: str) -> DataFrame:
    label = F.col("label_name")
    return rows.where({"unlabeled": label == "unlabeled", "labeled": label != "unlabeled", "skipped": label == "skip"}.get(mode, F.lit(True)))


def by_match(rows: DataFrame, mode: str, threshold: float) -> DataFrame:
    hit = F.col("score") >= threshold
    return rows.where({"matched": hit, "unmatched": ~hit}.get(mode, F.lit(True)))


def by_range(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Bounds as text, held to 0..1; a bound that isn't a number is none; a low above the high leaves nothing."""
    low, high = (F.when(~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))) for x in (F.trim(low).try_cast("double"), F.trim(high).try_cast("double")))
    return rows.where(F.coalesce(F.col("score") >= low, F.lit(True)) & F.coalesce(F.col("score") <= high, F.lit(True)) & F.coalesce(low <= high, F.lit(True)))


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("label_name") == n).alias(n) for n in ("good", "bad", "skip", "unlabeled")])


def summary(shown: DataFrame, threshold: float) -> DataFrame:
    return shown.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= threshold).alias("above"), F.count_if(F.col("label_name") != "unlabeled").alias("labeled"))


def similar(shown: DataFrame, anchor_id: int, n: int) -> DataFrame:
    """The n visible items nearest to a visible anchor; nothing if the anchor isn't visible. Vectors without a direction are near to nothing."""
    rows = units(shown)
    anchor = rows.where(F.col("item_id") == anchor_id).select(F.col("vector").alias("_a")).limit(1)
    near = rows.where(F.col("item_id") != anchor_id).join(F.broadcast(anchor))
    return near.select("item_id", cosine_similarity(F.col("vector"), F.col("_a")).alias("similarity")).orderBy(F.desc("similarity"), "item_id").limit(n)


def sort_key(mode: str) -> list[Column]:
    """Order of a view by bucket and score, file name, or date."""
    if mode == "filename":
        return [F.lower("name"), F.desc("score"), F.col("item_id")]
    if mode == "date":
        return [F.desc("mtime"), F.desc("score"), F.col("item_id")]
    return [bucket_rank(F.col("bucket")), F.desc("score"), F.lower("name"), F.col("item_id")]


def bucket_rank(bucket: Column) -> Column:
    out = F.lit(OTHER_BUCKET)
    for name, rank in BUCKETS.items():
        out = F.when(bucket == name, rank).otherwise(out)
    return out
