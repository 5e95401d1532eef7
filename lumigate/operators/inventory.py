"""Inventories of items by content: hashes, duplicates, caches by namespace, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha1(content)


def prune_marked(inventory: DataFrame, marked: DataFrame) -> DataFrame:
    """inventory without what lies under a marked folder (dir). Marks may be many, so Spark chooses the join by their size."""
    parts = F.split("path", "/")
    ups = inventory.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    under = ups.join(marked, "dir", "left_semi").select("path")
    return inventory.join(under, "path", "left_anti")


def namespace(backend: Column, model: Column) -> Column:
    """The space that vectors of one backend and model live in."""
    model = F.when(F.length(model) > 0, model).otherwise("default")
    return F.lower(F.regexp_replace(F.regexp_replace(F.concat_ws("-", backend, model), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def region_namespace(model: Column, geometry_version: int) -> Column:
    model = F.when(F.length(model) > 0, model).otherwise("default")
    slug = F.lower(F.regexp_replace(F.regexp_replace(model, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.concat(slug, F.lit(f"__g{geometry_version}"))


def cache_lookup(inventory: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """Cached vectors of files that didn't change and whose size is the model's."""
    return inventory.join(cache.where(F.size("vector") == dim), ["path", "mtime", "size"])


def pending(inventory: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct contents without a vector in the namespace: what a run, or one started again, has to embed."""
    return inventory.select("content_hash", "namespace").distinct().join(cache, ["content_hash", "namespace"], "left_anti")


def valid_version(derived: DataFrame, version: int) -> DataFrame:
    """Derived rows of the current decode version; labels are another table and stay."""
    return derived.where(F.col("version") == version)


def fan_out(inventory: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every path with its content's one vector."""
    return inventory.join(vectors, "content_hash")


def duplicate_groups(inventory: DataFrame) -> DataFrame:
    """content_hash, n and first of contents with more than one path, without gathering a group's members."""
    return inventory.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")


def duplicate_members(inventory: DataFrame, groups: DataFrame) -> DataFrame:
    return inventory.join(groups, "content_hash").select("content_hash", "path")


def duplicate_remainder(inventory: DataFrame) -> DataFrame:
    """All but the first path of each content."""
    return inventory.join(duplicate_groups(inventory), "content_hash").where("path <> first").select("content_hash", "path")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change: added, removed or changed."""
    a, b = before.select("path", F.struct("mtime", "size").alias("was")), after.select("path", F.struct("mtime", "size").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def baseline_diff(golden: DataFrame, now: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """name, axis and kind of difference between two tables of name, axis, score; beyond the tolerance, new or gone."""
    both = golden.select("name", "axis", F.col("score").alias("was")).join(now.select("name", "axis", F.col("score").alias("is")), ["name", "axis"], "full_outer")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.abs(F.col("was") - F.col("is")) > tolerance, "moved")
    return both.select("name", "axis", kind.alias("kind")).where("kind is not null")
