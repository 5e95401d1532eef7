"""Regions as data: planning boxes, which kinds may speak for which axis, and region evidence for each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigate.operators.cascade import combine_detail

# Smallest crop, anchors used, fallback bands, and the share of what an unanchored region claims over the full frame.
LEAST_SIDE = 48
MOST_ANCHORS = 3
BANDS = (("bandtop", "band_upper", 0.0, 0.55), ("bandmid", "band_mid", 0.25, 0.8), ("bandlow", "band_lower", 0.45, 1.0))
UNANCHORED = ("band", "band_upper", "band_mid", "band_lower")
UNANCHORED_SHARE = 0.5


def clamp_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box rounded half to even and held to the frame; null if a side is under LEAST_SIDE."""
    zero = F.lit(0)
    box = [F.greatest(zero, F.bround(left).cast("int")), F.greatest(zero, F.bround(top).cast("int")), F.least(width, F.bround(right).cast("int")), F.least(height, F.bround(bottom).cast("int"))]
    l, t, r, b = box
    return F.when((r - l >= LEAST_SIDE) & (b - t >= LEAST_SIDE), F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b")))


def top_anchors(anchors: Column, k: int = MOST_ANCHORS) -> Column:
    """The k largest anchors by area, in the given order at a tie."""
    ranked = F.transform(anchors, lambda a, i: F.struct((-(a["w"] * a["h"])).alias("area"), i.alias("i"), a.alias("a")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: s["a"])


def _near(a: Column, g) -> Column:
    """The box of anchor a by g["dx0"] and the others of a row of the geometry."""
    x, y, w, h = (a[c].cast("double") for c in ("x", "y", "w", "h"))
    return clamp_box(x + g["dx0"] * w, y + g["dy0"] * h, x + g["dx1"] * w, y + g["dy1"] * h, F.col("width"), F.col("height"))


def _bands() -> Column:
    """A list of region_key, kind and box; a box that is too small, or a centre that is all, is null."""
    w, h = F.col("width"), F.col("height")
    side = F.least(w, h)
    rows = [F.struct(F.lit(k).alias("region_key"), F.lit(kind).alias("kind"), clamp_box(F.lit(0.0), h * lo, w.cast("double"), h * hi, w, h).alias("box")) for k, kind, lo, hi in BANDS]
    left, top = (w - side) / 2, (h - side) / 2
    rows.append(F.struct(F.lit("centre").alias("region_key"), F.lit("band").alias("kind"), F.when(w != h, clamp_box(left, top, left + side, top + side, w, h)).alias("box")))
    return F.array(*rows)


def _unanchored() -> Column:
    return F.coalesce(F.size("anchors"), F.lit(0)) <= 0


def anchored_regions(frames: DataFrame, geometry: DataFrame, k: int = MOST_ANCHORS) -> DataFrame:
    """Boxes in multiples of each anchor by the user's geometry (kind, dx0, dy0, dx1, dy1)."""
    at = frames.where("width > 0 and height > 0").select("item_id", "width", "height", F.posexplode(top_anchors(F.col("anchors"), k)).alias("rank", "a")).join(F.broadcast(geometry))
    box = _near(F.col("a"), {c: F.col(c) for c in ("dx0", "dy0", "dx1", "dy1")})
    return at.select("item_id", F.concat("kind", F.col("rank").cast("string")).alias("region_key"), "kind", box.alias("box")).where("box is not null").select("item_id", "region_key", "kind", "box.*")


def fallback_bands(frames: DataFrame) -> DataFrame:
    """Three overlapping bands, and the centre square of a frame that isn't one, where there is no anchor."""
    none = frames.where(_unanchored() & (F.col("width") > 0) & (F.col("height") > 0))
    return none.select("item_id", F.inline(_bands())).where("box is not null").select("item_id", "region_key", "kind", "box.*")


def plan_regions(frames: DataFrame, geometry: DataFrame, k: int = MOST_ANCHORS) -> DataFrame:
    """The full frame of every item first, then anchored boxes or bands."""
    none = F.lit(None).cast("int")
    full = frames.select("item_id", F.lit("full").alias("region_key"), F.lit("full").alias("kind"), *[none.alias(c) for c in "ltrb"])
    return full.unionByName(anchored_regions(frames, geometry, k)).unionByName(fallback_bands(frames))


def plan_boxes(frames: DataFrame, geometry: DataFrame, k: int = MOST_ANCHORS) -> DataFrame:
    """frames with the rows of `plan_regions` as a list beside each (boxes: region_key, kind, l, t, r, b), so that whoever has the frame needs no join."""
    kinds = geometry.agg(F.collect_list(F.struct("kind", "dx0", "dy0", "dx1", "dy1")).alias("_geometry"))  # a few rows, broadcast as in `anchored_regions`
    near = lambda a, i: F.transform("_geometry", lambda g: F.struct(F.concat(g["kind"], i.cast("string")).alias("region_key"), g["kind"].alias("kind"), _near(a, g).alias("box")))
    found = F.when(_unanchored(), _bands()).otherwise(F.flatten(F.transform(top_anchors(F.col("anchors"), k), near)))
    found = F.filter(F.when((F.col("width") > 0) & (F.col("height") > 0), found), lambda x: x["box"].isNotNull())
    found = F.transform(found, lambda x: F.struct(x["region_key"].alias("region_key"), x["kind"].alias("kind"), *[x["box"][c].alias(c) for c in "ltrb"]))
    none = F.lit(None).cast("int")
    full = F.array(F.struct(F.lit("full").alias("region_key"), F.lit("full").alias("kind"), *[none.alias(c) for c in "ltrb"]))
    boxes = F.concat(full, F.coalesce(found, F.slice(full, 1, 0)))
    return frames.join(F.broadcast(kinds)).select(*[F.col(c) for c in frames.columns], boxes.alias("boxes"))


def region_scores(scored: DataFrame) -> DataFrame:
    """item_id, region_key, kind, axis, score of regions with a map of axis scores."""
    return scored.select("item_id", "region_key", "kind", F.explode("axes").alias("axis", "score"))


def aggregate_regions(scores: DataFrame, eligible: DataFrame) -> DataFrame:
    """The best evidence for each item and axis: full, the best eligible anchored region, or full plus a share of what bands add.

    An item without a full region has no value, which the gate takes as not known.
    """
    ok = scores.join(F.broadcast(eligible.withColumn("ok", F.lit(True))), ["axis", "kind"], "left")
    band = F.col("kind").isin(*UNANCHORED)
    full = F.max(F.when(F.col("kind") == "full", F.col("score")))
    at = ok.groupBy("item_id", "axis").agg(full.alias("full"), F.max(F.when(F.col("ok") & ~band, F.col("score"))).alias("anchored"), F.max(F.when(F.col("ok") & band, F.col("score"))).alias("bands"))
    add = F.greatest(F.coalesce(F.col("bands") - F.col("full"), F.lit(0.0)), F.lit(0.0))
    return at.select("item_id", "axis", F.when(F.col("full").isNotNull(), F.greatest("full", "anchored", F.col("full") + UNANCHORED_SHARE * add)).alias("score"))


def detail_rows(scores: DataFrame, eligible: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The detail of each region, with 0.5 for axes that its kind can't speak for."""
    wanted = scores.where(F.col("axis").isin(*weights))
    ok = wanted.join(F.broadcast(eligible.withColumn("ok", F.lit(True))), ["axis", "kind"], "left").withColumn("score", F.when(F.col("ok"), F.col("score")).otherwise(0.5))
    wide = ok.groupBy("item_id", "region_key", "kind").agg(*[F.max(F.when(F.col("axis") == a, F.col("score"))).alias(f"_{a}") for a in weights])
    return wide.select("item_id", "region_key", "kind", combine_detail([F.col(f"_{a}") for a in weights], list(weights.values())).alias("detail"))


def best_region(detail: DataFrame, order: Column) -> DataFrame:
    """The region that says most, the earliest at a tie; 'full' unless another says more than it."""
    key = F.struct("detail", (-order).alias("o"))
    other = F.when(~F.col("kind").isin("full", "anchor"), key)
    at = detail.groupBy("item_id").agg(F.max(F.when(F.col("kind") == "full", F.col("detail"))).alias("full"), F.max_by("region_key", other).alias("key"), F.max(other)["detail"].alias("most"))
    return at.select("item_id", F.when(F.col("most") > F.coalesce("full", F.lit(0.0)), F.col("key")).otherwise("full").alias("region_key"))
