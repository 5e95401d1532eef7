"""What to put before the reviewer next: buckets, diverse picks, disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigate.functions.vector import as_double, cosine_similarity
from lumigate.operators.storage import stored

# Size and margins of the buckets, and their orders with and without a likely match.
PER_BUCKET, MARGIN, DISAGREES = 6, 0.15, 0.08
WITH_LIKELY = ("Likely match", "Model disagrees", "Likely false positive", "Likely false negative", "Uncertain")
WITHOUT_LIKELY = ("Model disagrees", "Uncertain", "Likely false positive", "Likely false negative")


def disagreement(final: Column, base: Column) -> Column:
    return F.abs(final - base)


def _buckets(threshold: float, margin: float) -> list[tuple[str, Column, Column, Column]]:
    """Each bucket's name, who belongs to it, and two numbers that its best have least of."""
    s, none = F.col("score"), F.lit(0.0)
    gap = F.abs(s - threshold)
    return [
        ("Model disagrees", F.coalesce(F.col("disagreement") >= DISAGREES, F.lit(False)), -F.col("disagreement"), none),
        ("Likely match", s >= threshold + margin, -s, none),
        ("Likely false positive", (s >= threshold) & (s <= threshold + margin), s, none),
        ("Likely false negative", (s >= threshold - margin) & (s < threshold), -s, none),
        ("Uncertain", F.lit(True), gap, s),
    ]


def bucketed(shown: DataFrame, labels: DataFrame, threshold: float, per_bucket: int = PER_BUCKET, margin: float = MARGIN) -> DataFrame:
    """item_id, score, bucket and place: unlabelled items for review; an earlier bucket takes an item before later ones.

    One pass: of each bucket only as many of its best move from a partition as all buckets may pick together, since earlier ones can take no more from it. Those
    few (buckets * buckets * per_bucket, a fixed number) are dealt out on the driver.
    """
    left = shown.join(labels.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "score", "disagreement")
    buckets = _buckets(threshold, margin)
    entries = F.array(*[F.when(cond, F.struct(F.lit(k).alias("bucket"), first.cast("double").alias("first"), second.cast("double").alias("second"))) for k, (_, cond, first, second) in enumerate(buckets)])
    each = left.select("item_id", "score", F.inline(F.filter(entries, lambda x: x.isNotNull())))
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy("first", "second", "item_id"))).where(F.col("_r") <= per_bucket * len(buckets))
    taken, picked = set(), []
    found = best.orderBy("bucket", "_r").collect()
    for k, (name, *_) in enumerate(buckets):
        free = [r for r in found if r["bucket"] == k and r["item_id"] not in taken][:per_bucket]
        taken |= {r["item_id"] for r in free}
        picked += [(r["item_id"], r["score"], name, i + 1) for i, r in enumerate(free)]
    kinds = [left.schema["item_id"], left.schema["score"], T.StructField("bucket", T.StringType()), T.StructField("place", T.IntegerType())]
    return shown.sparkSession.createDataFrame(picked, T.StructType(kinds))


def in_review_order(picked: DataFrame) -> DataFrame:
    """picked with `turn`, the bucket's turn: another order when nothing is a likely match."""
    any_likely = picked.agg(F.coalesce(F.max((F.col("bucket") == "Likely match").cast("int")), F.lit(0)).alias("_any"))

    def turn(order: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("int")
        for i, b in enumerate(order):
            out = F.when(F.col("bucket") == b, i).otherwise(out)
        return out

    return picked.join(F.broadcast(any_likely)).withColumn("turn", F.when(F.col("_any") == 1, turn(WITH_LIKELY)).otherwise(turn(WITHOUT_LIKELY))).drop("_any")


def diverse(shown: DataFrame, group: str, order: list[Column], threshold: float, k: int = PER_BUCKET) -> DataFrame:
    """k items of each group: the first by order, then each time the one farthest from all taken, then nearest to the threshold.

    Every round is one grouped maximum and a join with one row for each group, by Spark's choice for their number; all groups go on together.
    """
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order, "item_id"))
    kept = stored(shown.select("item_id", group, "score", as_double(F.col("embedding")).alias("embedding")), "diverse")
    rows = kept.select("item_id", group, "score", F.col("embedding").alias("e"))
    seed = stored(kept.withColumn("_r", first).where("_r = 1").select(group, "item_id", F.col("embedding").alias("t")), "diverse")
    chosen = [seed.select("item_id", group, F.lit(1).alias("place"))]
    state = rows.withColumn("near", F.lit(float("inf")))
    last = seed
    for place in range(2, k + 1):
        state = state.join(last.select(group, F.col("item_id").alias("_taken"), "t"), group).where("item_id <> _taken")
        state = state.withColumn("near", F.least("near", 1 - cosine_similarity(F.col("e"), F.col("t")))).drop("_taken", "t")
        key = F.struct("near", (-F.abs(F.col("score") - threshold)).alias("g"), "score", (-F.col("item_id")).alias("i"))
        last = state.groupBy(group).agg(F.max_by(F.struct("item_id", F.col("e").alias("t")), key).alias("b")).select(group, "b.*")
        last = stored(last, "diverse")
        chosen.append(last.select("item_id", group, F.lit(place).alias("place")))
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out
