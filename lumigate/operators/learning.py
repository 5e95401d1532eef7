"""Learning from labels: prototypes, logistic regression, calibration, and metrics that decide a model's influence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigate.functions.vector import clip, dot, l2_normalize, sigmoid
from lumigate.operators import joint_fits
from lumigate.operators.labels import folds, split
from lumigate.operators.storage import stored

# When there are labels enough, and how much they may count.
LEAST_LABELS, LEAST_A_CLASS, LEAST_TO_SELECT = 6, 3, 12
FULL_TRUST = 40
GRID = (0.05, 0.25, 1.0, 4.0, 16.0)
PROTOTYPE_SCALE = 8.0
MOST_WEIGHT = 0.85


def features(embedding: Column, region: Column, axes: Column, order: list[str]) -> Column:
    """Embedding, best region's embedding (the item's own without one) and axis scores (0.5 where missing) in a row."""
    e = embedding.cast("array<double>")
    return F.concat(e, F.coalesce(region.cast("array<double>"), e), F.array(*[F.coalesce(axes[a], F.lit(0.5)) for a in order]))


def _per_place(rows: DataFrame) -> DataFrame:
    return rows.select("y", F.posexplode("features").alias("i", "x"))


def prototypes(train: DataFrame) -> DataFrame:
    """y and the unit mean of its unit feature vectors, one row a class."""
    at = _per_place(train.select("y", l2_normalize(F.col("features")).alias("features"))).groupBy("y", "i").agg(F.avg("x").alias("x"))
    return at.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).select("y", l2_normalize(F.col("v")).alias("prototype"))


def prototype_score(x: Column, pos: Column, neg: Column) -> Column:
    unit = l2_normalize(x)
    return sigmoid(PROTOTYPE_SCALE * (dot(unit, pos) - dot(unit, neg)))


def scaling(train: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each place; a deviation near 0 counts as 1."""
    at = _per_place(train).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    row = F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s")).alias("s"))))
    return at.agg(row.alias("r")).select(F.transform("r", lambda s: s["m"]).alias("mean"), F.transform("r", lambda s: s["s"]).alias("deviation"))


def class_weights(train: DataFrame) -> DataFrame:
    """y and its weight: n / (2 * count), scaled to a mean of 1 over rows."""
    n = train.groupBy("y").count()
    total = n.agg(F.sum("count").alias("n"), F.count("*").alias("classes"))
    return n.join(F.broadcast(total)).select("y", (F.col("n") / (F.col("classes") * F.col("count"))).alias("weight"))


def standardised(rows: DataFrame, scale: DataFrame) -> DataFrame:
    z = F.transform(F.arrays_zip(F.col("features").alias("x"), F.col("mean").alias("m"), F.col("deviation").alias("s")), lambda t: (t["x"] - t["m"]) / t["s"])
    return rows.join(F.broadcast(scale)).withColumn("z", z).drop("mean", "deviation")


@dataclass(frozen=True)
class Linear:
    """Coefficients over standardised places, and an intercept."""

    coefficients: list[float]
    intercept: float

    def margin(self, z: Column) -> Column:
        return dot(z, F.array(*[F.lit(float(c)) for c in self.coefficients])) + self.intercept

    def calibrated(self, slope: float, bias: float) -> Linear:
        return Linear([slope * c for c in self.coefficients], slope * self.intercept + bias)


def logistic(train: DataFrame, c: float = 1.0) -> Linear:
    """L2 logistic regression on standardised, class-weighted rows (z, y)."""
    n = train.count()
    weighted = train.join(F.broadcast(class_weights(train)), "y").select(array_to_vector("z").alias("v"), F.col("y").cast("double").alias("y"), "weight")
    model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight", regParam=1 / (c * n), standardization=False, maxIter=100).fit(weighted)
    return Linear([float(x) for x in model.coefficients], float(model.intercept))


def platt(held: DataFrame) -> tuple[float, float]:
    """Slope and bias of a logistic fit on margins (margin, y) that the model did not learn from."""
    fit = logistic(held.select(F.array("margin").alias("z"), "y"), 1e6)
    return fit.coefficients[0], fit.intercept


def out_of_folds(train: DataFrame, cs: tuple[float, ...], k: int = 5, seed: str = "cv") -> DataFrame:
    """item_id, y, c and p from a model that did not see the row, for each of cs; null where the rest could not train one."""
    dealt = stored(folds(train, k, seed), "folds")
    return joint_fits.predicted(dealt, joint_fits.minimised(dealt, joint_fits.begun(dealt, cs)), cs)


def out_of_fold(train: DataFrame, c: float, k: int = 5, seed: str = "cv") -> DataFrame:
    """item_id, y and p of one C."""
    return out_of_folds(train, (c,), k, seed).drop("c")


def roc_auc(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row with auc: the rank statistic with ties averaged; null under 4 rows or with one class.

    Rows are counted for each distinct score first. The running count over scores is a sum in two levels: by range
    of scores, then inside each, so no task sorts all scores.
    """
    at = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    below = running_sum(at, "s", "n").select("p", "n", F.col("before").alias("less"))
    sums = below.agg(F.sum(F.col("p") * (F.col("less") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0) & (F.col("p") + F.col("n") >= 4), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def in_ranges(rows: DataFrame, order: str, buckets: int) -> DataFrame:
    """rows with `_b`, the number of their range of order. The splitters are quantiles from a mergeable sketch, so each range has about as many rows whatever
    the values' law; which values they are decides the balance only."""
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(100 * buckets)).alias("_cuts"))  # one row
    place = F.size(F.filter("_cuts", lambda c: c < F.col(order).cast("double")))
    return rows.join(F.broadcast(cuts)).withColumn("_b", F.greatest(place, F.lit(0))).drop("_cuts")


def running_sum(rows: DataFrame, order: str, value: str, buckets: int | None = None) -> DataFrame:
    """rows with `before`, the sum of value over rows of a smaller order (its values are distinct numbers): by range, then inside each range."""
    dealt = in_ranges(rows, order, buckets or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # one row for each bucket
    starts = dealt.groupBy("_b").agg(F.sum(value).alias("_n")).select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_b").withColumn("before", F.col("_inside") + F.col("_start")).drop("_b", "_inside", "_start")


def average_precision(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row with ap: the mean over hits of the share of hits so far, best first, ties by score together."""
    at = rows.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("s")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count("*").alias("n"))
    hits = running_sum(at, "s", "p").withColumnRenamed("before", "hits")
    both = running_sum(hits, "s", "n")
    share = (F.col("hits") + F.col("p")) / (F.col("before") + F.col("n"))
    return both.agg(F.sum("p").alias("hits"), F.sum(F.col("p") * share).alias("u")).select(F.when(F.col("hits") > 0, F.col("u") / F.col("hits")).alias("ap"))


def select_c(train: DataFrame, k: int = 5) -> tuple[float, float | None]:
    """The first C of the grid with the best pooled out-of-fold AUC, and that AUC."""
    best, auc = 1.0, None
    found = stored(out_of_folds(train, tuple(GRID), k), "out-of-folds")
    for c in GRID:
        a = roc_auc(found.where(F.col("c") == c), "p").first()["auc"]
        if a is not None and (auc is None or a > auc):
            best, auc = c, a
    return best, auc


def blend_weight(auc: Column, labels: Column, has_classifier: Column, most: float = MOST_WEIGHT) -> Column:
    """A learned model's share of the score, by how well it tells held-out labels apart and by how many there are."""
    quality = F.when(auc.isNull(), F.when(has_classifier, 0.5).otherwise(0.35)).otherwise(clip((auc - 0.5) * 2))
    return clip(quality * clip(labels / FULL_TRUST)) * most


def learned_score(classifier: Column, prototype: Column, labels: Column) -> Column:
    """From the prototype to the classifier as labels come in; null if there is neither."""
    share = clip(labels / FULL_TRUST)
    return F.when(classifier.isNull(), prototype).when(prototype.isNull(), classifier).otherwise(share * classifier + (1 - share) * prototype)


def blend(base: Column, learned: Column, weight: Column) -> Column:
    return F.when(learned.isNull() | (weight <= 0), base).otherwise((1 - clip(weight)) * base + clip(weight) * learned)


def fit_outcome(train: DataFrame) -> DataFrame:
    """One row: labels, classes, whether there is a classifier, its C and AUC, and the blend weight."""
    spark = train.sparkSession
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}  # two rows
    total, few = sum(n.values()), min(n.get(0, 0), n.get(1, 0))
    classifier = total >= LEAST_LABELS and few >= LEAST_A_CLASS
    c, auc = select_c(train, min(5, few)) if classifier and total >= LEAST_TO_SELECT else (1.0, None)
    row = spark.createDataFrame([(total, n.get(1, 0), n.get(0, 0), classifier, float(c), auc)], "labels long, accepted long, rejected long, classifier boolean, c double, auc double")
    trained = (F.col("accepted") > 0) & (F.col("rejected") > 0)
    return row.withColumn("weight", F.when(trained, blend_weight(F.col("auc"), F.col("labels"), F.col("classifier"))).otherwise(0.0))


def quality_estimate(train: DataFrame, auc: float | None, seed: str = "quality") -> DataFrame:
    """One row: the cross-validated AUC, or that of a quarter held out."""
    if auc is not None:
        return train.sparkSession.createDataFrame([(auc,)], "auc double")
    cut = split(train, 0.25, seed)
    rest = cut.where(~F.col("test"))
    scale = scaling(rest)
    model = logistic(standardised(rest, scale))
    return roc_auc(standardised(cut.where("test"), scale).select("y", sigmoid(model.margin(F.col("z"))).alias("score")))


def plateau(history: DataFrame, within: float = 0.015) -> DataFrame:
    """history (run, auc) with flat: the last three within a small range."""
    w = Window.orderBy("run").rowsBetween(-2, 0)
    return history.withColumn("flat", (F.count("auc").over(w) == 3) & (F.max("auc").over(w) - F.min("auc").over(w) <= within))
