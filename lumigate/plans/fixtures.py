"""The shapes that queries run on, derived from the given tables; the axes are abstract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigate.functions.text import label_name
from lumigate.functions.vector import as_double
from lumigate.operators.axes import Registry, role_scores, score_axes
from lumigate.operators.cascade import evaluate, visible
from lumigate.operators.labels import training_set
from lumigate.operators.storage import stored
from lumigate.policy import Policy

ROLES = {"0": "subject", "1": "soft", "2": "exclude", "3": "clear", "4": "detail", "5": "detail", "6": "detail", "7": "detail", "8": "detail", "9": "policy"}
#: Weights of the detail axes; they reach the gate by the registry alone.
WEIGHTS = {"4": 1.0, "5": 0.85, "6": 0.85, "7": 0.7, "8": 0.7}
POLICY = Policy(scale=8.0)
#: Length of the tables' vectors.
DIM = 64
#: Kinds that may speak for an axis, besides the full frame.
ELIGIBLE = {"0": "torso,band_upper,band_mid,band_lower", "1": "torso,band_upper,band_mid", "2": "", "3": "", "4": "torso,band_upper,band_mid,band_lower", "5": "torso,band_upper,band_mid", "6": "torso,band_mid,band_lower", "7": "torso,band_upper,band_mid", "8": "torso,band_mid,band_lower", "9": "torso,band_upper,band_mid,band_lower"}
REGION_KEYS = ("full", "bandtop", "bandmid", "bandlow", "torso0")
KINDS = (("torso", "torso"), ("bandtop", "band_upper"), ("bandmid", "band_mid"), ("bandlow", "band_lower"), ("anchor", "anchor"))
GEOMETRY = (("near", -0.5, -0.5, 1.5, 1.5), ("below", -1.0, 1.0, 2.0, 2.5), ("wide", -2.0, 0.5, 3.0, 5.0))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), as_double(F.col("embedding")).alias("embedding"), F.nullif(F.col("label") % 3 - 1, F.lit(-1)).alias("anchors"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Axis k: the 4 lowest vec_id of label k for it, those of label k + 1 against it; weights 1 to 2.5."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    low = table(spark, sf, "embeddings").where("label is not null").withColumn("rank", rank).where("rank <= 4")
    sides = []
    for polarity, axis in (("p", F.col("label")), ("n", (F.col("label") + 9) % 10)):
        sides.append(low.select(axis.cast("string").alias("axis"), F.lit(polarity).alias("polarity"), F.col("vec_id").alias("prompt_id"), (1 + (F.col("rank") - 1) * 0.5).alias("weight"), F.when(axis % 2 == 0, "weighted_mean").otherwise("max").alias("aggregation"), F.col("embedding").alias("vector")))
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return sides[0].unionByName(sides[1]).withColumns({"role": roles[F.col("axis")], "axis_weight": weights[F.col("axis")]})


def registry(spark: SparkSession, sf: str) -> Registry:
    return Registry.of(prompts(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    reg = registry(spark, sf)
    return role_scores(score_axes(items(spark, sf), reg, POLICY.scale), reg)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """item_id and label: 2 where toxic, else the quality."""
    return table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("label"))


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Internal: holds excluded items."""
    reg = registry(spark, sf)
    rows = role_scores(score_axes(items(spark, sf), reg, POLICY.scale), reg)
    return evaluate(rows, POLICY, reg).withColumn("score", F.col("base"))


def named(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    out = rows.join(labels(spark, sf), "item_id", "left")
    return out.withColumns({"label_name": label_name(F.col("label")), "name": F.concat(F.lit("Item<"), F.col("item_id").cast("string"), F.lit(">.vec")), "mtime": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("item_id") * 37 % 1000)})


def shown(spark: SparkSession, sf: str) -> DataFrame:
    return named(visible(evaluated(spark, sf), POLICY), spark, sf)


def allowed(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """The rows of items that may be seen. Whatever gives item_id and isn't made from `shown` goes through here."""
    return rows.join(visible(evaluated(spark, sf), POLICY).select("item_id"), "item_id", "left_semi")


def region_items(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of items that may be seen."""
    keys = F.array(*[F.lit(k) for k in REGION_KEYS])
    kinds = F.create_map(F.lit("full"), F.lit("full"), *[F.lit(x) for kv in KINDS for x in kv])
    key = F.get(keys, (F.col("vec_id") % 5).cast("int"))
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).cast("long").alias("item_id"), key.alias("region_key"), (F.col("vec_id") % 5).cast("int").alias("place"), "embedding")
    return allowed(rows, spark, sf).withColumn("kind", F.coalesce(kinds[F.col("region_key")], kinds[F.regexp_replace("region_key", r"\d+$", "")]))


def eligible(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, k) for a, kinds in ELIGIBLE.items() for k in ["full", *filter(None, kinds.split(","))]], "axis string, kind string")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    w, h = (200 + 17 * F.col("p_size")).cast("int"), (150 + 23 * (F.col("p_partkey") % 40)).cast("int")
    anchor = F.struct((w / 3).cast("int").alias("x"), (h / 8).cast("int").alias("y"), F.lit(40).alias("w"), F.lit(50).alias("h"), F.lit(1.0).alias("score"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), w.alias("width"), h.alias("height"), F.when(F.col("p_partkey") % 3 == 0, F.array(anchor)).alias("anchors"))


def geometry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GEOMETRY), "kind string, dx0 double, dy0 double, dx1 double, dy1 double")


def label_events(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 2)
    return table(spark, sf, "events").where("event_type <> 'click'").select(F.col("user_id").alias("item_id"), code.alias("label"), F.col("event_id").alias("seq"))


def training(spark: SparkSession, sf: str) -> DataFrame:
    """What a fit may read: accepted and rejected items that may be seen; stored, as fits read it again and again."""
    own = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("label"))
    may = visible(evaluated(spark, sf), POLICY).select("item_id", F.col("embedding").alias("features"))
    return stored(training_set(own, may, DIM), "training")


def metric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("y"))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), F.sha1("text").alias("content_hash"), (F.lit(1_600_000_000) + F.col("doc_id")).alias("mtime"), F.col("n_chars").alias("size"))


def inventory_before(spark: SparkSession, sf: str) -> DataFrame:
    now = inventory(spark, sf).where("doc_id % 11 <> 0").withColumn("size", F.col("size") + (F.col("doc_id") % 13 == 0).cast("int"))
    gone = now.where("doc_id <= 5").withColumn("path", F.concat(F.lit("gone/"), "path"))
    return now.unionByName(gone)


def verdict_texts(spark: SparkSession, sf: str) -> DataFrame:
    p, k = F.col("props"), F.col("event_id") % 5
    text = F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("The answer is "), p, F.lit(" as asked."))).when(k == 3, F.concat(F.lit("["), p, F.lit("]"))).otherwise("no answer")
    return table(spark, sf, "events").select(F.col("event_id").alias("item_id"), text.alias("text"))


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Asked-for settings of each source: valid, out of range, not a number, a wrong choice, a refused key."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    asked = [("threshold", F.format_string("%d.5", F.col("n") % 3)), ("refine_max", (F.col("n") * 100_000).cast("string")), ("scale", F.lit("NaN")), ("policy_filter", F.when(F.col("n") % 2 == 0, "only").otherwise("none")), ("exclude_at", F.lit("0.9")), ("min_clear", F.lit("0.1")), ("classifier_weight", F.lit("0.5")), ("require_subject", F.lit("yes")), ("batch_size", F.lit("32")), ("pipeline", F.when(F.col("n") % 3 == 0, "simple").otherwise("cascade"))]
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in asked])
    return d.select("source", F.inline(rows))
