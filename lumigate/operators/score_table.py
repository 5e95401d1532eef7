"""Persisted scores: a relabel learns and blends again without the region pass, and a run scores only what is new or changed.

Two tables by signature (of the axis registry and the policy that the scores came from):

* `scores`: the visible items' results of the region pass, with what a model reads (axes, features, base score, best region);
* `done`: a hash for each item and content that was scored. Items that the gate excludes leave nothing else, neither id nor score.

`final` has the blended scores by signature and model signature. A batch writes folders of its own name, `scores` before `done`; one that broke off
between is scored again and replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.operators.learning import blend
from lumigate.operators.storage import delete, exists
from lumigate.policy import Policy

KEPT = "item_id long, content_hash string, axes map<string, double>, features array<double>, region_key string, base double"
FINAL = "item_id long, content_hash string, base double, learned double, score double"
#: Under so many items (80 bytes each) the inputs are broadcast against a table; beyond it Spark shuffles both.
BROADCAST_ITEMS = 500_000


def signature(prompts: DataFrame, policy: Policy) -> str:
    """Of a registry (axis, role, polarity, prompt_id, weight, aggregation, vector), whatever the order of its rows, and of a policy."""
    row = F.sha2(F.to_json(F.struct("axis", "role", "polarity", "prompt_id", "weight", "aggregation", "vector")), 256)
    parts = prompts.select(row.alias("h")).agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 13, 25)]).first()
    return prompts.sparkSession.range(1).select(F.sha2(F.lit(f"{tuple(parts)} {policy}"), 256)).first()[0][:24]


def _key() -> Column:
    item = F.col("item_id").cast("string")
    return F.sha2(F.concat_ws("|", F.length(item).cast("string"), item, F.coalesce("content_hash", F.lit(""))), 256)


class ScoreTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str, **folders: str) -> DataFrame:
        """Rows of a table under the given folders, which are filters that prune."""
        at = f"{self.path}/{name}"
        columns = ", ".join([schema, *(f"{f} string" for f in folders), "batch string"])
        rows = self.spark.read.schema(columns).option("basePath", at).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], columns)
        for folder, value in folders.items():
            rows = rows.where(F.col(folder) == value)
        return rows.drop(*folders)

    def stale(self, inputs: DataFrame, sig: str) -> DataFrame:
        """Distinct inputs (item_id, content_hash) that weren't scored under the signature."""
        return inputs.where("item_id is not null").dropDuplicates(["item_id", "content_hash"]).withColumn("_key", _key()).join(self._read("done", "_key string", sig=sig), "_key", "left_anti").drop("_key")

    def refresh(self, inputs: DataFrame, sig: str, score: Callable[[DataFrame], DataFrame], batch: str) -> None:
        """Scores what is stale. score: stale inputs to visible rows with item_id, axes, features, region_key and base."""
        todo = self.stale(inputs, sig)
        rows = score(todo).join(todo.select("item_id", "content_hash"), "item_id").select("item_id", "content_hash", "axes", "features", "region_key", "base")
        folder = f"sig={sig}/batch={batch}"
        keys = todo.select(_key().alias("_key"))
        keys.write.mode("overwrite").parquet(f"{self.path}/trying/{folder}")  # as `stale` reads `done`, its rows are fixed first
        rows.write.mode("overwrite").parquet(f"{self.path}/scores/{folder}")
        self.spark.read.schema("_key string").parquet(f"{self.path}/trying/{folder}").write.mode("overwrite").parquet(f"{self.path}/done/{folder}")
        delete(self.spark, f"{self.path}/trying/{folder}")

    def _of(self, rows: DataFrame, inputs: DataFrame) -> DataFrame:
        """rows of the inputs' items and contents: an item that changed, or is gone, has none of its old ones."""
        wanted = inputs.select("item_id", "content_hash").distinct()
        few = wanted.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
        return rows.join(F.broadcast(wanted) if few else wanted, ["item_id", "content_hash"], "left_semi")

    def scores(self, inputs: DataFrame, sig: str) -> DataFrame:
        return self._of(self._read("scores", KEPT, sig=sig), inputs).drop("batch").dropDuplicates(["item_id", "content_hash"])

    def rescore(self, inputs: DataFrame, sig: str, model: str, learn: Callable[[DataFrame], DataFrame], batch: str) -> DataFrame:
        """item_id, base, learned and score of the inputs' visible items under a model, named by its signature.

        Rows that the model has scored before are read; the others come from `scores` alone: no vector of the region pass is read. learn: rows of `scores` to
        item_id, learned (null: no opinion) and weight.
        """
        have = self._of(self._read("final", FINAL, sig=sig, model=model).where(F.col("batch") != batch), inputs).drop("batch")
        rows = self.scores(inputs, sig)
        todo = rows.join(have.select("item_id", "content_hash"), ["item_id", "content_hash"], "left_anti")
        said = todo.join(learn(todo), "item_id", "left")
        new = said.select("item_id", "content_hash", "base", "learned", blend(F.col("base"), F.col("learned"), F.coalesce("weight", F.lit(0.0))).alias("score"))
        new.write.mode("overwrite").parquet(f"{self.path}/final/sig={sig}/model={model}/batch={batch}")
        out = self._of(self._read("final", FINAL, sig=sig, model=model), inputs)
        return out.drop("batch").dropDuplicates(["item_id", "content_hash"]).drop("content_hash")
