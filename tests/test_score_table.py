"""Persisted scores: only stale items are scored, a relabel reads no vectors of the region pass, and excluded items leave no trace."""

import pytest
from pyspark.sql import functions as F

from lumigate.operators import score_table as st
from lumigate.policy import Policy


def inputs(spark, **contents):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in contents.items()], "item_id long, content_hash string")


@pytest.fixture
def table(spark, tmp_path):
    return st.ScoreTable(spark, f"file://{tmp_path}/scores")


class RegionPass:
    """Scores from a folder of region vectors; item 3 is excluded. Remembers what it was asked for."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.asked = spark, folder, []
        spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "item_id long, vector array<double>").write.parquet(folder)

    def __call__(self, todo):
        self.asked.append(sorted(r.item_id for r in todo.collect()))
        rows = self.spark.read.parquet(self.folder).join(todo.select("item_id"), "item_id").where("item_id <> 3")
        return rows.select("item_id", F.create_map(F.lit("4"), F.get("vector", 0)).alias("axes"), F.col("vector").alias("features"), F.lit("full").alias("region_key"), (F.get("vector", 0) / 10).alias("base"))


def learn(value):
    return lambda todo: todo.select("item_id", F.when(F.col("item_id") != 2, F.lit(value)).alias("learned"), F.lit(0.5).alias("weight"))


def scores(frame):
    return {r.item_id: round(r.score, 9) for r in frame.collect()}


def test_only_stale_items_are_scored(spark, table, tmp_path):
    run = RegionPass(spark, f"{tmp_path}/regions")
    table.refresh(inputs(spark, i1="a", i3="a"), "s", run, "1")
    table.refresh(inputs(spark, i1="a", i2="a", i3="a"), "s", run, "2")
    table.refresh(inputs(spark, i1="b", i2="a", i3="a"), "s", run, "3")  # item 1 changed
    table.refresh(inputs(spark, i1="b", i2="a"), "s", run, "4")
    table.refresh(inputs(spark, i1="b"), "other", run, "1")  # another registry or policy
    assert run.asked == [[1, 3], [2], [1], [], [1]]
    assert sorted(r.content_hash for r in table.scores(inputs(spark, i1="b", i2="a", i3="a"), "s").collect()) == ["a", "b"]
    assert table.scores(inputs(spark, i9="a"), "s").count() == 0


def test_a_batch_that_broke_off_is_scored_again(spark, table, tmp_path):
    run = RegionPass(spark, f"{tmp_path}/regions")
    table.refresh(inputs(spark, i1="a", i2="a"), "s", run, "1")
    for p in (tmp_path / "scores/done/sig=s/batch=1").iterdir():
        p.unlink()
    table.refresh(inputs(spark, i1="a", i2="a"), "s", run, "1")
    assert run.asked == [[1, 2], [1, 2]] and table.scores(inputs(spark, i1="a", i2="a"), "s").count() == 2


def test_a_relabel_reads_no_vectors_of_the_region_pass(spark, table, tmp_path):
    run = RegionPass(spark, f"{tmp_path}/regions")
    every = inputs(spark, i1="a", i2="a", i3="a", i5="a")
    table.refresh(every, "s", run, "1")
    for p in (tmp_path / "regions").glob("*"):
        p.unlink()  # a read of the region vectors would fail
    first = table.rescore(every, "s", "m1", learn(1.0), "1")
    assert scores(first) == {1: 0.55, 2: 0.2, 5: 0.75}
    second = table.rescore(every, "s", "m2", learn(0.0), "2")
    assert scores(second) == {1: 0.05, 2: 0.2, 5: 0.25}
    assert not any("/regions/" in f for f in second.inputFiles())


def test_rows_that_a_model_has_scored_are_read_and_the_rest_is_added(spark, table, tmp_path):
    run = RegionPass(spark, f"{tmp_path}/regions")
    table.refresh(inputs(spark, i1="a", i5="a"), "s", run, "1")
    table.rescore(inputs(spark, i1="a"), "s", "m", learn(1.0), "1")
    asked = []

    def watched(todo):
        asked.append(sorted(r.item_id for r in todo.collect()))
        return learn(1.0)(todo)

    both = inputs(spark, i1="a", i5="a")
    assert scores(table.rescore(both, "s", "m", watched, "2")) == {1: 0.55, 5: 0.75} and asked == [[5]]
    assert scores(table.rescore(both, "s", "m", watched, "2")) == {1: 0.55, 5: 0.75} and asked == [[5], [5]]  # the same batch again


def test_excluded_items_leave_no_trace(spark, table, tmp_path):
    run = RegionPass(spark, f"{tmp_path}/regions")
    every = inputs(spark, i1="a", i3="a")
    table.refresh(every, "s", run, "1")
    out = table.rescore(every, "s", "m", learn(1.0), "1")
    assert set(scores(out)) == {1}
    for name in ("scores", "final"):
        assert {r.item_id for r in spark.read.parquet(f"{tmp_path}/scores/{name}").collect()} == {1}
    assert all(set(r.asDict()) == {"_key", "sig", "batch"} for r in spark.read.parquet(f"{tmp_path}/scores/done").collect())
    assert table.stale(every, "s").count() == 0


def test_signatures(spark):
    rows = [("a", "exclude", "p", 1, 1.0, "max", [1.0]), ("b", "clear", "n", 2, 0.5, "max", [2.0])]
    kind = "axis string, role string, polarity string, prompt_id long, weight double, aggregation string, vector array<double>"
    of = lambda x, p: st.signature(spark.createDataFrame(x, kind), p)
    assert of(rows, Policy()) == of(rows[::-1], Policy())
    assert len({of(rows, Policy()), of(rows, Policy(threshold=0.5)), of(rows[:1], Policy()), of([(*rows[0][:4], 2.0, *rows[0][5:]), rows[1]], Policy())}) == 4
