"""The vector store: batches that run twice, namespaces that prune, streams without their checkpoint, versions, compaction."""

import pytest
from pyspark.sql import functions as F

from lumigate.operators import vector_store as vs


def embed(rows):
    return rows.select("content_hash", F.array(F.length("content_hash").cast("double")).alias("vector"))


def contents(spark, *hashes):
    return spark.createDataFrame([(h, i) for i, h in enumerate(hashes)], "content_hash string, other int")


def rows_of(frame):
    return sorted((r.namespace, r.batch, r.content_hash) for r in frame.collect())


@pytest.fixture
def store(spark, tmp_path):
    return vs.VectorStore(spark, f"file://{tmp_path}/store")


def test_a_batch_that_runs_twice_adds_nothing(spark, store):
    assert store.read().count() == 0
    store.fill(contents(spark, "a", "b", "b", None), "m", embed, "1")
    store.fill(contents(spark, "b", "c"), "m", embed, "2")
    before = rows_of(store.read())
    assert before == [("m", "1", "a"), ("m", "1", "b"), ("m", "2", "c")]
    for batch, of in (("2", ("b", "c")), ("1", ("a", "b", "b")), ("3", ("a", "c"))):
        store.fill(contents(spark, *of), "m", embed, batch)
    assert rows_of(store.read()) == before
    store.fill(contents(spark, "a"), "n", embed, "1")
    assert rows_of(store.read("n")) == [("n", "1", "a")]


def test_many_new_contents_take_the_way_without_a_broadcast(spark, store, monkeypatch):
    store.fill(contents(spark, "a", "b"), "m", embed, "1")
    monkeypatch.setattr(vs, "BROADCAST_HASHES", 1)
    assert [r.content_hash for r in store.missing(contents(spark, "b", "d", "d"), "m").collect()] == ["d"]


def test_a_namespace_and_a_batch_are_filters_on_folders(spark, store):
    store.fill(contents(spark, "a"), "m", embed, "1")
    store.fill(contents(spark, "b"), "n", embed, "1")
    plan = store.read("m")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan and "(namespace#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert len(store.read("m").inputFiles()) >= 1 and store.read("m").count() == 1


def test_only_missing_contents_reach_the_model(spark, store):
    store.fill(contents(spark, "a", "b"), "m", embed, "1")
    seen = []

    def counting(rows):
        seen.append(sorted(r.content_hash for r in rows.collect()))
        return embed(rows)

    store.fill(contents(spark, "a", "b", "c"), "m", counting, "2")
    assert seen == [["c"]]


def test_streams_and_lost_checkpoints(spark, store, tmp_path):
    folder = f"file://{tmp_path}/in"
    stream = lambda: spark.readStream.schema("content_hash string, other int").option("maxFilesPerTrigger", 1).parquet(folder)
    for of in (("a", "b"), ("b", "c")):
        contents(spark, *of).coalesce(1).write.mode("append").parquet(folder)
    store.fill_from(stream(), "m", embed, f"{tmp_path}/one", "one").awaitTermination()
    first = rows_of(store.read())
    assert [r[2] for r in first] == ["a", "b", "c"] and {r[1] for r in first} == {"one-0", "one-1"}
    # the same run without its checkpoint replays its batches; another run finds nothing new
    store.fill_from(stream(), "m", embed, f"{tmp_path}/lost", "one").awaitTermination()
    store.fill_from(stream(), "m", embed, f"{tmp_path}/two", "two").awaitTermination()
    assert sorted(r[2] for r in rows_of(store.read())) == ["a", "b", "c"]


def test_a_stream_gives_each_content_once_over_runs(spark, store, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: spark.readStream.schema("content_hash string, other int").parquet(folder)
    for n, of in enumerate((("a", "b", "a"), ("b", "c"), ("c", "a"))):
        contents(spark, *of).coalesce(1).write.mode("append").parquet(folder)
        vs.give_once(stream(), store, "given", f"{tmp_path}/checkpoint{n // 2}", out, f"run{n // 2}").awaitTermination()
    assert sorted(r.content_hash for r in spark.read.parquet(f"{out}/*").collect()) == ["a", "b", "c"]


def test_versions_and_compaction(spark, store, tmp_path):
    for i in range(3):
        store.fill(contents(spark, f"x{i}", "a"), "m", embed, str(i))
    store.compact("m")
    assert {r[1] for r in rows_of(store.read())} == {"compact0"} and sorted(r[2] for r in rows_of(store.read())) == ["a", "x0", "x1", "x2"]
    store.compact("m")
    newer = vs.VectorStore(spark, store.path, version=2)
    assert newer.read().count() == 0 and newer.missing(contents(spark, "a"), "m").count() == 1
    newer.fill(contents(spark, "a"), "m", embed, "v2")
    assert newer.read().count() == 1 and store.read().count() == 4


@pytest.mark.parametrize("name", ["", "a/b", "../x", "a=b"])
def test_names_that_are_no_folders(spark, store, name):
    with pytest.raises(ValueError):
        store.fill(contents(spark, "a"), name, embed, "1")
