"""Images, regions, plug-ins and sinks against plain Python."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumigate.operators import export, refine, regions
from lumigate.sources import images
from lumigate.streaming import streams


def png(pixels):
    """The bytes of a grey image, written by hand."""

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = pixels.shape
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def picture_table(spark, pixels):
    rows = [(i, f"h{i % 2}", (p.shape[1], p.shape[0], bytearray(p.tobytes()))) for i, p in pixels.items()]
    return spark.createDataFrame(rows, "item_id long, content_hash string, image struct<width:int,height:int,data:binary>")


PLAN = "item_id long, region_key string, l int, t int, r int, b int"


def test_images_are_decoded_and_what_is_none_is_listed(spark, tmp_path):
    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "good.PNG").write_bytes(png(pixels))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    good, rejects = images.decode(spark, str(tmp_path))
    row = good.select("image.*").collect()
    assert [(r.width, r.height, bytes(r.data)[: r.width * r.height * r.nChannels]) for r in row] == [(4, 3, pixels.tobytes())]
    assert sorted(r.path.rsplit("/", 1)[1] for r in rejects.collect()) == ["bad.png"]  # files of no bytes aren't listed
    found = images.scan_inventory(spark, str(tmp_path)).select("path", "size").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in found) == [("bad.png", 8), ("good.PNG", len(png(pixels)))]


def test_crops_are_those_of_the_array(spark):
    rnd = np.random.default_rng(3)
    pixels = {i: rnd.integers(0, 256, (20 + i, 30 + i), np.uint8) for i in range(6)}
    plan = [(i, "full", None, None, None, None) for i in range(6)] + [(i, "a", 2, 3, 9 + i, 11) for i in range(0, 6, 2)] + [(1, "outside", 100, 100, 120, 120), (77, "full", None, None, None, None)]
    got = images.crop_regions(picture_table(spark, pixels), spark.createDataFrame(plan, PLAN)).collect()
    want = {(i, "full"): p for i, p in pixels.items()} | {(i, "a"): pixels[i][3:11, 2 : 9 + i] for i in range(0, 6, 2)}
    assert {(r.item_id, r.region_key): (r.width, r.height, bytes(r.data)) for r in got} == {k: (p.shape[1], p.shape[0], p.tobytes()) for k, p in want.items()}
    assert len(got) == len(want)


def test_a_region_is_embedded_once_and_not_if_it_is_cached(spark):
    same = np.arange(100, dtype=np.uint8).reshape(10, 10)
    pixels = {0: same, 1: same + 100, 2: same}
    plan = spark.createDataFrame([(i, k, *box) for i in range(3) for k, box in (("full", (None,) * 4), ("top", (0, 0, 10, 5)))], PLAN)
    cache = spark.createDataFrame([("h0", "m__g1", "full"), ("h1", "m__g0", "top")], "content_hash string, namespace string, region_key string")
    got = images.embed_regions(picture_table(spark, pixels), plan, cache, "m__g1", images.HashEmbedder).collect()
    want = {("h0", "top"): same[:5], ("h1", "full"): pixels[1], ("h1", "top"): pixels[1][:5]}
    assert sorted((r.content_hash, r.region_key) for r in got) == sorted(want)
    for r in got:
        counts = np.bincount(want[r.content_hash, r.region_key].ravel() >> 4, minlength=16)
        assert np.allclose(r.vector, counts / np.linalg.norm(counts)) and r.namespace == "m__g1"


def test_contents_and_prompts_are_embedded_once(spark):
    texts = ["a b", "zz", "a b", ""]
    rows = spark.createDataFrame([(i, f"h{t}", bytearray(t.encode())) for i, t in enumerate(texts)], "item_id long, content_hash string, content binary")
    got = {r.content_hash: r.vector for r in images.embed_distinct(rows, images.HashEmbedder).collect()}
    assert set(got) == {"ha b", "hzz", "h"} and got["h"] == [0.0] * 16
    assert np.allclose(got["ha b"], np.bincount([6, 2, 6], minlength=16) / 5**0.5)
    said = images.embed_prompts(spark.createDataFrame([("a b", 1), ("zz", 2)], "text string, k int"), images.HashEmbedder).collect()
    assert {(r.text, r.k): r.vector for r in said} == {("a b", 1): got["ha b"], ("zz", 2): got["hzz"]}


def test_a_judge_that_fails_gives_null_for_that_item(spark):
    def judge():
        return lambda item: str(10 // (item - 3))

    got = {r.item_id: r.text for r in refine.judged(spark.range(6).withColumnRenamed("id", "item_id"), judge).collect()}
    assert got == {i: None if i == 3 else str(10 // (i - 3)) for i in range(6)}
    assert refine.judged(spark.createDataFrame([], "item_id long"), judge).collect() == []


def test_a_hook_that_fails_leaves_the_rows(spark):
    shown = spark.createDataFrame([(1, 0.5), (2, 0.7)], "item_id long, score double")
    plan = export.result_hook(shown, lambda rows: rows.select("nothing"))
    run = export.result_hook(shown, lambda rows: rows.withColumn("score", F.raise_error(F.lit("stop")).cast("double")))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, run.collect())) == [(1, 0.5), (2, 0.7)]
    more = export.result_hook(shown, lambda rows: rows.where("item_id = 2").union(spark.createDataFrame([(9, 1.0)], rows.schema)))
    assert [tuple(r) for r in more.collect()] == [(2, 0.7)]


def test_rejects_have_their_first_fault(spark):
    rows = spark.createDataFrame([(1, "", 0), (2, None, 5), (3, "x", 0), (4, "x", 2)], "item_id long, text string, size int")
    got = export.rejects(rows, {"no content": F.coalesce("text", F.lit("")) == "", "no size": F.col("size") == 0})
    assert sorted(map(tuple, got.collect())) == [(1, "no content"), (2, "no content"), (3, "no size")]


def test_sinks_write_folders_and_headers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b', "x"), (2, "c", "y")], "item_id long, name string, label string")
    export.write_table(rows, str(tmp_path / "csv"), "csv", ["label"])
    assert sorted(p.name for p in (tmp_path / "csv").iterdir() if p.is_dir()) == ["label=x", "label=y"]
    assert next((tmp_path / "csv/label=y").glob("*.csv")).read_text() == "item_id,name\n2,c\n"
    export.write_table(rows, str(tmp_path / "csv"), "json")  # a second run replaces the first
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(str(tmp_path / "csv")).collect())) == [(1, 'a,"b', "x"), (2, "c", "y")]


def test_a_stream_gives_no_content_that_is_known_or_given_before(spark, tmp_path):
    kind = "content_hash string, at timestamp"
    stamp = F.timestamp_seconds(F.lit(1_600_000_000))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("k",)], "content_hash string")
    for batch in (["a", "b", "a", "k"], ["b", "c", "k"]):
        spark.createDataFrame([(x,) for x in batch], "content_hash string").withColumn("at", stamp).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.run_available(streams.stream_dedup(stream, "at", known=known), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.content_hash for r in spark.read.schema(kind).parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_new_files_reach_the_stream_of_an_inventory_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.bin", "b.bin"):
        (tmp_path / "in" / name).write_bytes(name.encode())
        streams.run_available(streams.stream_inventory(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.size for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [5, 5]


def test_images_are_never_broadcast_and_made_after_the_join(spark):
    """The planner takes any column of bytes for small: pixels must neither be sent to the driver nor through a join."""
    rows = spark.createDataFrame([(i, 60, 50) for i in range(4)], "item_id long, width int, height int")
    plan = spark.createDataFrame([(i, k, *box) for i in range(3) for k, box in (("full", (None,) * 4), ("a", (5, 0, 15, 50)))], PLAN)
    image = F.struct("width", "height", F.expr("cast(rpad('', width * height, cast(item_id as string)) as binary)").alias("data"))
    stored = rows.select("item_id", image.alias("image"))
    got = images.crop_regions(rows, plan, image)
    want = {(i, k): (w, 50, str(i).encode() * (w * 50)) for i in range(3) for k, w in (("full", 60), ("a", 10))}
    for frame in (got, images.crop_regions(stored, plan)):
        assert {(r.item_id, r.region_key): (r.width, r.height, bytes(r.data)) for r in frame.collect()} == want
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("rpad") < text.index("Repartition") < text.index("Join")
    assert "BroadcastHashJoin" not in images.crop_regions(stored, plan)._jdf.queryExecution().executedPlan().toString()


def test_a_content_of_several_items_is_embedded_from_one_of_them(spark):
    rows = spark.createDataFrame([(i, f"h{i % 2}", 60, 50) for i in range(6)], "item_id long, content_hash string, width int, height int")
    image = F.struct("width", "height", F.expr("cast(rpad('', width * height, content_hash) as binary)").alias("data"))
    plan = spark.createDataFrame([(i, "full", None, None, None, None) for i in range(6)], PLAN)
    cache = spark.createDataFrame([], "content_hash string, namespace string, region_key string")
    got = images.embed_regions(rows, plan, cache, "m", images.HashEmbedder, image)
    assert sorted((r.content_hash, r.namespace, r.region_key) for r in got.collect()) == [("h0", "m", "full"), ("h1", "m", "full")]


def test_a_file_longer_than_any_picture_is_a_reject_that_no_task_reads(spark, tmp_path):
    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "good.png").write_bytes(png(pixels))
    (tmp_path / "bad.png").write_bytes(b"no image")
    with (tmp_path / "long.bin").open("wb") as f:
        f.truncate(2_200_000_000)  # a hole; no array of the JVM holds so many bytes
    good, rejects = images.decode(spark, str(tmp_path))
    assert [r.width for r in good.select("image.width").collect()] == [4]
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in rejects.collect()) == [("bad.png", "can't be decoded"), ("long.bin", "can't be decoded")]


SMALL = "/root/testdata/sf0.001"
FRAMES = "item_id long, content_hash string, width int, height int, anchors array<struct<x:int,y:int,w:int,h:int,score:double>>"


def frames_and_geometry(spark):
    anchor = lambda x, y, w, h: (x, y, w, h, 1.0)
    four = [anchor(10, 20, 60, 70), anchor(100, 30, 90, 80), anchor(5, 5, 50, 50), anchor(7, 7, 51, 51)]
    rows = [(0, "h0", 300, 200, None), (1, "h1", 300, 300, []), (2, "h2", 400, 300, four), (3, "h3", 0, 0, None), (4, "h4", 60, 40, [anchor(0, 0, 9, 9)]), (5, "h2", 400, 300, four)]
    return spark.createDataFrame(rows, FRAMES), spark.createDataFrame([("near", -0.5, -0.5, 1.5, 1.5), ("wide", -2.0, 0.5, 3.0, 5.0)], "kind string, dx0 double, dy0 double, dx1 double, dy1 double")


def pixels_of(row):
    size = row["width"] * row["height"]
    return (np.arange(size) * 7 + int(row["content_hash"][1:])).astype(np.uint8).reshape(row["height"], row["width"], 1)


def test_boxes_beside_a_frame_are_those_of_the_plan(spark):
    frames, geometry = frames_and_geometry(spark)
    got = regions.plan_boxes(frames, geometry).select("item_id", F.inline("boxes"))
    want = regions.plan_regions(frames, geometry)
    assert got.columns == want.columns and want.count() > 20
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_regions_of_images_that_tasks_make_from_frames_with_boxes(spark):
    frames, geometry = frames_and_geometry(spark)
    plan = [r.asDict() for r in regions.plan_regions(frames, geometry).where("item_id <> 3").collect()]
    rows = {r.item_id: pixels_of(r.asDict()) for r in frames.where("item_id <> 3").collect()}
    names = {0: "h0", 1: "h1", 2: "h2", 4: "h4", 5: "h2"}
    cut = lambda p: rows[p["item_id"]][p["t"] : p["b"], p["l"] : p["r"]]
    want = {(names[p["item_id"]], p["region_key"]): cut(p) for p in plan if (p["item_id"], p["region_key"]) != (0, "full")}
    cache = spark.createDataFrame([("h0", "m", "full"), ("h1", "other", "full")], "content_hash string, namespace string, region_key string")
    boxed = regions.plan_boxes(images.deal(frames, "item_id"), geometry)
    by_rows = images.embed_regions(frames, regions.plan_regions(frames, geometry), cache, "m", images.HashEmbedder, pixels_of)
    for out in (images.embed_regions(boxed, None, cache, "m", images.HashEmbedder, pixels_of), by_rows):
        got = out.collect()
        assert sorted((r.content_hash, r.region_key) for r in got) == sorted(want)
        for r in got:
            counts = np.bincount(want[r.content_hash, r.region_key].ravel() >> 4, minlength=16)
            assert np.allclose(r.vector, counts / np.linalg.norm(counts))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_regions_of_frames_are_embedded_with_one_join_by_key(spark):
    """Pixels are made by the task that cuts them, and what makes them goes with the boxes instead of joining them again."""
    frame = __spark_entry__.queries()["region_embed"](spark, SMALL)
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "rpad" not in text and text.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in text


def test_classes_of_bytes_are_those_of_a_plain_count():
    rnd = np.random.default_rng(5)
    texts = [b"", b"7", b"0123456789" * 50, bytes(range(256)), bytes(200), rnd.integers(0, 256, 10_000, np.uint8).tobytes(), rnd.integers(40, 90, 999, np.uint8).tobytes()]
    for t, v in zip(texts, images.HashEmbedder().embed([memoryview(t) for t in texts])):
        counts = np.bincount(np.frombuffer(t, np.uint8) >> 4, minlength=16)
        assert np.allclose(v, counts / max(np.linalg.norm(counts), 1e-12))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_crops_of_frames_join_nothing_and_leave_their_bytes_in_the_task(spark):
    out = __spark_entry__.queries()["crop_regions"](spark, SMALL)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "rpad" not in text and "SortMergeJoin" not in text and "BroadcastHashJoin" not in text
    assert out.columns == ["item_id", "region_key", "width", "height"] and "data#" not in text


def test_crops_without_their_bytes_have_the_sizes_of_those_with_them(spark):
    frames, geometry = frames_and_geometry(spark)
    boxed = regions.plan_boxes(images.deal(frames, "item_id"), geometry)
    full = images.crop_regions(boxed, image=pixels_of).collect()
    rows = {r.item_id: pixels_of(r.asDict()) for r in frames.collect()}
    plan = [r for r in regions.plan_regions(frames, geometry).collect() if r.item_id != 3]  # a frame without pixels has no crop
    assert {(r.item_id, r.region_key): bytes(r.data) for r in full} == {(p.item_id, p.region_key): rows[p.item_id][p.t : p.b, p.l : p.r].tobytes() for p in plan}
    sizes = images.crop_regions(boxed, image=pixels_of, data=False).collect()
    assert sorted((r.item_id, r.region_key, r.width, r.height) for r in full) == sorted(map(tuple, sizes)) and len(sizes) == len(plan)
