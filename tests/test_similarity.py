"""The index of many anchors against all pairs: recall, hidden anchors, copies, hot lists, vectors without a direction."""

import numpy as np
import pytest

from lumigate.operators import similarity as sim

SCHEMA = "item_id long, embedding array<float>"


def plain(items, anchors, n):
    """anchor -> [(similarity, item_id)], best first."""
    ids = np.array([i for i, v in items])
    v = np.array([v for _, v in items], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for a in anchors:
        near = np.round(v @ v[list(ids).index(a)], 12)
        order = sorted((i for i in range(len(ids)) if ids[i] != a), key=lambda i: (-near[i], ids[i]))[:n]
        out[a] = [(near[i], int(ids[i])) for i in order]
    return out


def listed(frame):
    out = {}
    for r in frame.orderBy("anchor", "rank").collect():
        out.setdefault(r.anchor, []).append((r.similarity, r.item_id))
    return out


def same(got, want):
    return {a: [i for _, i in x] for a, x in got.items()} == {a: [i for _, i in x] for a, x in want.items()} and all(abs(x - y) < 1e-9 for a in want for (x, _), (y, _) in zip(got[a], want[a]))


def clusters(n, dim, k, seed, noise=0.35):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(k, dim))
    return [(int(i), (centres[i % k] + noise * rnd.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("noise", [0.35, 5.0])
def test_recall_against_all_pairs(spark, noise):
    """Clustered vectors, and ones that nearly fill the space, where the audit has to widen."""
    items = clusters(3000, 16, 40, 1, noise)
    frame = spark.createDataFrame(items, SCHEMA).repartition(6)
    asked = [i for i, _ in items if i % 20 == 0]
    got = listed(sim.similar_to_each(frame, spark.createDataFrame([(i,) for i in asked], "item_id long"), 10))
    want = plain(items, asked, 10)
    hits = sum(len({i for _, i in got[a]} & {i for _, i in want[a]}) for a in asked)
    assert all(len(got[a]) == 10 for a in asked)
    assert hits / (10 * len(asked)) >= 0.9


def test_probing_all_lists_is_all_pairs_and_fewer_probes_compare_fewer(spark):
    items = clusters(600, 8, 12, 2)
    frame = spark.createDataFrame(items, SCHEMA)
    index = sim.Index(frame, 7)
    asked = sim.units(frame).withColumnRenamed("item_id", "anchor")
    want = plain(items, [i for i, _ in items], 7)
    assert same(listed(index.near(asked, 7, len(index.centres))), want)
    few = listed(index.near(asked, 7, 1))
    assert not same(few, want) and 20 <= len(index.centres) <= 30
    assert same(listed(index.exact(asked.where("anchor < 50"), 7)), {a: want[a] for a in range(50)})


def test_a_hidden_anchor_and_one_without_a_direction_have_no_rows(spark):
    items = clusters(50, 4, 3, 3) + [(60, [0.0] * 4), (61, None), (62, [float("nan")] * 4)]
    frame = spark.createDataFrame(items, SCHEMA)
    got = listed(sim.similar_to_each(frame, spark.createDataFrame([(1,), (1,), (60,), (61,), (62,), (99,), (None,)], "item_id long"), 3))
    assert set(got) == {1} and len(got[1]) == 3 and not {i for _, i in got[1]} & {60, 61, 62}
    assert sim.similar_to_each(frame.limit(0), frame, 3).count() == 0


def test_copies_and_hot_lists(spark, monkeypatch):
    """A third of the rows is one vector, and one list has most others; blocks and anchors' parts are small."""
    monkeypatch.setattr(sim, "BLOCK", 20)
    monkeypatch.setattr(sim, "ANCHORS", 15)
    rnd = np.random.default_rng(4)
    items = [(i, [1.0, 0.0, 0.0]) for i in range(0, 300, 3)] + [(i, [1.0, *(0.1 * rnd.normal(size=2)).astype(np.float32).tolist()]) for i in range(300) if i % 3]
    frame = spark.createDataFrame(items, SCHEMA)
    index = sim.Index(frame, 4, lists=2)
    assert index.entries.count() == 201
    asked = sim.units(frame).withColumnRenamed("item_id", "anchor")
    assert same(listed(index.near(asked, 4, 2)), plain(items, [i for i, _ in items], 4))


def test_extreme_numbers(spark):
    items = [(1, [1e-30, 0.0]), (2, [1e30, 1e29]), (3, [-1e30, 0.0])]
    got = listed(sim.similar_to_each(spark.createDataFrame(items, SCHEMA), spark.createDataFrame([(1,)], "item_id long"), 2))
    assert [i for _, i in got[1]] == [2, 3]


def test_an_anchor_is_sent_once_to_a_block_of_many_lists(spark):
    """Where neighbours are in most lists, an anchor's vector once left its task for every list, all in one piece."""
    items = clusters(600, 8, 12, 2)
    index = sim.Index(spark.createDataFrame(items, SCHEMA), 7)
    asked = sim.units(spark.createDataFrame(items, SCHEMA)).withColumnRenamed("item_id", "anchor")
    rows = sim.sent(asked, index.centres, index.first, index.many, len(index.centres)).collect()
    assert len(index.centres) > 20 and len(rows) == 600  # one block holds all lists
    own = {r["list"] for r in index.entries.select("list").distinct().collect()}
    assert all(set(r.lists) == own for r in rows)


def test_lists_are_packed_into_blocks(monkeypatch):
    monkeypatch.setattr(sim, "BLOCK", 10)
    first, many = sim.packed({0: 4, 1: 6, 2: 1, 4: 25, 5: 9}, 6)
    assert first.tolist() == [0, 0, 1, 0, 2, 5] and many.tolist() == [1, 1, 1, 0, 3, 1]
