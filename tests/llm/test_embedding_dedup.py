"""Links and components against all cosines, and the graph's recall."""

import numpy as np

from lumigate.llm import embedding_dedup
from lumigate.llm.embedding_dedup import near_duplicates, recall, searched
from lumigate.llm.hnsw import Graph, near


def clumps(seed, n, d=16):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(n // 6, d))
    v = centres[rnd.integers(0, len(centres), n)] + rnd.normal(size=(n, d)) * rnd.choice([0.05, 0.15, 0.4], (n, 1))
    v[: n // 5] = centres[0] + rnd.normal(size=(n // 5, d)) * 0.02
    return v.astype(np.float32)


def brute(rows):
    good = [(i, k, np.array(v, np.float64)) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, k, a) in enumerate(good):
        for j, m, b in good[x + 1 :]:
            if k == m and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def test_links_and_components_are_those_of_all_cosines(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 40)
    v = clumps(3, 700)
    rows = [(int(i), [float(x) for x in v[i]], int(i % 3 if i % 2 else 0)) for i in range(700)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [float("inf")] * 16, 1), (905, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_duplicates(frame.union(frame.limit(3))).collect()
    want = brute(rows)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert near_duplicates(frame.limit(0)).count() == 0
    null = near_duplicates(spark.createDataFrame([(None, [1.0], 1)], frame.schema)).first()
    assert (null.n_links, null.component_id, null.kept) == (0, None, False)


def test_recall_of_the_graph_and_of_widened_beams():
    v = clumps(5, 3000, 32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph.build(v)
    truth = v @ v.T
    top = np.argsort(-truth, axis=1)[:, :10]
    ids, _ = graph.search(v, 64)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), top.tolist())]) > 0.9
    want = truth >= 0.93
    found, true, hit = near(graph, v, 0.93, beam=32, whole=4)
    assert (found & want).sum() / want.sum() > 0.99 and hit >= 0.99 * true > 0
    again = Graph.load(v, **graph.dump())
    assert (again.search(v[:50], 32)[0] == graph.search(v[:50], 32)[0]).all()


def test_large_labels_long_vectors_and_the_recall_of_audits(spark):
    rnd = np.random.default_rng(8)
    a, b = rnd.normal(size=3072), rnd.normal(size=2200)
    rows = [(i, [float(x) for x in v], 2**40 + k) for i, (v, k) in enumerate([(a, 0), (a * 2, 0), (a, 1), (b, 0), (b + 0.01, 0), (a[:2200], 0)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(frame.withColumn("dim", frame.label)).collect()} == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
    assert recall(searched(frame)).first().recall == 1
