"""What the join of shingle sets costs besides its pairs: driver memory, rounds, and rows read from turn to turn."""

import tracemalloc

import numpy as np

from lumigate.llm import base, ngram_join
from lumigate.llm.ngram_join import Join, frequency_bitmaps, similar_documents


def plain_components(edges):
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return low


def test_bitmaps_take_no_byte_for_each_bit_on_the_driver(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f{i % 3}") for i in range(30)], "doc_id long, text string")
    tracemalloc.start()
    often, very = frequency_bitmaps(docs, Join(2, 80, 8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(often) == len(very) == 1 << (ngram_join.FREQUENCY_BITS - 3)
    assert peak < 80_000_000  # 16 MB that stay, the rows they come from, and little else
    ones = [int(np.unpackbits(x).sum()) for x in (often, very)]
    assert 0 < ones[0] and ones[1] == 0


def test_few_edges_take_no_rounds(spark, monkeypatch):
    written, was = [], base.stored
    monkeypatch.setattr(base, "stored", lambda df, name, *a: written.append(name) or was(df, name, *a))
    path = [(i, i + 1) for i in range(0, 600, 2)] + [(i + 1, i + 2) for i in range(0, 600, 2)] + [(900, 901), (7, 7)]
    edges = spark.createDataFrame(path, "a long, b long").repartition(6)
    assert {r.node: r.component for r in base.components(edges).collect()} == plain_components(path[:-1])
    assert len(written) <= 2


def test_components_of_more_edges_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(base, "HELD_EDGES", 20)
    rnd = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    for kind in ("long", "string"):
        rows = [tuple(f"{x:05d}" if kind == "string" else x for x in e) for e in edges]
        got = base.components(spark.createDataFrame(rows, f"a {kind}, b {kind}").repartition(7)).collect()
        assert {r.node: r.component for r in got} == plain_components([e for e in rows if e[0] != e[1]])
    assert base.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_turns_of_stars_read_large_groups_only(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 12, raising=False)
    monkeypatch.setattr(ngram_join, "BLOCK", 12)
    read, was = [], ngram_join.open_members
    monkeypatch.setattr(ngram_join, "open_members", lambda m, c: read.append(m.groupBy("tok").count().agg({"count": "min"}).first()[0]) or was(m, c))
    rnd = np.random.default_rng(9)
    rows = []
    for size in [4] * 10 + [40]:
        base_words = [f"v{x}" for x in rnd.integers(0, 10**6, 80)]
        for _ in range(size):
            w = list(base_words)
            for _ in range(int(rnd.integers(2, 6))):
                w[rnd.integers(0, 80)] = f"z{rnd.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    got, _ = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Join(4, 85))
    from tests.llm.test_ngram_join import brute

    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 4, 85)
    assert len(read) > 1 and min(read[1:]) > 12
