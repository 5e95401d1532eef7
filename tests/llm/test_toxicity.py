"""The classifier on rows that were not learned from, and its edge cases."""

import tracemalloc
import zlib

import numpy as np
from pyspark import SparkContext
from pyspark.sql import functions as F

from lumigate.llm.toxicity import Model, WordHashes, bias_of, features, fit, ftrl_pass, op2_toxicity, toxicity, training_rows, weights

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n=600):
    rnd = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = list(rnd.choice(WORDS, rnd.integers(5, 40)))
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(rnd.integers(0, len(words)), "vile scum")
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus(spark)
    docs = spark.createDataFrame([*rows, (None, None, 1.0), (9001, "", 1.0), (9002, "x " * 50_000, 1.0), (9002, "x " * 50_000, 1.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity(docs, marks).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in out if r.held_out} == {r.doc_id for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert len(held) > 100 and right > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in out)


def test_the_fit_never_sees_held_out_rows_and_is_bounded(spark):
    rows, labels = corpus(spark, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n double")
    got = training_rows(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Model(max_rows=50)).collect()
    assert len(got) == 50 and not [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity(docs, none).collect()] == [0.5]
    assert toxicity(docs.limit(0), none).count() == 0


def test_features_are_words_pairs_and_skip_pairs():
    assert [len(features(t, WordHashes(), 20)) for t in ("", "a", "a b", "a b c d")] == [0, 1, 3, 4 + 3 + 2 + 1]


def test_the_query_learns_nothing_from_held_out_labels(spark, tmp_path):
    rows, labels = corpus(spark, 400)
    scores = []
    for name, turn in (("as", 0), ("turned", 1)):
        marks = [(i, q, t ^ turn if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, "xx" if turn else "en", f"s{turn}") for i, t, _ in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
        out = op2_toxicity(spark, at)
        assert {"doc_id", "held_out", "score", "predicted"} <= set(out.columns)
        scores.append({r.doc_id: (r.held_out, r.score, r.predicted) for r in out.collect()})
    assert scores[0] == scores[1] and len(scores[0]) == 400
    truth = {i: t for i, _, t in labels}
    right = np.mean([p == truth[i] for i, (held, _, p) in scores[0].items() if held])
    assert right > 0.95


def test_the_fit_sends_no_state_through_the_driver(spark, monkeypatch):
    rows, labels = corpus(spark, 120)
    truth = {i: t for i, _, t in labels}
    docs = spark.createDataFrame([(i, t, truth[i]) for i, t, _ in rows], "doc_id long, text string, y int").repartition(3)
    sent, was = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda sc, value: sent.append(value) or was(sc, value))
    m = Model(bits=19, epochs=3)
    tracemalloc.start()
    at, w, bias = fit(docs, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not sent
    assert peak < 2_000_000  # a state of 2**19 coordinates takes 4 MB
    turns = {r.doc_id: r.turn for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("turn")).alias("turn")).collect()}
    z, n = (np.zeros((1 << m.bits) + 1, np.float32) for _ in range(2))
    shards = [sorted((turns[i], truth[i], t) for i, t, _ in rows if turns[i] % m.shards == k) for k in range(m.shards)]
    for epoch in range(m.epochs):
        z0, n0 = z.copy(), n.copy()
        for shard in shards:
            z1, n1 = z0.astype(np.float64), n0.astype(np.float64)
            order = np.random.default_rng(epoch).permutation(len(shard))
            ftrl_pass(((np.unique(features(shard[i][2], WordHashes(), m.bits)).astype(np.int64), shard[i][1]) for i in order), z1, n1, m)
            z += ((z1 - z0).astype(np.float32)) / m.shards
            n += ((n1 - n0).astype(np.float32)) / m.shards
    plain = weights(z[:-1], n[:-1], m)
    assert at.tolist() == np.flatnonzero(plain).tolist() and len(at) > 20
    assert np.allclose(w, plain[at], atol=1e-5) and abs(bias - bias_of(z[-1], n[-1])) < 1e-6
