"""Filling of budgets against a plain loop, and the rows taken against the SQL."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lumigate.llm.mixing import fill, mix, mixing_sql


def plain_fill(children, budget):
    got, left = [0.0] * len(children), set(range(len(children)))
    while left:
        level = (budget - sum(got)) / sum(children[i][1] for i in left)
        full = {i for i in left if children[i][0] <= level * children[i][1]}
        for i in full or left:
            got[i] = children[i][0] if full else max(level, 0) * children[i][1]
        left -= full or left
    return got


def test_fill_is_the_common_level(spark):
    rnd = np.random.default_rng(2)
    rows, expected = [], {}
    for p in range(30):
        children = [(int(rnd.integers(0, 50)), float(rnd.integers(1, 6))) for _ in range(rnd.integers(1, 7))]
        budget = float(rnd.uniform(0, 1.2) * sum(c for c, _ in children))
        for k, ((c, w), got) in enumerate(zip(children, plain_fill(children, budget))):
            rows.append((p, str(k), c, w, budget))
            expected[p, str(k)] = got
    frame = spark.createDataFrame(rows, "p int, source string, capacity long, weight double, b double")
    for r in fill(frame, ["p"], "b", "got").collect():
        assert abs(r.got - expected[r.p, r.source]) < 1e-6


def rows_of(frame):
    return sorted(map(repr, frame.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch").toPandas().itertuples(index=False, name=None)))


def test_rows_taken_are_those_of_the_sql(spark):
    rnd = np.random.default_rng(3)
    data = [(i, "w " * int(rnd.integers(0, 30)), str(rnd.choice(["en", "de", "fr"])), f"src{rnd.integers(0, 20) if i % 3 else 0}") for i in range(900)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = sorted(map(repr, con.sql(mixing_sql()).fetchall()))
    assert want and rows_of(mix(frame)) == want


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, domain string"
    frame = spark.createDataFrame([(None, None, None, None, "x"), (1, "", "en", "src1", "x"), (2, "a b " * 40_000, "en", "src1", "x"), (2, "a b " * 40_000, "en", "src1", "x"), (3, "c", None, "src2", None)], schema)
    everything = mix(frame, total=F.sum("tokens").cast("double"), epochs=1)
    assert everything.agg(F.sum("n_tokens")).first()[0] == 160_001
    assert mix(frame.limit(0)).count() == 0
