"""Names of a manifest against a loop that goes on until one is free."""

import re

import numpy as np

from lumigate.operators.export import manifest, result_counts


def suffixed(name, k):
    ext = (re.search(r"(?<=[^/])(\.[^./]+)$", name) or [""])[0]
    return f"{name[: len(name) - len(ext)]}_{k}{ext}"


def plain(rows, existing):
    """The first row of a wanted name has it; then, name by name in order of item_id, the next free number."""
    taken, out, later = set(existing), {}, []
    for i, folder, name in sorted(rows):
        wanted = f"{folder}/{name}" if folder else name
        if wanted in taken:
            later.append((wanted.endswith("."), wanted, i))
        else:
            out[i] = wanted
            taken.add(wanted)
    for _, wanted, i in sorted(later):
        k = 1
        while (name := suffixed(wanted, k)) in taken:
            k += 1
        out[i] = name
        taken.add(name)
    return out


def test_every_row_gets_the_next_free_name(spark):
    rnd = np.random.default_rng(9)
    names = ["a.txt", "a_1.txt", "a_3.txt", "b", "b_1", ".rc", "c.tar.gz", "b_2.", "b._1", "b_2._1"]
    rows = [(i, "d" if i % 2 else "", names[int(rnd.integers(0, len(names)))] if i % 3 else "a.txt") for i in range(600)]
    existing = ["a.txt", *[f"a_{k}.txt" for k in range(1, 40)], "d/a_7.txt", "d/a_9.txt", "d/a_1000000.txt", "d/a_12345678901234567890123.txt", "b_01", ".rc_2", "b._1", "d/b_2", "d/b_3"]
    got = manifest(spark.createDataFrame(rows, "item_id long, folder string, name string").repartition(5), spark.createDataFrame([(x,) for x in existing], "destination string"))
    out = {r.item_id: r for r in got.collect()}
    assert {i: r.destination for i, r in out.items()} == plain(rows, existing)
    assert len(out) == 600 and len({r.destination for r in out.values()} | set(existing)) == 600 + len(existing)
    assert {r.action for r in out.values()} == {"copy"}
    assert sum(r.n for r in result_counts(got).collect()) == 600
    null = spark.createDataFrame([(1, "", None), (2, "", None), (3, "", "x")], "item_id long, folder string, name string")
    assert sorted(r.item_id for r in manifest(null, spark.createDataFrame([], "destination string")).collect()) == [1, 2, 3]


def test_a_sink_that_is_handed_excluded_rows_writes_none(spark, tmp_path):
    from lumigate.operators import export
    from lumigate.operators.cascade import evaluate
    from lumigate.policy import Policy
    from tests.test_gates import CASES, REG, case

    ev = evaluate(case(spark, [c[:5] for c in CASES]), Policy(), REG)
    seen = {c[0] for c in CASES if c[5] == "scored"}
    export.write_decisions(ev, Policy(), f"{tmp_path}/decisions")
    assert {r.item_id for r in spark.read.parquet(f"{tmp_path}/decisions").collect()} == seen
    pairs = spark.createDataFrame([(a, b) for a in range(1, 12) for b in range(1, 12)] + [(None, 1), (1, None)], "item_id long, similar_id long")
    export.write_items(pairs, ev, Policy(), f"{tmp_path}/pairs", "json", ids=("item_id", "similar_id"))
    assert {(r.item_id, r.similar_id) for r in spark.read.json(f"{tmp_path}/pairs").collect()} == {(a, b) for a in seen for b in seen}


def test_a_failing_hook_is_logged(spark, caplog):
    from lumigate.operators import export

    rows = spark.range(2).withColumnRenamed("id", "item_id")
    assert export.result_hook(rows, lambda r: r.select("no_such_column")) is rows
    assert "a result hook failed" in caplog.text
