"""The audit against a plain loop over rows, orders and steps; files in any order; batches that run again."""

import itertools
import re

import duckdb
import numpy as np
import pytest

from lumigate.llm import filter_audit as fa

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    out += "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows) else "")


def plain(rows, labels):
    found = [(p or "", fails(t or "", d, rows), any(a == d and q == 1 for a, q, _ in labels), any(a == d and x == 1 for a, _, x in labels)) for d, t, p in rows]
    out, orders = [], ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {f[0] for f in found}:
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = [f for f in found if f[0] == part]
            gone = []
            for k, name in enumerate(order):
                here = [f for f in left if name in f[1]]
                row = (part, order, k + 1, len(left) - len(here), len(here), sum(name in f[1] for f in gone), sum(f[0] == part and f[1] == name for f in found), sum(f[2] for f in here), sum(f[3] for f in here))
                steps.append((name, row))
                shapley[name] += len(here)
                left, gone = [f for f in left if name not in f[1]], gone + here
        out += [(*row, shapley[name]) for name, row in steps]
    return sorted(out)


def corpus(seed=3, n=160):
    rnd = np.random.default_rng(seed)
    bodies = [" ".join(rnd.choice(["Ab", "cd", "EF", "gh$", "é"] + [f"w{i}" for i in range(300 if k % 3 else 20)], rnd.integers(0, 260))) for k in range(40)]
    bodies += [None, "", "  ", "a\x1cb", "A" * 5000]
    rows = [(int(rnd.integers(0, 90)) if i % 11 else None, bodies[min(int(rnd.exponential(9)), len(bodies) - 1)], [None, "", "en", "de"][rnd.integers(0, 4)]) for i in range(n)]
    labels = [(int(i), int(rnd.integers(0, 2)) if i % 3 else None, int(rnd.integers(0, 2))) for i in rnd.integers(0, 110, 80)]
    return rows, labels


def files(spark, rows, folder, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n], "doc_id long, text string, lang string").selectExpr("*", "'x' as part", "1.5 as bits", "'k' as key").coalesce(1).write.mode("append").parquet(folder)


def listed(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_rows_are_those_of_a_plain_loop_and_of_the_sql(spark, tmp_path):
    rows, labels = corpus()
    files(spark, sorted(rows, key=lambda r: -(r[0] or 0)), f"{tmp_path}/docs", 6)
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = listed(fa.audit(spark, f"{tmp_path}/docs", of, batches=6))
    assert got == plain(rows, labels)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    con.register("labels", of.toPandas())
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({fa.SQL})").fetchall()) == got


def test_smaller_ids_in_later_calls_retract_earlier_counts(spark, tmp_path):
    """The same work folder reads new files only, and the counts end as if all had been there at first."""
    rows, labels = corpus(8, 60)
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    later = sorted(rows, key=lambda r: -(r[0] or 0))
    files(spark, later[:30], f"{tmp_path}/docs", 1)
    first = listed(fa.audit(spark, f"{tmp_path}/docs", of, f"file://{tmp_path}/work"))
    assert first == plain(later[:30], labels)
    files(spark, later[30:], f"{tmp_path}/docs", 2)
    assert listed(fa.audit(spark, f"{tmp_path}/docs", of, f"file://{tmp_path}/work")) == plain(rows, labels)
    assert len({p.name for p in (tmp_path / "work/changes").glob("batch=*")}) >= 3
    again = listed(fa.audit(spark, f"{tmp_path}/docs", of, f"file://{tmp_path}/work"))
    assert again == plain(rows, labels)


def test_small_flushes_and_a_hot_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fa, "HELD", 3)
    monkeypatch.setattr(fa, "GROUP", 40)
    rows = [(900 - i, "the same text" if i % 3 else f"other {i}", "en") for i in range(300)]
    files(spark, rows, f"{tmp_path}/docs", 3)
    got = listed(fa.audit(spark, f"{tmp_path}/docs", spark.createDataFrame([], "doc_id long, quality int, toxic int"), batches=3))
    assert got == plain(rows, [])


def test_an_empty_table(spark, tmp_path):
    files(spark, [], f"{tmp_path}/docs", 1)
    assert listed(fa.audit(spark, f"{tmp_path}/docs", spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == []


@pytest.mark.parametrize("text", ["", " ", "a b", "A", "x" * 3_000_000, "w " * 1_000_000, "é#"])
def test_masks(text):
    assert fa.own_mask(text) == sum(fa.BIT[f] for f in fails(text, 1, []))
