"""Counts of texts against plain loops, and the estimates and verdicts against the same steps in numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigate.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, source string"
TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d a b c e", "é ü ß 漢字 #*|<", "l1\n l1\nl1\n\n \nl2\nl1", "a\x1cb c d", "#$%&|<>* end", "a b " * 30_000, "漢" * 5000]


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the words of the contract."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_are_those_of_plain_loops(spark):
    rnd = np.random.default_rng(5)
    texts = TEXTS + ["".join(rnd.choice(list("ab \n|#é"), rnd.integers(0, 80))) for _ in range(300)]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    for r in q.quality(frame).collect():
        want = plain_counts(texts[r.doc_id])
        assert tuple(r[c] for c in q.COUNTS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def corpus(n=700):
    rnd = np.random.default_rng(7)
    words = ["".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        body = list(rnd.choice(words, rnd.integers(60, 300)))
        if i % 23 == 0:
            body = [w + "%%%" for w in body]
        if i % 29 == 0:
            body = ["\n".join(body[:30])] * 3 + body
        lang, source = (None, "src0") if i % 7 == 0 else ("en", "src0" if i % 3 else f"tiny{i % 11}") if i % 5 else ("de", f"few{i % 40}")
        rows.append((i, " ".join(body), lang, source))
    return rows


def plain_verdicts(rows):
    """kept by doc_id: the cells and the concentration steps in numpy, cell by cell."""
    counts = {r[0]: plain_counts(r[1]) for r in rows}
    passing = [r for r in rows if counts[r[0]][0] >= 50 and 100 * counts[r[0]][4] <= 50 * counts[r[0]][0]]
    own, lang = {}, {}
    for r in passing:
        own.setdefault((r[2], r[3]), []).append(r[0])
    for (la, so), ids in list(own.items()):
        if len(ids) < 50:
            lang.setdefault(la, []).extend(own.pop((la, so)))
    rest = [i for la in list(lang) if len(lang[la]) < 50 for i in lang.pop(la)]
    kept, found = {r[0]: False for r in rows}, []
    for ids in [*own.values(), *lang.values(), rest]:
        if len(ids) < 50:
            kept |= dict.fromkeys(ids, True)
            continue
        c = np.array([counts[i] for i in ids], float)
        x = np.stack([np.log1p(c[:, 0]), np.log1p(c[:, 1] / c[:, 0]), *[np.log1p(100 * c[:, k] / c[:, 0]) for k in (2, 3, 4)]], 1)
        x = np.floor(x * 256 + 0.5)
        ridge = np.diag((np.array(q.FLOORS) * 256) ** 2)
        mid = np.median(x, 0)
        cov = np.diag((1.4826 * np.median(abs(x - mid), 0)) ** 2)

        def square():
            z = x - mid
            return np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov + ridge), z)

        def last(share):
            bins = np.floor(np.log2(np.clip(square(), 2.0**-8, 2.0**24)) * 8)
            return bins, np.sort(bins)[int(np.ceil(len(bins) * share)) - 1]

        for _ in range(6):
            bins, top = last(0.75)
            near = x[bins <= top]
            mid, cov = near.mean(0), np.cov(near.T, bias=True)
        scale = max(2 ** ((last(0.5)[1] + 0.5) / 8) / 4.351, 1)
        good = square() / scale <= 35.888
        kept |= dict(zip(ids, map(bool, good)))
        found.append(good.mean())
    return kept, found


def test_verdicts_are_those_of_plain_steps(spark):
    rows = corpus()
    got = {r.doc_id: r.kept for r in q.quality(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want, shares = plain_verdicts(rows)
    assert got == want and len(shares) == 4
    bad = {i for i in range(700) if i % 23 == 0}
    assert not any(got[i] for i in bad)
    assert np.mean([got[i] for i in got if i not in bad and i % 29]) > 0.99


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 3, [(1, "same words " + " ".join(f"w{k}" for k in range(60)), "en", "s")] * 80])
def test_edges(spark, rows):
    """Empty tables, nulls alone, and a cell of equal rows: nothing fails, and equal texts are no outliers."""
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine")).withColumn("cell", F.lit(1)).withColumn("x0", F.lit(9.5)).withColumn("_row", F.lit(3))
    got = q.quality(frame)
    assert {"doc_id", "lang", "source", "x0", "_row", "kept"} <= set(got.columns) and got.columns.count("kept") == 1
    found = got.collect()
    assert len(found) == len(rows) and all(r.kept == (len(rows) == 80) and r.x0 == 9.5 and r._row == 3 for r in found)


def test_a_long_text_takes_time_in_proportion(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(200_000))
    r = q.quality(spark.createDataFrame([(1, long, "en", "s")], SCHEMA)).first()
    assert (r.n_words, r.n_repeat_words) == plain_counts(long)[::4]


def test_no_python_worker_runs(spark):
    rows = q.counted(spark.createDataFrame([(1, "a", "en", "s")], SCHEMA), F.col("doc_id"))
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()
