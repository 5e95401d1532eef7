"""Nodes against plain loops over prefixes and against the SQL; double arrays against a set of prefixes."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from lumigate.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = {}
    tie = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", tie(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(leader, [])[:h] + turns[h:]
    return out


def plain(made):
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = {x for x in under if len(x) == len(node) + 1}
        childless = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def listed(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def corpus(seed=1):
    rnd = np.random.default_rng(seed)
    rows, texts = [], [None, "", "hé", "漢字", *[f"turn {i}" for i in range(12)]]
    for c in [*range(-9, 40), 101, 103, 2**40 + 3]:
        if c % 7 == 3:
            continue
        first = 0 if c % 3 else rnd.integers(0, 14)
        for k in range(int(rnd.integers(1, 12)) if c != 25 else 40):
            rows.append((c, None if k == 2 else k, [None, "", "user", "system"][(k + c // 9) % 4], texts[(first + k) % 14 if c % 2 else rnd.integers(0, 14)]))
    # one conversation again and again, repeated rows, equal turns, rows without a conversation
    rows += [(c, k, "user", f"same {k}") for c in range(200, 260) for k in range(12)]
    rows += [(5, 1, "user", "again")] * 3 + [(5, 1, None, "b"), (None, 1, "user", "x")]
    return rows


@pytest.fixture(params=[(pt.BLOCK, pt.PIECE, pt.NEAR), (25, 4, 1), (7, 1, 2)])
def sizes(request, monkeypatch):
    for name, value in zip(("BLOCK", "PIECE", "NEAR"), request.param):
        monkeypatch.setattr(pt, name, value)


def test_nodes_are_those_of_plain_loops_and_of_the_sql(spark, sizes):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], SCHEMA + ", key double").repartition(5)
    got = listed(pt.nodes(pt.rebuilt(frame)))
    assert got == plain(plain_rebuilt(rows))
    con = duckdb.connect()
    con.register("conversations", frame.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({pt.SQL})").fetchall(), key=str) == got


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(1, None, None, None)], [(3, 0, "a", "b")], [(4, 0, "u", "long " * 300_000)] * 2])
def test_edges(spark, rows):
    assert listed(pt.nodes(pt.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == plain(plain_rebuilt(rows))


def test_a_deep_shared_path(spark, monkeypatch):
    """Long common beginnings over several blocks: what blocks count twice is taken off every ancestor."""
    monkeypatch.setattr(pt, "BLOCK", 300)
    rows = [(5 * c, k, "u", f"t{k}" if k < 150 else f"{c}-{k}") for c in range(1, 9) for k in range(155)]
    made = plain_rebuilt(rows)
    got = listed(pt.nodes(pt.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == plain(made) and len(got) == 151 + 8 * 5


def test_double_arrays_hold_all_prefixes_and_no_others():
    rnd = np.random.default_rng(4)
    seqs = sorted({tuple(rnd.integers(0, 30, rnd.integers(0, 7)).tolist()) for _ in range(3000)})
    trie = pt.DoubleArray(seqs)
    states = {(): 0}
    for s in seqs:
        for d, t in enumerate(trie.walk(s), 1):
            assert states.setdefault(s[:d], t) == t
    assert len(set(states.values())) == len(states) == len(trie.order) + 1
    for p, s in list(states.items())[:400]:
        assert [trie.step(s, c) for c in range(30)] == [states.get((*p, c), -1) for c in range(30)]
    assert len(trie.check) < 2 * len(states)
