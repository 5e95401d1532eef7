"""Chunks, and what is removed against a plain loop of its own over lines."""

import numpy as np
import xxhash

from lumigate.llm.line_dedup import EVERY, chunks, dedup_lines, weights

WORDS = "a bc def ghij klmno } { if then".split()


def prose(rnd, low, high):
    return " ".join(f"w{k}" for k in rnd.integers(0, 10**6, rnd.integers(low, high)))


def test_chunks_share_lines_and_resist_shifts():
    rnd = np.random.default_rng(4)
    lines = [prose(rnd, 0, 12).encode() for _ in range(300)]
    cut = chunks(lines, weights(lines))
    assert [s for s, _ in cut][1:] == [e - 1 for _, e in cut][:-1]
    assert all(e - s >= 2 for s, e in cut)
    assert {i for i, x in enumerate(lines) if len(x.split()) >= EVERY} <= {s for s, _ in cut} | {e - 1 for _, e in cut}
    for gone in (1, 2, 50):
        rest = lines[gone:]
        same = {tuple(lines[s:e]) for s, e in cut if s > gone} - {tuple(rest[s:e]) for s, e in chunks(rest, weights(rest))}
        assert not same
    blank = [b""] * 500
    assert not chunks(blank, weights(blank))


def plain(texts):
    """Kept lines of each text: the docstring's rules, one text after the other, with Python's whole numbers and no shared code."""
    big, seen, out = 1 << 64, {}, []
    for text in texts:
        lines = [x.encode() for x in text.split("\n")] if text else []
        size = [max(len(x.split()), len(x) // 16) for x in lines]
        h = [xxhash.xxh3_64_intdigest(x) for x in lines]
        marks, run = [], 0
        for i in range(len(lines)):
            r = h[i] if i == 0 else h[i] ^ ((h[i - 1] * 128) % big + h[i - 1] // (1 << 57))
            here = (r * 0x9E3779B97F4A7C15 % big) // (1 << 32) * 8 < min(size[i], 8) * (1 << 32)
            run = run + 1 if i and lines[i] == lines[i - 1] else 0
            if run and size[i] > 1:
                here = run * size[i] % 8 < size[i]
            if here or marks and i - marks[-1] == 64 and i < len(lines):
                marks.append(i)
        found = [(a, b) for a, b in zip(marks, marks[1:]) if sum(size[a : b + 1]) >= 8]
        REACH[id(lines)] = found, size
        KEEP.append(lines)
        drop = set()
        for a, b in sorted(found + [(i, i) for i in range(len(lines)) if size[i] > 25]):
            block = tuple(lines[a : b + 1])
            if block not in seen:
                seen[block] = (lines, a, b)
                continue
            theirs, x, y = seen[block]
            more = set(range(a, b + 1))
            low = max([p + (size[p] >= 8) for p, q in found if q <= a], default=0)
            high = min([q for p, q in found if p >= b], default=len(lines))
            tlow, thigh = reach(theirs, x, y)
            k = 1
            while k <= 64 and a - k >= low and x - k >= tlow and lines[a - k] == theirs[x - k]:
                more.add(a - k)
                k += 1
            k = 1
            while k <= 64 and b + k < high and y + k < thigh and lines[b + k] == theirs[y + k]:
                more.add(b + k)
                k += 1
            if b > a or sum(size[i] for i in more) > 50:
                drop |= more
        out.append([x for i, x in enumerate(lines) if i not in drop])
    return out


REACH, KEEP = {}, []


def reach(lines, a, b):
    found, size = REACH[id(lines)]
    return max([p + (size[p] >= 8) for p, q in found if q <= a], default=0), min([q for p, q in found if p >= b], default=len(lines))


def test_removed_lines_are_those_of_a_plain_loop(spark):
    rnd = np.random.default_rng(6)
    shared = [[prose(rnd, 0, 14) if rnd.random() < 0.7 else str(rnd.choice(WORDS)) for _ in range(14)] for _ in range(6)]
    rows = []
    for i in range(200):
        lines = [prose(rnd, 0, 10) if rnd.random() < 0.6 else "" for _ in range(rnd.integers(0, 25))]
        if i % 3 == 0:
            a, b = sorted(rnd.integers(0, 15, 2))
            lines[len(lines) // 2 : len(lines) // 2] = shared[i % 6][a:b]
        rows.append((i, "\n".join(lines), 9))
    long = prose(rnd, 60, 61)
    rows += [(300, "x\n" + long + "\ny", 9), (301, long, 9), (302, "x\n" + long + "\ny\nz", 9), (303, "x y\n" * 400, 9), (304, "q\n" + "x y\n" * 300, 9)]
    half = prose(rnd, 47, 48)
    rows += [(310, f"a b\n{half}\nc d e\nf", 9), (311, f"a b\n{half}\nc d e\nf", 9), (312, f"b\n{half}\nd e", 9), (313, f"o\na b\n{half}\nc d", 9)]
    rows += [(500, None, 9), (501, "", 9), (502, "one line", 9), (503, "\n" * 5000, 9), (504, "}\n" * 900, 9), (7, rows[7][1], 9), (None, rows[3][1], 9)]
    once = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    for (i, t, _), kept in zip(once, plain([t for _, t, _ in once]), strict=True):
        n = len(t.split("\n")) if t else 0
        want.append((i, t and b"\n".join(kept).decode(), n, n - len(kept)))
    want.append(next(w for w in want if w[0] == 7))
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int").repartition(5))
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want if w[0] is None or w[0] < 300) > 200
    # every line that goes stays somewhere, and blank lines and brackets are no passage
    kept = {x for _, t, _, _ in got for x in (t or "").split("\n")}
    assert {x for _, t, _ in rows for x in (t or "").split("\n")} == kept
    assert {w[0]: w[3] for w in want}[503] == {w[0]: w[3] for w in want}[504] == 0
    assert [{w[0]: w[3] for w in want}[i] for i in (310, 311, 312)] == [0, 4, 0]
    assert dedup_lines(out.select("doc_id", "text").limit(0)).count() == 0
