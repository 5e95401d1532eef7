"""Comparison of groups of sets in blocks of a bounded size, where one task holds two blocks and gives no pair rows.

A group's members are dealt to blocks of about BLOCK members and at most about ELEMENTS elements. Each pair of blocks is a
task; overlaps of all their sets are one product of 0/1 matrices over the elements that two of them share. A
group's largest component has blocks of its own, which aren't compared with each other, so a few members outside a
very large component cost its size times their blocks. Of what a task finds between different components it gives as
many pairs as hold the components together, so at most one row a member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigate.llm.base import partitions, trimmed

BLOCK = 512
ELEMENTS = 1_500_000
#: Cells of a 0/1 matrix (4 bytes each) that a task has at once.
CELLS = 1 << 22


def blocks_of(members: DataFrame, group: str) -> DataFrame:
    """node, c, grp, i, j and side: a row for each task (grp, i, j) that a member is in; side 1 is that of block j.

    members has group, node, n (elements) and component c. Groups of one component have no rows.
    """
    per = members.groupBy(F.col(group).alias("grp"), "c").agg(F.count("*").alias("s"), F.sum("n").alias("e"))
    per = per.groupBy("grp").agg(F.sum("s").alias("size"), F.sum("e").alias("elements"), F.max(F.struct("s", "e", "c")).alias("main")).where("size > main.s")
    one = (F.col("size") <= BLOCK) & (F.col("elements") <= ELEMENTS)

    def blocks(s, e):
        return F.ceil(F.greatest(s / BLOCK, e / ELEMENTS)).cast("int")

    # a group that fits in one block is one task; else its largest component has blocks 0 .. n_main - 1
    n_main = F.when(one, 0).otherwise(blocks(F.col("main.s"), F.col("main.e")))
    n_rest = F.when(one, 1).otherwise(blocks(F.col("size") - F.col("main.s"), F.col("elements") - F.col("main.e")))
    plan = per.select("grp", n_main.alias("n_main"), n_rest.alias("n_rest"), F.col("main.c").alias("main_c"))
    rows = members.select(F.col(group).alias("grp"), "node", "c").join(plan, "grp").withColumn("in_main", (F.col("n_main") > 0) & (F.col("c") == F.col("main_c")))
    dealt = F.when(F.col("in_main"), F.pmod(F.xxhash64("node"), F.col("n_main"))).otherwise(F.col("n_main") + F.pmod(F.xxhash64("node"), F.col("n_rest"))).cast("int")
    rows = rows.withColumn("at", dealt).withColumn("with", F.explode(F.sequence(F.when(F.col("in_main"), F.col("n_main")).otherwise(0), F.col("n_main") + F.col("n_rest") - 1)))
    return rows.select("node", "c", "grp", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), (F.col("at") > F.col("with")).cast("int").alias("side"))


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many elements each of x has in common with each of y (None: of x)."""
    sets, k = x + (y or []), len(x)
    out = np.zeros((k, k if y is None else len(y)), np.float32)
    tok, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tok, kind="stable")
    tok, row = tok[order], row[order]
    col = np.cumsum(np.append([True], tok[1:] != tok[:-1])[: len(tok)]) - 1
    shared = np.bincount(col)[col] > 1 if len(col) else np.zeros(0, bool)
    col, row = np.unique(col[shared], return_inverse=True)[1], row[shared]
    step = max(1, CELLS // len(sets))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((len(sets), int(col[b - 1]) + 1 - lo), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m[:k] @ (m if y is None else m[k:]).T
    return out


def holding(found: np.ndarray, of_rows: np.ndarray, of_cols: np.ndarray) -> list[tuple[int, int]]:
    """Of a table of links, (row, column) of as many as hold together what it holds together; ends of one component are together before."""
    at = np.unique(np.concatenate([of_rows, of_cols]), return_inverse=True)[1]
    rows, cols = at[: len(of_rows)], at[len(of_rows) :]
    group, out = np.arange(at.max() + 1 if len(at) else 0), []
    for r in np.flatnonzero(found.any(1)):
        theirs, mine = np.flatnonzero(found[r]), group[rows[r]]
        groups, where = np.unique(group[cols[theirs]], return_index=True)
        out += [(int(r), int(theirs[w])) for g, w in zip(groups, where, strict=True) if g != mine]
        group[np.isin(group, groups)] = mine
    return out


def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task, from rows sorted by task; a task's rows may come in several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("grp", "i", "j")])
        cuts = [*np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, len(b)]
        start = 0
        for stop in cuts:
            if stop == start:
                continue
            if last is not None and (key[:, start] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, stop - start))
            last, start = key[:, start], stop
    if held:
        yield pa.Table.from_batches(held)


def packed(h: np.ndarray) -> bytes:
    """The distinct low 24 bits of hashes, sorted, 3 bytes each. For filters alone: hashes that fall together only let more pass."""
    return np.unique(h.astype(np.uint32) & np.uint32(0xFFFFFF)).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view(np.uint32).ravel()


def whole(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _sides(t: pa.Table, names: list[str], read: Callable[[bytes], np.ndarray]) -> list[dict]:
    """The two blocks of a task; one where it compares a block with itself."""
    own = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    side = t.column("side").to_numpy()
    out = []
    for at in [np.arange(len(side))] if own else [np.flatnonzero(side == k) for k in (0, 1)]:
        part = t.take(pa.array(at))
        out.append({c: part.column(c).to_numpy() for c in ("node", "c", "n")} | {x: [read(v.as_buffer()) for v in part.column(x)] for x in names})
    return out


def _with_sets(rows: DataFrame, sets: DataFrame, names: list[str]) -> DataFrame:
    spark = rows.sparkSession
    full = rows.join(sets.select("node", "n", *names), "node").select("grp", "i", "j", "side", "node", "c", "n", *names)
    return full.repartition(4 * partitions(spark), "grp", "i", "j").sortWithinPartitions("grp", "i", "j")


def _apart(x: dict, y: dict) -> np.ndarray:
    return x["c"][:, None] != y["c"][None, :]


def possible_blocks(rows: DataFrame, parts: DataFrame, join) -> DataFrame:
    """What passes the filters of the second and third order between components: `node` for each that has a partner, and
    components a, b of as many pairs as hold these together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tasks(batches):
            sides = _sides(t, ["part", "third"], unpacked)
            if len(sides[0]["n"]) == 0 or len(sides[-1]["n"]) == 0:
                continue
            x, y, own = sides[0], sides[-1], len(sides) == 1
            n, m = x["n"].astype(np.int64)[:, None], y["n"].astype(np.int64)[None, :]
            least = join.least(n, m)
            found = _apart(x, y) & (np.minimum(n, m) >= least)
            if not found.any():
                continue
            both = overlaps(x["part"], None if own else y["part"])
            found &= (np.array([len(s) for s in x["part"]])[:, None] - both <= n - least) & (np.array([len(s) for s in y["part"]])[None, :] - both <= m - least)
            if found.any():
                found &= overlaps(x["third"], None if own else y["third"]) > 0
            pairs = holding(found, x["c"], y["c"])
            some = np.unique(np.concatenate([x["node"][found.any(1)], y["node"][found.any(0)]]))
            blank = [None] * len(pairs)
            cols = [[int(x["c"][r]) for r, _ in pairs] + [None] * len(some), [int(y["c"][s]) for _, s in pairs] + [None] * len(some), blank + some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "node"])

    return _with_sets(rows, parts, ["part", "third"]).mapInArrow(trimmed(run), "a long, b long, node long")


def linked_blocks(rows: DataFrame, sets: DataFrame, join) -> DataFrame:
    """a, b and their components ca, cb: of the links between components as many as hold these together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tasks(batches):
            sides = _sides(t, ["set"], whole)
            if len(sides[0]["n"]) == 0 or len(sides[-1]["n"]) == 0:
                continue
            x, y = sides[0], sides[-1]
            n, m = x["n"].astype(np.int64)[:, None], y["n"].astype(np.int64)[None, :]
            found = _apart(x, y) & (np.minimum(n, m) >= join.least(n, m))
            if found.any():
                found &= join.linked(overlaps(x["set"], None if len(sides) == 1 else y["set"]).astype(np.int64), n, m)
            pairs = holding(found, x["c"], y["c"])
            cols = [[int(s[k][p[end]]) for p in pairs] for k in ("node", "c") for end, s in enumerate((x, y))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "ca", "cb"])

    return _with_sets(rows, sets, ["set"]).mapInArrow(trimmed(run), "a long, b long, ca long, cb long")
