"""Conversation prefix trie: double-array tries by prefix shard, their shared upper nodes merged over all shards.

Each conversation's turns become a sequence of turn hashes; `rebuilt` makes the ones that the query asks for. Sequences are
range-partitioned by their first turns and a hash of the whole: a shard is a run of neighbouring prefixes, and where one prefix, or
one sequence, has more than a shard's share, it is dealt over several. A task packs blocks of at most BLOCK turns: turns get dense ids,
the block's distinct sequences go into BASE and CHECK arrays (first fit from the first free slot), and walks over them count each
node's members and their smallest id; children follow their parents in the arrays' order, so sums over subtrees take one pass backwards.

A node is the same in all blocks by its chain of hashes. Members, and the bytes that members have from a node on, add up over blocks. Subtree sums of
distinct nodes (bytes, leaves) and children would count a node twice that two blocks share: shared nodes, the upper ones and those on a shard's edge, are
found by the merge, and what they count too often is taken off all their ancestors, which are shared as well, by pointer doubling: each
round doubles the distance that sums have come, so depth d takes log2(d) rounds.

Ids of the conversations that end at a node are hashed as one string. They travel in pieces of at most PIECE ids, sorted within a node, and
one pass per node feeds the pieces to SHA-256, so memory doesn't grow with a node's conversations.

Nulls and edges: rows with a null conv_id belong to no conversation and are left out; a null role or text is empty; turns are ordered by turn, null
first, equal turns by role and then by a hash of the text; repeated rows are turns like others; an empty table has no nodes, not even a root. Other columns
don't matter. One conversation's turns (40 bytes each) come together in one task, five or nine conversations at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.llm.base import forget, partitions, slices, stored, table, trimmed

#: Turns in a block, at most, but for a single longer conversation: about 500 bytes each.
BLOCK = 200_000
#: Turns of a sequence that sort it to its neighbours.
NEAR = 6
#: Conversation ids in a piece, and hexadecimal digits of a turn's hash.
PIECE, HEX = 1000, 32
#: Under so many shared nodes (about 60 bytes each) they are broadcast; beyond it Spark shuffles.
BROADCAST_NODES = 500_000
ROOT = hashlib.sha256(b"root").digest()[:16]
NODE = "key binary, parent binary, depth long, low long, parent_low long, n long, through long, bytes long, below long, leaves long, children long, ids string"


def turn_hash() -> Column:
    """Role and text, told apart by the role's length; 128 bits of SHA-256."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(HEX))


def sequences(talks: DataFrame, leader: Column) -> DataFrame:
    """leader, conv_id and turns (array of hash and bytes, in order): one shuffle of the turns' hashes, by leader."""
    rows = talks.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), turn_hash().alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b")
    )
    rows = rows.withColumn("leader", leader).repartition(partitions(talks.sparkSession), "leader")
    order = F.sort_array(F.collect_list(F.struct("turn", "role", "h", "b")))
    return rows.groupBy("leader", "conv_id").agg(F.transform(order, lambda t: F.struct(t["h"].alias("h"), t["b"].alias("b"))).alias("turns"))


def rebuilt(talks: DataFrame) -> DataFrame:
    """conv_id and turns: the first crc32(conv_id) % 9 turns of conversation conv_id - conv_id % 5, then the own turns after as many."""
    own = sequences(talks, F.col("conv_id") - F.col("conv_id") % 5)
    # conversations with one leader are at most nine, and already together
    group = own.groupBy("leader").agg(F.collect_list(F.struct("conv_id", "turns")).alias("all"))
    first = F.filter("all", lambda c: c["conv_id"] == F.col("leader"))
    rows = group.select(F.coalesce(F.get(first, F.lit(0))["turns"], F.array().cast("array<struct<h: string, b: bigint>>")).alias("head"), F.explode("all").alias("c"))
    h = (F.crc32(F.col("c.conv_id").cast("string")) % 9).cast("int")
    return rows.select("c.conv_id", F.concat(F.slice("head", F.lit(1), h), F.slice("c.turns", h + 1, F.greatest(F.size("c.turns") - h, F.lit(0)))).alias("turns"))


class DoubleArray:
    """A trie of sequences of dense ids: state t follows s by code c where t = base[s] + c and check[t] = s. 0 is the root."""

    def __init__(self, sequences: list[tuple[int, ...]]) -> None:
        """sequences: distinct, sorted."""
        self.base, self.check = [0], [0]
        self.order: list[int] = []  # states but the root, parents first
        self.codes: list[int] = []  # by order
        free = 1
        stack = [(0, 0, len(sequences), 0)]
        while stack:
            state, lo, hi, depth = stack.pop()
            while lo < hi and len(sequences[lo]) == depth:
                lo += 1
            if lo == hi:
                continue
            starts, codes = [lo], [sequences[lo][depth]]
            if sequences[hi - 1][depth] != codes[0]:
                for i in range(lo + 1, hi):
                    if sequences[i][depth] != codes[-1]:
                        starts.append(i)
                        codes.append(sequences[i][depth])
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            base = self._fit(codes, free)
            self.base[state] = base
            for c in codes:
                self.check[base + c] = state
            self.order += [base + c for c in codes]
            self.codes += codes
            stack += [(base + c, a, b, depth + 1) for c, a, b in zip(codes, starts, [*starts[1:], hi])]

    def _fit(self, codes: list[int], free: int) -> int:
        """The base where all codes, ascending, find free slots: tried from the first free slot on, at the end after a few."""
        check, tries = self.check, 0
        at = free
        while at < len(check):
            if check[at] < 0:
                base = at - codes[0]
                if all(base + c >= len(check) or check[base + c] < 0 for c in codes[1:]):
                    break
                tries += 1
                if tries == 64:
                    at = len(check)
                    break
            at += 1
        base = at - codes[0]
        more = base + codes[-1] + 1 - len(check)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more
        return base

    def step(self, state: int, code: int) -> int:
        """The state after state by code, or -1."""
        t = self.base[state] + code
        return t if 0 < t < len(self.check) and self.check[t] == state else -1

    def walk(self, codes: tuple[int, ...]) -> list[int]:
        """The states on the way from the root, without it."""
        out, s = [], 0
        for c in codes:
            s = self.step(s, c)
            out.append(s)
        return out


def block_nodes(hashes: list[bytes], sizes: np.ndarray, lengths: list[int], weights: list[int], lows: list[int]) -> list[tuple]:
    """The nodes of a block's sequences (distinct; weights: their conversations, lows: the smallest ids), and each one's end node's key.

    hashes and sizes have the turns of all sequences in a row.
    """
    alphabet, codes = np.unique(np.array(hashes, f"S{HEX}") if hashes else np.zeros(0, f"S{HEX}"), return_inverse=True)
    size_of = np.zeros(len(alphabet), np.int64)
    size_of[codes] = sizes
    ends = np.cumsum(lengths)
    codes = codes.tolist()
    seqs = [tuple(codes[e - n : e]) for e, n in zip(ends.tolist(), lengths)]
    trie = DoubleArray(sorted(seqs))
    m = len(trie.check)
    n, low, through, depth = [0] * m, [None] * m, [0] * m, [0] * m
    last = [0] * len(seqs)
    sizes = sizes.tolist()
    for k, (seq, w, c) in enumerate(zip(seqs, weights, lows)):
        way, e = trie.walk(seq), int(ends[k])
        last[k] = way[-1] if way else 0
        rest, i = 0, e
        for s in reversed(way):
            i -= 1
            rest += sizes[i]
            n[s] += w
            through[s] += w * rest
            low[s] = c if low[s] is None or c < low[s] else low[s]
        n[0] += w
        through[0] += w * rest
        low[0] = c if low[0] is None or c < low[0] else low[0]
    key, own, children = [ROOT] * m, [0] * m, [0] * m
    for s, c in zip(trie.order, trie.codes):
        p = trie.check[s]
        depth[s], own[s] = depth[p] + 1, int(size_of[c])
        key[s] = hashlib.sha256(key[p] + alphabet[c]).digest()[:16]
        children[p] += 1
    below, leaves = own[:], [int(not x) for x in children]
    for s in reversed(trie.order):
        p = trie.check[s]
        below[p] += below[s]
        leaves[p] += leaves[s]
    # a state with children counts their leaves alone: it began with none
    rows = [(key[s], None if s == 0 else key[trie.check[s]], depth[s], low[s], None if s == 0 else low[trie.check[s]], n[s], through[s], own[s], below[s], leaves[s], children[s]) for s in [0, *trie.order]]
    return rows, [key[s] for s in last]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a shard's sequences, which come sorted: rows of nodes, and rows of ids that end at a node (ids not null)."""
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 9, pa.string()]
    names = [x.strip().split()[0] for x in NODE.split(",")]

    def given(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), kinds)], names)

    def flushed() -> Iterator[pa.RecordBatch]:
        rows, ends = block_nodes(hashes, np.array(sizes, np.int64), lengths, weights, lows)
        yield from given([(*r, None) for r in rows])
        yield from given([(key, None, None, first, *[None] * 7, ids) for k, key in enumerate(ends) for first, ids in pieces[k]])

    hashes, sizes, lengths, weights, lows, pieces, was = [], [], [], [], [], [], None
    for b in (s for batch in batches for s in slices([batch], 200)):
        for c, seq, hs, bs in zip(*(b.column(x).to_pylist() for x in ("conv_id", "seq", "hashes", "sizes"))):
            if seq != was:
                if len(hashes) + len(lengths) >= BLOCK:
                    yield from flushed()
                    hashes, sizes, lengths, weights, lows, pieces = [], [], [], [], [], []
                raw = hs.encode()
                hashes += [raw[i : i + HEX] for i in range(0, len(raw), HEX)]
                sizes += bs
                lengths.append(len(bs))
                weights.append(0)
                lows.append(c)  # rows of one sequence come by conv_id
                pieces.append([])
                was, held = seq, PIECE
            weights[-1] += 1
            if held == PIECE:
                pieces[-1].append((c, str(c)))
                held = 0
            else:
                first, ids = pieces[-1][-1]
                pieces[-1][-1] = (first, f"{ids},{c}")
            held += 1
    if lengths:
        yield from flushed()


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and sha: rows of (key, low, ids) come by key and low."""
    was, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "sha"])

    keys, shas = [], []
    for b in batches:
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if key == was:
                digest.update(b"," + ids.encode())
                continue
            if digest:
                keys.append(was)
                shas.append(digest.hexdigest())
            was, digest = key, hashlib.sha256(ids.encode())
        yield row()
        keys, shas = [], []
    if digest:
        keys, shas = [was], [digest.hexdigest()]
        yield row()


def excess(shared: DataFrame) -> DataFrame:
    """key, less_below, less_leaves, less_children of shared nodes: what they and shared nodes under them are counted too often.

    less_children needs the next level only; the others come up the tree by doubling: a row's sum covers all within 2**k under it, and `up` is
    the ancestor 2**k above.
    """
    children = shared.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.sum(F.col("blocks") - 1).alias("less_children"))
    # a node that is a leaf in some blocks only isn't one
    leaf = F.when(F.col("children") > 0, F.col("bare")).otherwise(F.col("blocks") - 1)
    now = stored(shared.select("key", F.col("parent").alias("up"), ((F.col("blocks") - 1) * F.col("bytes")).alias("less_below"), leaf.alias("less_leaves")), "trie-excess")
    while now.where("up is not null").limit(1).count():
        more = now.where("up is not null").groupBy("up").agg(F.sum("less_below").alias("b"), F.sum("less_leaves").alias("l")).select(F.col("up").alias("key"), "b", "l")
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        new = now.join(more, "key", "left").join(above, "up", "left").select(
            "key", F.col("next").alias("up"), (F.col("less_below") + F.coalesce("b", F.lit(0))).alias("less_below"), (F.col("less_leaves") + F.coalesce("l", F.lit(0))).alias("less_leaves")
        )
        was, now = now, stored(new, "trie-excess")
        forget(was)
    return now.drop("up").join(children, "key", "left").select("key", "less_below", "less_leaves", F.coalesce("less_children", F.lit(0)).alias("less_children"))


def nodes(talks: DataFrame) -> DataFrame:
    """A row for each node of the trie of talks (conv_id, turns: array of h and b)."""
    spark = talks.sparkSession
    flat = talks.select("conv_id", F.array_join(F.transform("turns", lambda t: t["h"]), "").alias("hashes"), F.transform("turns", lambda t: t["b"]).alias("sizes"))
    flat = stored(flat.withColumns({"near": F.left("hashes", F.lit(NEAR * HEX)), "seq": F.unhex(F.left(F.sha2("hashes", 256), F.lit(HEX)))}), "trie-sequences")
    dealt = flat.repartitionByRange(partitions(spark), "near", "seq", "conv_id").sortWithinPartitions("near", "seq", "conv_id").select("conv_id", "seq", "hashes", "sizes")
    parts = stored(dealt.mapInArrow(trimmed(packed), NODE), "trie-blocks")
    forget(flat)
    ends = parts.where("ids is not null").select("key", "low", "ids").repartition(partitions(spark), "key").sortWithinPartitions("key", "low").mapInArrow(ended, "key binary, sha string")
    add = lambda c: F.sum(c).alias(c)
    once = lambda c: F.max(c).alias(c)
    rows = parts.where("ids is null").withColumn("sha", F.lit(None).cast("string")).unionByName(ends, allowMissingColumns=True)
    merged = rows.groupBy("key").agg(once("parent"), once("depth"), F.min("low").alias("low"), F.min("parent_low").alias("parent_low"), *map(add, ("n", "through", "below", "leaves", "children")), once("bytes"), once("sha"), F.count("n").alias("blocks"), F.sum(F.when(F.col("children") == 0, 1).otherwise(0)).alias("bare"))
    merged = stored(merged, "trie-nodes")
    forget(parts)
    shared = merged.where("blocks > 1")
    less = excess(shared).join(shared.select("key", F.col("low").alias("true_low")), "key")
    less = stored(less, "trie-shared")
    few = less.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    small = lambda df: F.broadcast(df) if few else df
    above = less.select(F.col("key").alias("parent"), F.col("true_low").alias("true_parent"))
    rows = merged.join(small(less), "key", "left").join(small(above), "parent", "left")
    off = lambda c: F.col(c) - F.coalesce(f"less_{c}", F.lit(0))
    return rows.select(
        F.col("low").alias("conv_id"), "depth", F.coalesce("true_parent", "parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), off("children").alias("n_children"),
        off("leaves").alias("n_leaves"), (F.col("through") - off("below")).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(table(spark, sf_dir, "conversations")))


#: CRC-32 of a decimal id: bytes are folded in with eight shifts each, the polynomial is 0xEDB88320 reflected.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

SQL = rf"""WITH own AS (SELECT conv_id::BIGINT AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[:32]) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT o.c, o.turns, coalesce(l.turns, []) AS lead, ({CRC}) % 9 AS h FROM (SELECT *, c::VARCHAR AS d FROM own) o LEFT JOIN own l ON l.c = o.c - o.c % 5),
made AS (SELECT c, list_concat(lead[:h], turns[h + 1:]) AS seq FROM heads),
marked AS (SELECT c, len(seq) AS total, d, CASE WHEN d = 0 THEN '' ELSE sha256(array_to_string(list_transform(seq[:d], lambda x: length(x.r)::VARCHAR || ':' || length(x.t)::VARCHAR || ':' || x.r || x.t), '|')) END AS key,
  CASE WHEN d = 0 THEN 0 ELSE strlen(seq[d].t) END AS b FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM made)),
node AS (SELECT key, d, min(c) AS low, count(*) AS n, any_value(b) AS b, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = d), '') AS ends FROM marked GROUP BY key, d),
up AS (SELECT n.key AS k, n.d AS kd, n.n, n.b, a.key AS above, a.d AS ad FROM node n JOIN marked a ON a.c = n.low AND a.d <= n.d),
kids AS (SELECT above AS key, ad AS d, count(*) AS children FROM up WHERE kd = ad + 1 GROUP BY ALL),
sums AS (SELECT above AS key, ad AS d, sum((u.n - 1) * u.b)::BIGINT AS saved, count(*) FILTER (kids.children IS NULL) AS leaves FROM up u LEFT JOIN kids ON kids.key = u.k AND kids.d = u.kd GROUP BY ALL)
SELECT n.low AS conv_id, n.d::BIGINT AS depth, p.low AS parent_conv_id, n.n AS n_convs, coalesce(kids.children, 0) AS n_children, sums.leaves AS n_leaves, sums.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN sums USING (key, d) LEFT JOIN kids USING (key, d) LEFT JOIN up u ON u.k = n.key AND u.kd = n.d AND u.ad = n.d - 1 LEFT JOIN node p ON p.key = u.above AND p.d = u.ad"""
