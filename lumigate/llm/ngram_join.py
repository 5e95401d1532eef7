"""N-gram Jaccard self-join by prefix filters under several global orders.

A document is its set of distinct word shingles; equal sets are one node. Two sets with a similarity of at
least `percent` share an element among the first n - ceil(n * percent / 100) + 1 of each under any order
that is the same for all documents. The first order is by frequency: shingles of one half of the hash range
are counted over all documents, the counts' classes go to two bitmaps of a fixed size, and rare ones come
first. Nodes that share a prefix shingle of this order form its group. The other orders are hash orders. Under the
second, prefixes up to a fixed hash may differ by no more than similar sets of these sizes differ at all; under the
third, prefixes must meet. Only pairs that pass all three are compared whole.

A group never gives all its pairs as rows. First it gives a star: its smallest node with each other node (in each map
task first, so that a group sends one node from each task). Stars are verified and linked nodes united. Large groups
whose nodes are then in different components give more stars, of other leaders, as long as these still unite many.
What is still apart then is compared in blocks of a bounded size (see ngram_blocks): a task holds two
blocks of a group and the filters of the second and third order, and gives only which nodes have a possible partner in
another component and as many pairs as hold these together. Nodes so held together are clusters; the blocks of
each cluster are compared whole, each pair of blocks in one task, which gives the links that join components. Blocks of
a group's or cluster's largest component aren't compared with each other. So no link between components is lost,
whatever a group's size, and rows grow with members and blocks, not with pairs. A node's number begins with its share
of rare shingles, so that a leader is what near copies have in common rather than one of them.

`links` has the verified pairs that hold the components together, `nodes` every document's node.

Nulls and edges: a null or empty text, or one of white space, has no shingles and links with nothing; a
text with fewer words than a shingle has one shingle; rows with a null doc_id take part, and a component's id
is its smallest doc_id that isn't null; repeated rows are equal documents; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.llm.base import components, fixed_bitmap, forget, marked, row_key, slices, stored, table, trimmed, without
from lumigate.llm.ngram_blocks import BLOCK, blocks_of, linked_blocks, packed, possible_blocks, unpacked
from lumigate.llm.ngram_blocks import whole as whole_set
from lumigate.llm.shingling import U, mixed, shingle_sets

#: One odd multiplier for each further order.
ORDERS = (U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93))
#: The prefix that is compared first under ORDERS[0]: hashes in this part of their range.
PART = 0.25
#: log2 of the bits of each frequency bitmap (8 MB), and least and most of those of the bitmap of texts to compare (16 MB).
FREQUENCY_BITS = 26
TEXT_BITS = (20, 27)
#: Counts from which a shingle is of the middle and the last class.
OFTEN, VERY_OFTEN = 4, 32
#: Open groups of over so many nodes are large: a turn of stars costs a pass over the texts and some 60 stages, and 136 pairs of blocks less.
LARGE = 16 * BLOCK
#: Large open groups give further stars as long as one in so many of these pairs links.
STAR_YIELD = 10
#: Shingles that a task holds before it sends them on.
FLUSH = 500_000


@dataclass(frozen=True)
class Join:
    """bits: hashes are dealt to 2**bits buckets by their first bits; 0 sets it by the number of input partitions."""

    words: int = 5
    percent: int = 80
    bits: int = 0

    def prefix(self, n: int) -> int:
        return n + (-n * self.percent // 100) + 1 if n else 0

    def least(self, a: int, b: int):
        """Elements that similar sets of a and b elements have in common at least."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def size_class(self, n: Column) -> Column:
        """Sizes of similar sets are in the same class or in neighbouring ones."""
        return F.floor(F.log(n) / (max(0.01, math.log(100 / self.percent)) * (1 + 1e-9)))


def classes_of(s: np.ndarray, often: np.ndarray, very: np.ndarray) -> np.ndarray:
    """0 counted and rare, 1 counted and of the middle, 2 not counted, 3 very often."""
    at = s >> U(64 - FREQUENCY_BITS)
    return np.where((s & U(1)) == 0, _bit(often, at) + 2 * _bit(very, at), 2).astype(np.uint64)


def node_of(s: np.ndarray, bitmaps: tuple[np.ndarray, np.ndarray]) -> int | None:
    """A set's number: 3 bits that grow with its share of rare shingles, then 60 bits of its hash (positive as a long).

    So the smallest node of a group of near copies is one that has least of its own, which most others are near to.
    """
    if not len(s):
        return None
    counted = s[(s & U(1)) == 0]
    rare = (classes_of(counted, *bitmaps) == 0).sum() / max(1, len(counted))
    h = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 4
    return min(7, int(rare * 20)) << 60 | h


def _texts(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in slices(batches):
        yield b, list(shingle_sets(b.column("text"), join.words))


def _by_bucket(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket of a sorted array begins, and the buckets that there are."""
    bucket = (h >> U(64 - bits)).astype(np.int32)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return np.append(at, len(h)), bucket[at]


def frequency_bitmaps(docs: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the shingles, in the counted half, that are in OFTEN and VERY_OFTEN documents or more.

    A task sends each of its shingles once with a count (up to 255, which is more than VERY_OFTEN).
    """

    def count(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            once, more = h[n == 1], h[n > 1]
            n = np.minimum(n[n > 1], 255).astype(np.uint8)
            rows = {}
            for k, x in enumerate((once, more)):
                begin, buckets = _by_bucket(x, join.bits)
                low = ((x >> U(32 - join.bits)) & U(0xFFFFFFFF)).astype(np.uint32)
                for bucket, i, j in zip(buckets.tolist(), begin[:-1], begin[1:], strict=True):
                    row = rows.setdefault(bucket, [b""] * 3)
                    row[k] = np.diff(low[i:j], prepend=np.uint32(0)).tobytes()
                    if k:
                        row[2] = n[i:j].tobytes()
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *[pa.array([r[k] for r in rows.values()], pa.binary()) for k in range(3)]], ["bucket", "once", "more", "counts"])

        for _, sets in _texts(batches, join):
            for s in sets:
                s = s[(s & U(1)) == 0]
                held.append(s)
                size += len(s)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    segment = 1 << (FREQUENCY_BITS - join.bits)

    def classes(t: pa.Table) -> pa.Table:
        once, more = (np.concatenate([np.cumsum(np.frombuffer(x.as_py(), np.uint32), dtype=np.uint32) for x in t.column(c)]) for c in ("once", "more"))
        low, counts = np.append(once, more), np.append(np.ones(len(once), np.uint8), np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("counts")]))
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.diff(low, prepend=low[:1] + 1 if len(low) else 0))
        n = np.add.reduceat(counts, at) if len(at) else counts
        out = []
        for least in (OFTEN, VERY_OFTEN):
            bits = np.zeros(segment, np.uint8)
            bits[low[at][n >= least] >> np.uint32(32 - (FREQUENCY_BITS - join.bits))] = 1
            out.append(pa.array([np.packbits(bits).tobytes()], pa.binary()))
        return pa.table([t.column("bucket").slice(0, 1).combine_chunks(), *out], names=["bucket", "often", "very"])

    steps = docs.select("text").mapInArrow(trimmed(count), "bucket int, once binary, more binary, counts binary")
    found = steps.groupBy("bucket").applyInArrow(classes, "bucket int, often binary, very binary").collect()  # together two bitmaps of fixed size
    often, very = (np.zeros(1 << (FREQUENCY_BITS - 3), np.uint8) for _ in range(2))
    for r in found:  # a segment is 64 bits or more
        for bits, part in ((often, r["often"]), (very, r["very"])):
            bits[r["bucket"] * segment // 8 : (r["bucket"] + 1) * segment // 8] = np.frombuffer(part, np.uint8)
    return often, very


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> U(3)] >> (7 - (at & U(7)).astype(np.uint8))) & 1


def frequency_prefix(s: np.ndarray, p: int, often: np.ndarray, very: np.ndarray) -> np.ndarray:
    """The first p of a set by class, then by hash."""
    if p >= len(s):
        return s
    rank = classes_of(s, often, very)
    return s[np.argpartition((rank << U(62)) | (s >> U(2)), p - 1)[:p]]


def _stars(tok: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by token and node without repeats: tokens, nodes, and for each the index of its group's first."""
    order = np.lexsort((node, tok))
    tok, node = tok[order], node[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
    tok, node = tok[new], node[new]
    head = np.ones(len(tok), bool)
    head[1:] = tok[1:] != tok[:-1]
    return tok, node, np.maximum.accumulate(np.where(head, np.arange(len(tok)), 0))


INDEX = ("key binary", "doc_id {}", "text_hash long", "n_shingles long", "node long", "tok long", "a long", "b long", "bucket int", "low binary", "heads binary")


def index(docs: DataFrame, join: Join, bitmaps) -> DataFrame:
    """One pass over the texts, stored: for each document key, doc_id, text_hash, n_shingles and node; tok, a, b for each star within a
    task's group; bucket, low and heads for the smallest nodes of a task's groups. A row has one of these three sets of columns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in INDEX]

    def filled(schema: pa.Schema, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        often, very = bitmaps.value
        toks, nodes, size, schema = [], [], 0, None

        def flush():
            tok, node, first = _stars(np.concatenate(toks), np.concatenate(nodes))
            own = first != np.arange(len(tok))
            yield filled(schema, tok=tok[own].astype(np.int64), a=node[first[own]], b=node[own])
            heads, head_nodes = tok[~own], node[~own]
            begin, buckets = _by_bucket(heads, join.bits)
            low = ((heads >> U(32 - join.bits)) & U(0xFFFFFFFF)).astype(np.uint32)
            at = list(zip(begin[:-1], begin[1:], strict=True))
            yield filled(schema, bucket=buckets, low=[low[i:j].tobytes() for i, j in at], heads=[head_nodes[i:j].tobytes() for i, j in at])

        for b, sets in _texts(batches, join):
            if schema is None:
                own = {"doc_id": b.schema.field("doc_id").type, "bucket": pa.int32()} | dict.fromkeys(("key", "low", "heads"), pa.binary())
                schema = pa.schema([(x, own.get(x, pa.int64())) for x in names])
            numbers = [node_of(s, bitmaps.value) for s in sets]
            yield filled(schema, key=b.column("key"), doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), n_shingles=[len(s) for s in sets], node=numbers)
            for s, number in zip(sets, numbers, strict=True):
                if len(s):
                    p = frequency_prefix(s, join.prefix(len(s)), often, very)
                    toks.append(p)
                    nodes.append(np.full(len(p), number, np.int64))
                    size += len(p)
            if size > FLUSH:
                yield from flush()
                toks, nodes, size = [], [], 0
        if toks:
            yield from flush()

    rows = docs.select(row_key().alias("key"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return stored(rows.mapInArrow(trimmed(run), ", ".join(INDEX).format(kind)), "ngram-index")


def stars(index: DataFrame) -> DataFrame:
    """tok, a, b: for each group of the first order, its smallest node a with each other node b, through at most two levels."""

    def meet(t: pa.Table) -> pa.Table:
        low, heads = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(name)]) for name, kind in (("low", np.uint32), ("heads", np.int64)))
        bucket = U(t.column("bucket")[0].as_py())
        tok, node, first = _stars((bucket << U(32)) | low.astype(U), heads)
        own = first != np.arange(len(tok))
        return pa.table([pa.array(c) for c in (tok[own].astype(np.int64), node[first[own]], node[own])], names=["tok", "a", "b"])

    bits = index.where("bucket is not null").select("bucket", "low", "heads")
    met = bits.groupBy("bucket").applyInArrow(meet, "tok long, a long, b long")
    return index.where("tok is not null").select("tok", "a", "b").union(met)


def part_of(s: np.ndarray) -> bytes:
    """The set's prefix under ORDERS[0] up to a fixed hash, packed."""
    key = mixed(s * ORDERS[0])
    return packed(key[key < U(int(PART * 2**64))] & U(0xFFFFFF))


def third_of(s: np.ndarray, p: int) -> bytes:
    """The first p of a set under ORDERS[1], packed."""
    key = mixed(s * ORDERS[1])
    return packed((key if p >= len(s) else np.partition(key, p - 1)[:p]) & U(0xFFFFFF))


def of_nodes(docs: DataFrame, nodes: DataFrame, join: Join, bitmaps, whole: bool) -> DataFrame:
    """node, n and `set` (the whole set), or node, n, `part` and `third`, once for each of nodes (stored; node and text_hash).

    A bitmap of a bounded size over the hashes of their texts keeps nearly all other texts from being cut into shingles.
    """
    bits = min(TEXT_BITS[1], max(TEXT_BITS[0], (16 * nodes.count()).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(fixed_bitmap(nodes, "text_hash", bits))
    names = ["set"] if whole else ["part", "third"]

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(marked(sent.value, b.column("text_hash").to_numpy(), bits)))
            for c in slices([b]):
                out, seen = [], set()
                for s in shingle_sets(c.column("text"), join.words):
                    if len(s) and (n := node_of(s, bitmaps.value)) not in seen:
                        seen.add(n)
                        out.append((n, len(s), *([s.tobytes()] if whole else [part_of(s), third_of(s, join.prefix(len(s)))])))
                cols = [pa.array([x[k] for x in out], t) for k, t in enumerate([pa.int64(), pa.int32(), *[pa.binary()] * len(names)])]
                yield pa.RecordBatch.from_arrays(cols, ["node", "n", *names])

    texts = docs.select("text", F.xxhash64("text").alias("text_hash"))
    rows = texts.mapInArrow(trimmed(run), "node long, n int" + "".join(f", {x} binary" for x in names)).join(nodes.select("node"), "node", "left_semi")
    return stored(rows.groupBy("node").agg(F.any_value("n").alias("n"), *[F.any_value(x).alias(x) for x in names]), "ngram-sets", "zstd")


def by_size(pairs: DataFrame, sizes: DataFrame, join: Join) -> DataFrame:
    """The pairs a, b whose sizes similar sets can have; stored. sizes has node and n."""
    for side in "ba":
        pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("n").cast("long").alias(f"n_{side}")), side)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return stored(pairs.where(100 * small >= join.percent * large).select("a", "b"), "ngram-sized")


def only(sets: DataFrame, ends: DataFrame) -> DataFrame:
    """sets less nearly all whose node isn't in ends (stored), by a bitmap of a bounded size, so that they aren't shuffled."""
    bits = min(TEXT_BITS[1], max(TEXT_BITS[0], (16 * ends.count()).bit_length()))
    sent = sets.sparkSession.sparkContext.broadcast(fixed_bitmap(ends, "node", bits))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(marked(sent.value, b.column("node").to_numpy(), bits)))

    return sets.mapInArrow(trimmed(run), sets.schema)


def filtered(pairs: DataFrame, sets: DataFrame, join: Join, whole: bool) -> DataFrame:
    """The pairs a, b that may be similar by their sizes and by the second and third order; or, with whole sets, that are."""
    names = ["set"] if whole else ["part", "third"]

    def passes(x: list[np.ndarray], y: list[np.ndarray], n: int, m: int) -> bool:
        least = join.least(n, m)
        if min(n, m) < least:
            return False
        both = len(np.intersect1d(x[0], y[0], True))
        if whole:
            return join.linked(both, n, m)
        # what a part lacks, its set lacks
        return len(x[0]) - both <= n - least and len(y[0]) - both <= m - least and len(np.intersect1d(x[1], y[1], True)) > 0

    def run(batches):
        read = whole_set if whole else unpacked
        for b in slices(batches):
            of = [[[read(v.as_buffer()) for v in b.column(f"{x}_{side}")] for x in names] for side in "ab"]
            sizes = zip(b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), strict=True)
            keep = [i for i, (n, m) in enumerate(sizes) if passes([c[i] for c in of[0]], [c[i] for c in of[1]], n, m)]
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int32()))

    for side in "ba":
        pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in ("n", *names)]), side)
    return pairs.select("a", "b", *[f"{x}_{side}" for side in "ab" for x in ("n", *names)]).mapInArrow(trimmed(run), "a long, b long")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def compared(docs: DataFrame, pairs: DataFrame, parts: DataFrame, texts: DataFrame, join: Join, bitmaps) -> DataFrame:
    """The similar ones of pairs: by the filters first, and whole sets only for what these leave."""
    sized = by_size(pairs, texts, join)
    ends = stored(ends_of(sized), "ngram-ends")
    likely = stored(filtered(sized, only(parts, ends), join, False), "ngram-likely")
    forget(sized, ends)
    ends = stored(texts.join(ends_of(likely), "node", "left_semi"), "ngram-ends")
    sets = of_nodes(docs, ends, join, bitmaps, True)
    out = stored(filtered(likely, sets, join, True), "ngram-links")
    forget(likely, ends, sets)
    return out


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """In each open group, another leader with each node of other components: the first by rank, then a hash of the turn."""
    by = F.struct(F.shiftrightunsigned("node", 60).alias("rank"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "c")
    lead = members.join(members.groupBy("tok").agg(F.min("c").alias("lo")), "tok").where("c <> lo").groupBy("tok").agg(F.min(by).alias("l"))
    pairs = members.join(lead, "tok").where("c <> l.c").select(F.col("l.node").alias("x"), F.col("node").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def with_component(df: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
    return df.join(comp.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def open_members(members: DataFrame, comp: DataFrame) -> DataFrame:
    """tok, node, n and component c of the groups whose nodes are in different components, equal groups once; stored.

    A group of two nodes has no pair but its star's.
    """
    at = with_component(members.select("tok", "node", "n"), comp, "node", "c")
    groups = at.groupBy("tok").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("h")).where("size > 2 and lo <> hi")
    groups = groups.groupBy("size", "h").agg(F.min("tok").alias("tok"))
    return stored(at.join(groups.select("tok", "size"), "tok"), "ngram-open")


def with_partners(opened: DataFrame, join: Join) -> DataFrame:
    """The members of open groups that have a node of another component and of a size near theirs in their group; stored.

    Sizes are compared by class, so that a group of any size gives one row a class and none is sorted.
    """
    at = opened.withColumn("size_class", join.size_class(F.col("n")))
    near = at.groupBy("tok", "size_class").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    near = near.withColumn("size_class", F.explode(F.array(*[F.col("size_class") + d for d in (-1, 0, 1)])))
    near = near.groupBy("tok", "size_class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("tok", "size_class")
    return stored(at.join(near, ["tok", "size_class"], "left_semi").select("tok", "node", "n", "c"), "ngram-open")


def similar_documents(docs: DataFrame, join: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): key, doc_id, n_shingles, node and component_id of every row; verified pairs of nodes that hold the components."""
    spark = docs.sparkSession
    if not join.bits:
        join = replace(join, bits=min(20, max(8, (4 * docs.rdd.getNumPartitions()).bit_length())))
    bitmaps = spark.sparkContext.broadcast(frequency_bitmaps(docs, join))
    passed = index(docs, join, bitmaps)
    nodes = passed.where("key is not null").select("key", "doc_id", "n_shingles", "node", "text_hash")
    edges = stored(stars(passed), "ngram-stars")
    known = nodes.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("text_hash").alias("text_hash"))
    texts = stored(known.join(ends_of(edges), "node", "left_semi"), "ngram-texts")
    parts = of_nodes(docs, texts, join, bitmaps, False)
    links = compared(docs, edges.select("a", "b").distinct(), parts, texts, join, bitmaps)
    comp = components(links)
    members = stored(edges.select("tok", F.explode(F.array("a", "b")).alias("node")).distinct().join(texts.select("node", "n"), "node"), "ngram-members")
    forget(edges)
    # components only grow, so a group that isn't open stays so
    opened, turn = open_members(members, comp), 0
    forget(members)
    # only large groups are read again from turn to turn
    large = stored(opened.where(f"size > {LARGE}"), "ngram-large")
    while large.limit(1).count():
        more = stored(star_pairs(large, turn), "ngram-pairs")
        added, tried, turn = compared(docs, more, parts, texts, join, bitmaps), more.count(), turn + 1
        links = links.union(added)
        comp = components(links)
        was, large = large, open_members(large, comp)
        forget(more, was)
        if added.count() * STAR_YIELD < tried:
            break
    forget(large)
    was, opened = opened, with_partners(with_component(opened.drop("c"), comp, "node", "c") if turn else opened, join)
    forget(was)
    # by the filters alone, in blocks: which nodes may have a partner in another component, and pairs of components that hold these together
    maybe = stored(possible_blocks(blocks_of(opened, "tok"), parts, join), "ngram-maybe")
    forget(opened, parts)
    clusters = components(maybe.where("a is not null").select("a", "b"))
    some = maybe.where("node is not null").select("node").distinct()
    at = with_component(texts.join(some, "node", "left_semi"), comp, "node", "c")
    at = stored(at.join(clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster")), "c"), "ngram-clusters")
    sets = of_nodes(docs, at, join, bitmaps, True)
    joined = stored(linked_blocks(blocks_of(at, "cluster"), sets, join), "ngram-links")
    forget(texts, maybe, at, sets)
    bitmaps.destroy()
    links = links.union(joined.select("a", "b"))
    over = components(joined.select("ca", "cb"), "ca", "cb").select(F.col("node").alias("class"), F.col("component").alias("over"))
    named = with_component(nodes, comp, "node", "class").join(over, "class", "left").withColumn("class", F.coalesce("over", "class")).drop("over")
    least = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("key", "doc_id", "n_shingles", "node", "class", "component_id"), links


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), then of the smallest key.

    Rows without shingles stay, each once.
    """
    nodes, _ = similar_documents(docs.select("doc_id", "text"), join)
    nodes = stored(nodes.select("key", "doc_id", "class"), "ngram-classes")
    first = nodes.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("f")).select(F.col("f.key").alias("_key"))
    lost = stored(nodes.where("class is not null").select(F.col("key").alias("_key")).distinct().join(first, "_key", "left_anti"), "ngram-lost")
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("_key"))
    out = without(rows, lost, "_key")
    if nodes.groupBy("key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["_key"])  # rows that are equal in doc_id and text
    return out.select("row.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), Join(4, 85))
    return nodes.select("doc_id", "n_shingles", "component_id")
