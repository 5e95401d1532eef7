"""Line dedup by content-defined chunks of lines, compared byte for byte and extended line by line.

A rolling hash over the hashes of a line and the one before it makes the line a boundary where it is under a bar that rises with
the line's weight (its words, or its bytes / 16 where words are long): about one boundary every EVERY words, at most one
a line, and none at an empty line; where one line of two words or more follows itself, that hash says nothing, and its words are counted instead. A chunk reaches from one boundary line to the next, both included, so it has two
lines or more; lines put in before it shift no boundary but the next one. A chunk of LEAST words or more that stands elsewhere in the corpus too, byte for
byte, keeps its first place (smallest doc_id, null last, then key and position); its lines go from all others, and with them the lines
beside it that are the same as beside the first place, up to the next chunk. A line of over LONG / 2 words is looked up by itself too, and goes if it and the same lines beside it have over LONG words.
What is removed thus stands elsewhere, and blank lines or single brackets are no chunk however often they follow one another.

One pass counts chunk hashes; the repeated ones go to a bitmap of fixed size. A second pass sends the text of
chunks that meet the bitmap, and grouping by hash and text compares the bytes. Only documents that lose lines are
shuffled, to be joined with what they lose.

A null text stays null and an empty one empty; a text of one line loses nothing unless the line is long; rows equal in
doc_id and text count as one document and get the same result; a text of any length is read whole; other columns stay, and
columns named as the results are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.llm.base import apart, fixed_bitmap, forget, in_bitmap, row_key, slices, stored, table

#: Words from one boundary to the next, about; a line of so many words is always one.
EVERY = 8
#: Words of the smallest chunk that counts.
LEAST = 8
#: Lines after which a boundary is set where the hash sets none, and lines that a chunk is extended by.
MAX = 64
#: A line goes without a chunk where it and what is the same beside it have more words than this.
LONG = 50
#: log2 of the bits of the bitmap of repeated chunks (8 MB).
BITS = 26

Span = tuple[int, int]


def lines_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def weights(lines: list[bytes]) -> np.ndarray:
    return np.fromiter((max(len(x.split()), len(x) // 16) for x in lines), np.uint64, len(lines))


def boundaries(lines: list[bytes], weight: np.ndarray) -> list[int]:
    """The lines where the rolling hash is under the bar of their weight."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    roll = h.copy()
    roll[1:] ^= (h[:-1] << np.uint64(7)) | (h[:-1] >> np.uint64(57))
    roll *= np.uint64(0x9E3779B97F4A7C15)
    here = (roll >> np.uint64(32)) * np.uint64(EVERY) < np.minimum(weight, EVERY) << np.uint64(32)
    at = np.arange(len(lines), dtype=np.uint64)
    again = np.concatenate([[False], h[1:] == h[:-1]])[: len(lines)]
    counted = (at - np.maximum.accumulate(np.where(again, np.uint64(0), at))) * weight % np.uint64(EVERY) < weight
    return np.flatnonzero(np.where(again & (weight > 1), counted, here)).tolist()


def chunks(lines: list[bytes], weight: np.ndarray) -> list[Span]:
    """(first line, line after the last) of each chunk; neighbours share a line."""
    out, start = [], None
    for at in [*boundaries(lines, weight), None]:
        if start is not None:
            stop = len(lines) - 1 if at is None else at
            while stop - start > MAX:
                out.append((start, start + MAX + 1))
                start += MAX
            if at is not None:
                out.append((start, at + 1))
        start = at
    return out


def spans(lines: list[bytes]) -> tuple[list[Span], list[Span], list[int]]:
    """The chunks that count, in order, the lines looked up by themselves, and the first line of each chunk that extending from a later one may take:
    the start itself where a line of its weight is a boundary after some lines only, else the next."""
    weight = weights(lines)
    before = np.concatenate([[0], np.cumsum(weight)])
    many = [(s, e) for s, e in chunks(lines, weight) if before[e] - before[s] >= LEAST]
    return many, [(i, i + 1) for i in np.flatnonzero(weight > LONG // 2).tolist()], [s + int(weight[s] >= EVERY) for s, _ in many]


def beside(span: Span, starts: list[int], stops: list[int], lows: list[int], n: int) -> tuple[range, range]:
    """The lines before a span, nearest first, and those after it, as far as no other chunk decides on them."""
    last, following = bisect_right(stops, span[0] + 1) - 1, bisect_left(starts, span[1] - 1)
    low = lows[last] if last >= 0 else 0
    high = stops[following] - 1 if following < len(stops) else n
    return range(span[0] - 1, max(low, span[0] - MAX) - 1, -1), range(span[1], min(high, span[1] + MAX))


def span_hash(block: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(block, 1)
    return h - (1 << 64) if h >> 63 else h


def span_hashes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                lines = lines_of(t)
                many, long, _ = spans(lines)
                out += [span_hash(b"\n".join(lines[s:e])) for s, e in many + long]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["h"])

    return docs.select("text").mapInArrow(run, "h long")


def suspects(docs: DataFrame, bits) -> DataFrame:
    """h, block, doc_id, key, no (first line), stop and the lines beside them, of the spans whose hash meets the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for b in slices(batches):
            rows, out = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                lines = lines_of(t)
                many, long, lows = spans(lines)
                starts, stops = [s for s, _ in many], [e for _, e in many]
                for s, e in many + long:
                    if in_bitmap(known, h := span_hash(block := b"\n".join(lines[s:e])), BITS):
                        rows.append(i)
                        out.append((h, block, s, e, *([lines[k] for k in r] for r in beside((s, e), starts, stops, lows, len(lines)))))
            at = pa.array(rows, pa.int64())
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            h, block, *rest = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([h, block, b.column("doc_id").take(at), b.column("key").take(at), *rest], ["h", "block", "doc_id", "key", "no", "stop", "prior", "next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("key", "doc_id", "text").mapInArrow(run, f"h long, block binary, doc_id {kind}, key binary, no int, stop int, prior array<binary>, next array<binary>")


def same_from_start(a: str, b: str) -> Column:
    """How many values two arrays share from their starts on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, F.lit(False)).cast("int")
    return F.when(other > 0, other - 1).otherwise(F.size(same))


def bit_table(keys: DataFrame, column: str) -> DataFrame:
    """part and bits: a bitmap of 2**BITS bits as rows of 4 KB (8 MB in all, whatever the number of keys)."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << BITS))
    return keys.select((at / 32768).cast("int").alias("part"), (at % 32768).alias("bit")).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def in_bit_table(rows: DataFrame, bits: DataFrame, column: str) -> DataFrame:
    """rows with `hit`: whether the bit of a column's value is set. The table is of fixed size, so it is broadcast."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << BITS))
    bit = (at % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1
    return rows.withColumn("part", (at / 32768).cast("int")).join(F.broadcast(bits), "part", "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("part", "bits")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text less the lines of its repeated chunks, and n_lines and n_removed (lines) in place of columns with these names."""
    spark = docs.sparkSession
    repeated = span_hashes(docs).groupBy("h").count().where("count > 1")
    bits = spark.sparkContext.broadcast(fixed_bitmap(repeated, "h", BITS))
    found = stored(suspects(docs.select("doc_id", "text", row_key().alias("key")), bits), "spans", "zstd")
    first = found.groupBy("h", "block").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "no", "prior", "next")).alias("f")).where("n > 1")
    first = first.select("h", "block", F.col("f.key").alias("fkey"), F.col("f.no").alias("fno"), F.col("f.prior").alias("fprior"), F.col("f.next").alias("fnext"))
    # stored, so that the join reads two plain shuffles and Spark can split a chunk that very many documents hold
    first = stored(first, "first-places", "zstd")
    again = found.join(first, ["h", "block"]).where("key <> fkey or no <> fno")
    wide = again.select("key", F.expr("stop = no + 1").alias("alone"), (F.col("no") - same_from_start("prior", "fprior")).alias("no"), (F.col("stop") + same_from_start("next", "fnext")).alias("stop"))
    lost = stored(wide.groupBy("key").agg(F.collect_set(F.struct("no", "stop", "alone")).alias("lost")), "lost-lines")
    forget(found, first)
    # documents that lose nothing, nearly all of those that a bitmap of fixed size doesn't show, need no join
    rows = in_bit_table(docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("key")), bit_table(lost, "key"), "key")
    text = F.col("row.text")
    n_lines = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = rows.where("not hit").select("row", text.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, n, gone = [], [], []
            for t, lost in zip(pc.struct_field(b.column("row"), "text").to_pylist(), b.column("lost").to_pylist(), strict=True):
                lines = lines_of(t)
                lost = [x for x in lost or () if not x["alone"] or weights(lines[x["no"] : x["stop"]]).sum() > LONG]
                drop = {k for x in lost for k in range(x["no"], x["stop"])}
                texts.append(t if not drop else b"\n".join(x for k, x in enumerate(lines) if k not in drop).decode("utf-8", "surrogatepass"))
                n.append(len(lines))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_removed"])

    cut = rows.where("hit").join(lost, "key", "left").select("row", "lost").mapInArrow(cut_out, whole.schema)
    kept = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in apart(docs, {"n_lines", "n_removed"})]
    return whole.union(cut).select(*kept, "n_lines", "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
