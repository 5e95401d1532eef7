"""Token-id output in training order: every sequence gets a global slot by a keyed permutation.

Documents are encoded once. A document's place is by the md5 of its doc_id and text: its first 4 hexadecimal digits are its
bucket, a window numbers the sequences of a bucket, and a prefix sum over the buckets makes the numbers global and
dense, so they depend on the data alone and not on partitions or tasks. A keyed Feistel network over the
smallest even-sized bit domain, walked along its cycle until it is below the number of sequences, maps number
to slot one to one. Slots are dense, so shard = slot // per_shard is an exact range partition that needs no
sampling; in each shard records lie in slot order at a fixed stride of 2 * length bytes.

`materialised` gives the records. `write_shards` writes each shard as one file of fixed-stride records, under a temporary
name that is renamed when the file is whole; after a stop only shards that are missing are written, and a folder begun with other
data, layout or key is refused. `read_shards` reads from any slot on: shard slot // per_shard, byte slot % per_shard * stride.

A document's tokens end with END. Its last sequence is filled up with END, and n_tokens says how many tokens
count. A null or empty text is one sequence of END alone; repeated rows and rows with a null doc_id are
documents like others (which of equal rows has which slot makes no difference); no text is cut; other columns of docs aren't read.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigate.llm.base import row_key, slices, stored, table, trimmed
from lumigate.llm.token_counts import tokenizer_path

END = 50256
ROUNDS = 6
#: Rows that are encoded together, which bounds what a task holds.
ROWS = 2_000


#: Hexadecimal digits of a document's bucket: at most 65,536 buckets have a prefix sum.
DIGITS = 4
#: A shard has so many sequences at least, and more (a power of 2) where there would be more shards than MOST_SHARDS.
LEAST_SHARD, MOST_SHARDS = 4096, 32_768


@dataclass(frozen=True)
class Layout:
    """length: tokens of a sequence, 2 bytes each. per_shard: sequences of a shard, 0 for one by their number. key: of the permutation."""

    length: int = 512
    per_shard: int = 0
    key: int = 20_240_229
    vocabulary: str = "byte_bpe_50k.tiktoken"

    def of(self, total: int) -> Layout:
        """With per_shard set."""
        return self if self.per_shard else replace(self, per_shard=max(LEAST_SHARD, 1 << max(0, -(-total // MOST_SHARDS) - 1).bit_length()))


def encoder(path: str):
    """Text -> ids, special tokens' strings being ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _round(right: np.ndarray, key: int, r: int, half: int) -> np.ndarray:
    x = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * (2 * r + 1) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x & np.uint64((1 << half) - 1)


def permuted(number: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of numbers below n: a bijection of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    x, todo = number.astype(np.uint64), np.ones(len(number), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & np.uint64((1 << half) - 1)
        for r in range(ROUNDS):
            left, right = right, left ^ _round(right, key, r, half)
        x[todo] = left << np.uint64(half) | right
        todo[todo] = x[todo] >= n
    return x.astype(np.int64)


def encoded(docs: DataFrame, layout: Layout) -> DataFrame:
    """bucket, start (sequences of the bucket before this document), doc_id, n_tokens (with END) and tokens; stored."""
    path = tokenizer_path(layout.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches, ROWS):
            tokens = [array("H", [*encode(t or ""), END]).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array([len(t) // 2 for t in tokens], pa.int64()), pa.array(tokens, pa.binary())], ["key", "doc_id", "n_tokens", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(row_key().alias("key"), "doc_id", "text").mapInArrow(trimmed(run), f"key binary, doc_id {kind}, n_tokens long, tokens binary")
    rows = rows.withColumn("bucket", F.conv(F.substring(F.hex("key"), 1, DIGITS), 16, 10).cast("int"))
    before = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    n_seq = F.ceil(F.col("n_tokens") / layout.length).cast("long")
    return stored(rows.select("bucket", F.coalesce(F.sum(n_seq).over(before), F.lit(0)).alias("start"), "doc_id", "n_tokens", "tokens"), "tokens", "zstd")


@dataclass(frozen=True)
class Order:
    """rows: slot, shard, doc_id, seq, n_tokens and tokens (not filled up), one shard to a partition in slot order. mark: of the data."""

    rows: DataFrame
    total: int
    layout: Layout
    mark: str


def training_order(docs: DataFrame, layout: Layout = Layout(), done: Callable[[int, Layout, str], DataFrame] | None = None) -> Order:
    """done, given the number of sequences, the layout and the mark, names the shards that aren't wanted (a column `shard`, MOST_SHARDS rows at most)."""
    length, texts = layout.length, encoded(docs, layout)
    n_seq = F.ceil(F.col("n_tokens") / length).cast("long")
    # a row for each bucket, whose number is bounded
    sizes = texts.groupBy("bucket").agg(F.max(F.col("start") + n_seq).alias("n"), F.bit_xor(F.xxhash64("start", "tokens")).alias("mark"))
    offsets = stored(sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"), "n", "mark"), "offsets")
    total, mark = offsets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.md5(F.concat_ws(",", F.sum("n"), F.bit_xor(F.xxhash64("bucket", "mark"))))).first()
    layout = layout.of(total)
    per_shard, key = layout.per_shard, layout.key

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            first = b.column("offset").to_numpy() + b.column("start").to_numpy()
            sizes = b.column("n_tokens").to_numpy()
            n = -(-sizes // length)
            row = np.repeat(np.arange(len(b)), n)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            records = [t[i : i + 2 * length] for t in b.column("tokens").to_pylist() for i in range(0, len(t), 2 * length)]
            slot = permuted(first[row] + seq, total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // per_shard), b.column("doc_id").take(pa.array(row)), pa.array(seq.astype(np.int64)), pa.array(np.minimum(length, sizes[row] - seq * length)), pa.array(records, pa.binary())],
                ["slot", "shard", "doc_id", "seq", "n_tokens", "tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.join(F.broadcast(offsets.select("bucket", "offset")), "bucket").select("start", "offset", "doc_id", "n_tokens", "tokens")
    records = rows.mapInArrow(trimmed(cut), f"slot long, shard long, doc_id {kind}, seq long, n_tokens long, tokens binary")
    if done is not None:
        records = records.join(F.broadcast(done(total, layout, mark)), "shard", "left_anti")
    shards = max(1, -(-total // per_shard))
    return Order(records.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot"), total, layout, mark)


def materialised(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """slot, shard, byte_offset, doc_id, seq, n_tokens and tokens (fixed stride), one shard to a partition in slot order."""
    order = training_order(docs, layout)
    stride = 2 * layout.length
    filled = F.expr(f"rpad(tokens, {stride}, X'{END.to_bytes(2, 'little').hex()}')")
    return order.rows.select("slot", "shard", (F.col("slot") % order.layout.per_shard * stride).alias("byte_offset"), "doc_id", "seq", "n_tokens", filled.alias("tokens"))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def file_system(path: str):
    """The file system of a folder that the driver and all executors reach: a mounted path, or a URI that pyarrow.fs knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_shards(path: str, total: int, layout: Layout) -> dict[int, str]:
    """Shard number -> file of the shards in the folder that have their full size; as many entries as shards at most."""
    from pyarrow import fs

    files, root = file_system(path)
    stride, out = 2 * layout.length, {}
    for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if (m := re.fullmatch(r"shard-(\d+)\.bin", f.base_name)) and f.size == stride * min(layout.per_shard, total - int(m[1]) * layout.per_shard):
            out[int(m[1])] = f.path
    return out


def write_shards(docs: DataFrame, path: str, layout: Layout = Layout()) -> DataFrame:
    """Writes the files; gives shard, n_records and crc32 of those that this call wrote (stored). Called again after a stop, it writes
    only what is missing. Each file has its place in path under a temporary name until it is whole, so a task that is lost or runs twice does no harm.
    """
    spark, stride = docs.sparkSession, 2 * layout.length

    def done(total: int, layout: Layout, mark: str) -> DataFrame:
        files, root = file_system(path)
        files.create_dir(root, recursive=True)
        want = json.dumps(asdict(layout) | {"total": total, "data": mark}, sort_keys=True)
        try:
            with files.open_input_stream(f"{root}/layout.json") as f:
                if f.read().decode() != want:
                    raise ValueError(f"{path} was begun with other data or another layout")
        except FileNotFoundError:
            with files.open_output_stream(f"{root}/layout.json") as f:
                f.write(want.encode())
        return spark.createDataFrame([(x,) for x in whole_shards(path, total, layout)], "shard long")

    order = training_order(docs, layout, done)
    fill = END.to_bytes(2, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        files, root = file_system(path)
        out, at, n, crc, name = None, None, 0, 0, ""

        def close():
            out.close()
            files.move(name, f"{root}/{shard_name(at)}")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([crc], pa.int64())], ["shard", "n_records", "crc32"])

        for b in batches:
            for shard, tokens in zip(b.column("shard").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                if shard != at:
                    if out is not None:
                        yield close()
                    at, n, crc, name = shard, 0, 0, f"{root}/_{shard_name(shard)}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(name)
                record = tokens + fill * ((stride - len(tokens)) // 2)
                out.write(record)
                n, crc = n + 1, zlib.crc32(record, crc)
        if out is not None:
            yield close()

    return stored(order.rows.select("shard", "tokens").mapInArrow(trimmed(write), "shard long, n_records long, crc32 long"), "manifest")


def read_shards(spark: SparkSession, path: str, slot: int = 0) -> DataFrame:
    """slot and tokens of the records from a slot on; files of earlier shards aren't opened, and no record before the slot is given."""
    files, root = file_system(path)
    with files.open_input_stream(f"{root}/layout.json") as f:
        said = json.loads(f.read())
    layout = Layout(**{k: v for k, v in said.items() if k not in ("total", "data")})
    stride, per_shard = 2 * layout.length, layout.per_shard
    shards = [x for x in sorted(whole_shards(path, said["total"], layout)) if x >= slot // per_shard]  # MOST_SHARDS at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        for b in batches:
            for shard in b.column("shard").to_pylist():
                at = max(0, slot - shard * per_shard)
                with files.open_input_file(f"{root}/{shard_name(shard)}") as f:
                    f.seek(at * stride)
                    while data := f.read(ROWS * stride):
                        k = len(data) // stride
                        yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + at + np.arange(k)), pa.array([data[i * stride : (i + 1) * stride] for i in range(k)], pa.binary())], ["slot", "tokens"])
                        at += k

    return spark.createDataFrame([(x,) for x in shards], "shard long").repartitionByRange(max(1, len(shards)), "shard").mapInArrow(read, "slot long, tokens binary")


def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(table(spark, sf_dir, "documents").select("doc_id", "text"))
