"""A store of vectors by content and namespace: each content is embedded once in a namespace, whatever run, batch or stream brings it.

Layout: namespace=<ns>/batch=<run>-<number>/*.parquet with content_hash, vector, and version. A reader of one namespace prunes the others by
folder. A batch writes a folder of its own name and replaces what an earlier try of the same batch left there; what it adds is what no other batch of
the namespace has. So a batch that runs twice adds nothing, and one that broke off leaves nothing half.

One writer to a namespace at a time; readers at any time. `compact` merges the batches of a namespace into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumigate.operators.storage import delete, exists, forget, stored

SCHEMA = T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("version", T.IntegerType()), T.StructField("namespace", T.StringType()), T.StructField("batch", T.StringType())])
#: Under so many hashes (60 bytes each) a batch's side is broadcast, and the store is scanned by hash alone without a shuffle.
BROADCAST_HASHES = 1_000_000


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, version: int = 1) -> None:
        """version: of the decoding that vectors derive from. Rows of other versions count as absent and are replaced."""
        self.spark, self.path, self.version = spark, path.rstrip("/"), version

    def read(self, namespace: str | None = None) -> DataFrame:
        """content_hash, vector, namespace and batch of this version's vectors; a namespace is a filter on folders."""
        rows = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], SCHEMA)
        rows = rows if namespace is None else rows.where(F.col("namespace") == namespace)
        return rows.where(F.col("version") == self.version).drop("version")

    def missing(self, contents: DataFrame, namespace: str, batch: str = "") -> DataFrame:
        """Distinct rows of contents (content_hash and others; one row a hash) without a vector in the namespace. What `batch` itself wrote counts as missing."""
        once = contents.where("content_hash is not null").dropDuplicates(["content_hash"])
        keys = stored(once.select("content_hash"), "store-keys")
        few = keys.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
        have = self.read(namespace).where(F.col("batch") != batch).select("content_hash")
        known = have.join(F.broadcast(keys), "content_hash", "left_semi").distinct() if few else have
        return once.join(F.broadcast(known) if few else known, "content_hash", "left_anti")

    def add(self, vectors: DataFrame, namespace: str, batch: str) -> None:
        """Writes vectors (content_hash, vector) as the batch, in place of what it wrote before."""
        rows = vectors.select(F.col("content_hash").cast("string").alias("content_hash"), F.col("vector").cast("array<double>").alias("vector"), F.lit(self.version).alias("version"))
        rows.write.mode("overwrite").parquet(self._folder(namespace, batch))

    def fill(self, contents: DataFrame, namespace: str, embed: Callable[[DataFrame], DataFrame], batch: str) -> None:
        """Embeds the contents that the namespace lacks, and adds their vectors as the batch. embed: rows with content_hash to (content_hash, vector)."""
        self.add(embed(self.missing(contents, namespace, batch)), namespace, batch)

    def fill_from(self, stream: DataFrame, namespace: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str, run: str = "stream") -> StreamingQuery:
        """The same for what a stream has now, by micro-batches of a run: contents that another batch, run or stream has added are known."""

        def add(rows: DataFrame, number: int) -> None:
            self.fill(rows, namespace, embed, f"{run}-{number}")

        return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def compact(self, namespace: str) -> None:
        """One batch in place of all: written beside them, and they are deleted after. If it stops between, a reader has rows twice, and `compact` again mends it."""
        rows = self.read(namespace)
        old = [r["batch"] for r in rows.select("batch").distinct().collect()]  # names of folders
        name = f"compact{sum(b.startswith('compact') for b in old)}"
        while name in old:
            name += "x"
        self.add(rows.dropDuplicates(["content_hash"]), namespace, name)
        for b in old:
            delete(self.spark, self._folder(namespace, b))

    def _folder(self, namespace: str, batch: str) -> str:
        for part in (namespace, batch):
            if not part or not all(c.isalnum() or c in "_-." for c in part):
                raise ValueError(f"a namespace and a batch are letters, digits, '_', '-' and '.': {part!r}")
        return f"{self.path}/namespace={namespace}/batch={batch}"


def give_once(stream: DataFrame, store: VectorStore, namespace: str, checkpoint: str, out: str, run: str = "stream") -> StreamingQuery:
    """Contents of a stream (content_hash and others) that were never given before, appended to out; the store keeps what was given.

    The known set is the operator's own: no watermark bounds it, and a new checkpoint doesn't forget it. out is written before the store is, so a batch that breaks off
    between the two gives the same rows again, into the same folder.
    """

    def give(rows: DataFrame, number: int) -> None:
        batch = f"{run}-{number}"
        new = stored(store.missing(rows, namespace, batch), "given")
        new.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        store.add(new.select("content_hash", F.array().cast("array<double>").alias("vector")), namespace, batch)
        forget(new)

    return stream.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
