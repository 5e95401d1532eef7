"""The fold of label events with state: each item's newest event, kept by Spark's state store from batch to batch.

An event counts if it is newer than what the item has: by seq, then by label, a clearing one (null) least. So late and repeated events change nothing,
whatever batch they come in, and no batch is read again. A cleared item keeps its seq, that an older label can't bring it back.
`current` reads the fold from the state itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumigate.operators.storage import rocks

EVENT = "item_id long, seq long, label int"
NEWEST = "newest"


def order(seq: int, label: int | None) -> tuple[int, bool, int]:
    return seq, label is not None, label or 0


def newest_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest event of each item of an Arrow batch: an item with very many events comes to few rows before they are dealt by item."""
    for b in batches:
        rows = pa.Table.from_batches([b])
        # nulls would sort last, but are least among events of one seq
        code = pc.fill_null(rows["label"], -(2**31))
        rows = rows.append_column("code", code).sort_by([("item_id", "ascending"), ("seq", "ascending"), ("code", "ascending")]).drop_columns("code")
        ids = rows["item_id"].to_pandas()
        yield from rows.filter(pa.array(~ids.duplicated(keep="last"))).to_batches()


class NewestLabel(StatefulProcessor):
    """State by item: seq and label of its newest event. Gives the items whose newest event is another now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState(NEWEST, "seq long, label int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = self.newest.get() if self.newest.exists() else None
        found = max((order(r["seq"], r["label"]) + (r["label"],) for r in rows), key=lambda x: x[:3])
        if was is None or found[:3] > order(*was):
            self.newest.update((found[0], found[3]))
            yield Row(item_id=key[0], seq=found[0], label=found[3])


def fold_labels(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds events (item_id, label, seq) that there are now; a later call with the same checkpoint goes on. Changed items go to path, a folder for
    each micro-batch, so one that runs twice writes the same folder. Events without item or seq are left out."""
    events = stream.select(F.col("item_id").cast("long").alias("item_id"), F.col("seq").cast("long").alias("seq"), F.col("label").cast("int").alias("label"))
    events = events.where("item_id is not null and seq is not null").mapInArrow(newest_of_batches, EVENT)
    changed = events.groupBy("item_id").transformWithState(NewestLabel(), EVENT, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocks(stream.sparkSession):
        return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """item_id and label of items whose newest event sets one, from the state of the last batch."""
    rows = spark.read.format("statestore").option("stateVarName", NEWEST).load(checkpoint)
    return rows.select("key.item_id", "value.label").where("label is not null")


def changes(spark: SparkSession, path: str) -> DataFrame:
    """What each batch changed: item_id, seq, label and batch; a null label clears."""
    return spark.read.schema(EVENT + ", batch long").option("basePath", path).parquet(path)
