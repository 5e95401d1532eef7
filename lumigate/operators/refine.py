"""Second opinions: who gets one, and how it counts."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigate.operators.axes import Registry, role_scores, score_axes
from lumigate.operators.cascade import evaluate
from lumigate.operators.regions import aggregate_regions, region_scores
from lumigate.policy import Policy


def refine_band(evaluated: DataFrame, p: Policy) -> DataFrame:
    """Items not excluded within the band around the threshold, the nearest first, up to the policy's number."""
    gap = F.abs(F.col("score") - p.threshold)
    return evaluated.where(~F.col("excluded")).withColumn("gap", gap).where(F.col("gap") <= p.refine_band).orderBy("gap", "item_id").limit(p.refine_max)


def adjudication_band(evaluated: DataFrame, p: Policy) -> DataFrame:
    """The same, and items whose clearance isn't settled; those in the band first."""
    margin = max(0.05, p.refine_band * 0.65)
    unsettled = (F.abs(F.col("e_exclude") - p.exclude_at) <= margin) | (F.abs(F.col("e_clear") - p.min_clear) <= margin)
    rows = evaluated.where(~F.col("excluded")).withColumn("gap", F.abs(F.col("score") - p.threshold))
    inside = F.col("gap") <= p.refine_band
    return rows.where(inside | unsettled).withColumn("in_band", inside).orderBy(F.desc("in_band"), "gap", "item_id").limit(p.refine_max)


def refine_blend(base: Column, second: Column, weight: float) -> Column:
    """The base where there is no second score."""
    return F.when(second.isNull() | F.isnan(second), base).otherwise((1 - weight) * base + weight * second)


def join_verdicts(items: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their cached verdict, items without one) by content, model and prompt version."""
    key = ["content_hash", "model", "prompt_version"]
    return items.join(verdicts, key), items.join(verdicts, key, "left_anti")


class Window:
    """Calls of a function in the order of their arguments, at most `most` open at a time. A call that fails, or takes longer than `timeout` seconds from its start, gives None.

    Arguments are taken as calls come free, so a slow judge holds its input back. A call that ran out of time is given up: its thread is a daemon's, and it
    counts as open until it ends, so that a judge which hangs isn't asked more than it can bear; when all are stuck, the rest waits its time and gives None.
    """

    def __init__(self, ask: Callable[[int], str | None], most: int, timeout: float) -> None:
        self.ask, self.most, self.timeout = ask, most, timeout
        self.free = threading.Semaphore(most)

    def _call(self, item: int, out: Future) -> None:
        try:
            out.set_result(self.ask(item))
        except Exception:  # noqa: BLE001  the judge is a plug-in
            out.set_result(None)
        finally:
            self.free.release()

    def _begun(self, item: int) -> tuple[Future, float]:
        out: Future = Future()
        if self.free.acquire(timeout=self.timeout):
            threading.Thread(target=self._call, args=(item, out), daemon=True).start()
        else:
            out.set_result(None)
        return out, time.monotonic() + self.timeout

    def answers(self, items: Iterable[int]) -> Iterator[str | None]:
        waiting: deque[tuple[Future, float]] = deque()

        def first() -> str | None:
            out, until = waiting.popleft()
            try:
                return out.result(max(0.0, until - time.monotonic()))
            except TimeoutError:
                return None

        for item in items:
            if len(waiting) == self.most:
                yield first()
            waiting.append(self._begun(item))
        while waiting:
            yield first()


def judged(items: DataFrame, judge: Callable[[], Callable[[int], str | None]], in_flight: int = 4, timeout: float = 60.0) -> DataFrame:
    """item_id and the text that a judge, built once in a task, gives for it; null where it fails or takes too long, so that one item's failure stops no job.

    in_flight calls are open at a time in each task, so a cluster has that many times its tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = Window(judge(), in_flight, timeout)
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "text": pd.Series(list(window.answers(map(int, b["item_id"]))), dtype=object, index=b.index)})

    return items.select("item_id").mapInPandas(run, "item_id long, text string")


def second_opinions(band: DataFrame, views: DataFrame, best: DataFrame, reg: Registry, eligible: DataFrame, p: Policy) -> DataFrame:
    """item_id, score and flag (excluded) of a second model for the items of band (item_id, anchors).

    views: item_id, region_key, kind and embedding in the second model's namespace; reg has that model's prompts. Each item is judged by its full view and by that of its best region
    (best: item_id, region_key); without a full view there is no opinion. The band is bounded by the policy, so it is broadcast.
    """
    few = F.broadcast(band.select("item_id", "anchors"))
    own = views.join(few, "item_id").join(best.withColumnRenamed("region_key", "_best"), "item_id", "left").where("region_key = 'full' or region_key = _best")
    scores = region_scores(score_axes(own, reg, p.scale).select("item_id", "region_key", "kind", "axes"))
    wide = aggregate_regions(scores, eligible).where("score is not null").groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("axis", "score"))).alias("axes"))  # one entry an axis
    full = own.where("region_key = 'full'").select("item_id").distinct()
    rows = wide.join(full, "item_id", "left_semi").join(few, "item_id")
    return evaluate(role_scores(rows, reg), p, reg).select("item_id", F.col("base").alias("score"), F.col("excluded").alias("flag"))


def with_second(evaluated: DataFrame, verdicts: DataFrame, p: Policy) -> DataFrame:
    """Scores blended with second ones; a second opinion may add an exclusion and never take one away."""
    rows = evaluated.join(verdicts.select("item_id", F.col("score").alias("second"), F.col("flag").alias("second_flag")), "item_id", "left")
    flagged = F.col("excluded") | F.coalesce(F.col("second_flag"), F.lit(False))
    rows = rows.withColumn("excluded", flagged).withColumn("stage", F.when(flagged, "excluded").otherwise(F.col("stage")))
    return rows.withColumn("base", F.when(flagged, 0.0).otherwise(refine_blend(F.col("base"), F.col("second"), p.refine_weight))).drop("second", "second_flag")
