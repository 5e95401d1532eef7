"""Decisions, manifests and report rows. What is written of items passes the gate in the sink itself, whatever rows the caller hands in."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigate.functions.text import score_band
from lumigate.operators.cascade import visible
from lumigate.operators.storage import stored
from lumigate.policy import BySource, Policy

log = logging.getLogger(__name__)


def decisions(shown: DataFrame, threshold: float) -> DataFrame:
    return shown.select("item_id", "score", F.when(F.col("score") >= threshold, "match").otherwise("no_match").alias("decision"))


def rejects(rows: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """item_id and reason of rows that have a fault: the first of faults (reason: whether a row has it) that holds."""
    reason = F.coalesce(*[F.when(has, why) for why, has in faults.items()])
    return rows.select("item_id", reason.alias("reason")).where("reason is not null")


def held(rows: DataFrame, evaluated: DataFrame, p: Policy | BySource, ids: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """rows whose items, by all of ids, the gate lets through: those that `visible` gives of the evaluated frame. A null id, or one that wasn't evaluated, is not seen."""
    seen = visible(evaluated, p).select("item_id").distinct()
    for name in ids:
        rows = rows.join(seen.withColumnRenamed("item_id", name), name, "left_semi")
    return rows


def write_items(rows: DataFrame, evaluated: DataFrame, p: Policy | BySource, path: str, form: str = "parquet", by: list[str] | None = None, ids: tuple[str, ...] = ("item_id",)) -> None:
    """The sink of rows about items: it takes the evaluated frame and joins the visible ids itself, so excluded rows that it is handed are not written."""
    write_table(held(rows, evaluated, p, ids), path, form, by)


def write_decisions(evaluated: DataFrame, p: Policy | BySource, path: str, form: str = "parquet") -> None:
    """Decisions straight from an evaluated frame, which holds excluded rows."""
    scored = evaluated if "score" in evaluated.columns else evaluated.withColumn("score", F.col("base"))
    write_items(decisions(scored, p.threshold), evaluated, p, path, form)


def write_table(rows: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Rows that aren't about items (rejects, labels, counts): Parquet, CSV with a header, or JSON lines, in folders by columns if wanted."""
    w = rows.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).format(form).save(path)


def folders(organization: str, label: Column, score: Column) -> Column:
    """The folder of an item: flat, by band, by label, or by label and band."""
    band = score_band(score)
    return {"score_band": band, "label": label, "score_band_label": F.concat_ws("/", label, band)}.get(organization, F.lit(""))


def ranked(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """rows with their number from 1 by order among those of the same `by`, and no task that has all rows of one value.

    Ranges of (by, order) are stored; a row's number is that in its range plus the counts of the value's ranges before.
    """
    dealt = stored(rows.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy(by, "_part").count().select(by, "_part", before.alias("_before"))
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy(by, "_part").orderBy(order))).join(counts, [by, "_part"], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def suffixed(name: Column, k: Column) -> Column:
    """A name with _k before its extension."""
    ext = F.regexp_extract(name, r"(?<=[^/])(\.[^./]+)$", 1)
    return F.concat(F.left(name, F.length(name) - F.length(ext)), F.lit("_"), k.cast("string"), ext)


def renamed(clashing: DataFrame, taken: DataFrame) -> DataFrame:
    """clashing (wanted, and _k from 1) with destination: the _k-th suffix that gives no name of taken (destination)."""
    forms = [(r"_([1-9][0-9]{0,17})(\.[^./]+)$", "$2"), (r"_([1-9][0-9]{0,17})$", "")]
    found = [F.struct(F.regexp_replace("destination", r, rest).alias("wanted"), F.nullif(F.regexp_extract("destination", r, 1), F.lit("")).cast("long").alias("number")) for r, rest in forms]
    most = clashing.groupBy("wanted").agg(F.max("_k").alias("most"))
    used = taken.select("destination", F.explode(F.array(*found)).alias("x")).select("destination", "x.*").where(F.col("number").isNotNull() & (suffixed(F.col("wanted"), F.col("number")) == F.col("destination")))
    used = ranked(used.select("wanted", "number").distinct().join(most, "wanted"), "wanted", "number", "_i")
    # between the i-th used number and the next one, a row's number is its own count plus i
    start = used.select("wanted", F.lit(0).cast("long").alias("number"), "most", F.lit(0).cast("long").alias("_i")).distinct()
    after = used.select("wanted", (F.col("_i") - 1).alias("_i"), F.col("number").alias("next"))
    gaps = start.unionByName(used.select("wanted", "number", "most", F.col("_i").cast("long"))).join(after, ["wanted", "_i"], "left")
    gaps = gaps.withColumn("lo", F.col("number") - F.col("_i") + 1).withColumn("hi", F.least("most", F.col("next") - F.col("_i") - 1)).where("lo <= hi")
    free = gaps.select("wanted", "_i", "hi", F.explode(F.sequence("lo", "hi", F.lit(4096).cast("long"))).alias("lo"))
    free = free.select("wanted", "_i", F.explode(F.sequence("lo", F.least(F.col("lo") + 4095, "hi"))).alias("_k"))
    number = F.col("_k") + F.coalesce("_i", F.lit(0))
    return clashing.join(free, ["wanted", "_k"], "left").withColumn("destination", suffixed(F.col("wanted"), number)).drop("_i")


def manifest(rows: DataFrame, existing: DataFrame, policy: str = "rename") -> DataFrame:
    """rows (item_id, folder, name) with destination, action, collision and reason of a copy.

    Under `rename` the first row of a destination keeps it if no file is there, and the others get suffixes in order of
    item_id: the n-th row the n-th number whose name no existing file has and no row wants. Every row has a name of its own.
    """
    dest = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    there = existing.select(F.col("destination").alias("wanted"), F.lit(1).alias("_there")).distinct()
    at = ranked(rows.withColumn("wanted", dest), "wanted", "item_id", "_n").join(there, "wanted", "left")
    at = at.withColumn("_k", (F.col("_n") - 1 + F.coalesce("_there", F.lit(0))).cast("long")).withColumn("collision", F.col("_k") > 0)
    if policy == "skip":
        return at.select("item_id", F.col("wanted").alias("destination"), F.when(F.col("collision"), "skip").otherwise("copy").alias("action"), "collision", F.when(F.col("collision"), "duplicate exists").otherwise("").alias("reason"))
    if policy == "overwrite":
        return at.select("item_id", F.col("wanted").alias("destination"), F.when(F.col("collision"), "overwrite").otherwise("copy").alias("action"), "collision", F.lit("").alias("reason"))
    at = stored(at.select("item_id", "wanted", "_k", "collision"), "manifest")
    taken = existing.select("destination").unionByName(at.select(F.col("wanted").alias("destination"))).distinct()
    clashing, dotted = at.where("collision"), F.coalesce(F.endswith(F.col("wanted"), F.lit(".")), F.lit(False))
    named = renamed(clashing.where(~dotted), taken)
    # 'b_2.' with _1 and 'b._1' with _2 are one name: names that end in a dot come after the others
    if not clashing.where(dotted).isEmpty():
        named = stored(named, "renamed")
        named = named.unionByName(renamed(clashing.where(dotted), taken.unionByName(named.select("destination"))))
    out = at.where(~F.col("collision")).withColumn("destination", F.col("wanted")).unionByName(named)
    return out.select("item_id", "destination", F.lit("copy").alias("action"), "collision", F.when(F.col("collision"), "renamed").otherwise("").alias("reason"))


def result_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action", "reason").agg(F.count("*").alias("n"))


def report_rows(shown: DataFrame, axes: Column) -> DataFrame:
    """Score, label and escaped axis text of a report's cards."""
    safe = F.replace(F.replace(F.replace(F.col("name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(axes)), lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.3f", F.round(x["value"], 10)))), ", ")
    return shown.select("item_id", safe.alias("name"), F.format_string("%.3f", F.round("score", 10)).alias("score_text"), "label_name", text.alias("axis_text"))


def result_hook(shown: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's transformation of review rows; what it returns is held to visible items, and its failure leaves the rows.

    Its result is stored, so that a failure in a task is met here and not in what is done with the rows later.
    """
    try:
        return stored(shown.transform(hook).join(shown.select("item_id").distinct(), "item_id", "left_semi"), "hook")
    except Exception:  # noqa: BLE001  a hook that can't be planned or fails in a task is as if there were none
        log.exception("a result hook failed; its rows are those before it")
        return shown
