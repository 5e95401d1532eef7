"""Names, labels, bands and lenient parsing as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigate.functions.vector import clip, evidence
from lumigate.functions.verdicts import object_scores

# Bands and label names that outputs use.
BAND_HIGH, BAND_MEDIUM = 0.7, 0.35
LABELS = {1: "good", 0: "bad", 2: "skip"}


def score_band(score: Column, low: float = BAND_MEDIUM, high: float = BAND_HIGH) -> Column:
    return F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")


def label_name(label: Column) -> Column:
    out = F.lit("unlabeled")
    for code, name in LABELS.items():
        out = F.when(label == code, name).otherwise(out)
    return out


def prompt_normalize(prompts: DataFrame) -> DataFrame:
    """axis, prompt and weight of axis, pos, text, weight (text): stripped, blanks dropped, bad weights 1; an axis of blanks keeps one."""
    w = F.expr("try_cast(weight AS double)")
    rows = prompts.select("axis", "pos", F.trim("text").alias("prompt"), F.when(w > 0, w).otherwise(1.0).alias("weight"))
    kept = rows.where(F.length("prompt") > 0)
    blank = prompts.select("axis").distinct().join(kept.select("axis").distinct(), "axis", "left_anti")
    return kept.unionByName(blank.select("axis", F.lit(0).cast("int").alias("pos"), F.lit("").alias("prompt"), F.lit(1.0).alias("weight")))


def sanitize_name(name: Column) -> Column:
    held = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00]', "_"), r"(?U)^\s+|\s+$", ""), r"^\.+|\.+$", "")
    return F.when(F.length(held) > 0, held).otherwise("output")


def format_output_name(path: Column, score: Column, label: Column, index: Column, stamp: Column, template: str) -> Column:
    """A name from a template of {stem}, {name}, {ext}, {score}, {score_pct}, {index}, {date}, {timestamp}, {label}; others become empty."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    stem = F.when(F.length(ext) > 0, F.expr("1")).otherwise(F.lit(0))
    stem = F.when(stem == 1, F.left(name, F.length(name) - F.length(ext))).otherwise(name)
    values = {
        "stem": stem, "name": name, "ext": ext, "score": F.format_string("%.3f", score), "score_pct": F.format_string("%.1f", score * 100),
        "index": F.when(F.length(index.cast("string")) >= 4, index.cast("string")).otherwise(F.lpad(index.cast("string"), 4, "0")), "date": F.date_format(stamp, "yyyyMMdd"), "timestamp": F.date_format(stamp, "yyyyMMdd_HHmmss"), "label": label, "label_name": label,
    }
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    out = sanitize_name(F.regexp_replace(out, r"\{[^{}]*\}", ""))
    return F.when(F.endswith(F.lower(out), F.lower(ext)), out).otherwise(F.concat(out, ext))


def region_kind(keys: DataFrame, kinds: DataFrame) -> DataFrame:
    """keys (region_key) with the kind of the longest prefix in kinds (prefix, kind); 'full' is itself, anything else a band."""
    found = keys.join(F.broadcast(kinds), F.col("region_key").startswith(F.col("prefix")), "left")
    best = found.groupBy("region_key").agg(F.max_by("kind", F.length("prefix")).alias("k"))
    return best.select("region_key", F.when(F.col("region_key") == "full", "full").otherwise(F.coalesce("k", F.lit("band"))).alias("kind"))


def redact_roots(message: Column, roots: list[str]) -> Column:
    """Private roots replaced by ~, the longest first."""
    for root in sorted(filter(None, roots), key=len, reverse=True):
        message = F.replace(message, F.lit(root), F.lit("~"))
    return message


def parse_verdict(text: Column, axes: list[str]) -> Column:
    """A lenient model's answer as map of axis to 0..1: fences stripped, the whole as JSON, else the first object that can be read from a brace on;
    null if there is none, or the whole is JSON but no object. Only texts that aren't JSON as a whole go to the scanner."""
    bare = F.trim(F.regexp_replace(text, "(?i)```(json)?", ""))
    whole = F.try_parse_json(bare)
    is_object = F.startswith(F.schema_of_variant(whole), F.lit("OBJECT"))

    def number(raw: Column) -> Column:
        x = F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double"))
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), clip(x))

    def picked(value: Callable[[str], Column]) -> Column:
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(a).alias("key"), value(a).alias("value")) for a in axes]), lambda x: x["value"].isNotNull()))

    found = F.from_json(object_scores(F.when(whole.isNull(), bare)), "map<string, double>")
    of_whole = picked(lambda a: number(F.try_variant_get(whole, f"$.{a}", "string")))
    return F.when(whole.isNotNull(), F.when(is_object, of_whole)).when(found.isNotNull(), picked(lambda a: clip(found[a])))


def axis_details(axes: Column, shown: dict[str, str], anchors: Column, region: Column) -> Column:
    """A compact line of evidence; shown: label -> axis."""
    parts = [F.when(axes[a].isNotNull(), F.format_string(f"{label} %.2f", F.round(evidence(axes[a]), 10))) for label, a in shown.items()]
    parts.append(F.when(anchors >= 0, F.format_string("anchors %d", anchors)))
    parts.append(F.when(~F.coalesce(region, F.lit("")).isin("", "full"), F.concat(F.lit("region "), region)))
    return F.concat_ws("  ", *parts)


def dominant_axis(axes: Column, groups: dict[str, list[str]], least: float = 0.2, other: str = "Other") -> Column:
    """The group with the most evidence, the first listed at a tie; `other` under `least`."""
    values = {g: F.greatest(*[F.coalesce(evidence(axes[a]), F.lit(0.0)) for a in names], F.lit(0.0)) for g, names in groups.items()}
    most = F.greatest(*values.values(), F.lit(0.0))
    out = F.when(most < least, other)
    for g, v in values.items():
        out = out.when(v == most, g)
    return out


def oriented_size(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height as seen: orientations 5 to 8 lie on their side."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))
