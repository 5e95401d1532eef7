"""The policy: validated settings whose protective part can only be tightened, and the axis registry's rules."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds and defaults that results depend on.
EXCLUDE_AT = 0.30
CLEAR_AT_LEAST = 0.25
MARGIN = 0.10
STRONGLY_AT = 0.75
ANCHORED_MARGIN = 0.05
WEAK_CLEAR_DETAIL = 0.35
ROLES = ("subject", "soft", "exclude", "clear", "detail", "policy")
#: key -> (kind, default, low, high or choices). Gate keys: high is the default (min_clear: low), so they only tighten.
SETTINGS = {
    "batch_size": ("int", "16", "1", "1024"),
    "threshold": ("float", "0.35", "0.0", "1.0"),
    "scale": ("float", "40.0", "0.01", "1000.0"),
    "classifier_weight": ("float", "0.7", "0.0", "100.0"),
    "zero_shot_weight": ("float", "0.3", "0.0", "100.0"),
    "policy_filter": ("choice", "include", None, "include,exclude,only"),
    "policy_threshold": ("float", "0.5", "0.0", "1.0"),
    "require_subject": ("bool", "false", None, None),
    "pipeline": ("choice", "cascade", None, "cascade,simple"),
    "deep_scan": ("choice", "candidates", None, "candidates,always,off"),
    "refine_band": ("float", "0.18", "0.0", "1.0"),
    "refine_max": ("int", "400", "0", "1000000"),
    "refine_weight": ("float", "0.65", "0.0", "1.0"),
    "max_learning_weight": ("float", "0.85", "0.0", "0.95"),
    "exclude_at": ("float", "0.3", "0.01", "0.3"),
    "min_clear": ("float", "0.25", "0.25", "1.0"),
    "margin": ("float", "0.1", "0.0", "0.1"),
    "strongly_at": ("float", "0.75", "0.0", "0.75"),
    "anchored_margin": ("float", "0.05", "0.0", "0.05"),
    "weak_clear_detail": ("float", "0.35", "0.0", "0.35"),
    "detail_weights": ("weights", "", None, None),
}
#: What a source may set for itself.
OVERRIDABLE = ("batch_size", "threshold", "scale", "classifier_weight", "zero_shot_weight", "policy_filter", "policy_threshold", "require_subject", "deep_scan", "refine_band", "refine_max", "refine_weight", "detail_weights")
#: Settings that only the simple pipeline reads.
SIMPLE_ONLY = ("classifier_weight", "zero_shot_weight")


@dataclass(frozen=True)
class Policy:
    threshold: float = 0.35
    scale: float = 40.0
    subject_gate: float = 0.35
    require_subject: bool = False
    subject_at: float = 0.5
    require_soft: bool = True
    soft_at: float = 0.0
    policy_filter: str = "include"
    policy_threshold: float = 0.5
    deep_scan: str = "candidates"
    exclude_at: float = EXCLUDE_AT
    min_clear: float = CLEAR_AT_LEAST
    margin: float = MARGIN
    strongly_at: float = STRONGLY_AT
    anchored_margin: float = ANCHORED_MARGIN
    weak_clear_detail: float = WEAK_CLEAR_DETAIL
    refine_band: float = 0.18
    refine_max: int = 400
    refine_weight: float = 0.65
    max_learning_weight: float = 0.85

    def __post_init__(self):
        """Protective constants are held to their defaults or tighter, whatever was asked for."""
        for name, most in (("exclude_at", EXCLUDE_AT), ("margin", MARGIN), ("strongly_at", STRONGLY_AT), ("anchored_margin", ANCHORED_MARGIN), ("weak_clear_detail", WEAK_CLEAR_DETAIL)):
            value = getattr(self, name)
            object.__setattr__(self, name, most if value != value else max(0.0, min(most, value)))
        object.__setattr__(self, "exclude_at", max(0.01, self.exclude_at))
        object.__setattr__(self, "min_clear", CLEAR_AT_LEAST if self.min_clear != self.min_clear else min(1.0, max(CLEAR_AT_LEAST, self.min_clear)))

    def with_(self, **changes) -> Policy:
        return replace(self, **{k: v for k, v in changes.items() if k in {f.name for f in fields(self)}})


#: Settings of a source that take effect where its items are gated, and what they are.
EFFECTIVE = {"threshold": "double", "scale": "double", "policy_filter": "string", "policy_threshold": "double", "require_subject": "boolean", "refine_band": "double", "refine_max": "int", "refine_weight": "double"}


class BySource:
    """A policy whose overridable settings are columns of the row's source (see `by_source`); all else, the gate's constants among it, is the base policy's."""

    def __init__(self, base: Policy) -> None:
        self._base = base
        for name in EFFECTIVE:
            own = F.col(f"own.{name}")
            setattr(self, name, F.coalesce(own, F.lit(getattr(base, name))))
        self.weights = F.col("own.weights")

    def __getattr__(self, name: str):
        return getattr(self._base, name)


def weights_of(text: Column) -> Column:
    """A map of weights from JSON: what isn't a number of 0 or more is left out; null if nothing is left."""
    pairs = F.map_entries(F.from_json(text, "map<string, string>"))
    number = lambda e: e["value"].try_cast("double")
    good = F.filter(pairs, lambda e: number(e).isNotNull() & ~F.isnan(number(e)) & (number(e) >= 0))
    return F.when(F.size(good) > 0, F.map_from_entries(F.transform(good, lambda e: F.struct(e["key"], number(e).alias("value")))))


def by_source(asked: DataFrame, settings: DataFrame) -> DataFrame:
    """source and own, a struct of the effective settings that the source may set and has set (null: the policy's), and its weights, which replace the registry's."""
    held = bounded(split_overrides(asked).where("accepted"), settings)
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    own = F.struct(*[of(k).cast(kind).alias(k) for k, kind in EFFECTIVE.items()], weights_of(of("detail_weights")).alias("weights"))
    return held.where("source is not null").groupBy("source").agg(own.alias("own"))


def check_roles(roles: dict[str, str]) -> None:
    """A registry has exactly one axis to exclude by and one that clears; there is no way to go without."""
    check_role_counts(Counter(r if r in ROLES else None for r in roles.values()))


def check_role_counts(axes: dict[str | None, int]) -> None:
    """The same by the number of axes of each role; None counts those of no known role, or of two."""
    for role in ("exclude", "clear"):
        if axes.get(role, 0) != 1:
            raise ValueError(f"the registry must declare exactly one axis with the role {role}")
    if axes.get(None):
        raise ValueError(f"{axes[None]} axes have no role, two, or one that isn't among {', '.join(ROLES)}")


def settings_table(spark) -> DataFrame:
    rows = [(k, kind, d, None if kind not in ("int", "float") else float(low), None if kind not in ("int", "float") else float(high), high if kind == "choice" else None) for k, (kind, d, low, high) in SETTINGS.items()]
    return spark.createDataFrame(rows, "key string, kind string, default string, low double, high double, choices string")


def bounded(asked: DataFrame, settings: DataFrame) -> DataFrame:
    """source, key and the effective value: floats are held to their bounds, other bad values give the default."""
    s = asked.join(F.broadcast(settings), "key")
    number = F.expr("try_cast(trim(value) AS double)")
    sound = number.isNotNull() & ~F.isnan(number)
    whole = F.expr("try_cast(trim(value) AS bigint)")
    value = (
        F.when(F.col("kind") == "float", F.when(sound, F.greatest("low", F.least("high", number))).otherwise(F.col("default").try_cast("double")).cast("string"))
        .when(F.col("kind") == "int", F.when(whole.between(F.col("low"), F.col("high")), whole).otherwise(F.col("default").try_cast("bigint")).cast("string"))
        .when(F.col("kind") == "weights", F.when(weights_of(F.col("value")).isNotNull(), F.col("value")).otherwise(F.col("default")))
        .when(F.col("kind") == "choice", F.when(F.array_contains(F.split("choices", ","), F.col("value")), F.col("value")).otherwise(F.col("default")))
        .otherwise(F.when(F.col("value").isin("true", "false"), F.col("value")).otherwise(F.col("default")))
    )
    return s.select("source", "key", value.alias("value"))


def split_overrides(asked: DataFrame) -> DataFrame:
    """asked with accepted: whether a source may set the key."""
    return asked.withColumn("accepted", F.col("key").isin(*OVERRIDABLE))


def resolved(asked: DataFrame, settings: DataFrame) -> DataFrame:
    """source, key and value for every source and setting: its accepted override in bounds, else the default."""
    keys = F.broadcast(settings.select("key", "default", "kind"))
    every = asked.select("source").distinct().join(keys)
    own = bounded(split_overrides(asked).where("accepted"), settings)
    base = F.when(F.col("kind") == "float", F.col("default").try_cast("double").cast("string")).otherwise(F.col("default"))
    return every.join(own, ["source", "key"], "left").select("source", "key", F.coalesce("value", base).alias("value"))


def inert(asked: DataFrame) -> DataFrame:
    """Settings that have no effect under the pipeline the source asks for."""
    simple = asked.where((F.col("key") == "pipeline") & (F.col("value") == "simple")).select("source")
    return asked.where(F.col("key").isin(*SIMPLE_ONLY)).join(simple, "source", "left_anti").select("source", "key")


