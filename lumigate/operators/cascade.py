"""The gate cascade: protective exclusion that fails closed, soft gates, detail, stages and the base score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigate.functions.vector import clip, evidence, ramp
from lumigate.operators.axes import Registry, role_scores, score_axes
from lumigate.policy import BySource, Policy

# The gate's shape beside the policy's bounds.
ANCHORED_SHARE = 0.4  # of exclude_at, from which an anchored item may look excluded
CLEAR_SHARE = 0.6  # of exclude_at, from which the score falls
ANCHORED_SUBJECT = 0.85
SOFT_LEAST = 0.25
#: Under so many sources (a kilobyte each) their settings are broadcast; beyond it Spark shuffles.
BROADCAST_SOURCES = 50_000
STAGES = ("excluded", "no_subject", "soft_fail", "scored")


def combine_detail(scores: list[Column], weights: list[float], strongest: float = 0.65, average: float = 0.35) -> Column:
    """Mostly the strongest axis, with a share for the mean; halved where nothing backs a weak one up."""
    parts = [clip(evidence(s) * min(w, 1.0)) for s, w in zip(scores, weights, strict=True) if w > 0]
    if not parts:
        return F.lit(0.0)
    every = F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts])
    most = F.array_max(every)
    mean = F.aggregate(every, F.lit(0.0), lambda s, x: s + x) / len(parts)
    backed = F.size(F.filter(every, lambda x: x >= 0.15))
    raw = strongest * most + average * mean
    return F.when((backed < 2) & (most < 0.55), raw * 0.5).otherwise(raw)


def combine_detail_by(scores: list[Column], weights: list[Column], strongest: float = 0.65, average: float = 0.35) -> Column:
    """The same where each row has its own weights; null, as one not above 0, leaves the axis out."""
    one = F.array(*[F.when(w > 0, F.coalesce(clip(evidence(s) * F.least(w, F.lit(1.0))), F.lit(0.0))) for s, w in zip(scores, weights, strict=True)])
    every = F.filter(one, lambda x: x.isNotNull())
    most = F.coalesce(F.array_max(every), F.lit(0.0))
    mean = F.aggregate(every, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(every), F.lit(1))
    raw = strongest * most + average * mean
    return F.when((F.size(F.filter(every, lambda x: x >= 0.15)) < 2) & (most < 0.55), raw * 0.5).otherwise(raw)


def detail_of(axes: Column, reg: Registry, own: Column | None = None) -> Column:
    """The detail by the registry's weights, or by a row's own map of weights, which replaces them where it isn't null."""
    weights = reg.detail_weights
    if own is None:
        return combine_detail([axes[a] for a in weights], list(weights.values()))
    return combine_detail_by([axes[a] for a in weights], [F.when(own.isNull(), F.lit(w)).otherwise(own[a]) for a, w in weights.items()])


def _if(flag: bool | Column, yes: Column, no: Column) -> Column:
    return F.when(flag, yes).otherwise(no) if isinstance(flag, Column) else yes if flag else no


def excluded(exclude: Column, clear: Column, detail: Column, anchors: Column, p: Policy) -> Column:
    """True where the protective gate holds: by evidence, by a weak clearance on anything worth showing, or by not knowing."""
    anchored = F.coalesce(anchors > 0, F.lit(False))
    looks = (exclude >= p.exclude_at) & (exclude > clear + p.margin)
    strongly = exclude >= p.strongly_at
    anchored_looks = anchored & (exclude > clear + p.anchored_margin) & (exclude >= p.exclude_at * ANCHORED_SHARE)
    weak = (detail >= p.weak_clear_detail) & (clear < p.min_clear)
    return exclude.isNull() | clear.isNull() | F.coalesce(looks | strongly | anchored_looks | weak, F.lit(True))


def soft_factors(subject: Column, soft: Column, exclude: Column, anchors: Column, p: Policy | BySource) -> dict[str, Column]:
    anchored = F.coalesce(anchors > 0, F.lit(False))
    one = F.lit(1.0)
    of_subject = _if(p.require_subject, F.greatest(ramp(subject, p.subject_gate, p.subject_gate + 0.2), F.when(anchored, ANCHORED_SUBJECT).otherwise(0.0)), one)
    of_soft = F.greatest(ramp(soft, max(0.0, p.soft_at - 0.05), p.soft_at + 0.35), F.lit(SOFT_LEAST)) if p.require_soft else one
    return {"gate_subject": of_subject, "gate_soft": of_soft, "gate_clear": 1 - ramp(exclude, p.exclude_at * CLEAR_SHARE, p.exclude_at)}


def evaluate(scored: DataFrame, p: Policy | BySource, reg: Registry) -> DataFrame:
    """scored (axes, role scores, anchors) with evidence, gates, detail, stage and base score. Internal: holds excluded rows.

    The roles' weights are the registry's own; without a detail axis the gate could not tell what is worth showing. A row's own weights may
    lower its detail for ranking only: what the gate asks a clearance for is the greater of the two.
    """
    if not reg.detail_weights:
        raise ValueError("the registry must declare an axis with the role detail")
    half = F.lit(0.5)
    ev = scored.withColumns({f"e_{r}": evidence(F.col(r) if r in ("exclude", "clear") else F.coalesce(F.col(r), half)) for r in ("subject", "soft", "exclude", "clear")})
    own = p.weights if isinstance(p, BySource) else None
    ev = ev.withColumn("detail", detail_of(F.col("axes"), reg, own))
    asked = F.col("detail") if own is None else F.greatest(F.col("detail"), detail_of(F.col("axes"), reg))
    ev = ev.withColumn("excluded", excluded(F.col("e_exclude"), F.col("e_clear"), asked, F.col("anchors"), p))
    ev = ev.withColumns(soft_factors(F.col("e_subject"), F.col("e_soft"), F.col("e_exclude"), F.col("anchors"), p))
    has_subject = _if(p.require_subject, (F.col("e_subject") >= p.subject_gate) | F.coalesce(F.col("anchors") > 0, F.lit(False)), F.lit(True))
    soft_ok = F.col("e_soft") >= p.soft_at if p.require_soft else F.lit(True)
    stage = F.when(F.col("excluded"), "excluded").when(~has_subject, "no_subject").when(~soft_ok, "soft_fail").otherwise("scored")
    factor = F.col("gate_subject") * F.col("gate_soft") * F.col("gate_clear")
    return ev.withColumns({"stage": stage, "gate_factor": factor}).withColumn("base", F.when(F.col("excluded"), 0.0).otherwise(F.col("detail") * F.col("gate_factor")))


def evaluate_by_source(items: DataFrame, reg: Registry, settings: DataFrame, p: Policy, vector: str = "embedding") -> DataFrame:
    """items (source, anchors, and the vector) evaluated with each source's own settings; a source without any has those of p.

    settings: one row a source, by `policy.by_source`. The gate is held twice, under p and under the source's own scale and weights,
    and an item that either excludes is excluded: a flatter scale or a dropped weight can't bring one back.
    """
    rows = score_axes(items.drop("axes"), reg, p.scale, vector).withColumnRenamed("axes", "_all")
    base = evaluate(role_scores(rows.withColumnRenamed("_all", "axes"), reg), p, reg).select(*items.columns, F.col("excluded").alias("_held"))
    few = settings.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = base.join(F.broadcast(settings) if few else settings, "source", "left")
    own = BySource(p)
    scored = role_scores(score_axes(named, reg, own.scale, vector), reg)
    out = evaluate(scored, own, reg).withColumn("excluded", F.col("excluded") | F.col("_held"))
    return out.withColumns({"stage": F.when(F.col("excluded"), "excluded").otherwise(F.col("stage")), "base": F.when(F.col("excluded"), 0.0).otherwise(F.col("base"))}).drop("_held")


def stage_counts(evaluated: DataFrame) -> DataFrame:
    """The only thing said about excluded items: how many."""
    return evaluated.groupBy("stage").agg(F.count("*").alias("n"))


def visible(evaluated: DataFrame, p: Policy | BySource) -> DataFrame:
    """The one door to every sink and view: what the gate and the policy let through."""
    mode = p.policy_filter if isinstance(p.policy_filter, Column) else F.lit(p.policy_filter)
    hides = F.when(mode == "exclude", F.coalesce(F.col("policy") < p.policy_threshold, F.lit(True))).when(mode == "only", F.coalesce(F.col("policy") >= p.policy_threshold, F.lit(False)))
    keep = (F.col("stage") == "scored") & F.coalesce(hides, F.lit(True)) & _if(p.require_subject, F.coalesce(F.col("subject") >= p.subject_at, F.lit(False)), F.lit(True))
    return evaluated.where(keep & ~F.col("excluded"))


def simple_score(detail_score: Column, classifier: Column, weight: float = 0.7, zero_shot: float = 0.3) -> Column:
    """The single-embedding score; without a classifier the zero-shot score alone."""
    total = weight + zero_shot
    return F.when(classifier.isNull() | F.lit(total <= 0), detail_score).otherwise((weight * classifier + zero_shot * detail_score) / (total or 1.0))


def candidates(scored: DataFrame, p: Policy) -> DataFrame:
    """Items that earn the region pass; those that look excluded are among them, so that the read gets better."""
    if p.deep_scan == "always":
        return scored
    if p.deep_scan == "off":
        return scored.where(F.lit(False))
    half = F.lit(0.5)
    near = evidence(F.coalesce(F.col("subject"), half)) >= max(0.0, p.subject_gate - 0.15)
    return scored.where(near | (evidence(F.coalesce(F.col("exclude"), half)) >= p.exclude_at * 0.7) | F.coalesce(F.col("anchors") > 0, F.lit(False)))
