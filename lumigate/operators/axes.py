"""Scoring items against a registry of weighted positive and negative prompts for each axis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigate.functions.vector import as_double, dot, sigmoid
from lumigate.policy import ROLES, check_role_counts, check_roles

#: 20,000 vectors of 1024 numbers are 160 MB in each Python worker.
MOST_PROMPTS = 20_000


def registry(prompts: DataFrame) -> DataFrame:
    """One row: every axis with its role, how it aggregates, its prompts, and each side's weights folded into one vector.

    prompts: axis, role, polarity ('p' or 'n'), prompt_id, weight, aggregation, vector. A weighted mean of dot products
    is the dot product with the weighted mean, so such an axis costs two products whatever its number of prompts.
    """
    axes = prompts.groupBy("axis").agg(F.min("role").alias("role"), F.max("role").alias("other"))
    role = F.when(F.col("role").eqNullSafe(F.col("other")) & F.col("role").isin(*ROLES), F.col("role"))
    check_role_counts({r["role"]: r["count"] for r in axes.groupBy(role.alias("role")).count().collect()})  # a row for each role that there is
    at = prompts.select("axis", "polarity", "weight", F.posexplode(as_double(F.col("vector"))).alias("i", "x"))
    folded = at.groupBy("axis", "polarity", "i").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"))
    folded = folded.groupBy("axis", "polarity").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("fold"))
    each = prompts.groupBy("axis", "polarity").agg(F.first("role").alias("role"), F.first("aggregation").alias("aggregation"), F.collect_list(as_double(F.col("vector"))).alias("prompts"))
    sides = each.join(folded, ["axis", "polarity"])
    pos = sides.where("polarity = 'p'").select("axis", "role", "aggregation", F.struct("fold", "prompts").alias("pos"))
    neg = sides.where("polarity = 'n'").select("axis", F.struct("fold", "prompts").alias("neg"))
    axes = pos.join(neg, "axis", "left")
    return axes.agg(F.array_sort(F.collect_list(F.struct("axis", "role", "aggregation", "pos", "neg"))).alias("registry"))


@dataclass(frozen=True)
class Registry:
    """The axes of a policy with their roles and prompts, as the registry's rows declare them. Nothing else names an axis' role or weight.

    A registry holds at most MOST_PROMPTS prompts: it goes to every task, and doesn't grow with the items.
    """

    roles: dict[str, str]
    detail_weights: dict[str, float]
    #: By axis: for each side the weighted mean of its prompts, or all of them where the best one counts.
    sides: tuple[tuple[np.ndarray | None, np.ndarray | None], ...] = ()

    @staticmethod
    def declared(roles: dict[str, str], weights: dict[str, float] | None = None, sides=()) -> Registry:
        check_roles(roles)
        return Registry(dict(sorted(roles.items())), {a: (weights or {}).get(a, 1.0) for a, r in sorted(roles.items()) if r == "detail"}, sides)

    @staticmethod
    def of(prompts: DataFrame) -> Registry:
        """prompts: axis, role, polarity ('p' or 'n'), prompt_id, weight, aggregation, vector, and axis_weight for detail axes (1 where there is none)."""
        extra = ["axis_weight"] if "axis_weight" in prompts.columns else []
        rows = prompts.select("axis", "role", "polarity", "prompt_id", "weight", "aggregation", as_double(F.col("vector")).alias("vector"), *extra).limit(MOST_PROMPTS + 1).collect()
        if len(rows) > MOST_PROMPTS:
            raise ValueError(f"a registry has at most {MOST_PROMPTS} prompts")
        named, weights, sides = {}, {}, {}
        for r in sorted(rows, key=lambda r: (r["axis"], r["polarity"], r["prompt_id"])):
            if named.setdefault(r["axis"], r["role"]) != r["role"]:
                raise ValueError(f"the axis {r['axis']} has two roles")
            if extra and r["axis_weight"] is not None:
                weights[r["axis"]] = float(r["axis_weight"])
            sides.setdefault((r["axis"], r["polarity"]), []).append(r)

        def side(axis: str, polarity: str) -> np.ndarray | None:
            found = sides.get((axis, polarity))
            if not found:
                return None
            vectors = np.array([r["vector"] for r in found], np.float64)
            if sides[axis, "p" if (axis, "p") in sides else polarity][0]["aggregation"] == "max":
                return vectors
            w = np.array([r["weight"] for r in found], np.float64)
            return (w @ vectors / w.sum())[None]

        return Registry.declared(named, weights, tuple((side(a, "p"), side(a, "n")) for a in sorted(named)))

    def axis_of(self, role: str) -> str | None:
        """The one axis of a single role."""
        found = [a for a, r in self.roles.items() if r == role]
        if len(found) > 1:
            raise ValueError(f"{len(found)} axes have the role {role}")
        return found[0] if found else None

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """For each row and axis the similarity to the axis less that to what speaks against it: one matrix product. A side without prompts has 0."""
        parts = [s for both in self.sides for s in both if s is not None]
        near = vectors @ np.concatenate(parts).T if parts else np.zeros((len(vectors), 0))
        out, at = np.zeros((len(vectors), len(self.sides))), 0
        for k, both in enumerate(self.sides):
            for side, sign in zip(both, (1, -1)):
                if side is not None:
                    out[:, k] += sign * near[:, at : at + len(side)].max(1)
                    at += len(side)
        return out


def _margins(items: DataFrame, reg: Registry, vector: str) -> DataFrame:
    """items with _margins, in the order of the registry's axes; null for a vector that is null, has nulls, or isn't of the registry's size."""
    dim = next((s.shape[1] for both in reg.sides for s in both if s is not None), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(vector)
            flat, sizes = pc.list_flatten(lists), pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(sizes, 0))
            good = sizes == dim
            places = (ends[good] - dim)[:, None] + np.arange(dim)
            found = np.full((len(b), len(reg.sides)), np.nan)
            found[good] = reg.margins(numbers[places])
            known = ~np.isnan(found).any(1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(known, len(reg.sides), 0))]), pa.int32())
            rows = pa.ListArray.from_arrays(offsets, pa.array(found[known].ravel()), mask=pa.array(~known)) if len(b) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, rows], [*b.schema.names, "_margins"])

    return items.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("_margins", T.ArrayType(T.DoubleType()))]))


def score_axes(items: DataFrame, reg: Registry, scale: float | Column, vector: str = "embedding") -> DataFrame:
    """items with `axes`, a map of axis to score 0..1. scale may be a column, as settings of a source are.

    An item whose vector can't be compared has no scores, and the gate takes that as not known.
    """
    rows = _margins(items, reg, vector)
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    scores = F.map_from_arrays(F.array(*map(F.lit, reg.roles)), F.transform("_margins", lambda m: sigmoid(scale * m)))
    # as a generated column the scores are computed once a row; as an alias, filters on the gate would copy them into each use
    return rows.select(*items.columns, F.explode(F.array(scores)).alias("axes"))


def role_scores(scored: DataFrame, reg: Registry, roles: dict[str, str] | None = None) -> DataFrame:
    """scored with a column for the score of each single role: subject, soft, exclude, clear, policy.

    The roles are the registry's. Where a caller names roles as well, they must be the same, or the gate would look at another axis.
    """
    if roles is not None and roles != reg.roles:
        wrong = sorted(set(roles.items()) ^ set(reg.roles.items()))
        raise ValueError(f"these roles are not the registry's: {wrong}")
    named = {role: reg.axis_of(role) for role in ("subject", "soft", "exclude", "clear", "policy")}
    return scored.withColumns({role: F.col("axes")[axis] if axis is not None else F.lit(None).cast("double") for role, axis in named.items()})


def prompt_test(items: DataFrame, positive: DataFrame, negative: DataFrame, scale: float, n: int) -> DataFrame:
    """The n items nearest to ad-hoc prompts; without negative prompts their similarity is 0."""
    sides = positive.agg(F.collect_list(as_double(F.col("vector"))).alias("p")).join(negative.agg(F.collect_list(as_double(F.col("vector"))).alias("n")))
    e = as_double(F.col("embedding"))
    mean = lambda side: F.aggregate(F.transform(side, lambda v: dot(e, v)), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(side), F.lit(1))
    return items.join(F.broadcast(sides)).select("item_id", sigmoid(scale * (mean(F.col("p")) - mean(F.col("n")))).alias("similarity")).orderBy(F.desc("similarity"), "item_id").limit(n)
