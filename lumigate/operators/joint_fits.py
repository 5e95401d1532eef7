"""Logistic fits of several folds and strengths at once: a step of Newton's method for all of them is one pass over the rows.

A fit alone is tens of jobs, and a choice of C is folds times grid such fits. Here a task sums what its rows give to each fit, a group adds up the tasks'
sums, and the driver gets one row a fit, of (features + 1) squared numbers whatever the rows. Losses are convex, so it is the minimum that `learning.logistic` looks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes at most, and what a further step may still gain of the loss (relative) where a fit ends.
PASSES, ENOUGH = 100, 1e-12


@dataclass(frozen=True)
class Fit:
    """A model of the rows outside a fold: their mean and deviation, the weight of each class, and coefficients with the intercept last."""

    fold: int
    c: float
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    beta: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.deviation, np.ones((len(x), 1))])


def rest_of(moments: list, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each place over the other folds, from theirs (fold, i, n, mean, var); a deviation near 0 counts as 1."""
    by = {}
    for r in moments:
        if r["fold"] != fold:
            by.setdefault(r["i"], []).append((r["n"], r["mean"], r["var"]))
    n, mean, var = np.moveaxis(np.array([by[i] for i in sorted(by)], np.float64), 2, 0)
    middle = (n * mean).sum(1) / n.sum(1)
    deviation = np.sqrt((n * (var + (mean - middle[:, None]) ** 2)).sum(1) / n.sum(1))
    return middle, np.where(deviation < 1e-8, 1.0, deviation)


def begun(dealt: DataFrame, cs: tuple[float, ...]) -> list[Fit]:
    """A fit for each fold that has rows and leaves both classes to the others, and each of cs."""
    counts = {(r["fold"], r["y"]): r["count"] for r in dealt.groupBy("fold", "y").count().collect()}  # two rows a fold
    at = dealt.select("fold", F.posexplode("features").alias("i", "x")).groupBy("fold", "i")
    moments = at.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).collect()  # a row for each fold and place
    fits = []
    for fold in sorted({f for f, _ in counts}):
        n = np.array([sum(k for (f, y), k in counts.items() if f != fold and y == c) for c in (0, 1)])
        if n.all():
            mean, deviation = rest_of(moments, fold)
            fits += [Fit(fold, c, mean, deviation, n.sum() / (2 * n), np.zeros(len(mean) + 1)) for c in cs]
    return fits


def sums(dealt: DataFrame, fits: list[Fit]) -> list[np.ndarray]:
    """Of each fit: the loss of its rows, its gradient and its second derivatives, in a row."""
    width = len(fits[0].beta)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((len(fits), 1 + width + width * width))
        for f in frames:
            if not len(f):
                continue
            x, y, fold = np.stack(f["features"]).astype(np.float64), f["y"].to_numpy(), f["fold"].to_numpy()
            last, z = None, None
            for k, fit in enumerate(fits):
                if fit.fold != last:
                    last, rest = fit.fold, fold != fit.fold
                    z, ours = fit.inputs(x[rest]), y[rest]
                margin, w = z @ fit.beta, fit.weights[ours]
                p = 0.5 * (1 + np.tanh(margin / 2))
                found[k, 0] += w @ np.logaddexp(0, np.where(ours == 1, -margin, margin))
                found[k, 1 : 1 + width] += (w * (p - ours)) @ z
                found[k, 1 + width :] += ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()
        yield pd.DataFrame({"fit": np.arange(len(fits)), "sums": list(found)})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fit": rows["fit"].iloc[:1].to_numpy(), "sums": [np.sum(rows["sums"].to_numpy(), axis=0)]})

    schema = "fit int, sums array<double>"
    rows = dealt.select("fold", "y", "features").mapInPandas(run, schema).groupBy("fit").applyInPandas(added, schema).collect()
    return [np.array(r["sums"]) for r in sorted(rows, key=lambda r: r["fit"])]


def minimised(dealt: DataFrame, fits: list[Fit]) -> list[Fit]:
    """fits at the minimum of their class-weighted, L2-regularised loss; a step that doesn't lower it is halved."""
    done: dict[int, Fit] = {}
    open_ = {k: (fit, None, None, np.inf) for k, fit in enumerate(fits)}  # tried, last accepted, its step, its loss
    for _ in range(PASSES):
        if not open_:
            break
        names = list(open_)
        for k, found in zip(names, sums(dealt, [open_[k][0] for k in names])):
            tried, before, step, least = open_[k]
            width = len(tried.beta)
            penalty = np.append(np.full(width - 1, 1 / tried.c), 0.0)
            loss = found[0] + 0.5 * penalty @ tried.beta**2
            if np.isfinite(loss) and loss > least:
                step = step / 2
                if np.abs(step).max() < 1e-12 * (1 + np.abs(before.beta).max()):
                    done[k] = before
                    del open_[k]
                else:
                    open_[k] = (replace(before, beta=before.beta + step), before, step, least)
                continue
            slope = found[1 : 1 + width] + penalty * tried.beta
            curve = found[1 + width :].reshape(width, width) + np.diag(penalty)
            step = -np.linalg.lstsq(curve, slope, rcond=None)[0] if np.isfinite(loss) else np.full(width, np.nan)
            if not -(slope @ step) > ENOUGH * (1 + loss):  # also where features aren't numbers: such a fit gives none
                done[k] = replace(tried, beta=tried.beta + step)
                del open_[k]
            else:
                open_[k] = (replace(tried, beta=tried.beta + step), tried, step, loss)
    return [done[k] if k in done else open_[k][0] for k in range(len(fits))]


def predicted(dealt: DataFrame, fits: list[Fit], cs: tuple[float, ...]) -> DataFrame:
    """item_id, y, c and p of every row for each of cs, by the fit that did not see it; null where there is none."""
    by = {(fit.fold, fit.c): fit for fit in fits}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for fold, rows in f.groupby("fold"):
                x = np.stack(rows["features"]).astype(np.float64)
                for c in cs:
                    fit = by.get((fold, c))
                    p = None if fit is None else 0.5 * (1 + np.tanh(fit.inputs(x) @ fit.beta / 2))
                    yield rows[["item_id", "y"]].assign(c=c, p=pd.Series(p, rows.index, "float64") if p is not None else None)

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    return dealt.select("item_id", "y", "fold", "features").mapInPandas(run, f"item_id {kinds['item_id']}, y {kinds['y']}, c double, p double")
