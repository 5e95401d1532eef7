"""Fits against plain numpy."""

import numpy as np

from pyspark.sql import functions as F

from lumigate.operators import labels, learning, review


def newton(z, y, c):
    """Class-weighted L2 logistic regression with a free intercept: coefficients and intercept."""
    n, counts = len(y), np.bincount(y)
    w = n / (len(counts) * counts[y])
    x = np.hstack([z, np.ones((n, 1))])
    penalty = np.diag([1 / c] * z.shape[1] + [0.0])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (p - y)) + penalty @ beta)
        beta -= step
    return beta[:-1], beta[-1]


def rows(n=80, d=3, seed=5):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d)) * [1, 5, 0.2] + [0, 3, -1]
    y = (x[:, 0] + 0.2 * x[:, 1] + rnd.normal(size=n) > 1).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(k), [float(v) for v in r]) for i, (r, k) in enumerate(zip(x, y, strict=True))], "item_id long, y int, features array<double>")


def test_a_logistic_fit_is_the_minimum_that_newton_finds(spark):
    x, y = rows()
    train = frame(spark, x, y)
    z = learning.standardised(train, learning.scaling(train))
    for c in (0.25, 4.0):
        model = learning.logistic(z, c)
        want, bias = newton((x - x.mean(0)) / x.std(0), y, c)
        assert np.allclose(model.coefficients, want, atol=2e-3) and abs(model.intercept - bias) < 2e-3


def test_platt_is_a_nearly_free_fit_of_the_margin(spark):
    x, y = rows(seed=8)
    margin = 3 * x[:, 0] - 1
    held = spark.createDataFrame([(float(m), int(k)) for m, k in zip(margin, y, strict=True)], "margin double, y int")
    (want,), bias = newton(margin[:, None], y, 1e6)
    slope, at = learning.platt(held)
    assert abs(slope - want) < 2e-3 and abs(at - bias) < 2e-3


def test_scores_out_of_fold_come_from_models_without_the_row(spark):
    x, y = rows(60)
    train = frame(spark, x, y)
    dealt = {r.item_id: r.fold for r in learning.folds(train, 3, "cv").collect()}
    got = {r.item_id: r.p for r in learning.out_of_fold(train, 1.0, 3).collect()}
    assert sorted(got) == list(range(60))
    for f in range(3):
        rest, here = [i for i in got if dealt[i] != f], [i for i in got if dealt[i] == f]
        mean, deviation = x[rest].mean(0), x[rest].std(0)
        beta, bias = newton((x[rest] - mean) / deviation, y[rest], 1.0)
        want = 1 / (1 + np.exp(-((x[here] - mean) / deviation @ beta + bias)))
        assert np.allclose([got[i] for i in here], want, atol=2e-3)


def auc(p, y):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        rank[p == v] = rank[p == v].mean()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def scaled(fit, x):
    s = fit.std(0)
    return (x - fit.mean(0)) / np.where(s < 1e-8, 1, s)


def pooled_auc(spark, x, y, c, k):
    """Out-of-fold predictions by Newton's method, on the folds that the library deals."""
    fold = np.array([r.fold for r in labels.folds(frame(spark, x, y), k, "cv").orderBy("item_id").collect()])
    p = np.zeros(len(y))
    for f in range(k):
        rest, here = fold != f, fold == f
        w, b = newton(scaled(x[rest], x[rest]), y[rest], c)
        p[here] = 1 / (1 + np.exp(-(scaled(x[rest], x[here]) @ w + b)))
    return auc(p, y)


def test_select_c_and_fit_outcome(spark, monkeypatch):
    monkeypatch.setattr(learning, "GRID", (0.002, 4.0))  # fewer fits
    x, y = rows(40, 3, 9)
    found = [pooled_auc(spark, x, y, c, 5) for c in learning.GRID]
    out = learning.fit_outcome(frame(spark, x, y)).first()  # goes through select_c
    assert (out.labels, out.accepted, out.rejected, out.classifier) == (40, (y == 1).sum(), (y == 0).sum(), True)
    assert min(out.accepted, out.rejected) >= 5 and abs(out.auc - max(found)) < 0.01 and abs(found[learning.GRID.index(out.c)] - max(found)) < 0.01
    assert abs(out.weight - min(1, max(0, (out.auc - 0.5) * 2)) * 0.85) < 1e-9


def test_fit_outcome_of_few_labels(spark):
    x, y = rows(8, 3, 9)
    y[:] = [0, 1, 0, 1, 0, 1, 0, 1]
    out = learning.fit_outcome(frame(spark, x, y)).first()  # a classifier, but too few labels to choose C
    assert out.classifier and out.c == 1.0 and out.auc is None and abs(out.weight - 0.5 * 8 / 40 * 0.85) < 1e-9
    out = learning.fit_outcome(frame(spark, x[:2], y[:2])).first()  # a prototype only
    assert not out.classifier and abs(out.weight - 0.35 * 2 / 40 * 0.85) < 1e-9
    out = learning.fit_outcome(frame(spark, x[::2], y[::2])).first()  # one class
    assert not out.classifier and out.weight == 0


def test_quality_estimate(spark):
    x, y = rows(60, 3, 11)
    train = frame(spark, x, y)
    assert learning.quality_estimate(train, 0.7).first().auc == 0.7
    cut = np.array([r.test for r in labels.split(train, 0.25, "quality").orderBy("item_id").collect()])
    w, b = newton(scaled(x[~cut], x[~cut]), y[~cut], 1.0)
    want = auc(scaled(x[~cut], x[cut]) @ w + b, y[cut])
    assert abs(learning.quality_estimate(train, None).first().auc - want) < 0.02


def test_diverse_picks_are_those_of_a_plain_loop(spark):
    rnd = np.random.default_rng(3)
    items = [(i, f"g{i % 3}", round(float(rnd.random()), 2), rnd.normal(size=4).tolist()) for i in range(45)]
    items += [(100, "one", 0.5, [1.0, 0.0, 0.0, 0.0])]
    out = review.diverse(spark.createDataFrame(items, "item_id long, bucket string, score double, embedding array<double>"), "bucket", [F.desc("score")], 0.35, 5)
    got = {(r.bucket, r.place): r.item_id for r in out.collect()}
    want = {}
    for g in {i[1] for i in items}:
        rest = sorted((i for i in items if i[1] == g), key=lambda i: (-i[2], i[0]))
        taken = [rest.pop(0)]
        while rest and len(taken) < 5:
            far = lambda i: min(1 - np.dot(i[3], t[3]) / np.linalg.norm(i[3]) / np.linalg.norm(t[3]) for t in taken)
            best = max(rest, key=lambda i: (round(far(i), 12), -abs(i[2] - 0.35), i[2], -i[0]))
            rest.remove(best)
            taken.append(best)
        want |= {(g, k + 1): t[0] for k, t in enumerate(taken)}
    assert got == want


def test_ranges_of_a_heavy_tailed_score_are_even_and_values_stay(spark):
    rnd = np.random.default_rng(8)
    score, y = np.exp(6 * rnd.normal(size=20_000)), rnd.integers(0, 2, 20_000)
    frame_ = spark.createDataFrame([(float(s), int(k)) for s, k in zip(score, y)], "score double, y int").repartition(8)
    sizes = [r["count"] for r in learning.in_ranges(frame_, "score", 64).groupBy("_b").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 20_000 / 64
    assert abs(learning.roc_auc(frame_).first().auc - auc(score, y)) < 1e-12
    order = np.argsort(-score)
    hits = y[order] == 1
    ap = (np.cumsum(hits) / np.arange(1, len(hits) + 1))[hits].mean()
    assert abs(learning.average_precision(frame_).first().ap - ap) < 1e-9
    assert learning.roc_auc(frame_.limit(0)).first().auc is None


def test_fits_of_all_folds_and_strengths_share_their_passes(spark):
    """A choice of C once was folds times grid fits of tens of jobs each."""
    x, y = rows(60, 3, 13)
    train = frame(spark, x, y).repartition(3).cache()
    train.count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("choice", "")
    try:
        got = learning.out_of_folds(train, (0.05, 16.0), 3).collect()
        jobs = len(tracker.getJobIdsForGroup("choice"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    dealt = {r.item_id: r.fold for r in learning.folds(train, 3, "cv").collect()}
    assert len(got) == 120 and jobs < 80
    for c in (0.05, 16.0):
        p = {r.item_id: r.p for r in got if r.c == c}
        for f in range(3):
            rest, here = [i for i in p if dealt[i] != f], [i for i in p if dealt[i] == f]
            w, b = newton(scaled(x[rest], x[rest]), y[rest], c)
            assert np.allclose([p[i] for i in here], 1 / (1 + np.exp(-(scaled(x[rest], x[here]) @ w + b))), atol=1e-6)


def test_a_fold_without_a_model_gives_null(spark):
    x, y = np.arange(18.0).reshape(9, 2), np.array([1] + [0] * 8)
    train = frame(spark, x, y)
    dealt = {r.item_id: r.fold for r in learning.folds(train, 3, "cv").collect()}
    got = {r.item_id: r.p for r in learning.out_of_fold(train, 1.0, 3).collect()}
    assert {i for i, p in got.items() if p is None} == {i for i in got if dealt[i] == dealt[0]}
