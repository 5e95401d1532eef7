"""The protective gate and its invariants, region evidence and detail, with exact numbers."""

import pytest
from pyspark.sql import functions as F

from lumigate.operators import cascade, export, regions
from lumigate.operators.axes import Registry, role_scores
from lumigate.plans.fixtures import ROLES, WEIGHTS
from lumigate.policy import Policy, check_roles

REG = Registry.declared(ROLES, WEIGHTS)


def case(spark, rows):
    """rows: item_id, exclude, clear, detail (axis 4) as raw scores, anchors."""
    frame = spark.createDataFrame(rows, "item_id long, x double, c double, d double, anchors int")
    axes = F.create_map(F.lit("0"), F.lit(0.9), F.lit("1"), F.lit(0.9), F.lit("2"), F.col("x"), F.lit("3"), F.col("c"), F.lit("4"), F.col("d"), F.lit("5"), F.col("d"), F.lit("6"), F.lit(0.5), F.lit("7"), F.lit(0.5), F.lit("8"), F.lit(0.5), F.lit("9"), F.lit(0.6))
    return role_scores(frame.withColumn("axes", axes), REG, ROLES)


CASES = [
    (1, 0.5, 0.9, 0.95, None, "scored"),
    (2, 0.9, 0.9, 0.95, 1, "excluded"),  # strongly
    (3, 0.7, 0.6, 0.6, 0, "excluded"),  # looks it, and more than cleared
    (4, 0.5, 0.55, 0.95, None, "excluded"),  # anchors not known, no clearance
    (5, 0.5, 0.55, 0.95, 0, "excluded"),
    (6, None, 0.9, 0.2, 0, "excluded"),  # not known
    (7, 0.5, None, 0.2, 0, "excluded"),
    (8, 0.57, 0.5, 0.5, 1, "excluded"),  # anchored: a small margin is enough
    (9, 0.57, 0.5, 0.5, 0, "scored"),
]


def test_stages(spark):
    got = {r.item_id: r.stage for r in cascade.evaluate(case(spark, [c[:5] for c in CASES]), Policy(), REG).collect()}
    assert got == {c[0]: c[5] for c in CASES}


def test_nothing_excluded_is_ever_seen(spark):
    bad = {c[0] for c in CASES if c[5] == "excluded"}
    ev = cascade.evaluate(case(spark, [c[:5] for c in CASES]), Policy(), REG).withColumn("score", F.col("base"))
    for mode in ("include", "exclude", "only"):
        shown = cascade.visible(ev, Policy(policy_filter=mode))
        back = export.result_hook(shown, lambda rows: rows.select("item_id").unionByName(ev.select("item_id")))
        for out in (shown, back, export.decisions(shown, 0.35)):
            assert not bad & {r.item_id for r in out.collect()}


def test_the_gate_only_tightens():
    p = Policy(exclude_at=0.9, min_clear=0.0, margin=1.0, strongly_at=1.0, anchored_margin=1.0, weak_clear_detail=float("nan"))
    assert (p.exclude_at, p.min_clear, p.margin, p.strongly_at, p.anchored_margin, p.weak_clear_detail) == (0.3, 0.25, 0.1, 0.75, 0.05, 0.35)
    assert Policy(exclude_at=0.1, min_clear=0.9).exclude_at == 0.1
    with pytest.raises(ValueError):
        check_roles({"a": "detail", "b": "exclude"})
    with pytest.raises(ValueError):
        check_roles({"a": "clear"})


def test_region_evidence(spark):
    rows = [(1, "full", "full", "4", 0.5), (1, "bandtop", "band_upper", "4", 0.9), (2, "full", "full", "4", 0.6), (2, "torso0", "torso", "4", 0.8), (3, "full", "full", "4", 0.9), (3, "torso0", "torso", "4", 0.2), (4, "torso0", "torso", "4", 0.8), (5, "full", "full", "2", 0.5), (5, "torso0", "torso", "2", 0.9)]
    scores = spark.createDataFrame(rows, "item_id long, region_key string, kind string, axis string, score double")
    ok = spark.createDataFrame([("4", "full"), ("4", "torso"), ("4", "band_upper"), ("2", "full")], "axis string, kind string")
    got = {r.item_id: r.score for r in regions.aggregate_regions(scores, ok).collect()}
    assert got == {1: pytest.approx(0.7), 2: pytest.approx(0.8), 3: pytest.approx(0.9), 4: None, 5: pytest.approx(0.5)}


def sourced(spark, asked, p=Policy(scale=8.0)):
    """Items of two directions for the clear and the exclude axis, one set in each of the sources; and the visible ids by source."""
    import numpy as np

    from lumigate import policy as pol

    unit = np.eye(4)
    reg = Registry.declared({"a": "exclude", "b": "clear", "c": "detail", "d": "detail"}, {"c": 1.0, "d": 0.7}, tuple((unit[i : i + 1], None) for i in range(4)))
    vectors = {1: [0.0, 0.9, 0.9, 0.0], 2: [0.9, 0.0, 0.9, 0.0], 3: [0.2, 0.05, 0.9, 0.9], 4: [0.0, 0.9, 0.1, 0.9], 5: None, 6: [0.1, 0.2]}
    rows = [(10 * n + i, s, 0, v) for n, s in enumerate(("plain", "own")) for i, v in vectors.items()]
    items = spark.createDataFrame(rows, "item_id long, source string, anchors int, embedding array<double>")
    own = pol.by_source(spark.createDataFrame([("own", k, v) for k, v in asked.items()], "source string, key string, value string"), pol.settings_table(spark))
    out = cascade.evaluate_by_source(items, reg, own, p)
    shown = cascade.visible(out, pol.BySource(p)).collect()
    return {s: {r.item_id % 10: r for r in shown if r.source == s} for s in ("plain", "own")}


def test_a_source_s_settings_rank_its_items_only(spark):
    got = sourced(spark, {"scale": "4", "threshold": "0.2"})
    assert set(got["plain"]) == set(got["own"]) == {1, 4}
    assert got["own"][1].base < got["plain"][1].base
    got = sourced(spark, {"detail_weights": '{"d": 0.5, "c": -1, "x": "y"}'})  # replaces: c is dropped
    assert got["own"][1].detail == 0 and got["plain"][1].detail > 0 and got["own"][4].detail < got["plain"][4].detail


@pytest.mark.parametrize("asked", [
    {"scale": "0.01"}, {"detail_weights": '{"c": 0, "d": 0}'}, {"detail_weights": '{"d": 0.0001}'}, {"scale": "0.01", "detail_weights": '{"d": 0.0001}'},
    {"exclude_at": "0.9", "min_clear": "0", "margin": "1", "strongly_at": "1", "weak_clear_detail": "1", "anchored_margin": "1"}, {"pipeline": "simple"}, {"scale": "NaN", "detail_weights": "no json"},
])
def test_no_setting_of_a_source_brings_an_excluded_item_back(spark, asked):
    """Neither keys that it may not set, nor a flat scale or dropped weights, which it may; items without a vector that can be compared stay out."""
    assert not set(sourced(spark, asked)["own"]) & {2, 3, 5, 6}


def test_roles_that_are_not_the_registry_s_are_an_error(spark):
    wrong = ROLES | {"2": "detail", "4": "exclude"}
    with pytest.raises(ValueError):
        role_scores(spark.range(1).withColumn("axes", F.create_map(F.lit("2"), F.lit(0.9))), REG, wrong)
    frame = "axis string, role string, polarity string, prompt_id long, weight double, aggregation string, vector array<double>"
    with pytest.raises(ValueError):
        Registry.of(spark.createDataFrame([("a", "exclude", "p", 1, 1.0, "max", [1.0]), ("a", "clear", "n", 2, 1.0, "max", [1.0])], frame))
    with pytest.raises(ValueError):
        Registry.of(spark.createDataFrame([("a", "exclude", "p", 1, 1.0, "max", [1.0])], frame))


def test_one_setting_has_one_default():
    from lumigate.policy import SETTINGS

    p = Policy()
    for key, (kind, default, _, _) in SETTINGS.items():
        if hasattr(p, key) and kind in ("float", "int"):
            assert float(default) == float(getattr(p, key)), key
