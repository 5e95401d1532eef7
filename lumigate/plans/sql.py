"""The parts that the queries' SQL shares."""

from __future__ import annotations

from lumigate.plans.fixtures import ELIGIBLE, GEOMETRY

EV = "greatest(0.0, least(1.0, ({0} - 0.5) * 2))"


def ev(x: str) -> str:
    return EV.format(x)


def ramp(x: str, low: float, high: float) -> str:
    return f"greatest(0.0, least(1.0, ({x} - {low}) / ({high} - {low})))"


def band(x: str) -> str:
    return f"CASE WHEN {x} >= 0.7 THEN 'high' WHEN {x} >= 0.35 THEN 'medium' ELSE 'low' END"


PROMPTS = """ranked AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings WHERE label IS NOT NULL),
prompt AS (SELECT label AS axis, 'p' AS pol, vec_id AS pid, 1 + (rn - 1) * 0.5 AS w, v FROM ranked WHERE rn <= 4 UNION ALL SELECT (label + 9) % 10, 'n', vec_id, 1 + (rn - 1) * 0.5, v FROM ranked WHERE rn <= 4)"""


def axis_scores(source: str, key: str, name: str = "axis_score") -> str:
    """CTEs over `prompt`: axis_score(key, axis, score), or another name, of rows of source with column e."""
    return f"""side_{source} AS (SELECT {key}, axis, pol, CASE WHEN axis % 2 = 0 THEN sum(w * d) / sum(w) ELSE max(d) END AS s FROM (SELECT {key}, axis, pol, w, list_dot_product(e, v) AS d FROM {source}, prompt) GROUP BY {key}, axis, pol),
{name} AS (SELECT {key}, axis, 1 / (1 + exp(-8.0 * (max(s) FILTER (pol = 'p') - coalesce(max(s) FILTER (pol = 'n'), 0)))) AS score FROM side_{source} GROUP BY {key}, axis)"""


def detail(get) -> str:
    parts = ", ".join(f"{ev(get(a))} * {w}" for a, w in (("4", 1.0), ("5", 0.85), ("6", 0.85), ("7", 0.7), ("8", 0.7)))
    return f"[{parts}]"


def combined(parts: str) -> str:
    raw = f"(0.65 * list_max({parts}) + 0.35 * list_sum({parts}) / 5)"
    return f"CASE WHEN len(list_filter({parts}, lambda x: x >= 0.15)) < 2 AND list_max({parts}) < 0.55 THEN {raw} * 0.5 ELSE {raw} END"


WIDE = ", ".join(f"max(score) FILTER (axis = {k}) AS a{k}" for k in range(10))
EXCLUDED = """(e_exclude IS NULL OR e_clear IS NULL OR (e_exclude >= 0.3 AND e_exclude > e_clear + 0.1) OR e_exclude >= 0.75
  OR (coalesce(anchors, 0) > 0 AND e_exclude > e_clear + 0.05 AND e_exclude >= 0.3 * 0.4) OR (detail >= 0.35 AND e_clear < 0.25))"""
GATED = f"""SELECT *, CASE WHEN excluded THEN 'excluded' WHEN e_soft < 0 THEN 'soft_fail' ELSE 'scored' END AS stage, gate_soft * gate_clear AS gate_factor, CASE WHEN excluded THEN 0.0 ELSE detail * gate_soft * gate_clear END AS score FROM (
  SELECT *, {EXCLUDED} AS excluded, greatest({ramp("e_soft", 0.0, 0.35)}, 0.25) AS gate_soft, 1 - {ramp("e_exclude", 0.3 * 0.6, 0.3)} AS gate_clear FROM (
    SELECT *, {combined("parts")} AS detail FROM (
      SELECT *, {ev("a0")} AS e_subject, {ev("a1")} AS e_soft, {ev("a2")} AS e_exclude, {ev("a3")} AS e_clear, {detail(lambda a: "a" + a)} AS parts FROM wide)))"""
#: WITH ... ev (every item, internal), shown (what may be seen, with labels and names).
ITEMS = f"""WITH RECURSIVE item AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS e, nullif(label % 3 - 1, -1) AS anchors, label AS k FROM embeddings),
{PROMPTS},
{axis_scores("item", "item_id")},
wide AS (SELECT i.item_id, i.e, i.anchors, w.* EXCLUDE (item_id) FROM item i JOIN (SELECT item_id, {WIDE} FROM axis_score GROUP BY item_id) w USING (item_id)),
ev AS ({GATED}),
lab AS (SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS label FROM labels),
shown AS (SELECT ev.*, lab.label, CASE lab.label WHEN 1 THEN 'good' WHEN 0 THEN 'bad' WHEN 2 THEN 'skip' ELSE 'unlabeled' END AS label_name, 'Item<' || item_id || '>.vec' AS name, 1700000000 + (item_id * 37) % 1000 AS mt FROM ev LEFT JOIN lab USING (item_id) WHERE stage = 'scored' AND NOT excluded)
"""
_eligible = ", ".join(f"({a}, '{k}')" for a, kinds in ELIGIBLE.items() for k in ["full", *filter(None, kinds.split(","))])
#: Regions of items that may be seen only: the gate decides by the item.
REGIONS = f"""{ITEMS}, region AS (SELECT vec_id, vec_id // 5 AS item_id, vec_id % 5 AS place, ['full', 'bandtop', 'bandmid', 'bandlow', 'torso0'][vec_id % 5 + 1] AS region_key, ['full', 'band_upper', 'band_mid', 'band_lower', 'torso'][vec_id % 5 + 1] AS kind, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id // 5 IN (SELECT item_id FROM shown)),
{axis_scores("region", "vec_id", "region_score")},
rs AS (SELECT r.item_id, r.region_key, r.kind, r.place, s.axis, s.score FROM region r JOIN region_score s USING (vec_id)),
eligible(axis, kind) AS (VALUES {_eligible}),
agg AS (SELECT item_id, axis, CASE WHEN f IS NOT NULL THEN greatest(f, coalesce(an, f), f + 0.5 * greatest(coalesce(ba - f, 0), 0)) END AS score FROM (
  SELECT item_id, rs.axis, max(score) FILTER (kind = 'full') AS f, max(score) FILTER (el.axis IS NOT NULL AND kind NOT LIKE 'band%') AS an, max(score) FILTER (el.axis IS NOT NULL AND kind LIKE 'band%') AS ba
  FROM rs LEFT JOIN eligible el USING (axis, kind) GROUP BY item_id, rs.axis)),
rw AS (SELECT item_id, region_key, kind, any_value(place) AS place, {", ".join(f"max(CASE WHEN el.axis IS NOT NULL THEN score ELSE 0.5 END) FILTER (rs.axis = {k}) AS a{k}" for k in range(4, 9))} FROM rs LEFT JOIN eligible el USING (axis, kind) GROUP BY item_id, region_key, kind),
rd AS (SELECT item_id, region_key, kind, place, {combined("parts")} AS detail FROM (SELECT *, {detail(lambda a: "a" + a)} AS parts FROM rw))
"""
GEO = ", ".join(str(g) for g in GEOMETRY)


def clamp(l: str, t: str, r: str, b: str) -> str:
    return f"{{'l': greatest(0, round_even({l}, 0))::INTEGER, 't': greatest(0, round_even({t}, 0))::INTEGER, 'r': least(width, round_even({r}, 0))::INTEGER, 'b': least(height, round_even({b}, 0))::INTEGER}}"


FRAMES = f"""WITH frame AS (SELECT p_partkey AS item_id, (200 + 17 * p_size)::INTEGER AS width, (150 + 23 * (p_partkey % 40))::INTEGER AS height FROM part),
anch AS (SELECT item_id, width, height, floor(width / 3)::INTEGER AS x, floor(height / 8)::INTEGER AS y FROM frame WHERE item_id % 3 = 0),
geo(kind, dx0, dy0, dx1, dy1) AS (VALUES {GEO}),
ar AS (SELECT item_id, kind || '0' AS region_key, kind, {clamp("x + dx0 * 40", "y + dy0 * 50", "x + dx1 * 40", "y + dy1 * 50")} AS box FROM anch, geo),
fb AS (SELECT item_id, key AS region_key, kind, {clamp("0.0", "height * lo", "width::DOUBLE", "height * hi")} AS box FROM frame, (VALUES ('bandtop', 'band_upper', 0.0, 0.55), ('bandmid', 'band_mid', 0.25, 0.8), ('bandlow', 'band_lower', 0.45, 1.0)) b(key, kind, lo, hi) WHERE item_id % 3 <> 0
  UNION ALL SELECT item_id, 'centre', 'band', {clamp("(width - s) / 2", "(height - s) / 2", "(width - s) / 2 + s", "(height - s) / 2 + s")} FROM (SELECT *, least(width, height) AS s FROM frame) WHERE item_id % 3 <> 0 AND width <> height)
"""
BOX = "box.l AS l, box.t AS t, box.r AS r, box.b AS b"
BIG = "box.r - box.l >= 48 AND box.b - box.t >= 48"
INVENTORY = """WITH inv AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, sha1(text) AS content_hash, 1600000000 + doc_id AS mtime, n_chars AS size FROM documents),
kept AS (SELECT doc_id, path, content_hash, mtime, size + (doc_id % 13 = 0)::INTEGER AS size FROM inv WHERE doc_id % 11 <> 0),
before_ AS (SELECT * FROM kept UNION ALL SELECT doc_id, 'gone/' || path, content_hash, mtime, size FROM kept WHERE doc_id <= 5)
"""
EVENTS = """WITH le AS (SELECT user_id AS item_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 WHEN 'view' THEN 2 END AS label, event_id AS seq FROM events WHERE event_type <> 'click'),
fold AS (SELECT item_id, label FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS rn FROM le) WHERE rn = 1 AND label IS NOT NULL)
"""
#: Labelled rows that may be seen only: no fit reads another.
TRAIN = f"""{ITEMS}, train AS (SELECT shown.item_id, shown.e AS x, l.quality AS y FROM shown JOIN labels l ON shown.item_id = l.doc_id WHERE l.quality IN (0, 1)),
pairs AS (SELECT d.doc_id AS id, d.n_chars::DOUBLE AS score, l.toxic AS y FROM documents d JOIN labels l USING (doc_id))
"""
