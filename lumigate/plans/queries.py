"""Every operator as a query over the given tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate import policy as pol
from lumigate.functions import text as tx
from lumigate.functions import vector as vec
from lumigate.operators import axes, cascade, export, labels, learning, refine, regions, review, score_table, similarity, views
from lumigate.operators import inventory as inv
from lumigate.operators.storage import shared_dir
from lumigate.plans import fixtures as fx
from lumigate.plans import sql as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


def r6(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)


# Scores and gates ---------------------------------------------------------------------------------------------

@query(q.ITEMS + "SELECT item_id, round(score, 6) AS score, round(detail, 6) AS detail FROM shown WHERE score >= 0.35 ORDER BY shown.score DESC, item_id LIMIT 20")
def flagship(spark, sf):
    top = views.matches(fx.shown(spark, sf), fx.POLICY.threshold).orderBy(F.desc("score"), "item_id").limit(20)
    return top.select("item_id", r6("score", "score"), r6("detail", "detail"))


def _axis_long(spark, sf, kind):
    return fx.shown(spark, sf).select("item_id", F.explode("axes").alias("axis", "s")).where(F.col("axis").cast("int") % 2 == kind).select("item_id", "axis", r6("s", "score"))


_AXIS = q.ITEMS + "SELECT a.item_id, axis::VARCHAR AS axis, round(a.score, 6) AS score FROM axis_score a WHERE axis % 2 = {0} AND item_id IN (SELECT item_id FROM shown)"


@query(_AXIS.format(0))
def axis_score_mean(spark, sf):
    return _axis_long(spark, sf, 0)


@query(_AXIS.format(1))
def axis_score_max(spark, sf):
    return _axis_long(spark, sf, 1)


@query(q.ITEMS + "SELECT i.item_id, p.axis::VARCHAR AS axis, p.pol AS polarity, count(*) AS n, round(max(list_dot_product(i.e, p.v)), 6) AS most FROM shown i, prompt p GROUP BY ALL")
def join_prompts(spark, sf):
    # the registry is one row, so a join without a key adds no rows
    both = fx.shown(spark, sf).join(F.broadcast(axes.registry(fx.prompts(spark, sf))))
    side = both.select("item_id", vec.as_double(F.col("embedding")).alias("e"), F.explode("registry").alias("r"))
    rows = F.array(*[F.struct(F.lit(p).alias("polarity"), F.col(f"r.{s}.prompts").alias("v")) for p, s in (("p", "pos"), ("n", "neg"))])
    return side.select("item_id", F.col("r.axis").alias("axis"), "e", F.inline(rows)).where("v is not null").select("item_id", "axis", "polarity", F.size("v").cast("long").alias("n"), r6(F.array_max(F.transform("v", lambda v: vec.dot(F.col("e"), v))), "most"))


@query(q.ITEMS + "SELECT item_id, round(1 / (1 + exp(-8 * (p - n))), 6) AS similarity FROM (SELECT item_id, avg(list_dot_product(e, v)) FILTER (axis = 1 AND pol = 'p') AS p, avg(list_dot_product(e, v)) FILTER (axis = 1 AND pol = 'n') AS n FROM shown, prompt GROUP BY item_id) ORDER BY (p - n) DESC, item_id LIMIT 10")
def prompt_test(spark, sf):
    p = fx.prompts(spark, sf).where("axis = '1'")
    out = axes.prompt_test(fx.shown(spark, sf), p.where("polarity = 'p'"), p.where("polarity = 'n'"), fx.POLICY.scale, 10)
    return out.select("item_id", r6("similarity", "similarity"))


@query(q.ITEMS + "SELECT item_id, excluded FROM ev WHERE NOT excluded")
def exclusion_gate(spark, sf):
    return fx.evaluated(spark, sf).where(~F.col("excluded")).select("item_id", "excluded")


@query(q.ITEMS + "SELECT item_id, 1.0::DOUBLE AS gate_subject, round(gate_soft, 6) AS gate_soft, round(gate_clear, 6) AS gate_clear, round(gate_factor, 6) AS gate_factor FROM shown")
def soft_gates(spark, sf):
    return fx.shown(spark, sf).select("item_id", *[r6(c, c) for c in ("gate_subject", "gate_soft", "gate_clear", "gate_factor")])


@query(q.ITEMS + "SELECT item_id, round(detail, 6) AS detail FROM shown")
def combine_detail(spark, sf):
    return fx.shown(spark, sf).select("item_id", r6("detail", "detail"))


@query(q.ITEMS + "SELECT item_id, stage, round(score, 6) AS score FROM shown")
def cascade_stage(spark, sf):
    return fx.shown(spark, sf).select("item_id", "stage", r6("score", "score"))


@query(q.ITEMS + "SELECT stage, count(*) AS n FROM ev GROUP BY stage")
def stage_counts(spark, sf):
    return cascade.stage_counts(fx.evaluated(spark, sf))


@query(q.ITEMS + "SELECT item_id, round(CASE WHEN p IS NULL THEN z ELSE 0.7 * p + 0.3 * z END, 6) AS score FROM (SELECT item_id, a4 AS z, CASE WHEN item_id % 2 = 0 THEN a5 END AS p FROM shown)")
def simple_pipeline(spark, sf):
    p = F.when(F.col("item_id") % 2 == 0, F.col("axes")["5"])
    return fx.shown(spark, sf).select("item_id", r6(cascade.simple_score(F.col("axes")["4"], p), "score"))


@query(q.ITEMS + f"SELECT count(*) AS n FROM wide WHERE {q.ev('a0')} >= 0.35 - 0.15 OR {q.ev('a2')} >= 0.3 * 0.7 OR coalesce(anchors, 0) > 0")
def candidate_mask(spark, sf):
    return cascade.candidates(fx.scored(spark, sf), fx.POLICY).agg(F.count("*").alias("n"))


@query(q.ITEMS + "SELECT item_id FROM shown WHERE a9 < 0.5")
def visibility_mask(spark, sf):
    p = fx.POLICY.with_(policy_filter="exclude")
    return cascade.visible(fx.evaluated(spark, sf), p).select("item_id")


@query(q.ITEMS + "SELECT item_id, round(score, 6) AS score FROM shown WHERE score >= 0.35")
def match_filter(spark, sf):
    return views.matches(fx.shown(spark, sf), 0.35).select("item_id", r6("score", "score"))


# Regions ------------------------------------------------------------------------------------------------------

def _region_scores(spark, sf):
    rows = axes.score_axes(fx.region_items(spark, sf), fx.registry(spark, sf), fx.POLICY.scale)
    return regions.region_scores(rows)


@query(q.REGIONS + "SELECT item_id, region_key, kind, axis::VARCHAR AS axis, round(score, 6) AS score FROM rs")
def region_score_table(spark, sf):
    return _region_scores(spark, sf).withColumn("score", F.round("score", 6))


@query(q.REGIONS + "SELECT rs.axis::VARCHAR AS axis, kind, count(*) AS n FROM rs JOIN eligible USING (axis, kind) GROUP BY ALL")
def join_region_eligibility(spark, sf):
    return _region_scores(spark, sf).join(F.broadcast(fx.eligible(spark)), ["axis", "kind"]).groupBy("axis", "kind").agg(F.count("*").alias("n"))


@query(q.REGIONS + "SELECT item_id, axis::VARCHAR AS axis, round(score, 6) AS score FROM agg")
def region_aggregate(spark, sf):
    return regions.aggregate_regions(_region_scores(spark, sf), fx.eligible(spark)).withColumn("score", F.round("score", 6))


@query(q.REGIONS + "SELECT item_id, region_key, kind, round(detail, 6) AS detail FROM rd")
def combine_detail_rows(spark, sf):
    return regions.detail_rows(_region_scores(spark, sf), fx.eligible(spark), fx.WEIGHTS).withColumn("detail", F.round("detail", 6))


@query(q.REGIONS + "SELECT item_id, CASE WHEN most > coalesce(f, 0) THEN key ELSE 'full' END AS region_key FROM (SELECT item_id, max(detail) FILTER (kind = 'full') AS f, max(detail) FILTER (kind <> 'full') AS most, (list(region_key ORDER BY detail DESC, place) FILTER (kind <> 'full'))[1] AS key FROM rd GROUP BY item_id)")
def best_region(spark, sf):
    detail = regions.detail_rows(_region_scores(spark, sf), fx.eligible(spark), fx.WEIGHTS)
    place = F.create_map(*[F.lit(x) for i, k in enumerate(fx.REGION_KEYS) for x in (k, i)])[F.col("region_key")]
    return regions.best_region(detail, place)


@query(f"SELECT vec_id, region_key, CASE WHEN region_key = 'full' THEN 'full' WHEN region_key LIKE 'torso%' THEN 'torso' WHEN region_key LIKE 'bandtop%' THEN 'band_upper' WHEN region_key LIKE 'bandmid%' THEN 'band_mid' ELSE 'band' END AS kind FROM (SELECT vec_id, ['full', 'bandtop', 'bandmid3', 'centre', 'torso0'][vec_id % 5 + 1] AS region_key FROM embeddings)")
def region_kind(spark, sf):
    keys = F.array(*[F.lit(k) for k in ("full", "bandtop", "bandmid3", "centre", "torso0")])
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.get(keys, (F.col("vec_id") % 5).cast("int")).alias("region_key"))
    kinds = spark.createDataFrame(list(fx.KINDS), "prefix string, kind string")
    return rows.join(F.broadcast(tx.region_kind(rows.select("region_key").distinct(), kinds)), "region_key").select("vec_id", "region_key", "kind")


@query(q.FRAMES + f"SELECT item_id, region_key, kind, {q.BOX} FROM ar WHERE {q.BIG}")
def anchored_regions(spark, sf):
    return regions.anchored_regions(fx.frames(spark, sf), fx.geometry(spark))


@query(q.FRAMES + f"SELECT item_id, region_key, kind, {q.BOX} FROM fb WHERE {q.BIG}")
def fallback_bands(spark, sf):
    return regions.fallback_bands(fx.frames(spark, sf))


@query(q.FRAMES + f"SELECT item_id, 'full' AS region_key, 'full' AS kind, NULL::INTEGER AS l, NULL::INTEGER AS t, NULL::INTEGER AS r, NULL::INTEGER AS b FROM frame UNION ALL SELECT item_id, region_key, kind, {q.BOX} FROM (SELECT * FROM ar UNION ALL SELECT * FROM fb) WHERE {q.BIG}")
def plan_regions(spark, sf):
    return regions.plan_regions(fx.frames(spark, sf), fx.geometry(spark))


@query(q.FRAMES + f"SELECT item_id, {q.BOX} FROM (SELECT item_id, {q.clamp('width * 0.125 - 20', 'height * 0.5 - 30', 'width * 0.5', 'height * 0.9 + 7')} AS box FROM frame) WHERE {q.BIG}")
def clamp_box(spark, sf):
    w, h = F.col("width"), F.col("height")
    box = regions.clamp_box(w * 0.125 - 20, h * 0.5 - 30, w * 0.5, h * 0.9 + 7, w, h)
    return fx.frames(spark, sf).select("item_id", box.alias("box")).where("box is not null").select("item_id", "box.*")


@query("SELECT p_partkey AS item_id, list_slice(list_reverse(list_sort([p_size % 7, p_size % 11, p_size % 5, p_size % 3])), 1, 3) AS widths FROM part")
def top_k_anchors(spark, sf):
    sizes = F.array(*[F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("p_size") % k).cast("int").alias("w"), F.lit(1).alias("h"), F.lit(1.0).alias("score")) for k in (7, 11, 5, 3)])
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.transform(regions.top_anchors(sizes), lambda a: a["w"]).alias("widths"))


# Scalars ------------------------------------------------------------------------------------------------------

def _e(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", vec.as_double(F.col("embedding")).alias("e"))


_E = "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"


@query(f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total, round(sqrt(list_dot_product(e, e)) / n, 6) AS length FROM (SELECT *, CASE WHEN list_dot_product(e, e) > 0 THEN sqrt(list_dot_product(e, e)) ELSE 1 END AS n FROM ({_E}))")
def l2_normalize(spark, sf):
    rows = _e(spark, sf).select("vec_id", vec.l2_normalize(F.col("e")).alias("u"))
    return rows.select("vec_id", r6(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), "total"), r6(vec.norm(F.col("u")), "length"))


_SHIFT = "list_concat(e[2:], e[:1])"


@query(f"SELECT vec_id, round(list_dot_product(e, {_SHIFT}), 6) AS d FROM ({_E})")
def dot(spark, sf):
    e = F.col("e")
    return _e(spark, sf).select("vec_id", r6(vec.dot(e, F.concat(F.slice(e, 2, 10_000), F.slice(e, 1, 1))), "d"))


@query(f"SELECT vec_id, round(list_dot_product(e, {_SHIFT}) / list_dot_product(e, e), 6) AS c FROM ({_E})")
def cosine_similarity(spark, sf):
    e = F.col("e")
    return _e(spark, sf).select("vec_id", r6(vec.cosine_similarity(e, F.concat(F.slice(e, 2, 10_000), F.slice(e, 1, 1))), "c"))


def _scalar(name: str, fn, sql: str):
    def run(spark, sf):
        x = (F.col("value") - 50) / 10
        return fx.table(spark, sf, "events").where("value is not null").select("event_id", r6(fn(x), "y"))

    query(f"SELECT event_id, round({sql}, 6) AS y FROM (SELECT event_id, (value - 50) / 10 AS x FROM events WHERE value IS NOT NULL)", name)(run)


_scalar("sigmoid", vec.sigmoid, "1 / (1 + exp(-x))")
_scalar("logit", lambda x: vec.logit(vec.sigmoid(x)), "ln(greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-x))))) - ln(1 - greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-x)))))")
_scalar("evidence", vec.evidence, q.ev("x"))
_scalar("ramp", lambda x: vec.ramp(x, 0.2, 0.9), q.ramp("x", 0.2, 0.9))
_scalar("ramp_flat", lambda x: vec.ramp(x, 0.5, 0.5), q.ramp("x", 0.5, 0.501))


@query(f"SELECT event_id, {q.band('value / 100')} AS band FROM events")
def score_band(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", tx.score_band(F.col("value") / 100).alias("band"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'skip' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE 'unlabeled' END AS label_name FROM labels")
def label_name(spark, sf):
    return fx.labels(spark, sf).select(F.col("item_id").alias("doc_id"), tx.label_name(F.col("label")).alias("label_name"))


@query("""WITH p AS (SELECT source AS axis, (doc_id % 7)::INTEGER AS pos, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE '  ' || lang || ' ' END AS t, CASE doc_id % 4 WHEN 0 THEN '2.5' WHEN 1 THEN '-1' WHEN 2 THEN 'x' END AS w FROM documents WHERE source IS NOT NULL),
k AS (SELECT axis, pos, trim(t) AS prompt, CASE WHEN try_cast(w AS DOUBLE) > 0 THEN try_cast(w AS DOUBLE) ELSE 1.0 END AS weight FROM p WHERE trim(t) <> '')
SELECT * FROM k UNION ALL SELECT DISTINCT axis, 0, '', 1.0 FROM p WHERE axis NOT IN (SELECT axis FROM k)""")
def prompt_normalize(spark, sf):
    d = fx.table(spark, sf, "documents").where("source is not null")
    text = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("  "), "lang", F.lit(" ")))
    k = F.col("doc_id") % 4
    return tx.prompt_normalize(d.select(F.col("source").alias("axis"), (F.col("doc_id") % 7).cast("int").alias("pos"), text.alias("text"), F.when(k == 0, "2.5").when(k == 1, "-1").when(k == 2, "x").alias("weight")))


@query(r"""SELECT doc_id, CASE WHEN s = '' THEN 'output' ELSE s END AS name FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(chr(9) || ' ' || source || CASE WHEN doc_id % 3 = 0 THEN ':a/b*?.' ELSE '<' || doc_id || '>..' || chr(10) END, '[<>:"/\\|?*\x00]', '_', 'g'), '^\s+|\s+$', '', 'g'), '^\.+|\.+$', '', 'g') AS s FROM documents)""")
def sanitize_name(spark, sf):
    raw = F.concat(F.lit("\t "), "source", F.when(F.col("doc_id") % 3 == 0, ":a/b*?.").otherwise(F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">..\n"))))
    return fx.table(spark, sf, "documents").select("doc_id", tx.sanitize_name(raw).alias("name"))


@query(r"""SELECT doc_id, source || '_' || doc_id || '_' || printf('%.3f', (n_chars % 1000) / 1000.0) || '_' || CASE WHEN doc_id > 999 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 4, '0') END || '_' || strftime(to_timestamp(1600000000 + doc_id) AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S') || '_' || lang || '.txt' AS name FROM documents""")
def format_output_name(spark, sf):
    d = fx.table(spark, sf, "documents")
    path = F.concat(F.lit("in/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    name = tx.format_output_name(path, (F.col("n_chars") % 1000) / 1000, F.col("lang"), F.col("doc_id"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id")), "{stem}_{score}_{index}_{timestamp}{nothing}_{label}{ext}")
    return d.select("doc_id", name.alias("name"))


@query("SELECT doc_id, replace(replace('read /home/user/data/' || source || ' and /home/user/x', '/home/user/data', '~'), '/home/user', '~') AS line FROM documents")
def redact_roots(spark, sf):
    line = F.concat(F.lit("read /home/user/data/"), "source", F.lit(" and /home/user/x"))
    return fx.table(spark, sf, "documents").select("doc_id", tx.redact_roots(line, ["/home/user", "/home/user/data", ""]).alias("line"))


@query("SELECT event_id AS item_id, CASE WHEN event_id % 5 < 3 THEN least(1.0, greatest(0.0, try_cast(json_extract_string(props, '$.k') AS DOUBLE))) END AS k FROM events")
def parse_verdict(spark, sf):
    return fx.verdict_texts(spark, sf).select("item_id", tx.parse_verdict(F.col("text"), ["k"])["k"].alias("k"))


_SHOWN_AXES = {"one": "4", "two": "5"}


@query(q.ITEMS + f"SELECT item_id, concat_ws('  ', printf('one %.2f', round({q.ev('a4')}, 10)), printf('two %.2f', round({q.ev('a5')}, 10)), CASE WHEN anchors >= 0 THEN 'anchors ' || anchors END) AS details FROM shown")
def axis_details(spark, sf):
    return fx.shown(spark, sf).select("item_id", tx.axis_details(F.col("axes"), _SHOWN_AXES, F.col("anchors"), F.lit("full")).alias("details"))


_GROUPS = {"First": ["5"], "Second": ["4", "7", "8"], "Third": ["6"]}
_DOMINANT = f"CASE WHEN greatest(g1, g2, g3) < 0.2 THEN 'Other' WHEN g1 = greatest(g1, g2, g3) THEN 'First' WHEN g2 = greatest(g1, g2, g3) THEN 'Second' ELSE 'Third' END"
_G = f"SELECT *, {q.ev('a5')} AS g1, greatest({q.ev('a4')}, {q.ev('a7')}, {q.ev('a8')}) AS g2, {q.ev('a6')} AS g3 FROM shown"


@query(q.ITEMS + f"SELECT item_id, {_DOMINANT} AS bucket FROM ({_G})")
def dominant_axis(spark, sf):
    return fx.shown(spark, sf).select("item_id", tx.dominant_axis(F.col("axes"), _GROUPS).alias("bucket"))


@query(q.ITEMS + f"SELECT item_id, {_DOMINANT} AS bucket, round(score, 6) AS score FROM ({_G}) WHERE score >= 0.35")
def detected_view(spark, sf):
    return views.matches(fx.shown(spark, sf), 0.35).select("item_id", tx.dominant_axis(F.col("axes"), _GROUPS).alias("bucket"), r6("score", "score"))


@query(q.FRAMES + "SELECT item_id, CASE WHEN item_id % 9 BETWEEN 5 AND 8 THEN height ELSE width END AS width, CASE WHEN item_id % 9 BETWEEN 5 AND 8 THEN width ELSE height END AS height FROM frame")
def oriented_size(spark, sf):
    return fx.frames(spark, sf).select("item_id", tx.oriented_size(F.col("width"), F.col("height"), F.col("item_id") % 9).alias("s")).select("item_id", "s.*")


# Views --------------------------------------------------------------------------------------------------------

@query(q.ITEMS + "SELECT item_id FROM shown WHERE contains(lower(name || ' ' || label_name), 'item<1')")
def search_filter(spark, sf):
    return views.search(fx.shown(spark, sf), " ITEM<1 ", ["name", "label_name"]).select("item_id")


@query(q.ITEMS + "SELECT item_id FROM shown WHERE label_name <> 'unlabeled'")
def label_filter(spark, sf):
    return views.by_label(fx.shown(spark, sf), "labeled").select("item_id")


@query(q.ITEMS + "SELECT item_id FROM shown WHERE score < 0.35")
def matched_filter(spark, sf):
    return views.by_match(fx.shown(spark, sf), "unmatched", 0.35).select("item_id")


@query(q.ITEMS + "SELECT item_id FROM shown WHERE score >= 0.1")
def score_range_filter(spark, sf):
    return views.by_range(fx.shown(spark, sf), F.lit(" 0.1 "), F.lit("high")).select("item_id")


@query(q.ITEMS + "SELECT count(*) FILTER (label_name = 'good') AS good, count(*) FILTER (label_name = 'bad') AS bad, count(*) FILTER (label_name = 'skip') AS skip, count(*) FILTER (label_name = 'unlabeled') AS unlabeled FROM shown")
def label_counts(spark, sf):
    return views.label_counts(fx.shown(spark, sf))


@query(q.ITEMS + "SELECT count(*) AS total, count(*) FILTER (score >= 0.35) AS above, count(*) FILTER (label_name <> 'unlabeled') AS labeled FROM shown")
def summary_counts(spark, sf):
    return views.summary(fx.shown(spark, sf), 0.35)


@query(q.ITEMS + ", anchor AS (SELECT e AS a, item_id AS aid FROM shown ORDER BY item_id LIMIT 1) SELECT item_id, round(list_dot_product(e, a) / sqrt(list_dot_product(e, e) * list_dot_product(a, a)), 6) AS similarity FROM shown, anchor WHERE item_id <> aid ORDER BY list_dot_product(e, a) / sqrt(list_dot_product(e, e) * list_dot_product(a, a)) DESC, item_id LIMIT 12")
def similar_items(spark, sf):
    shown = fx.shown(spark, sf)
    first = shown.agg(F.min("item_id").alias("i")).first()["i"]
    return views.similar(shown, -1 if first is None else first, 12).select("item_id", r6("similarity", "similarity"))


@query()
def similar_batch(spark, sf):
    """The five nearest of every visible item, by the index; tests hold its recall against all pairs."""
    shown = fx.shown(spark, sf).select("item_id", "embedding")
    return similarity.similar_to_each(shown, shown, 5).select("anchor", "item_id", r6("similarity", "similarity"), "rank")


@query(q.ITEMS + "SELECT item_id, row_number() OVER (ORDER BY lower(name), score DESC, item_id)::INTEGER AS place FROM shown ORDER BY lower(name), score DESC, item_id LIMIT 50")
def view_sort(spark, sf):
    from pyspark.sql import Window

    top = fx.shown(spark, sf).orderBy(*views.sort_key("filename")).limit(50)
    return top.select("item_id", F.row_number().over(Window.orderBy(*views.sort_key("filename"))).alias("place"))


_VIEWED = q.ITEMS + """, viewed AS (SELECT item_id, name, mt, round(score, 9) AS s, CASE WHEN item_id % 10 = 0 THEN 20 WHEN round(score, 9) >= 0.5 THEN 0 WHEN round(score, 9) >= 0.35 THEN 1 WHEN round(score, 9) >= 0.2 THEN 2 ELSE 3 END AS b FROM shown)
SELECT item_id, row_number() OVER (ORDER BY {0})::INTEGER AS place FROM viewed ORDER BY {0} LIMIT 50"""


def _viewed(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    from pyspark.sql import Window

    rows = fx.shown(spark, sf).withColumn("score", F.round("score", 9))
    s = F.col("score")
    bucket = F.when(F.col("item_id") % 10 == 0, "Model disagrees").when(s >= 0.5, "Likely match").when(s >= 0.35, "Likely false positive").when(s >= 0.2, "Likely false negative").otherwise("Uncertain")
    order = views.sort_key(mode)
    top = rows.withColumn("bucket", bucket).orderBy(*order).limit(50)  # at most 50 rows are numbered in one task
    return top.select("item_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(_VIEWED.format("b, s DESC, lower(name), item_id"))
def view_sort_bucket(spark, sf):
    return _viewed(spark, sf, "bucket")


@query(_VIEWED.format("mt DESC, s DESC, item_id"))
def view_sort_date(spark, sf):
    return _viewed(spark, sf, "date")


# Inventories --------------------------------------------------------------------------------------------------

@query(q.INVENTORY + "SELECT path FROM inv WHERE NOT (path LIKE 'src1/%' OR path LIKE 'src7/%')")
def prune_marked_dirs(spark, sf):
    marked = fx.inventory(spark, sf).select(F.substring_index("path", "/", 1).alias("dir")).distinct().where("dir in ('src1', 'src7')")
    return inv.prune_marked(fx.inventory(spark, sf), marked).select("path")


@query("SELECT doc_id, sha1(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", inv.content_hash(F.col("text")).alias("content_hash"))


def _cache(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return fx.inventory_before(spark, sf).join(e, F.col("doc_id") == F.col("vec_id")).select("path", "mtime", "size", "content_hash", "vector", F.lit("ns").alias("namespace"))


_CACHE = ", cache AS (SELECT b.*, 'ns' AS namespace FROM before_ b JOIN embeddings e ON b.doc_id = e.vec_id)"


@query(q.INVENTORY + _CACHE + " SELECT i.path FROM inv i JOIN cache c ON i.path = c.path AND i.mtime = c.mtime AND i.size = c.size")
def cache_lookup(spark, sf):
    return inv.cache_lookup(fx.inventory(spark, sf), _cache(spark, sf).drop("content_hash"), 64).select("path")


@query(q.INVENTORY + _CACHE + " SELECT i.path, c.path AS cached FROM inv i JOIN cache c USING (content_hash)")
def join_cache(spark, sf):
    return inv.fan_out(fx.inventory(spark, sf).select("content_hash", "path"), _cache(spark, sf).select("content_hash", F.col("path").alias("cached"))).select("path", "cached")


@query("SELECT DISTINCT source, lang, trim(lower(regexp_replace('Mod-' || source || '/' || lang || '!', '[^A-Za-z0-9]+', '_', 'g')), '_') AS namespace FROM documents")
def cache_namespace(spark, sf):
    return fx.table(spark, sf, "documents").select("source", "lang").distinct().select("source", "lang", inv.namespace(F.lit("Mod"), F.concat("source", F.lit("/"), "lang", F.lit("!"))).alias("namespace"))


@query("SELECT DISTINCT source, trim(lower(regexp_replace('M:' || source, '[^A-Za-z0-9]+', '_', 'g')), '_') || '__g2' AS namespace FROM documents")
def region_namespace(spark, sf):
    return fx.table(spark, sf, "documents").select("source").distinct().select("source", inv.region_namespace(F.concat(F.lit("M:"), "source"), 2).alias("namespace"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 2")
def decode_version_invalidate(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("version"))
    return inv.valid_version(rows, 2).select("vec_id")


@query(q.INVENTORY + _CACHE + " SELECT DISTINCT content_hash FROM inv WHERE content_hash NOT IN (SELECT content_hash FROM cache WHERE content_hash IS NOT NULL)")
def incremental_pending(spark, sf):
    return inv.pending(fx.inventory(spark, sf).withColumn("namespace", F.lit("ns")), _cache(spark, sf)).select("content_hash")


@query(q.INVENTORY + ", v AS (SELECT content_hash, min(doc_id) AS vec FROM inv GROUP BY content_hash) SELECT path, vec FROM inv JOIN v USING (content_hash)")
def join_dedup_fanout(spark, sf):
    rows = fx.inventory(spark, sf)
    return inv.fan_out(rows, rows.groupBy("content_hash").agg(F.min("doc_id").alias("vec"))).select("path", "vec")


@query(q.INVENTORY + "SELECT content_hash, count(*) AS n, min(path) AS first FROM inv GROUP BY content_hash HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return inv.duplicate_groups(fx.inventory(spark, sf))


@query(q.INVENTORY + "SELECT content_hash, path FROM inv WHERE content_hash IN (SELECT content_hash FROM inv GROUP BY content_hash HAVING count(*) > 1)")
def duplicate_members(spark, sf):
    rows = fx.inventory(spark, sf)
    return inv.duplicate_members(rows, inv.duplicate_groups(rows))


@query(q.INVENTORY + "SELECT content_hash, path FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS rn FROM inv) WHERE rn > 1")
def duplicate_remainder(spark, sf):
    return inv.duplicate_remainder(fx.inventory(spark, sf))


@query(q.INVENTORY + "SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN i.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM before_ b FULL JOIN inv i USING (path) WHERE b.path IS NULL OR i.path IS NULL OR b.mtime <> i.mtime OR b.size <> i.size")
def snapshot_diff(spark, sf):
    return inv.snapshot_diff(fx.inventory_before(spark, sf), fx.inventory(spark, sf))


@query("WITH g AS (SELECT vec_id, i, x::DOUBLE AS x FROM (SELECT vec_id, unnest([0, 1]) AS i, unnest(embedding[1:2]) AS x FROM embeddings)) SELECT vec_id::VARCHAR AS name, i::VARCHAR AS axis, CASE WHEN vec_id % 7 = 0 AND vec_id % 5 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 'new' WHEN vec_id % 5 = 0 THEN 'gone' ELSE 'moved' END AS kind FROM g WHERE (vec_id % 7 = 0) <> (vec_id % 5 = 0) OR (vec_id % 7 <> 0 AND vec_id % 5 <> 0 AND vec_id % 3 = 0)")
def baseline_diff(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice(vec.as_double(F.col("embedding")), 1, 2)).alias("i", "score")).select("vec_id", F.col("vec_id").cast("string").alias("name"), F.col("i").cast("string").alias("axis"), "score")
    now = rows.where("vec_id % 5 <> 0").withColumn("score", F.col("score") + F.when(F.col("vec_id") % 3 == 0, 0.01).otherwise(1e-7))
    return inv.baseline_diff(rows.where("vec_id % 7 <> 0"), now)


# Settings -----------------------------------------------------------------------------------------------------

_ASKED = """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
asked AS (SELECT source, 'threshold' AS key, (n % 3) || '.5' AS value FROM s UNION ALL SELECT source, 'refine_max', (n * 100000)::VARCHAR FROM s UNION ALL SELECT source, 'scale', 'NaN' FROM s
 UNION ALL SELECT source, 'policy_filter', CASE WHEN n % 2 = 0 THEN 'only' ELSE 'none' END FROM s UNION ALL SELECT source, 'exclude_at', '0.9' FROM s UNION ALL SELECT source, 'min_clear', '0.1' FROM s
 UNION ALL SELECT source, 'classifier_weight', '0.5' FROM s UNION ALL SELECT source, 'require_subject', 'yes' FROM s UNION ALL SELECT source, 'batch_size', '32' FROM s UNION ALL SELECT source, 'pipeline', CASE WHEN n % 3 = 0 THEN 'simple' ELSE 'cascade' END FROM s),
eff AS (SELECT source, key, CASE key WHEN 'threshold' THEN CASE WHEN value = '0.5' THEN '0.5' ELSE '1.0' END WHEN 'refine_max' THEN CASE WHEN value::BIGINT <= 1000000 THEN value ELSE '400' END WHEN 'scale' THEN '40.0'
 WHEN 'policy_filter' THEN CASE WHEN value = 'none' THEN 'include' ELSE value END WHEN 'exclude_at' THEN '0.3' WHEN 'min_clear' THEN '0.25' WHEN 'require_subject' THEN 'false' ELSE value END AS value FROM asked)
"""


@query(_ASKED + "SELECT * FROM eff")
def policy_bounds(spark, sf):
    return pol.bounded(fx.settings(spark, sf), pol.settings_table(spark))


_OWN = ", ".join(f"'{k}'" for k in pol.OVERRIDABLE)


@query(_ASKED + f"SELECT source, key, key IN ({_OWN}) AS accepted FROM asked")
def policy_override_allowlist(spark, sf):
    return pol.split_overrides(fx.settings(spark, sf)).select("source", "key", "accepted")


_DEFAULTS = ", ".join(f"('{k}', '{d}')" for k, (_, d, _, _) in pol.SETTINGS.items())


@query(_ASKED + f"SELECT s.source, d.key, coalesce(e.value, d.value) AS value FROM s CROSS JOIN (VALUES {_DEFAULTS}) d(key, value) LEFT JOIN eff e ON e.source = s.source AND e.key = d.key AND e.key IN ({_OWN})")
def policy_resolve(spark, sf):
    return pol.resolved(fx.settings(spark, sf), pol.settings_table(spark))


#: Items of documents' sources, each with the settings that its source asks for; the last ones it may not set, or they would weaken the gate.
_SOURCED = q.ITEMS + f""", src AS (SELECT i.item_id, i.anchors, d.source, try_cast(substr(d.source, 4) AS INTEGER) % 4 AS k FROM item i JOIN documents d ON d.doc_id = i.item_id),
rescaled AS (SELECT s.item_id, axis, 1 / (1 + exp(-CASE WHEN k = 0 THEN 4.0 ELSE 8.0 END * (max(v.s) FILTER (pol = 'p') - coalesce(max(v.s) FILTER (pol = 'n'), 0)))) AS score FROM side_item v JOIN src s USING (item_id) GROUP BY s.item_id, axis, k),
swide AS (SELECT s.item_id, s.anchors, s.source, s.k, w.* EXCLUDE (item_id) FROM src s JOIN (SELECT item_id, {q.WIDE} FROM rescaled GROUP BY item_id) w USING (item_id)),
parted AS (SELECT *, {q.ev("a0")} AS e_subject, {q.ev("a1")} AS e_soft, {q.ev("a2")} AS e_exclude, {q.ev("a3")} AS e_clear, {q.detail(lambda a: "a" + a)} AS parts, [{q.ev("a4")} * 1.0, {q.ev("a6")} * 0.5] AS few FROM swide),
detailed AS (SELECT * EXCLUDE (parts, few), CASE WHEN k = 2 THEN {q.combined("few").replace("/ 5", "/ 2")} ELSE {q.combined("parts")} END AS rank_detail, greatest({q.combined("parts")}, CASE WHEN k = 2 THEN {q.combined("few").replace("/ 5", "/ 2")} ELSE 0 END) AS detail FROM parted),
gated AS (SELECT *, {q.EXCLUDED} AS own_excluded, CASE WHEN k = 3 THEN greatest({q.ramp("e_subject", 0.35, 0.55)}, CASE WHEN coalesce(anchors, 0) > 0 THEN 0.85 ELSE 0 END) ELSE 1 END AS g0, greatest({q.ramp("e_soft", 0.0, 0.35)}, 0.25) AS g1, 1 - {q.ramp("e_exclude", 0.3 * 0.6, 0.3)} AS g2 FROM detailed)
SELECT g.item_id, g.source, round(rank_detail, 6) AS detail, round(rank_detail * g0 * g1 * g2, 6) AS score, rank_detail * g0 * g1 * g2 >= CASE WHEN k = 0 THEN 0.2 ELSE 0.35 END AS matched FROM gated g JOIN ev USING (item_id)
WHERE NOT own_excluded AND NOT ev.excluded AND (k <> 1 OR coalesce(g.a9 < 0.4, true)) AND (k <> 3 OR ((g.e_subject >= 0.35 OR coalesce(g.anchors, 0) > 0) AND coalesce(g.a0 >= 0.5, false)))"""


@query(_SOURCED)
def policy_by_source(spark, sf):
    """Items scored, gated and matched under the settings of their source; what a source may not set has no effect."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source")
    asked = {0: {"scale": "4", "threshold": "0.2"}, 1: {"policy_filter": "exclude", "policy_threshold": "0.4"}, 2: {"detail_weights": '{"4": 1, "6": 0.5, "5": "no", "7": -1}'}, 3: {"require_subject": "true", "exclude_at": "0.9", "min_clear": "0", "pipeline": "simple"}}
    k = F.substring("source", 4, 9).try_cast("int") % 4
    rows = F.array(*[F.when(k == n, F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))) for n, of in asked.items() for key, value in of.items()])
    settings = docs.select("source").distinct().select("source", F.inline(F.filter(rows, lambda x: x.isNotNull())))
    own = pol.by_source(settings, pol.settings_table(spark))
    items = fx.items(spark, sf).join(docs, "item_id")
    by = pol.BySource(fx.POLICY)
    shown = cascade.visible(cascade.evaluate_by_source(items, fx.registry(spark, sf), own, fx.POLICY), by)
    return shown.select("item_id", "source", r6("detail", "detail"), r6("base", "score"), (F.col("base") >= by.threshold).alias("matched"))


@query(_ASKED + "SELECT source, 'classifier_weight' AS key FROM s WHERE n % 3 <> 0")
def inert_settings(spark, sf):
    return pol.inert(fx.settings(spark, sf))


# Labels and learning ------------------------------------------------------------------------------------------

@query(q.EVENTS + "SELECT item_id, label FROM fold")
def label_fold(spark, sf):
    return labels.fold(fx.label_events(spark, sf))


@query(q.ITEMS + "SELECT item_id, 1 AS label, 100001::BIGINT AS seq FROM shown WHERE score >= 0.35")
def bulk_label(spark, sf):
    return labels.bulk_label(views.matches(fx.shown(spark, sf), 0.35), 1, 100_000)


def _pool(spark, sf):
    return fx.label_events(spark, sf).where("label is not null")


@query(q.EVENTS + "SELECT item_id, label, seq FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS rn FROM le WHERE label IS NOT NULL) WHERE rn = 1 ORDER BY seq DESC, item_id LIMIT 100")
def pool_upsert(spark, sf):
    e = _pool(spark, sf)
    return labels.pool_upsert(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), 100)


_OWNLAB = ", own AS (SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS label FROM labels)"


@query(q.EVENTS + _OWNLAB + " SELECT * FROM own UNION ALL SELECT * FROM fold WHERE item_id NOT IN (SELECT item_id FROM own)")
def pool_merge(spark, sf):
    return labels.pool_merge(fx.labels(spark, sf), labels.fold(fx.label_events(spark, sf)))


@query(q.EVENTS + "SELECT item_id, label FROM fold WHERE item_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def pool_prune(spark, sf):
    here = fx.items(spark, sf).where("item_id % 2 = 0").select("item_id")
    return labels.pool_prune(labels.fold(fx.label_events(spark, sf)), here)


@query(q.EVENTS + _OWNLAB + " SELECT item_id, label FROM own WHERE item_id NOT IN (SELECT item_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS rn FROM le) WHERE rn = 1 AND label IS NULL)")
def pool_forget(spark, sf):
    e = fx.label_events(spark, sf)
    cleared = e.select("item_id").distinct().join(labels.fold(e), "item_id", "left_anti")
    return labels.pool_forget(fx.labels(spark, sf), cleared)


@query(q.EVENTS + "SELECT count(*) AS total, count(*) FILTER (label = 1) AS accepted, count(*) FILTER (label = 0) AS rejected FROM fold")
def pool_stats(spark, sf):
    return labels.fold(fx.label_events(spark, sf)).agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("accepted"), F.count_if(F.col("label") == 0).alias("rejected"))


@query(q.ITEMS + "SELECT item_id, label_name FROM shown")
def join_labels(spark, sf):
    return fx.shown(spark, sf).select("item_id", "label_name")


@query(q.ITEMS + "SELECT item_id FROM shown WHERE label IS NULL")
def anti_labeled(spark, sf):
    return cascade.visible(fx.evaluated(spark, sf), fx.POLICY).join(fx.labels(spark, sf), "item_id", "left_anti").select("item_id")


@query(q.ITEMS + "SELECT item_id, label AS y FROM shown WHERE label IN (0, 1)")
def training_set(spark, sf):
    shown = cascade.visible(fx.evaluated(spark, sf), fx.POLICY).withColumn("features", vec.as_double(F.col("embedding")))
    return labels.training_set(fx.labels(spark, sf), shown, 64).select("item_id", "y")


@query(q.ITEMS + "SELECT item_id, 138::BIGINT AS width, round(2 * list_sum(e) + a0 + a1 + a2 + a3 + a4 + a5 + a6 + a7 + a8 + a9, 6) AS total FROM shown")
def build_features(spark, sf):
    f = learning.features(F.col("embedding"), F.lit(None).cast("array<double>"), F.col("axes"), [str(k) for k in range(10)])
    return fx.shown(spark, sf).select("item_id", f.alias("f")).select("item_id", F.size("f").cast("long").alias("width"), r6(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), "total"))


_PROTO = q.TRAIN + """, pe AS (SELECT y, i, avg(x / n) AS x FROM (SELECT y, unnest(range(len(x))) AS i, unnest(x) AS x, sqrt(list_dot_product(x, x)) AS n FROM train) GROUP BY y, i),
pv AS (SELECT y, list(x ORDER BY i) AS v FROM pe GROUP BY y), proto AS (SELECT y, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS p FROM pv)
"""


@query(_PROTO + "SELECT y, len(p) AS n, round(p[1], 6) AS first, round(list_sum(p), 6) AS total FROM proto")
def prototype_fit(spark, sf):
    p = learning.prototypes(fx.training(spark, sf))
    return p.select("y", F.size("prototype").cast("long").alias("n"), r6(F.get("prototype", 0), "first"), r6(F.aggregate("prototype", F.lit(0.0), lambda s, x: s + x), "total"))


def _prototype_scores(spark, sf):
    p = learning.prototypes(fx.training(spark, sf))
    both = p.agg(F.max(F.when(F.col("y") == 1, F.col("prototype"))).alias("pos"), F.max(F.when(F.col("y") == 0, F.col("prototype"))).alias("neg"))
    return fx.shown(spark, sf).join(F.broadcast(both)).select("item_id", learning.prototype_score(F.col("embedding"), F.col("pos"), F.col("neg")).alias("p"))


_PS = _PROTO + ", ps AS (SELECT vec_id AS item_id, 1 / (1 + exp(-8 * ((list_dot_product(x, a.p) - list_dot_product(x, b.p)) / sqrt(list_dot_product(x, x))))) AS p FROM (SELECT item_id AS vec_id, e AS x FROM shown), (SELECT p FROM proto WHERE y = 1) a, (SELECT p FROM proto WHERE y = 0) b)"


@query(_PS + " SELECT item_id, round(p, 6) AS p FROM ps")
def prototype_score(spark, sf):
    return _prototype_scores(spark, sf).withColumn("p", F.round("p", 6))


@query(q.TRAIN + "SELECT i, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END, 6) AS deviation FROM (SELECT unnest(range(len(x)))::INTEGER AS i, unnest(x) AS x FROM train) GROUP BY i")
def standard_scale(spark, sf):
    s = learning.scaling(fx.training(spark, sf)).select(F.posexplode(F.arrays_zip("mean", "deviation")).alias("i", "s"))
    return s.select("i", r6("s.mean", "mean"), r6("s.deviation", "deviation"))


@query(q.TRAIN + "SELECT y, round((SELECT count(*) FROM train) / (2.0 * count(*)), 6) AS weight FROM train GROUP BY y")
def class_weights(spark, sf):
    return learning.class_weights(fx.training(spark, sf)).select("y", r6("weight", "weight"))


_KEY = "md5('{0}|' || item_id)"


@query(q.TRAIN + f"SELECT item_id, y, ((row_number() OVER (PARTITION BY y ORDER BY {_KEY.format('s')}, item_id) - 1) % 5)::INTEGER AS fold FROM train")
def stratified_folds(spark, sf):
    return labels.folds(fx.training(spark, sf), 5, "s").select("item_id", "y", "fold")


@query(q.TRAIN + f"SELECT item_id, y, rn <= least(n - 1, greatest(1, round_even(n * 0.25, 0))) AS test FROM (SELECT item_id, y, row_number() OVER (PARTITION BY y ORDER BY {_KEY.format('t')}, item_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM train)")
def stratified_split(spark, sf):
    return labels.split(fx.training(spark, sf), 0.25, "t").select("item_id", "y", "test")


@query(q.TRAIN + "SELECT round((sum(r) FILTER (y = 1) - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, count(*) FILTER (y = 1) OVER () AS np, count(*) FILTER (y = 0) OVER () AS nn FROM pairs) GROUP BY np, nn")
def roc_auc(spark, sf):
    return learning.roc_auc(fx.metric_pairs(spark, sf)).select(r6("auc", "auc"))


@query(q.TRAIN + "SELECT round(sum(p * hits / seen) / sum(p), 6) AS ap FROM (SELECT p, sum(p) OVER (ORDER BY score DESC) AS hits, sum(n) OVER (ORDER BY score DESC) AS seen FROM (SELECT score, count(*) FILTER (y = 1) AS p, count(*) AS n FROM pairs GROUP BY score))")
def average_precision(spark, sf):
    return learning.average_precision(fx.metric_pairs(spark, sf)).select(r6("ap", "ap"))


@query(q.TRAIN + "SELECT y, n, round(least(1.0, greatest(0.0, q * least(1.0, n / 40.0))) * 0.85, 6) AS weight FROM (SELECT y, count(*) AS n, CASE WHEN y = 1 THEN 0.6 ELSE 0.35 END AS q FROM train GROUP BY y)")
def blend_weight(spark, sf):
    n = fx.training(spark, sf).groupBy("y").agg(F.count("*").alias("n"))
    return n.select("y", "n", r6(learning.blend_weight(F.when(F.col("y") == 1, 0.8), F.col("n"), F.lit(False)), "weight"))


@query(_PS + " SELECT item_id, round(CASE WHEN item_id % 3 = 0 THEN p ELSE 0.75 * (item_id % 100) / 100 + 0.25 * p END, 6) AS score FROM ps")
def learned_score(spark, sf):
    c = F.when(F.col("item_id") % 3 != 0, (F.col("item_id") % 100) / 100)
    return _prototype_scores(spark, sf).select("item_id", r6(learning.learned_score(c, F.col("p"), F.lit(30)), "score"))


@query(q.ITEMS + "SELECT item_id, round(CASE WHEN item_id % 4 = 0 THEN score ELSE 0.6 * score + 0.4 * a9 END, 6) AS score FROM shown")
def score_blend(spark, sf):
    learned = F.when(F.col("item_id") % 4 != 0, F.col("axes")["9"])
    return fx.shown(spark, sf).select("item_id", r6(learning.blend(F.col("score"), learned, F.lit(0.4)), "score"))


@query("SELECT run, auc, coalesce(n = 3 AND hi - lo <= 0.015, false) AS flat FROM (SELECT l_linenumber::BIGINT AS run, round(avg(l_discount), 4) AS auc, count(*) OVER w AS n, max(round(avg(l_discount), 4)) OVER w AS hi, min(round(avg(l_discount), 4)) OVER w AS lo FROM lineitem GROUP BY l_linenumber WINDOW w AS (ORDER BY l_linenumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))")
def quality_plateau(spark, sf):
    history = fx.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("run")).agg(F.round(F.avg("l_discount"), 4).alias("auc"))
    return learning.plateau(history)


@query(q.EVENTS + ", h AS (SELECT count(*) AS n, sum(('0x' || substr(md5(item_id || '|' || label), 1, 12))::BIGINT::HUGEINT) AS h FROM fold WHERE label IN (0, 1)) SELECT sha1('v1|' || n || '|' || coalesce(h, 0)) AS signature FROM h")
def training_signature(spark, sf):
    return labels.signature(labels.fold(fx.label_events(spark, sf)), "v1")


@query(q.ITEMS + "SELECT item_id, round(0.7 * score + 0.3 * CASE label WHEN 1 THEN 1.0 WHEN 0 THEN 0.0 ELSE score END, 6) AS score FROM shown")
def rescore(spark, sf):
    learned = F.when(F.col("label") == 1, 1.0).when(F.col("label") == 0, 0.0)
    return fx.shown(spark, sf).select("item_id", r6(learning.blend(F.col("score"), learned, F.lit(0.3)), "score"))


_RESCORED = _PS.replace(q.ITEMS, q.REGIONS, 1) + f""", rwide AS (SELECT item_id, anchors, w.* EXCLUDE (item_id) FROM item JOIN (SELECT item_id, {q.WIDE} FROM agg GROUP BY item_id) w USING (item_id)),
rev AS ({q.GATED.replace("FROM wide", "FROM rwide")})
SELECT r.item_id, round(r.score, 6) AS base, round(0.7 * r.score + 0.3 * ps.p, 6) AS score FROM rev r JOIN ps USING (item_id) WHERE r.stage = 'scored' AND NOT r.excluded"""


def region_pass(spark: SparkSession, sf: str, wanted: DataFrame) -> DataFrame:
    """The visible ones of the wanted items by their regions' evidence: item_id, axes, features, region_key and base."""
    reg = fx.registry(spark, sf)
    of = axes.score_axes(fx.region_items(spark, sf).join(wanted.select("item_id"), "item_id", "left_semi"), reg, fx.POLICY.scale)
    best = regions.aggregate_regions(regions.region_scores(of), fx.eligible(spark)).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("axis", "score"))).alias("axes"))
    rows = axes.role_scores(best.join(fx.items(spark, sf), "item_id"), reg)
    shown = cascade.visible(cascade.evaluate(rows, fx.POLICY, reg), fx.POLICY)
    return shown.select("item_id", "axes", F.col("embedding").alias("features"), F.lit("full").alias("region_key"), "base")


@query(_RESCORED)
def rescore_persisted(spark, sf):
    """Half of the items are scored, then all; labels change twice, and only the blend is done again. Scores are those of a full run."""
    table = score_table.ScoreTable(spark, f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}")
    sig = score_table.signature(fx.prompts(spark, sf), fx.POLICY)
    inputs = fx.items(spark, sf).select("item_id", F.sha1(F.col("item_id").cast("string")).alias("content_hash"))
    for batch, part in (("half", inputs.where("item_id % 2 = 0")), ("all", inputs)):
        table.refresh(part, sig, lambda todo: region_pass(spark, sf, todo), batch)
    train = fx.training(spark, sf)

    def learn_from(rows):
        p = learning.prototypes(rows)
        both = p.agg(F.max(F.when(F.col("y") == 1, F.col("prototype"))).alias("pos"), F.max(F.when(F.col("y") == 0, F.col("prototype"))).alias("neg"))
        return lambda todo: todo.join(F.broadcast(both)).select("item_id", learning.prototype_score(F.col("features"), F.col("pos"), F.col("neg")).alias("learned"), F.lit(0.3).alias("weight"))

    table.rescore(inputs, sig, "few", learn_from(train.where("item_id % 3 <> 0")), "one")
    out = table.rescore(inputs, sig, "every", learn_from(train), "two")
    return out.select("item_id", r6("base", "base"), r6("score", "score"))


@query()
def logreg_fit(spark, sf):
    train = fx.training(spark, sf)
    z = learning.standardised(train, learning.scaling(train))
    model = learning.logistic(z)
    return z.select("item_id", "y", r6(vec.sigmoid(model.margin(F.col("z"))), "p"))


@query(q.TRAIN + "SELECT item_id, round(1 / (1 + exp(-(list_sum(list_transform(x, lambda v, i: v * (i % 5 - 2))) + 0.5))), 6) AS p FROM train")
def logreg_score(spark, sf):
    model = learning.Linear([float((i + 1) % 5 - 2) for i in range(64)], 0.5)
    return fx.training(spark, sf).select("item_id", r6(vec.sigmoid(model.margin(F.col("features"))), "p"))


@query()
def platt_calibrate(spark, sf):
    cut = labels.split(fx.training(spark, sf), 0.25, "platt")
    rest = cut.where(~F.col("test"))
    scale = learning.scaling(rest)
    model = learning.logistic(learning.standardised(rest, scale))
    held = learning.standardised(cut.where("test"), scale).select("item_id", "y", model.margin(F.col("z")).alias("margin"))
    slope, bias = learning.platt(held)
    return held.select("item_id", "y", r6(vec.sigmoid(slope * F.col("margin") + bias), "p"))


def _folds_of(train):
    """Five folds, or as many as the smaller class has rows."""
    return max(2, min(5, *[r["count"] for r in train.groupBy("y").count().collect()]))  # a row a class


@query()
def cross_val_scores(spark, sf):
    train = fx.training(spark, sf)
    return learning.out_of_fold(train, 1.0, _folds_of(train))


@query()
def select_c(spark, sf):
    train = fx.training(spark, sf)
    c, auc = learning.select_c(train, _folds_of(train))
    return train.agg(F.count("*").alias("labels")).select("labels", F.lit(c).alias("c"), F.lit(auc).alias("auc"))


@query()
def fit_outcome(spark, sf):
    return learning.fit_outcome(fx.training(spark, sf))


@query()
def quality_estimate(spark, sf):
    return learning.quality_estimate(fx.training(spark, sf), None)


# Review and second opinions -----------------------------------------------------------------------------------

def _review(spark, sf):
    rows = fx.shown(spark, sf).withColumn("score", F.round("score", 9))
    return rows.withColumn("disagreement", F.when(F.col("item_id") % 4 == 0, review.disagreement(F.round(F.col("axes")["9"], 9), F.col("score"))))


@query(q.ITEMS + "SELECT item_id, round(abs(a9 - score), 6) AS disagreement FROM shown")
def score_disagreement(spark, sf):
    return fx.shown(spark, sf).select("item_id", r6(review.disagreement(F.col("axes")["9"], F.col("score")), "disagreement"))


_BUCKETS = q.ITEMS + """, un AS (SELECT item_id, s, CASE WHEN item_id % 4 = 0 THEN abs(round(a9, 9) - s) END AS d FROM (SELECT *, round(score, 9) AS s FROM shown WHERE label IS NULL)),
b1 AS (SELECT item_id, s, 'Model disagrees' AS bucket, row_number() OVER (ORDER BY d DESC, item_id) AS place FROM un WHERE d >= 0.08 QUALIFY place <= 6),
b2 AS (SELECT item_id, s, 'Likely match' AS bucket, row_number() OVER (ORDER BY s DESC, item_id) AS place FROM un WHERE s >= 0.35::DOUBLE + 0.15::DOUBLE AND item_id NOT IN (SELECT item_id FROM b1) QUALIFY place <= 6),
b3 AS (SELECT item_id, s, 'Likely false positive' AS bucket, row_number() OVER (ORDER BY s, item_id) AS place FROM un WHERE s BETWEEN 0.35 AND 0.5 AND item_id NOT IN (SELECT item_id FROM b1 UNION ALL SELECT item_id FROM b2) QUALIFY place <= 6),
b4 AS (SELECT item_id, s, 'Likely false negative' AS bucket, row_number() OVER (ORDER BY s DESC, item_id) AS place FROM un WHERE s >= 0.2 AND s < 0.35 AND item_id NOT IN (SELECT item_id FROM b1 UNION ALL SELECT item_id FROM b2 UNION ALL SELECT item_id FROM b3) QUALIFY place <= 6),
b5 AS (SELECT item_id, s, 'Uncertain' AS bucket, row_number() OVER (ORDER BY abs(s - 0.35), s, item_id) AS place FROM un WHERE item_id NOT IN (SELECT item_id FROM b1 UNION ALL SELECT item_id FROM b2 UNION ALL SELECT item_id FROM b3 UNION ALL SELECT item_id FROM b4) QUALIFY place <= 6),
picked AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4 UNION ALL SELECT * FROM b5)
"""


@query(_BUCKETS + "SELECT item_id, round(s, 6) AS score, bucket, place::INTEGER AS place FROM picked")
def bucketed_sampling(spark, sf):
    return review.bucketed(_review(spark, sf), fx.labels(spark, sf), 0.35).withColumn("score", F.round("score", 6))


@query(_BUCKETS + "SELECT item_id, CASE WHEN l THEN list_position(['Likely match', 'Model disagrees', 'Likely false positive', 'Likely false negative', 'Uncertain'], bucket) ELSE list_position(['Model disagrees', 'Uncertain', 'Likely false positive', 'Likely false negative'], bucket) END::INTEGER - 1 AS turn FROM picked, (SELECT count(*) > 0 AS l FROM b2)")
def review_order(spark, sf):
    return review.in_review_order(review.bucketed(_review(spark, sf), fx.labels(spark, sf), 0.35)).select("item_id", "turn")


@query()
def diverse_top_k(spark, sf):
    rows = fx.shown(spark, sf).withColumn("band", tx.score_band(F.col("score")))
    return review.diverse(rows, "band", [F.desc("score")], 0.35)


@query(q.ITEMS + "SELECT item_id, round(abs(score - 0.35), 6) AS gap FROM shown WHERE abs(score - 0.35) <= 0.18 ORDER BY abs(score - 0.35), item_id LIMIT 400")
def refine_band(spark, sf):
    return refine.refine_band(fx.shown(spark, sf), fx.POLICY).select("item_id", r6("gap", "gap"))


@query(q.ITEMS + "SELECT item_id, abs(score - 0.35) <= 0.18 AS in_band FROM shown WHERE abs(score - 0.35) <= 0.18 OR abs(e_exclude - 0.3) <= 0.18 * 0.65 OR abs(e_clear - 0.25) <= 0.18 * 0.65 ORDER BY in_band DESC, abs(score - 0.35), item_id LIMIT 400")
def adjudication_band(spark, sf):
    return refine.adjudication_band(fx.shown(spark, sf), fx.POLICY).select("item_id", "in_band")


def _verdicts(spark, sf):
    e = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("item_id")).agg((F.round(F.avg("value"), 3) / 100).alias("score"), (F.max("event_id") % 10 == 0).alias("flag"))
    return e


_V = ", ver AS (SELECT user_id AS item_id, round(avg(value), 3) / 100 AS s2, max(event_id) % 10 = 0 AS flag FROM events GROUP BY user_id)"


@query(q.ITEMS + _V + " SELECT item_id, round(CASE WHEN s2 IS NULL THEN score ELSE 0.35 * score + 0.65 * s2 END, 5) AS score FROM shown LEFT JOIN ver USING (item_id) WHERE NOT coalesce(flag, false)")
def refine_blend(spark, sf):
    both = refine.with_second(fx.evaluated(spark, sf).drop("score"), _verdicts(spark, sf), fx.POLICY)
    return cascade.visible(both, fx.POLICY).select("item_id", F.round("base", 5).alias("score"))


@query(q.ITEMS + """, vx AS (SELECT user_id AS item_id, 0.5 + (user_id % 7) / 20.0 AS a0, 0.9 AS a1, (user_id % 10) / 15.0 AS a2, 0.7 AS a3, 0.5 + (user_id % 11) / 22.0 AS a4, NULL::INTEGER AS anchors FROM events GROUP BY user_id),
wide2 AS (SELECT *, 0.5 AS a5, 0.5 AS a6, 0.5 AS a7, 0.5 AS a8, 0.5 AS a9 FROM vx) """ + "SELECT item_id, round(score, 6) AS score FROM (" + q.GATED.replace("FROM wide)", "FROM wide2)") + ") WHERE NOT excluded")
def adjudicate_score(spark, sf):
    u = F.col("item_id")
    rows = fx.table(spark, sf, "events").select(F.col("user_id").alias("item_id")).distinct()
    half = F.lit(0.5)
    values = {"0": 0.5 + (u % 7) / 20, "1": F.lit(0.9), "2": (u % 10) / 15, "3": F.lit(0.7), "4": 0.5 + (u % 11) / 22, **{str(k): half for k in range(5, 10)}}
    rows = rows.withColumns({"axes": F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), "anchors": F.lit(None).cast("int")})
    reg = axes.Registry.declared(fx.ROLES, fx.WEIGHTS)
    out = cascade.evaluate(axes.role_scores(rows, reg), fx.POLICY, reg)
    return cascade.visible(out, fx.POLICY).select("item_id", r6("base", "score"))


@query(q.INVENTORY + ", c AS (SELECT DISTINCT content_hash FROM before_ WHERE doc_id % 2 = 0) SELECT path, content_hash IN (SELECT content_hash FROM c) AS cached FROM inv")
def join_verdicts(spark, sf):
    add = {"model": F.lit("m"), "prompt_version": F.lit("1")}
    rows = fx.inventory(spark, sf).withColumns(add)
    cached = fx.inventory_before(spark, sf).where("doc_id % 2 = 0").select("content_hash").distinct().withColumns(add)
    have, lack = refine.join_verdicts(rows, cached)
    return have.select("path", F.lit(True).alias("cached")).unionByName(lack.select("path", F.lit(False).alias("cached")))


# Sinks --------------------------------------------------------------------------------------------------------

def _written(rows: DataFrame, form: str, by: list[str] | None = None, sf: str | None = None) -> DataFrame:
    """rows as a sink has written them, read again; with sf through the sink of items, whose gate evaluates them."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    if sf is None:
        export.write_table(rows, path, form, by)
    else:
        export.write_items(rows, fx.evaluated(spark, sf), fx.POLICY, path, form, by)
    return spark.read.schema(rows.schema).option("header", True).format(form).load(path)


@query(q.ITEMS + "SELECT item_id, round(score, 6) AS score, CASE WHEN score >= 0.35 THEN 'match' ELSE 'no_match' END AS decision FROM shown")
def write_decisions(spark, sf):
    """The sink is handed all evaluated rows, excluded ones too, and writes the visible ones."""
    every = export.decisions(fx.evaluated(spark, sf), 0.35).withColumn("score", F.round("score", 6))
    return _written(every, "parquet", sf=sf)


@query("SELECT doc_id AS item_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'no content' WHEN n_chars < 40 THEN 'too short' ELSE 'a line without end' END AS reason FROM documents WHERE coalesce(trim(text), '') = '' OR n_chars < 40 OR (strpos(text, chr(10)) = 0 AND n_chars > 300)")
def write_rejects(spark, sf):
    rows = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", "n_chars")
    text = F.coalesce(F.trim("text"), F.lit(""))
    faults = {"no content": text == "", "too short": F.col("n_chars") < 40, "a line without end": ~F.contains(F.col("text"), F.lit("\n")) & (F.col("n_chars") > 300)}
    return _written(export.rejects(rows, faults), "json")


@query(q.ITEMS + f"SELECT item_id, label_name || '/' || {q.band('score')} AS folder FROM shown")
def export_partitioned(spark, sf):
    folder = export.folders("score_band_label", F.col("label_name"), F.col("score"))
    rows = fx.shown(spark, sf).select("item_id", folder.alias("folder"), "label_name", tx.score_band(F.col("score")).alias("band"))
    out = _written(rows, "parquet", ["label_name", "band"], sf)
    return out.where("folder = concat(label_name, '/', band)").select("item_id", "folder")


@query(q.ITEMS + "SELECT name, round(score, 6) AS score, label_name FROM shown")
def export_csv(spark, sf):
    return _written(fx.shown(spark, sf).select("name", r6("score", "score"), "label_name"), "csv")


@query(q.ITEMS + "SELECT item_id, name, round(score, 6) AS score, stage, label_name FROM shown")
def export_json(spark, sf):
    return _written(fx.shown(spark, sf).select("item_id", "name", r6("score", "score"), "stage", "label_name"), "json")


@query(q.ITEMS + "SELECT item_id, replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS name, printf('%.3f', round(score, 10)) AS score_text, label_name, " + " || ', ' || ".join(f"'{k}=' || printf('%.3f', round(a{k}, 10))" for k in range(10)) + " AS axis_text FROM shown")
def report_rows(spark, sf):
    return export.report_rows(fx.shown(spark, sf), F.col("axes"))


def _manifest(spark, sf):
    d = fx.table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("item_id"), F.col("source").alias("folder"), F.concat("lang", F.lit(".txt")).alias("name"))
    there = rows.where("item_id % 50 = 0").select(F.concat_ws("/", "folder", "name").alias("destination")).distinct()
    return export.manifest(rows, there)


_MANIFEST = """WITH t AS (SELECT doc_id, source || '/' || lang AS stem, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS n, source || '/' || lang IN (SELECT source || '/' || lang FROM documents WHERE doc_id % 50 = 0) AS there FROM documents),
m AS (SELECT doc_id AS item_id, CASE WHEN n + there::INTEGER = 0 THEN stem || '.txt' ELSE stem || '_' || (n + there::INTEGER) || '.txt' END AS destination, n + there::INTEGER > 0 AS collision FROM t)
"""


@query(_MANIFEST + "SELECT item_id, destination, 'copy' AS action, collision, CASE WHEN collision THEN 'renamed' ELSE '' END AS reason FROM m")
def export_manifest(spark, sf):
    return _manifest(spark, sf)


@query(_MANIFEST + "SELECT 'copy' AS action, CASE WHEN collision THEN 'renamed' ELSE '' END AS reason, count(*) AS n FROM m GROUP BY ALL")
def export_result_counts(spark, sf):
    return export.result_counts(_manifest(spark, sf))


@query(q.ITEMS + "SELECT item_id, round(score, 6) AS score FROM shown WHERE item_id % 2 = 0")
def result_hook(spark, sf):
    everything = fx.items(spark, sf).withColumn("score", F.lit(1.0))

    def hook(rows):  # adds rows that aren't visible; they don't get through
        return rows.where("item_id % 2 = 0").select("item_id", "score").unionByName(everything.select("item_id", "score").join(rows.select("item_id"), "item_id", "left_anti"))

    return export.result_hook(fx.shown(spark, sf), hook).select("item_id", r6("score", "score"))
