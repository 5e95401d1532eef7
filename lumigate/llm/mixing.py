"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget goes down a tree of domain, language and source. At each node it is shared among the children
in proportion to their weights; a child gets no more than its subtree holds (its tokens times the epochs
allowed), and what it can't take goes to its siblings, in proportion to their weights, before any of it
would reach an ancestor: a node's own share was already held to what its subtree has. Filling to a common
level is exact in one window over the children sorted by tokens for each unit of weight.

Each leaf then takes whole passes over its documents and, for the rest of its share, the prefix of one more
pass in that pass's seeded order: as long as the tokens so far stay within the share. The order is an md5 of
seed, epoch and doc_id cut into BUCKETS ranges; sums by range find the range where the share ends, and only
that range's rows are sorted, so no leaf is ever gathered in one task.

Nulls and edges: a null domain, language or source is a leaf of its own, a null or empty text has 0 tokens
and is taken with its place in the order, a weight that is missing, null or not above 0 takes nothing, rows with
equal doc_id are ordered by their text, and identical rows are interchangeable. Other columns stay, whatever their names; `mix` puts
its own domain, n_tokens and epoch in place of columns with these names, and `chosen` keeps those too, in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigate.llm.base import apart, forget, stored, table

LEVELS = ("domain", "lang", "source")
#: 3 hexadecimal digits of the order's md5.
BUCKETS = 4096
#: Leaves under this count are broadcast (about 100 bytes each); beyond it Spark shuffles and splits skewed leaves.
BROADCAST_LEAVES = 100_000
SEED = "mix-1"

# The production targets of the query: fixed weights by level; what isn't listed has the default.
DOMAIN_WEIGHTS = {"web": 5.0, "books": 3.0, "code": 2.0}
LANG_WEIGHTS = {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}
SHARE = 0.5


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def domain_of(source: Column) -> Column:
    """The domain that a source name belongs to, by its trailing number: 0-9 web, 10-15 books, others code."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1).try_cast("int")
    return F.when(n < 10, "web").when(n < 16, "books").otherwise("code")


def weight_of(name: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Share each parent's `budget` among its rows of children (capacity, weight), as column out.

    Below a common level each child has its whole capacity, above it the level times its weight.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    rows = children.where(F.col("weight") > 0).withColumn("_r", ratio)
    by = Window.partitionBy(*parent)
    before = by.orderBy("_r", *[c for c in LEVELS if c in children.columns]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_full", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("double")).withColumn("_w", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col(budget) - F.col("_full")) / F.col("_w")
    # the first child that is not full sets the level: before it all are full, and after it this quotient only falls
    rows = rows.withColumn("_level", F.max(F.when(level <= F.col("_r"), level)).over(by))
    share = F.when(F.col("_level").isNull(), F.col("capacity").cast("double")).otherwise(F.least(F.col("capacity").cast("double"), F.greatest(F.col("_level"), F.lit(0.0)) * F.col("weight")))
    return rows.withColumn(out, share).drop("_r", "_full", "_w", "_level")


def budgets(leaves: DataFrame, total: Column, epochs: int) -> DataFrame:
    """domain, lang, source, tokens and share (whole tokens) of leaves that have domain_weight, lang_weight and source_weight."""
    of = leaves.withColumn("capacity", F.col("tokens") * epochs)
    top = of.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("domain_weight").alias("weight")).withColumn("_all", F.lit(0)).join(F.broadcast(of.agg(total.alias("_b0"))))
    one = fill(top, ["_all"], "_b0", "_b1").select("domain", "_b1")
    langs = of.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("lang_weight").alias("weight"))
    two = fill(langs.join(one, langs["domain"].eqNullSafe(one["domain"])).drop(one["domain"]), ["domain"], "_b1", "_b2").select("domain", "lang", "_b2")
    last = of.withColumn("weight", F.col("source_weight"))
    last = last.join(two, last["domain"].eqNullSafe(two["domain"]) & last["lang"].eqNullSafe(two["lang"])).drop(two["domain"]).drop(two["lang"])
    return fill(last, ["domain", "lang"], "_b2", "_b3").select(*LEVELS, "tokens", F.floor(F.col("_b3") + 1e-6).cast("long").alias("share"))


def order_key(epoch: Column, seed: str, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def chosen(docs: DataFrame, total: Column | None = None, epochs: int = 2, seed: str = SEED, domain: Column | None = None, source_weight: Column | None = None) -> DataFrame:
    """row (a struct of the columns of docs), domain, n_tokens and epoch: each row once for each epoch that the budget takes it in.

    total is an aggregate over the leaves that gives the budget; by default SHARE of all tokens. One pass over the texts leaves a table of
    what the budget needs of each row (levels, doc_id, tokens), and the plan is stored as one row a leaf; the
    second pass takes rows of docs against that plan without a shuffle, but for the rows of the one range where a leaf's share ends.
    """
    total = F.floor(F.sum("tokens") * SHARE).cast("double") if total is None else total
    domain = domain_of(F.col("source")) if domain is None else domain
    sized = stored(docs.select(domain.alias("domain"), "lang", "source", "doc_id", n_tokens(F.col("text")).alias("n_tokens")), "mixing-sizes")
    leaves = sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumns({
        "domain_weight": weight_of(F.col("domain"), DOMAIN_WEIGHTS, 1.0),
        "lang_weight": weight_of(F.col("lang"), LANG_WEIGHTS, 1.0),
        "source_weight": F.lit(1.0) if source_weight is None else source_weight,
    })
    shares = stored(budgets(stored(leaves, "mixing-leaves"), total, epochs).where("share > 0"), "mixing-shares")
    plan = shares.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.floor(F.col("share") / F.col("tokens")).cast("int").alias("_passes"), (F.col("share") % F.col("tokens")).alias("_rest"))
    few = shares.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES

    def dealt(rows: DataFrame, levels: list[Column], doc_id: Column, by: DataFrame) -> DataFrame:
        same = [x.eqNullSafe(F.col(f"_{c}")) for c, x in zip(LEVELS, levels, strict=True)]
        key = order_key(F.col("_passes"), seed, doc_id)
        return rows.join(F.broadcast(by) if few else by, same).withColumns({"_key": key, "_bucket": F.conv(F.substring(key, 1, 3), 16, 10).cast("int")})

    # where the last pass ends: sums by range of the order
    leaf = [f"_{c}" for c in LEVELS]
    sums = dealt(sized, [F.col(c) for c in LEVELS], F.col("doc_id"), plan).where("_rest > 0").groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("_n"), F.first("_rest").alias("_rest"))
    so_far = sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*leaf).orderBy("_bucket")))
    ends = so_far.where("_upto > _rest").groupBy(*leaf).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_end"))
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in leaf], F.col("_end._bucket").alias("_last"), F.col("_end._before").alias("_before"))
    # a leaf whose rest isn't reached by any range has no end, and then takes no prefix
    plan = plan.join(ends, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in leaf], "left").select(*leaf, "_passes", "_rest", "_last", "_before")
    plan = stored(plan, "mixing-plan")
    forget(sized)
    rows = docs.select(F.struct(*docs.columns).alias("row"), domain.alias("domain"))
    every = dealt(rows, [F.col("domain"), F.col("row.lang"), F.col("row.source")], F.col("row.doc_id"), plan)
    text = F.col("row.text")
    in_prefix = (F.col("_rest") > 0) & (F.col("_bucket") < F.col("_last"))
    n_passes = F.col("_passes") + F.coalesce(in_prefix, F.lit(False)).cast("int")
    whole = every.where(n_passes > 0).select("row", "domain", n_tokens(text).alias("n_tokens"), F.explode(F.sequence(F.lit(0), n_passes - 1)).alias("epoch"))
    edge = every.where("_rest > 0 and _bucket = _last").withColumn("n_tokens", n_tokens(text))
    order = Window.partitionBy(*leaf).orderBy("_key", F.md5(F.coalesce(text, F.lit("")))).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_upto", F.sum("n_tokens").over(order) + F.col("_before")).where("_upto <= _rest").select("row", "domain", "n_tokens", F.col("_passes").alias("epoch"))
    return whole.unionByName(edge)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows that `chosen` takes, with domain, n_tokens and epoch in place of columns with these names."""
    return chosen(docs, **options).select(*[F.col("row").getField(c).alias(c) for c in apart(docs, {"domain", "n_tokens", "epoch"})], "domain", "n_tokens", "epoch")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "domain", "lang", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"))


def _case(name: str, weights: dict[str, float]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END"


def _fill_sql(rows: str, parent: str, budget: str, order: str) -> str:
    """The same filling in SQL: rows has capacity, weight and the budget."""
    return f"""(SELECT *, CASE WHEN lvl IS NULL THEN capacity::DOUBLE ELSE least(capacity::DOUBLE, greatest(lvl, 0) * weight) END AS got FROM (
      SELECT *, max(CASE WHEN ({budget} - before_c) / rest_w <= capacity / weight THEN ({budget} - before_c) / rest_w END) OVER (PARTITION BY {parent}) AS lvl FROM (
        SELECT *, coalesce(sum(capacity) OVER b, 0)::DOUBLE AS before_c, sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0.0) AS rest_w
        FROM {rows} WINDOW b AS (PARTITION BY {parent} ORDER BY capacity / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))"""


def mixing_sql(docs: str = "documents", epochs: int = 2, columns: str = "doc_id, domain, lang, source, n_tokens, epoch") -> str:
    """The query in SQL over a table or subquery with the columns of documents."""
    key = f"md5(concat_ws('|', '{SEED}', p.passes::VARCHAR, d.doc_id::VARCHAR))"
    return f"""WITH rows_ AS (
      SELECT *, CASE WHEN n < 10 THEN 'web' WHEN n < 16 THEN 'books' ELSE 'code' END AS domain FROM (
        SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_tokens, try_cast(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM {docs})),
    leaves AS (SELECT domain, lang, source, (sum(n_tokens) * {epochs})::BIGINT AS capacity, sum(n_tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
    d1 AS (SELECT domain, 0 AS top, sum(capacity) AS capacity, {_case("domain", DOMAIN_WEIGHTS)}::DOUBLE AS weight, floor((SELECT sum(tokens) FROM leaves) * {SHARE})::DOUBLE AS b FROM leaves GROUP BY domain),
    f1 AS (SELECT domain, got FROM {_fill_sql("d1", "top", "b", "domain")}),
    d2 AS (SELECT l.domain, l.lang, sum(capacity) AS capacity, {_case("l.lang", LANG_WEIGHTS)}::DOUBLE AS weight, any_value(f1.got) AS b FROM leaves l JOIN f1 USING (domain) GROUP BY l.domain, l.lang),
    f2 AS (SELECT domain, lang, got FROM {_fill_sql("d2", "domain", "b", "lang")}),
    d3 AS (SELECT l.*, 1.0::DOUBLE AS weight, f2.got AS b FROM leaves l JOIN f2 USING (domain, lang)),
    plan AS (SELECT domain, lang, source, share // tokens AS passes, share % tokens AS rest FROM (SELECT *, floor(got + 1e-6)::BIGINT AS share FROM {_fill_sql("d3", "domain, lang", "b", "source")}) WHERE share > 0),
    dealt AS (SELECT d.*, p.passes, p.rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY {key}, md5(text) ROWS UNBOUNDED PRECEDING) AS upto FROM rows_ d JOIN plan p USING (domain, lang, source)),
    taken AS (SELECT *, unnest(range(passes))::INTEGER AS epoch FROM dealt UNION ALL SELECT *, passes::INTEGER FROM dealt WHERE rest > 0 AND upto <= rest)
    SELECT {columns} FROM taken"""
