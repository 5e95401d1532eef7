"""Quality rules: fixed rules, then robust multivariate outliers by language and source, in DataFrame functions only.

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated windows of three).
A text of under MIN_WORDS words, or with more than half of its words in repeated windows, fails. The others' counts
become a vector of five transformed statistics, and each cell (a language and source) gets its minimum-covariance-
determinant estimate: from medians and median deviations on, STEPS concentration steps take the mean and covariance
of those HALF of the cell's rows that lie nearest by Mahalanobis distance under the last estimate. The last covariance is scaled
so that the cell's median squared distance is that of a normal vector, and rows beyond CUT are rejected.

Every row of a cell takes part in every step; no cell is gathered. Statistics are whole multiples of 1/SCALE, so sums of them
and of their products are exact and don't depend on the order of tasks; the nearest rows are found by counts in fixed logarithmic bins of
the distance, and whole bins are taken. What shuffles is one row for each cell and bin of a task, never a row of a text.

Nulls and edges: a null text has no words and fails; null languages and sources are cells of their own; a doc_id may be null or repeated, every row
gets a row. Cells of under MIN_ROWS passing rows are judged together with the other small ones of their language, and where these are too few,
with all such rows; where even those are under MIN_ROWS, nobody is an outlier. A statistic that hardly varies in a cell has FLOORS added to its
variance, so equal rows don't turn the rest into outliers. Columns of the input with the results' names are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigate.llm.base import apart, forget, stored, table

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MIN_ROWS = 50
#: Share of a cell's rows that an estimate rests on, at least.
HALF = 0.75
STEPS = 6
SCALE = 256
#: Bins of the squared distance: so many to a doubling, from 2**-LOW to 2**HIGH.
FINE, LOW, HIGH = 8, 8, 24
STATS = ("length", "word", "symbols", "lines", "windows")
P = len(STATS)
#: Least standard deviations: natural logarithms, the last three of 1 + parts in a hundred words.
FLOORS = (0.3, 0.1, 0.5, 1.0, 1.0)
#: Median of the squared length of a normal vector of P coordinates, and the 1 - 1e-6 quantile: fixed values of the chi-square law.
MEDIAN, CUT = 4.351, 35.888
#: Cells under this count are broadcast (about 300 bytes each); beyond it Spark shuffles and splits skewed cells.
BROADCAST_CELLS = 50_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = {*COUNTS, "base_failed", "distance", "cell", "kept"}
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def counted(docs: DataFrame, keep: Column) -> DataFrame:
    """_row (what keep gives) and the counts of each text. Arrays that a lambda indexes are columns of their own, made once a row."""
    text = F.coalesce("text", F.lit(""))
    inner = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    rows = docs.select(keep.alias("_row"), text.alias("_text"), F.when(F.length(inner) > 0, F.split(inner, SPACE + "+")).otherwise(none).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_words")
    at = lambda i: F.get("_codes", i)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"))
    rows = rows.select(
        "_row", "_codes", n.cast("long").alias("n_words"), F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("_lines"), starts.alias("_starts"),
        F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))).alias("_hashes"),
    )
    # texts whose windows all differ are done; in the others equal windows are neighbours once sorted, by 128 bits of their words' codes
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    window = lambda i: F.struct(F.get("_hashes", i).alias("a"), F.xxhash64(at(i + 2), at(i), at(i + 1)).alias("b"), i.alias("i"))
    ordered = F.sort_array(F.transform(F.when(some, F.col("_starts")).otherwise(F.array().cast("array<int>")), window))
    rows = rows.select("_row", *COUNTS[:3], (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), ordered.alias("_ordered"))
    like = lambda x, j: (F.get("_ordered", j)["a"] == x["a"]) & (F.get("_ordered", j)["b"] == x["b"])
    twice = F.filter("_ordered", lambda x, j: F.coalesce(like(x, j - 1), F.lit(False)) | F.coalesce(like(x, j + 1), F.lit(False)))
    begin = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), begin, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return rows.select("_row", *COUNTS[:4], covered.cast("long").alias("n_repeat_words"))


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistics() -> list[Column]:
    """The vector of a text that passes: whole multiples of 1/SCALE."""
    n = F.greatest("n_words", F.lit(1))
    share = lambda x: F.log1p(100 * F.col(x) / n)
    values = (F.log1p("n_words"), F.log1p(F.col("word_chars") / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words"))
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def cells(rows: DataFrame) -> DataFrame:
    """rows (lang, source, base_failed) with their cell: null where there are too few rows to judge by."""
    name = lambda level, *of: F.to_json(F.array(F.lit(level), *of))
    sums = rows.where("not base_failed").groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
    small = F.when(F.col("_n") < MIN_ROWS, F.col("_n"))
    sums = sums.withColumn("_by_lang", F.sum(small).over(Window.partitionBy("_lang")))
    every = sums.groupBy("_lang").agg(F.sum(small).alias("_s")).where(f"_s < {MIN_ROWS}").agg(F.sum("_s").alias("_rest"))
    own, of_lang = name("source", F.col("_lang"), F.col("_source")), name("lang", F.col("_lang"))
    cell = F.when(F.col("_n") >= MIN_ROWS, own).when(F.col("_by_lang") >= MIN_ROWS, of_lang).when(F.col("_rest") >= MIN_ROWS, name("all"))
    named = stored(sums.join(F.broadcast(every)).select("_lang", "_source", cell.alias("cell")), "quality-cells")  # every is one row
    few = named.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    out = rows.join(F.broadcast(named) if few else named, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    return out.withColumn("cell", F.when(~F.col("base_failed"), F.col("cell")))


def distance() -> Column:
    """Squared Mahalanobis distance under the row's estimate: `middle`, and `inverse` by rows of P, in units of 1/SCALE."""
    z = [f"(x{i} - middle[{i}])" for i in range(P)]
    return F.expr(" + ".join(f"{1 if i == j else 2} * inverse[{i * P + j}] * {z[i]} * {z[j]}" for i, j in PAIRS))


def bin_of(squared: Column) -> Column:
    held = F.least(F.greatest(squared, F.lit(2.0**-LOW)), F.lit(2.0**HIGH))
    return F.floor(F.log2(held) * FINE).cast("int")


def inverted(cov: dict[tuple[int, int], Column]) -> Column:
    """The inverse of cov plus the floors, by rows of P: every coordinate is swept once."""
    full = [cov[max(i, j), min(i, j)] + F.lit((FLOORS[i] * SCALE) ** 2 if i == j else 0.0) for i in range(P) for j in range(P)]

    def swept(m: Column, k: Column) -> Column:
        at = lambda i, j: F.get(m, i * P + j)

        def entry(t: Column) -> Column:
            i, j = F.floor(t / P).cast("int"), t % P
            pivot = at(k, k)
            return F.when((i == k) & (j == k), -1.0 / pivot).when((i == k) | (j == k), F.get(m, t) / pivot).otherwise(F.get(m, t) - at(i, k) * at(k, j) / pivot)

        return F.transform(F.sequence(F.lit(0), F.lit(P * P - 1)), entry)

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), F.array(*full), swept), lambda x: -x)


def reached(bins: DataFrame, share: float, out: str) -> DataFrame:
    """For each cell of bins (cell, bin, n) the first bin up to which there are share of its rows."""
    by = Window.partitionBy("cell")
    sums = bins.withColumns({"_upto": F.sum("n").over(by.orderBy("bin")), "_all": F.sum("n").over(by)})
    return sums.where(F.col("_upto") >= F.ceil(F.col("_all") * share)).groupBy("cell").agg(F.min("bin").alias(out))


def fit(rows: DataFrame) -> DataFrame:
    """The estimate of each cell of rows (cell, x0..), stored: middle, inverse, and the scale of its squared distances."""
    rows = rows.where("cell is not null").select("cell", *[f"x{i}" for i in range(P)])
    # values are whole and few, so exact percentiles need one count for each value
    middles = F.array(*[F.percentile(f"x{i}", 0.5) for i in range(P)])
    now = stored(rows.groupBy("cell").agg(middles.alias("middle")), "quality-middles")
    few = now.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    joined = lambda of: rows.join(F.broadcast(of) if few else of, "cell")
    spread = joined(now).groupBy("cell").agg(F.first("middle").alias("middle"), *[F.percentile(F.abs(F.col(f"x{i}") - F.col("middle")[i]), 0.5).alias(f"_d{i}") for i in range(P)])
    start = {(i, j): (1.4826 * F.col(f"_d{i}")) ** 2 if i == j else F.lit(0.0) for i, j in PAIRS}
    was, now = now, stored(spread.select("cell", "middle", inverted(start).alias("inverse")), "quality-start")
    forget(was)
    bins = lambda of: joined(of).groupBy("cell", bin_of(distance()).alias("bin")).agg(F.count("*").alias("n"))
    for _ in range(STEPS):
        near = now.join(reached(bins(now), HALF, "_last"), "cell")
        moments = [F.sum(f"x{i}").cast("double").alias(f"_s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).cast("double").alias(f"_p{i}{j}") for i, j in PAIRS]
        sums = joined(near).where(bin_of(distance()) <= F.col("_last")).groupBy("cell").agg(F.count("*").cast("double").alias("_n"), *moments)
        mean = [F.col(f"_s{i}") / F.col("_n") for i in range(P)]
        cov = {(i, j): F.col(f"_p{i}{j}") / F.col("_n") - mean[i] * mean[j] for i, j in PAIRS}
        was, now = now, stored(sums.select("cell", F.array(*mean).alias("middle"), inverted(cov).alias("inverse")), "quality-step")
        forget(was)
    # a covariance is not scaled below its floors: texts that all but agree have small distances, and no outliers for it
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("_half") + 0.5) / FINE) / MEDIAN, F.lit(1.0))
    out = stored(now.join(reached(bins(now), 0.5, "_half"), "cell").withColumn("scale", scale).drop("_half"), "quality-estimates")
    forget(now)
    return out


def judged(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows with distance (null without an estimate) and kept."""
    few = estimates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    out = rows.join(F.broadcast(estimates) if few else estimates, "cell", "left").withColumn("distance", F.sqrt(distance() / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(CUT), F.lit(True))
    return out.withColumn("kept", kept).drop(*estimates.columns[1:])


def quality(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (by default all but the text) with the counts, base_failed, cell, distance and kept."""
    names = [c for c in (carry or docs.columns) if c not in RESULTS and (carry or c != "text")]
    keep = F.struct(F.struct(*[F.col(c) for c in names]).alias("own"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = counted(docs.select(*apart(docs, RESULTS)), keep).withColumn("base_failed", failed())
    rows = stored(rows.select("_row.*", *COUNTS, "base_failed", *statistics()), "quality-counts")
    rows = cells(rows)
    out = judged(rows, fit(rows))
    return out.select("own.*", *COUNTS, "base_failed", "cell", "distance", "kept")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept", "cell", "distance")
