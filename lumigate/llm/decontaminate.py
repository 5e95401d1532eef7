"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Fixed masks over the word sequence ignore some positions, so a seed still matches when the words under a
mask's gaps were substituted. However LEAST of a window's WINDOW words (or the same share of a shorter item's) lie, one
of the masks for its length has only equal words under its ones, so that no overlap is without a hit. Every mask but that of one
word begins with two ones, so a position whose first two words begin no
seed of the benchmark is left out at once, which loses nothing. Hashes of the benchmark's seeds meet those of the corpus in one join; each hit
gives a document, an item and the offset between them, and along that offset the two word sequences are
compared position by position: a window of WINDOW words with at least LEAST equal ones is an overlap.

The benchmark side is broadcast only if its seed count is under BROADCAST_SEEDS; beyond that Spark joins the
two sides by shuffling on the hash. A verdict depends on a document's words alone. Verdicts go back to the documents by a hash of the text,
broadcast if there are few enough.

Nulls and edges: a null or empty text is never contaminated; an item shorter than WINDOW is compared over its whole
length with the same share of equal words, which is all of them up to 4; items without a word match nothing; repeated
documents each get the verdict; other columns, of any type and name, stay (`judged` keeps even those named as the results).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.llm.base import BROADCAST_KEYS, apart, stored, table

#: Each 1 is a word that must be equal, each 0 one that may differ. Five words decide for items of 9 words or more.
MASKS = ("11111", "111011", "1101011", "11001011", "11110001")
#: The masks of shorter items, with the numbers of words that they serve.
SHORT = {"1": (1,), "11": (2,), "111": (3, 5), "1111": (4, 6, 7, 8), "11011": (5, 6, 7, 8)}
#: Items of so many words at most have one mask, which is all of the item; from LONG words on they have MASKS.
WHOLE, LONG = 4, 9
WINDOW = 13
LEAST = 10
#: 24 bytes a seed or less, and fewer pairs than seeds: about 100 MB at most are broadcast.
BROADCAST_SEEDS = 2_000_000
#: Items under this count are broadcast with their words.
BROADCAST_ITEMS = 50_000


def text_key(text: Column) -> Column:
    """A verdict depends on the text alone, so equal texts share one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: as a lambda's variable it isn't copied into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair(position: str) -> Column:
    """The hash of the word at a position and the next one, with which every mask begins."""
    return F.xxhash64("word", F.get("words", F.col(position) + 1))


def serves(mask: str, n: int) -> bool:
    """Whether items of n words are looked up by a mask."""
    return n in SHORT[mask] if mask in SHORT else n >= LONG


def seed(mask: str, position: str) -> Column:
    """The hash of the words under a mask's ones from a position on; null where the mask leaves the text."""
    on = [i for i, bit in enumerate(mask) if bit == "1"]
    inside = F.col(position) + len(mask) <= F.size("words")
    return F.when(inside, F.xxhash64(F.lit(mask), *[F.get("words", F.col(position) + k) for k in on]))


def seed_rows(df: DataFrame, keep: list[str], position: str, masks: list[str], pairs: DataFrame | None = None, item: bool = False) -> DataFrame:
    """keep, position and seed of masks at every position of df's column `words`; with pairs, only where those begin.

    Of items, only the masks that serve their length count.
    """
    at = df.select(*keep, "words", F.posexplode("words").alias(position, "word"))
    if pairs is not None:
        at = at.withColumn("pair", pair(position)).join(F.broadcast(pairs), "pair")
    size = F.least(F.size("words"), F.lit(LONG))
    seeds = [F.when(size.isin([n for n in range(1, LONG + 1) if serves(m, n)]), seed(m, position)) if item else seed(m, position) for m in masks]
    return at.select(*keep, position, F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def overlap(doc: Column, item: Column) -> Column:
    """The most equal words in a window of the item laid on as many words of a document (null where it has none)."""
    equal = F.zip_with(doc, item, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    width = F.least(F.lit(WINDOW), F.size(item))

    def best(e: Column) -> Column:
        return F.array_max(F.transform(F.sequence(F.lit(0), F.size(item) - width), lambda s: F.aggregate(F.slice(e, s + 1, width), F.lit(0), lambda a, x: a + x)))

    return let(equal, best)


def laid(words: Column, offset: Column, size: Column) -> Column:
    """The words of a document under an item of `size` words laid at an offset; null before its first word, missing after its last."""
    inside = F.slice(words, F.greatest(offset, F.lit(0)) + 1, F.greatest(F.lit(0), size + F.least(offset, F.lit(0))))
    return F.when(offset >= 0, inside).otherwise(F.concat(F.array_repeat(F.lit(None).cast("string"), -F.least(offset, F.lit(0))), inside))


def verdicts(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """text_key, n_items (benchmark items that the text overlaps) and most_equal (of WINDOW words) of the texts with any hit; stored.

    Hits carry only the words under the item, so no whole text is shuffled, and rows grow with hits: equal
    texts, and hits of several seeds at one offset, are one row from the map side on.
    """
    items = stored(benchmark.where(F.col("text").isNotNull()).select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).dropDuplicates(), "benchmark-items")
    sizes = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(LONG)).alias("n")).distinct().collect()]  # LONG numbers at most
    masks = [m for m in (*SHORT, *MASKS) if any(serves(m, n) for n in sizes)] or list(MASKS)
    keep = ["item_id", "whole", "size"]
    of_items = stored(seed_rows(items.select("item_id", "words", (F.size("words") <= WHOLE).alias("whole"), F.size("words").alias("size")), keep, "q", masks, item=True).dropDuplicates(), "benchmark-seeds")
    words_of = docs.select(text_key(F.col(text)).alias("text_key"), words(F.col(text)).alias("words"))
    pairs, rows = None, []
    if of_items.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        # a position can only start a seed if its first two words start one in the benchmark
        pairs = items.select("words", F.posexplode("words").alias("q", "word")).select(pair("q").alias("pair")).distinct()
        of_items = F.broadcast(of_items)
    if long := [m for m in masks if m != "1"]:
        rows.append(seed_rows(words_of, ["text_key", "words"], "p", long, pairs))
    if "1" in masks:
        rows.append(seed_rows(words_of, ["text_key", "words"], "p", ["1"]))
    offset = F.col("p") - F.col("q")
    met = reduce(DataFrame.unionByName, rows).join(of_items, "seed").select("text_key", "item_id", "whole", offset.alias("offset"), laid(F.col("words"), offset, F.col("size")).alias("doc"))
    # a seed that is all of the item tells as much at one place as at all of them
    hits = met.select("text_key", "item_id", F.when(~F.col("whole"), F.col("offset")).alias("at"), "doc").distinct()
    few = items.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    sides = hits.join(F.broadcast(items) if few else items, "item_id")
    real = F.col("n") * WINDOW >= F.least(F.col("size"), F.lit(WINDOW)) * LEAST
    of_item = sides.select("text_key", "item_id", F.size("words").alias("size"), overlap(F.col("doc"), F.col("words")).alias("n")).groupBy("text_key", "item_id").agg(F.max("n").alias("n"), F.max(real.cast("int")).alias("real"))
    found = of_item.groupBy("text_key").agg(F.sum("real").cast("long").alias("n_items"), F.max("n").cast("long").alias("most_equal"))
    return stored(found, "contaminated")


def judged(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of the columns of docs), contaminated (boolean), n_items and most_equal."""
    found = verdicts(docs, benchmark, text)
    few = found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col(text)).alias("text_key"))
    out = rows.join(F.broadcast(found) if few else found, "text_key", "left")
    n_items = F.coalesce("n_items", F.lit(0))
    return out.select("row", (n_items > 0).alias("contaminated"), n_items.alias("n_items"), F.coalesce("most_equal", F.lit(0)).alias("most_equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with contaminated, n_items and most_equal in place of columns with these names."""
    results = ["contaminated", "n_items", "most_equal"]
    return judged(docs, benchmark, text).select(*[F.col("row").getField(c).alias(c) for c in apart(docs, set(results))], *results)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "n_items", "most_equal")
