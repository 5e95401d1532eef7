"""Columns of the input with the operators' own names, and maps: results replace them, and the pipeline's stages keep them."""

import pytest
from pyspark.sql import functions as F

from lumigate.llm import ngram_blocks, ngram_join
from lumigate.llm.decontaminate import decontaminate
from lumigate.llm.decontaminate import judged as contaminated
from lumigate.llm.line_dedup import dedup_lines
from lumigate.llm.mixing import chosen, mix
from lumigate.llm.ngram_join import Join, one_of_each, similar_documents
from lumigate.llm.toxicity import judged as toxic
from lumigate.llm.toxicity import toxicity

NAMES = ["_key", "key", "epoch", "domain", "n_tokens", "lost", "row", "score", "predicted", "held_out", "contaminated", "n_items", "most_equal", "text_key", "hit", "part", "bits", "text_hash", "tok", "node", "_bucket", "_passes", "class", "n_lines"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"w{i} line\nanother {i} line of some words here\nshared line one\nshared line two" if i % 5 else None, "en", f"src{i % 3}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.select("*", *[F.lit(123.0).alias(c) for c in NAMES], F.create_map(F.lit("a"), "doc_id").alias("extra"))


def kept(rows, docs, replaced=()):
    names = [c for c in NAMES if c not in replaced]
    found = rows.collect()
    assert found and set(docs.columns) <= set(rows.columns) | set(replaced)
    assert all(r[c] == 123.0 for r in found for c in names) and all(r["extra"] == {"a": r["doc_id"]} for r in found)


def test_other_columns_stay(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "another 7 line of some words here shared line one")], "item_id long, text string")
    kept(mix(docs), docs, ("domain", "n_tokens", "epoch"))
    kept(chosen(docs).select("row.*"), docs)
    kept(toxicity(docs, labels), docs, ("score", "predicted", "held_out"))
    kept(toxic(docs, labels).select("row.*"), docs)
    kept(decontaminate(docs, bench), docs, ("contaminated", "n_items", "most_equal"))
    kept(contaminated(docs, bench).select("row.*"), docs)
    kept(dedup_lines(docs), docs, ("n_lines",))
    assert contaminated(docs, bench).where("contaminated").count() >= 1


def test_one_of_each_keeps_columns(docs):
    # maps can't be made distinct, so repeated rows with one are told apart by doc_id and text alone
    kept(one_of_each(docs, Join(3, 80)), docs)


def test_small_blocks_and_many_stars_give_the_components_of_all_pairs(spark, monkeypatch):
    from tests.llm.test_ngram_join import brute, corpus

    for module in (ngram_join, ngram_blocks):
        monkeypatch.setattr(module, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "OFTEN", 2)
    rows = corpus(9)
    got, _ = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Join(4, 70))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 4, 70)
