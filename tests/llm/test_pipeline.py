"""The stages in a row against plain versions of each on planted cases."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from lumigate.llm.binary_output import END, encoder, tokenizer_path


def test_stages_against_plain_versions(spark, tmp_path):
    rnd = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(500)]
    item = list(rnd.choice(vocab, 30))
    rows, toxic, copies, leaks = [], set(), {}, set()
    for i in range(400):
        words = list(rnd.choice(vocab, 90))
        if i % 10 == 3:
            words[5:5] = ["vile", "scum", "vile"]
            toxic.add(i)
        elif i % 10 == 5 and i > 20:
            words = rows[i - 4][1].split()
            words[40] = "changed"
            copies[i] = i - 4
        elif i % 10 == 7:
            words[10:10] = item
            leaks.add(i)
        rows.append((i, " ".join(words), "en", f"src{i % 20}", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), set(range(400))
    columns = docs.columns
    for k, ((_, stage), gone) in enumerate(zip(corpus_pipeline.STAGES[:4], (toxic, set(copies), leaks, None), strict=True)):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = [r.doc_id for r in docs.collect()]
        assert len(got) == len(set(got))
        if gone is None:
            total = sum(len(rows[i][1].split()) for i in left)
            taken = sum(len(rows[i][1].split()) for i in got)
            assert set(got) < left and 0.45 * total < taken <= 0.5 * total
        else:
            assert set(got) == left - gone
        left = set(got)
    records = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    encode, by = encoder(tokenizer_path("byte_bpe_50k.tiktoken")), {}
    for r in sorted(records, key=lambda r: r.seq):
        by[r.doc_id] = by.get(r.doc_id, b"") + bytes(r.tokens)[: 2 * r.n_tokens]
    assert by == {i: np.array([*encode(rows[i][1]), END], np.uint16).tobytes() for i in left}
    assert sorted(r.slot for r in records) == list(range(len(records)))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(records)
