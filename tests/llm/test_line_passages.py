"""Planted passages of 1 to 6 lines between lines of their own: all of them go but their first places."""

import numpy as np
from pyspark.sql import functions as F

from lumigate.llm.line_dedup import dedup_lines, op3_line_dedup


def test_planted_passages_of_one_to_six_lines_go_whole(spark, tmp_path):
    rnd = np.random.default_rng(8)

    def prose(n):
        return " ".join(f"w{k}" for k in rnd.integers(0, 10**6, n))

    passages = [[prose(60) if n == 1 else prose(30) for _ in range(n)] for n in range(1, 7) for _ in range(5)]
    rows, want = [], {}
    for i in range(4 * len(passages)):
        own = [prose(8) for _ in range(rnd.integers(2, 9))]
        at, p = int(rnd.integers(0, len(own) + 1)), passages[i % len(passages)]
        rows.append((i, "\n".join(own[:at] + p + own[at:])))
        want[i] = rows[-1][1] if i < len(passages) else "\n".join(own)
    # one short line again isn't a passage, nor are blank lines and single characters, and a null or empty text stays what it is
    rows += [(900, "same\n" + prose(5)), (901, "same\n" + prose(6)), (902, None), (903, ""), (904, "a\na\na"), (905, "a\n\n\na\na\n}\n}"), (906, "}\n}\n\n\n")]
    want |= {i: t for i, t in rows[-7:]}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_line_dedup(spark, str(tmp_path))
    texts = spark.createDataFrame([(i, t or "") for i, t in want.items()], "doc_id long, t string").select("doc_id", F.sha2("t", 256).alias("h"))
    assert got.join(texts, "doc_id").where("h <> text_sha256").count() == 0


def test_passages_of_short_lines_over_fifty_words_go_nearly_whole(spark):
    """Lines of 1 to 8 words, where a boundary isn't sure: 99 of 100 passages lose all lines but blank ones, wherever they stand."""
    rnd = np.random.default_rng(3)

    def line(n):
        return " ".join(f"w{k}" for k in rnd.integers(0, 10**7, n))

    passages = [[line(n) for _ in range(51 // n + 1)] for n in range(1, 9) for _ in range(50)]
    rows = [(2 * i + k, "\n".join([line(5), *p, line(7)])) for i, p in enumerate(passages) for k in range(2)]
    out = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(out[2 * i] == 0 for i in range(len(passages)))
    whole = sum(out[2 * i + 1] == len(p) for i, p in enumerate(passages))
    assert whole >= 0.99 * len(passages), whole
