"""The query against a plain comparison of every item laid on every document at every offset."""

import re

import numpy as np

from lumigate.llm.decontaminate import op7_decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def best(doc, item):
    """The most equal words that any window of the item has on the document, at any offset."""
    width, most = min(13, len(item)), 0
    for offset in range(1 - len(item), len(doc)):
        equal = [0 <= k + offset < len(doc) and doc[k + offset] == w for k, w in enumerate(item)]
        most = max([most, *(sum(equal[s : s + width]) for s in range(len(item) - width + 1))])
    return most


def test_the_query_equals_a_comparison_of_all_positions(spark, tmp_path):
    rnd = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(40)]

    def prose(n):
        return list(rnd.choice(vocab, n))

    items = [prose(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 20, 33)]
    items[0] = ["rare"]
    docs = []
    for i in range(160):
        body, item = prose(int(rnd.integers(0, 50))), list(items[i % len(items)])
        for k in rnd.choice(len(item), min(len(item), i // 15 % 5), replace=False):
            item[k] = "other"
        at = int(rnd.choice([0, len(body) // 2, len(body)]))
        cut = item[int(rnd.integers(0, 4)) :] if i % 7 == 0 else item
        docs.append((i, (", " if i % 2 else " ").join(body[:at] + cut + body[at:])))
    docs += [(900, None), (901, ""), (902, "... !"), (903, "Rare"), (3, docs[3][1])]
    bench = [(k, " ".join(x).capitalize() + ".") for k, x in enumerate(items)] + [(90, None), (91, ""), (92, "?!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op7_decontaminate(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    text, real_ones = dict(docs), 0
    for r in got:
        doc = words(text[r.doc_id])
        most = [best(doc, x) for x in items]
        real = [n for n, x in zip(most, items, strict=True) if n * 13 >= min(13, len(x)) * 10]
        assert (r.contaminated, r.n_items) == (bool(real), len(real)), (r, most)
        assert max(real, default=0) <= r.most_equal <= max(most)
        real_ones += bool(real)
    assert 60 < real_ones < 160
