"""The masks cover every way in which an overlap's words may differ, and items of any length are found."""

from itertools import combinations

import numpy as np

from lumigate.llm.decontaminate import LEAST, LONG, MASKS, SHORT, WINDOW, decontaminate, serves


def gaps_of(n):
    """All ways to put the most substitutions that an item of n words may have."""
    least = -(-min(n, WINDOW) * LEAST // WINDOW)
    return list(combinations(range(n), n - least))


def test_every_overlap_leaves_a_mask_free():
    for n in range(1, WINDOW + 1):
        masks = [m for m in (*SHORT, *MASKS) if serves(m, n)]
        for gaps in gaps_of(n):
            assert any(all(s + i not in gaps for i, bit in enumerate(m) if bit == "1") for m in masks for s in range(n - len(m) + 1)), (n, gaps)
    assert len(gaps_of(WINDOW)) == 286 and all(m.startswith("11") for m in (*SHORT, *MASKS) if m != "1") and LONG <= WINDOW


def test_every_pattern_of_substitutions_and_short_items_are_found(spark):
    rnd = np.random.default_rng(7)
    word = (f"x{i}" for i in range(10**6))
    items = {n: [next(word) for _ in range(n)] for n in range(1, WINDOW + 1)} | {40: [next(word) for _ in range(40)]}
    docs, bad = [], {}

    def put(words, n, hit):
        body = [next(word) for _ in range(6)]
        at = int(rnd.integers(0, 7))
        bad[len(docs)] = n if hit else None
        docs.append((len(docs), " ".join(body[:at] + words + body[at:])))

    for n in range(1, WINDOW + 1):
        for gaps in gaps_of(n):
            put([next(word) if k in gaps else w for k, w in enumerate(items[n])], n, True)
        more = {*gaps_of(n)[0], n - 1}
        put([next(word) if k in more else w for k, w in enumerate(items[n])], n, False)
    put([next(word) if k % 4 == 3 else w for k, w in enumerate(items[40])], 40, True)
    docs += [(len(docs), None), (len(docs) + 1, "")]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()] + [(50, ""), (51, None)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    assert len(out) == len(docs)
    assert [i for i, n in bad.items() if out[i].contaminated != (n is not None) or out[i].n_items != (n is not None)] == []
    only = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench.where("item_id = 1"))
    assert [r.doc_id for r in only.where("contaminated").collect()] == [i for i, n in bad.items() if n == 1]
