"""The join against all pairs compared one by one."""

import re

import numpy as np

from lumigate.llm import ngram_join
from lumigate.llm.ngram_join import Join, similar_documents


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rnd = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = list(rnd.choice(vocab, 50))
    rows = []
    for g in range(40):
        base = list(rnd.choice(vocab, rnd.integers(20, 120)))
        if g % 4 == 0:
            base[5:5] = passage
        for _ in range(int(rnd.integers(1, 9))):
            w = list(base)
            for _ in range(int(rnd.integers(0, 6))):
                w[rnd.integers(0, len(w))] = "z" + str(rnd.integers(0, 10**6))
            rows.append(" ".join(w))
    # a chain: each a step from the last, the ends far apart
    chain = list(rnd.choice(vocab, 100))
    for _ in range(25):
        chain[rnd.integers(0, 100)] = "c" + str(rnd.integers(0, 10**6))
        rows.append("\n".join(chain))
    rows += ["", None, "  \t ", "one", "One", "one two", "é É", "É é", "x y z q", "x y z q r"]
    order = rnd.permutation(len(rows))
    return [(int(i), rows[j]) for i, j in enumerate(order)]


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    for seed, k, percent, often in ((1, 4, 85, 4), (3, 4, 60, 2)):
        monkeypatch.setattr(ngram_join, "OFTEN", often)
        rows = corpus(seed)
        got, _ = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Join(k, percent))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, k, percent)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, None), (None, "")], "doc_id long, text string")
    got = sorted(similar_documents(docs)[0].collect(), key=str)
    assert len(got) == 5 and sorted(str(r.component_id) for r in got) == ["7", "7", "7", "8", "None"]
    assert similar_documents(docs.limit(0))[0].count() == 0


def test_prefix_is_exact():
    for n in range(1, 200):
        assert Join(4, 85).prefix(n) == n - -(-85 * n // 100) + 1


def test_words_are_those_of_the_contract():
    import random

    import pyarrow as pa

    from lumigate.llm.shingling import shingle_sets

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aAbZ \t\n\x0b\x0c\r\x1cé\xa0日") for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [None, "x" * 3_000_000, "y z " * 700_000]
    sets = [s.tobytes() for s in shingle_sets(pa.array(texts).slice(1), 2)]
    plain = []
    for t in texts[1:]:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        plain.append(frozenset(tuple(w[j : j + 2]) for j in range(max(1, len(w) - 1))) if w else frozenset())
    assert [len(s) // 8 for s in sets] == [len(p) for p in plain]
    assert len(set(zip(sets, plain))) == len(set(sets)) == len(set(plain))
