"""Planted passages, exact and with substituted words, against clean documents."""

import numpy as np

from lumigate.llm.decontaminate import decontaminate


def test_planted_passages(spark):
    rnd = np.random.default_rng(5)
    vocab = [f"word{i}" for i in range(300)]

    def prose(n):
        return list(rnd.choice(vocab, n))

    items = [prose(n) for n in (15, 20, 30, 59, 9)]
    docs, bad = [], set()
    for i in range(120):
        body = prose(80)
        if i % 4 == 0:
            item = list(items[(i // 4) % 5])
            if i % 8 == 0 and len(item) > 9:
                for k in range(4, len(item), 7):
                    item[k] = "other"
            body[20:20] = item
            bad.add(i)
        docs.append((i, " ".join(body), "c"))
    docs += [(200, None, "c"), (201, "", "c"), (202, "of the", "c"), (203, "long " * 30_000, "c"), (0, docs[0][1], "c"), (None, " ".join(items[2]), "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_items string")
    bench = spark.createDataFrame([*[(i, " ".join(t).upper() + ".") for i, t in enumerate(items)], (9, None), (10, ""), (11, "too short"), (0, " ".join(items[0]).upper() + ".")], "item_id long, text string")
    out = decontaminate(frame, bench).collect()
    assert len(out) == len(docs)
    assert {r.doc_id for r in out if r.contaminated} == bad | {None}
    assert decontaminate(frame, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(frame.limit(0), bench).count() == 0
