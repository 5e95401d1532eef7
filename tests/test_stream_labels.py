"""The stateful fold of label events against the batch fold: late, repeated and clearing events, restarts, batches that run again."""

import numpy as np

from lumigate.operators import labels
from lumigate.streaming import labels as st

SCHEMA = "item_id long, label int, seq long"


def events(n, seed):
    rnd = np.random.default_rng(seed)
    rows = [(int(rnd.exponential(6)), [None, 0, 1, 2][rnd.integers(0, 4)], int(s)) for s in rnd.permutation(n)]
    return rows + rows[: n // 5] + [(None, 1, 5), (3, 1, None)]


def arrive(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{out}/{folder}")
    st.fold_labels(stream, f"{out}/changes", f"{out}/checkpoint").awaitTermination()


def rows_of(frame):
    return sorted((r.item_id, r.label) for r in frame.collect())


def test_late_repeated_and_clearing_events_and_restarts(spark, tmp_path):
    out, all_rows = f"file://{tmp_path}", events(400, 1)
    for part in range(3):  # seqs are shuffled over the parts, so every restart meets late events
        for half in range(2):
            arrive(spark, all_rows[part * 2 + half :: 6], f"{out}/in")
        run(spark, "in", out)
        seen = [r for p in range(part + 1) for h in range(2) for r in all_rows[p * 2 + h :: 6]]
        want = rows_of(labels.fold(spark.createDataFrame(seen, SCHEMA).where("item_id is not null and seq is not null")))
        assert rows_of(st.current(spark, f"{out}/checkpoint")) == want
    batches = sorted(p.name for p in (tmp_path / "changes").glob("batch=*"))
    assert len(batches) == 6
    run(spark, "in", out)  # nothing new: no batch runs
    assert sorted(p.name for p in (tmp_path / "changes").glob("batch=*")) == batches
    # each change is newer than those of earlier batches
    last = {}
    for r in st.changes(spark, f"{out}/changes").orderBy("batch").collect():
        assert st.order(r.seq, r.label) > last.get(r.item_id, (-1,))
        last[r.item_id] = st.order(r.seq, r.label)


def test_a_run_reads_new_files_only(spark, tmp_path):
    out = f"file://{tmp_path}"
    arrive(spark, [(1, 1, 10), (2, 0, 3)], f"{out}/in")
    run(spark, "in", out)
    for p in (tmp_path / "in").glob("*.parquet"):
        p.write_bytes(b"no longer a table")  # a second reading would fail
        (tmp_path / "in" / f".{p.name}.crc").unlink(missing_ok=True)
    arrive(spark, [(1, 0, 9), (2, None, 4), (3, 2, 1)], f"{out}/in")
    run(spark, "in", out)
    assert rows_of(st.current(spark, f"{out}/checkpoint")) == [(1, 1), (3, 2)]


def test_ties_go_to_the_larger_label_and_nulls_are_least():
    assert st.order(4, None) < st.order(4, 0) < st.order(4, 1) < st.order(5, None)
