"""The permutation, and an exact round trip of every text."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from lumigate.llm.binary_output import END, Layout, encoder, materialised, permuted, read_shards, tokenizer_path, write_shards


def test_permutation_is_a_bijection_that_the_key_changes():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        slots = permuted(np.arange(n), n, 7)
        assert sorted(slots) == list(range(n))
    assert list(permuted(np.arange(1000), 1000, 7)) != list(permuted(np.arange(1000), 1000, 8))


@pytest.fixture(scope="module")
def case(spark):
    texts = ["", None, "hello world", "x " * 3000, "<|endoftext|> is text", "é日😀 " * 50] + [f"doc {i} " * (i % 40) for i in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(2, "hello world", 1), (None, "no id", 1)]
    layout = Layout(length=64, per_shard=50)
    return rows, layout, spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(6)


def test_round_trip(case):
    rows, layout, docs = case
    records = materialised(docs, layout).collect()
    assert sorted(r.slot for r in records) == list(range(len(records)))
    assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 128 and len(r.tokens) == 128 for r in records)
    encode = encoder(tokenizer_path(layout.vocabulary))
    want = sorted(bytes(np.array([*encode(t or ""), END], np.uint16)) for _, t, _ in rows)
    by, got = {}, []
    for r in records:
        by.setdefault(r.doc_id, []).append(r)
    for i, part in by.items():
        part.sort(key=lambda r: r.seq)
        if i != 2:
            got.append(b"".join(bytes(r.tokens)[: 2 * r.n_tokens] for r in part))
        else:
            got += [bytes(r.tokens)[: 2 * r.n_tokens] for r in part]
    assert sorted(got) == want


def test_slots_depend_on_the_data_alone(case):
    _, layout, docs = case
    slots = [sorted((r.slot, str(r.doc_id), r.seq, bytes(r.tokens)) for r in materialised(d, layout).collect()) for d in (docs, docs.coalesce(1), docs.repartition(11, "text"))]
    assert slots[0] == slots[1] == slots[2]


def test_files_have_a_fixed_stride_and_writing_and_reading_resume(case, spark, tmp_path):
    _, layout, docs = case
    path, stride = tmp_path / "out", 128
    want = {r.slot: bytes(r.tokens) for r in materialised(docs, layout).collect()}
    first = {r.shard: r.n_records for r in write_shards(docs, str(path), layout).collect()}
    assert sum(first.values()) == len(want) and set(first) == set(range(-(-len(want) // 50)))
    files = {f.name: f.read_bytes() for f in path.glob("shard-*.bin")}
    assert b"".join(files[n] for n in sorted(files)) == b"".join(want[i] for i in range(len(want)))
    # a job that stopped: one shard is missing, one was cut short, a temporary file is left
    (path / "shard-00000001.bin").unlink()
    (path / "shard-00000003.bin").write_bytes(files["shard-00000003.bin"][:stride])
    (path / "_shard-00000001.bin-x").write_bytes(b"left")
    again = write_shards(docs.repartition(3), str(path), layout)
    assert {r.shard for r in again.collect()} == {1, 3}
    assert {f.name: f.read_bytes() for f in path.glob("shard-*.bin")} == files
    rest = {r.slot: bytes(r.tokens) for r in read_shards(spark, str(path), 120).collect()}
    assert rest == {i: t for i, t in want.items() if i >= 120}
    with pytest.raises(ValueError, match="other data"):
        write_shards(docs.limit(5), str(path), layout)


def test_shards_stay_few():
    assert Layout().of(10).per_shard == 4096 and Layout().of(32_768 * 4096 + 1).per_shard == 8192 and Layout(per_shard=7).of(10**9).per_shard == 7


def test_no_documents(case):
    _, layout, docs = case
    assert materialised(docs.limit(0), layout).count() == 0
