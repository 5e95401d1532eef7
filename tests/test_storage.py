"""Stored tables: deleted when told, and swept by age; other folders stay."""

import pytest

from lumigate.operators import storage
from lumigate.operators.storage import exists, forget, stored, sweep


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """A shared folder of this test's own, as sweeping takes what other tests have stored too."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    return f"file://{tmp_path}/shared"


def test_tables_are_forgotten_and_swept_by_age(spark, folder):
    one, two, none = (stored(spark.range(n), "swept") for n in (5, 3, 0))
    spark.range(1).write.parquet(f"{folder}/not-a-table")
    assert (one.count(), two.count(), none.count()) == (5, 3, 0)
    forget(one, none)
    assert not exists(spark, one._stored_at) and not exists(spark, none._stored_at)
    name = two._stored_at.rsplit("/", 1)[1]
    assert sweep(spark, 1) == [] and two.count() == 3
    assert sweep(spark, 0) == [name] and not exists(spark, two._stored_at)
    assert exists(spark, f"{folder}/not-a-table")


def test_sweep_without_any_table(spark, folder):
    assert sweep(spark, 0) == []
