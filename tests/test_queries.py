"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
NAMES = ["flagship", "stage_counts", "region_aggregate", "plan_regions", "parse_verdict", "label_fold", "policy_resolve", "snapshot_diff", "duplicate_remainder", "roc_auc", "average_precision", "training_signature", "export_manifest", "bucketed_sampling", "stream_label_fold"]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    num = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x
    return sorted(str([num(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_the_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert got and got == plain(want.fetchall(), want.columns)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
