"""No query gives an excluded item, and no fit reads one."""

import os

import duckdb
import pytest

import lumigate.plans.sources  # noqa: F401  registers its queries
from lumigate.plans import fixtures as fx
from lumigate.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
#: item_id of these is a document, a frame of part, a user or an event; their rows aren't scored items.
OTHER_IDS = {
    "plan_regions", "anchored_regions", "fallback_bands", "clamp_box", "top_k_anchors", "oriented_size", "oriented_headers", "crop_regions", "parse_verdict", "verdict_in_prose", "export_manifest", "label_fold",
    "stream_label_fold", "pool_upsert", "pool_merge", "pool_prune", "pool_forget", "adjudicate_score", "read_labels", "write_rejects",
}
#: Columns that hold the id of a scored item, in any query that isn't among these.
IDS = {"item_id", "anchor", "similar_id"}
#: Slow, and without such a column.
LEFT_OUT = {"select_c", "fit_outcome", "region_embed", "embed_items"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def bad(spark):
    found = {r.item_id for r in fx.evaluated(spark, SF).where("excluded").select("item_id").collect()}
    assert len(found) > 100
    return found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER_IDS - LEFT_OUT))
def test_no_excluded_item_is_given(spark, bad, con, name):
    """Every registered query whose columns hold an item's id, whatever it is called. Its SQL tells the columns without a run."""
    if name in ORACLE_SQL and not IDS & set(con.sql(ORACLE_SQL[name]).columns):
        return
    out = QUERIES[name](spark, SF)
    ids = [c for c in out.columns if c in IDS]
    assert not ids or not bad & {x for r in out.select(*ids).distinct().collect() for x in r}


def test_no_fit_reads_an_excluded_item(spark, bad):
    got = {r.item_id for r in fx.training(spark, SF).select("item_id").collect()}
    assert got and not bad & got


def test_the_lists_name_queries():
    assert OTHER_IDS | LEFT_OUT <= set(QUERIES)
