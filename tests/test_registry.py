"""Registered queries against DuckDB, and the shape of their plans."""

import duckdb
import pytest

from cartwheel.sources.retail import Star
from cartwheel.operators import rfm
from registry import QUERIES, oracle
from tests.conftest import SMALL, TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SQL = oracle()
TYPES = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
# Queries that go through ordered group calculations, repeated with tiny cells.
CUT = """w5_rank_first_scores w7_detailed_segments a4_orders_by_day c3_popular_candidates c7_stratified_split c10_popular_items
  i2_popularity_rank i7_category_codes j12_popular_not_bought m1_roc_auc m2_pr_auc m4_ranking_metrics q1_ordered_history
  q3_next_item_windows q8_transitions q8_next_item_scores x5_prefixed_interactions""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{TINY}/{name}.parquet'")
    return con


def text(row):
    return tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


def compare(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields} == kinds
    place = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in place) for r in relation.fetchall()), key=text)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=text)
    assert [text(r) for r in got] == [text(r) for r in want]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_its_sql(spark, duck, key):
    """Same rows as DuckDB, without pairing joins or Python workers in the plan."""
    df = QUERIES[key](spark, TINY)
    text_ = plan(df)
    for bad in ("CartesianProduct", "NestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
        assert bad not in text_ or key == "e13_external_model"
    compare(df, duck.sql(SQL[key]))


@pytest.mark.parametrize("key", CUT)
def test_query_with_cut_groups(spark, duck, small_cells, key, monkeypatch):
    from cartwheel import session

    monkeypatch.setattr(session, "_STAGED", {})
    compare(QUERIES[key](spark, TINY), duck.sql(SQL[key]))


def test_evaluation_sets_prune_partitions_and_columns(spark):
    text_ = plan(Star(spark, TINY, None).lines("prior").groupBy("product_id").count())
    assert "PartitionFilters: [isnotnull(eval_set" in text_
    assert "ReadSchema: struct<product_id:bigint>" in text_


def test_top_k_limits_before_the_shuffle(spark):
    text_ = plan(QUERIES["e4_top_k"](spark, TINY))
    assert "WindowGroupLimit" in text_ and "Partial" in text_


def test_known_answers_with_a_folded_catalogue(spark):
    """Published figures of the fixture: 100 products, sf0.01."""
    star = Star(spark, SMALL, 100)
    sets = {r.eval_set: r["count"] for r in star.orders.groupBy("eval_set").count().collect()}
    assert sets == {"prior": 13500, "train": 1350, "test": 150}
    lines = {r.eval_set: r["count"] for r in star.facts.groupBy("eval_set").count().collect()}
    assert lines == {"prior": 53019, "train": 5261, "test": 562}
    counts = {r.segment: r.n_users for r in rfm.segment_counts(rfm.segment_users(star.lines())).collect()}
    assert counts == {
        "Hibernating": 686, "Champions": 488, "About_to_Sleep": 116, "Loyal_Customers": 86,
        "Need_Attention": 61, "Promising": 34, "Potential_Loyalists": 29,
    }
    assert (star.products.count(), star.aisles.count(), star.departments.count()) == (100, 24, 6)
