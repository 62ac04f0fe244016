"""Quantile scores and ranks: hand-made cases and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cartwheel.functions import ordered
from cartwheel.functions.quantile import (
    add_scores, average_pct_rank, dense_codes, quantile_edges, quantile_of, rank_first_score, ranked_counts,
)


def frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, x double")


def by_id(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_tied_edges_are_compressed(spark):
    df = frame(spark, [1.0, 1, 1, 2, 2, 3, 4, 5, 6, 10])
    out = add_scores(df, 5, {"up": ("x", False), "down": ("x", True)})
    assert by_id(out, "up") == [1, 1, 1, 1, 1, 2, 3, 3, 4, 4]
    assert by_id(out, "down") == [4, 4, 4, 4, 4, 3, 2, 2, 1, 1]


def test_tied_edges_can_raise(spark):
    df = frame(spark, [1.0, 1, 1, 2, 2, 3, 4, 5, 6, 10])
    with pytest.raises(PySparkException):
        add_scores(df, 5, {"s": ("x", False)}, on_ties="raise").collect()


@pytest.mark.parametrize("seed", range(3))
def test_scores_match_qcut(spark, seed):
    x = np.random.default_rng(seed).normal(size=101).round(3)
    want = (pd.qcut(x, 5, labels=False, duplicates="drop") + 1).tolist()
    assert by_id(add_scores(frame(spark, x.tolist()), 5, {"s": ("x", False)}), "s") == want


def test_all_values_equal(spark):
    assert by_id(add_scores(frame(spark, [3.0] * 4), 5, {"s": ("x", False)}), "s") == [1] * 4


def test_rank_first_of_seven(spark):
    out = rank_first_score(frame(spark, [float(i) for i in range(7)]), "x", "id", 5, "s")
    assert by_id(out, "s") == [1, 1, 2, 3, 4, 5, 5]


def test_rank_first_of_one(spark):
    assert by_id(rank_first_score(frame(spark, [1.0]), "x", "id", 5, "s"), "s") == [1]


@pytest.mark.parametrize("cut", [False, True])
def test_rank_first_matches_qcut_of_ranks(spark, cut, monkeypatch):
    if cut:
        monkeypatch.setattr(ordered, "CELLS_PER_PARTITION", 40)
    x = np.random.default_rng(1).integers(0, 6, 333).astype(float)
    want = (pd.qcut(pd.Series(x).rank(method="first"), 5, labels=False) + 1).tolist()
    assert by_id(rank_first_score(frame(spark, x.tolist()), "x", "id", 5, "s"), "s") == want


def test_average_pct_rank(spark):
    out = average_pct_rank(frame(spark, [1.0, 2, 2, 3]), "x", "p")
    assert by_id(out, "p") == [0.25, 0.625, 0.625, 1.0]


def test_dense_codes(spark):
    df = spark.createDataFrame([(0, 5), (1, 2), (2, None), (3, 2)], "id long, c int")
    assert by_id(dense_codes(df, "c", "code"), "code") == [1, 0, -1, 0]


def test_mode_takes_the_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (1,), (3,)], "x int")
    assert df.agg(F.mode("x", True).alias("m")).first().m == 1


def test_quantiles_of_more_values_than_a_task_should_hold(spark, monkeypatch):
    """200,000 distinct values, in cells of some thousands each."""
    monkeypatch.setattr(ordered, "CELLS_PER_PARTITION", 16)
    df = spark.range(200_000).select(F.expr("cast(pmod(xxhash64(id), 1000000007) as double) / 7").alias("x"), F.col("id").alias("y"))
    row = quantile_edges(df, 7, {"a": "x", "b": "y"}).first()
    values = df.toPandas()
    shares = np.arange(8) / 7
    assert row.a == pytest.approx(np.quantile(values.x, shares), abs=1e-6)
    assert row.b == pytest.approx(np.quantile(values.y, shares), abs=1e-6)
    dealt = ordered.in_cells(df.select("x").distinct(), ["x"], []).groupBy("_cell").count().toPandas()["count"]
    assert len(dealt) == 64 and dealt.max() < 3 * 200_000 / 64
    plan = quantile_edges(df, 7, {"a": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles_per_group(spark, bounded):
    rows = pd.DataFrame({"k": np.arange(500) % 7, "x": np.random.default_rng(2).integers(0, 30, 500)})
    rows.loc[rows.k == 3, "x"] = 4
    ranked = ranked_counts(spark.createDataFrame(rows), ["k"], "x", bounded)
    got = ranked.groupBy("k").agg(*[quantile_of("x", s).alias(f"q{s}") for s in (0, 0.25, 0.5, 1)]).toPandas().set_index("k").sort_index()
    want = rows.groupby("k").x.quantile([0, 0.25, 0.5, 1]).unstack()
    assert np.allclose(got.values, want.values)


def test_no_values(spark):
    assert quantile_edges(spark.createDataFrame([(None,)], "x double"), 4, {"a": "x"}).first().a is None
