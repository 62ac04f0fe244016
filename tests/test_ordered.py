"""Ordered group calculations against pandas, with one plan for groups of all sizes."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartwheel.functions import ordered
from cartwheel.functions.ordered import in_cells, running, top_per_group
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds 40% of the rows, with a long run of equal leading values."""
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n))
    frame = pd.DataFrame({"k": key, "a": rng.integers(0, 12, n), "b": rng.permutation(n), "v": rng.integers(0, 9, n)})
    df = spark.createDataFrame(frame).repartition(5).cache()
    return frame, df


def expected(frame, keys):
    f = frame.sort_values([*keys, "a", "b"]).reset_index(drop=True)
    g = f.groupby(keys) if keys else f.assign(_=0).groupby("_")
    f["n"] = g.cumcount() + 1
    f["s"] = g["v"].cumsum()
    f["t"] = g["v"].transform("sum")
    f["p"] = g["b"].shift(1)
    return sorted(
        tuple(None if pd.isna(x) else int(x) for x in r)
        for r in f[["k", "a", "b", "n", "s", "t"]].itertuples(index=False)
    ), {int(b): (None if pd.isna(p) else int(p)) for b, p in zip(f["b"], f["p"])}


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("per_partition", [1, 4, 40])
def test_running_matches_pandas(skewed, keys, per_partition, monkeypatch):
    frame, df = skewed
    monkeypatch.setattr(ordered, "CELLS_PER_PARTITION", per_partition)
    out = running(df, keys, ["a", "b"], number="n", sums={"s": "v"}, totals={"t": "v"}, prev={"p": "b"})
    want, prev = expected(frame, keys)
    assert sorted(rows(out, "k", "a", "b", "n", "s", "t")) == want
    assert {r.b: r.p for r in out.select("b", "p").collect()} == prev


def test_null_keys_are_a_group(spark):
    df = spark.range(400).select(F.when(F.col("id") % 3 == 0, F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    got = running(df, ["k"], ["a"], number="n", totals={"t": F.lit(1)})
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("a")).cast("long"))
    assert rows(got, "k", "a", "n") == rows(want, "k", "a", "n")


def test_a_hot_key_is_dealt_to_many_cells(skewed, monkeypatch):
    _, df = skewed
    monkeypatch.setattr(ordered, "CELLS_PER_PARTITION", 4)
    dealt = in_cells(df, ["k"], ["a", "b"])
    sizes = dealt.where("k = 0").groupBy("_cell").count().collect()
    assert len(sizes) >= 5 and max(r["count"] for r in sizes) < 0.5 * df.where("k = 0").count()
    assert dealt.where("_first").count() == dealt.select("_cell").distinct().count() <= ordered.cell_count(df)


def test_cells_are_in_order_and_copies_stay_together(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("k"), F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("a")
    )
    ends = in_cells(df, ["k"], ["a"]).groupBy("_cell").agg(F.min("a").alias("low"), F.max("a").alias("high")).orderBy("_cell").collect()
    assert len(ends) > 1 and all(a.high < b.low for a, b in zip(ends, ends[1:]))


def test_a_group_over_all_cells_and_groups_between(spark, small_cells):
    """One key from the first cell to the last, keys that begin with a cell, and a key in the middle of one."""
    df = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit(0)).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("a"))
    got = running(df, ["k"], ["a"], number="n", sums={"s": F.lit(1)}, totals={"t": F.lit(1)}, prev={"p": "a"})
    w = Window.partitionBy("k").orderBy("a")
    want = df.select(
        "k", "a", F.row_number().over(w).cast("long").alias("n"), F.row_number().over(w).cast("long").alias("s"),
        F.count("*").over(Window.partitionBy("k")).alias("t"), F.lag("a").over(w).alias("p"),
    )
    assert rows(got, "k", "a", "n", "s", "t", "p") == rows(want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long, a long")
    assert running(df, ["k"], ["a"], number="n").count() == 0


def test_a_third_in_one_key_costs_little_more_than_a_window(spark):
    df = spark.range(1_000_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100_000).alias("k"), F.col("id").alias("a")
    )

    def seconds(make):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    window = Window.partitionBy("k").orderBy("a")
    plain = min(seconds(lambda: df.withColumn("n", F.row_number().over(window))) for _ in range(2))
    cells = min(seconds(lambda: running(df, ["k"], ["a"], number="n")) for _ in range(2))
    print(f"window {plain:.1f} s, cells {cells:.1f} s")
    assert cells < 4 * plain + 5


def test_no_plan_pairs_all_rows(skewed):
    _, df = skewed
    for keys in ([], ["k"]):
        out = running(df, keys, ["a", "b"], number="n", prev={"p": "b"})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_per_group(skewed):
    frame, df = skewed
    want = frame.sort_values(["k", "b"]).groupby("k").head(3)
    got = top_per_group(df, ["k"], ["b"], 3)
    assert rows(got, "k", "b") == sorted(((int(k), int(b)) for k, b in zip(want.k, want.b)), key=repr)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_among_first_matches_numbering(spark, small_cells, keys):
    """Quotas that end inside a bucket, take everything or nothing, also in a group without a key."""
    df = spark.range(3000).selectExpr("nullif(int(id % 3), 2) AS k", "pmod(xxhash64(id), 97) AS a", "id AS b")
    quota = F.least(F.lit(0.37) * F.col("_size"), F.lit(700)).cast("int") if keys else F.lit(1234)
    told = ordered.among_first(df, keys, ["a", "b"], (F.col("a") / 8).cast("int"), quota, "first").toPandas()
    assert len(told) == 3000
    for _, rows in told.groupby("k", dropna=False) if keys else [(0, told)]:
        want = int(min(0.37 * len(rows), 700)) if keys else 1234
        assert list(rows.sort_values(["a", "b"])["first"]) == [True] * want + [False] * (len(rows) - want)
    for limit, n in ((0, 0), (10_000, 3000)):
        assert ordered.among_first(df, [], ["a", "b"], F.col("a"), F.lit(limit), "first").where("first").count() == n
