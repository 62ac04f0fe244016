"""Quantiles, quantile scores and ranks over whole tables.

Quantiles are picked from the counts of the distinct values, cumulated by an
ordered pass: no task holds the values of a column, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.ordered import running
from cartwheel.functions.scalar import beside, long

EDGE_DIGITS = 9


def ranked_counts(df: DataFrame, keys: Sequence[str], column: str, bounded: bool = False) -> DataFrame:
    """Distinct values of every group with ``_ties``, rows up to them (``_upto``) and of the group (``_total``).

    ``bounded=True`` says that a group has few distinct values by construction.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(long(F.count(F.lit(1))).alias("_ties"))
    return running(values, keys, [column], sums={"_upto": "_ties"}, totals={"_total": "_ties"}, bounded=bounded)


def quantile_of(column: str, share: float) -> Column:
    """Aggregate over ``ranked_counts``: the linearly interpolated quantile."""
    at = (F.col("_total") - 1) * F.lit(float(share))
    low, high = F.floor(at), F.ceil(at)
    x = F.col(column).cast("double")
    below, above = F.min(F.when(F.col("_upto") > low, x)), F.min(F.when(F.col("_upto") > high, x))
    up, down = F.max(at - low), F.max(high - at)
    return F.when(up == 0, below).otherwise(down * below + up * above)


def quantile_edges(df: DataFrame, q: int, columns: dict[str, str]) -> DataFrame:
    """One row ``{name: edges of column}``: q-quantile edges without repeats."""
    cells = [F.struct(F.lit(name).alias("_name"), F.col(c).cast("double").alias("_x")) for name, c in columns.items()]
    ranked = ranked_counts(df.select(F.inline(F.array(*cells))), ["_name"], "_x")
    cuts = F.array(*[quantile_of("_x", i / q) for i in range(q + 1)])
    per_name = ranked.groupBy("_name").agg(F.array_distinct(F.transform(cuts, lambda e: F.round(e, EDGE_DIGITS))).alias("_edges"))
    return per_name.agg(*[F.max(F.when(F.col("_name") == name, F.col("_edges"))).alias(name) for name in columns])


def score(x: Column, edge: Column, q: int, reverse: bool = False, on_ties: str = "compress") -> Column:
    """Right-closed bin number 1..bins of ``x`` between the edges.

    With repeated edges there are fewer than ``q`` bins: ``compress`` numbers
    the surviving ones, ``raise`` fails the query.
    """
    last = F.size(edge) - 1
    above = [F.when((F.lit(i) < last) & (x > F.get(edge, F.lit(i))), 1).otherwise(0) for i in range(1, q)]
    place = sum(above, F.lit(1))
    if reverse:
        place = F.greatest(last, F.lit(1)) + 1 - place
    if on_ties == "raise":
        place = F.when(last < q, F.raise_error(F.lit("tied quantile edges"))).otherwise(place)
    return F.when(x.isNotNull(), place).cast("int")


def add_scores(df: DataFrame, q: int, scores: dict[str, tuple[str, bool]], on_ties: str = "compress") -> DataFrame:
    """Add ``{score: (column, reverse)}``; all edges come from one ordered pass."""
    table = quantile_edges(df, q, {f"_e_{name}": c for name, (c, _) in scores.items()})
    joined = df.transform(beside, table)
    for name, (c, reverse) in scores.items():
        x = F.round(F.col(c).cast("double"), EDGE_DIGITS)
        joined = joined.withColumn(name, score(x, F.col(f"_e_{name}"), q, reverse, on_ties))
    return joined.drop(*[f"_e_{name}" for name in scores])


def rank_first_score(
    df: DataFrame, column: str, tie_break: str, q: int, name: str, reverse: bool = False
) -> DataFrame:
    """Equal-count bins of the first-come rank: bin = ceil((rank-1)*q/(n-1))."""
    ranked = running(
        df, [], [column, tie_break], number="_r", totals={"_n": F.lit(1)}
    )
    steps = F.col("_n") - 1
    place = F.expr("((_r - 1) * {q} + (_n - 2)) div (_n - 1)".format(q=q))
    place = F.when(steps < 1, F.lit(1)).otherwise(F.greatest(F.lit(1), place))
    place = F.lit(q + 1) - place if reverse else place
    return ranked.withColumn(name, place.cast("int")).drop("_r", "_n")


def average_pct_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ascending percentile rank with average ties.

    The ordered pass runs over the distinct values of a count column: d distinct
    counts add up to at least d*d/2 rows, so there are few of them.
    """
    cumulated = ranked_counts(df, [], column, bounded=True)
    rank = (F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2) / F.col("_total")
    return df.join(cumulated.select(column, rank.alias(name)), column, "left").select(*df.columns, name)


def dense_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Code 0.. of the sorted distinct values, null gets -1. For category columns."""
    distinct = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = running(distinct, [], [column], number="_code", bounded=True)
    coded = df.join(codes, column, "left")
    return coded.select(*df.columns, (F.coalesce("_code", F.lit(0)) - 1).cast("int").alias(name))
