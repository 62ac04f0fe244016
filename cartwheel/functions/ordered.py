"""Ordered per-group calculations that do not depend on how big one group is.

A plain ``row_number() over (partition by key order by ...)`` sorts a whole
group in one task. If one key holds a third of all rows, that task never ends.
``running`` lets Spark range-partition the rows of all groups by keys and order,
writes them once with the number of their partition, their cell, numbers every
cell on its own and adds the totals of the cells before it. There is one plan for
every size: the number of cells follows the number of shuffle partitions, which
is set with the data. Most groups lie in one cell; only a group that a cell
begins with can have rows in the cell before, so the table of totals has at most
two rows per cell and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions.scalar import col
from cartwheel.session import written

CELLS_PER_PARTITION = 1

_ALL = "_all"
_CELL = "_cell"
_FIRST = "_first"
#: ``monotonically_increasing_id`` holds the partition above the row in it.
_ROW_BITS = 33


def cell_count(df: DataFrame) -> int:
    return CELLS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt to cells in the order of keys and rows, with the cell and whether it begins with the row; written once."""
    parts = [*keys, *order]
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(cell_count(df), *parts).sortWithinPartitions(*parts).withColumn("_place", place)
    cell = F.shiftright("_place", _ROW_BITS).cast("int")
    first = F.col("_place") == F.shiftleft(F.shiftright("_place", _ROW_BITS), _ROW_BITS)
    return written(dealt.select(*df.columns, cell.alias(_CELL), first.alias(_FIRST)), "cells")


def _same(names: Sequence[str], prefix: str) -> Column:
    equal = F.lit(True)
    for name in names:
        equal = equal & F.col(name).eqNullSafe(F.col(f"{prefix}{name}"))
    return equal


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    sums: Mapping[str, Column | str] | None = None,
    totals: Mapping[str, Column | str] | None = None,
    prev: Mapping[str, Column | str] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Row number, running sums, group totals and previous values in ``order``.

    ``order`` must be unique within a group. ``bounded=True`` says the groups are
    small by construction. Otherwise the rows are written once with their cells,
    and numbered when the result is read.
    """
    sums, totals, prev = dict(sums or {}), dict(totals or {}), dict(prev or {})
    names = df.columns
    if not keys:
        keys = [_ALL]
        df = df.withColumn(_ALL, F.lit(0))
    keys, order = list(keys), list(order)
    rows = df if bounded else in_cells(df, keys, order)
    parts = keys if bounded else [*keys, _CELL]
    whole = Window.partitionBy(*parts)
    by_order = whole.orderBy(*order)
    so_far = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.row_number().over(by_order)
    local = rows.select(
        *names,
        *([F.col(p) for p in parts if p not in names]),
        *([position.alias("_pos")] if number or (prev and not bounded) else []),
        *[F.sum(col(c)).over(so_far).alias(f"_run_{n}") for n, c in sums.items()],
        *[F.sum(col(c)).over(whole).alias(f"_tot_{n}") for n, c in totals.items()],
        *[F.lag(col(c)).over(by_order).alias(f"_lag_{n}") for n, c in prev.items()],
    )
    if bounded:
        return local.select(
            *names,
            *([F.col("_pos").alias(number)] if number else []),
            *[F.col(f"_run_{n}").alias(n) for n in sums],
            *[F.col(f"_tot_{n}").alias(n) for n in totals],
            *[F.col(f"_lag_{n}").alias(n) for n in prev],
        )

    # One row per cell of the groups that a cell begins with: at most two per cell.
    begun = rows.where(F.col(_FIRST)).select(*[F.col(k).alias(f"_is_{k}") for k in keys]).distinct()
    cells = (
        rows.join(F.broadcast(begun), _same(keys, "_is_"), "left_semi")
        .groupBy(*parts)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(col(c)).alias(f"_s_{n}") for n, c in sums.items()],
            *[F.sum(col(c)).alias(f"_t_{n}") for n, c in totals.items()],
            *[F.max_by(F.struct(col(c).alias("v")), F.struct(*order)).alias(f"_l_{n}") for n, c in prev.items()],
        )
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *[F.col(p).alias(f"_of_{p}") for p in parts],
        F.sum("_rows").over(earlier).alias("_before"),
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"_group_{n}") for n in totals],
        *[F.lag(f"_l_{n}").over(group.orderBy(_CELL)).alias(f"_last_{n}") for n in prev],
    )
    joined = local.join(F.broadcast(offsets), _same(parts, "_of_"), "left")
    out = [F.col(n) for n in names]
    if number:
        out.append((F.col("_pos") + F.coalesce("_before", F.lit(0))).cast("long").alias(number))
    for n in sums:
        before = F.coalesce(F.col(f"_before_{n}"), F.lit(0))
        out.append((F.coalesce(F.col(f"_run_{n}"), F.lit(0)) + before).alias(n))
    for n in totals:
        out.append(F.coalesce(f"_group_{n}", f"_tot_{n}").alias(n))
    for n in prev:
        first = F.col("_pos") == 1
        out.append(F.when(first, F.col(f"_last_{n}")["v"]).otherwise(F.col(f"_lag_{n}")).alias(n))
    return joined.select(*out)


def among_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, quota: Column, name: str
) -> DataFrame:
    """Adds whether a row is among the first ``quota`` rows of its group in ``order``.

    ``bucket`` is one of a few thousand numbers that rise with ``order``, ``quota``
    may use ``_size``, the rows of the group. The counts of the buckets tell it for
    all rows but those of the bucket a quota ends in: only these are put in order,
    the others are neither sorted nor shuffled. ``df`` is read several times.
    """
    names, keys = df.columns, list(keys) or [_ALL]
    rows = df.withColumn("_bucket", bucket)
    if keys == [_ALL]:
        rows = rows.withColumn(_ALL, F.lit(0))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy("_bucket"))
    sums = counts.select(*keys, "_bucket", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.sum("_n").over(group).alias("_size"))
    rest = F.least(quota, F.col("_size")) - F.col("_before")
    ends = written(
        sums.withColumn("_rest", rest).where((F.col("_rest") > 0) & (F.col("_before") + F.col("_rest") <= F.col("_upto")))
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bucket").alias("_end"), "_rest"),
        "ends",
    )
    met = rows.join(F.broadcast(ends), _same(keys, "_of_"), "left")
    at_end = F.col("_bucket").eqNullSafe(F.col("_end"))
    clear = met.where(~at_end).select(*names, F.coalesce(F.col("_bucket") < F.col("_end"), F.lit(False)).alias(name))
    edge = running(met.where(at_end).select(*dict.fromkeys([*names, *keys, "_rest"])), keys, order, number="_place")
    return clear.unionByName(edge.select(*names, (F.col("_place") <= F.col("_rest")).alias(name)))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group.

    The rank filter lets Spark keep only ``k`` rows per group in every map task
    before the shuffle, so a hot group reaches its reducer as k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
