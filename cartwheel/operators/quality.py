"""Validation, profiling and cleaning of the source tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.scalar import fill_numeric, long, numeric, ratio
from cartwheel.schemas import REQUIRED

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_WIDTHS = ((T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31))


def missing_columns(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]] = REQUIRED) -> dict[str, list[str]]:
    """Required columns absent per table (metadata only); a missing table lacks all."""
    return {
        name: sorted(set(columns) - set(tables[name].columns if name in tables else ()))
        for name, columns in required.items()
    }


def is_valid(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]] = REQUIRED) -> bool:
    return not any(missing_columns(tables, required).values())


def orphan_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Distinct child keys without a parent. Distinct first: a hot key is one row."""
    known = parent.select(F.col(parent_key or key).alias(key))
    return child.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, key: str, check: str, parent_key: str | None = None) -> DataFrame:
    return orphan_keys(child, parent, key, parent_key).agg(long(F.count(F.lit(1))).alias("invalid_keys")).select(
        F.lit(check).alias("check_name"), "invalid_keys"
    )


def foreign_key_report(products: DataFrame, aisles: DataFrame, departments: DataFrame) -> DataFrame:
    return orphan_count(products, aisles, "aisle_id", "products.aisle_id").unionAll(
        orphan_count(products, departments, "department_id", "products.department_id")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, all_null) from one pass over the table."""
    return _unpivot(
        df.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count(F.col(c)).alias(c) for c in df.columns],
        ),
        df.columns,
        lambda c: {
            "n_rows": F.col("_rows"),
            "null_count": F.col("_rows") - F.col(c),
            "all_null": ((F.col(c) == 0) & (F.col("_rows") > 0)).cast("int"),
        },
    )


def _unpivot(row: DataFrame, columns: Sequence[str], stats) -> DataFrame:
    """One aggregate row to one row per column."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), *[v.alias(n) for n, v in stats(c).items()])
        for c in columns
    ]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def validate_frame(df: DataFrame, required: Sequence[str], name: str = "table") -> DataFrame:
    """One row: is the table usable, and which of its columns are all null."""
    missing = sorted(set(required) - set(df.columns))
    row = df.agg(
        long(F.count(F.lit(1))).alias("n_rows"),
        *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    flags = F.array(*[
        F.when((F.col(f"_{i}") == 0) & (F.col("n_rows") > 0), F.lit(c)) for i, c in enumerate(df.columns)
    ])
    return row.select(
        F.lit(name).alias("table_name"),
        "n_rows",
        F.lit(",".join(missing)).alias("missing_columns"),
        F.concat_ws(",", F.array_compact(flags)).alias("all_null_columns"),
        (F.lit(not missing) & (F.col("n_rows") > 0)).cast("int").alias("passed"),
    )


def fill_first_gap(orders: DataFrame, first_gap: str = "zero") -> DataFrame:
    """Gap before a user's first order: 0 after cleaning, null in the raw table."""
    if first_gap == "null":
        return orders
    return orders.withColumn("days_since_prior_order", F.coalesce("days_since_prior_order", F.lit(0.0)))


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest integer type that holds every value; all-digit text to int; double to float.

    The choice needs one aggregate row (minimum, maximum, all digits) per table.
    """
    fields = [(f"c{i}", f) for i, f in enumerate(df.schema.fields)]
    stats: list[Column] = []
    for alias, field in fields:
        c = F.col(field.name)
        if isinstance(field.dataType, _INTEGERS):
            stats += [F.min(c).cast("long").alias(f"{alias}_low"), F.max(c).cast("long").alias(f"{alias}_high")]
        elif isinstance(field.dataType, T.StringType):
            digits = c.rlike("^[0-9]+$") & c.try_cast("int").isNotNull()
            stats.append(F.coalesce(F.bool_and(F.coalesce(digits, F.lit(False))), F.lit(False)).alias(f"{alias}_digits"))
    found = df.agg(*stats).first() if stats else None
    out = []
    for alias, field in fields:
        c = F.col(field.name)
        if isinstance(field.dataType, _INTEGERS) and found[f"{alias}_low"] is not None:
            low, high = found[f"{alias}_low"], found[f"{alias}_high"]
            fits = [t for t, bits in _WIDTHS if -(1 << bits) <= low and high < (1 << bits)]
            c = c.cast(fits[0] if fits else T.LongType())
        elif isinstance(field.dataType, T.StringType) and found[f"{alias}_digits"]:
            c = c.cast("int")
        elif isinstance(field.dataType, T.DoubleType):
            c = c.cast("float")
        out.append(c.alias(field.name))
    return df.select(*out)


def integrity_report(df: DataFrame, required: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Per column: type, nulls, null share, distinct values; spread of numeric columns.

    The plain figures of all columns come from one pass. Exact distinct counts
    come from a second one: each row gives its (column, value) pairs, which are
    made distinct where they are read and only then shuffled.
    """
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, _INTEGERS + _FLOATS)}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    row = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(types):
        c = F.col(name)
        number = c.cast("double") if name in numbers else F.lit(None).cast("double")
        row += [
            F.count(c).alias(f"_filled_{i}"),
            F.approx_count_distinct(c).alias(f"_seen_{i}"),
            F.avg(number).alias(f"_mean_{i}"),
            F.stddev_samp(number).alias(f"_std_{i}"),
            F.min(number).alias(f"_min_{i}"),
            F.max(number).alias(f"_max_{i}"),
        ]
    if not approximate:
        row = [c for i, c in enumerate(row) if i == 0 or (i - 1) % 6 != 1]
    place = {name: i for i, name in enumerate(types)}

    def figures(name: str) -> Column:
        i, missing = place[name], F.col("_rows") - F.col(f"_filled_{place[name]}")
        parts = {
            "column_name": F.lit(name),
            "dtype": F.lit(types[name]),
            "is_required": F.lit(int(name in required)),
            "n_rows": long("_rows"),
            "null_count": long(missing),
            "null_percentage": 100.0 * ratio(missing, "_rows"),
            "unique_count": long(f"_seen_{i}") if approximate else F.lit(None).cast("long"),
            **{part: F.col(f"_{part}_{i}") for part in ("mean", "std", "min", "max")},
        }
        return F.struct(*[value.alias(key) for key, value in parts.items()])

    report = df.agg(*row).select(F.inline(F.array(*[figures(name) for name in types])))
    if approximate:
        return report
    pairs = F.array(*[F.struct(F.lit(name).alias("_of"), F.col(name).cast("string").alias("_value")) for name in types])
    distinct = df.select(F.explode(pairs).alias("_at")).select("_at.*").where(F.col("_value").isNotNull()).distinct()
    counts = distinct.groupBy("_of").agg(long(F.count(F.lit(1))).alias("_unique"))
    joined = report.join(counts, F.col("column_name") == F.col("_of"), "left")
    unique = F.coalesce("_unique", F.lit(0).cast("long")).alias("unique_count")
    return joined.select(*[unique if c == "unique_count" else F.col(c) for c in report.columns])


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, columns); a row count of a file scan reads footers only."""
    parts = [
        df.agg(long(F.count(F.lit(1))).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def missing_values(df: DataFrame) -> DataFrame:
    return null_profile(df).select("column_name", long("null_count").alias("null_count"))


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numeric(c) for c in columns})


def fill_by_group(df: DataFrame, prefix: str = "ui_") -> DataFrame:
    """Pairs without history get 0 in their pair columns, then all numbers do."""
    return fill_numeric(df.fillna(0, subset=[c for c in df.columns if c.startswith(prefix)]))
