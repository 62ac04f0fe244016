"""Column helpers. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.schemas import DAY_NAMES

# Lifts binary representations of decimal ties above the tie, so that half-up
# rounding gives the same digits on every engine.
TIE = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int, half_even: bool = False) -> Column:
    """Half-up rounding in plain double arithmetic (``round`` would go through a
    decimal per value); ``half_even`` keeps ties on the even digit."""
    c = col(c).cast("double")
    if half_even:
        return F.bround(c, digits)
    scale = F.lit(float(10**digits))
    return F.rint((c + F.lit(TIE)) * scale) / scale


def zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def ratio(a: Column | str, b: Column | str, digits: int | None = None) -> Column:
    """a / b with null or zero denominators giving 0."""
    q = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return zero(q if digits is None else rounded(q, digits))


def std(c: Column | str, digits: int) -> Column:
    """Sample deviation; a single row counts as 0."""
    return zero(rounded(F.stddev_samp(col(c)), digits))


def std_of_sums(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from count, sum and sum of squares of an integer measure."""
    n, total, squares = (c.cast("double") for c in (n, total, squares))
    spread = F.greatest(squares - F.try_divide(total * total, n), F.lit(0.0))
    return F.sqrt(F.try_divide(spread, n - 1))


def long(c: Column | str) -> Column:
    return col(c).cast("long")


def wrapped(c: Column | str) -> Column:
    """A whole decimal as a long, modulo 2^64: unchanged if a long can hold it."""
    half, whole = F.expr(f"{1 << 63}BD"), F.expr(f"{1 << 64}BD")
    return long(F.pmod(col(c) + half, whole) - half)


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row aggregate beside every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_row", packed).select(
        *df.columns, *[F.col("_row")[c].alias(c) for c in one_row.columns]
    )


def binarise(c: Column | str, threshold: float = 0.5) -> Column:
    return (col(c) > F.lit(threshold)).cast("int")


def confidence(score: Column | str) -> Column:
    s = col(score)
    return F.when(s > 0.6, "High").when(s > 0.3, "Medium").otherwise("Low")


def day_name(dow: Column | str) -> Column:
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return F.element_at(names, col(dow).cast("int") + 1)


def mapped(c: Column | str, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(default))


def numeric(c: Column | str) -> Column:
    """Text to number; what is not a number becomes 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def seeded(seed: int, *keys: Column | str) -> Column:
    """Reproducible pseudo-random sort key."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fill_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(columns) if columns is not None else numeric_columns(df))
