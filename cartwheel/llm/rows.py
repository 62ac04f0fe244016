"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slim(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column of a table is read or clashes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    """(doc_id, text) of each row, without a second copy of the whole batch; null is empty."""
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield doc_id, text.as_py() or ""


def row_digest(*columns: Column) -> Column:
    """16 bytes that name the values of a row, nulls among them, and its text (null is empty)."""
    values = [F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*values, F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")))


def without(docs: DataFrame, verdicts: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs``, whatever their columns are called, but for those that ``verdicts`` rejects by ``row_digest``.

    ``digest`` is that column as an expression over ``docs``.
    """
    gone = verdicts.where("NOT kept").select(F.col("row_digest").alias("rejected")).distinct()
    own = docs.select(digest.alias("of"), F.struct("*").alias("row"))
    return own.join(gone, own["of"] == gone["rejected"], "left_anti").select("row.*")
