"""Raw files -> validated, cleaned, processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartwheel.operators import quality, rfm
from cartwheel.operators.facts import order_facts
from cartwheel.sources.files import load_parquet, load_raw, save_parquet


def clean(name: str, table: DataFrame, narrow: bool = True) -> DataFrame:
    if name == "orders":
        table = quality.fill_first_gap(table)
    return quality.narrow_types(table) if narrow else table


def ingest(spark: SparkSession, raw_folder: str, processed_folder: str, narrow: bool = True) -> dict[str, DataFrame]:
    """Load, validate, clean and save; returns scans of the saved tables."""
    raw = load_raw(spark, raw_folder)
    if not quality.is_valid(raw):
        raise ValueError(f"raw tables lack columns: {quality.missing_columns(raw)}")
    out = {}
    for name, table in raw.items():
        path = f"{processed_folder}/{name}.parquet"
        save_parquet(clean(name, table, narrow), path)
        out[name] = load_parquet(spark, path)
    return out


def segment(spark: SparkSession, processed_folder: str, features_folder: str, quantiles: int = 5) -> DataFrame:
    """Segment the users of the processed tables; saves the full and the lookup table."""
    table = {
        name: load_parquet(spark, f"{processed_folder}/{name}.parquet")
        for name in ("orders", "order_products_prior", "order_products_train")
    }
    lines = table["order_products_prior"].unionByName(table["order_products_train"])
    segments = rfm.segment_users(order_facts(table["orders"], lines), quantiles)
    return save_segments(segments, features_folder)


def save_segments(segments: DataFrame, features_folder: str) -> DataFrame:
    """The lookup is cut from the saved table, so the metrics are computed once."""
    spark = segments.sparkSession
    path = f"{features_folder}/rfm_analysis.parquet"
    save_parquet(segments, path)
    saved = load_parquet(spark, path)
    save_parquet(rfm.segment_lookup(saved), f"{features_folder}/user_segments.parquet")
    return saved
