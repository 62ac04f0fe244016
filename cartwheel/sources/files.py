"""Files in and out: CSV, parquet, JSON, raw folders, fallbacks, models."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.operators.facts import enrich_products
from cartwheel.schemas import RAW_FILES, SCHEMAS


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """Header CSV. A declared schema saves the inference pass; bad rows fail."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def save_csv(df: DataFrame, path: str, **options) -> None:
    df.write.mode("overwrite").option("header", True).options(**options).csv(path)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six raw tables; a missing file fails here, before any job runs."""
    tables = {}
    for name, file in RAW_FILES.items():
        try:
            tables[name] = load_csv(spark, f"{folder}/{file}", SCHEMAS[name])
        except AnalysisException as error:
            raise FileNotFoundError(f"required raw file missing: {file}") from error
    return tables


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException:
        return False


def enriched_products(spark: SparkSession, processed: str, raw: Mapping[str, DataFrame]) -> DataFrame:
    """The processed product table, or a rebuild from raw (inner joins) if absent."""
    path = f"{processed}/products_enriched.parquet"
    if exists(spark, path):
        return load_parquet(spark, path)
    return enrich_products(raw["products"], raw["aisles"], raw["departments"], "inner")


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    """Writes a new version named by the time of saving."""
    path = f"{folder}/{name}/v{time.time_ns():020d}"
    model.write().overwrite().save(path)
    return path


def model_versions(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Saved versions, oldest first (one metadata file per version is listed)."""
    try:
        files = spark.read.text(f"{folder}/{name}/v*/metadata").select(F.input_file_name().alias("f"))
    except AnalysisException:
        return []
    version = F.regexp_extract("f", r"/(v[0-9]{20})/metadata/", 1)
    return sorted(row.v for row in files.select(version.alias("v")).distinct().collect())


def load_model(spark: SparkSession, folder: str, name: str) -> PipelineModel:
    """The newest saved version."""
    versions = model_versions(spark, folder, name)
    if not versions:
        raise FileNotFoundError(f"no saved model {name}")
    return PipelineModel.load(f"{folder}/{name}/{versions[-1]}")


def export_recommendations(recommendations: DataFrame, path: str) -> None:
    save_csv(recommendations, path)
