"""Shared folder and written intermediate tables.

Intermediate results that several passes read are written to the folder the
cluster names in ``spark.checkpoint.dir``: a lost executor then only costs its
running tasks. Where it is unset, a local session uses a folder in its
warehouse. What an application has written goes when its JVM ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()
_STAGED: dict[tuple, tuple[str, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"


def application_folder(spark: SparkSession) -> str:
    """Folder of this application's steps, marked to be deleted with the JVM."""
    folder = f"{shared_folder(spark)}/cartwheel/{spark.sparkContext.applicationId}"
    if folder not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MARKED.add(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "step", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return a scan of it: later passes start from the files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(
    spark: SparkSession, key: tuple, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """``written`` once per application and key; the key names the sources and their version."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _STAGED:
        df = build()
        path = new_path(spark, str(key[0]))
        df.write.partitionBy(*partition_by).parquet(path)
        _STAGED[full] = (path, df.schema)
    path, schema = _STAGED[full]
    return spark.read.schema(schema).parquet(path)
