"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from cartwheel.plans.ingest import ingest, segment
from cartwheel.plans.training import save_splits
from cartwheel.schemas import RAW_FILES, SCHEMAS
from cartwheel.sources import files
from cartwheel.sources.retail import Star
from registry.tables import six_tables
from tests.conftest import TINY, rows


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    for name, table in six_tables(Star(spark, TINY, None)).items():
        files.save_csv(table, f"{folder}/{RAW_FILES[name]}")
    return folder


def test_raw_tables_round_trip(spark, raw):
    loaded = files.load_raw(spark, raw)
    for name, table in six_tables(Star(spark, TINY, None)).items():
        assert loaded[name].schema == SCHEMAS[name]
        assert rows(loaded[name].select(table.columns)) == rows(table)


def test_missing_raw_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_raw(spark, str(tmp_path))


def test_ingest_then_segment(spark, raw, tmp_path):
    done = ingest(spark, raw, str(tmp_path / "processed"))
    assert done["orders"].where(F.col("days_since_prior_order").isNull()).isEmpty()
    assert dict(done["orders"].dtypes)["order_dow"] == "tinyint"
    segments = segment(spark, str(tmp_path / "processed"), str(tmp_path / "features"))
    lookup = spark.read.parquet(str(tmp_path / "features" / "user_segments.parquet"))
    assert segments.count() == lookup.count() == Star(spark, TINY, None).lines().select("user_id").distinct().count()


def test_ingest_rejects_missing_columns(spark, raw, tmp_path, monkeypatch):
    from cartwheel.operators import quality

    monkeypatch.setattr(quality, "is_valid", lambda tables: False)
    with pytest.raises(ValueError):
        ingest(spark, raw, str(tmp_path / "processed"))


def test_newest_model_wins(spark, tmp_path):
    from cartwheel.operators import models

    df = spark.range(40).select(F.col("id").alias("x"), (F.col("id") > 20).cast("int").alias("label"))
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, folder, "m")
    files.save_model(models.stack_logistic(df, ["x"]), folder, "m")
    files.save_model(models.random_forest(df, ["x"], trees=3), folder, "m")
    assert len(files.model_versions(spark, folder, "m")) == 2
    assert "RandomForest" in type(files.load_model(spark, folder, "m").stages[-1]).__name__


def test_saved_splits(spark, tmp_path):
    split = spark.createDataFrame([(1, 1, 0, 0.5, "train"), (1, 2, 1, 0.1, "test")], "user_id long, product_id long, label int, f double, split string")
    save_splits(split, split.select("user_id", "product_id", "label"), split.select("product_id"), str(tmp_path))
    meta = files.load_json(spark, str(tmp_path / "split_metadata")).first()
    assert (meta.train_size, meta.test_size, meta.feature_count) == (1, 1, 1)
