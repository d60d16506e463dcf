"""Stored tiles and download manifests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = (
    "map_id STRING, source_id STRING, z INT, tile_size INT, cols INT, rows INT, status STRING, updated_at STRING,"
    " average_tile_bytes DOUBLE, completed_keys ARRAY<STRING>, missing_keys ARRAY<STRING>"
)
STORED_SCHEMA = "map_id STRING, level BIGINT, col BIGINT, row BIGINT, mime_type STRING, byte_length BIGINT"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def manifest_rows(manifests: DataFrame, column: str = "completed_keys") -> DataFrame:
    """One row per key of a manifest, its z/x/y parsed; keys that do not parse are dropped."""
    keep = [c for c in manifests.columns if not c.endswith("_keys")]
    rows = manifests.select(*keep, F.explode(column).alias("key"))
    part = lambda i: F.try_element_at(F.split("key", "/"), F.lit(i)).try_cast("bigint")
    return rows.select(*keep, "key", part(1).cast("int").alias("z"), part(2).alias("x"), part(3).alias("y")).where(
        "z is not null and x is not null and y is not null"
    )
