"""Imagery-service metadata as a validated source catalogue."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.constants import EARTH_RADIUS_M, HALF_WORLD_M
from cairnfield.functions.geo import florida_albers_to_mercator, geographic_to_mercator

_REF = "spatialReference: STRUCT<wkid: INT, latestWkid: INT>"
SERVICE_SCHEMA = (
    f"url STRING, name STRING, description STRING, copyrightText STRING, documentInfo STRUCT<Title: STRING>, singleFusedMapCache BOOLEAN,"
    f" fullExtent STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE, {_REF}>, {_REF.replace(':', '', 1)},"
    f" tileInfo STRUCT<rows: INT, cols: INT, origin: STRUCT<x: DOUBLE, y: DOUBLE>, {_REF}, lods: ARRAY<STRUCT<level: INT, resolution: DOUBLE>>>,"
    " maxImageWidth DOUBLE, maxImageHeight DOUBLE, pixelSizeX DOUBLE, pixelSizeY DOUBLE, error STRUCT<code: INT, message: STRING>"
)
# fixed values: Web Mercator reference numbers
MERCATOR_IDS = [3857, 102100, 102113]
YEAR = r"\b((?:19|20)\d{2})\b"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERVICE_SCHEMA).json(path)


def from_service_text(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.from_json(column, SERVICE_SCHEMA).alias("s")).select("s.*")


def _year(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), YEAR, 1)
    return F.when(found != "", found.cast("int"))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def tiled_sources(services: DataFrame) -> DataFrame:
    """One row per service: its extent, zoom range and credit, or the first rule it breaks."""
    c = F.col
    lods = F.filter("tileInfo.lods", lambda x: (x["level"] >= 0) & (x["resolution"] > 0))
    rows = services.withColumn("_lods", F.coalesce(lods, F.array().cast("array<struct<level:int,resolution:double>>")))
    tile_ref = F.coalesce("tileInfo.spatialReference.latestWkid", "tileInfo.spatialReference.wkid")
    area_ref = F.coalesce("fullExtent.spatialReference.latestWkid", "fullExtent.spatialReference.wkid", tile_ref)

    def off(x: Column) -> Column:
        expected = F.lit(2 * math.pi * EARTH_RADIUS_M / 256) / F.pow(F.lit(2.0), x["level"])
        return F.abs(x["resolution"] - expected) > expected * 0.01

    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/$", "")
    # fixed values: refusal texts
    reason = (
        F.when(c("error").isNotNull(), F.concat(F.lit("ArcGIS service error: "), F.coalesce(c("error.message"), F.concat(F.lit("code "), F.coalesce(c("error.code").cast("string"), F.lit("unknown"))))))
        .when(no(path.rlike("(?i)/MapServer$")), "Paste an ArcGIS REST MapServer URL with a cached tile service.")
        .when(no(c("singleFusedMapCache")) | c("tileInfo").isNull(), "This ArcGIS MapServer does not expose a cached tile service.")
        .when(no((c("tileInfo.rows") == 256) & (c("tileInfo.cols") == 256)), "Only 256 × 256 cached ArcGIS tiles are supported.")
        .when(c("tileInfo.origin.x").isNull() | c("tileInfo.origin.y").isNull(), "The ArcGIS tile service has an invalid cache origin.")
        .when(
            (F.abs(c("tileInfo.origin.x") + HALF_WORLD_M) > 1) | (F.abs(c("tileInfo.origin.y") - HALF_WORLD_M) > 1),
            "Only the standard Web Mercator cache origin is supported.",
        )
        .when(tile_ref.isNull(), "The ArcGIS tile service must publish its spatial reference.")
        .when(c("fullExtent").isNull(), "The ArcGIS tile service must publish its full extent.")
        .when(~area_ref.isin(MERCATOR_IDS) | ~tile_ref.isin(MERCATOR_IDS), "Only Web Mercator ArcGIS tile services are supported.")
        .when(F.exists("_lods", off), "The ArcGIS cache levels do not use the standard Web Mercator zoom matrix.")
        .when(
            (F.size("_lods") == 0) | (F.size(F.array_distinct(F.transform("_lods", lambda x: x["level"]))) < F.size("_lods")),
            "The ArcGIS tile service has no valid, unique cache levels.",
        )
    )
    year = F.coalesce(_year(c("description")), _year(c("documentInfo.Title")))
    text = lambda n: F.when(F.trim(n) != "", F.trim(n))
    owner = F.coalesce(text("copyrightText"), c("name"), _host(c("url")))
    dated = F.when(year.isNull(), "").otherwise(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")))
    levels = F.transform("_lods", lambda x: x["level"])
    return rows.withColumn("reason", reason).select(
        "url", F.coalesce(text("name"), _host(c("url"))).alias("name"), "reason", c("fullExtent.xmin").alias("west"), c("fullExtent.ymin").alias("south"),
        c("fullExtent.xmax").alias("east"), c("fullExtent.ymax").alias("north"), F.array_min(levels).alias("min_zoom"), F.array_max(levels).alias("max_zoom"),
        F.concat(F.lit("Imagery: "), owner, F.lit(" via ArcGIS"), dated).alias("attribution"), year.alias("year"),
    )


def export_sources(services: DataFrame) -> DataFrame:
    """Export services with their extent in Mercator metres, size caps and native resolution."""
    c = F.col
    ref = F.coalesce("fullExtent.spatialReference.latestWkid", "fullExtent.spatialReference.wkid", "spatialReference.latestWkid", "spatialReference.wkid")

    def corner(x: str, y: str) -> Column:
        px, py = c(f"fullExtent.{x}"), c(f"fullExtent.{y}")
        gx, gy = geographic_to_mercator(px, py)
        ax, ay = florida_albers_to_mercator(px, py)
        pick = lambda m, g, a: F.when(ref.isin(MERCATOR_IDS), m).when(ref.isin(4326, 4269), g).when(ref == 3087, a)
        return F.struct(pick(px, gx, ax).alias("x"), pick(py, gy, ay).alias("y"))

    four = F.array(corner("xmin", "ymin"), corner("xmin", "ymax"), corner("xmax", "ymin"), corner("xmax", "ymax"))
    rows = services.withColumn("_c", four).withColumn("_x", F.transform("_c", lambda p: p["x"])).withColumn("_y", F.transform("_c", lambda p: p["y"]))
    year = _year(c("documentInfo.Title"))
    return rows.where(c("error").isNull() & F.get("_x", F.lit(0)).isNotNull()).select(
        "url", F.coalesce("name", _host(c("url"))).alias("name"), F.when(c("url").rlike("(?i)/ImageServer/?$"), "imageserver-export").otherwise("mapserver-export").alias("kind"),
        F.array_min("_x").alias("west"), F.array_min("_y").alias("south"), F.array_max("_x").alias("east"), F.array_max("_y").alias("north"),
        F.floor(F.coalesce("maxImageWidth", F.lit(2048.0))).cast("int").alias("max_w"), F.floor(F.coalesce("maxImageHeight", F.lit(2048.0))).cast("int").alias("max_h"),
        F.greatest(F.coalesce("pixelSizeX", F.lit(0.3)), F.coalesce("pixelSizeY", F.lit(0.3))).alias("resolution_m"), year.alias("year"),
    )
