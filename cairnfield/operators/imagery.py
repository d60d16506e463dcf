"""Planning of imagery captures and exports over framed areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.constants import (
    CAPTURE_CIRCUMFERENCE_M,
    CAPTURE_MAX_SIDE,
    CAPTURE_MAX_TILES,
    CAPTURE_MAX_ZOOM,
    EXPORT_IMAGE_PX,
    TILE_SIZE,
)
from cairnfield.functions.geo import capture_y, ground_resolution, mercator_x_m, mercator_y_m, round_half_up, world_x
from cairnfield.operators.ordered import top_by
from cairnfield.operators.tiles import _boxes_in_extents


def capture_dims(frames: DataFrame, z: Column | int) -> DataFrame:
    """Output size, tile range and ground resolution of each frame at a zoom."""
    c = F.col
    zoom = z if isinstance(z, Column) else F.lit(z)
    rows = frames.withColumn("zoom", zoom).withColumns({
        "x_min": world_x(c("west"), zoom), "y_min": capture_y(c("north"), zoom),
        "x_max": world_x(c("east"), zoom), "y_max": capture_y(c("south"), zoom),
    })
    rows = rows.withColumns({
        "width": F.greatest(F.lit(1), round_half_up(c("x_max") - c("x_min"))), "height": F.greatest(F.lit(1), round_half_up(c("y_max") - c("y_min"))),
        "tile_x_min": F.floor(c("x_min") / TILE_SIZE), "tile_x_max": F.floor((c("x_max") - 0.0001) / TILE_SIZE),
        "tile_y_min": F.floor(c("y_min") / TILE_SIZE), "tile_y_max": F.floor((c("y_max") - 0.0001) / TILE_SIZE),
        "meters_per_pixel": ground_resolution((c("north") + c("south")) / 2, zoom),
    })
    count = F.greatest(F.lit(1), c("tile_x_max") - c("tile_x_min") + 1) * F.greatest(F.lit(1), c("tile_y_max") - c("tile_y_min") + 1)
    return rows.withColumn("tile_count", count)


def optimal_zoom(frames: DataFrame, max_side: int = CAPTURE_MAX_SIDE, max_tiles: int = CAPTURE_MAX_TILES, max_zoom: int = CAPTURE_MAX_ZOOM) -> DataFrame:
    """Finest zoom whose output fits the side and tile caps; 0 when none does."""
    c = F.col
    tried = frames.select("frame_id", "north", "south", "west", "east", F.explode(F.sequence(F.lit(0), F.lit(max_zoom))).alias("_z"))
    dims = capture_dims(tried, c("_z"))
    fits = (F.greatest("width", "height") <= max_side) & (c("tile_count") <= max_tiles)
    return dims.groupBy("frame_id").agg(F.coalesce(F.max(F.when(fits, c("_z"))), F.lit(0)).alias("zoom"))


def mercator_frames(frames: DataFrame) -> DataFrame:
    c = F.col
    return frames.select(
        "frame_id", mercator_x_m(c("west")).alias("west"), mercator_y_m(c("south")).alias("south"),
        mercator_x_m(c("east")).alias("east"), mercator_y_m(c("north")).alias("north"),
    )


def capture_requests(frames: DataFrame, z: Column | int, step: int = EXPORT_IMAGE_PX) -> DataFrame:
    """Export requests of at most ``step`` pixels a side that tile each frame, with Mercator bounds."""
    c = F.col
    dims = capture_dims(frames, z)
    rows = dims.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), c("height") - 1, F.lit(step).cast("bigint"))))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), c("width") - 1, F.lit(step).cast("bigint"))))
    w, h = F.least(F.lit(step), c("width") - c("x")), F.least(F.lit(step), c("height") - c("y"))
    scale = F.pow(F.lit(2.0), c("zoom")) * (TILE_SIZE / CAPTURE_CIRCUMFERENCE_M)
    half = CAPTURE_CIRCUMFERENCE_M / 2
    return rows.select(
        "frame_id", "x", "y", w.alias("width"), h.alias("height"), ((c("x_min") + c("x")) / scale - half).alias("west"),
        (F.lit(half) - (c("y_min") + c("y") + h) / scale).alias("south"), ((c("x_min") + c("x") + w) / scale - half).alias("east"),
        (F.lit(half) - (c("y_min") + c("y")) / scale).alias("north"),
    )


def plan_requests(frames: DataFrame, sources: DataFrame, pixel_size: float) -> DataFrame:
    """Export requests per (frame, source) pair at the wanted size, never finer than the source.

    ``frames`` is in Mercator metres and names its ``source_id``.
    """
    c = F.col
    rows = frames.join(sources.select("source_id", "max_w", "max_h", "resolution_m"), "source_id")
    rows = rows.withColumn("pixel_size", F.greatest(F.lit(float(pixel_size)), c("resolution_m")))
    side = lambda a, b: F.greatest(F.lit(1), F.ceil((c(a) - c(b)) / c("pixel_size"))).cast("bigint")
    rows = rows.withColumn("_w", side("east", "west")).withColumn("_h", side("north", "south"))
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("y", F.explode(F.sequence(zero, c("_h") - 1, c("max_h").cast("bigint"))))
    rows = rows.withColumn("x", F.explode(F.sequence(zero, c("_w") - 1, c("max_w").cast("bigint"))))
    rows = rows.withColumn("width", F.least("max_w", c("_w") - c("x"))).withColumn("height", F.least("max_h", c("_h") - c("y")))
    left, top = c("west") + c("x") * c("pixel_size"), c("north") - c("y") * c("pixel_size")
    return rows.select(
        "frame_id", "source_id", "x", "y", "width", "height", "pixel_size", left.alias("west"),
        (top - c("height") * c("pixel_size")).alias("south"), (left + c("width") * c("pixel_size")).alias("east"), top.alias("north"),
    )


def match_sources(frames: DataFrame, sources: DataFrame, best_only: bool = False) -> DataFrame:
    """Sources whose extent holds a whole Mercator frame, finest first."""
    c = F.col
    box = frames.select("frame_id", c("west").alias("_w"), c("south").alias("_s"), c("east").alias("_e"), c("north").alias("_n"))
    met = _boxes_in_extents(box, sources).select("frame_id", "source_id", "resolution_m")
    return top_by(met, ["frame_id"], [c("resolution_m"), c("source_id")], 1) if best_only else met


def achievable_resolution(frames: DataFrame, max_side: int, max_requests: int) -> DataFrame:
    """Finest pixel size that keeps each Mercator frame within the side and request caps.

    ``frames`` carries its source's resolution_m, max_w and max_h. Doubling finds a size that fits,
    52 halvings close in on the limit, and two percent is left as room. Null if 60 doublings are too few.
    """
    c = F.col
    span_x, span_y = c("east") - c("west"), c("north") - c("south")
    rows = frames.withColumn("_sx", span_x).withColumn("_sy", span_y)

    def fits(size: Column) -> Column:
        w, h = F.ceil(c("_sx") / size), F.ceil(c("_sy") / size)
        return (F.greatest(w, h) <= max_side) & (F.ceil(w / c("max_w")) * F.ceil(h / c("max_h")) <= max_requests)

    start = F.greatest(c("resolution_m") * 2, c("_sx") / max_side, c("_sy") / max_side)
    rows = rows.withColumn("_start", start)
    doubled = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: c("_start") * F.pow(F.lit(2.0), k.cast("double")))
    rows = rows.withColumn("_high", F.element_at(F.filter(doubled, fits), 1))
    first = F.struct(c("resolution_m").alias("lo"), c("_high").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        ok = fits(mid)
        return F.struct(F.when(ok, acc["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(acc["hi"]).alias("hi"))

    closed = F.aggregate(F.sequence(F.lit(1), F.lit(52)), first, halve)
    return rows.select("frame_id", F.when(fits(c("resolution_m")), c("resolution_m")).otherwise(closed["hi"] * 1.02).alias("resolution_m"))


def naip_zoom(frames: DataFrame, ground_m: float = 0.3, max_side: int = 12000, max_requests: int = 16) -> DataFrame:
    """Fractional zoom of a ground resolution, lowered until side and request caps hold; null if they do not after 12 tries."""
    c = F.col
    mid = (c("north") + c("south")) / 2
    start = F.log2(F.cos(F.radians(mid)) * (CAPTURE_CIRCUMFERENCE_M / (TILE_SIZE * ground_m)))
    rows = frames.withColumn("_z", start)

    def sides(z: Column) -> tuple[Column, Column]:
        w = F.greatest(F.lit(1), round_half_up(world_x(c("east"), z) - world_x(c("west"), z)))
        h = F.greatest(F.lit(1), round_half_up(capture_y(c("south"), z) - capture_y(c("north"), z)))
        return w, h

    def fits(z: Column) -> Column:
        w, h = sides(z)
        return (F.greatest(w, h) <= max_side) & (F.ceil(w / EXPORT_IMAGE_PX) * F.ceil(h / EXPORT_IMAGE_PX) <= max_requests)

    def lower(z: Column, _: Column) -> Column:
        return F.when(fits(z), z).otherwise(z + F.log2(F.lit(float(max_side)) / F.greatest(*sides(z))) - 0.000001)

    lowered = rows.withColumn("_z", F.aggregate(F.sequence(F.lit(1), F.lit(12)), c("_z"), lower))
    return lowered.select("frame_id", F.when(fits(c("_z")), F.greatest(F.lit(0.0), c("_z"))).alias("zoom"))
