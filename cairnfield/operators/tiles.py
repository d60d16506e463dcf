"""Tile plans, pyramids, downloads and their audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.constants import (
    DETAIL_CELL_LIMIT,
    DETAIL_CELL_PX,
    DETAIL_TILES_PER_SIDE,
    DETAIL_ZOOM,
    HALF_WORLD_M,
    MAX_ATTEMPTS,
    MAX_MERCATOR_LAT,
    MAX_WORKING_SIDE,
    OVERVIEW_MAX_SIDE,
    STORAGE_SAFETY,
    TILE_BUFFER_M,
    TILE_CIRCUMFERENCE_M,
    TILE_SIZE,
)
from cairnfield.functions.geo import (
    D2R,
    clamp,
    detail_cell_x,
    detail_cell_y,
    mercator_x_m,
    mercator_y_m,
    world_lat,
    world_lon,
    world_px_to_m_x,
    world_px_to_m_y,
    world_x,
    world_y,
)
from cairnfield.functions.plane import retry_delay_ms, segment_intersects_rect
from cairnfield.operators.lines import segments
from cairnfield.operators.ordered import number_rows, top_by, with_next


def ground_area(boundaries: DataFrame) -> DataFrame:
    """Square metres on the ground: Mercator area scaled by the squared cosine of the mean latitude."""
    c = F.col
    pts = boundaries.withColumn("x", c("lon") * (TILE_CIRCUMFERENCE_M / 360)).withColumn(
        "y", F.ln(F.tan(clamp(c("lat"), -MAX_MERCATOR_LAT, MAX_MERCATOR_LAT) * (math.pi / 360) + math.pi / 4)) * (TILE_CIRCUMFERENCE_M / (2 * math.pi))
    )
    mid = boundaries.groupBy("map_id").agg(F.avg("lat").alias("_lat"), F.avg(mercator_x_m(c("lon"))).alias("_mx"))
    ring = segments(pts.select("map_id", "idx", "x", "y"), ["map_id"], closed=F.lit(True))
    # Shifting the origin to the mean keeps the cross products small.
    base = pts.groupBy("map_id").agg(F.avg("x").alias("_ox"), F.avg("y").alias("_oy"))
    ring = ring.join(base, "map_id")
    cross = (c("x1") - c("_ox")) * (c("y2") - c("_oy")) - (c("x2") - c("_ox")) * (c("y1") - c("_oy"))
    twice = ring.groupBy("map_id").agg(F.sum(cross).alias("_t"))
    return twice.join(mid, "map_id").select("map_id", (F.abs("_t") / 2 * F.pow(F.cos(c("_lat") * D2R), F.lit(2.0))).alias("area_m2"))


def _cover(boundaries: DataFrame, z: int, side: int, buffer_m: float) -> DataFrame:
    """Grid squares of ``side`` pixels at zoom ``z`` that touch each boundary or its buffer.

    Edges list only the squares near them; squares strictly inside are found per row from the edge
    crossings at the row's middle. Nothing is tested against a boundary's whole bounding box.
    """
    c = F.col
    world = boundaries.withColumn("x", world_x(c("lon"), z)).withColumn("y", world_y(c("lat"), z))
    box = world.groupBy("map_id").agg(
        F.avg("lat").alias("_lat"), F.min("x").alias("_l"), F.min("y").alias("_t"), F.max("x").alias("_r"), F.max("y").alias("_b")
    )
    grow = F.lit(float(buffer_m)) / F.greatest(F.lit(0.01), F.cos(c("_lat") * D2R)) * (TILE_SIZE * 2**z / TILE_CIRCUMFERENCE_M)
    s = F.lit(float(side))
    last = 2**z * TILE_SIZE // side - 1
    eps = 2.220446049250313e-16
    low = lambda v: F.floor((c(v) - c("_pad")) / s)
    if buffer_m:
        high = lambda v: F.floor((c(v) + c("_pad") - eps) / s)
        cap = lambda v: F.least(F.lit(last), v)
        floor0 = lambda v: F.greatest(F.lit(0), v)
    else:
        near = eps * 2**z * TILE_SIZE
        high = lambda v: F.floor(F.greatest(c({"_r": "_l", "_b": "_t"}[v]), c(v) - near) / s)
        cap = floor0 = lambda v: v
    box = box.withColumn("_pad", grow if buffer_m else F.lit(0.0))
    box = box.select(
        "map_id", "_pad", floor0(low("_l")).cast("bigint").alias("min_x"), floor0(low("_t")).cast("bigint").alias("min_y"),
        cap(high("_r")).cast("bigint").alias("max_x"), cap(high("_b")).cast("bigint").alias("max_y"),
    )
    edges = segments(world.select("map_id", "idx", "x", "y"), ["map_id"], closed=F.lit(True)).join(box, "map_id")
    span = lambda lo, hi, a, b: F.sequence(
        F.greatest(c(lo), F.floor((F.least(a, b) - c("_pad")) / s).cast("bigint") - 1),
        F.least(c(hi), F.floor((F.greatest(a, b) + c("_pad")) / s).cast("bigint") + 1),
    )
    near_edge = edges.withColumn("ty", F.explode(span("min_y", "max_y", "y1", "y2")))
    # Within the row, only the stretch of the edge that passes it (with the buffer) matters.
    dy = F.nullif(c("y2") - c("y1"), F.lit(0.0))
    ya = F.greatest(c("ty") * s - c("_pad") - s, F.least("y1", "y2"))
    yb = F.least((c("ty") + 1) * s + c("_pad") + s, F.greatest("y1", "y2"))
    xa = F.coalesce(c("x1") + (c("x2") - c("x1")) * (ya - c("y1")) / dy, c("x1"))
    xb = F.coalesce(c("x1") + (c("x2") - c("x1")) * (yb - c("y1")) / dy, c("x2"))
    near_edge = near_edge.withColumn("_xa", xa).withColumn("_xb", xb).withColumn("tx", F.explode(span("min_x", "max_x", c("_xa"), c("_xb"))))
    left, top, right, bottom = c("tx") * s, c("ty") * s, (c("tx") + 1) * s, (c("ty") + 1) * s
    hit = segment_intersects_rect(c("x1"), c("y1"), c("x2"), c("y2"), left, top, right, bottom)
    if buffer_m:
        away = lambda px, py: F.hypot(F.greatest(left - px, F.lit(0.0), px - right), F.greatest(top - py, F.lit(0.0), py - bottom))
        dx, dy2 = c("x2") - c("x1"), c("y2") - c("y1")
        len2 = dx * dx + dy2 * dy2

        def corner(px: Column, py: Column) -> Column:
            t = F.when(len2 == 0, 0.0).otherwise(clamp(((px - c("x1")) * dx + (py - c("y1")) * dy2) / F.nullif(len2, F.lit(0.0)), 0.0, 1.0))
            return F.hypot(px - c("x1") - t * dx, py - c("y1") - t * dy2) <= c("_pad")

        hit = hit | (F.least(away(c("x1"), c("y1")), away(c("x2"), c("y2"))) <= c("_pad"))
        hit = hit | corner(left, top) | corner(right, top) | corner(right, bottom) | corner(left, bottom)
    touched = near_edge.where(hit).select("map_id", "tx", "ty").distinct()
    # Squares without an edge are all in or all out: their centre decides, between pairs of crossings.
    rows = edges.withColumn("ty", F.explode(F.sequence(
        F.greatest(c("min_y"), F.floor(F.least("y1", "y2") / s).cast("bigint") - 1), F.least(c("max_y"), F.floor(F.greatest("y1", "y2") / s).cast("bigint") + 1)
    )))
    mid = (c("ty") + 0.5) * s
    cuts = rows.where((c("y1") > mid) != (c("y2") > mid)).select(
        "map_id", "ty", "min_x", "max_x", (c("x1") + (c("x2") - c("x1")) * (mid - c("y1")) / (c("y2") - c("y1"))).alias("at")
    )
    # Crossings of one row are numbered from the left; each even one opens a stretch to the next.
    numbered = number_rows(cuts, ["map_id", "ty"], [c("at")], "_k", start=0)
    runs = with_next(numbered, ["map_id", "ty"], {"at": "_next"}, idx="_k").where("_k % 2 = 0 and _next is not null")
    first = F.greatest(c("min_x"), F.ceil(c("at") / s - 0.5).cast("bigint"))
    final = F.least(c("max_x"), F.floor(c("_next") / s - 0.5).cast("bigint"))
    inner = runs.withColumn("_a", first).withColumn("_b", final).where("_a <= _b")
    inner = inner.select("map_id", F.explode(F.sequence("_a", "_b")).alias("tx"), "ty")
    both = touched.unionByName(inner).distinct()
    return both.join(box, "map_id").select("map_id", c("tx").alias("x"), c("ty").alias("y"), "min_x", "min_y", "max_x", "max_y")


def tile_cover(boundaries: DataFrame, z: int, buffer_m: float = TILE_BUFFER_M) -> DataFrame:
    """Tiles touching each boundary plus buffer, with their column and row in the planned image."""
    t = _cover(boundaries, z, TILE_SIZE, buffer_m)
    return t.select("map_id", F.lit(z).alias("z"), "x", "y", (F.col("x") - F.col("min_x")).alias("col"), (F.col("y") - F.col("min_y")).alias("row"))


def tile_plans(boundaries: DataFrame, z: int, buffer_m: float = TILE_BUFFER_M) -> DataFrame:
    """One plan row per boundary: origin, size, tile count, bounds and ground area."""
    c = F.col
    t = _cover(boundaries, z, TILE_SIZE, buffer_m).groupBy("map_id", "min_x", "min_y", "max_x", "max_y").agg(F.count("*").alias("tile_count"))
    world = float(TILE_SIZE * 2**z)
    cols, rows = c("max_x") - c("min_x") + 1, c("max_y") - c("min_y") + 1
    px = float(TILE_SIZE)
    return t.join(ground_area(boundaries), "map_id").select(
        "map_id", F.lit(z).alias("z"), (c("min_x") * TILE_SIZE).alias("origin_x"), (c("min_y") * TILE_SIZE).alias("origin_y"),
        (cols * TILE_SIZE).alias("width"), (rows * TILE_SIZE).alias("height"), cols.alias("cols"), rows.alias("rows"), "tile_count",
        (c("min_x") * px / world * 360 - 180).alias("west"), ((c("max_x") + 1) * px / world * 360 - 180).alias("east"),
        world_lat(c("min_y") * px, z).alias("north"), world_lat((c("max_y") + 1) * px, z).alias("south"), "area_m2",
    )


def detail_cells(boundaries: DataFrame) -> DataFrame:
    """Export cells that meet each boundary, with Mercator bounds."""
    c = F.col
    t = _cover(boundaries, DETAIL_ZOOM, DETAIL_CELL_PX, 0.0)
    px = float(DETAIL_CELL_PX)
    return t.select(
        "map_id", "x", "y", world_px_to_m_x(c("x") * px).alias("west_m"), world_px_to_m_y((c("y") + 1) * px).alias("south_m"),
        world_px_to_m_x((c("x") + 1) * px).alias("east_m"), world_px_to_m_y(c("y") * px).alias("north_m"),
    )


def plan_detail(boundaries: DataFrame, limit: int = DETAIL_CELL_LIMIT) -> DataFrame:
    counts = detail_cells(boundaries).groupBy("map_id").agg(F.count("*").alias("cells"))
    return counts.join(ground_area(boundaries), "map_id").withColumn("over_limit", F.col("cells") > limit)


def detail_cell_at(points: DataFrame) -> DataFrame:
    return points.withColumn("cell_x", detail_cell_x(F.col("lon"))).withColumn("cell_y", detail_cell_y(F.col("lat")))


def cell_neighbourhood(points: DataFrame, keys: list[str]) -> DataFrame:
    """The nine cells around each point, nearest first, own cell before others at equal distance."""
    c = F.col
    px = float(DETAIL_CELL_PX)
    rows = detail_cell_at(points).withColumn("_fx", world_x(c("lon"), DETAIL_ZOOM)).withColumn("_fy", world_y(c("lat"), DETAIL_ZOOM))

    def cell(dx: int, dy: int) -> Column:
        x, y = c("cell_x") + dx, c("cell_y") + dy
        away = F.hypot(
            F.greatest(x * px - c("_fx"), F.lit(0.0), c("_fx") - (x + 1) * px), F.greatest(y * px - c("_fy"), F.lit(0.0), c("_fy") - (y + 1) * px)
        )
        return F.struct(away.alias("d"), F.lit(0 if dx == dy == 0 else 1).alias("other"), y.alias("y"), x.alias("x"))

    # Nine structs sorted in place: no shuffle is needed to rank them.
    nine = F.sort_array(F.array(*[cell(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    return rows.select(*keys, F.posexplode(nine).alias("rank", "_n")).select(*keys, "rank", c("_n.x").alias("x"), c("_n.y").alias("y"), c("_n.d").alias("distance"))


def detail_tiles(cells: DataFrame) -> DataFrame:
    """The 64 tiles of each export cell."""
    c = F.col
    n = DETAIL_TILES_PER_SIDE
    rows = cells.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    keep = [k for k in cells.columns if k not in ("x", "y")]
    col, row = c("_i") % n, F.floor(c("_i") / n).cast("int")
    return rows.select(*keep, (c("x") * n + col).alias("x"), (c("y") * n + row).alias("y"), col.alias("export_col"), row.alias("export_row"))


def local_detail_tiles(cells: DataFrame, maps: DataFrame) -> DataFrame:
    """Tiles of each cell inside its map's doubled grid; maps must be aligned z20 tile maps."""
    c = F.col
    tile = float(TILE_SIZE)
    m = maps.where("source_zoom = 20 and tile_size = 256 and width > 0 and height > 0").select(
        "map_id", (c("origin_x") * 2 / tile).alias("_oc"), (c("origin_y") * 2 / tile).alias("_or"),
        F.ceil(c("width") * 2 / tile).alias("_cols"), F.ceil(c("height") * 2 / tile).alias("_rows"),
    ).where("_oc = floor(_oc) and _or = floor(_or)")
    rows = detail_tiles(cells).join(m, "map_id")
    rows = rows.withColumn("col", (c("x") - c("_oc")).cast("bigint")).withColumn("row", (c("y") - c("_or")).cast("bigint"))
    return rows.where("col >= 0 and row >= 0 and col < _cols and row < _rows").drop("_oc", "_or", "_cols", "_rows")


def pyramid_levels(maps: DataFrame, max_side: int = OVERVIEW_MAX_SIDE) -> DataFrame:
    """Levels that halve each map until its long side fits the overview."""
    c = F.col
    long = F.greatest("width", "height")
    top = F.greatest(F.lit(0), F.ceil(F.log2(long / F.lit(float(max_side))))).cast("int")
    rows = maps.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    half = lambda n: F.ceil(c(n) / F.pow(F.lit(2.0), c("level"))).cast("bigint")
    rows = rows.select("map_id", "level", half("width").alias("width"), half("height").alias("height"))
    return rows.withColumn("cols", F.ceil(c("width") / TILE_SIZE)).withColumn("rows", F.ceil(c("height") / TILE_SIZE))


def tiles_for_region(rects: DataFrame, levels: DataFrame, changed: bool = False) -> DataFrame:
    """Tiles of every level that a rectangle touches; ``changed`` uses half-open bounds."""
    c = F.col
    rows = rects.join(levels, "map_id").where("rw > 0 and rh > 0")
    cover = F.pow(F.lit(2.0), c("level")) * TILE_SIZE
    lo = lambda v: F.greatest(F.lit(0), F.floor(c(v) / cover))
    if changed:
        hi = lambda v, w, n: F.least(c(n) - 1, F.ceil((c(v) + c(w)) / cover) - 1)
    else:
        hi = lambda v, w, n: F.least(c(n) - 1, F.floor((c(v) + c(w) - 1) / cover))
    rows = rows.withColumns({"_x0": lo("rx"), "_x1": hi("rx", "rw", "cols"), "_y0": lo("ry"), "_y1": hi("ry", "rh", "rows")})
    rows = rows.where("_x0 <= _x1 and _y0 <= _y1")
    rows = rows.withColumn("col", F.explode(F.sequence("_x0", "_x1"))).withColumn("row", F.explode(F.sequence("_y0", "_y1")))
    return rows.select("map_id", "rect_id", "level", "col", "row")


def level_for_region(rects: DataFrame, levels: DataFrame, cap: int = MAX_WORKING_SIDE * MAX_WORKING_SIDE) -> DataFrame:
    """Finest level at which a region stays within the pixel budget, else the coarsest."""
    c = F.col
    scale = F.pow(F.lit(2.0), c("level"))
    rows = rects.select("map_id", "rect_id", "rw", "rh").join(levels, "map_id")
    area = F.least(F.ceil(c("rw") / scale), c("width")) * F.least(F.ceil(c("rh") / scale), c("height"))
    fits = F.when(area <= cap, c("level"))
    best = rows.groupBy("map_id", "rect_id", "rw", "rh").agg(F.min(fits).alias("_fit"), F.max("level").alias("_top"))
    return best.select("map_id", "rect_id", F.when(c("rw") * c("rh") <= cap, 0).otherwise(F.coalesce("_fit", "_top")).alias("level"))


TILE = ["map_id", "z", "x", "y"]


def missing_tiles(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Planned tiles without a stored record, that is, what a resumed download still has to fetch."""
    return planned.join(stored.select(*TILE).distinct(), TILE, "left_anti")


def done_tiles(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Planned tiles that are stored; stored keys outside the plan do not count."""
    return planned.join(stored.select(*TILE).distinct(), TILE, "left_semi")


def storage_complete(planned: DataFrame, manifest: DataFrame, levels: DataFrame, stored: DataFrame) -> DataFrame:
    """Per planned map: does its manifest equal the plan, and is every needed tile stored?

    ``manifest`` has one row per tile with status (map), completed and missing flags; ``stored`` has
    (map_id, level, col, row).
    """
    c = F.col
    plan = planned.select(*TILE).distinct()
    kept = manifest.groupBy(*TILE).agg(F.max("completed").alias("completed"), F.max("missing").alias("missing"), F.max("status").alias("status"))
    both = plan.withColumn("_p", F.lit(1)).join(kept.withColumn("_m", F.lit(1)), TILE, "full")
    bad = c("_p").isNull() | c("_m").isNull() | ~F.coalesce("completed", F.lit(False)) | F.coalesce("missing", F.lit(False)) | (F.coalesce("status", F.lit("")) != "complete")
    per_map = both.groupBy("map_id").agg(F.count_if(bad).alias("bad_tiles"))
    base = planned.select("map_id", F.lit(0).cast("bigint").alias("level"), c("col").cast("bigint").alias("col"), c("row").cast("bigint").alias("row")).distinct()
    over = levels.where("level > 0").withColumn("col", F.explode(F.expr("sequence(0, cols - 1)"))).withColumn("row", F.explode(F.expr("sequence(0, rows - 1)")))
    need = base.unionByName(over.select("map_id", c("level").cast("bigint").alias("level"), c("col").cast("bigint").alias("col"), c("row").cast("bigint").alias("row")))
    have = stored.select("map_id", "level", "col", "row").distinct()
    gaps = need.join(have, ["map_id", "level", "col", "row"], "left_anti").groupBy("map_id").agg(F.count("*").alias("absent"))
    out = planned.select("map_id").distinct().join(per_map, "map_id", "left").join(gaps, "map_id", "left").fillna(0, ["absent"])
    return out.select("map_id", "bad_tiles", "absent", ((c("bad_tiles") == 0) & (c("absent") == 0)).alias("complete"))


def tile_estimate(planned: DataFrame, samples: DataFrame, done: DataFrame, quota: DataFrame) -> DataFrame:
    """Download size and time per map from the first three tiles' sizes, and whether it fits.

    ``samples`` has (map_id, row, col, bytes) with null bytes for tiles that were not available.
    """
    c = F.col
    first = top_by(samples, ["map_id"], [c("row"), c("col")], 3).groupBy("map_id").agg(F.avg("bytes").alias("average_bytes"), F.count("bytes").alias("sample_count"))
    size = planned.groupBy("map_id").agg(F.count("*").alias("planned"))
    have = done.groupBy("map_id").agg(F.count("*").alias("done"))
    rows = size.join(first, "map_id").join(have, "map_id", "left").join(quota, "map_id", "left").fillna(0, ["done"])
    est = F.ceil(c("average_bytes") * c("planned"))
    need = F.ceil(est * STORAGE_SAFETY)
    free = F.greatest(F.lit(0), F.greatest(c("quota"), F.lit(0)) - F.greatest(c("usage"), F.lit(0)))
    return rows.where("sample_count > 0").select(
        "map_id", "sample_count", "average_bytes", est.alias("estimated_bytes"), F.greatest(F.lit(1.0), (c("planned") - c("done")) / 5).alias("estimated_seconds"),
        need.alias("required_bytes"), (free >= need).alias("enough_space"),
    )


def within_coverage(boundaries: DataFrame, sources: DataFrame) -> DataFrame:
    """(map, source) pairs with every boundary point inside the source's extent.

    A boundary is inside exactly when its box is, so only boxes meet sources; ``sources`` is a
    catalogue whose size the caller has checked, and is left to the optimiser to broadcast.
    """
    c = F.col
    box = boundaries.groupBy("map_id").agg(
        F.min(mercator_x_m(c("lon"))).alias("_w"), F.max(mercator_x_m(c("lon"))).alias("_e"),
        F.min(mercator_y_m(c("lat"))).alias("_s"), F.max(mercator_y_m(c("lat"))).alias("_n"),
    )
    return _boxes_in_extents(box, sources).select("map_id", "source_id")


_COARSE_M = 200000.0


def _boxes_in_extents(box: DataFrame, sources: DataFrame) -> DataFrame:
    """Boxes (_w, _s, _e, _n) contained in extents, met through a coarse grid on the box corner."""
    c = F.col
    s = F.lit(_COARSE_M)
    limit = F.lit(HALF_WORLD_M)
    cell = lambda v: F.floor(v / s)
    ext = sources.withColumn("_gx", F.explode(F.sequence(cell(F.greatest(c("west"), -limit)), cell(F.least(c("east"), limit)))))
    ext = ext.withColumn("_gy", F.explode(F.sequence(cell(F.greatest(c("south"), -limit)), cell(F.least(c("north"), limit)))))
    own = box.withColumn("_gx", cell(c("_w"))).withColumn("_gy", cell(c("_s")))
    return own.join(ext, ["_gx", "_gy"]).where("_w >= west and _e <= east and _s >= south and _n <= north")


def control_grid(plans: DataFrame) -> DataFrame:
    """Nine exact control points of every tile plan: corners, edge middles and the centre."""
    c = F.col
    steps = F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))
    rows = plans.select("map_id", "z", "origin_x", "origin_y", "width", "height", F.posexplode(steps).alias("_r", "_fy"))
    rows = rows.select("*", F.posexplode(steps).alias("_c", "_fx"))
    rows = rows.withColumn("x", c("_fx") * c("width")).withColumn("y", c("_fy") * c("height"))
    return rows.select(
        "map_id", F.concat(F.lit("tile-anchor-"), (c("_r") * 3 + c("_c") + 1).cast("string")).alias("anchor_id"), "x", "y",
        world_lat(c("origin_y") + c("y"), c("z")).alias("lat"), world_lon(c("origin_x") + c("x"), c("z")).alias("lon"),
    )


def boundary_feature(boundaries: DataFrame, plans: DataFrame) -> DataFrame:
    """Boundary points in the pixels of their tile plan."""
    c = F.col
    rows = boundaries.join(plans.select("map_id", "z", "origin_x", "origin_y"), "map_id")
    return rows.select("map_id", "idx", (world_x(c("lon"), c("z")) - c("origin_x")).alias("x"), (world_y(c("lat"), c("z")) - c("origin_y")).alias("y"))


def attempt_state(attempt: Column, status: Column) -> Column:
    """What an attempt leaves its key in if it is the last one."""
    again = (status == 408) | (status == 429) | (status >= 500)
    ok = (status >= 200) & (status < 300)
    return F.when(ok, "completed").when(again & (attempt < MAX_ATTEMPTS), "retry").otherwise("missing")


def retry_plan(log: DataFrame) -> DataFrame:
    """Outcome of every key after its last attempt and, if it will be retried, the delay.

    One aggregate per key; ``u`` in the log is the caller's jitter draw in 0..1.
    """
    c = F.col
    last = log.groupBy("map_id", "key").agg(F.max(F.struct("attempt", "ts", "status", "retry_after_s", "u")).alias("l"))
    rows = last.select("map_id", "key", "l.*")
    rows = rows.withColumn("state", attempt_state(c("attempt"), c("status")))
    delay = F.when(c("state") == "retry", retry_delay_ms(c("attempt"), c("retry_after_s"), c("u")))
    return rows.select("map_id", "key", "attempt", "status", "state", delay.alias("delay_ms"))


def progress(log: DataFrame, plan: DataFrame) -> DataFrame:
    """Completed, missing and total keys per planned map. ``plan`` has (map_id, total)."""
    c = F.col
    keys = log.groupBy("map_id", "key").agg(F.max(c("status").between(200, 299)).alias("done"), F.max("attempt").alias("tries"), F.max_by("status", "attempt").alias("last"))
    retry = (c("last") == 408) | (c("last") == 429) | (c("last") >= 500)
    lost = ~c("done") & (~retry | (c("tries") >= MAX_ATTEMPTS))
    agg = keys.groupBy("map_id").agg(F.count_if("done").alias("completed"), F.count_if(lost).alias("missing"))
    out = plan.join(agg, "map_id", "left").fillna(0, ["completed", "missing"])
    return out.withColumn("finished", c("completed") + c("missing") >= c("total"))


