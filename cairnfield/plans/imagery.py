"""Queries: tiles, detail cells, frames, sources, download audits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cairnfield.functions import geo as G
from cairnfield.functions.plane import retry_delay_ms, working_size
from cairnfield.operators import imagery as I
from cairnfield.operators import tiles as T
from cairnfield.plans import corpus as C
from cairnfield.plans.corpus import VIEWS, with_views
from cairnfield.plans.fits import r
from cairnfield.plans.registry import query
from cairnfield.plans.sqlparts import on_segment

c = F.col
Z = 19
HALF = "20037508.342789244e0"


def wx(lon: str, z) -> str:
    return f"((({lon}) + 180) / 360e0 * 256 * pow(2, {z}))"


def wy(lat: str, z) -> str:
    s = f"sin(radians(greatest(-85.05112878e0, least(85.05112878e0, {lat}))))"
    return f"((0.5e0 - ln((1 + {s}) / (1 - {s})) / (4 * pi())) * 256 * pow(2, {z}))"


def cy(lat: str, z) -> str:
    s = f"greatest(-0.9999e0, least(0.9999e0, sin(radians({lat}))))"
    return f"((0.5e0 - ln((1 + {s}) / (1 - {s})) / (4 * pi())) * 256 * pow(2, {z}))"


def ilat(y: str, z) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y}) / (256 * pow(2, {z}))))))"


def ilon(x: str, z) -> str:
    return f"(({x}) / (256 * pow(2, {z})) * 360 - 180)"


def mx(lon: str) -> str:
    return f"(({lon}) * {HALF} / 180)"


def my(lat: str) -> str:
    return f"(ln(tan((({lat}) + 90) * pi() / 360)) * {HALF} / pi())"


def _cover_sql(z: int, side: int, buf: float) -> str:
    near = ""
    if buf:
        corners = " OR ".join(
            f"pow({x} - (x1 + ({t}) * (x2 - x1)), 2) + pow({y} - (y1 + ({t}) * (y2 - y1)), 2) <= pad * pad"
            for x, y in (("l", "t"), ("rr", "t"), ("rr", "b"), ("l", "b")) for t in [on_segment(x, y)]
        )
        away = lambda x, y: f"sqrt(pow(greatest(l - {x}, 0e0, {x} - rr), 2) + pow(greatest(t - {y}, 0e0, {y} - b), 2)) <= pad"
        near = f" OR {away('x1', 'y1')} OR {away('x2', 'y2')} OR {corners}"
    from cairnfield.plans.linework import _clip_sql

    hit = _clip_sql("l", "t", "rr", "b")
    inside = " OR ".join(
        f"(COUNT(*) FILTER ((y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0) + x1)) % 2 = 1"
        for x, y in (("l", "t"), ("rr", "t"), ("rr", "b"), ("l", "b"))
    )
    pad = f"{buf}e0 / greatest(0.01e0, cos(radians(AVG(lat)))) * 256 * pow(2, {z}) / 40075016.68557849e0" if buf else "0e0"
    return f"""(WITH w AS (SELECT map_id, idx, lat, {wx('lon', z)} AS x, {wy('lat', z)} AS y FROM boundaries),
ed AS (SELECT a.map_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM w a JOIN w b ON b.map_id = a.map_id AND b.idx = (a.idx + 1) % 4),
bx AS (SELECT map_id, {pad} AS pad, MIN(x) AS x0, MIN(y) AS y0, MAX(x) AS xx, MAX(y) AS yy FROM w GROUP BY map_id),
g AS (SELECT map_id, pad, CAST(floor((x0 - pad) / {side}) AS BIGINT) AS min_x, CAST(floor((y0 - pad) / {side}) AS BIGINT) AS min_y, CAST(floor((xx + pad) / {side}) AS BIGINT) AS max_x, CAST(floor((yy + pad) / {side}) AS BIGINT) AS max_y FROM bx),
s AS (SELECT *, x * {side}e0 AS l, y * {side}e0 AS t, (x + 1) * {side}e0 AS rr, (y + 1) * {side}e0 AS b FROM (SELECT *, unnest(range(min_x, max_x + 1)) AS x FROM (SELECT *, unnest(range(min_y, max_y + 1)) AS y FROM g)))
SELECT s.map_id, x, y, min_x, min_y, max_x, max_y FROM s JOIN ed ON ed.map_id = s.map_id GROUP BY s.map_id, x, y, min_x, min_y, max_x, max_y, l, t, rr, b, pad HAVING bool_or({hit}{near}) OR {inside})"""


VIEWS["tiles"] = (["boundaries"], f"SELECT map_id, {Z} AS z, x, y, x - min_x AS col, y - min_y AS row, min_x, min_y, max_x, max_y FROM {_cover_sql(Z, 256, 20.0)}")
VIEWS["cells"] = (["boundaries"], f"SELECT map_id, x, y FROM {_cover_sql(21, 2048, 0.0)}")
VIEWS["areas"] = (
    ["boundaries"],
    """SELECT map_id, abs(SUM(x1 * y2 - x2 * y1)) / 2 * pow(MAX(k), 2) AS area_m2 FROM (SELECT a.map_id, a.x - o.ox AS x1, a.y - o.oy AS y1, b.x - o.ox AS x2, b.y - o.oy AS y2, o.k FROM p a JOIN p b ON b.map_id = a.map_id AND b.idx = (a.idx + 1) % 4
  JOIN (SELECT map_id, AVG(x) AS ox, AVG(y) AS oy, cos(radians(AVG(lat))) AS k FROM p GROUP BY map_id) o ON o.map_id = a.map_id) GROUP BY map_id""",
)
VIEWS["p"] = (["boundaries"], "SELECT map_id, idx, lat, lon * 40075016.68557849e0 / 360 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 40075016.68557849e0 / (2 * pi()) AS y FROM boundaries")
VIEWS["areas"] = (["p"], VIEWS["areas"][1])
VIEWS["sources"] = (
    [],
    """SELECT n_nationkey AS source_id, CASE n_nationkey % 3 WHEN 0 THEN 0.0762e0 WHEN 1 THEN 0.3e0 ELSE 1e0 END AS resolution_m, 1024 + 512 * (n_nationkey % 3) AS max_w, 1024 + 512 * (n_nationkey % 2) AS max_h,
  -8990000e0 + n_nationkey * 3000 AS west, 3100000e0 + n_nationkey * 500 AS south, -8900000e0 + n_nationkey * 3000 AS east, 3170000e0 + n_nationkey * 500 AS north FROM nation""",
)
VIEWS["mframes"] = (["frames"], f"SELECT frame_id, {mx('west')} AS west, {my('south')} AS south, {mx('east')} AS east, {my('north')} AS north FROM frames")


def sources(spark, sf):
    k = c("n_nationkey")
    return C.table(spark, sf, "nation").select(
        k.cast("bigint").alias("source_id"), F.when(k % 3 == 0, 0.0762).when(k % 3 == 1, 0.3).otherwise(1.0).alias("resolution_m"),
        (k % 3 * 512 + 1024).alias("max_w"), (k % 2 * 512 + 1024).alias("max_h"), (k * 3000 - F.lit(8990000.0)).alias("west"),
        (k * 500 + F.lit(3100000.0)).alias("south"), (k * 3000 - F.lit(8900000.0)).alias("east"), (k * 500 + F.lit(3170000.0)).alias("north"),
    )


def rounded(df, cols, digits):
    return df.withColumns({n: r(c(n), digits) for n in cols})


@query("f06_mercator", with_views("boundaries", f"""SELECT map_id, idx, round({wx('lon', 18)}, 3) AS x, round({wy('lat', 18)}, 3) AS y, round({ilon(wx('lon', 18), 18)}, 6) AS lon, round({ilat(wy('lat', 18), 18)}, 6) AS lat,
  round(40075016.686e0 * cos(radians(lat)) / (256 * pow(2, 18)), 8) AS resolution, round({mx('lon')}, 2) AS mx, round({my('lat')}, 2) AS my FROM boundaries"""))
def _(spark, sf):
    x, y = G.world_x(c("lon"), 18), G.world_y(c("lat"), 18)
    return C.boundaries(spark, sf).select(
        "map_id", "idx", r(x, 3).alias("x"), r(y, 3).alias("y"), r(G.world_lon(x, 18), 6).alias("lon"), r(G.world_lat(y, 18), 6).alias("lat"),
        r(G.ground_resolution(c("lat"), 18), 8).alias("resolution"), r(G.mercator_x_m(c("lon")), 2).alias("mx"), r(G.mercator_y_m(c("lat")), 2).alias("my"),
    )


@query("f07_tile_keys", with_views("boundaries", f"""SELECT map_id, idx, '19/' || CAST(floor({wx('lon', 19)} / 256) AS BIGINT) || '/' || CAST(floor({wy('lat', 19)} / 256) AS BIGINT) AS tile_key,
  CAST(floor({wx('lon', 21)} / 2048) AS BIGINT) || '/' || CAST(floor({wy('lat', 21)} / 2048) AS BIGINT) AS cell_key, round({ilat(f"floor({wy('lat', 19)} / 256 + 1) * 256", 19)}, 7) AS south FROM boundaries"""))
def _(spark, sf):
    tx, ty = F.floor(G.world_x(c("lon"), 19) / 256), F.floor(G.world_y(c("lat"), 19) / 256)
    quad = G.tile_quad(tx * 256, ty * 256, (tx + 1) * 256, (ty + 1) * 256, 19)
    return C.boundaries(spark, sf).select(
        "map_id", "idx", G.tile_key(F.lit(19), tx, ty).alias("tile_key"), G.cell_key(G.detail_cell_x(c("lon")), G.detail_cell_y(c("lat"))).alias("cell_key"),
        r(quad[0]["lat"], 7).alias("south"),
    )


@query("f10_working_size", "SELECT p_partkey, CAST(greatest(1, floor(w * k + 0.5e0)) AS INTEGER) AS width, CAST(greatest(1, floor(h * k + 0.5e0)) AS INTEGER) AS height, k < 1 AS scaled FROM (SELECT *, least(1e0, 7000e0 / greatest(w, h)) AS k FROM (SELECT p_partkey, 100 + (p_partkey * 37) % 12000 AS w, 100 + (p_partkey * 91) % 9000 AS h FROM part))")
def _(spark, sf):
    k = c("p_partkey")
    s = working_size(k * 37 % 12000 + 100, k * 91 % 9000 + 100)
    return C.table(spark, sf, "part").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"), s["scaled"].alias("scaled"))


@query("f11_retry_delay", with_views("requests", "SELECT event_id, greatest(floor(least(60000e0, 1000e0 * pow(2, attempt - 1)) * (0.5e0 + (event_id % 100) / 100e0 * 0.5e0) + 0.5e0), COALESCE(retry_after_s * 1000, 0e0)) AS delay_ms FROM requests"))
def _(spark, sf):
    u = c("event_id") % 100 / 100
    return C.requests(spark, sf).select("event_id", retry_delay_ms(c("attempt"), c("retry_after_s"), u).alias("delay_ms"))


@query("f12_extents", with_views("frames", f"""SELECT frame_id, round({mx('west')}, 2) AS west, round(ln(tan((south + 90) * pi() / 360)) * {HALF} / pi(), 2) AS south FROM frames"""))
def _(spark, sf):
    x, y = G.geographic_to_mercator(c("west"), c("south"))
    return C.frames(spark, sf).select("frame_id", r(x, 2).alias("west"), r(y, 2).alias("south"))


def _albers_sql() -> str:
    """Inverse of EPSG:3087 by the textbook's latitude series of steps, eight of them."""
    # fixed values: EPSG:3087 parameters
    a, flat, lat_1, lat_2, lat_0 = 6378137.0, 1 / 298.257222101, 24.0, 31.5, 24.0
    e2 = flat * (2 - flat)
    e = e2**0.5
    sine = lambda d: math.sin(math.radians(d))
    q = lambda d: (1 - e2) * (sine(d) / (1 - e2 * sine(d) ** 2) + math.atanh(e * sine(d)) / e)
    m2 = lambda d: math.cos(math.radians(d)) ** 2 / (1 - e2 * sine(d) ** 2)
    n = (m2(lat_1) - m2(lat_2)) / (q(lat_2) - q(lat_1))
    top = m2(lat_1) + n * q(lat_1)
    rho = a * math.sqrt(top - n * q(lat_0)) / n
    step = f"pow(1 - {e2!r}e0 * s * s, 2) / (2 * cos(phi)) * (q / {1 - e2!r}e0 - s / (1 - {e2!r}e0 * s * s) + ln((1 - {e!r}e0 * s) / (1 + {e!r}e0 * s)) / {2 * e!r}e0)"
    return f"""WITH RECURSIVE p AS (SELECT s_suppkey AS frame_id, s_suppkey * 5000 % 700000 - 300000e0 AS dx, {rho!r}e0 - (s_suppkey * 7000 % 800000 + 50000e0) AS dy FROM supplier),
w AS (SELECT frame_id, dx, dy, ({top!r}e0 - (dx * dx + dy * dy) * {(n / a) ** 2!r}) / {n!r}e0 AS q FROM p),
walk AS (SELECT *, asin(q / 2) AS phi, 0 AS k FROM w UNION ALL SELECT frame_id, dx, dy, q, phi + {step}, k + 1 FROM (SELECT *, sin(phi) AS s FROM walk) WHERE k < 8)
SELECT frame_id, round((degrees(atan2(dx, dy) / {n!r}e0) - 84) * {HALF} / 180, 1) AS x, round(ln(tan(pi() / 4 + phi / 2)) * {HALF} / pi(), 1) AS y FROM walk WHERE k = 8"""


@query("f12_state_plane_extents", _albers_sql())
def _(spark, sf):
    k = c("s_suppkey")
    x, y = G.florida_albers_to_mercator(k * 5000 % 700000 + F.lit(100000.0), k * 7000 % 800000 + F.lit(50000.0))
    return C.table(spark, sf, "supplier").select(k.alias("frame_id"), r(x, 1).alias("x"), r(y, 1).alias("y"))


@query("g05_ground_area", with_views("areas", "SELECT map_id, round(area_m2, 1) AS area_m2 FROM areas"))
def _(spark, sf):
    return rounded(T.ground_area(C.boundaries(spark, sf)), ["area_m2"], 1)


@query("j07_tile_cover", with_views("tiles", "SELECT map_id, z, x, y, col, row FROM tiles"))
def _(spark, sf):
    return T.tile_cover(C.boundaries(spark, sf), Z)


@query("j07_detail_cells", with_views("cells", "SELECT map_id, x, y FROM cells"))
def _(spark, sf):
    return T.detail_cells(C.boundaries(spark, sf)).select("map_id", "x", "y")


@query("i04_tile_plans", with_views("tiles areas", f"""SELECT t.map_id, z, min_x * 256 AS origin_x, min_y * 256 AS origin_y, (max_x - min_x + 1) * 256 AS width, (max_y - min_y + 1) * 256 AS height, n AS tile_count,
  round({ilon('min_x * 256', Z)}, 7) AS west, round({ilat('min_y * 256', Z)}, 7) AS north, round({ilat('(max_y + 1) * 256', Z)}, 7) AS south, round(area_m2, 1) AS area_m2
FROM (SELECT map_id, z, min_x, min_y, max_x, max_y, COUNT(*) AS n FROM tiles GROUP BY ALL) t JOIN areas a ON a.map_id = t.map_id"""))
def _(spark, sf):
    p = T.tile_plans(C.boundaries(spark, sf), Z).drop("east", "cols", "rows")
    return rounded(rounded(p, ["west", "north", "south"], 7), ["area_m2"], 1)


@query("i05_plan_detail", with_views("cells areas", "SELECT c.map_id, cells, round(area_m2, 1) AS area_m2, cells > 40 AS over_limit FROM (SELECT map_id, COUNT(*) AS cells FROM cells GROUP BY map_id) c JOIN areas a ON a.map_id = c.map_id"))
def _(spark, sf):
    return rounded(T.plan_detail(C.boundaries(spark, sf)), ["area_m2"], 1)


@query("u02_tile_functions", with_views("boundaries", """SELECT map_id, idx, CAST(i % 8 AS INTEGER) AS export_col, CAST(i // 8 AS INTEGER) AS export_row, (map_id * 8 + i % 8) AS x, (idx * 8 + i // 8) AS y FROM boundaries, (SELECT unnest(range(64)) AS i)"""))
def _(spark, sf):
    from cairnfield.functions.sql import register_functions

    register_functions(spark)
    C.boundaries(spark, sf).createOrReplaceTempView("cairn_boundaries")
    return spark.sql("SELECT map_id, idx, t.export_col, t.export_row, t.x, t.y FROM cairn_boundaries, LATERAL cairn_detail_tiles(map_id, idx) t")


@query("u01_sql_functions", with_views("usable means", """SELECT u.map_id, anchor_id, round(12756274e0 * asin(least(1e0, sqrt(pow(sin(radians(mlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(mlat)) * pow(sin(radians(mlon - lon) / 2), 2)))), 3) AS d,
  CAST(floor(256 * pow(2, 18) * (lon + 180) / 360 / 256) AS BIGINT) AS tx FROM usable u JOIN means m ON m.map_id = u.map_id"""))
def _(spark, sf):
    from cairnfield.functions.sql import register_functions
    from cairnfield.operators.anchors import usable_anchors

    register_functions(spark)
    a = usable_anchors(C.anchors(spark, sf))
    mid = a.groupBy("map_id").agg(F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    return a.join(mid, "map_id").selectExpr("map_id", "anchor_id", "round(cairn_haversine_m(lat, lon, mlat, mlon), 3) AS d", "cairn_tile_x(lon, 18) AS tx")


@query("t16_control_grid", with_views("tiles", f"""SELECT map_id, 'tile-anchor-' || (rr * 3 + cc + 1) AS anchor_id, x, y, round({ilat('min_y * 256 + y', Z)}, 7) AS lat, round({ilon('min_x * 256 + x', Z)}, 7) AS lon FROM (
  SELECT *, cc / 2e0 * (max_x - min_x + 1) * 256 AS x, rr / 2e0 * (max_y - min_y + 1) * 256 AS y FROM (SELECT DISTINCT map_id, min_x, min_y, max_x, max_y FROM tiles), (SELECT unnest(range(3)) AS rr), (SELECT unnest(range(3)) AS cc))"""))
def _(spark, sf):
    return rounded(T.control_grid(T.tile_plans(C.boundaries(spark, sf), Z)), ["lat", "lon"], 7)


@query("t16_boundary_feature", with_views("tiles boundaries", f"SELECT b.map_id, b.idx, round({wx('lon', Z)} - min_x * 256, 3) AS x, round({wy('lat', Z)} - min_y * 256, 3) AS y FROM boundaries b JOIN (SELECT DISTINCT map_id, min_x, min_y FROM tiles) t ON t.map_id = b.map_id"))
def _(spark, sf):
    b = C.boundaries(spark, sf)
    return rounded(T.boundary_feature(b, T.tile_plans(b, Z)), ["x", "y"], 3)


def _stored(tiles):
    return tiles.where("(x * 7 + y * 3) % 5 <> 0").unionByName(tiles.where("(x + y) % 9 = 0").withColumn("z", F.lit(Z + 1)))


_STORED = "(SELECT map_id, z, x, y FROM tiles WHERE (x * 7 + y * 3) % 5 <> 0)"


@query("j09_missing_tiles", with_views("tiles", f"SELECT t.map_id, t.z, t.x, t.y, col, row FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM {_STORED} s WHERE s.map_id = t.map_id AND s.x = t.x AND s.y = t.y)"))
def _(spark, sf):
    t = T.tile_cover(C.boundaries(spark, sf), Z)
    return T.missing_tiles(t, _stored(t))


@query("j09_done_tiles", with_views("tiles", f"SELECT map_id, COUNT(*) AS done FROM {_STORED} GROUP BY map_id"))
def _(spark, sf):
    t = T.tile_cover(C.boundaries(spark, sf), Z)
    return T.done_tiles(t, _stored(t)).groupBy("map_id").agg(F.count("*").alias("done"))


@query("s09_stored_tiles", with_views("tiles", "SELECT map_id, COUNT(*) AS completed FROM tiles WHERE map_id % 3 = 0 OR (x + y) % 4 <> 0 GROUP BY map_id"))
def _(spark, sf):
    """Manifests keep keys as rows: explode a completed-key array per map and count the tiles."""
    from cairnfield.sources.tiles import manifest_rows

    t = T.tile_cover(C.boundaries(spark, sf), Z).where("map_id % 3 = 0 or (x + y) % 4 <> 0")
    docs = t.groupBy("map_id", "row").agg(F.collect_list(G.tile_key(c("z"), c("x"), c("y"))).alias("completed_keys"))
    return manifest_rows(docs).groupBy("map_id").agg(F.count("*").alias("completed"))


@query("o02_storage_complete", with_views("tiles", """SELECT t.map_id, COUNT(*) FILTER (t.map_id % 3 <> 0 AND (x + y) % 4 = 0) AS bad_tiles, COUNT(*) FILTER (t.map_id % 2 <> 0 AND (x + y) % 6 = 0) AS absent,
  COUNT(*) FILTER (t.map_id % 3 <> 0 AND (x + y) % 4 = 0) = 0 AND COUNT(*) FILTER (t.map_id % 2 <> 0 AND (x + y) % 6 = 0) = 0 AS complete FROM tiles t GROUP BY t.map_id"""))
def _(spark, sf):
    t = T.tile_cover(C.boundaries(spark, sf), Z)
    m = t.withColumn("completed", (c("map_id") % 3 == 0) | ((c("x") + c("y")) % 4 != 0)).withColumn("missing", F.lit(False)).withColumn("status", F.lit("complete"))
    sizes = t.groupBy("map_id").agg(((F.max("col") + 1) * 256).alias("width"), ((F.max("row") + 1) * 256).alias("height"))
    have = t.where("map_id % 2 = 0 or (x + y) % 6 <> 0").withColumn("level", F.lit(0).cast("bigint"))
    return T.storage_complete(t, m, T.pyramid_levels(sizes), have)


@query("g27_tile_estimate", with_views("tiles", """WITH s AS (SELECT *, CASE WHEN (x + y) % 7 = 0 THEN NULL ELSE 9000 + (x * 13 + y * 7) % 5000 END AS bytes, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY row, col) AS rn FROM tiles),
a AS (SELECT map_id, AVG(bytes) AS avg_b, COUNT(bytes) AS k FROM s WHERE rn <= 3 GROUP BY map_id), n AS (SELECT map_id, COUNT(*) AS planned, COUNT(*) FILTER ((x * 7 + y * 3) % 5 <> 0) AS done FROM tiles GROUP BY map_id)
SELECT n.map_id, k AS sample_count, round(avg_b, 3) AS average_bytes, CAST(ceil(avg_b * planned) AS BIGINT) AS estimated_bytes, greatest(1e0, (planned - done) / 5e0) AS estimated_seconds, CAST(ceil(ceil(avg_b * planned) * 1.5e0) AS BIGINT) AS required_bytes,
  greatest(0, (n.map_id * 10000) - 50000) >= ceil(ceil(avg_b * planned) * 1.5e0) AS enough_space FROM n JOIN a ON a.map_id = n.map_id WHERE k > 0"""))
def _(spark, sf):
    t = T.tile_cover(C.boundaries(spark, sf), Z)
    size = F.when((c("x") + c("y")) % 7 == 0, F.lit(None)).otherwise((c("x") * 13 + c("y") * 7) % 5000 + 9000)
    quota = t.select("map_id").distinct().withColumn("quota", c("map_id") * 10000).withColumn("usage", F.lit(50000))
    e = T.tile_estimate(t, t.withColumn("bytes", size), t.where("(x * 7 + y * 3) % 5 <> 0"), quota)
    return rounded(e, ["average_bytes"], 3)


_LEVELS = "(SELECT map_id, level, width, height, CAST(ceil(width / 256e0) AS BIGINT) AS cols, CAST(ceil(height / 256e0) AS BIGINT) AS rows FROM (SELECT map_id, level, CAST(ceil(w / pow(2, level)) AS BIGINT) AS width, CAST(ceil(h / pow(2, level)) AS BIGINT) AS height FROM (SELECT *, unnest(range(CAST(greatest(0, ceil(log2(greatest(w, h) / 4096e0))) AS BIGINT) + 1)) AS level FROM (SELECT p_partkey AS map_id, 3000 + (p_partkey * 37) % 40000 AS w, 2000 + (p_partkey * 91) % 30000 AS h FROM part))))"


def _big_maps(spark, sf):
    k = c("p_partkey")
    return C.table(spark, sf, "part").select(k.alias("map_id"), (k * 37 % 40000 + 3000).alias("width"), (k * 91 % 30000 + 2000).alias("height"))


@query("r13_pyramid_levels", f"SELECT map_id, CAST(level AS INTEGER) AS level, width, height, cols, rows FROM {_LEVELS}")
def _(spark, sf):
    return T.pyramid_levels(_big_maps(spark, sf))


def _rects(spark, sf):
    k = c("p_partkey")
    d = lambda e: e.cast("double")
    return C.table(spark, sf, "part").select(
        k.alias("map_id"), k.alias("rect_id"), d(k * 53 % 9000).alias("rx"), d(k * 29 % 7000).alias("ry"), d(k * 17 % 3000 + 1).alias("rw"), d(k * 71 % 2500 + 1).alias("rh")
    )


_RECTS = "(SELECT p_partkey AS map_id, (p_partkey * 53) % 9000 AS rx, (p_partkey * 29) % 7000 AS ry, (p_partkey * 17) % 3000 + 1 AS rw, (p_partkey * 71) % 2500 + 1 AS rh FROM part)"


def _region_sql(changed: bool) -> str:
    hi = (lambda v, w, n: f"least({n} - 1, ceil(({v} + {w}) / k) - 1)") if changed else (lambda v, w, n: f"least({n} - 1, floor(({v} + {w} - 1) / k))")
    return f"""SELECT map_id, map_id AS rect_id, CAST(level AS INTEGER) AS level, col, row FROM (SELECT *, unnest(range(y0, y1 + 1)) AS row FROM (SELECT *, unnest(range(x0, x1 + 1)) AS col FROM (
  SELECT r.map_id, level, CAST(greatest(0, floor(rx / k)) AS BIGINT) AS x0, CAST(greatest(0, floor(ry / k)) AS BIGINT) AS y0, CAST({hi('rx', 'rw', 'cols')} AS BIGINT) AS x1, CAST({hi('ry', 'rh', 'rows')} AS BIGINT) AS y1
  FROM {_RECTS} r JOIN (SELECT *, 256e0 * pow(2, level) AS k FROM {_LEVELS}) l ON l.map_id = r.map_id)))"""


@query("j08_tiles_for_region", _region_sql(False))
def _(spark, sf):
    return T.tiles_for_region(_rects(spark, sf), T.pyramid_levels(_big_maps(spark, sf)))


@query("j08_tiles_for_changed_region", _region_sql(True))
def _(spark, sf):
    return T.tiles_for_region(_rects(spark, sf), T.pyramid_levels(_big_maps(spark, sf)), changed=True)


@query("k06_level_for_region", f"""SELECT r.map_id, r.map_id AS rect_id, CAST(CASE WHEN rw * rh <= 2000000 THEN 0 ELSE COALESCE(MIN(CASE WHEN least(ceil(rw / pow(2, level)), width) * least(ceil(rh / pow(2, level)), height) <= 2000000 THEN level END), MAX(level)) END AS INTEGER) AS level
FROM {_RECTS} r JOIN {_LEVELS} l ON l.map_id = r.map_id GROUP BY r.map_id, rw, rh""")
def _(spark, sf):
    return T.level_for_region(_rects(spark, sf), T.pyramid_levels(_big_maps(spark, sf)), 2000000)


@query("p11_within_coverage", with_views("boundaries sources", f"""SELECT map_id, source_id FROM boundaries b CROSS JOIN sources s GROUP BY map_id, source_id
HAVING bool_and({mx('lon')} BETWEEN west AND east AND {my('lat')} BETWEEN south AND north)"""))
def _(spark, sf):
    return T.within_coverage(C.boundaries(spark, sf), sources(spark, sf))


@query("j10_match_sources", with_views("mframes sources", """SELECT frame_id, source_id, resolution_m FROM (SELECT frame_id, source_id, resolution_m, ROW_NUMBER() OVER (PARTITION BY frame_id ORDER BY resolution_m, source_id) AS rn
FROM mframes f JOIN sources s ON f.west >= s.west AND f.east <= s.east AND f.south >= s.south AND f.north <= s.north) WHERE rn = 1"""))
def _(spark, sf):
    return I.match_sources(I.mercator_frames(C.frames(spark, sf)), sources(spark, sf), best_only=True)


@query("j11_local_detail_tiles", with_views("cells tiles", """SELECT map_id, x, y, export_col, export_row, col, row FROM (SELECT c.map_id, c.x * 8 + i % 8 AS x, c.y * 8 + i // 8 AS y, CAST(i % 8 AS INTEGER) AS export_col, CAST(i // 8 AS INTEGER) AS export_row, c.x * 8 + i % 8 - min_x * 4 AS col, c.y * 8 + i // 8 - min_y * 4 AS row, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h
  FROM cells c JOIN (SELECT DISTINCT map_id, min_x, min_y, max_x, max_y FROM tiles) t ON t.map_id = c.map_id, (SELECT unnest(range(64)) AS i)) WHERE col >= 0 AND row >= 0 AND col < w * 4 AND row < h * 4"""))
def _(spark, sf):
    b = C.boundaries(spark, sf)
    # The z19 plan's box in z20 pixels gives the saved map's extent.
    m = T.tile_plans(b, Z).select("map_id", F.lit(20).alias("source_zoom"), F.lit(256).alias("tile_size"), *[(c(n) * 2).alias(n) for n in ("origin_x", "origin_y", "width", "height")])
    return T.local_detail_tiles(T.detail_cells(b).select("map_id", "x", "y"), m)


@query("k04_cell_neighbourhood", with_views("fixes", f"""SELECT event_id, CAST(rn - 1 AS INTEGER) AS rank, x, y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY round(d, 6), other, y, x) AS rn FROM (
  SELECT event_id, cx + dx AS x, cyy + dy AS y, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END AS other, sqrt(pow(greatest((cx + dx) * 2048 - fx, 0e0, fx - (cx + dx + 1) * 2048), 2) + pow(greatest((cyy + dy) * 2048 - fy, 0e0, fy - (cyy + dy + 1) * 2048), 2)) AS d
  FROM (SELECT event_id, {wx('lon', 21)} AS fx, {wy('lat', 21)} AS fy, CAST(floor({wx('lon', 21)} / 2048) AS BIGINT) AS cx, CAST(floor({wy('lat', 21)} / 2048) AS BIGINT) AS cyy FROM fixes), (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)))"""))
def _(spark, sf):
    return T.cell_neighbourhood(C.fixes(spark, sf), ["event_id"]).drop("distance")


_DIMS = f"""(SELECT *, greatest(1, floor(x1 - x0 + 0.5e0)) AS width, greatest(1, floor(y1 - y0 + 0.5e0)) AS height, greatest(1, floor((x1 - 0.0001e0) / 256) - floor(x0 / 256) + 1) * greatest(1, floor((y1 - 0.0001e0) / 256) - floor(y0 / 256) + 1) AS tiles FROM (
  SELECT *, {wx('west', 'z')} AS x0, {cy('north', 'z')} AS y0, {wx('east', 'z')} AS x1, {cy('south', 'z')} AS y1 FROM {{src}}))"""


@query("i01_capture_dims", with_views("frames", f"SELECT frame_id, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(tiles AS BIGINT) AS tile_count, round(40075016.686e0 * cos(radians((north + south) / 2)) / (256 * pow(2, 15)), 6) AS meters_per_pixel FROM {_DIMS.format(src='(SELECT *, 15 AS z FROM frames)')}"))
def _(spark, sf):
    d = I.capture_dims(C.frames(spark, sf), 15)
    return rounded(d.select("frame_id", "width", "height", "tile_count", "meters_per_pixel"), ["meters_per_pixel"], 6)


@query("k06_optimal_zoom", with_views("frames", f"SELECT frame_id, CAST(COALESCE(MAX(CASE WHEN greatest(width, height) <= 8192 AND tiles <= 256 THEN z END), 0) AS INTEGER) AS zoom FROM {_DIMS.format(src='(SELECT *, unnest(range(17)) AS z FROM frames)')} GROUP BY frame_id"))
def _(spark, sf):
    return I.optimal_zoom(C.frames(spark, sf))


@query("i02_capture_requests", with_views("frames", f"""SELECT frame_id, x, y, least(1000, CAST(width AS BIGINT) - x) AS width, least(1000, CAST(height AS BIGINT) - y) AS height, round((x0 + x) / k - 20037508.343e0, 2) AS west, round(20037508.343e0 - (y0 + y) / k, 2) AS north
FROM (SELECT *, 256 * pow(2, 15) / 40075016.686e0 AS k, unnest(range(0, CAST(width AS BIGINT), 1000)) AS x FROM (SELECT *, unnest(range(0, CAST(height AS BIGINT), 1000)) AS y FROM {_DIMS.format(src='(SELECT *, 15 AS z FROM frames)')}))"""))
def _(spark, sf):
    q = I.capture_requests(C.frames(spark, sf), 15, 1000)
    return rounded(q.select("frame_id", "x", "y", "width", "height", "west", "north"), ["west", "north"], 2)


@query("i02_plan_requests", with_views("mframes sources", """SELECT frame_id, source_id, x, y, least(max_w, w - x) AS width, least(max_h, h - y) AS height, round(west + x * px, 2) AS west, round(north - y * px, 2) AS north FROM (SELECT *, unnest(range(0, w, max_w)) AS x FROM (SELECT *, unnest(range(0, h, max_h)) AS y FROM (
  SELECT f.*, source_id, max_w, max_h, greatest(2e0, resolution_m) AS px, CAST(ceil((f.east - f.west) / greatest(2e0, resolution_m)) AS BIGINT) AS w, CAST(ceil((f.north - f.south) / greatest(2e0, resolution_m)) AS BIGINT) AS h FROM mframes f JOIN sources s ON s.source_id = f.frame_id % 25)))"""))
def _(spark, sf):
    f = I.mercator_frames(C.frames(spark, sf)).withColumn("source_id", c("frame_id") % 25)
    q = I.plan_requests(f, sources(spark, sf), 2.0)
    return rounded(q.select("frame_id", "source_id", "x", "y", "width", "height", "west", "north"), ["west", "north"], 2)


# With sides under the cap, 4 x 4 requests of 2048 pixels always do, so only the longer side decides.
@query("i03_achievable_resolution", with_views("mframes", "SELECT frame_id, round(CASE WHEN side <= 0.3e0 * 8192 THEN 0.3e0 ELSE side / 8192 * 1.02e0 END, 6) AS resolution_m FROM (SELECT frame_id, greatest(east - west, north - south) AS side FROM mframes)"))
def _(spark, sf):
    f = I.mercator_frames(C.frames(spark, sf)).withColumns({"resolution_m": F.lit(0.3), "max_w": F.lit(2048), "max_h": F.lit(2048)})
    return rounded(I.achievable_resolution(f, 8192, 16), ["resolution_m"], 6)


@query("i03_fractional_zoom", with_views("frames", """WITH RECURSIVE walk AS (SELECT frame_id, (east - west) / 360 AS wide, (ln((1 + sin(radians(north))) / (1 - sin(radians(north)))) - ln((1 + sin(radians(south))) / (1 - sin(radians(south))))) / (4 * pi()) AS high,
  log2(cos(radians((north + south) / 2)) * 40075016.686e0 / (256 * 0.3e0)) AS z, 0 AS k FROM frames
 UNION ALL SELECT frame_id, wide, high, CASE WHEN greatest(w, h) <= 12000 AND ceil(w / 4000) * ceil(h / 4000) <= 16 THEN z ELSE z + log2(12000e0 / greatest(w, h)) - 0.000001e0 END, k + 1
  FROM (SELECT *, greatest(1e0, floor(wide * 256 * pow(2, z) + 0.5e0)) AS w, greatest(1e0, floor(high * 256 * pow(2, z) + 0.5e0)) AS h FROM walk) WHERE k < 12)
SELECT frame_id, round(greatest(0e0, z), 6) AS zoom FROM walk WHERE k = 12"""))
def _(spark, sf):
    return rounded(I.naip_zoom(C.frames(spark, sf)), ["zoom"], 6)
