"""The same expressions for SQL users: scalar and table functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cairnfield.constants import BASE_DELAY_MS, CAPTURE_CIRCUMFERENCE_M, DETAIL_CELL_PX, DETAIL_ZOOM, HALF_WORLD_M, MAX_DELAY_MS, MAX_MERCATOR_LAT, MAX_WORKING_SIDE, TILE_SIZE

SCALARS = {
    "cairn_haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
        "(SELECT if(chord IS NULL, NULL, 12756274D * asin(least(1D, chord))) FROM (SELECT sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)) AS chord))"
    ),
    "cairn_tile_x(lon DOUBLE, z INT) RETURNS BIGINT": "floor((lon + 180) / 360 * pow(2, z))",
    "cairn_tile_y(lat DOUBLE, z INT) RETURNS BIGINT": (
        "floor((0.5D - ln((1 + sin(radians(least(85.05112878D, greatest(-85.05112878D, lat)))))"
        " / (1 - sin(radians(least(85.05112878D, greatest(-85.05112878D, lat)))))) / (4 * pi())) * pow(2, z))"
    ),
    "cairn_tile_key(z INT, x BIGINT, y BIGINT) RETURNS STRING": "concat_ws('/', z, x, y)",
    "cairn_color_distance(r1 DOUBLE, g1 DOUBLE, b1 DOUBLE, r2 DOUBLE, g2 DOUBLE, b2 DOUBLE) RETURNS DOUBLE": (
        "sqrt(pow(r1 - r2, 2) + pow(g1 - g2, 2) + pow(b1 - b2, 2))"
    ),
    "cairn_luminance(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE": "(0.2126D * r + 0.7152D * g + 0.0722D * b) / 255",
    "cairn_slug(name STRING) RETURNS STRING": (
        "coalesce(nullif(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-'), '^-|-$', ''), ''), 'park-map')"
    ),
    "cairn_world_x(lon DOUBLE, z DOUBLE) RETURNS DOUBLE": f"(lon + 180) / 360 * pow(2, z) * {TILE_SIZE}",
    "cairn_world_y(lat DOUBLE, z DOUBLE) RETURNS DOUBLE": (
        f"(SELECT (0.5D - ln((1 + s) / (1 - s)) / (4 * pi())) * pow(2, z) * {TILE_SIZE}"
        f" FROM (SELECT sin(radians(greatest(least(lat, {MAX_MERCATOR_LAT}D), -{MAX_MERCATOR_LAT}D))) AS s WHERE lat IS NOT NULL))"
    ),
    "cairn_world_lon(x DOUBLE, z DOUBLE) RETURNS DOUBLE": f"x / (pow(2, z) * {TILE_SIZE}) * 360 - 180",
    "cairn_world_lat(y DOUBLE, z DOUBLE) RETURNS DOUBLE": f"degrees(atan(sinh((1 - 2 * y / (pow(2, z) * {TILE_SIZE})) * pi())))",
    "cairn_ground_resolution(lat DOUBLE, z DOUBLE) RETURNS DOUBLE": f"cos(radians(lat)) * {CAPTURE_CIRCUMFERENCE_M!r}D / (pow(2, z) * {TILE_SIZE})",
    "cairn_mercator_x_m(lon DOUBLE) RETURNS DOUBLE": f"lon * {HALF_WORLD_M!r}D / 180",
    "cairn_mercator_y_m(lat DOUBLE) RETURNS DOUBLE": (
        f"if(lat IS NULL, NULL, ln(tan((greatest(least(lat, {MAX_MERCATOR_LAT}D), -{MAX_MERCATOR_LAT}D) + 90) * pi() / 360)) * {HALF_WORLD_M!r}D / pi())"
    ),
    "cairn_detail_cell_x(lon DOUBLE) RETURNS BIGINT": f"floor(cairn_world_x(lon, {DETAIL_ZOOM}) / {DETAIL_CELL_PX})",
    "cairn_detail_cell_y(lat DOUBLE) RETURNS BIGINT": f"floor(cairn_world_y(lat, {DETAIL_ZOOM}) / {DETAIL_CELL_PX})",
    "cairn_cell_key(x BIGINT, y BIGINT) RETURNS STRING": "concat_ws('/', x, y)",
    "cairn_distance2(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE": "(x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)",
    "cairn_segment_t(px DOUBLE, py DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE": (
        "CASE WHEN px + py + x1 + y1 + x2 + y2 IS NULL THEN NULL WHEN x1 = x2 AND y1 = y2 THEN 0D ELSE least(1D, greatest(0D,"
        " ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(cairn_distance2(x1, y1, x2, y2), 0D))) END"
    ),
    "cairn_working_width(width DOUBLE, height DOUBLE) RETURNS INT": f"greatest(1, int(floor(width * least(1D, {MAX_WORKING_SIDE}D / greatest(width, height)) + 0.5D)))",
    "cairn_working_height(width DOUBLE, height DOUBLE) RETURNS INT": "cairn_working_width(height, width)",
    "cairn_retry_delay_ms(attempt INT, retry_after_s DOUBLE, u DOUBLE) RETURNS DOUBLE": (
        f"greatest(floor(least({MAX_DELAY_MS}D, pow(2, greatest(0, attempt - 1)) * {BASE_DELAY_MS}) * (least(1D, greatest(0D, u)) * 0.5D + 0.5D) + 0.5D),"
        " CASE WHEN retry_after_s >= 0 THEN retry_after_s * 1000 ELSE 0D END)"
    ),
    "cairn_hex(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS STRING": (
        "concat('#', array_join(transform(array(r, g, b), v -> lower(lpad(hex(bigint(least(255D, greatest(0D, floor(v + 0.5D))))), 2, '0'))), ''))"
    ),
    "cairn_color_bin(r INT, g INT, b INT) RETURNS INT": "shiftleft(shiftright(r, 4), 8) | shiftleft(shiftright(g, 4), 4) | shiftright(b, 4)",
}
TABLES = {
    "cairn_detail_tiles(cell_x BIGINT, cell_y BIGINT) RETURNS TABLE (x BIGINT, y BIGINT, export_col INT, export_row INT)": (
        "SELECT cell_x * 8 + i % 8, cell_y * 8 + i div 8, int(i % 8), int(i div 8) FROM (SELECT explode(sequence(0, 63)) AS i)"
    ),
    "cairn_tile_range(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, z INT) RETURNS TABLE (x BIGINT, y BIGINT)": (
        "SELECT x, explode(sequence(c, d)) AS y FROM (SELECT explode(sequence(a, b)) AS x, c, d FROM (SELECT cairn_tile_x(west, z) AS a,"
        " cairn_tile_x(east, z) AS b, cairn_tile_y(north, z) AS c, cairn_tile_y(south, z) AS d))"
    ),
}


def register_functions(spark: SparkSession) -> None:
    for head, body in {**SCALARS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
