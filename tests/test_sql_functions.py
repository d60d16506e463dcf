"""SQL functions against the column expressions of the same name."""

import pytest
from pyspark.sql import functions as F

from cairnfield.functions import color, geo, plane
from cairnfield.functions.sql import SCALARS, register_functions


def cases():
    c = F.col
    return {
        "cairn_haversine_m(lat, lon, u, a)": geo.haversine_m(c("lat"), c("lon"), c("u"), c("a")),
        "cairn_world_x(lon, 17)": geo.world_x(c("lon"), 17),
        "cairn_world_y(lat, 17)": geo.world_y(c("lat"), 17),
        "cairn_world_lon(a * 1000, 17)": geo.world_lon(c("a") * 1000, 17),
        "cairn_world_lat(a * 1000, 17)": geo.world_lat(c("a") * 1000, 17),
        "cairn_ground_resolution(lat, 12)": geo.ground_resolution(c("lat"), 12),
        "cairn_mercator_x_m(lon)": geo.mercator_x_m(c("lon")),
        "cairn_mercator_y_m(lat)": geo.mercator_y_m(c("lat")),
        "cairn_detail_cell_x(lon)": geo.detail_cell_x(c("lon")),
        "cairn_detail_cell_y(lat)": geo.detail_cell_y(c("lat")),
        "cairn_cell_key(k, k + 1)": geo.cell_key(c("k"), c("k") + 1),
        "cairn_tile_key(3, k, k + 1)": geo.tile_key(F.lit(3), c("k"), c("k") + 1),
        "cairn_distance2(a, lat, lon, u)": plane.distance2(c("a"), c("lat"), c("lon"), c("u")),
        "cairn_segment_t(lat, lon, 0D, 0D, a, u)": plane.project_on_segment(c("lat"), c("lon"), F.lit(0.0), F.lit(0.0), c("a"), c("u"))["t"],
        "cairn_working_width(a * 100, 900D)": plane.working_size(c("a") * 100, F.lit(900.0))["width"],
        "cairn_working_height(a * 100, 900D)": plane.working_size(c("a") * 100, F.lit(900.0))["height"],
        "cairn_retry_delay_ms(int(k), IF(k % 2 = 0, null, 3.5D), u)": plane.retry_delay_ms(c("k"), F.when(c("k") % 2 != 0, 3.5), c("u")),
        "cairn_color_distance(a, lat, lon, u, a, a)": color.color_distance(c("a"), c("lat"), c("lon"), c("u"), c("a"), c("a")),
        "cairn_luminance(a, lat, u)": color.luminance(c("a"), c("lat"), c("u")),
        "cairn_hex(a, lat, u * 100)": color.rgb_to_hex(c("a"), c("lat"), c("u") * 100),
        "cairn_color_bin(int(k * 30), 77, 255)": color.color_bin(c("k") * 30, F.lit(77), F.lit(255)),
    }


def test_sql_functions_equal_columns(spark):
    register_functions(spark)
    known = cases()
    rows = [(k, -89.9 + 22.3 * k, -180.0 + 40.1 * k, 0.13 * k, 37.5 * k + 0.5) for k in range(9)] + [(4, 1.0, 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k bigint, lat double, lon double, u double, a double")
    got = df.select(*[F.expr(sql).alias(f"g{i}") for i, sql in enumerate(known)], *[want.alias(f"w{i}") for i, want in enumerate(known.values())])
    for row in got.collect():
        for i, sql in enumerate(known):
            g, w = row[f"g{i}"], row[f"w{i}"]
            assert (g == pytest.approx(w, rel=1e-9, abs=1e-9)) if isinstance(w, float) else g == w, (sql, row)
    named = {sql.split("(")[0] for sql in known}
    assert len(named) == 21 and named <= {head.split("(")[0] for head in SCALARS}
    null = spark.range(1).selectExpr("cairn_haversine_m(null, 1, 2, 3) a", "cairn_world_y(null, 3) b", "cairn_mercator_y_m(null) c", "cairn_segment_t(null, 1, 2, 3, 2, 3) d", "cairn_world_x(null, 3) e")
    assert set(null.first()) == {None}
