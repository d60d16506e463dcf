"""Queries: control points, fits, projection and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.geo import haversine_m
from cairnfield.operators import anchors as A
from cairnfield.operators import lines as L
from cairnfield.plans import corpus as C
from cairnfield.plans.corpus import with_views
from cairnfield.plans.registry import query
from cairnfield.plans.sqlparts import AFF, SIM, haversine, sheet
from cairnfield.session import cut


def r(col, digits: int):
    """Round away from ties at the engines' last digits; negative zero becomes zero."""
    return F.round(col, digits) + F.lit(0.0)


def straight(spark: SparkSession, sf: str) -> DataFrame:
    """Fits of all maps; a rubber-sheet map is represented by its companion affine."""
    return A.fit_anchors(C.anchors(spark, sf), C.maps(spark, sf), tps=False)


def flat(fits: DataFrame) -> DataFrame:
    """Use only the affine part for projection, which is what the SQL side can state."""
    return fits.withColumn("method", F.when(F.col("method") == "tps", "affine").otherwise(F.col("method")))


def located(spark: SparkSession, sf: str) -> DataFrame:
    return A.apply_fit(C.vertices(spark, sf), flat(straight(spark, sf)))


@query("p01_usable_anchors", with_views("usable", "SELECT map_id, anchor_id, x, y, round(lat, 7) AS lat, round(lon, 7) AS lon FROM usable"))
def _(spark, sf):
    return A.usable_anchors(C.anchors(spark, sf)).select("map_id", "anchor_id", "x", "y", r(F.col("lat"), 7).alias("lat"), r(F.col("lon"), 7).alias("lon"))


@query("g06_fit_frames", with_views("coef", """SELECT map_id, n AS anchor_count, round(lat0, 11) AS lat0, round(lon0, 11) AS lon0, round(kx, 3) AS kx, round(ky, 3) AS ky, cx, cy, scale FROM coef"""))
def _(spark, sf):
    f = A.fit_frames(C.anchors(spark, sf), C.maps(spark, sf))
    return f.select("map_id", "anchor_count", *[r(F.col(c), 11).alias(c) for c in ("lat0", "lon0")], *[r(F.col(c), 3).alias(c) for c in ("kx", "ky")], "cx", "cy", "scale")


def _coefs(df):
    return df.select("map_id", "anchor_count", *[r(F.col("affine")[i], 4).alias(f"a{i}") for i in range(6)])


@query("g07_fit_similarity", with_views("coef", "SELECT map_id, n AS anchor_count, " + ", ".join(f"round(({SIM})[{i + 1}], 4) + 0e0 AS a{i}" for i in range(6)) + " FROM coef WHERE has_sim"))
def _(spark, sf):
    return _coefs(A.fit_similarity(C.anchors(spark, sf), C.maps(spark, sf)))


@query("g08_fit_affine", with_views("coef", "SELECT map_id, n AS anchor_count, " + ", ".join(f"round(({AFF})[{i + 1}], 3) + 0e0 AS a{i}" for i in range(6)) + " FROM coef WHERE has_aff"))
def _(spark, sf):
    f = A.fit_affine(C.anchors(spark, sf), C.maps(spark, sf))
    return f.select("map_id", "anchor_count", *[r(F.col("affine")[i], 3).alias(f"a{i}") for i in range(6)])


@query("g09_fit_tps", with_views("sheets", "SELECT map_id, m AS anchor_count, CAST(m AS INTEGER) AS controls, round(we[m + 2], 3) AS e_u, round(wn[m + 3], 3) AS n_v FROM sheets"))
def _(spark, sf):
    f = A.fit_anchors(C.anchors(spark, sf), C.maps(spark, sf)).where("method = 'tps'")
    return f.select("map_id", "anchor_count", F.size("controls").alias("controls"), r(F.element_at("w_e", -2), 3).alias("e_u"), r(F.element_at("w_n", -1), 3).alias("n_v"))


@query("g10_fit_methods", with_views("fits", "SELECT map_id, ok, reason, CAST(need AS INTEGER) AS need, requested, method, anchor_count FROM fits"))
def _(spark, sf):
    return straight(spark, sf).select("map_id", "ok", "reason", "need", "requested", "method", "anchor_count")


@query("g11_fit_quality", with_views("quality", """SELECT map_id, method, round(rms, 3) AS rms, round(mpp, 5) AS meters_per_pixel, checked, COALESCE(mirrored, FALSE) AS mirrored,
  COALESCE(mpp < 0.005e0 OR mpp > 200, FALSE) AS implausible_scale FROM quality WHERE ok"""))
def _(spark, sf):
    q = A.fit_quality(C.anchors(spark, sf), straight(spark, sf)).where("ok")
    return q.select("map_id", "method", r(F.col("rms"), 3).alias("rms"), r(F.col("meters_per_pixel"), 5).alias("meters_per_pixel"), "checked", "mirrored", "implausible_scale")


@query("g11_anchor_residuals", with_views("resid", "SELECT map_id, anchor_id, round(residual_m, 3) AS residual_m FROM resid"))
def _(spark, sf):
    return A.anchor_residuals(C.anchors(spark, sf), straight(spark, sf)).withColumn("residual_m", r(F.col("residual_m"), 3))


@query("g12_spread", with_views("support", "SELECT map_id, n, round(ratio, 6) AS ratio, supported, independent FROM support"))
def _(spark, sf):
    return A.spread(C.anchors(spark, sf)).withColumn("ratio", r(F.col("ratio"), 6))


@query("g13_loo_residuals", with_views("loo fits", "SELECT l.map_id, anchor_id, round(loo_residual_m, 2) AS loo_residual_m FROM loo l JOIN fits f ON f.map_id = l.map_id WHERE f.method <> 'tps'"))
def _(spark, sf):
    fits = straight(spark, sf).where("method <> 'tps'")
    return A.loo_residuals(C.anchors(spark, sf), fits, C.maps(spark, sf)).withColumn("loo_residual_m", r(F.col("loo_residual_m"), 2))


@query("g14_loo_tps", with_views("loo left_sheets controls", f"""SELECT l.map_id, l.anchor_id, round(COALESCE(b.d, l.loo_residual_m), 2) AS loo_residual_m FROM loo l JOIN controls k ON k.map_id = l.map_id AND k.anchor_id = l.anchor_id
LEFT JOIN (SELECT map_id, left_out, {haversine('lat', 'lon', f"lat0 + {sheet('wn', 'u', 'v')} / ky", f"lon0 + {sheet('we', 'u', 'v')} / kx")} AS d
  FROM (SELECT s.*, o.lat, o.lon, o.lat0, o.lon0, o.kx, o.ky, o.u, o.v FROM left_sheets s JOIN controls o ON o.map_id = s.map_id AND o.anchor_id = s.left_out)) b ON b.map_id = l.map_id AND b.left_out = l.anchor_id"""))
def _(spark, sf):
    fits = A.fit_anchors(C.anchors(spark, sf), C.maps(spark, sf)).where("method = 'tps'")
    return A.loo_residuals(C.anchors(spark, sf), fits, C.maps(spark, sf)).withColumn("loo_residual_m", r(F.col("loo_residual_m"), 2))


_OUTLIER_SQL = with_views("quality loo resid", """SELECT r.map_id, r.anchor_id, round(r.residual_m, 2) AS residual_m, round(l.loo_residual_m, 2) AS loo_residual_m,
  q.checked AND CASE WHEN l.loo_residual_m IS NOT NULL THEN l.loo_residual_m > greatest(25e0, 2.2e0 * m.med) ELSE r.residual_m > greatest(25e0, 2.2e0 * q.rms) END AS outlier
FROM resid r JOIN quality q ON q.map_id = r.map_id LEFT JOIN loo l ON l.map_id = r.map_id AND l.anchor_id = r.anchor_id
LEFT JOIN (SELECT map_id, median(loo_residual_m) AS med FROM loo GROUP BY map_id) m ON m.map_id = r.map_id""")


def _flagged(spark, sf):
    a = C.anchors(spark, sf)
    fits = flat(straight(spark, sf))
    q = A.fit_quality(a, fits)
    return q, A.outliers(a, q, cut(A.loo_residuals(a, fits, C.maps(spark, sf))))


@query("g15_outliers", _OUTLIER_SQL)
def _(spark, sf):
    _, rows = _flagged(spark, sf)
    return rows.select("map_id", "anchor_id", r(F.col("residual_m"), 2).alias("residual_m"), r(F.col("loo_residual_m"), 2).alias("loo_residual_m"), "outlier")


@query("p09_fit_status", with_views("quality loo resid", f"""WITH flags AS (SELECT map_id, bool_or(outlier) AS odd FROM ({_OUTLIER_SQL.split(chr(10), 0)[0][_OUTLIER_SQL.rindex('SELECT r.map_id'):]}) GROUP BY map_id),
counts AS (SELECT o_custkey AS map_id, COUNT(*) AS c FROM orders GROUP BY o_custkey),
base AS (SELECT q.*, COALESCE(odd, FALSE) AS odd, COALESCE(c, 0) AS c,
  'Placed using ' || CASE WHEN method = 'similarity' THEN 'scale and rotate' WHEN method = 'affine' THEN 'stretch to fit' ELSE 'rubber sheet' END || '. About ' ||
  CASE WHEN mpp >= 1 THEN printf('%.1f', mpp) || ' m' ELSE CAST(CAST(floor(mpp * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || ' cm' END || ' per map pixel.' AS placed,
  CASE WHEN rms < 1 THEN '<1 m' WHEN rms < 1000 THEN CAST(CAST(floor(rms + 0.5e0) AS BIGINT) AS VARCHAR) || ' m' ELSE printf('%.1f', rms / 1000) || ' km' END AS res
  FROM quality q LEFT JOIN flags ON flags.map_id = q.map_id LEFT JOIN counts ON counts.map_id = q.map_id)
SELECT map_id, CASE WHEN reason = 'degenerate' THEN 'These anchors sit on top of each other. Spread them across the map.' WHEN NOT ok AND c = 0 THEN ''
  WHEN NOT ok THEN 'Add ' || need || ' more anchor' || CASE WHEN need = 1 THEN '' ELSE 's' END || ' with coordinates to place the map.'
  WHEN mirrored THEN 'The anchors describe a mirror image. Latitude and longitude may be swapped on one of them.'
  WHEN mpp < 0.005e0 OR mpp > 200 THEN placed || ' That scale looks wrong for a park map; check each anchor’s coordinates.'
  WHEN NOT checked AND c >= 4 AND requested <> 'similarity' THEN 'These anchors do not spread far enough across the map to check a stretch in every direction. Add an anchor farther from their line to confirm the fit.'
  WHEN NOT checked THEN placed || ' Add another anchor so the fit can be checked.'
  ELSE placed || ' Anchors agree within ' || res || ' on average.' || CASE WHEN odd THEN ' The red anchor is the odd one out: re-check its spot or coordinates.'
    WHEN rms > 60 THEN ' That’s loose. If the map is hand-drawn, try the rubber sheet method with more anchors.' ELSE '' END END AS text,
  CASE WHEN NOT ok THEN NULL WHEN mirrored OR mpp < 0.005e0 OR mpp > 200 THEN 'warn' WHEN NOT checked THEN 'good' WHEN odd OR rms > 60 THEN 'warn' ELSE 'good' END AS tone FROM base"""))
def _(spark, sf):
    a, m = C.anchors(spark, sf), C.maps(spark, sf)
    fits = straight(spark, sf)
    q = A.fit_quality(a, fits)
    rows = A.outliers(a, q, cut(A.loo_residuals(a, flat(fits), m)))
    counts = a.groupBy("map_id").agg(F.count("*").alias("anchors"))
    return A.fit_status(q, rows, counts)


@query("j01_apply_fit", with_views("located", "SELECT map_id, feature_id, idx, round(lat, 6) + 0e0 AS lat, round(lon, 6) + 0e0 AS lon FROM located"))
def _(spark, sf):
    return located(spark, sf).select("map_id", "feature_id", "idx", r(F.col("lat"), 6).alias("lat"), r(F.col("lon"), 6).alias("lon"))


@query("j01_apply_fit_tps", with_views("sheets fits vertices", f"""SELECT map_id, feature_id, idx, round(lat0 + {sheet('wn', 'u', 'v')} / ky, 6) AS lat, round(lon0 + {sheet('we', 'u', 'v')} / kx, 6) AS lon
FROM (SELECT s.*, feature_id, idx, lat0, lon0, kx, ky, (x - cx) / scale AS u, (y - cy) / scale AS v FROM vertices p JOIN fits f ON f.map_id = p.map_id JOIN sheets s ON s.map_id = p.map_id)"""))
def _(spark, sf):
    fits = A.fit_anchors(C.anchors(spark, sf), C.maps(spark, sf)).where("method = 'tps'")
    out = A.apply_fit(C.vertices(spark, sf), fits)
    return out.select("map_id", "feature_id", "idx", r(F.col("lat"), 6).alias("lat"), r(F.col("lon"), 6).alias("lon"))


@query("j02_invert_fit", with_views("fits usable", """SELECT map_id, anchor_id, round(u * scale + cx, 2) + 0e0 AS x, round(v * scale + cy, 2) + 0e0 AS y FROM (
  SELECT *, (aff[5] * (te - aff[3]) - aff[2] * (tn - aff[6])) / d AS u, (-aff[4] * (te - aff[3]) + aff[1] * (tn - aff[6])) / d AS v FROM (
    SELECT a.anchor_id, f.*, (a.lon - lon0) * kx AS te, (a.lat - lat0) * ky AS tn, CASE WHEN abs(aff[1] * aff[5] - aff[2] * aff[4]) >= 1e-12 THEN aff[1] * aff[5] - aff[2] * aff[4] END AS d
    FROM usable a JOIN fits f ON f.map_id = a.map_id WHERE ok))"""))
def _(spark, sf):
    pts = A.usable_anchors(C.anchors(spark, sf)).select("map_id", "anchor_id", "lat", "lon")
    out = A.invert_fit(pts, flat(straight(spark, sf)))
    return out.select("map_id", "anchor_id", r(F.col("x"), 2).alias("x"), r(F.col("y"), 2).alias("y"))


# A folded sheet has several places over one spot, so what is known is where the way there and back ends.
@query("j02_invert_fit_tps", with_views("controls", "SELECT map_id, anchor_id, 0e0 AS off_m FROM controls"))
def _(spark, sf):
    fits = A.fit_anchors(C.anchors(spark, sf), C.maps(spark, sf)).where("method = 'tps'")
    pts = A.usable_anchors(C.anchors(spark, sf)).select("map_id", "anchor_id", "lat", "lon")
    there = A.invert_fit(pts, fits).select("map_id", "anchor_id", "x", "y")
    back = A.apply_fit(there, fits).withColumnsRenamed({"lat": "blat", "lon": "blon"}).join(pts, ["map_id", "anchor_id"])
    return back.select("map_id", "anchor_id", r(haversine_m(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")), 3).alias("off_m"))


@query("f01_haversine", with_views("usable means", f"SELECT u.map_id, anchor_id, round({haversine('u.lat', 'u.lon', 'mlat', 'mlon')}, 3) AS d FROM usable u JOIN means m ON m.map_id = u.map_id"))
def _(spark, sf):
    a = A.usable_anchors(C.anchors(spark, sf))
    mid = a.groupBy("map_id").agg(F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    return a.join(mid, "map_id").select("map_id", "anchor_id", r(haversine_m(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon")), 3).alias("d"))


@query("g01_path_length", with_views("lengths", "SELECT map_id, feature_id, n_vertices, round(length_m, 2) AS length_m FROM lengths"))
def _(spark, sf):
    geo = located(spark, sf)
    return L.path_length(geo, F.col("kind") == "area").withColumn("length_m", r(F.col("length_m"), 2))


@query("g28_map_summary", with_views("lengths features", """SELECT f.map_id, COUNT(*) FILTER (kind = 'trail') AS trails, COUNT(*) FILTER (kind = 'area') AS areas, COUNT(*) FILTER (kind = 'poi') AS points,
  round(SUM(CASE WHEN kind = 'trail' THEN COALESCE(length_m, 0e0) ELSE 0e0 END), 1) AS trail_length_m FROM features f LEFT JOIN lengths l ON l.feature_id = f.feature_id GROUP BY f.map_id"""))
def _(spark, sf):
    lengths = L.path_length(located(spark, sf), F.col("kind") == "area")
    return L.map_summary(C.features(spark, sf), lengths).withColumn("trail_length_m", r(F.col("trail_length_m"), 1))


@query("g02_map_view", with_views("fits maps anchors", """WITH corners AS (SELECT m.map_id, unnest([0e0, width, width, 0e0]) AS x, unnest([CAST(height AS DOUBLE), height, 0e0, 0e0]) AS y FROM maps m),
q AS (SELECT map_id, MIN(lat) AS south, MIN(lon) AS west, MAX(lat) AS north, MAX(lon) AS east FROM (
  SELECT c.map_id, lat0 + (aff[4] * (x - cx) / scale + aff[5] * (y - cy) / scale + aff[6]) / ky AS lat, lon0 + (aff[1] * (x - cx) / scale + aff[2] * (y - cy) / scale + aff[3]) / kx AS lon
  FROM corners c JOIN fits f ON f.map_id = c.map_id WHERE ok) GROUP BY map_id),
a AS (SELECT map_id, COUNT(*) AS n, MIN(lat) AS south, MIN(lon) AS west, MAX(lat) AS north, MAX(lon) AS east FROM anchors WHERE lat IS NOT NULL GROUP BY map_id)
SELECT COALESCE(q.map_id, a.map_id) AS map_id, CASE WHEN q.map_id IS NOT NULL THEN 'quad' WHEN a.n = 1 THEN 'anchor' ELSE 'anchors' END AS source, round(COALESCE(q.south, a.south), 6) AS south,
  round(COALESCE(q.west, a.west), 6) AS west, round(COALESCE(q.north, a.north), 6) AS north, round(COALESCE(q.east, a.east), 6) AS east FROM q FULL JOIN a ON a.map_id = q.map_id"""))
def _(spark, sf):
    quads = A.overlay_quad(flat(straight(spark, sf)), C.maps(spark, sf))
    v = L.map_view(quads, C.anchors(spark, sf))
    return v.select("map_id", "source", *[r(F.col(k), 6).alias(k) for k in ("south", "west", "north", "east")])


@query("t17_overlay_mesh", with_views("fits maps", """SELECT g.map_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(x, 4) AS x, round(y, 4) AS y, round(lat0 + (aff[4] * (x - cx) / scale + aff[5] * (y - cy) / scale + aff[6]) / ky, 6) AS lat,
  round(lon0 + (aff[1] * (x - cx) / scale + aff[2] * (y - cy) / scale + aff[3]) / kx, 6) AS lon
FROM (SELECT map_id, row, col, width * col / 8e0 AS x, height * row / 6e0 AS y FROM maps, (SELECT unnest(range(7)) AS row), (SELECT unnest(range(9)) AS col)) g JOIN fits f ON f.map_id = g.map_id WHERE ok"""))
def _(spark, sf):
    m = A.overlay_mesh(flat(straight(spark, sf)), C.maps(spark, sf), 8)
    return m.select("map_id", "row", "col", r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"), r(F.col("lat"), 6).alias("lat"), r(F.col("lon"), 6).alias("lon"))


@query("u03_grouped_solvers", with_views("controls", "SELECT DISTINCT map_id, 0e0 AS worst_m FROM controls"))
def _(spark, sf):
    """Rubber-sheet fit, then every anchor of those maps projected forward and compared with itself."""
    fits = A.fit_anchors(C.anchors(spark, sf), C.maps(spark, sf)).where("method = 'tps'")
    a = A.usable_anchors(C.anchors(spark, sf))
    there = A.apply_fit(a.select("map_id", "anchor_id", "x", "y"), fits).withColumnsRenamed({"lat": "plat", "lon": "plon"})
    back = there.join(a.select("map_id", "anchor_id", "lat", "lon"), ["map_id", "anchor_id"])
    return back.groupBy("map_id").agg(r(F.max(haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))), 3).alias("worst_m"))
