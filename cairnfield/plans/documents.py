"""Queries: text functions, GPX text, project documents, validation, document sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.functions import color as K
from cairnfield.functions import text as X
from cairnfield.operators import lines as L
from cairnfield.plans import corpus as C
from cairnfield.plans.corpus import VIEWS, with_views
from cairnfield.plans.fits import located, r
from cairnfield.plans.registry import query
from cairnfield.plans.sqlparts import COLOR_NAME
from cairnfield.sources import catalog as S
from cairnfield.sources import documents as D
from cairnfield.sources import gpx as G
from cairnfield.sources import projects as P
from cairnfield.session import cut

c = F.col

_COORD = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN printf('%.4f, %.4f', la, -lo) WHEN 1 THEN printf('%.3f S %.3f E', la, lo) WHEN 2 THEN printf('%d°%d''%d"N, %d°%d''%d"W', d, m, s, d + 40, m, s)
 WHEN 3 THEN printf('https://maps.example/@%.5f,%.5f,15z', la, -lo) WHEN 4 THEN printf('%.2f W, %.2f N', lo, la) ELSE 'nowhere ' || o_orderkey END AS t, la, lo, d, m, s
FROM (SELECT o_orderkey, (o_orderkey % 100) + 0.1234e0 AS la, (o_orderkey % 200) + 0.2468e0 AS lo, CAST(o_orderkey % 90 AS BIGINT) AS d, CAST(o_orderkey % 60 AS BIGINT) AS m, CAST((o_orderkey // 7) % 60 AS BIGINT) AS s FROM orders)"""


@query("f02_parse_latlon", f"""SELECT o_orderkey, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT o_orderkey, CASE k WHEN 0 THEN CAST(printf('%.4f', la) AS DOUBLE) WHEN 1 THEN -CAST(printf('%.3f', la) AS DOUBLE) WHEN 2 THEN d + m / 60e0 + s / 3600e0 WHEN 3 THEN CAST(printf('%.5f', la) AS DOUBLE) WHEN 4 THEN CAST(printf('%.2f', la) AS DOUBLE) END AS lat,
 CASE k WHEN 0 THEN -CAST(printf('%.4f', lo) AS DOUBLE) WHEN 1 THEN CAST(printf('%.3f', lo) AS DOUBLE) WHEN 2 THEN -(d + 40 + m / 60e0 + s / 3600e0) WHEN 3 THEN -CAST(printf('%.5f', lo) AS DOUBLE) WHEN 4 THEN -CAST(printf('%.2f', lo) AS DOUBLE) END AS lon
 FROM (SELECT *, o_orderkey % 6 AS k FROM ({_COORD}))) WHERE abs(lat) <= 90 AND abs(lon) <= 180""")
def _(spark, sf):
    k = c("o_orderkey")
    la, lo = (k % 100) + F.lit(0.1234), (k % 200) + F.lit(0.2468)
    d, m, s = k % 90, k % 60, F.floor(k / 7) % 60
    text = (
        F.when(k % 6 == 0, F.format_string("%.4f, %.4f", la, -lo)).when(k % 6 == 1, F.format_string("%.3f S %.3f E", la, lo))
        .when(k % 6 == 2, F.format_string("%d°%d'%d\"N, %d°%d'%d\"W", d, m, s, d + 40, m, s)).when(k % 6 == 3, F.format_string("https://maps.example/@%.5f,%.5f,15z", la, -lo))
        .when(k % 6 == 4, F.format_string("%.2f W, %.2f N", lo, la)).otherwise(F.concat(F.lit("nowhere "), k.cast("string")))
    )
    p = C.table(spark, sf, "orders").select(k, X.parse_latlon(text).alias("p")).where("p is not null")
    return p.select("o_orderkey", r(c("p.lat"), 6).alias("lat"), r(c("p.lon"), 6).alias("lon"))


def _len_sql(m: str, mi: str) -> str:
    return f"""CASE WHEN {mi} THEN CASE WHEN {m} < 1609 THEN printf('%.2f', {m} / 1609.344e0) ELSE printf('%.1f', {m} / 1609.344e0) END || ' mi' WHEN {m} < 1000 THEN CAST(CAST(floor({m} + 0.5e0) AS BIGINT) AS VARCHAR) || ' m' ELSE printf('%.2f', {m} / 1000) || ' km' END"""


@query("f03_formats", f"""SELECT o_orderkey, {_len_sql('o_totalprice', 'o_orderkey % 2 = 0')} AS length_text, CASE WHEN p < 1 THEN '±<1 m' WHEN p < 1000 THEN '±' || CAST(CAST(floor(p + 0.5e0) AS BIGINT) AS VARCHAR) || ' m' ELSE '±' || printf('%.1f', p / 1000) || ' km' END AS residual,
 printf('%.6f', o_totalprice / 7000) || ', ' || printf('%.6f', -o_totalprice / 5000) AS latlon FROM (SELECT *, o_totalprice / 100 AS p FROM orders)""")
def _(spark, sf):
    m = c("o_totalprice")
    units = F.when(c("o_orderkey") % 2 == 0, "mi").otherwise("km")
    return C.table(spark, sf, "orders").select(
        "o_orderkey", X.format_length(m, units).alias("length_text"), X.format_residual(m / 100).alias("residual"), X.format_latlon(m / 7000, -m / 5000).alias("latlon")
    )


_DESC = f"""(CASE WHEN kind = 'poi' THEN notes ELSE concat_ws(chr(10), nullif(notes, ''), CASE WHEN kind = 'trail' AND route_kind = 'one-way' THEN 'Route: One-way' WHEN kind = 'trail' AND route_kind = 'loop' THEN 'Route: Loop (' || route_direction || ')' END,
 CASE kind WHEN 'trail' THEN 'Length: ' ELSE 'Perimeter: ' END || {_len_sql('length_m', 'TRUE')}) END)"""
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_COLOR = """(CASE WHEN regexp_matches(color, '^#?[0-9a-fA-F]{6}$') THEN '#' || upper(right(color, 6)) WHEN regexp_matches(color, '^#?[0-9a-fA-F]{3}$') THEN '#' || upper(regexp_replace(right(color, 3), '(.)', '\\1\\1', 'g'))
 WHEN kind = 'trail' THEN '#D9480F' WHEN kind = 'area' THEN '#3A7D44' ELSE '#1F6FB2' END)"""
VIEWS["docfeatures"] = (
    ["features", "lengths"],
    f"""SELECT *, {_DESC} AS description, {_COLOR} AS norm, CASE kind WHEN 'trail' THEN 0 WHEN 'area' THEN 1 ELSE 2 END AS rk FROM (SELECT f.*, COALESCE(l.length_m, 0e0) AS length_m FROM features f JOIN lengths l ON l.feature_id = f.feature_id)""",
)
VIEWS["docpoints"] = (
    ["located", "docfeatures"],
    """SELECT v.map_id, v.feature_id, v.idx, v.lat, v.lon, v.kind, f.rk FROM (SELECT map_id, feature_id, idx, lat, lon, kind FROM located UNION ALL SELECT a.map_id, a.feature_id, n.n, a.lat, a.lon, a.kind FROM located a JOIN (SELECT feature_id, COUNT(*) AS n FROM located WHERE kind = 'area' GROUP BY feature_id) n ON n.feature_id = a.feature_id WHERE a.idx = 0) v
 JOIN docfeatures f ON f.feature_id = v.feature_id""",
)


@query("f04_feature_description", with_views("docfeatures", "SELECT map_id, feature_id, description FROM docfeatures"))
def _(spark, sf):
    f, geo, lengths = _doc_inputs(spark, sf)
    d = X.feature_description(c("kind"), c("notes"), c("route_kind"), c("route_direction"), c("length_m"), F.lit("mi"))
    return f.join(lengths, L.KEYS).select("map_id", "feature_id", d.alias("description"))


@query("f05_text_functions", f"""SELECT page_id, COALESCE(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'park-map') AS slug, {_ESC.format('html')} AS escaped FROM pages""")
def _(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", X.slugify(c("url")).alias("slug"), X.xml_escape(c("html")).alias("escaped"))


@query("f05_document_escape", f"SELECT doc_id, {_ESC.format('text')} AS escaped FROM documents")
def _(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", X.xml_escape(c("text")).alias("escaped"))


@query("f05_colors", with_views("features", f"SELECT feature_id, {_COLOR} AS color, 'ff' || substr({_COLOR}, 6, 2) || substr({_COLOR}, 4, 2) || substr({_COLOR}, 2, 2) AS kml FROM features"))
def _(spark, sf):
    color = X.feature_color(c("kind"), c("color"))
    return C.features(spark, sf).select("feature_id", color.alias("color"), X.kml_color(color).alias("kml"))


_HSL = """SELECT *, CASE WHEN d > 1e-6 THEN ((CASE WHEN hi = r / 255e0 THEN ((g - b) / 255e0 / d) % 6 WHEN hi = g / 255e0 THEN (b - r) / 255e0 / d + 2 ELSE (r - g) / 255e0 / d + 4 END) * 60 + 360) % 360 ELSE 0e0 END AS h, CASE WHEN d > 1e-6 THEN d / (1 - abs(2 * l - 1)) ELSE 0e0 END AS s
 FROM (SELECT *, hi - lo AS d, (hi + lo) / 2 AS l FROM (SELECT *, greatest(r, g, b) / 255e0 AS hi, least(r, g, b) / 255e0 AS lo FROM (SELECT o_orderkey, CAST(o_orderkey * 7 % 256 AS INTEGER) AS r, CAST(o_orderkey * 13 % 256 AS INTEGER) AS g, CAST(o_orderkey * 29 % 256 AS INTEGER) AS b FROM orders)))"""


@query("f08_colors", f"""SELECT o_orderkey, round(h, 4) AS h, round(s, 6) AS s, round(l, 6) AS l, {COLOR_NAME} AS name,
 printf('#%02x%02x%02x', r, g, b) AS hex, round((0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) / 255, 6) AS lum, round(sqrt(pow(r - 200, 2) + pow(g - 30, 2) + pow(b - 30, 2)), 5) AS distance,
 CASE WHEN (0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) / 255 < 0.82e0 THEN printf('#%02x%02x%02x', r, g, b) ELSE '#D9480F' END AS ink FROM ({_HSL})""")
def _(spark, sf):
    k = c("o_orderkey")
    px = C.table(spark, sf, "orders").select(k, *[(k * m % 256).cast("int").alias(n) for n, m in (("r", 7), ("g", 13), ("b", 29))])
    rgb = (c("r"), c("g"), c("b"))
    hsl = K.rgb_to_hsl(*rgb)
    back = K.hex_to_rgb(K.rgb_to_hex(*rgb))
    return px.select(
        "o_orderkey", r(hsl["h"], 4).alias("h"), r(hsl["s"], 6).alias("s"), r(hsl["l"], 6).alias("l"), K.color_name(*rgb).alias("name"),
        K.rgb_to_hex(back["r"], back["g"], back["b"]).alias("hex"), r(K.luminance(*rgb), 6).alias("lum"),
        r(K.color_distance(*rgb, F.lit(200), F.lit(30), F.lit(30)), 5).alias("distance"), K.feature_color_for_ink(*rgb, F.lit("#D9480F")).alias("ink"),
    )


def _gpx_texts(spark, sf):
    """One small GPX text per line; its third point is out of range and must be dropped."""
    v = C.vertices(spark, sf, net=True)
    lat = F.when(c("idx") == 2, F.lit("95.5")).otherwise(F.format_string("%.6f", F.lit(38.6) - c("y") * F.lit(0.000009)))
    lon = F.format_string("%.6f", F.lit(-78.4) + c("x") * F.lit(0.00001))
    tag = F.when(c("kind") == "poi", "wpt").when(c("kind") == "area", "rtept").otherwise("trkpt")
    point = F.concat(F.lit("<"), tag, F.lit(' lat="'), lat, F.lit('" lon="'), lon, F.lit('"><ele>'), c("idx").cast("string"), F.lit("</ele></"), tag, F.lit(">"))
    # A line has at most eight points here.
    body = v.select("feature_id", "kind", "idx", point.alias("t")).groupBy("feature_id", "kind").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "t"))), lambda s: s["t"]), "").alias("b")
    )
    name = F.when(c("feature_id") % 2 == 0, F.concat(F.lit("<name>L&amp;"), c("feature_id").cast("string"), F.lit("</name>"))).otherwise("")
    line = F.when(c("kind") == "poi", c("b")).when(c("kind") == "area", F.concat(F.lit("<rte>"), name, c("b"), F.lit("</rte>"))).otherwise(
        F.concat(F.lit("<trk>"), name, F.lit("<trkseg>"), c("b"), F.lit("</trkseg></trk>"))
    )
    return body.select("feature_id", F.concat(F.lit("<gpx>"), line, F.lit("</gpx>")).alias("xml"))


def _gpx_points(spark, sf):
    return G.from_gpx_text(_gpx_texts(spark, sf), "feature_id", "xml")


VIEWS["gps"] = (
    ["net_vertices"],
    """SELECT feature_id AS file, k AS kind, CASE k WHEN 'wpt' THEN 'wpt-' || pt_no WHEN 'rtept' THEN 'rte-1-' || pt_no ELSE 'trk-1-1-' || pt_no END AS point_id,
 CASE k WHEN 'wpt' THEN 'Waypoint ' || pt_no ELSE ln || ' pt ' || pt_no END AS name, lat, lon, CAST(idx AS DOUBLE) AS ele, CAST(pt_no AS INTEGER) AS pt_no, ln FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY idx) AS pt_no, CASE WHEN k <> 'wpt' AND feature_id % 2 = 0 THEN 'L&' || feature_id WHEN k = 'rtept' THEN 'Route 1' WHEN k = 'trkpt' THEN 'Track 1' END AS ln FROM (
 SELECT feature_id, idx, CASE kind WHEN 'poi' THEN 'wpt' WHEN 'area' THEN 'rtept' ELSE 'trkpt' END AS k, CAST(printf('%.6f', 38.6e0 - y * 9e-6) AS DOUBLE) AS lat, CAST(printf('%.6f', -78.4e0 + x * 1e-5) AS DOUBLE) AS lon FROM net_vertices WHERE idx <> 2))""",
)


@query("s03_gpx_text", with_views("gps", "SELECT file, kind, point_id, name, lat, lon, ele, pt_no FROM gps"))
def _(spark, sf):
    return _gpx_points(spark, sf).select("file", "kind", "point_id", "name", "lat", "lon", "ele", "pt_no")


@query("s02_gps_lines", with_views("gps", "SELECT file, kind, ln AS line_name, COUNT(*) AS n, round(SUM(lat * pt_no), 8) AS checksum FROM gps WHERE kind <> 'wpt' GROUP BY file, kind, ln"))
def _(spark, sf):
    lines = G.gps_lines(_gpx_points(spark, sf))
    one = lines.withColumn("n", F.size("points")).withColumn("s", F.aggregate(F.transform("points", lambda p: p["lat"] * p["pt_no"]), F.lit(0.0), lambda a, b: a + b))
    return one.groupBy("file", "kind", "line_name").agg(F.sum("n").alias("n"), r(F.sum("s"), 8).alias("checksum"))


@query("o01_union_points", with_views("gps", "SELECT kind, COUNT(*) AS n, round(AVG(lat), 6) AS lat FROM gps GROUP BY kind"))
def _(spark, sf):
    return _gpx_points(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), r(F.avg("lat"), 6).alias("lat"))


@query("p06_search_points", with_views("gps", "SELECT file, name, pt_no FROM gps WHERE lower(name) LIKE '%way%' ORDER BY file, pt_no LIMIT 100"))
def _(spark, sf):
    return G.search_points(_gpx_points(spark, sf), " WAY ").select("file", "name", "pt_no")


def _track_points(spark, sf):
    """Whole nets as files: each line is a track of its net."""
    v = C.vertices(spark, sf, net=True).where("kind <> 'poi'")
    return v.select(
        c("map_id").alias("file"), F.lit("trkpt").alias("kind"), c("feature_id").alias("track_no"), F.lit(1).alias("seg_no"), (c("idx") + 1).alias("pt_no"), "x", "y"
    )


@query("w08_decimate", with_views("net_vertices", """SELECT file, track_no, pt_no FROM (SELECT map_id AS file, feature_id AS track_no, idx + 1 AS pt_no, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY feature_id, idx) - 1 AS i, COUNT(*) OVER (PARTITION BY map_id) AS n FROM net_vertices WHERE kind <> 'poi')
WHERE i = 0 OR i = n - 1 OR i % CAST(ceil(n / 300e0) AS BIGINT) = 0"""))
def _(spark, sf):
    return G.decimate(_track_points(spark, sf), 300, 100).select("file", "track_no", "pt_no")


def _project_docs(spark, sf):
    """A JSON document per customer map, versions 1 to 5, with all its features."""
    f = C.features(spark, sf)
    v = C.vertices(spark, sf)
    # Lines have at most eight points, and a customer has some dozens of orders.
    pts = v.groupBy(*L.KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("pts"))
    poi = c("kind") == "poi"
    one = F.struct(
        c("feature_id").cast("string").alias("id"), "name", "color", "notes", "kind", F.when(~poi, c("pts")).alias("pts"), F.when(poi, c("pts")[0]).alias("at"),
        F.when(poi, c("poi_type")).alias("poiType"), F.struct(c("route_kind").alias("kind"), c("route_direction").alias("direction")).alias("route"),
    )
    rows = f.join(pts, L.KEYS).groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("feature_id", one.alias("f")))).alias("_f"))
    doc = F.struct(
        (c("map_id") % 5 + 1).alias("version"), F.concat(F.lit("Map "), c("map_id").cast("string")).alias("name"), F.lit("auto").alias("fitMethod"),
        F.struct(F.lit(2000).alias("width"), F.lit(1500).alias("height")).alias("image"), F.transform("_f", lambda x: x["f"]).alias("features"),
    )
    return rows.select(c("map_id").alias("doc"), F.to_json(doc).alias("json"))


@query("s04_read_projects", with_views("features vertices", """SELECT f.map_id, CAST(f.feature_id AS VARCHAR) AS feature_id, f.kind, CASE WHEN f.kind = 'poi' THEN f.poi_type END AS poi_type, CASE WHEN f.map_id % 5 + 1 = 4 OR f.kind <> 'trail' THEN f.route_kind END AS route_kind,
 CASE WHEN f.kind = 'poi' THEN 1 ELSE n END AS points, round(CASE WHEN f.kind = 'poi' THEN first_x ELSE sum_x END, 6) AS x FROM features f
 JOIN (SELECT feature_id, COUNT(*) AS n, SUM(x * (idx + 1)) AS sum_x, arg_min(x, idx) AS first_x FROM vertices GROUP BY feature_id) v ON v.feature_id = f.feature_id WHERE f.map_id % 5 + 1 <= 4"""))
def _(spark, sf):
    docs, _ = P.from_project_text(_project_docs(spark, sf), "doc", "json")
    t = P.tables(docs)
    n = t["vertices"].groupBy(*L.KEYS).agg(F.count("*").alias("points"), r(F.sum(c("x") * (c("idx") + 1)), 6).alias("x"))
    # Versions below 4 all pass the step that clears trail routes.
    return t["features"].join(n, L.KEYS).select("map_id", "feature_id", "kind", "poi_type", "route_kind", "points", "x")


@query("u04_migrations", with_views("features", "SELECT version, COUNT(*) AS docs FROM (SELECT DISTINCT map_id, CASE WHEN map_id % 5 + 1 <= 4 THEN 4 ELSE 5 END AS version FROM features) GROUP BY version"))
def _(spark, sf):
    ok, bad = P.from_project_text(_project_docs(spark, sf), "doc", "json")
    return ok.select("version").unionByName(bad.select("version")).groupBy("version").agg(F.count("*").alias("docs"))


@query("s05_legacy_import", with_views("features vertices", """SELECT f.feature_id AS map_id, f.kind, CASE WHEN f.kind = 'poi' THEN f.poi_type END AS poi_type, n AS points, 'Feature 1' AS name FROM features f
 JOIN (SELECT feature_id, COUNT(*) AS n FROM vertices GROUP BY feature_id) v ON v.feature_id = f.feature_id"""))
def _(spark, sf):
    f, v = C.features(spark, sf), C.vertices(spark, sf)
    pts = v.groupBy(*L.KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("pts"))
    kind = F.when(c("kind") == "poi", "point").when(c("kind") == "area", "area").otherwise("line")
    doc = F.struct(
        F.lit("oldmaps").alias("app"), F.lit("data:image/png;base64,aGVsbG8=").alias("image"),
        F.struct(F.array(F.struct(kind.alias("type"), c("poi_type").alias("sym"), "pts")).alias("features")).alias("meta"),
    )
    docs = f.join(pts, L.KEYS).select(c("feature_id").alias("map_id"), F.to_json(doc).alias("j")).select("map_id", F.from_json("j", P.LEGACY_SCHEMA).alias("d")).select("map_id", "d.*")
    t = P.legacy_tables(docs, "oldmaps")
    n = t["vertices"].groupBy(*L.KEYS).agg(F.count("*").alias("points"))
    return t["features"].join(n, L.KEYS).select("map_id", "kind", "poi_type", "points", "name")


_LOOPBAD = """route_kind = 'loop' AND NOT (n >= 4 AND fx = zx AND fy = zy AND nd >= 3)"""


@query("s06_validate_projects", with_views("facts features anchors", f"""SELECT f.net_id AS map_id, 'feature/' || f.feature_id AS path, m AS message FROM features f JOIN facts a ON a.feature_id = f.feature_id, LATERAL (SELECT unnest([
 CASE WHEN f.kind = 'trail' AND n < 2 THEN 'pts must contain at least 2 points' END, CASE WHEN f.kind = 'trail' AND route_kind = 'one-way' AND fx = zx AND fy = zy THEN 'has one-way route but is closed or degenerate' END,
 CASE WHEN f.kind = 'trail' AND {_LOOPBAD} THEN 'loop must be closed with at least 3 distinct vertices' END, CASE WHEN f.kind = 'trail' AND route_kind = 'loop' AND NOT ({_LOOPBAD}) AND abs(area) <= 1e-6 THEN 'loop must have non-zero signed area' END,
 CASE WHEN f.kind = 'trail' AND route_kind = 'loop' AND NOT ({_LOOPBAD}) AND abs(area) > 1e-6 AND (CASE WHEN area > 0 THEN 'clockwise' ELSE 'counterclockwise' END) <> route_direction THEN 'loop direction does not match geometry winding' END]) AS m) q WHERE m IS NOT NULL
UNION ALL SELECT map_id, 'anchor/' || anchor_id, 'll must be null or a finite [lat, lon] pair' FROM anchors WHERE lat IS NOT NULL AND anchor_id % 19 = 0"""))
def _(spark, sf):
    f = C.features(spark, sf).withColumn("map_id", c("net_id"))
    a = C.anchors(spark, sf).withColumn("lon", F.when(c("anchor_id") % 19 != 0, c("lon")))
    a = a.withColumn("lat", F.when((c("anchor_id") % 17 != 0), c("lat")))
    maps = f.select("map_id").distinct().withColumn("width", F.lit(2000)).withColumn("height", F.lit(1500))
    return P.validate(maps, a, f, C.vertices(spark, sf, net=True))


@query("s08_sources", """SELECT url, CASE k WHEN 1 THEN 'Paste an ArcGIS REST MapServer URL with a cached tile service.' WHEN 2 THEN 'Only 256 × 256 cached ArcGIS tiles are supported.' WHEN 3 THEN 'Only the standard Web Mercator cache origin is supported.' WHEN 4 THEN 'The ArcGIS cache levels do not use the standard Web Mercator zoom matrix.' END AS reason,
 CASE k WHEN 5 THEN 2021 END AS year, 'Imagery: Owner ' || s_suppkey || ' via ArcGIS' || CASE k WHEN 5 THEN ' (2021)' ELSE '' END AS attribution FROM (SELECT *, s_suppkey % 6 AS k, 'https://host' || s_suppkey || '.example/rest/' || CASE s_suppkey % 6 WHEN 1 THEN 'FeatureServer' ELSE 'MapServer' END AS url FROM supplier)""")
def _(spark, sf):
    k, n = c("s_suppkey") % 6, c("s_suppkey").cast("string")
    lods = F.array(*[F.struct(F.lit(z).alias("level"), (F.when(k == 4, 1.05).otherwise(1.0) * (40075016.68557849 / 256 / 2**z)).alias("resolution")) for z in (15, 18, 20)])
    ref = F.struct(F.lit(102100).alias("wkid"))
    doc = F.struct(
        F.concat(F.lit("https://host"), n, F.lit(".example/rest/"), F.when(k == 1, "FeatureServer").otherwise("MapServer")).alias("url"), F.lit("svc").alias("name"),
        F.concat(F.lit("Owner "), n).alias("copyrightText"), F.when(k == 5, "flown in 2021 and later").alias("description"), F.lit(True).alias("singleFusedMapCache"),
        F.struct(F.lit(-8990000.0).alias("xmin"), F.lit(3100000.0).alias("ymin"), F.lit(-8900000.0).alias("xmax"), F.lit(3170000.0).alias("ymax"), ref.alias("spatialReference")).alias("fullExtent"),
        F.struct(
            F.when(k == 2, 512).otherwise(256).alias("rows"), F.lit(256).alias("cols"), ref.alias("spatialReference"), lods.alias("lods"),
            F.struct((F.when(k == 3, 50.0).otherwise(0.0) - F.lit(20037508.342787)).alias("x"), F.lit(20037508.342787).alias("y")).alias("origin"),
        ).alias("tileInfo"),
    )
    texts = C.table(spark, sf, "supplier").select(F.to_json(doc).alias("j"))
    return S.tiled_sources(S.from_service_text(texts, "j")).select("url", "reason", "year", "attribution")


def _doc_inputs(spark, sf):
    geo = cut(located(spark, sf))
    lengths = L.path_length(geo, c("kind") == "area")
    f = C.features(spark, sf).join(geo.select("map_id").distinct(), "map_id", "left_semi")
    return f, geo, cut(lengths)


def _docs(spark, sf, geo):
    return C.maps(spark, sf).select("map_id", "name").join(geo.select("map_id").distinct(), "map_id", "left_semi")


_DOCS = "(SELECT c_custkey AS map_id, c_name AS name FROM customer WHERE c_custkey IN (SELECT map_id FROM located))"
_F7 = "regexp_replace(regexp_replace(printf('%.7f', {}), '0+$', ''), '\\.$', '')"
_Q = "replace({}, '\"', '\\\"')"


@query("s10_geojson", with_views("docpoints docfeatures located", f"""SELECT map_id, section, ord, sub, part, text FROM (
SELECT map_id, 0 AS section, 0 AS ord, 0 AS sub, 0 AS part, '{{"type":"FeatureCollection","name":"' || name || '","features":[' || chr(10) AS text FROM {_DOCS} UNION ALL SELECT map_id, 9, 0, 0, 0, chr(10) || ']}}' || chr(10) FROM {_DOCS}
UNION ALL SELECT map_id, rk + 1, seq, 0, 0, CASE WHEN ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY rk, seq) = 1 THEN '' ELSE ',' || chr(10) END || '{{"type":"Feature","properties":{{"name":"' || {_Q.format('name')} || '","kind":"' || CASE kind WHEN 'poi' THEN poi_type ELSE kind END || '"'
  || CASE WHEN route_kind IS NOT NULL THEN ',"route":"' || route_kind || '"' ELSE '' END || CASE WHEN route_kind = 'loop' THEN ',"direction":"' || route_direction || '"' ELSE '' END || CASE WHEN description <> '' THEN ',"description":"' || replace({_Q.format('description')}, chr(10), '\\n') || '"' ELSE '' END
  || CASE kind WHEN 'poi' THEN ',"marker-color":"' || norm || '"' ELSE ',"stroke":"' || norm || '","length_m":' || CAST(floor(length_m + 0.5e0) AS BIGINT) END || '}},"geometry":{{"type":"' || CASE kind WHEN 'poi' THEN 'Point","coordinates":' WHEN 'trail' THEN 'LineString","coordinates":[' ELSE 'Polygon","coordinates":[[' END FROM docfeatures
UNION ALL SELECT map_id, rk + 1, feature_id, 1, 0, string_agg('[' || {_F7.format('lon')} || ',' || {_F7.format('lat')} || ']', ',' ORDER BY idx) FROM docpoints GROUP BY map_id, rk, feature_id
UNION ALL SELECT map_id, rk + 1, seq, 2, 0, CASE kind WHEN 'poi' THEN '}}}}' WHEN 'trail' THEN ']}}}}' ELSE ']]}}}}' END FROM docfeatures)"""))
def _(spark, sf):
    f, geo, lengths = _doc_inputs(spark, sf)
    return D.geojson_parts(_docs(spark, sf, geo), f, geo, lengths)


_HEAD = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="cairnfield" xmlns="http://www.topografix.com/GPX/1/1" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:gpx_style="http://www.topografix.com/GPX/gpx_style/0/2" xsi:schemaLocation="http://www.topografix.com/GPX/1/1 http://www.topografix.com/GPX/1/1/gpx.xsd">' || chr(10)"""
_SYM = "CASE poi_type WHEN 'Parking' THEN 'Parking Area' WHEN 'Viewpoint' THEN 'Scenic Area' WHEN 'Campsite' THEN 'Campground' WHEN 'Water' THEN 'Drinking Water' WHEN 'Junction' THEN 'Crossing' ELSE poi_type END"


@query("s11_gpx", with_views("docpoints docfeatures located", f"""SELECT map_id, section, ord, sub, part, text FROM (
SELECT map_id, 0 AS section, 0 AS ord, 0 AS sub, 0 AS part, {_HEAD} || '<metadata><name>' || name || '</name><time>1970-01-01T00:00:00Z</time></metadata>' || chr(10) AS text FROM {_DOCS} UNION ALL SELECT map_id, 9, 0, 0, 0, '</gpx>' || chr(10) FROM {_DOCS}
UNION ALL SELECT f.map_id, 1, f.seq, 0, 0, '<wpt lat="' || printf('%.7f', lat) || '" lon="' || printf('%.7f', lon) || '"><name>' || {_ESC.format('f.name')} || '</name>' || CASE WHEN notes <> '' THEN '<desc>' || {_ESC.format('notes')} || '</desc>' ELSE '' END || '<sym>' || {_SYM} || '</sym><type>' || poi_type || '</type></wpt>' || chr(10) FROM docfeatures f JOIN located l ON l.feature_id = f.feature_id WHERE f.kind = 'poi'
UNION ALL SELECT map_id, rk + 2, seq, 0, 0, '<trk><name>' || {_ESC.format('name')} || '</name><desc>' || {_ESC.format('description')} || '</desc><type>' || CASE kind WHEN 'area' THEN 'Area' ELSE 'Trail' END || '</type><extensions><gpx_style:line><gpx_style:color>' || substr(norm, 2) || '</gpx_style:color><gpx_style:width>4</gpx_style:width></gpx_style:line></extensions>' || chr(10) || '<trkseg>' || chr(10) FROM docfeatures WHERE kind <> 'poi'
UNION ALL SELECT map_id, rk + 2, feature_id, 1, 0, string_agg('<trkpt lat="' || printf('%.7f', lat) || '" lon="' || printf('%.7f', lon) || '"/>' || chr(10), '' ORDER BY idx) FROM docpoints WHERE kind <> 'poi' GROUP BY map_id, rk, feature_id
UNION ALL SELECT map_id, rk + 2, seq, 2, 0, '</trkseg></trk>' || chr(10) FROM docfeatures WHERE kind <> 'poi')"""))
def _(spark, sf):
    f, geo, lengths = _doc_inputs(spark, sf)
    return D.gpx_parts(_docs(spark, sf, geo), f, geo, lengths)


_ICON = "CASE poi_type WHEN 'Trailhead' THEN 'hiker' WHEN 'Parking' THEN 'parking_lot' WHEN 'Restroom' THEN 'toilets' WHEN 'Viewpoint' THEN 'camera' WHEN 'Campsite' THEN 'campground' WHEN 'Information' THEN 'info-i' WHEN 'Junction' THEN 'placemark_square' ELSE 'placemark_circle' END"
_ABGR = "substr(norm, 6, 2) || substr(norm, 4, 2) || substr(norm, 2, 2)"


@query("s12_kml", with_views("docpoints docfeatures located", f"""SELECT map_id, section, ord, sub, part, text FROM (
SELECT map_id, 0 AS section, 0 AS ord, 0 AS sub, 0 AS part, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2">' || chr(10) || '<Document><name>' || name || '</name><open>1</open>' || chr(10) AS text FROM {_DOCS}
UNION ALL SELECT map_id, 99, 0, 0, 0, '</Document>' || chr(10) || '</kml>' || chr(10) FROM {_DOCS}
UNION ALL SELECT map_id, rk + 1, seq, 0, 0, '<Style id="s-' || feature_id || '">' || CASE kind WHEN 'poi' THEN '<IconStyle><color>ff' || {_ABGR} || '</color><scale>1.1</scale><Icon><href>https://maps.google.com/mapfiles/kml/shapes/' || {_ICON} || '.png</href></Icon></IconStyle>'
  ELSE '<LineStyle><color>ff' || {_ABGR} || '</color><width>4</width></LineStyle><PolyStyle><color>55' || {_ABGR} || '</color></PolyStyle>' END || '</Style>' || chr(10) FROM docfeatures
UNION ALL SELECT DISTINCT map_id, rk * 3 + 10, 0, 0, 0, CASE rk WHEN 0 THEN '<Folder><name>Trails</name><open>1</open>' WHEN 1 THEN '<Folder><name>Areas</name>' ELSE '<Folder><name>Points of interest</name>' END || chr(10) FROM docfeatures
UNION ALL SELECT DISTINCT map_id, rk * 3 + 12, 0, 0, 0, '</Folder>' || chr(10) FROM docfeatures
UNION ALL SELECT map_id, rk * 3 + 11, seq, 0, 0, '<Placemark><name>' || {_ESC.format('name')} || '</name>' || CASE kind WHEN 'poi' THEN CASE WHEN notes <> '' THEN '<description>' || {_ESC.format('notes')} || '</description>' ELSE '' END || '<styleUrl>#s-' || feature_id || '</styleUrl><ExtendedData><Data name="type"><value>' || poi_type || '</value></Data></ExtendedData><Point><coordinates>'
  ELSE '<description>' || {_ESC.format('description')} || '</description><styleUrl>#s-' || feature_id || '</styleUrl>' || CASE kind WHEN 'trail' THEN CASE WHEN route_kind IS NOT NULL THEN '<ExtendedData><Data name="route"><value>' || route_kind || '</value></Data>' || CASE route_kind WHEN 'loop' THEN '<Data name="direction"><value>' || route_direction || '</value></Data>' ELSE '' END || '</ExtendedData>' ELSE '' END
   || '<LineString><tessellate>1</tessellate><altitudeMode>clampToGround</altitudeMode><coordinates>' ELSE '<Polygon><tessellate>1</tessellate><outerBoundaryIs><LinearRing><coordinates>' END END FROM docfeatures
UNION ALL SELECT map_id, rk * 3 + 11, feature_id, 1, 0, string_agg(printf('%.7f', lon) || ',' || printf('%.7f', lat) || ',0', ' ' ORDER BY idx) FROM docpoints GROUP BY map_id, rk, feature_id
UNION ALL SELECT map_id, rk * 3 + 11, seq, 2, 0, CASE kind WHEN 'poi' THEN '</coordinates></Point></Placemark>' WHEN 'trail' THEN '</coordinates></LineString></Placemark>' ELSE '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' END || chr(10) FROM docfeatures)"""))
def _(spark, sf):
    f, geo, lengths = _doc_inputs(spark, sf)
    return D.kml_parts(_docs(spark, sf, geo), f, geo, lengths)


@query("s10_preview_features", with_views("located features", "SELECT f.map_id, f.feature_id, f.kind FROM features f JOIN (SELECT feature_id, COUNT(*) AS n FROM located GROUP BY feature_id) l ON l.feature_id = f.feature_id WHERE n >= CASE f.kind WHEN 'trail' THEN 2 WHEN 'area' THEN 3 ELSE 1 END"))
def _(spark, sf):
    return D.preview_features(C.features(spark, sf), located(spark, sf)).select("map_id", "feature_id", "kind")
