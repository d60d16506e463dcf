"""Queries: measures of lines, routes, windows along lines, simplification."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.functions.plane import project_on_segment, segment_intersects_rect
from cairnfield.operators import lines as L
from cairnfield.operators import routes as R
from cairnfield.operators import simplify as S
from cairnfield.plans import corpus as C
from cairnfield.plans.corpus import with_views
from cairnfield.plans.fits import r
from cairnfield.plans.registry import query
from cairnfield.plans.sqlparts import WINDING, on_segment
from cairnfield.session import cut

c = F.col


@query("p02_segments", with_views("segs", """SELECT map_id, feature_id, seg, x1, y1, x2, y2 FROM segs WHERE kind <> 'poi'
UNION ALL SELECT z.map_id, z.feature_id, z.idx, z.x, z.y, a.x, a.y FROM net_vertices a JOIN (SELECT map_id, feature_id, MAX(idx) AS idx, arg_max(x, idx) AS x, arg_max(y, idx) AS y FROM net_vertices WHERE kind = 'area' GROUP BY map_id, feature_id) z
  ON z.feature_id = a.feature_id WHERE a.idx = 0"""))
def _(spark, sf):
    v = C.vertices(spark, sf, net=True).where("kind <> 'poi'")
    return L.segments(v, closed=c("kind") == "area").select("map_id", "feature_id", "seg", "x1", "y1", "x2", "y2")


_POINTS = "(SELECT map_id, feature_id AS pid, x, y FROM net_vertices WHERE kind = 'poi')"


def _pois(v):
    return v.where("kind = 'poi'").select("map_id", c("feature_id").alias("pid"), "x", "y")


_RINGSEGS = """SELECT map_id, feature_id, x1, y1, x2, y2 FROM segs WHERE kind = 'area' UNION ALL SELECT z.map_id, z.feature_id, z.x, z.y, a.x, a.y FROM net_vertices a
  JOIN (SELECT map_id, feature_id, arg_max(x, idx) AS x, arg_max(y, idx) AS y FROM net_vertices WHERE kind = 'area' GROUP BY map_id, feature_id) z ON z.feature_id = a.feature_id WHERE a.idx = 0"""


@query("p03_point_in_polygon", with_views("segs", f"""WITH ring AS ({_RINGSEGS})
SELECT map_id, pid, feature_id FROM (SELECT p.map_id, p.pid, r.feature_id, COUNT(*) FILTER ((y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / nullif(y2 - y1, 0) + x1) AS n
  FROM {_POINTS} p JOIN ring r ON r.map_id = p.map_id GROUP BY p.map_id, p.pid, r.feature_id) WHERE n % 2 = 1"""))
def _(spark, sf):
    v = C.vertices(spark, sf, net=True)
    return L.point_in_polygon(_pois(v), v.where("kind = 'area'"), ["pid"])


_CLIP = "greatest(0e0, {a}, {b}) <= least(1e0, {c}, {d})"


def _clip_sql(left: str, top: str, right: str, bottom: str) -> str:
    def axis(s: str, e: str, lo: str, hi: str) -> tuple[str, str]:
        d = f"({e} - {s})"
        still = f"CASE WHEN {s} BETWEEN {lo} AND {hi} THEN {{}} ELSE {{}} END"
        return (
            f"CASE WHEN {d} = 0 THEN {still.format('0e0', '2e0')} ELSE least(({lo} - {s}) / nullif({d}, 0), ({hi} - {s}) / nullif({d}, 0)) END",
            f"CASE WHEN {d} = 0 THEN {still.format('1e0', '-1e0')} ELSE greatest(({lo} - {s}) / nullif({d}, 0), ({hi} - {s}) / nullif({d}, 0)) END",
        )

    ax, bx = axis("x1", "x2", left, right)
    ay, by = axis("y1", "y2", top, bottom)
    return _CLIP.format(a=ax, b=ay, c=bx, d=by)


@query("p04_segment_rect", with_views("trail_segs", f"SELECT map_id, feature_id, seg, {_clip_sql('500e0', '400e0', '1100e0', '900e0')} AS meets FROM trail_segs"))
def _(spark, sf):
    meets = segment_intersects_rect(c("x1"), c("y1"), c("x2"), c("y2"), *[F.lit(v) for v in (500.0, 400.0, 1100.0, 900.0)])
    return L.segments(C.trail_vertices(spark, sf)).select("map_id", "feature_id", "seg", meets.alias("meets"))


@query("p05_select_in_rect", with_views("trail_segs", f"""WITH rects AS (SELECT DISTINCT map_id, 1500 - (map_id % 7) * 100 AS x, 200 + (map_id % 5) * 80 AS y, -160 AS w, 220 AS h FROM trail_segs)
SELECT DISTINCT s.map_id, s.map_id AS rect_id, feature_id FROM trail_segs s JOIN rects r ON r.map_id = s.map_id WHERE {_clip_sql('least(x, x + w)', 'least(y, y + h)', 'greatest(x, x + w)', 'greatest(y, y + h)')}"""))
def _(spark, sf):
    v = C.trail_vertices(spark, sf)
    m = c("map_id")
    rects = v.select("map_id").distinct().select(
        "map_id", m.alias("rect_id"), (1500 - m % 7 * 100).cast("double").alias("rx"), (m % 5 * 80 + 200).cast("double").alias("ry"),
        F.lit(-160.0).alias("rw"), F.lit(220.0).alias("rh"),
    )
    return L.select_in_rect(v, rects)


@query("g01_pixel_length", with_views("trail_segs", "SELECT map_id, feature_id, round(SUM(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))), 4) AS length_px FROM trail_segs GROUP BY map_id, feature_id"))
def _(spark, sf):
    return L.pixel_length(C.trail_vertices(spark, sf)).withColumn("length_px", r(c("length_px"), 4))


@query("g02_bounds", with_views("net_vertices", """SELECT map_id, feature_id, MIN(x) AS "left", MIN(y) AS top, MAX(x) AS "right", MAX(y) AS bottom FROM net_vertices GROUP BY map_id, feature_id"""))
def _(spark, sf):
    return L.bounds(C.vertices(spark, sf, net=True))


@query("g03_signed_area", with_views("facts", f"SELECT map_id, feature_id, area, {WINDING} AS winding FROM facts"))
def _(spark, sf):
    return L.signed_area(C.vertices(spark, sf, net=True))


@query("g04_closed_loop", with_views("facts", "SELECT map_id, feature_id, n, nd AS n_distinct, n >= 4 AND fx = zx AND fy = zy AND nd >= 3 AS closed FROM facts"))
def _(spark, sf):
    return L.is_closed_loop(C.vertices(spark, sf, net=True))


_REASON = f"""CASE WHEN route_kind = 'one-way' THEN CASE WHEN n < 2 THEN 'A one-way trail needs at least 2 points' WHEN fx = zx AND fy = zy THEN 'A one-way trail cannot be closed' END
  WHEN route_kind = 'loop' THEN CASE WHEN NOT (n >= 4 AND fx = zx AND fy = zy AND nd >= 3) THEN 'Loop must be closed with at least 3 distinct vertices' WHEN ({WINDING}) IS NULL THEN 'Loop must have non-zero area'
    WHEN ({WINDING}) <> route_direction THEN 'Loop direction ' || route_direction || ' does not match geometry winding ' || ({WINDING}) END END"""


@query("p08_route_check", with_views("facts features", f"""SELECT map_id, feature_id, route_kind, reason, reason IS NULL AS valid FROM (SELECT f.net_id AS map_id, f.feature_id, f.route_kind, {_REASON} AS reason
FROM features f JOIN facts a ON a.feature_id = f.feature_id WHERE f.kind = 'trail')"""))
def _(spark, sf):
    f = C.features(spark, sf).withColumn("map_id", c("net_id"))
    return L.route_check(f, C.vertices(spark, sf, net=True))


_LOOPS = f"""SELECT map_id, feature_id, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN w END AS direction FROM (
  SELECT *, CASE WHEN n < 3 THEN 'A loop requires at least 3 vertices.' WHEN gap > 60 THEN 'Trail ends are too far apart (' || printf('%.1f', gap) || ' px) to close into a loop (must be within snap tolerance of 60.0 px).'
    WHEN nd2 < 3 THEN 'A loop requires at least 3 distinct vertices.' WHEN w IS NULL THEN 'Trail has zero area and cannot form a loop.' END AS error FROM (
    SELECT f.map_id, f.feature_id, n, nd2, sqrt(pow(fx - zx, 2) + pow(fy - zy, 2)) AS gap, CASE WHEN a2 > 1e-6 THEN 'clockwise' WHEN a2 < -1e-6 THEN 'counterclockwise' END AS w
    FROM facts f JOIN (SELECT feature_id, COUNT(DISTINCT x * 10000 + y) AS nd2, SUM(COALESCE(x * ny - nx * y, 0e0)) / 2 AS a2 FROM (
      SELECT feature_id, x, y, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny FROM (SELECT v.feature_id, v.idx, CASE WHEN v.idx = n - 1 THEN fx ELSE v.x END AS x, CASE WHEN v.idx = n - 1 THEN fy ELSE v.y END AS y
        FROM net_vertices v JOIN facts f ON f.feature_id = v.feature_id) WINDOW w AS (PARTITION BY feature_id ORDER BY idx)) GROUP BY feature_id) s ON s.feature_id = f.feature_id WHERE f.kind = 'trail'))"""


@query("f14_close_as_loop", with_views("facts", _LOOPS))
def _(spark, sf):
    return L.close_as_loop(C.trail_vertices(spark, sf), 60.0)


@query("f13_rotate_loop", with_views("facts", """SELECT v.map_id, v.feature_id, CAST(i AS BIGINT) AS idx, v.x, v.y FROM (SELECT v.*, (v.idx - (1 + f.feature_id % 3) % (n - 1) + (n - 1)) % (n - 1) AS j, n - 1 AS m FROM net_vertices v JOIN facts f ON f.feature_id = v.feature_id
  WHERE n >= 4 AND fx = zx AND fy = zy AND nd >= 3 AND f.kind = 'trail' AND v.idx < n - 1) v, LATERAL (SELECT unnest(CASE WHEN j = 0 THEN [j, m] ELSE [j] END) AS i)"""))
def _(spark, sf):
    v = C.trail_vertices(spark, sf)
    starts = v.select("map_id", "feature_id").distinct().withColumn("start", 1 + c("feature_id") % 3)
    return L.rotate_loop(v, starts)


@query("f13_reverse_lines", with_views("trail_vertices", "SELECT map_id, feature_id, MAX(idx) OVER (PARTITION BY feature_id) - idx AS idx, x, y FROM trail_vertices"))
def _(spark, sf):
    return L.reverse_lines(C.trail_vertices(spark, sf))


@query("f09_project_on_segment", with_views("trail_segs", f"SELECT map_id, feature_id, seg, round(t, 6) AS t, round(x1 + t * (x2 - x1), 4) AS x, round(y1 + t * (y2 - y1), 4) AS y FROM (SELECT *, {on_segment('700e0', '600e0')} AS t FROM trail_segs)"))
def _(spark, sf):
    p = project_on_segment(F.lit(700.0), F.lit(600.0), c("x1"), c("y1"), c("x2"), c("y2"))
    rows = L.segments(C.trail_vertices(spark, sf)).withColumn("_p", p)
    return rows.select("map_id", "feature_id", "seg", r(c("_p.t"), 6).alias("t"), r(c("_p.x"), 4).alias("x"), r(c("_p.y"), 4).alias("y"))


@query("w01_neighbours", with_views("trail_vertices", "SELECT map_id, feature_id, idx, x, LAG(x) OVER w AS prev_x, LEAD(x) OVER w AS next_x FROM trail_vertices WINDOW w AS (PARTITION BY feature_id ORDER BY idx)"))
def _(spark, sf):
    from cairnfield.operators.ordered import with_next

    v = with_next(C.trail_vertices(spark, sf), L.KEYS, {"x": "next_x"})
    return with_next(v, L.KEYS, {"x": "prev_x"}, back=True).drop("y")


@query("w02_cumulative_length", with_views("cum", "SELECT map_id, feature_id, idx, round(dist, 4) AS dist FROM cum"))
def _(spark, sf):
    return L.cumulative_length(C.trail_vertices(spark, sf)).select("map_id", "feature_id", "idx", r(c("dist"), 4).alias("dist"))


_AT = """SELECT map_id, feature_id, x, y FROM (SELECT s.map_id, s.feature_id, seg, x1 + (x2 - x1) * t AS x, y1 + (y2 - y1) * t AS y, ROW_NUMBER() OVER (PARTITION BY s.feature_id ORDER BY seg) AS rn FROM (
  SELECT s.*, w.d, CASE WHEN d2 = d1 THEN 0e0 ELSE least(1e0, (w.d - d1) / nullif(d2 - d1, 0)) END AS t FROM msegs s JOIN ({want}) w ON w.feature_id = s.feature_id
  WHERE w.d <= d2 OR seg = w.last) s) WHERE rn = 1"""


@query("w03_point_at", with_views("msegs", "SELECT map_id, feature_id, round(x, 4) AS x, round(y, 4) AS y FROM (" + _AT.format(want="SELECT feature_id, 250e0 AS d, MAX(seg) AS last FROM msegs GROUP BY feature_id") + ")"))
def _(spark, sf):
    v = C.trail_vertices(spark, sf)
    want = v.select("map_id", "feature_id").distinct().withColumn("d", F.lit(250.0))
    return L.point_at(v, want).select("map_id", "feature_id", r(c("x"), 4).alias("x"), r(c("y"), 4).alias("y"))


@query("w03_midpoints", with_views("msegs", "SELECT map_id, feature_id, round(x, 3) AS x, round(y, 3) AS y FROM (" + _AT.format(want="SELECT feature_id, MAX(d2) / 2 AS d, MAX(seg) AS last FROM msegs GROUP BY feature_id HAVING MAX(d2) > 0") + ")"))
def _(spark, sf):
    return L.midpoints(C.trail_vertices(spark, sf)).select("map_id", "feature_id", r(c("x"), 3).alias("x"), r(c("y"), 3).alias("y"))


_STATIONS = """SELECT map_id, feature_id, d, x1 + (x2 - x1) * (d - d1) / (d2 - d1) AS x, y1 + (y2 - y1) * (d - d1) / (d2 - d1) AS y, FALSE AS pinned
  FROM (SELECT *, unnest(range(CAST(floor(d1 / 60) AS BIGINT) + 1, CAST(floor(d2 / 60) AS BIGINT) + 1)) * 60e0 AS d FROM msegs)
UNION ALL SELECT c.map_id, c.feature_id, dist, x, y, TRUE FROM cum c JOIN (SELECT feature_id, MAX(idx) AS last FROM cum GROUP BY feature_id) l ON l.feature_id = c.feature_id WHERE idx = 0 OR idx = last"""


@query("w04_stations", with_views("msegs", f"SELECT map_id, feature_id, round(d, 3) AS d, round(arg_max(x, pinned), 3) + 0e0 AS x, round(arg_max(y, pinned), 3) + 0e0 AS y, bool_or(pinned) AS pinned FROM ({_STATIONS}) GROUP BY map_id, feature_id, d"))
def _(spark, sf):
    s = L.stations(C.trail_vertices(spark, sf), 60.0)
    return s.select("map_id", "feature_id", r(c("d"), 3).alias("d"), r(c("x"), 3).alias("x"), r(c("y"), 3).alias("y"), "pinned")


@query("o03_distinct_station_keys", with_views("msegs", f"SELECT DISTINCT map_id, CAST(floor(x / 64) AS BIGINT) AS cell_x, CAST(floor(y / 64) AS BIGINT) AS cell_y FROM ({_STATIONS})"))
def _(spark, sf):
    s = L.stations(C.trail_vertices(spark, sf), 60.0)
    return s.select("map_id", F.floor(c("x") / 64).cast("bigint").alias("cell_x"), F.floor(c("y") / 64).cast("bigint").alias("cell_y")).distinct()


@query("w05_union_length", with_views("segs", """SELECT map_id, SUM(greatest(hi - greatest(lo, done), 0e0)) AS covered FROM (SELECT *, COALESCE(MAX(hi) OVER (PARTITION BY map_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS done
  FROM (SELECT map_id, least(x1, x2) AS lo, greatest(x1, x2) AS hi FROM segs WHERE kind = 'trail' AND x1 <> x2)) GROUP BY map_id"""))
def _(spark, sf):
    s = L.segments(C.trail_vertices(spark, sf)).where("x1 <> x2")
    return L.union_length(s.select("map_id", F.least("x1", "x2").alias("lo"), F.greatest("x1", "x2").alias("hi")), ["map_id"])


@query("w10_end_directions", with_views("ends", """SELECT map_id, feature_id, side, round(CASE WHEN l > 0 THEN dx / nullif(l, 0) ELSE 0e0 END, 6) + 0e0 AS dx, round(CASE WHEN l > 0 THEN dy / nullif(l, 0) ELSE 0e0 END, 6) + 0e0 AS dy FROM (SELECT *, sqrt(dx * dx + dy * dy) AS l FROM (
  SELECT e.map_id, e.feature_id, e.side, COALESCE(CASE e.side WHEN 0 THEN arg_min(v.x, v.idx) ELSE arg_max(v.x, v.idx) END - e.x, 0e0) AS dx, COALESCE(CASE e.side WHEN 0 THEN arg_min(v.y, v.idx) ELSE arg_max(v.y, v.idx) END - e.y, 0e0) AS dy
  FROM ends e LEFT JOIN trail_vertices v ON v.feature_id = e.feature_id AND (v.x <> e.x OR v.y <> e.y) GROUP BY e.map_id, e.feature_id, e.side, e.x, e.y))"""))
def _(spark, sf):
    d = L.end_directions(C.trail_vertices(spark, sf))
    return d.select("map_id", "feature_id", "side", r(c("dx"), 6).alias("dx"), r(c("dy"), 6).alias("dy"))


@query("k01_export_order", with_views("features", "SELECT map_id, feature_id, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY CASE kind WHEN 'trail' THEN 0 WHEN 'area' THEN 1 ELSE 2 END, seq) AS position FROM features"))
def _(spark, sf):
    from cairnfield.operators.ordered import number_rows

    f = L.export_order(C.features(spark, sf)).select("map_id", "feature_id", "kind_rank", "seq")
    return number_rows(f, ["map_id"], [c("kind_rank"), c("seq")], "position").select("map_id", "feature_id", "position")


@query("j05_project_points", with_views("trail_segs", f"""SELECT map_id, feature_id, seg, round(t, 6) AS t, round(hx, 4) AS x, round(hy, 4) AS y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY pow(px - hx, 2) + pow(py - hy, 2), seg) AS rn FROM (
  SELECT *, x1 + t * (x2 - x1) AS hx, y1 + t * (y2 - y1) AS hy FROM (SELECT *, {on_segment('px', 'py')} AS t FROM (SELECT *, (feature_id * 31 % 2000) + 0.25e0 AS px, (feature_id * 17 % 1500) + 0.5e0 AS py FROM trail_segs)))) WHERE rn = 1"""))
def _(spark, sf):
    v = C.trail_vertices(spark, sf)
    f = c("feature_id")
    pts = v.select("map_id", "feature_id").distinct().withColumn("x", f * 31 % 2000 + F.lit(0.25)).withColumn("y", f * 17 % 1500 + F.lit(0.5))
    out = L.project_points(pts, v, [])
    return out.select("map_id", "feature_id", "seg", r(c("t"), 6).alias("t"), r(c("x"), 4).alias("x"), r(c("y"), 4).alias("y"))


@query("j18_junctions", with_views("net_vertices", """SELECT map_id, x, y FROM net_vertices WHERE kind <> 'poi' GROUP BY map_id, x, y
HAVING COUNT(DISTINCT CASE WHEN kind = 'trail' THEN feature_id END) >= 2 OR (COUNT(*) FILTER (kind = 'trail') > 0 AND COUNT(*) FILTER (kind = 'area') > 0)"""))
def _(spark, sf):
    return S.junctions(C.vertices(spark, sf, net=True))


@query("t12_simplify")
def _(spark, sf):
    out = S.simplify(C.vertices(spark, sf, net=True), 150.0)
    return out.select("map_id", "feature_id", "idx", "x", "y")


@query("t13_smooth", with_views("trail_vertices", """WITH n AS (SELECT *, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny, MAX(idx) OVER (PARTITION BY feature_id) AS top FROM trail_vertices WINDOW w AS (PARTITION BY feature_id ORDER BY idx)),
p AS (SELECT map_id, feature_id, idx * 3 AS o, x, y FROM n WHERE idx = 0 OR idx = top
  UNION ALL SELECT map_id, feature_id, idx * 3 + 1, floor((0.75e0 * x + 0.25e0 * nx) * 100 + 0.5e0) / 100, floor((0.75e0 * y + 0.25e0 * ny) * 100 + 0.5e0) / 100 FROM n WHERE idx > 0 AND idx < top
  UNION ALL SELECT map_id, feature_id, idx * 3 + 2, floor((0.25e0 * x + 0.75e0 * nx) * 100 + 0.5e0) / 100, floor((0.25e0 * y + 0.75e0 * ny) * 100 + 0.5e0) / 100 FROM n WHERE idx + 1 < top)
SELECT map_id, feature_id, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY o) - 1 AS idx, x, y FROM p"""))
def _(spark, sf):
    v = C.trail_vertices(spark, sf).withColumn("kind", F.lit("trail"))
    return S.smooth(v).select("map_id", "feature_id", "idx", "x", "y")


@query("t14_simplify_maps")
def _(spark, sf):
    # Junctions, lines, points and the count before read the vertices; they are derived once.
    v = cut(C.vertices(spark, sf, net=True))
    return S.simplify_report(v, S.simplify_maps(v, 100.0, True))


_FOUND = "SELECT map_id, feature_id AS line_id, x1, y1, x2, y2, feature_id * 100 + seg AS sid FROM trail_segs WHERE feature_id % 2 = 0"
_TRUTH = "SELECT map_id, feature_id AS line_id, x1, y1, x2, y2, feature_id * 100 + seg AS sid FROM trail_segs WHERE feature_id % 2 = 1"


def _capsule_sql(own: str, other: str, tol: float) -> str:
    return f"""SELECT map_id, sid, oid, lo, hi FROM (SELECT map_id, sid, oid, unnest([greatest(0e0, (-p1 - sqrt(greatest(k1, 0e0))) / dd), greatest(0e0, (-p2 - sqrt(greatest(k2, 0e0))) / dd), greatest(CASE WHEN abs(dv) < 1e-12 THEN CASE WHEN wv BETWEEN 0 AND vv THEN 0e0 ELSE 1e0 END ELSE greatest(0e0, least((0 - wv) / nullif(dv, 0), (vv - wv) / nullif(dv, 0))) END,
    CASE WHEN abs(dc) < 1e-12 THEN CASE WHEN wc BETWEEN -reach AND reach THEN 0e0 ELSE 1e0 END ELSE greatest(0e0, least((-reach - wc) / nullif(dc, 0), (reach - wc) / nullif(dc, 0))) END)]) AS lo,
  unnest([least(1e0, (-p1 + sqrt(greatest(k1, 0e0))) / dd), least(1e0, (-p2 + sqrt(greatest(k2, 0e0))) / dd), least(CASE WHEN abs(dv) < 1e-12 THEN CASE WHEN wv BETWEEN 0 AND vv THEN 1e0 ELSE 0e0 END ELSE least(1e0, greatest((0 - wv) / nullif(dv, 0), (vv - wv) / nullif(dv, 0))) END,
    CASE WHEN abs(dc) < 1e-12 THEN CASE WHEN wc BETWEEN -reach AND reach THEN 1e0 ELSE 0e0 END ELSE least(1e0, greatest((-reach - wc) / nullif(dc, 0), (reach - wc) / nullif(dc, 0))) END)]) AS hi,
  unnest([k1, k2, CASE WHEN vv > 0 THEN 1e0 ELSE -1e0 END]) AS ok
 FROM (SELECT *, p1 * p1 - dd * (pow(x1 - u1, 2) + pow(y1 - w1, 2) - {tol} * {tol}) AS k1, p2 * p2 - dd * (pow(x1 - u2, 2) + pow(y1 - w2, 2) - {tol} * {tol}) AS k2, sqrt(vv) * {tol} AS reach FROM (
  SELECT a.map_id, a.sid, b.sid AS oid, a.x1, a.y1, b.x1 AS u1, b.y1 AS w1, b.x2 AS u2, b.y2 AS w2, pow(a.x2 - a.x1, 2) + pow(a.y2 - a.y1, 2) AS dd, pow(b.x2 - b.x1, 2) + pow(b.y2 - b.y1, 2) AS vv,
   (a.x1 - b.x1) * (a.x2 - a.x1) + (a.y1 - b.y1) * (a.y2 - a.y1) AS p1, (a.x1 - b.x2) * (a.x2 - a.x1) + (a.y1 - b.y2) * (a.y2 - a.y1) AS p2,
   (a.x1 - b.x1) * (b.x2 - b.x1) + (a.y1 - b.y1) * (b.y2 - b.y1) AS wv, (a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1) AS dv,
   (a.x1 - b.x1) * (b.y2 - b.y1) - (a.y1 - b.y1) * (b.x2 - b.x1) AS wc, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS dc
  FROM {own} a JOIN {other} b ON a.map_id = b.map_id AND greatest(a.x1, a.x2) + {tol} >= least(b.x1, b.x2) AND least(a.x1, a.x2) - {tol} <= greatest(b.x1, b.x2)
    AND greatest(a.y1, a.y2) + {tol} >= least(b.y1, b.y2) AND least(a.y1, a.y2) - {tol} <= greatest(b.y1, b.y2)) WHERE dd > 0)) WHERE ok >= 0 AND hi > lo"""


def _cover_sql(own: str, other: str, tol: float) -> str:
    return f"""SELECT map_id, sid, SUM(greatest(hi - greatest(lo, done), 0e0)) AS covered FROM (SELECT *, COALESCE(MAX(hi) OVER (PARTITION BY map_id, sid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS done
 FROM ({_capsule_sql(own, other, tol)})) GROUP BY map_id, sid"""


def _share_sql(own: str, other: str, tol: float) -> str:
    return f"""SELECT o.map_id, least(1e0, SUM(l * COALESCE(covered, 0e0)) / SUM(l)) AS share FROM (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS l FROM {own}) o
 LEFT JOIN ({_cover_sql(own, other, tol)}) k ON k.sid = o.sid AND k.map_id = o.map_id GROUP BY o.map_id"""


def _sides(spark, sf):
    v = C.trail_vertices(spark, sf).withColumnRenamed("feature_id", "line_id")
    return v.where("line_id % 2 = 0"), v.where("line_id % 2 = 1")


@query("j19_capsule_intervals", with_views("trail_segs", f"""WITH f AS ({_FOUND}), t AS ({_TRUTH}) SELECT map_id, sid AS seg_id, COUNT(*) AS n, round(SUM(hi - lo), 4) AS total FROM (
SELECT map_id, sid, oid, MIN(lo) AS lo, MAX(hi) AS hi FROM ({_capsule_sql('f', 't', 5.0)}) GROUP BY map_id, sid, oid HAVING MAX(hi) - MIN(lo) > 1e-6) GROUP BY map_id, sid"""))
def _(spark, sf):
    found, truth = _sides(spark, sf)
    seg = lambda v: L.segments(v, ["map_id", "line_id"]).withColumn("seg_id", c("line_id") * 100 + c("seg"))
    iv = L.capsule_intervals(seg(found), seg(truth), 5.0, ["map_id"])
    # Segments that only touch the capsule are near for rounding errors.
    return iv.where("hi - lo > 1e-6").groupBy("map_id", "seg_id").agg(F.count("*").alias("n"), r(F.sum(c("hi") - c("lo")), 4).alias("total"))


@query("g25_line_match", with_views("trail_segs", f"""WITH f AS ({_FOUND}), t AS ({_TRUTH})
SELECT m.map_id, round(COALESCE(a.share, 1e0), 5) AS recall, round(COALESCE(b.share, 1e0), 5) AS precision FROM (SELECT DISTINCT map_id FROM trail_segs) m
LEFT JOIN ({_share_sql('t', 'f', 5.0)}) a ON a.map_id = m.map_id LEFT JOIN ({_share_sql('f', 't', 5.0)}) b ON b.map_id = m.map_id"""))
def _(spark, sf):
    found, truth = _sides(spark, sf)
    m = L.line_match(found, truth, 5.0)
    return m.select("map_id", r(c("recall"), 5).alias("recall"), r(c("precision"), 5).alias("precision"))


_HD = """SELECT b.pair_id, MAX(d2) AS d2 FROM (SELECT p.pair_id, p.seg, p.i, MIN(pow(px - (x1 + t * (x2 - x1)), 2) + pow(py - (y1 + t * (y2 - y1)), 2)) AS d2 FROM (
  SELECT p.*, s.x1, s.y1, s.x2, s.y2, {t} AS t FROM (SELECT pair_id, seg, i, x1 + (x2 - x1) * i / k AS px, y1 + (y2 - y1) * i / k AS py FROM (SELECT *, unnest(range(k + 1)) AS i FROM (
    SELECT *, greatest(1, CAST(ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 50e0) AS BIGINT)) AS k FROM {a}))) p JOIN {b} s ON s.pair_id = p.pair_id) p GROUP BY p.pair_id, p.seg, p.i) b GROUP BY b.pair_id"""


@query("g26_hausdorff", with_views("trail_segs", f"""WITH e AS (SELECT (feature_id // 2) AS pair_id, seg, x1, y1, x2, y2 FROM trail_segs WHERE feature_id % 2 = 0), o AS (SELECT (feature_id // 2) AS pair_id, seg, x1, y1, x2, y2 FROM trail_segs WHERE feature_id % 2 = 1)
SELECT pair_id, round(sqrt(MAX(d2)), 3) AS hausdorff FROM ({_HD.format(a='e', b='o', t=on_segment('px', 'py', 's.x1', 's.y1', 's.x2', 's.y2'))} UNION ALL {_HD.format(a='o', b='e', t=on_segment('px', 'py', 's.x1', 's.y1', 's.x2', 's.y2'))}) GROUP BY pair_id
UNION ALL SELECT pair_id, CAST('Infinity' AS DOUBLE) FROM (SELECT pair_id FROM e UNION ALL SELECT pair_id FROM o) GROUP BY pair_id HAVING pair_id NOT IN (SELECT pair_id FROM e) OR pair_id NOT IN (SELECT pair_id FROM o)"""))
def _(spark, sf):
    v = C.trail_vertices(spark, sf).withColumn("pair_id", F.floor(c("feature_id") / 2).cast("bigint"))
    a, b = v.where("feature_id % 2 = 0"), v.where("feature_id % 2 = 1")
    h = L.hausdorff(a, b, 50.0, ["pair_id"])
    return h.withColumn("hausdorff", r(c("hausdorff"), 3))


@query("t18_set_routes", with_views("facts features", f"""WITH cl AS ({_LOOPS}) SELECT f.net_id AS map_id, f.feature_id, want, CASE want WHEN 'loop' THEN cl.error
  WHEN 'one-way' THEN CASE WHEN a.fx = a.zx AND a.fy = a.zy THEN 'A closed trail cannot be marked as a one-way route.' END END AS error,
  CASE WHEN want = 'loop' AND cl.ok THEN cl.direction END AS direction FROM (SELECT *, CASE feature_id % 3 WHEN 0 THEN 'loop' WHEN 1 THEN 'one-way' ELSE 'clear' END AS want FROM features WHERE kind = 'trail') f
JOIN facts a ON a.feature_id = f.feature_id JOIN cl ON cl.feature_id = f.feature_id"""))
def _(spark, sf):
    v = C.trail_vertices(spark, sf)
    k = c("feature_id") % 3
    want = v.select("map_id", "feature_id").distinct().withColumn("want", F.when(k == 0, "loop").when(k == 1, "one-way").otherwise("clear"))
    return R.set_routes(v, want.withColumn("want_direction", F.lit(None).cast("string")), 60.0)["verdicts"].select("map_id", "feature_id", "want", "error", "direction")
