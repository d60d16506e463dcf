"""Queries: line ends, junctions, edits and chains on the nets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.operators import hits as H
from cairnfield.operators import lines as L
from cairnfield.operators import topology as T
from cairnfield.plans import corpus as C
from cairnfield.plans.corpus import VIEWS, with_views
from cairnfield.plans.fits import r
from cairnfield.plans.registry import query
from cairnfield.plans.sqlparts import on_segment
from cairnfield.session import cut

c = F.col
TOL = 8.0

VIEWS["targets"] = (
    ["clusters", "hits"],
    """SELECT map_id, feature_id, side, x, y, cx AS tx, cy AS ty FROM clusters WHERE size > 1 UNION ALL SELECT map_id, feature_id, side, x, y, hx, hy FROM hits""",
)
VIEWS["snapped"] = (
    ["targets", "hits", "trail_vertices"],
    """WITH ins AS (SELECT map_id, onf AS feature_id, seg + MIN(t) AS k, hx AS x, hy AS y FROM hits WHERE t > 1e-9 AND t < 1 - 1e-9 GROUP BY map_id, onf, seg, hx, hy),
changed AS (SELECT feature_id FROM targets WHERE x <> tx OR y <> ty UNION SELECT feature_id FROM ins)
SELECT map_id, feature_id, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY k) - 1 AS idx, x, y FROM (
  SELECT v.map_id, v.feature_id, CAST(v.idx AS DOUBLE) AS k, COALESCE(t.tx, v.x) AS x, COALESCE(t.ty, v.y) AS y FROM (SELECT *, MAX(idx) OVER (PARTITION BY feature_id) AS top FROM trail_vertices) v
    LEFT JOIN targets t ON t.feature_id = v.feature_id AND ((t.side = 0 AND v.idx = 0) OR (t.side = 1 AND v.idx = v.top)) WHERE v.feature_id IN (SELECT feature_id FROM changed)
  UNION ALL SELECT map_id, feature_id, k, x, y FROM ins)""",
)


def _trails(spark, sf):
    return C.trail_vertices(spark, sf)


@query("j03_near_ends", with_views("endpairs", """SELECT map_id, feature_id, side, bf AS near_feature_id, bs AS near_side, round(sqrt(d2), 4) AS distance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY d2, bf, bs) AS rn FROM endpairs) WHERE rn = 1"""))
def _(spark, sf):
    return T.near_ends(_trails(spark, sf), TOL).withColumn("distance", r(c("distance"), 4))


@query("j04_nearest_segment", with_views("hits", "SELECT map_id, feature_id, side, onf AS on_feature_id, seg, round(t, 6) AS t, round(hx, 4) AS x, round(hy, 4) AS y FROM hits"))
def _(spark, sf):
    v = _trails(spark, sf)
    lone = T.endpoint_clusters(v, TOL).where("size < 2")
    n = T.nearest_segment(lone, L.segments(v), TOL)
    return n.select("map_id", "feature_id", "side", "on_feature_id", "seg", r(c("t"), 6).alias("t"), r(c("hx"), 4).alias("x"), r(c("hy"), 4).alias("y"))


@query("t01_endpoint_clusters", with_views("clusters", "SELECT map_id, feature_id, side, CASE WHEN size > 1 THEN size ELSE 1 END AS size, round(cx, 4) AS cluster_x, round(cy, 4) AS cluster_y FROM clusters"))
def _(spark, sf):
    e = T.endpoint_clusters(_trails(spark, sf), TOL)
    return e.select("map_id", "feature_id", "side", "size", r(c("cluster_x"), 4).alias("cluster_x"), r(c("cluster_y"), 4).alias("cluster_y"))


@query("t02_snap_ends", with_views("snapped", "SELECT map_id, feature_id, idx, round(x, 4) AS x, round(y, 4) AS y FROM snapped"))
def _(spark, sf):
    s = T.snap_ends(_trails(spark, sf), TOL)
    return s.select("map_id", "feature_id", "idx", r(c("x"), 4).alias("x"), r(c("y"), 4).alias("y"))


@query("t03_maps_needing_cleanup", with_views("endpairs hits trail_vertices", """SELECT m.map_id, d.map_id IS NOT NULL AS needs_cleanup FROM (SELECT DISTINCT map_id FROM trail_vertices) m
LEFT JOIN (SELECT map_id FROM endpairs WHERE d2 > 0 UNION SELECT map_id FROM hits WHERE d2 > 0 OR (t > 1e-9 AND t < 1 - 1e-9)) d ON d.map_id = m.map_id"""))
def _(spark, sf):
    return T.maps_needing_cleanup(_trails(spark, sf), TOL)


@query("g29_count_snapped", with_views("snapped ends", """SELECT n.map_id, COUNT(*) FILTER (n.x <> e.x OR n.y <> e.y) AS snapped FROM (SELECT map_id, feature_id, s.side, CASE s.side WHEN 0 THEN ax ELSE zx END AS x, CASE s.side WHEN 0 THEN ay ELSE zy END AS y FROM (
  SELECT map_id, feature_id, arg_min(x, idx) AS ax, arg_min(y, idx) AS ay, arg_max(x, idx) AS zx, arg_max(y, idx) AS zy FROM snapped GROUP BY map_id, feature_id), (SELECT unnest([0, 1]) AS side) s) n
JOIN ends e ON e.feature_id = n.feature_id AND e.side = n.side GROUP BY n.map_id"""))
def _(spark, sf):
    # Snapping and counting read the vertices; they are derived once.
    v = cut(_trails(spark, sf))
    return T.count_snapped(v, T.snap_ends(v, TOL))


@query("t05_split_trails", with_views("trail_vertices", """SELECT map_id, CASE WHEN p = 1 THEN feature_id + 1000000000 ELSE feature_id END AS feature_id, CASE WHEN p = 1 THEN idx - cutat ELSE idx END AS idx, x, y FROM (
  SELECT *, 1 + feature_id % 3 AS cutat, MAX(idx) OVER (PARTITION BY feature_id) AS top FROM trail_vertices), (SELECT unnest([0, 1]) AS p) WHERE cutat < top AND ((p = 0 AND idx <= cutat) OR (p = 1 AND idx >= cutat))"""))
def _(spark, sf):
    v = _trails(spark, sf)
    cuts = v.select("map_id", "feature_id").distinct().withColumn("at", (c("feature_id") % 3 + 1)).withColumn("new_id", c("feature_id") + 1000000000)
    return T.split_trails(v, cuts)


_PAIRS = """SELECT map_id, a_id, b_id FROM (SELECT map_id, feature_id AS a_id, LEAD(feature_id) OVER (PARTITION BY map_id, feature_id // 2 ORDER BY feature_id) AS b_id FROM (SELECT DISTINCT map_id, feature_id FROM trail_vertices)) WHERE b_id IS NOT NULL"""


def _pairs(v):
    ids = v.select("map_id", "feature_id").distinct()
    even = ids.where("feature_id % 2 = 0").withColumnRenamed("feature_id", "a_id").withColumn("b_id", c("a_id") + 1)
    return even.join(ids.withColumnRenamed("feature_id", "b_id"), ["map_id", "b_id"], "left_semi").select("map_id", "a_id", "b_id")


@query("t06_join_pairs", with_views("trail_vertices", f"""WITH pr AS ({_PAIRS}), e AS (SELECT feature_id, MAX(idx) AS top, arg_min(x, idx) AS sx, arg_min(y, idx) AS sy, arg_max(x, idx) AS ex, arg_max(y, idx) AS ey FROM trail_vertices GROUP BY feature_id),
o AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS k, CASE WHEN least(d0, d1, d2, d3) <= 0.25e0 THEN 1 ELSE 0 END AS skip FROM (
  SELECT p.*, a.top AS atop, b.top AS btop, pow(a.ex - b.sx, 2) + pow(a.ey - b.sy, 2) AS d0, pow(a.ex - b.ex, 2) + pow(a.ey - b.ey, 2) AS d1, pow(a.sx - b.sx, 2) + pow(a.sy - b.sy, 2) AS d2, pow(a.sx - b.ex, 2) + pow(a.sy - b.ey, 2) AS d3
  FROM pr p JOIN e a ON a.feature_id = p.a_id JOIN e b ON b.feature_id = p.b_id))
SELECT o.map_id, o.a_id AS feature_id, CASE WHEN k >= 2 THEN atop - v.idx ELSE v.idx END AS idx, v.x, v.y FROM o JOIN trail_vertices v ON v.feature_id = o.a_id
UNION ALL SELECT map_id, a_id, atop + 1 + i - skip, x, y FROM (SELECT o.*, v.x, v.y, CASE WHEN k % 2 = 1 THEN btop - v.idx ELSE v.idx END AS i FROM o JOIN trail_vertices v ON v.feature_id = o.b_id) WHERE i >= skip"""))
def _(spark, sf):
    v = _trails(spark, sf)
    return T.join_pairs(v, _pairs(v))


_LINKS = f"""SELECT p.map_id, p.a_id, p.b_id, p.a_id + 2000000000 AS new_id, s.x1 + 0.25e0 * (s.x2 - s.x1) AS ax, s.y1 + 0.25e0 * (s.y2 - s.y1) AS ay, u.x1 + 0.5e0 * (u.x2 - u.x1) AS bx, u.y1 + 0.5e0 * (u.y2 - u.y1) AS by_
FROM ({_PAIRS}) p JOIN trail_segs s ON s.feature_id = p.a_id AND s.seg = 0 JOIN trail_segs u ON u.feature_id = p.b_id AND u.seg = 0"""


@query("t07_connect", with_views("trail_segs trail_vertices", f"""WITH lk AS ({_LINKS}), added AS (SELECT map_id, a_id AS feature_id, 0.25e0 AS k, ax AS x, ay AS y FROM lk UNION ALL SELECT map_id, b_id, 0.5e0, bx, by_ FROM lk),
ok AS (SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM trail_vertices v WHERE v.feature_id = a.feature_id AND v.x = a.x AND v.y = a.y))
SELECT map_id, feature_id, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY k) - 1 AS idx, x, y FROM (SELECT v.map_id, v.feature_id, CAST(v.idx AS DOUBLE) AS k, v.x, v.y FROM trail_vertices v WHERE feature_id IN (SELECT feature_id FROM ok) UNION ALL SELECT * FROM ok)
UNION ALL SELECT map_id, new_id, 0, ax, ay FROM lk UNION ALL SELECT map_id, new_id, 1, bx, by_ FROM lk"""))
def _(spark, sf):
    v = _trails(spark, sf)
    first = L.segments(v).where("seg = 0").select("map_id", "feature_id", "x1", "y1", "x2", "y2")
    a = first.select("map_id", c("feature_id").alias("a_id"), (c("x1") + 0.25 * (c("x2") - c("x1"))).alias("a_x"), (c("y1") + 0.25 * (c("y2") - c("y1"))).alias("a_y"))
    b = first.select("map_id", c("feature_id").alias("b_id"), (c("x1") + 0.5 * (c("x2") - c("x1"))).alias("b_x"), (c("y1") + 0.5 * (c("y2") - c("y1"))).alias("b_y"))
    links = _pairs(v).join(a, ["map_id", "a_id"]).join(b, ["map_id", "b_id"])
    zero = F.lit(0).cast("bigint")
    links = links.withColumn("a_seg", zero).withColumn("b_seg", zero).withColumn("new_id", c("a_id") + 2000000000)
    return T.connect(v, links)


@query("t08_split_candidates", with_views("trail_segs trail_vertices", f"""WITH p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY pow(px - hx, 2) + pow(py - hy, 2), seg) AS rn FROM (SELECT *, x1 + t * (x2 - x1) AS hx, y1 + t * (y2 - y1) AS hy FROM (
  SELECT *, {on_segment('px', 'py')} AS t FROM (SELECT *, (feature_id * 31 % 2000) + 0.25e0 AS px, (feature_id * 17 % 1500) + 0.5e0 AS py, MAX(seg) OVER (PARTITION BY feature_id) AS last FROM trail_segs)))),
vx AS (SELECT feature_id, arg_min(idx, d2 * 1000 - idx) AS cutat FROM (SELECT v.feature_id, v.idx, pow(v.x - p.px, 2) + pow(v.y - p.py, 2) AS d2 FROM trail_vertices v JOIN p ON p.feature_id = v.feature_id AND rn = 1 WHERE v.idx > 0 AND v.idx <= last) WHERE d2 <= 14400 GROUP BY feature_id),
sp AS (SELECT * FROM p WHERE rn = 1 AND feature_id NOT IN (SELECT feature_id FROM vx) AND NOT (seg = 0 AND t = 0) AND NOT (seg = last AND t = 1))
SELECT map_id, feature_id, idx, x, y FROM (
SELECT v.map_id, v.feature_id + q * 1000000000 AS feature_id, v.idx - q * cutat AS idx, v.x, v.y FROM trail_vertices v JOIN vx ON vx.feature_id = v.feature_id, (SELECT unnest([0, 1]) AS q) WHERE (q = 0 AND v.idx <= cutat) OR (q = 1 AND v.idx >= cutat)
UNION ALL SELECT v.map_id, v.feature_id + CASE WHEN v.idx > seg THEN 1000000000 ELSE 0 END, CASE WHEN v.idx > seg THEN v.idx - seg ELSE v.idx END, v.x, v.y FROM trail_vertices v JOIN sp ON sp.feature_id = v.feature_id
UNION ALL SELECT map_id, feature_id, seg + 1, round(hx, 4), round(hy, 4) FROM sp UNION ALL SELECT map_id, feature_id + 1000000000, 0, round(hx, 4), round(hy, 4) FROM sp)"""))
def _(spark, sf):
    v = _trails(spark, sf)
    f = c("feature_id")
    at = v.select("map_id", "feature_id").distinct().withColumn("px", f * 31 % 2000 + F.lit(0.25)).withColumn("py", f * 17 % 1500 + F.lit(0.5)).withColumn("new_id", f + 1000000000)
    out = T.split_candidates(v, at, 120.0)
    return out.select("map_id", "feature_id", "idx", r(c("x"), 4).alias("x"), r(c("y"), 4).alias("y"))


_CHAINLINKS = """SELECT map_id, feature_id AS a_id, nxt AS b_id FROM (SELECT map_id, feature_id, LEAD(feature_id) OVER (PARTITION BY map_id, feature_id // 16 ORDER BY feature_id) AS nxt FROM (SELECT DISTINCT map_id, feature_id FROM trail_vertices)) WHERE nxt IS NOT NULL"""


def _chain_links(v):
    """End of each line to start of the next one of its run of sixteen ids in the same map."""
    from pyspark.sql import Window

    ids = v.select("map_id", "feature_id").distinct()
    w = Window.partitionBy("map_id", F.floor(c("feature_id") / 16)).orderBy("feature_id")
    nxt = ids.withColumn("b_id", F.lead("feature_id").over(w)).where("b_id is not null")
    return nxt.select("map_id", c("feature_id").alias("a_id"), F.lit(1).alias("a_side"), "b_id", F.lit(0).alias("b_side"))


@query("t09_assemble_chains", with_views("trail_vertices", f"""WITH lk AS ({_CHAINLINKS}), ids AS (SELECT DISTINCT map_id, feature_id FROM trail_vertices),
ch AS (SELECT map_id, feature_id, MIN(feature_id) OVER (PARTITION BY map_id, feature_id // 16) AS chain_id, ROW_NUMBER() OVER (PARTITION BY map_id, feature_id // 16 ORDER BY feature_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY map_id, feature_id // 16) AS n FROM ids)
SELECT map_id, chain_id AS feature_id, ROW_NUMBER() OVER (PARTITION BY map_id, chain_id ORDER BY pos, idx) - 1 AS idx, x, y FROM (SELECT ch.*, v.idx, v.x, v.y FROM ch JOIN trail_vertices v ON v.feature_id = ch.feature_id WHERE n > 1 AND NOT (pos > 0 AND v.idx = 0))"""))
def _(spark, sf):
    v = _trails(spark, sf)
    return T.chain_vertices(v, T.assemble_chains(v, _chain_links(v)))


@query("j06_interior_branches", with_views("msegs ends", f"""SELECT DISTINCT e.map_id, e.e AS center_id FROM ends e JOIN (SELECT s.*, l.total FROM msegs s JOIN (SELECT feature_id, MAX(d2) AS total FROM msegs GROUP BY feature_id) l ON l.feature_id = s.feature_id) s ON s.map_id = e.map_id
  AND e.x BETWEEN least(x1, x2) - 8 AND greatest(x1, x2) + 8 AND e.y BETWEEN least(y1, y2) - 8 AND greatest(y1, y2) + 8,
  LATERAL (SELECT {on_segment('e.x', 'e.y')} AS t) q WHERE pow(e.x - (x1 + t * (x2 - x1)), 2) + pow(e.y - (y1 + t * (y2 - y1)), 2) <= 64 AND d1 + t * (d2 - d1) > 8 AND total - (d1 + t * (d2 - d1)) > 8"""))
def _(spark, sf):
    v = _trails(spark, sf)
    e = T.trail_ends(v).withColumn("center_id", c("feature_id") * 2 + c("side"))
    return T.interior_branches(e, v, TOL)


@query("t04_auto_join")
def _(spark, sf):
    v = _trails(spark, sf)
    return T.auto_join(v, v.select("map_id", "feature_id").distinct(), TOL)["vertices"]


@query("t04_auto_join_counts")
def _(spark, sf):
    v = _trails(spark, sf)
    return T.auto_join(v, v.select("map_id", "feature_id").distinct(), TOL)["counts"]


@query("o04_apply_edit", with_views("features", """SELECT net_id AS map_id, feature_id, seq, 0 AS sub_seq, name FROM features WHERE feature_id % 11 <> 3 AND NOT (kind = 'trail' AND feature_id % 5 = 0)
UNION ALL SELECT net_id, feature_id + q * 1000000000, seq, q, CASE q WHEN 1 THEN name || ' (2)' ELSE name END FROM features, (SELECT unnest([0, 1]) AS q) WHERE kind = 'trail' AND feature_id % 5 = 0"""))
def _(spark, sf):
    f = C.features(spark, sf).withColumn("map_id", c("net_id"))
    v = C.vertices(spark, sf, net=True)
    hit = f.where("kind = 'trail' and feature_id % 5 = 0")
    cuts = hit.select("map_id", "feature_id", F.lit(1).cast("bigint").alias("at"), (c("feature_id") + 1000000000).alias("new_id"))
    updated = hit.withColumn("after_id", F.lit(None).cast("bigint")).unionByName(T.split_features(f, cuts))
    removed = f.where("feature_id % 11 = 3 and not (kind = 'trail' and feature_id % 5 = 0)")
    parts = T.split_trails(v, cuts)
    out, _ = T.apply_edit(f, v, updated, parts, removed)
    return out.select("map_id", "feature_id", "seq", "sub_seq", "name")


_PROBE = "SELECT DISTINCT map_id, feature_id AS pid, (feature_id * 31 % 2000) + 0.25e0 AS px, (feature_id * 17 % 1500) + 0.5e0 AS py FROM net_vertices"


@query("j17_nearest_feature", with_views("segs", f"""WITH p AS ({_PROBE}),
ring AS (SELECT map_id, feature_id, x1, y1, x2, y2 FROM segs WHERE kind = 'area' UNION ALL SELECT z.map_id, z.feature_id, z.x, z.y, a.x, a.y FROM net_vertices a
  JOIN (SELECT map_id, feature_id, arg_max(x, idx) AS x, arg_max(y, idx) AS y FROM net_vertices WHERE kind = 'area' GROUP BY map_id, feature_id) z ON z.feature_id = a.feature_id WHERE a.idx = 0),
edge AS (SELECT map_id, feature_id, x1, y1, x2, y2 FROM segs WHERE kind = 'trail' UNION ALL SELECT * FROM ring),
ln AS (SELECT * FROM (SELECT p.map_id, p.pid, e.feature_id, sqrt(pow(px - (x1 + t * (x2 - x1)), 2) + pow(py - (y1 + t * (y2 - y1)), 2)) AS d FROM p JOIN edge e ON e.map_id = p.map_id AND px BETWEEN least(x1, x2) - 9 AND greatest(x1, x2) + 9 AND py BETWEEN least(y1, y2) - 9 AND greatest(y1, y2) + 9,
  LATERAL (SELECT {on_segment('px', 'py')} AS t) q) WHERE d < 9),
pt AS (SELECT * FROM (SELECT p.map_id, p.pid, v.feature_id, sqrt(pow(px - v.x, 2) + pow(py - v.y, 2)) - 3 AS d FROM p JOIN net_vertices v ON v.map_id = p.map_id AND v.kind = 'poi' AND abs(v.x - px) < 12 AND abs(v.y - py) < 12) WHERE d < 9),
near AS (SELECT pid, arg_min(feature_id, d * 1e9 + feature_id * 1e-6) AS feature_id FROM (SELECT * FROM ln UNION ALL SELECT * FROM pt) GROUP BY pid),
ins AS (SELECT pid, MIN(feature_id) AS feature_id FROM (SELECT p.pid, r.feature_id, COUNT(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) AS n FROM p JOIN ring r ON r.map_id = p.map_id GROUP BY p.pid, r.feature_id) WHERE n % 2 = 1 GROUP BY pid)
SELECT p.map_id, p.pid, COALESCE(near.feature_id, ins.feature_id) AS feature_id FROM p LEFT JOIN near ON near.pid = p.pid LEFT JOIN ins ON ins.pid = p.pid WHERE COALESCE(near.feature_id, ins.feature_id) IS NOT NULL"""))
def _(spark, sf):
    v = C.vertices(spark, sf, net=True)
    f = c("feature_id")
    pts = v.select("map_id", "feature_id").distinct().select("map_id", f.alias("pid"), (f * 31 % 2000 + F.lit(0.25)).alias("x"), (f * 17 % 1500 + F.lit(0.5)).alias("y"))
    return H.nearest_feature(pts, v, ["pid"])
