"""SQL text for expressions that many oracle queries share."""

from __future__ import annotations

import math

from cairnfield.plans.corpus import VIEWS

D2R = repr(math.pi / 180)
MDEG = repr(6378137.0 * math.pi / 180) + "e0"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(12756274e0 * asin(least(1e0, sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))"
    )


#: Name of a colour of hue h, saturation s and lightness l; fixed values.
COLOR_NAME = """CASE WHEN l < 0.16e0 THEN 'Black' WHEN s < 0.16e0 THEN CASE WHEN l > 0.82e0 THEN 'White' ELSE 'Gray' END WHEN (h < 45 OR h >= 340) AND l < 0.42e0 AND s < 0.65e0 AND h >= 10 THEN 'Brown'
 WHEN h < 12 OR h >= 345 THEN 'Red' WHEN h < 42 THEN CASE WHEN l < 0.35e0 THEN 'Brown' ELSE 'Orange' END WHEN h < 68 THEN 'Yellow' WHEN h < 160 THEN 'Green' WHEN h < 195 THEN 'Teal' WHEN h < 250 THEN 'Blue' WHEN h < 290 THEN 'Purple' ELSE 'Pink' END"""


def sheet(w: str, u: str, v: str) -> str:
    """A rubber sheet's value at (u, v), from a row of ``sheets``."""
    r2 = f"(pow(us[i] - {u}, 2) + pow(vs[i] - {v}, 2))"
    return f"({w}[m + 1] + {w}[m + 2] * {u} + {w}[m + 3] * {v} + list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN {r2} > 0 THEN {w}[i] * {r2} * ln({r2}) ELSE 0e0 END)))"


def ratio(n: str, xx: str, xy: str, yy: str) -> str:
    major = f"((({xx}) + ({yy}) + sqrt(pow(({xx}) - ({yy}), 2) + 4 * pow({xy}, 2))) / 2)"
    return (
        f"CASE WHEN ({n}) >= 3 AND ({xx}) + ({yy}) > 0 THEN "
        f"sqrt(greatest(0e0, ({xx}) * ({yy}) - pow({xy}, 2))) / {major} ELSE 0e0 END"
    )


VIEWS["usable"] = (
    ["anchors"],
    "SELECT * FROM anchors WHERE lat IS NOT NULL AND lon IS NOT NULL AND isfinite(lat) AND isfinite(lon) AND isfinite(x) AND isfinite(y)",
)
# Plain centred sums, taken in two passes.
VIEWS["means"] = (
    ["usable"],
    "SELECT map_id, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, AVG(lat) AS mlat, AVG(lon) AS mlon FROM usable GROUP BY map_id",
)
VIEWS["sums"] = (
    ["means"],
    """SELECT m.map_id, n, mx, my, mlat, mlon, SUM((x - mx) * (x - mx)) AS xx, SUM((x - mx) * (y - my)) AS xy,
  SUM((y - my) * (y - my)) AS yy, SUM((x - mx) * (lat - mlat)) AS xlat, SUM((x - mx) * (lon - mlon)) AS xlon,
  SUM((y - my) * (lat - mlat)) AS ylat, SUM((y - my) * (lon - mlon)) AS ylon
FROM usable u JOIN means m ON u.map_id = m.map_id GROUP BY m.map_id, n, mx, my, mlat, mlon""",
)
VIEWS["dropped"] = (
    ["sums"],
    """SELECT u.*, s.n, mx, my, mlat, mlon, xx, xy, yy, xlat, xlon, ylat, ylon,
  xx - (x - mx) * (x - mx) * n / (n - 1e0) AS wxx, xy - (x - mx) * (y - my) * n / (n - 1e0) AS wxy, yy - (y - my) * (y - my) * n / (n - 1e0) AS wyy,
  xlat - (x - mx) * (lat - mlat) * n / (n - 1e0) AS wxlat, xlon - (x - mx) * (lon - mlon) * n / (n - 1e0) AS wxlon,
  ylat - (y - my) * (lat - mlat) * n / (n - 1e0) AS wylat, ylon - (y - my) * (lon - mlon) * n / (n - 1e0) AS wylon
FROM usable u JOIN sums s ON u.map_id = s.map_id WHERE n >= 2""",
)
VIEWS["support"] = (
    ["sums", "dropped"],
    f"""SELECT s.map_id, s.n, {ratio('s.n', 'xx', 'xy', 'yy')} AS ratio,
  ({ratio('s.n', 'xx', 'xy', 'yy')}) >= 0.08e0 AS supported, COALESCE(k.kept, FALSE) AS independent
FROM sums s LEFT JOIN (SELECT map_id, bool_and(({ratio('n - 1', 'wxx', 'wxy', 'wyy')}) >= 0.08e0) AS kept FROM dropped WHERE n >= 4 GROUP BY map_id) k
  ON k.map_id = s.map_id""",
)
VIEWS["coef"] = (
    ["maps", "support"],
    f"""SELECT *, e_u * n_v - e_v * n_u AS det, n >= 3 AND COALESCE(abs(e_u * n_v - e_v * n_u) > 1e-9, FALSE) AS has_aff, p IS NOT NULL AS has_sim FROM (
  SELECT *, (xlon * kx - ylat * ky) / scale / nullif(spread2, 0) AS p, (ylon * kx + xlat * ky) / scale / nullif(spread2, 0) AS q,
    (mx - cx) / scale AS mu, (my - cy) / scale AS mv,
    CASE WHEN n >= 3 AND dd >= 1e-9 * xx * yy THEN (yy * xlon - xy * ylon) / dd * kx * scale END AS e_u,
    CASE WHEN n >= 3 AND dd >= 1e-9 * xx * yy THEN (xx * ylon - xy * xlon) / dd * kx * scale END AS e_v,
    CASE WHEN n >= 3 AND dd >= 1e-9 * xx * yy THEN (yy * xlat - xy * ylat) / dd * ky * scale END AS n_u,
    CASE WHEN n >= 3 AND dd >= 1e-9 * xx * yy THEN (xx * ylat - xy * xlat) / dd * ky * scale END AS n_v
  FROM (SELECT s.*, m.requested, m.width, m.height, u.ratio, u.supported, u.independent, mlat AS lat0, mlon AS lon0,
      cos(radians(mlat)) * {MDEG} AS kx, {MDEG} AS ky, width / 2e0 AS cx, height / 2e0 AS cy, CAST(greatest(width, height) AS DOUBLE) AS scale,
      (xx + yy) / pow(greatest(width, height), 2) AS spread2, xx * yy - xy * xy AS dd
    FROM sums s JOIN maps m ON m.map_id = s.map_id JOIN support u ON u.map_id = s.map_id WHERE s.n >= 2))""",
)
SIM = "[p, q, -(p * mu + q * mv), q, -p, -(q * mu - p * mv)]"
AFF = "[e_u, e_v, -(e_u * mu + e_v * mv), n_u, n_v, -(n_u * mu + n_v * mv)]"
# The rubber sheet's companion affine stands for it wherever SQL needs a straight model.
VIEWS["fits"] = (
    ["coef"],
    f"""SELECT m.map_id, c.n IS NOT NULL AND (has_sim OR has_aff) AS ok, CASE WHEN c.n IS NULL THEN 'too-few' WHEN NOT has_sim AND NOT has_aff THEN 'degenerate' END AS reason,
  CASE WHEN c.n IS NULL THEN 2 - COALESCE(a.n, 0) ELSE 0 END AS need, m.requested, COALESCE(c.n, a.n, 0) AS anchor_count,
  CASE WHEN NOT (has_sim OR has_aff) THEN NULL WHEN method = 'similarity' AND NOT has_sim THEN 'affine' ELSE method END AS method,
  lat0, lon0, kx, ky, cx, cy, scale, det, independent, ratio, CASE WHEN method = 'similarity' AND has_sim THEN {SIM} ELSE {AFF} END AS aff
FROM maps m LEFT JOIN (SELECT *, CASE WHEN requested = 'auto' THEN CASE WHEN n >= 4 AND has_aff AND supported THEN 'affine' ELSE 'similarity' END
    WHEN requested = 'affine' AND NOT has_aff THEN 'similarity'
    WHEN requested = 'tps' AND (n < 4 OR NOT has_aff) THEN CASE WHEN has_aff THEN 'affine' ELSE 'similarity' END
    ELSE requested END AS method FROM coef) c ON c.map_id = m.map_id
  LEFT JOIN (SELECT map_id, COUNT(*) AS n FROM usable GROUP BY map_id) a ON a.map_id = m.map_id""",
)
# Straight fits only: the same maps with no rubber sheet asked for.
VIEWS["located"] = (
    ["fits", "vertices"],
    """SELECT v.map_id, v.feature_id, v.idx, v.kind, lat0 + (aff[4] * u + aff[5] * v_ + aff[6]) / ky AS lat, lon0 + (aff[1] * u + aff[2] * v_ + aff[3]) / kx AS lon
FROM (SELECT v.*, f.*, (v.x - cx) / scale AS u, (v.y - cy) / scale AS v_ FROM vertices v JOIN fits f ON f.map_id = v.map_id WHERE f.ok) v""",
)
# Rubber sheets from whole systems, by elimination with the largest pivot. Two controls in one place leave no sheet.
VIEWS["controls"] = (
    ["fits", "usable"],
    """SELECT f.map_id, anchor_id, lat, lon, lat0, lon0, kx, ky, (x - cx) / scale AS u, (y - cy) / scale AS v, (lon - lon0) * kx AS e, (lat - lat0) * ky AS n
FROM usable a JOIN fits f ON f.map_id = a.map_id WHERE f.method = 'tps' AND f.map_id NOT IN (SELECT map_id FROM usable GROUP BY map_id, x, y HAVING COUNT(*) > 1)""",
)
def _sheets(source: str, keys: str) -> str:
    return f"""WITH RECURSIVE c AS (SELECT {keys}, COUNT(*) AS m, list(u ORDER BY anchor_id) AS us, list(v ORDER BY anchor_id) AS vs, list(e ORDER BY anchor_id) AS es, list(n ORDER BY anchor_id) AS ns FROM {source} GROUP BY {keys}),
walk AS (SELECT {keys}, m + 3 AS size, us, vs, CAST(1 AS BIGINT) AS k, list_concat(
   list_transform(range(1, m + 1), lambda i: list_concat(list_transform(range(1, m + 1), lambda j: CASE WHEN i = j THEN 0e0 ELSE (pow(us[i] - us[j], 2) + pow(vs[i] - vs[j], 2)) * ln(pow(us[i] - us[j], 2) + pow(vs[i] - vs[j], 2)) END), [1e0, us[i], vs[i], es[i], ns[i]])),
   [list_concat(list_transform(us, lambda x: 1e0), [0e0, 0e0, 0e0, 0e0, 0e0]), list_concat(us, [0e0, 0e0, 0e0, 0e0, 0e0]), list_concat(vs, [0e0, 0e0, 0e0, 0e0, 0e0])]) AS a FROM c
 UNION ALL SELECT {keys}, size, us, vs, k + 1, list_transform(range(1, size + 1), lambda i: CASE WHEN i = k THEN lead ELSE list_transform(range(1, size + 3), lambda j: (CASE WHEN i = p THEN a[k] ELSE a[i] END)[j] - (CASE WHEN i = p THEN a[k] ELSE a[i] END)[k] * lead[j]) END)
 FROM (SELECT *, list_transform(a[p], lambda x: x / a[p][k]) AS lead FROM (SELECT *, list_position(heads, list_max(heads)) AS p FROM (SELECT *, list_transform(range(1, size + 1), lambda i: CASE WHEN i < k THEN -1e0 ELSE abs(a[i][k]) END) AS heads FROM walk WHERE k <= size))))
SELECT {keys}, size - 3 AS m, us, vs, list_transform(a, lambda r: r[size + 1]) AS we, list_transform(a, lambda r: r[size + 2]) AS wn FROM walk WHERE k = size + 1"""


VIEWS["sheets"] = (["controls"], _sheets("controls", "map_id"))
# Every control left out in turn, where five or more are there.
VIEWS["left_controls"] = (
    ["controls"],
    """SELECT c.*, o.anchor_id AS left_out FROM controls c JOIN controls o ON o.map_id = c.map_id AND o.anchor_id <> c.anchor_id
WHERE c.map_id IN (SELECT map_id FROM controls GROUP BY map_id HAVING COUNT(*) >= 5)""",
)
VIEWS["left_sheets"] = (["left_controls"], _sheets("left_controls", "map_id, left_out"))
VIEWS["geosegs"] = (
    ["located"],
    """SELECT * FROM (SELECT map_id, feature_id, kind, idx, lat AS lat1, lon AS lon1, LEAD(lat) OVER w AS lat2, LEAD(lon) OVER w AS lon2
  FROM located WINDOW w AS (PARTITION BY feature_id ORDER BY idx)) WHERE lat2 IS NOT NULL
UNION ALL SELECT a.map_id, a.feature_id, a.kind, z.idx, z.lat, z.lon, a.lat, a.lon FROM located a
  JOIN (SELECT feature_id, arg_max(idx, idx) AS idx, arg_max(lat, idx) AS lat, arg_max(lon, idx) AS lon FROM located WHERE kind = 'area' GROUP BY feature_id) z
  ON z.feature_id = a.feature_id WHERE a.kind = 'area' AND a.idx = 0""",
)
VIEWS["lengths"] = (
    ["located", "geosegs"],
    f"""SELECT l.map_id, l.feature_id, l.n_vertices, COALESCE(s.m, 0e0) AS length_m FROM
  (SELECT map_id, feature_id, COUNT(*) AS n_vertices FROM located GROUP BY map_id, feature_id) l
  LEFT JOIN (SELECT feature_id, SUM({haversine('lat1', 'lon1', 'lat2', 'lon2')}) AS m FROM geosegs GROUP BY feature_id) s ON s.feature_id = l.feature_id""",
)
VIEWS["resid"] = (
    ["fits", "usable"],
    """SELECT map_id, anchor_id, sqrt(pow(aff[1] * u + aff[2] * v + aff[3] - (lon - lon0) * kx, 2) + pow(aff[4] * u + aff[5] * v + aff[6] - (lat - lat0) * ky, 2)) AS residual_m
FROM (SELECT f.*, a.anchor_id, a.lat, a.lon, (a.x - cx) / scale AS u, (a.y - cy) / scale AS v FROM usable a JOIN fits f ON f.map_id = a.map_id WHERE f.ok)""",
)
VIEWS["quality"] = (
    ["fits", "resid"],
    """SELECT f.*, r.rms, CASE WHEN ok THEN CASE WHEN method = 'similarity' THEN sqrt(pow(aff[1], 2) + pow(aff[2], 2)) ELSE sqrt(abs(det)) END / scale END AS mpp,
  ok AND anchor_count > CASE WHEN method = 'similarity' THEN 2 ELSE 3 END AND
    (NOT (requested IN ('affine', 'tps') OR (requested = 'auto' AND anchor_count >= 4)) OR COALESCE(independent, FALSE)) AS checked,
  ok AND method <> 'similarity' AND det > 0 AS mirrored
FROM fits f LEFT JOIN (SELECT map_id, sqrt(AVG(residual_m * residual_m)) AS rms FROM resid GROUP BY map_id) r ON r.map_id = f.map_id""",
)
VIEWS["loo"] = (
    ["dropped", "fits"],
    f"""SELECT map_id, anchor_id, {haversine('lat', 'lon', 'plat', 'plon')} AS loo_residual_m FROM (
  SELECT *, CASE WHEN method = 'similarity' THEN llat + (q * u - p * v) / {MDEG} ELSE lat - misslat / (1 - h) END AS plat,
    CASE WHEN method = 'similarity' THEN llon + (p * u + q * v) / kk ELSE lon - misslon / (1 - h) END AS plon
  FROM (SELECT *, (x - lmx) / scale AS u, (y - lmy) / scale AS v, (wxlon * kk - wylat * {MDEG}) * scale / (wxx + wyy) AS p, (wylon * kk + wxlat * {MDEG}) * scale / (wxx + wyy) AS q
    FROM (SELECT *, cos(radians(llat)) * {MDEG} AS kk,
        1e0 / n + (yy * pow(x - mx, 2) - 2 * xy * (x - mx) * (y - my) + xx * pow(y - my, 2)) / (xx * yy - xy * xy) AS h,
        lat - mlat - ((yy * xlat - xy * ylat) * (x - mx) + (xx * ylat - xy * xlat) * (y - my)) / (xx * yy - xy * xy) AS misslat,
        lon - mlon - ((yy * xlon - xy * ylon) * (x - mx) + (xx * ylon - xy * xlon) * (y - my)) / (xx * yy - xy * xy) AS misslon
      FROM (SELECT d.*, f.method, f.scale, (n * mx - x) / (n - 1e0) AS lmx, (n * my - y) / (n - 1e0) AS lmy,
          (n * mlat - lat) / (n - 1e0) AS llat, (n * mlon - lon) / (n - 1e0) AS llon
        FROM dropped d JOIN fits f ON f.map_id = d.map_id WHERE f.ok AND n >= 4
          AND (f.method = 'similarity' OR ({ratio('n - 1', 'wxx', 'wxy', 'wyy')}) >= 0.08e0)))))
WHERE plat IS NOT NULL AND plon IS NOT NULL""",
)


def on_segment(px: str, py: str, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> str:
    """Clamped parameter of the nearest point of a segment."""
    len2 = f"(pow({x2} - {x1}, 2) + pow({y2} - {y1}, 2))"
    return (
        f"CASE WHEN {len2} = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, (({px} - {x1}) * ({x2} - {x1}) + "
        f"({py} - {y1}) * ({y2} - {y1})) / {len2})) END"
    )


VIEWS["ends"] = (
    ["trail_vertices"],
    """SELECT v.map_id, v.feature_id, s.side, CASE s.side WHEN 0 THEN ax ELSE zx END AS x, CASE s.side WHEN 0 THEN ay ELSE zy END AS y, v.feature_id * 2 + s.side AS e
FROM (SELECT map_id, feature_id, arg_min(x, idx) AS ax, arg_min(y, idx) AS ay, arg_max(x, idx) AS zx, arg_max(y, idx) AS zy FROM trail_vertices GROUP BY map_id, feature_id HAVING COUNT(*) >= 2) v,
  (SELECT unnest([0, 1]) AS side) s""",
)
VIEWS["endpairs"] = (
    ["ends"],
    """SELECT a.map_id, a.e AS a, b.e AS b, a.feature_id, a.side, b.feature_id AS bf, b.side AS bs, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2
FROM ends a JOIN ends b ON a.map_id = b.map_id AND a.feature_id <> b.feature_id AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8 WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 64""",
)
VIEWS["clusters"] = (
    ["ends", "endpairs"],
    """WITH RECURSIVE reach(src, dst) AS (SELECT e, e FROM ends UNION SELECT r.src, p.b FROM reach r JOIN endpairs p ON p.a = r.dst)
SELECT e.*, m.size, m.cx, m.cy FROM ends e JOIN (SELECT src, COUNT(*) AS size, AVG(x) AS cx, AVG(y) AS cy FROM reach JOIN ends ON ends.e = reach.dst GROUP BY src) m ON m.src = e.e""",
)
VIEWS["hits"] = (
    ["clusters", "trail_segs"],
    f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY e ORDER BY d2, onf, seg) AS rn FROM (SELECT *, pow(x - hx, 2) + pow(y - hy, 2) AS d2 FROM (
  SELECT *, x1 + t * (x2 - x1) AS hx, y1 + t * (y2 - y1) AS hy FROM (SELECT c.map_id, c.feature_id, c.side, c.e, c.x, c.y, s.feature_id AS onf, s.seg, s.x1, s.y1, s.x2, s.y2, {on_segment('c.x', 'c.y')} AS t
    FROM clusters c JOIN trail_segs s ON s.map_id = c.map_id AND s.feature_id <> c.feature_id AND c.x BETWEEN least(x1, x2) - 8 AND greatest(x1, x2) + 8 AND c.y BETWEEN least(y1, y2) - 8 AND greatest(y1, y2) + 8
    WHERE c.size = 1 AND (x1 <> x2 OR y1 <> y2)))) WHERE d2 <= 64) WHERE rn = 1""",
)
VIEWS["facts"] = (
    ["net_vertices"],
    """SELECT a.map_id, a.feature_id, a.kind, n, nd, fx, fy, zx, zy, CASE WHEN n >= 3 THEN (COALESCE(s, 0e0) + CASE WHEN fx <> zx OR fy <> zy THEN zx * fy - fx * zy ELSE 0e0 END) / 2 ELSE 0e0 END AS area
FROM (SELECT map_id, feature_id, kind, COUNT(*) AS n, COUNT(DISTINCT x * 10000 + y) AS nd, arg_min(x, idx) AS fx, arg_min(y, idx) AS fy, arg_max(x, idx) AS zx, arg_max(y, idx) AS zy FROM net_vertices GROUP BY map_id, feature_id, kind) a
LEFT JOIN (SELECT feature_id, SUM(x1 * y2 - x2 * y1) AS s FROM (SELECT feature_id, x AS x1, y AS y1, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2 FROM net_vertices WINDOW w AS (PARTITION BY feature_id ORDER BY idx)) GROUP BY feature_id) c ON c.feature_id = a.feature_id""",
)
WINDING = "CASE WHEN area > 1e-6 THEN 'clockwise' WHEN area < -1e-6 THEN 'counterclockwise' END"
VIEWS["cum"] = (
    ["trail_vertices"],
    """SELECT map_id, feature_id, idx, x, y, SUM(step) OVER (PARTITION BY feature_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS dist FROM (
  SELECT *, COALESCE(sqrt(pow(x - LAG(x) OVER w, 2) + pow(y - LAG(y) OVER w, 2)), 0e0) AS step FROM trail_vertices WINDOW w AS (PARTITION BY feature_id ORDER BY idx))""",
)
VIEWS["msegs"] = (
    ["cum"],
    """SELECT * FROM (SELECT map_id, feature_id, idx AS seg, x AS x1, y AS y1, dist AS d1, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2, LEAD(dist) OVER w AS d2 FROM cum WINDOW w AS (PARTITION BY feature_id ORDER BY idx)) WHERE x2 IS NOT NULL""",
)
