"""Queries: pixels, masks, tracing, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.constants import CHIP_MERGE_DISTANCE, CLUSTER_DISTANCE
from cairnfield.functions.color import color_bin
from cairnfield.operators import corridor as K
from cairnfield.operators import pixels as P
from cairnfield.operators import review as R
from cairnfield.operators import trace as T
from cairnfield.plans import corpus as C
from cairnfield.plans.corpus import VIEWS, with_views
from cairnfield.plans.fits import r
from cairnfield.plans.imagery import rounded
from cairnfield.plans.registry import query
from cairnfield.plans.sqlparts import COLOR_NAME
from cairnfield.session import cut, small_broadcasts

c = F.col


def _maps(spark, sf):
    return C.pixels(spark, sf).select("map_id").distinct().withColumn("width", F.lit(150)).withColumn("height", F.lit(100))


def _chips(spark, sf):
    inks = F.array(*[
        F.struct(F.lit(i).alias("chip_id"), F.lit(p).alias("r"), F.lit(q).alias("g"), F.lit(s).alias("b"), F.lit(n).alias("name"), F.lit(k).alias("named"))
        for i, p, q, s, n, k in ((1, 200, 30, 30, "Red", False), (2, 30, 60, 200, "Loop", True), (3, 40, 140, 60, "Green", False))
    ])
    return _maps(spark, sf).select("map_id", F.explode(inks).alias("i")).select("map_id", "i.*").withColumn("tolerance", F.lit(40.0))


VIEWS["chips"] = (
    ["pixels"],
    """SELECT m.map_id, k.* FROM (SELECT DISTINCT map_id FROM pixels) m, (SELECT unnest([1, 2, 3]) AS chip_id, unnest([200, 30, 40]) AS ir, unnest([30, 60, 140]) AS ig, unnest([30, 200, 60]) AS ib, unnest(['Red', 'Loop', 'Green']) AS chip, unnest([FALSE, TRUE, FALSE]) AS named) k""",
)
VIEWS["mask"] = (["pixels", "chips"], "SELECT p.map_id, chip_id, x, y FROM pixels p JOIN chips k ON k.map_id = p.map_id WHERE pow(r - ir, 2) + pow(g - ig, 2) + pow(b - ib, 2) <= 1600")
_NEAR8 = "(SELECT unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx, unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy)"
VIEWS["grown"] = (
    ["mask", "pixels", "chips"],
    f"""SELECT * FROM mask UNION SELECT p.map_id, chip_id, p.x, p.y FROM pixels p JOIN chips k ON k.map_id = p.map_id WHERE pow(r - ir, 2) + pow(g - ig, 2) + pow(b - ib, 2) <= 6400
 AND EXISTS (SELECT 1 FROM mask m, {_NEAR8} o WHERE m.map_id = p.map_id AND m.chip_id = k.chip_id AND m.x = p.x + o.dx AND m.y = p.y + o.dy)""",
)


def _mask(spark, sf):
    return P.color_mask(C.pixels(spark, sf), _chips(spark, sf))


@query("r01_color_mask", with_views("mask", "SELECT map_id, chip_id, x, y FROM mask"))
def _(spark, sf):
    return _mask(spark, sf)


@query("r02_grow_mask", with_views("grown", "SELECT map_id, chip_id, x, y FROM grown"))
def _(spark, sf):
    return P.grow_mask(_mask(spark, sf), C.pixels(spark, sf), _chips(spark, sf))


_DIL = "SELECT DISTINCT map_id, chip_id, x + dx AS x, y + dy AS y FROM mask, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)"


@query("w07_dilate", with_views("mask", _DIL))
def _(spark, sf):
    return P.dilate(_mask(spark, sf), 1)


@query("w07_erode", with_views("mask", "SELECT map_id, chip_id, m.x, m.y FROM (SELECT map_id, chip_id, x + dx AS x, y + dy AS y FROM mask, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)) m GROUP BY map_id, chip_id, m.x, m.y HAVING COUNT(*) = 9"))
def _(spark, sf):
    return P.erode(_mask(spark, sf), 1)


@query("r03_close_mask", with_views("mask", f"""SELECT map_id, chip_id, x, y FROM (SELECT map_id, chip_id, x, y, COUNT(*) AS n FROM (SELECT map_id, chip_id, x + ex AS x, y + ey AS y FROM ({_DIL}) d, (SELECT unnest([-1, 0, 1]) AS ex), (SELECT unnest([-1, 0, 1]) AS ey) WHERE x BETWEEN -1 AND 150 AND y BETWEEN -1 AND 100) GROUP BY map_id, chip_id, x, y)
WHERE n = 9 AND x BETWEEN 0 AND 149 AND y BETWEEN 0 AND 99"""))
def _(spark, sf):
    return P.close_mask(_mask(spark, sf), _maps(spark, sf), 1)


VIEWS["labels8"] = (
    ["mask"],
    f"""WITH RECURSIVE runs AS (SELECT map_id, chip_id, y, MIN(x) AS x0, MAX(x) AS x1, map_id * 100000000 + chip_id * 10000000 + y * 1000 + MIN(x) AS id FROM (SELECT *, x - ROW_NUMBER() OVER (PARTITION BY map_id, chip_id, y ORDER BY x) AS g FROM mask) GROUP BY map_id, chip_id, y, g),
 e AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.map_id = b.map_id AND a.chip_id = b.chip_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
 reach(src, dst) AS (SELECT id, id FROM runs UNION SELECT e.b, r.dst FROM reach r JOIN e ON e.a = r.src WHERE e.b > r.dst)
SELECT map_id, chip_id, unnest(range(x0, x1 + 1)) AS x, y, l FROM runs JOIN (SELECT src, MIN(dst) AS l FROM reach GROUP BY src) q ON q.src = runs.id""",
)


@query("r04_components", with_views("labels8", "SELECT map_id, chip_id, CAST(x AS INTEGER) AS x, y, CAST((l % 10000000) // 1000 AS INTEGER) AS label_y, CAST(l % 1000 AS INTEGER) AS label_x FROM labels8"))
def _(spark, sf):
    return P.components(_mask(spark, sf))


@query("r04_drop_specks", with_views("labels8", "SELECT map_id, chip_id, COUNT(*) AS components, SUM(n) AS cells FROM (SELECT map_id, chip_id, l, COUNT(*) AS n FROM labels8 GROUP BY map_id, chip_id, l HAVING COUNT(*) >= 4) GROUP BY map_id, chip_id"))
def _(spark, sf):
    kept = P.drop_specks(P.components(_mask(spark, sf)))
    per = kept.groupBy(*P.LABEL).agg(F.count("*").alias("n"))
    return per.groupBy("map_id", "chip_id").agg(F.count("*").alias("components"), F.sum("n").alias("cells"))


@query("r05_thin")
def _(spark, sf):
    return T.thin(_mask(spark, sf))


def _skeleton(spark, sf):
    with small_broadcasts(spark):
        labelled = cut(P.drop_specks(P.components(_mask(spark, sf))))
    return labelled, cut(T.thin(labelled.select("map_id", "chip_id", "x", "y")))


@query("g21_component_stats")
def _(spark, sf):
    labelled, skeleton = _skeleton(spark, sf)
    return P.component_stats(labelled, skeleton, 0)


@query("r06_drop_filled")
def _(spark, sf):
    labelled, skeleton = _skeleton(spark, sf)
    return P.drop_filled(skeleton, labelled, 0)


def _graph(spark, sf):
    labelled, skeleton = _skeleton(spark, sf)
    return T.skeleton_graph(P.drop_filled(skeleton, labelled, 0))


def _flat(df):
    return df.select("raster.map_id", "raster.chip_id", *[n for n in df.columns if n != "raster"])


@query("r07_skeleton_graph")
def _(spark, sf):
    return _flat(_graph(spark, sf)["edges"])


@query("j16_bridge_links")
def _(spark, sf):
    return _flat(T.bridge_links(_graph(spark, sf), 4.0, F.lit(8.0)))


@query("r08_bridge")
def _(spark, sf):
    return _flat(T.bridge(_graph(spark, sf), 4.0, F.lit(8.0))["edges"])


@query("r09_prune")
def _(spark, sf):
    return _flat(T.prune(_graph(spark, sf), F.lit(6.0))["edges"])


@query("r10_trace_lines")
def _(spark, sf):
    lines = T.trace_lines(T.prune(_graph(spark, sf), F.lit(6.0)), F.lit(8.0), 1.0, 20.0)
    return lines.select("map_id.map_id", "map_id.chip_id", "feature_id", "idx", "x", "y", r(c("length_px"), 4).alias("length_px"))


@query("r11_find_trails")
def _(spark, sf):
    found = T.find_trails(C.pixels(spark, sf), _maps(spark, sf), _chips(spark, sf).drop("tolerance"), 40.0, 8.0, 20.0)["candidates"]
    return rounded(R.review(found).select("map_id", "candidate_id", "chip_id", "length_px", "confidence", "selected", "band"), ["length_px", "confidence"], 4)


_LOOKS = ", ".join([f"(0, 0, {dx}, {dy})" for dx in (-1, 0, 1) for dy in (-1, 0, 1)] + [f"({side}, {k}, {-k * side}, 0)" for side in (-1, 1) for k in range(1, 9)])
_UNIT = "least(1e0, greatest(0e0, {}))"
_CONFIDENCE_SQL = f"""WITH s AS (SELECT * FROM (SELECT map_id, x, y, LEAD(y) OVER (PARTITION BY map_id, x ORDER BY y) - y AS span FROM pixels) WHERE span > 0),
q AS (SELECT map_id, x, y AS seg, k, y + span * k / n AS py FROM (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS k FROM (SELECT *, greatest(1, ceil(span / 2e0)) AS n FROM s))),
d AS (SELECT p.map_id, chip_id, x, y, pow(r - ir, 2) + pow(g - ig, 2) + pow(b - ib, 2) AS d2 FROM pixels p JOIN chips k ON k.map_id = p.map_id),
ink AS (SELECT * FROM d WHERE d2 <= 1600),
e AS (SELECT q.map_id, q.x, seg, k, COALESCE(bool_or(side = 0 AND i.x IS NOT NULL), FALSE) AS found, COALESCE(bool_or(side = 0 AND d2 <= 576), FALSE) AS core,
  COALESCE(MIN(step) FILTER (side = -1 AND i.x IS NULL), 9) + COALESCE(MIN(step) FILTER (side = 1 AND i.x IS NULL), 9) - 2 AS w
 FROM q CROSS JOIN (VALUES {_LOOKS}) o(side, step, dx, dy) LEFT JOIN ink i ON i.map_id = q.map_id AND i.chip_id = q.x % 3 + 1 AND i.x = q.x + dx AND i.y = CAST(floor(py + dy + 0.5e0) AS INTEGER) GROUP BY q.map_id, q.x, seg, k),
a AS (SELECT map_id, x, AVG(CAST(found AS INTEGER)) AS support, AVG(CAST(core AS INTEGER)) AS core, AVG(w + CAST(found AS INTEGER)) AS width, AVG(pow(w + CAST(found AS INTEGER), 2)) AS w2 FROM e GROUP BY map_id, x),
l AS (SELECT map_id, x, SUM(span) AS length FROM s GROUP BY map_id, x),
t AS (SELECT a.map_id, a.x, {_UNIT.format("0.2e0 * support + 0.53e0 * core + 0.17e0 * exp(-greatest(0e0, width - 2) / 2) + 0.04e0 / (1 + sqrt(greatest(0e0, w2 - width * width)) / greatest(width, 1e0)) + 0.03e0 + 0.03e0 * least(1e0, length / 80e0)")} AS line FROM a JOIN l ON l.map_id = a.map_id AND l.x = a.x),
c AS (SELECT chip, {_UNIT.format("((hi - lo) / (1 - abs(hi + lo - 1)) - 0.25e0) / 0.45e0")} * {_UNIT.format("(0.78e0 - (hi + lo) / 2) / 0.4e0")} AS quality FROM (VALUES (1, 200 / 255e0, 30 / 255e0), (2, 200 / 255e0, 30 / 255e0), (3, 140 / 255e0, 40 / 255e0)) v(chip, hi, lo))
SELECT map_id, CAST(x AS BIGINT) AS candidate_id, round({_UNIT.format("line * (0.4e0 + 0.6e0 * quality)")}, 5) AS confidence FROM t JOIN c ON c.chip = x % 3 + 1"""


@query("g23_candidate_confidence", with_views("pixels chips", _CONFIDENCE_SQL))
def _(spark, sf):
    v = _line_vertices(spark, sf).withColumnRenamed("line", "candidate_id")
    cands = v.select("map_id", "candidate_id").distinct().withColumns({"chip_id": c("candidate_id") % 3 + 1, "min_length_px": F.lit(20.0), "tolerance": F.lit(40.0)})
    from cairnfield.operators.lines import pixel_length

    cands = cands.join(pixel_length(v, ["map_id", "candidate_id"]), ["map_id", "candidate_id"])
    return rounded(T.candidate_confidence(cands, v, C.pixels(spark, sf), _chips(spark, sf).drop("tolerance")), ["confidence"], 5)


def _line_vertices(spark, sf):
    """Every pixel column as a line that runs down its map."""
    return C.pixels(spark, sf).select(
        "map_id", c("x").cast("bigint").alias("line"), c("y").cast("bigint").alias("idx"), c("x").cast("double").alias("x"), c("y").cast("double").alias("y")
    )


_BIN = "((r >> 4) << 8) | ((g >> 4) << 4) | (b >> 4)"


@query("g16_color_histogram", with_views("pixels", f"SELECT map_id, {_BIN} AS bin, COUNT(*) AS n FROM pixels GROUP BY map_id, bin"))
def _(spark, sf):
    return P.color_histogram(C.pixels(spark, sf))


_MOVED = ", ".join(f"'{k}': COALESCE(z.{k}, 0e0) + n * m{k}" for k in "rgb") + ", 'm': COALESCE(z.m, 0e0) + n"
# One bin a step; the sums so far, colour by mass, are the state.
VIEWS["clusters"] = (
    ["pixels"],
    f"""WITH RECURSIVE o AS (SELECT map_id, bin, CAST(n AS DOUBLE) AS n, (bin >> 8) % 16 * 16 + 8e0 AS mr, (bin >> 4) % 16 * 16 + 8e0 AS mg, bin % 16 * 16 + 8e0 AS mb, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY n DESC, bin) AS k FROM (SELECT map_id, {_BIN} AS bin, COUNT(*) AS n FROM pixels GROUP BY map_id, bin)),
walk AS (SELECT DISTINCT map_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(r DOUBLE, g DOUBLE, b DOUBLE, m DOUBLE)[]) AS t, CAST(NULL AS BIGINT) AS bin, CAST(NULL AS BIGINT) AS own FROM o
 UNION ALL SELECT map_id, k, CASE WHEN own > len(t) THEN list_append(t, {{'r': n * mr, 'g': n * mg, 'b': n * mb, 'm': n}}) ELSE list_transform(t, lambda z, i: CASE WHEN i = own THEN {{{_MOVED}}} ELSE z END) END, bin, own
 FROM (SELECT *, CASE WHEN list_min(d2) <= {CLUSTER_DISTANCE**2} THEN list_position(d2, list_min(d2)) ELSE len(t) + 1 END AS own FROM (SELECT w.map_id, o.k, t, o.bin, n, mr, mg, mb, list_transform(t, lambda z: pow(z.r / z.m - mr, 2) + pow(z.g / z.m - mg, 2) + pow(z.b / z.m - mb, 2)) AS d2 FROM walk w JOIN o ON o.map_id = w.map_id AND o.k = w.k + 1)))
SELECT map_id, CAST(bin AS INTEGER) AS bin, CAST(own - 1 AS INTEGER) AS cluster FROM walk WHERE k > 0""",
)


@query("g17_cluster_bins", with_views("clusters", "SELECT map_id, bin, cluster FROM clusters"))
def _(spark, sf):
    return P.cluster_bins(P.color_histogram(C.pixels(spark, sf)))


VIEWS["edged"] = (
    ["pixels"],
    f"""SELECT *, COALESCE(LAG(bin) OVER w <> bin, FALSE) OR COALESCE(LEAD(bin) OVER w <> bin, FALSE) OR COALESCE(LAG(bin) OVER v <> bin, FALSE) OR COALESCE(LEAD(bin) OVER v <> bin, FALSE) AS edge FROM (SELECT *, {_BIN} AS bin FROM pixels)
WINDOW w AS (PARTITION BY map_id, y ORDER BY x), v AS (PARTITION BY map_id, x ORDER BY y)""",
)


@query("w06_edge_pixels", with_views("edged", "SELECT map_id, x, y, edge FROM edged"))
def _(spark, sf):
    px = C.pixels(spark, sf).withColumn("bin", color_bin(c("r"), c("g"), c("b")))
    return P.edge_pixels(px, "bin", "x", "y").select("map_id", "x", "y", "edge")


@query("g18_cluster_stats", with_views("edged", """SELECT a.map_id, a.bin AS cluster, n, edges, round(n / CAST(total AS DOUBLE), 8) AS share, round(CASE WHEN edges / CAST(n AS DOUBLE) >= 0.3e0 THEN edges / CAST(n AS DOUBLE) ELSE COALESCE(loc, 0e0) END, 8) AS thinness, CAST(floor(r + 0.5e0) AS INTEGER) AS r, CAST(floor(g + 0.5e0) AS INTEGER) AS g, CAST(floor(b + 0.5e0) AS INTEGER) AS b
FROM (SELECT map_id, bin, COUNT(*) AS n, COUNT(*) FILTER (edge) AS edges, AVG(r) AS r, AVG(g) AS g, AVG(b) AS b FROM edged GROUP BY map_id, bin) a JOIN (SELECT map_id, COUNT(*) AS total FROM edged GROUP BY map_id) t ON t.map_id = a.map_id
LEFT JOIN (SELECT map_id, bin, MAX(e / CAST(k AS DOUBLE)) AS loc FROM (SELECT map_id, bin, COUNT(*) AS k, COUNT(*) FILTER (edge) AS e FROM edged GROUP BY map_id, bin, x // 32, y // 32 HAVING COUNT(*) >= 8) GROUP BY map_id, bin) l ON l.map_id = a.map_id AND l.bin = a.bin"""))
def _(spark, sf):
    px = C.pixels(spark, sf)
    own = P.color_histogram(px).select("map_id", "bin", c("bin").alias("cluster"))
    return rounded(P.cluster_stats(px, own), ["share", "thinness"], 8)


_SCAN_SQL = f"""WITH RECURSIVE own AS (SELECT p.map_id, x, y, r, g, b, cluster FROM pixels p JOIN clusters k ON k.map_id = p.map_id AND k.bin = ({_BIN})),
e AS (SELECT *, COALESCE(LAG(cluster) OVER w <> cluster, FALSE) OR COALESCE(LEAD(cluster) OVER w <> cluster, FALSE) OR COALESCE(LAG(cluster) OVER v <> cluster, FALSE) OR COALESCE(LEAD(cluster) OVER v <> cluster, FALSE) AS edge FROM own WINDOW w AS (PARTITION BY map_id, y ORDER BY x), v AS (PARTITION BY map_id, x ORDER BY y)),
tile AS (SELECT map_id, cluster, COUNT(*) AS n, COUNT(*) FILTER (edge) AS edges, SUM(r) AS r, SUM(g) AS g, SUM(b) AS b FROM e GROUP BY map_id, cluster, x // 32, y // 32),
stat AS (SELECT map_id, cluster, SUM(n) / SUM(SUM(n)) OVER (PARTITION BY map_id) AS share, SUM(edges) / SUM(n) AS thin, COALESCE(MAX(CASE WHEN n >= 8 THEN edges / CAST(n AS DOUBLE) END), 0e0) AS thinnest, floor(SUM(r) / SUM(n) + 0.5e0) AS r, floor(SUM(g) / SUM(n) + 0.5e0) AS g, floor(SUM(b) / SUM(n) + 0.5e0) AS b FROM tile GROUP BY map_id, cluster),
hue AS (SELECT *, CASE WHEN d > 1e-6 THEN ((CASE WHEN hi = r / 255e0 THEN ((g - b) / 255e0 / d) % 6 WHEN hi = g / 255e0 THEN (b - r) / 255e0 / d + 2 ELSE (r - g) / 255e0 / d + 4 END) * 60 + 360) % 360 ELSE 0e0 END AS h, CASE WHEN d > 1e-6 THEN d / (1 - abs(2 * l - 1)) ELSE 0e0 END AS s
 FROM (SELECT *, hi - lo AS d, (hi + lo) / 2 AS l FROM (SELECT *, CASE WHEN thin >= 0.3e0 THEN thin ELSE thinnest END AS t, greatest(r, g, b) / 255e0 AS hi, least(r, g, b) / 255e0 AS lo FROM stat))),
good AS (SELECT *, share * t * (s + 0.35e0) AS score, {COLOR_NAME} AS name, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY share * t * (s + 0.35e0) DESC, cluster) AS k FROM hue WHERE share BETWEEN 0.0003e0 AND 0.25e0 AND t >= 0.3e0 AND NOT (l > 0.86e0 AND s < 0.3e0)),
walk AS (SELECT DISTINCT map_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM good UNION ALL SELECT w.map_id, q.k, CASE WHEN len(kept) >= 10 OR EXISTS (SELECT 1 FROM good o WHERE o.map_id = q.map_id AND list_contains(kept, o.k) AND pow(o.r - q.r, 2) + pow(o.g - q.g, 2) + pow(o.b - q.b, 2) < 2304) THEN kept ELSE list_append(kept, q.k) END FROM walk w JOIN good q ON q.map_id = w.map_id AND q.k = w.k + 1)
SELECT q.map_id, CAST(list_position(kept, q.k) - 1 AS INTEGER) AS rank, r, g, b, name, s > 0.3e0 AND t > 0.45e0 AND l < 0.8e0 AS likely, score FROM good q JOIN (SELECT map_id, arg_max(kept, k) AS kept FROM walk GROUP BY map_id) w ON w.map_id = q.map_id AND list_contains(kept, q.k)"""


VIEWS["scan"] = (["clusters", "pixels"], _SCAN_SQL)


@query("g19_scan_colors", with_views("scan", "SELECT map_id, rank, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, name, likely, round(score, 8) AS score FROM scan"))
def _(spark, sf):
    return rounded(P.scan_colors(C.pixels(spark, sf)).select("map_id", "rank", "r", "g", "b", "name", "likely", "score"), ["score"], 8)


@query("k02_diverse_colors", with_views("pixels", """WITH RECURSIVE cand AS (SELECT map_id, c AS cluster, r, g, b, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY score DESC, c) AS k FROM (SELECT DISTINCT map_id, x % 40 AS c, (x % 40) * 6 AS r, 255 - (x % 40) * 5 AS g, (x % 40) * 37 % 256 AS b, ((x % 40) * 17 % 23) AS score FROM pixels)),
walk AS (SELECT map_id, 0 AS k, CAST([] AS STRUCT(r BIGINT, g BIGINT, b BIGINT, cluster BIGINT)[]) AS kept FROM (SELECT DISTINCT map_id FROM cand)
 UNION ALL SELECT w.map_id, w.k + 1, CASE WHEN len(kept) >= 10 OR len(list_filter(kept, lambda o: pow(o.r - q.r, 2) + pow(o.g - q.g, 2) + pow(o.b - q.b, 2) < 2304)) > 0 THEN kept ELSE list_append(kept, {'r': CAST(q.r AS BIGINT), 'g': CAST(q.g AS BIGINT), 'b': CAST(q.b AS BIGINT), 'cluster': CAST(q.cluster AS BIGINT)}) END FROM walk w JOIN cand q ON q.map_id = w.map_id AND q.k = w.k + 1)
SELECT map_id, CAST(i - 1 AS INTEGER) AS rank, CAST(kept[i].cluster AS INTEGER) AS cluster FROM (SELECT map_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM walk WHERE k = (SELECT MAX(k) FROM walk))"""))
def _(spark, sf):
    x = c("x") % 40
    rows = C.pixels(spark, sf).select("map_id", x.alias("cluster"), (x * 6).alias("r"), (255 - x * 5).alias("g"), (x * 37 % 256).alias("b"), (x * 17 % 23).alias("score")).distinct()
    return P.diverse_top_k(rows).select("map_id", "rank", "cluster")


@query("g20_blank_tiles", with_views("pixels", """WITH s AS (SELECT map_id, (y // 10) * 100 + x // 10 AS tile_id, y * 1000 + x AS pos, r // 16 AS r, g // 16 AS g, b // 16 AS b, CASE WHEN (x // 10 + y // 10) % 6 = 0 AND x % 10 < 9 THEN 0 ELSE 255 END AS a FROM pixels),
f AS (SELECT map_id, tile_id, arg_min(r * 10000 + g * 100 + b, pos) AS fc FROM s WHERE a <> 0 GROUP BY map_id, tile_id)
SELECT s.map_id, s.tile_id, COUNT(*) AS samples, COUNT(*) FILTER (a = 0) / CAST(COUNT(*) AS DOUBLE) > 0.8e0 OR COUNT(*) FILTER (a <> 0 AND r * 10000 + g * 100 + b = fc) / CAST(COUNT(*) AS DOUBLE) > 0.98e0 AS blank FROM s LEFT JOIN f ON f.map_id = s.map_id AND f.tile_id = s.tile_id GROUP BY s.map_id, s.tile_id"""))
def _(spark, sf):
    tx, ty = F.floor(c("x") / 10), F.floor(c("y") / 10)
    clear = ((tx + ty) % 6 == 0) & (c("x") % 10 < 9)
    s = C.pixels(spark, sf).select(
        "map_id", (ty * 100 + tx).alias("tile_id"), (c("y") * 1000 + c("x")).alias("pos"), *[F.floor(c(k) / 16).alias(k) for k in "rgb"], F.when(clear, 0).otherwise(255).alias("a")
    )
    return P.blank_tiles(s)


_PTS = "(SELECT map_id, x * 1000 + y AS pid, x + 0.3e0 AS px, y + 0.2e0 AS py FROM pixels)"


def _probe(spark, sf):
    return C.pixels(spark, sf).select("map_id", (c("x") * 1000 + c("y")).alias("pid"), (c("x") + F.lit(0.3)).alias("x"), (c("y") + F.lit(0.2)).alias("y"))


@query("j12_snap_to_ink", with_views("pixels", f"""SELECT map_id, pid, x AS ink_x, y AS ink_y, round(s, 5) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id, pid ORDER BY s, y, x) AS rn FROM (SELECT p.map_id, pid, q.x, q.y, sqrt(pow(q.x - px, 2) + pow(q.y - py, 2)) + sqrt(pow(r - 200, 2) + pow(g - 30, 2) + pow(b - 30, 2)) / 40e0 * 6 * 0.5e0 AS s
 FROM {_PTS} p JOIN pixels q ON q.map_id = p.map_id AND abs(q.x - floor(px + 0.5e0)) <= 6 AND abs(q.y - floor(py + 0.5e0)) <= 6 WHERE sqrt(pow(q.x - px, 2) + pow(q.y - py, 2)) <= 6 AND pow(r - 200, 2) + pow(g - 30, 2) + pow(b - 30, 2) <= 1600)) WHERE rn = 1"""))
def _(spark, sf):
    pts = _probe(spark, sf).withColumns({"ir": F.lit(200), "ig": F.lit(30), "ib": F.lit(30)})
    return rounded(P.snap_to_ink(pts, C.pixels(spark, sf), ["pid"], 40.0, 6.0), ["score"], 5)


_DISC = ", ".join(f"({dx}, {dy})" for dx in range(-3, 4) for dy in range(-3, 4) if dx * dx + dy * dy <= 9)
_AROUND = "PARTITION BY map_id, {line} ORDER BY {pos} RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING"
_BY_ROW, _BY_COLUMN = _AROUND.format(line="y", pos="x"), _AROUND.format(line="x", pos="y")


# Box sums run along rows, then columns, but for spots without a pixel of their own there are no probes.
@query("j13_pick_ink", with_views("pixels", f"""WITH full_grid AS (SELECT map_id, x, y FROM (SELECT DISTINCT map_id, x FROM pixels), LATERAL (SELECT unnest(range(100)) AS y)),
g AS (SELECT f.map_id, f.x, f.y, p.r, p.g, p.b FROM full_grid f LEFT JOIN pixels p ON p.map_id = f.map_id AND p.x = f.x AND p.y = f.y),
h AS (SELECT map_id, x, y, r, SUM(r) OVER w AS sr, SUM(g) OVER w AS sg, SUM(b) OVER w AS sb, COUNT(r) OVER w AS n FROM g WINDOW w AS ({_BY_ROW})),
m AS (SELECT map_id, x, y, SUM(sr) OVER w / SUM(n) OVER w AS mr, SUM(sg) OVER w / SUM(n) OVER w AS mg, SUM(sb) OVER w / SUM(n) OVER w AS mb, r FROM h WINDOW w AS ({_BY_COLUMN})),
s AS (SELECT m.map_id, m.x AS ax, m.y AS ay, q.x, q.y, q.r, q.g, q.b, sqrt(pow(q.r - mr, 2) + pow(q.g - mg, 2) + pow(q.b - mb, 2)) - sqrt(dx * dx + dy * dy) * 2e0 AS sc
 FROM m, (VALUES {_DISC}) d(dx, dy), pixels q WHERE m.r IS NOT NULL AND q.map_id = m.map_id AND q.x = m.x + dx AND q.y = m.y + dy),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id, ax, ay ORDER BY sc DESC, y, x) AS rn FROM s)
SELECT w.map_id, CAST(w.ax * 1000 + w.ay AS INTEGER) AS pid, CASE WHEN sc >= 10 THEN w.r ELSE k.r END AS r, CASE WHEN sc >= 10 THEN w.g ELSE k.g END AS g, CASE WHEN sc >= 10 THEN w.b ELSE k.b END AS b
FROM w JOIN pixels k ON k.map_id = w.map_id AND k.x = w.ax AND k.y = w.ay WHERE rn = 1"""))
def _(spark, sf):
    return P.pick_ink(_probe(spark, sf), C.pixels(spark, sf), ["pid"], 3.0)


# The walk over scanned colours: each meets the first chip that is near, or becomes a chip.
@query("j14_merge_chips", with_views("scan chips", f"""WITH RECURSIVE old AS (SELECT map_id, list({{'chip_id': CAST(chip_id AS VARCHAR), 'r': CAST(ir AS DOUBLE), 'g': CAST(ig AS DOUBLE), 'b': CAST(ib AS DOUBLE), 'name': chip, 'enabled': FALSE, 'named': named}} ORDER BY chip_id) AS t FROM chips GROUP BY map_id),
walk AS (SELECT map_id, t, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS added FROM old
 UNION ALL SELECT map_id, CASE WHEN spot > 0 THEN list_transform(t, lambda z, i: CASE WHEN i = spot THEN {{'chip_id': z.chip_id, 'r': z.r, 'g': z.g, 'b': z.b, 'name': z.name, 'enabled': TRUE, 'named': z.named}} ELSE z END)
   ELSE list_append(t, {{'chip_id': 'new-' || added, 'r': r, 'g': g, 'b': b, 'name': name, 'enabled': TRUE, 'named': FALSE}}) END, k + 1, added + CASE WHEN spot > 0 THEN 0 ELSE 1 END
 FROM (SELECT w.*, q.r, q.g, q.b, q.name, COALESCE(list_position(list_transform(t, lambda z: sqrt(pow(z.r - q.r, 2) + pow(z.g - q.g, 2) + pow(z.b - q.b, 2)) < {CHIP_MERGE_DISTANCE}), TRUE), 0) AS spot FROM walk w JOIN scan q ON q.map_id = w.map_id AND q.rank = w.k))
SELECT map_id, CAST(i - 1 AS BIGINT) AS seq, t[i].chip_id AS chip_id, t[i].r AS r, t[i].g AS g, t[i].b AS b, t[i].name AS name, t[i].enabled AS enabled, t[i].named AS named FROM (SELECT map_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT map_id, arg_max(t, k) AS t FROM walk GROUP BY map_id))"""))
def _(spark, sf):
    base = _chips(spark, sf)
    cols = {"seq": c("chip_id").cast("bigint"), "r": c("r").cast("double"), "g": c("g").cast("double"), "b": c("b").cast("double"), "enabled": F.lit(False), "share": F.lit(0.1)}
    existing = base.withColumns(cols).withColumn("chip_id", c("chip_id").cast("string"))
    scanned = P.scan_colors(C.pixels(spark, sf)).select(
        "map_id", c("rank").cast("bigint").alias("seq"), *[c(k).cast("double").alias(k) for k in "rgb"], "name", F.lit(True).alias("enabled"), "share", F.lit(False).alias("named")
    )
    return P.merge_chips(existing, scanned).select("map_id", "seq", "chip_id", "r", "g", "b", "name", "enabled", "named")


@query("r13_build_pyramid", with_views("pixels", """SELECT map_id, x, y, round(AVG(r), 5) AS r, round(AVG(g), 5) AS g FROM (SELECT map_id, x // 2 AS x, y // 2 AS y, AVG(r) AS r, AVG(g) AS g FROM (SELECT map_id, x // 2 AS x, y // 2 AS y, AVG(r) AS r, AVG(g) AS g FROM pixels GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""))
def _(spark, sf):
    return rounded(P.build_pyramid(C.pixels(spark, sf), 2).drop("b"), ["r", "g"], 5)


@query("r14_read_region", with_views("pixels", """WITH up AS (SELECT map_id, x * 2 + i AS x, y * 2 + j AS y, r FROM pixels, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)), d AS (SELECT map_id, x, y, b AS r FROM pixels)
SELECT u.map_id, u.map_id AS rect_id, u.x, u.y, COALESCE(d.r, u.r) AS r, d.r IS NOT NULL AS detail FROM up u LEFT JOIN d ON d.map_id = u.map_id AND d.x = u.x AND d.y = u.y WHERE u.x >= 120 AND u.x < 220 AND u.y >= 60 AND u.y < 140"""))
def _(spark, sf):
    px = C.pixels(spark, sf)
    rects = px.select("map_id").distinct().withColumns({"rect_id": c("map_id"), "rx": F.lit(60), "ry": F.lit(30), "rw": F.lit(50), "rh": F.lit(40)})
    return P.read_region(px, px.withColumn("r", c("b")), rects).select("map_id", "rect_id", "x", "y", "r", "detail")


@query("p10_effective_options", """SELECT c_custkey AS map_id, CAST(i AS INTEGER) AS chip_id, CASE WHEN adapt THEN CASE WHEN chroma > 32 THEN 40e0 ELSE 60e0 END ELSE tol END AS tolerance, CASE WHEN adapt THEN CASE WHEN chroma > 32 THEN 8e0 ELSE 0e0 END ELSE CAST(gap AS DOUBLE) END AS gap_px, CASE WHEN adapt THEN least(len_, 50e0) ELSE len_ END AS min_length_px FROM (
SELECT *, size >= 1000 AND tol = 60 AND chroma <= 110 AND NOT (chroma <= 32 AND lo < 220) AS adapt FROM (SELECT *, greatest(r, g, b) - least(r, g, b) AS chroma, least(r, g, b) AS lo FROM (SELECT *, c_custkey * i * 7 % 256 AS r, c_custkey * i * 11 % 256 AS g, c_custkey * i * 13 % 256 AS b,
 greatest(6, least(120, CAST(floor(size / 80e0 + 0.5e0) AS BIGINT))) AS gap, size * 0.04e0 AS len_, CASE WHEN c_custkey % 5 = 0 THEN 45e0 ELSE 60e0 END AS tol FROM (SELECT c_custkey, 500 + c_custkey * 13 % 6000 AS size, unnest([1, 2, 3]) AS i FROM customer))))""")
def _(spark, sf):
    k = c("c_custkey")
    base = C.table(spark, sf, "customer").select(k.alias("map_id"), (k * 13 % 6000 + 500).alias("width"))
    maps = base.withColumn("height", F.lit(400)).withColumns({
        "tolerance": F.when(c("map_id") % 5 == 0, 45.0).otherwise(60.0), "gap_px": F.greatest(F.lit(6), F.least(F.lit(120), F.floor(c("width") / 80 + 0.5))), "min_length_px": c("width") * 0.04,
    })
    chips = base.select("map_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("chip_id"))
    chips = chips.withColumns({n: c("map_id") * c("chip_id") * m % 256 for n, m in (("r", 7), ("g", 11), ("b", 13))})
    return P.effective_options(maps, chips, 1000)


def _cands(spark, sf):
    """Candidates from trails: colour by id, length from the vertex count, some without a score."""
    v = C.trail_vertices(spark, sf).withColumnRenamed("feature_id", "candidate_id")
    k = c("candidate_id")
    cands = v.groupBy("map_id", "candidate_id").agg(F.count("*").alias("n")).select(
        "map_id", "candidate_id", k.alias("seq"), (k % 3 + 1).cast("int").alias("chip_id"), (c("n") * 10 + k % 7).cast("double").alias("length_px"),
        F.when(k % 8 != 0, k % 100 / 100).alias("confidence"),
    )
    return cands, v


VIEWS["cands"] = (
    ["trail_vertices"],
    """SELECT map_id, feature_id AS candidate_id, feature_id AS seq, CAST(feature_id % 3 + 1 AS INTEGER) AS chip_id, CAST(COUNT(*) * 10 + feature_id % 7 AS DOUBLE) AS length_px, CASE WHEN feature_id % 8 <> 0 THEN (feature_id % 100) / 100e0 END AS confidence FROM trail_vertices GROUP BY map_id, feature_id""",
)
_NAMES = "(SELECT unnest([1, 2, 3]) AS chip_id, unnest(['Red', 'Loop', 'Green']) AS chip, unnest([FALSE, TRUE, FALSE]) AS named)"


def _cand_chips(cands):
    names = F.array(*[F.struct(F.lit(i).alias("chip_id"), F.lit(n).alias("name"), F.lit(k).alias("named"), F.lit(p).alias("r"), F.lit(q).alias("g"), F.lit(s).alias("b")) for i, n, k, p, q, s in ((1, "Red", False, 200, 30, 30), (2, "Loop", True, 30, 60, 200), (3, "Green", False, 40, 140, 60))])
    return cands.select("map_id").distinct().select("map_id", F.explode(names).alias("k")).select("map_id", "k.*")


@query("p07_review", with_views("cands", "SELECT map_id, candidate_id, confidence IS NULL OR confidence >= 0.5e0 AS selected, CASE WHEN confidence >= 0.75e0 THEN 'High' WHEN confidence >= 0.5e0 THEN 'Medium' WHEN confidence IS NOT NULL THEN 'Low' END AS band FROM cands"))
def _(spark, sf):
    return R.review(_cands(spark, sf)[0]).select("map_id", "candidate_id", "selected", "band")


@query("k03_rank_candidates", with_views("cands", "SELECT map_id, candidate_id, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY confidence DESC NULLS LAST, seq) AS position FROM cands"))
def _(spark, sf):
    return R.rank_candidates(_cands(spark, sf)[0]).select("map_id", "candidate_id", "position")


_NAMED = f"""(SELECT c.*, CASE WHEN n = 1 THEN base WHEN named THEN base || ' (part ' || k || ')' ELSE base || ' ' || k END AS name FROM (SELECT c.*, k.named, CASE WHEN k.named THEN chip ELSE chip || ' trail' END AS base, ROW_NUMBER() OVER (PARTITION BY map_id, c.chip_id ORDER BY seq) AS k, COUNT(*) OVER (PARTITION BY map_id, c.chip_id) AS n FROM cands c JOIN {_NAMES} k ON k.chip_id = c.chip_id) c)"""


@query("w09_name_candidates", with_views("cands", f"SELECT map_id, candidate_id, name FROM {_NAMED}"))
def _(spark, sf):
    cands, _ = _cands(spark, sf)
    return R.name_candidates(cands, _cand_chips(cands)).select("map_id", "candidate_id", "name")


@query("k05_filter_lines", with_views("trail_segs", """SELECT a.map_id, a.feature_id, round(l, 4) AS length_px FROM (SELECT map_id, feature_id, SUM(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS l, sqrt(pow(arg_max(x2, seg) - arg_min(x1, seg), 2) + pow(arg_max(y2, seg) - arg_min(y1, seg), 2)) AS chord FROM trail_segs GROUP BY map_id, feature_id) a
WHERE l >= 300 AND NOT (l < 500 AND l / greatest(chord, 1e0) > 1.5e0)"""))
def _(spark, sf):
    out = T.filter_lines(C.trail_vertices(spark, sf), 300.0)
    return out.where("idx = 0").select("map_id", "feature_id", r(c("length_px"), 4).alias("length_px"))


VIEWS["links"] = (
    ["ends"],
    """WITH d AS (SELECT *, CASE WHEN l > 0 THEN dx / nullif(l, 0) ELSE 0e0 END AS ux, CASE WHEN l > 0 THEN dy / nullif(l, 0) ELSE 0e0 END AS uy FROM (SELECT *, sqrt(dx * dx + dy * dy) AS l FROM (
  SELECT e.map_id, e.feature_id, e.side, e.x, e.y, COALESCE(CASE e.side WHEN 0 THEN arg_min(v.x, v.idx) ELSE arg_max(v.x, v.idx) END - e.x, 0e0) AS dx, COALESCE(CASE e.side WHEN 0 THEN arg_min(v.y, v.idx) ELSE arg_max(v.y, v.idx) END - e.y, 0e0) AS dy
  FROM ends e LEFT JOIN trail_vertices v ON v.feature_id = e.feature_id AND (v.x <> e.x OR v.y <> e.y) GROUP BY e.map_id, e.feature_id, e.side, e.x, e.y)))
SELECT a.map_id, a.feature_id AS a_id, a.side AS a_side, b.feature_id AS b_id, b.side AS b_side, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance, a.feature_id % 3 = b.feature_id % 3 AS same_chip FROM d a JOIN d b ON a.map_id = b.map_id AND a.feature_id < b.feature_id AND abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30
WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 900 AND a.ux * b.ux + a.uy * b.uy < -0.7e0""",
)


@query("j15_continuation_links", with_views("links", "SELECT map_id, a_id, a_side, b_id, b_side, round(distance, 4) AS distance, same_chip FROM links"))
def _(spark, sf):
    cands, v = _cands(spark, sf)
    return rounded(R.continuation_links(cands, v, 30.0), ["distance"], 4)


# The walk itself, link by link: taken ports, and the chain that each line is in by now.
@query("t10_match_links", with_views("links", """WITH RECURSIVE o AS (SELECT *, CAST(a_id AS VARCHAR) || ':' || a_side AS pa, CAST(b_id AS VARCHAR) || ':' || b_side AS pb, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY distance, a_id, a_side, b_id, b_side) AS k FROM links),
walk AS (SELECT map_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, list(id) AS ids, list(id) AS chains, CAST([] AS BIGINT[]) AS kept FROM (SELECT map_id, a_id AS id FROM o UNION SELECT map_id, b_id FROM o) GROUP BY map_id
 UNION ALL SELECT map_id, k, CASE WHEN ok THEN list_concat(used, [pa, pb]) ELSE used END, ids, CASE WHEN ok THEN list_transform(chains, lambda t: CASE WHEN t = cb THEN ca ELSE t END) ELSE chains END, CASE WHEN ok THEN list_append(kept, k) ELSE kept END
 FROM (SELECT *, ca <> cb AND NOT list_contains(used, pa) AND NOT list_contains(used, pb) AS ok FROM (SELECT w.map_id, o.k, used, ids, chains, kept, pa, pb, chains[list_position(ids, a_id)] AS ca, chains[list_position(ids, b_id)] AS cb FROM walk w JOIN o ON o.map_id = w.map_id AND o.k = w.k + 1)))
SELECT o.map_id, a_id, a_side, b_id, b_side, round(distance, 4) AS distance FROM o JOIN (SELECT map_id, unnest(kept) AS k FROM (SELECT map_id, arg_max(kept, k) AS kept FROM walk GROUP BY map_id)) w ON w.map_id = o.map_id AND w.k = o.k"""))
def _(spark, sf):
    cands, v = _cands(spark, sf)
    return rounded(R.match_links(R.continuation_links(cands, v, 30.0)), ["distance"], 4)


@query("t11_merge_cross_color")
def _(spark, sf):
    cands, v = _cands(spark, sf)
    return rounded(R.merge_cross_color(cands, v, 30.0)["candidates"], ["length_px", "confidence"], 4)


@query("g24_merge_attrs", with_views("cands", """WITH p AS (SELECT *, candidate_id // 16 AS chain_id, candidate_id % 16 AS pos FROM cands), m AS (SELECT map_id, chain_id, arg_max(candidate_id, length_px * 1e9 - candidate_id) AS candidate_id, arg_max(chip_id, length_px * 1e9 - candidate_id) AS chip_id, SUM(length_px) AS length_px,
 CASE WHEN COUNT(*) = COUNT(confidence) THEN SUM(confidence * length_px) / SUM(length_px) END AS confidence FROM p GROUP BY map_id, chain_id)
SELECT m.map_id, m.chain_id, m.candidate_id, m.chip_id, length_px, round(confidence, 6) AS confidence, COALESCE(also, '') AS also FROM m LEFT JOIN (SELECT map_id, chain_id, string_agg(CAST(chip_id AS VARCHAR), ',' ORDER BY f) AS also FROM (SELECT p.map_id, p.chain_id, p.chip_id, MIN(pos) AS f FROM p JOIN m ON m.map_id = p.map_id AND m.chain_id = p.chain_id WHERE p.chip_id <> m.chip_id GROUP BY p.map_id, p.chain_id, p.chip_id) GROUP BY map_id, chain_id) a ON a.map_id = m.map_id AND a.chain_id = m.chain_id"""))
def _(spark, sf):
    cands, _ = _cands(spark, sf)
    k = c("candidate_id")
    parts = cands.withColumn("chain_id", F.floor(k / 16).cast("bigint")).withColumn("pos", k % 16)
    m = R.merge_attrs(parts)
    return m.select("map_id", "chain_id", "candidate_id", "chip_id", "length_px", r(c("confidence"), 6).alias("confidence"), F.concat_ws(",", c("also_chips").cast("array<string>")).alias("also"))


@query("r12_accept", with_views("cands", f"""SELECT map_id, candidate_id AS feature_id, name, CASE chip_id WHEN 1 THEN '#c81e1e' WHEN 2 THEN '#1e3cc8' ELSE '#288c3c' END AS color, CASE WHEN candidate_id % 5 = 0 THEN 'Also follows: ' || CASE chip_id WHEN 1 THEN 'Loop' ELSE 'Red' END || '.' ELSE '' END AS notes FROM {_NAMED} WHERE confidence IS NULL OR confidence >= 0.5e0"""))
def _(spark, sf):
    cands, _ = _cands(spark, sf)
    chips = _cand_chips(cands)
    other = F.when(c("chip_id") == 1, 2).otherwise(1)
    rows = R.name_candidates(R.review(cands), chips).withColumn("also_chips", F.when(c("candidate_id") % 5 == 0, F.array(other)).otherwise(F.array().cast("array<int>")))
    return R.accept(rows, chips).select("map_id", "feature_id", "name", "color", "notes")


def _median(v: str) -> str:
    """Value at index n div 2 of the sorted values."""
    return f"list_sort(list({v}))[COUNT(*) // 2 + 1]"


def _apart(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({a}{k} - {b}{k}, 2)" for k in "rgb") + ")"


# Lines run straight down, so a station's flanks lie in its own row.
_LINE_INK_SQL = f"""WITH seen AS (SELECT s.map_id, s.x AS line, s.y, o, p.r, p.g, p.b FROM (SELECT * FROM pixels WHERE y % 4 = 0) s, (SELECT unnest(range(-6, 7)) AS o) JOIN pixels p ON p.map_id = s.map_id AND p.y = s.y AND p.x = greatest(0, least(149, s.x - o))),
f AS (SELECT l.map_id, l.line, l.y, l.r AS lr, l.g AS lg, l.b AS lb, q.r AS qr, q.g AS qg, q.b AS qb FROM seen l JOIN seen q ON q.map_id = l.map_id AND q.line = l.line AND q.y = l.y WHERE l.o = -6 AND q.o = 6),
back AS (SELECT map_id, line, {", ".join(f"{_median(f'greatest(l{k}, q{k})')} AS f{k}" for k in "rgb")} FROM f GROUP BY map_id, line),
mid AS (SELECT map_id, line, COUNT(*) AS stations, {", ".join(f"{_median(k)} AS m{k}" for k in "rgb")} FROM seen WHERE o = 0 GROUP BY map_id, line),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id, line, y ORDER BY contrast DESC, o) AS place FROM (SELECT s.*, least({_apart('s.', 'f.l')}, {_apart('s.', 'f.q')}) AS contrast FROM seen s JOIN f ON f.map_id = s.map_id AND f.line = s.line AND f.y = s.y) WHERE contrast > 40) WHERE place = 1),
top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id, line ORDER BY n DESC, first_y) AS place FROM (SELECT map_id, line, COUNT(*) AS n, MIN(y) AS first_y, {", ".join(f"floor(AVG({k}) + 0.5e0) AS v{k}" for k in "rgb")} FROM best GROUP BY map_id, line, r // 16, g // 16, b // 16)) WHERE place = 1)
SELECT mid.map_id, CAST(mid.line AS BIGINT) AS feature_id, stations, {", ".join(f"CAST(CASE WHEN {_apart('m', 'f')} > 40 THEN m{k} WHEN n / CAST(stations AS DOUBLE) >= 0.5e0 AND {_apart('v', 'f')} > 40 THEN v{k} END AS INTEGER) AS ink_{k}" for k in "rgb")}
FROM mid JOIN back ON back.map_id = mid.map_id AND back.line = mid.line LEFT JOIN top ON top.map_id = mid.map_id AND top.line = mid.line"""


@query("g22_line_ink", with_views("pixels", _LINE_INK_SQL))
def _(spark, sf):
    v = _line_vertices(spark, sf).withColumnRenamed("line", "feature_id")
    return R.line_ink(v, C.pixels(spark, sf), _maps(spark, sf), 6, 40.0)


_TINT = "sqrt(pow(r - 30, 2) + pow(g - 60, 2) + pow(b - 200, 2))"
_REFINE_SQL = f"""WITH l AS (SELECT map_id, x AS line, MAX(y) AS len FROM pixels GROUP BY map_id, x),
d AS (SELECT map_id, line, d, d = 0 OR d = len AS pinned FROM (SELECT map_id, line, len, unnest(list_distinct(list_concat(range(0, len, 60), [CAST(len AS BIGINT)]))) AS d FROM l)),
st AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id, line ORDER BY d) - 1 AS idx FROM d),
met AS (SELECT st.map_id, line, idx, x, y, {_TINT} + sqrt(pow(x - line, 2) + pow(y - d, 2)) * (40e0 / 6) AS cost FROM st JOIN pixels p ON p.map_id = st.map_id AND abs(x - line) <= 6 AND abs(y - d) <= 6 WHERE NOT pinned),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id, line, idx ORDER BY cost, y, x) AS place FROM met WHERE cost <= 40) WHERE place = 1),
moved AS (SELECT st.map_id, st.line, st.idx, d, pinned, CAST(COALESCE(b.x, st.line) AS DOUBLE) AS x, CAST(COALESCE(b.y, d) AS DOUBLE) AS y FROM st LEFT JOIN best b ON b.map_id = st.map_id AND b.line = st.line AND b.idx = st.idx),
run AS (SELECT *, greatest(1, ceil(sqrt(pow(x - ax, 2) + pow(y - ay, 2)) / 10)) AS n FROM (SELECT *, LAG(x) OVER w AS ax, LAG(y) OVER w AS ay FROM moved WINDOW w AS (PARTITION BY map_id, line ORDER BY idx)) WHERE ax IS NOT NULL),
walk AS (SELECT map_id, line, idx, ax + (x - ax) * (k / n) AS sx, ay + (y - ay) * (k / n) AS sy FROM (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS k FROM run)),
share AS (SELECT w.map_id, line, idx, AVG(CASE WHEN {_TINT} <= 40 THEN 1e0 ELSE 0e0 END) AS confidence FROM walk w JOIN pixels p ON p.map_id = w.map_id AND p.x = CAST(floor(sx + 0.5e0) AS INTEGER) AND p.y = CAST(floor(sy + 0.5e0) AS INTEGER) GROUP BY w.map_id, line, idx)
SELECT m.map_id, CAST(m.line AS BIGINT) AS feature_id, m.idx, CAST(d AS DOUBLE) AS d, x, y, pinned, round(confidence, 4) AS confidence, COALESCE(confidence >= 0.6e0, FALSE) AS refined FROM moved m LEFT JOIN share s ON s.map_id = m.map_id AND s.line = m.line AND s.idx = m.idx"""


@query("t15_refine_lines", with_views("pixels", _REFINE_SQL))
def _(spark, sf):
    v = _line_vertices(spark, sf).withColumnRenamed("line", "feature_id")
    inks = v.select("map_id", "feature_id").distinct().withColumns({"ink_r": F.lit(30), "ink_g": F.lit(60), "ink_b": F.lit(200)})
    return rounded(R.refine_lines(v, C.pixels(spark, sf), _maps(spark, sf), inks, 6.0, 40.0), ["d", "x", "y", "confidence"], 4)


@query("t15_refine_paths")
def _(spark, sf):
    # Slanted strokes run three columns left a row down; hand lines stray from them by up to four pixels.
    top = _maps(spark, sf).select("map_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("feature_id"))
    v = top.select("map_id", c("feature_id").cast("bigint").alias("feature_id"), F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i"))
    x = c("i") * 10.0 + 8
    v = v.select("map_id", "feature_id", c("i").cast("bigint").alias("idx"), x.alias("x"), ((41 - x) / 3 + c("feature_id") * 40 / 3 + 27 + F.pmod(c("i") * 5 + c("map_id"), F.lit(9)) - 4).alias("y"))
    inks = v.select("map_id", "feature_id").distinct().withColumns({"ink_r": F.lit(200), "ink_g": F.lit(30), "ink_b": F.lit(30)})
    out = K.refine_paths(v, C.pixels(spark, sf), _maps(spark, sf), inks, 8.0, 60.0)["vertices"]
    return rounded(out, ["x", "y"], 4)
