"""Which feature a point falls on."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cairnfield.functions.plane import project_on_segment
from cairnfield.operators.grid import met_in_cells
from cairnfield.operators.lines import point_in_polygon, segments
from cairnfield.operators.together import Columns, Net, Places, Refused, by_maps, met_by_segments, numbered_ids, project
from cairnfield.session import cut

# fixed values: pick distances in screen pixels
LINE_REACH = 9.0
POI_REACH = 12.0
POI_BONUS = 3.0


def nearest_feature(points: DataFrame, v: DataFrame, point_keys: Sequence[str], scale: float = 1.0) -> DataFrame:
    """The feature under each point: nearest line or point of interest in reach, else an area around it.

    Reach is in screen pixels; ``scale`` is screen pixels per map pixel. Points of interest get a
    bonus, ties go to the least id. Points and features of a map meet in one task; those of a map that
    is too large for it meet in cells.
    """
    c = F.col
    marks = [f"_p{k}" for k in range(len(point_keys))]
    whole = numbered_ids(points.select("map_id"), v) and all(isinstance(points.schema[k].dataType, IntegralType) for k in point_keys)
    if not whole or not 0 < scale < math.inf:
        return _nearest_by_cells(points, v, point_keys, scale)
    null = lambda k: F.lit(None).cast(k)
    role = F.when(c("kind") == "poi", SPOT).when(c("kind") == "area", AREA).otherwise(LINE)
    drawn = v.where("kind is not null").select("map_id", "feature_id", "idx", "x", "y", *[null(points.schema[k].dataType).alias(m) for k, m in zip(point_keys, marks)], role.alias("_role"))
    asked = points.select("map_id", null(v.schema["feature_id"].dataType).alias("feature_id"), null(v.schema["idx"].dataType).alias("idx"), "x", "y", *[c(k).alias(m) for k, m in zip(point_keys, marks)], F.lit(POINT).alias("_role"))
    fields = [*(drawn.schema[m] for m in marks), v.schema["feature_id"]]
    found, rest = by_maps(drawn.unionByName(asked), partial(_nearest_together, marks, scale), fields, ["_role"])
    named = lambda df: df.withColumnsRenamed(dict(zip(marks, point_keys)))
    out = named(found).select("map_id", *point_keys, "feature_id")
    if rest is None:
        return out
    kind = F.when(c("_role") == SPOT, "poi").when(c("_role") == AREA, "area").otherwise("trail")
    some = named(rest.where(c("_role") == POINT).select("map_id", *marks, "x", "y"))
    return out.unionByName(_nearest_by_cells(some, rest.where(c("_role") != POINT).select("map_id", "feature_id", "idx", "x", "y", kind.alias("kind")), point_keys, scale))


LINE, AREA, SPOT, POINT = range(4)
STRIP = 64.0


def _nearest_together(marks: list[str], scale: float, c: Columns, maps: np.ndarray) -> Columns:
    """``nearest_feature`` of whole maps."""
    role, least = c["_role"], np.iinfo(np.int64).min
    at, spot, drawn = np.flatnonzero(role == POINT), np.flatnonzero(role == SPOT), np.flatnonzero((role == LINE) | (role == AREA))
    keys = [c[k][at] for k in marks]
    order = np.lexsort((*keys, maps[at]))
    twice = np.zeros(len(at), bool)
    twice[order[1:]] = np.all([k[order][1:] == k[order][:-1] for k in (*keys, maps[at])], axis=0)
    odd = twice | np.any([k == least for k in keys], axis=0) if keys else twice
    lost = np.concatenate([maps[at[odd]], maps[(role != POINT) & (c["feature_id"] == least)], maps[~(np.isfinite(c["x"]) & np.isfinite(c["y"]))]])
    if len(lost):
        raise Refused(lost)
    px, py, m = c["x"][at], c["y"][at], maps[at]
    net = Net({**{k: c[k][drawn] for k in ("feature_id", "idx", "x", "y")}}, maps[drawn])
    kinds = role[drawn][np.lexsort((c["idx"][drawn], c["feature_id"][drawn], maps[drawn]))]
    mixed = kinds != kinds[net.first][net.of]
    if mixed.any():
        raise Refused(net.maps[mixed])
    of, _, path = net.segments()
    ring = np.flatnonzero((kinds[net.first] == AREA) & (net.top >= 1))
    a, z = net.first[ring], net.first[ring] + net.top[ring]
    of, path = np.concatenate([of, ring]), tuple(np.concatenate(k) for k in zip(path, (net.x[z], net.y[z], net.x[a], net.y[a])))
    places = Places(m, px, py, STRIP)
    got: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (int, float, int))]
    for s, p in met_by_segments(places, net.line_map[of], path, LINE_REACH / scale):
        d = np.sqrt(project(px[p], py[p], *(k[s] for k in path))[3]) * scale
        near = d < LINE_REACH
        got.append((p[near], d[near], net.ids[of[s[near]]]))
    x, y = c["x"][spot], c["y"][spot]
    for s, p in met_by_segments(places, maps[spot], (x, y, x, y), POI_REACH / scale):
        d = np.hypot(px[p] - x[s], py[p] - y[s]) * scale
        near = d < POI_REACH
        got.append((p[near], d[near] - POI_BONUS, c["feature_id"][spot[s[near]]]))
    p, d, f = (np.concatenate(k) for k in zip(*got))
    order = np.lexsort((f, d, p))
    best = order[np.diff(p[order], prepend=-1) != 0]
    out, has = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    out[p[best]], has[p[best]] = f[best], True
    # The others may lie in an area: by the edges that a ray to the right crosses, looked up in rows of strips.
    rest = np.flatnonzero(~has)
    edge = np.flatnonzero(kinds[net.first][of] == AREA)
    x1, y1, x2, y2 = (k[edge] for k in path)
    box = [np.full(len(net.first), v) for v in (np.inf, np.inf, -np.inf, -np.inf)]
    for k, (fold, v) in enumerate(((np.minimum, net.x), (np.minimum, net.y), (np.maximum, net.x), (np.maximum, net.y))):
        fold.at(box[k], net.of, v)
    left = box[0][of[edge]]
    rows = Places(m[rest], py[rest], px[rest], STRIP)
    crossed: list[np.ndarray] = [np.zeros(0, np.int64)]
    # An edge stands for the box from its ring's left side to its own right one; here y comes first.
    for s, p in met_by_segments(rows, net.line_map[of[edge]], (np.minimum(y1, y2), left, np.maximum(y1, y2), left), 0.0, np.maximum(x1, x2) - left):
        p = rest[p]
        with np.errstate(all="ignore"):
            hit = ((y1[s] > py[p]) != (y2[s] > py[p])) & (px[p] < (x2[s] - x1[s]) * (py[p] - y1[s]) / (y2[s] - y1[s]) + x1[s])
        s, p = s[hit], p[hit]
        line = of[edge[s]]
        ok = (px[p] >= box[0][line]) & (px[p] <= box[2][line]) & (py[p] >= box[1][line]) & (py[p] <= box[3][line])
        crossed.append(p[ok] * len(net.first) + line[ok])
    pair, n = np.unique(np.concatenate(crossed), return_counts=True)
    p, line = np.divmod(pair[n % 2 == 1], max(len(net.first), 1))
    # Lines are in order of their ids within a map, so a point's first one is its least.
    p, first = np.unique(p, return_index=True)
    out[p], has[p] = net.ids[line[first]], True
    some = np.flatnonzero(has)
    return {"map": m[some], "feature_id": out[some], **{k: v[some] for k, v in zip(marks, keys)}}


def _nearest_by_cells(points: DataFrame, v: DataFrame, point_keys: Sequence[str], scale: float) -> DataFrame:
    c = F.col
    keys = ["map_id", *point_keys]
    reach, poi_reach = LINE_REACH / scale, POI_REACH / scale
    probe = points.select(*keys, c("x").alias("px"), c("y").alias("py"))
    lines = v.where("kind <> 'poi'")
    edges = segments(lines.select("map_id", "feature_id", "idx", "x", "y", "kind"), closed=c("kind") == "area")
    probe = cut(probe)

    def on_line(met: DataFrame) -> DataFrame:
        d_line = F.sqrt(project_on_segment(c("px"), c("py"), c("x1"), c("y1"), c("x2"), c("y2"))["d2"]) * scale
        return met.select(*keys, "feature_id", d_line.alias("d")).where(f"d < {LINE_REACH}")

    def on_spot(met: DataFrame) -> DataFrame:
        met = met.select(*keys, "feature_id", (F.hypot(c("px") - c("x1"), c("py") - c("y1")) * scale).alias("d"))
        return met.where(f"d < {POI_REACH}").withColumn("d", c("d") - POI_BONUS)

    at = [c(n).alias(f"{n}{k}") for k in (1, 2) for n in "xy"]
    spots = cut(v.where("kind = 'poi'").select("map_id", "feature_id", *at))
    near = met_in_cells(probe, cut(edges.select("map_id", "feature_id", "x1", "y1", "x2", "y2")), ["map_id"], 64.0, reach, on_line, "px", "py")
    met = met_in_cells(probe, spots, ["map_id"], poi_reach, poi_reach, on_spot, "px", "py")
    both = near.unionByName(met)
    best = both.groupBy(*keys).agg(F.min(F.struct("d", "feature_id")).alias("b")).select(*keys, c("b.feature_id").alias("_near"))
    inside = point_in_polygon(points, v.where("kind = 'area'"), point_keys).groupBy(*keys).agg(F.min("feature_id").alias("_in"))
    out = best.join(inside, keys, "full")
    return out.select(*keys, F.coalesce("_near", "_in").alias("feature_id"))
