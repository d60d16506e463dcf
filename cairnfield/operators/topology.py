"""Line ends that should meet: clusters, snapping, splitting, joining, chaining."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField

from cairnfield.functions.plane import distance2, project_on_segment
from cairnfield.operators.graph import connected_components, list_rank
from cairnfield.operators.grid import met_in_cells, point_cells, point_cells_around
from cairnfield.operators.lines import KEYS, measured_segments, project_points, ring_facts, route_reason, segments
from cairnfield.operators.ordered import running, top_by
from cairnfield.operators.simplify import renumber
from cairnfield.operators.together import Clusters, Columns, Net, Places, Refused, by_maps, components, least_and_greatest, linked_spots, met_by_segments, nearest, numbered_ids, project
from cairnfield.session import cut


def _end_pairs(v: DataFrame) -> DataFrame:
    """Every trail with at least two vertices and its ends (ax, ay) and (zx, zy), in one row."""
    at = F.struct("x", "y")
    ends = v.groupBy(*KEYS).agg(F.max("idx").alias("_top"), F.min_by(at, "idx").alias("a"), F.max_by(at, "idx").alias("z"))
    return ends.where("_top >= 1").select(*KEYS, *[F.col(f"{p}.{n}").alias(f"{p}{n}") for p in "az" for n in "xy"])


def _each_end(pairs: DataFrame) -> DataFrame:
    at = [F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "az"]
    return pairs.select(*KEYS, F.posexplode(F.array(*at)).alias("side", "p")).select(*KEYS, "side", "p.x", "p.y")


def trail_ends(v: DataFrame) -> DataFrame:
    """Both ends of every trail with at least two vertices: (map_id, feature_id, side, x, y)."""
    return _each_end(_end_pairs(v))


def _spots(ends: DataFrame) -> DataFrame:
    """Distinct end coordinates with the least and greatest trail that ends there."""
    return ends.groupBy("map_id", "x", "y").agg(F.min("feature_id").alias("lo"), F.max("feature_id").alias("hi"))


def spot_links(ends: DataFrame, tolerance: float, own: bool = False) -> DataFrame:
    """Links (a, b) between end coordinates that tie all ends within tolerance into clusters.

    Cells are small enough that all ends in one cell are within tolerance of each other, so a cell
    needs a star and not all pairs; a coordinate needs at most two links into a neighbour cell,
    because a cell's ends are tied already unless one single trail owns them. ``own`` lets the two
    ends of one trail count as near each other.
    """
    c = F.col
    size = tolerance / math.sqrt(2) if tolerance > 0 else 1.0
    spots = point_cells(_spots(ends), size).withColumn("id", F.struct("map_id", "x", "y"))
    cells = spots.groupBy("map_id", "_cx", "_cy").agg(F.min("id").alias("_hub"), F.min("lo").alias("_clo"), F.max("hi").alias("_chi"))
    tied = F.lit(True) if own else c("_clo") != c("_chi")
    star = spots.join(cells.where(tied).select("map_id", "_cx", "_cy", "_hub"), ["map_id", "_cx", "_cy"])
    star = star.where("id <> _hub").select(c("id").alias("a"), c("_hub").alias("b"))
    if tolerance <= 0:
        return star.limit(0)
    around = point_cells_around(spots.drop("_cx", "_cy"), size, ring=2).select(
        c("id").alias("a"), "map_id", c("x").alias("px"), c("y").alias("py"), c("lo").alias("alo"), c("hi").alias("ahi"), "_cx", "_cy"
    )
    met = around.join(spots, ["map_id", "_cx", "_cy"]).where(c("id") > c("a"))
    met = met.where(distance2(c("px"), c("py"), c("x"), c("y")) <= tolerance * tolerance)
    if not own:
        met = met.where(~((c("alo") == c("ahi")) & (c("lo") == c("hi")) & (c("alo") == c("lo"))))
    few = met.groupBy("a", "map_id", "_cx", "_cy").agg(F.min("id").alias("_b1"), F.max("id").alias("_b2"))
    cross = few.select("a", F.explode(F.array_distinct(F.array("_b1", "_b2"))).alias("b"))
    return star.unionByName(cross)


def endpoint_clusters(v: DataFrame, tolerance: float, own: bool = False) -> DataFrame:
    """Every trail end with its cluster, the cluster's size and its mean point.

    Ends alone in their cluster, or sharing a spot with their own trail only, have size 1. The ends of a map meet in
    one task; those of a map that is too large for it meet in cells.
    """
    c = F.col
    pairs = _end_pairs(v)
    if not numbered_ids(v) or not math.isfinite(tolerance):
        return _clusters_by_cells(_each_end(pairs), tolerance, own)
    fields = [pairs.schema["feature_id"], StructField("side", IntegerType()), *(StructField(k, DoubleType()) for k in ("x", "y", "rx", "ry")), StructField("size", LongType()), *(StructField(k, DoubleType()) for k in ("cluster_x", "cluster_y"))]
    found, rest = by_maps(pairs, partial(_clustered, tolerance, own), fields, ["feature_id"])
    out = found.select(*KEYS, "side", "x", "y", F.struct(c("rx").alias("x"), c("ry").alias("y")).alias("cluster"), "size", "cluster_x", "cluster_y")
    return out if rest is None else out.unionByName(_clusters_by_cells(_each_end(rest), tolerance, own))


def _finite(maps: np.ndarray, *values: np.ndarray) -> None:
    for v in values:
        if not np.isfinite(v).all():
            raise Refused(maps[~np.isfinite(v)])


def _clustered(tolerance: float, own: bool, c: Columns, maps: np.ndarray) -> Columns:
    """``endpoint_clusters`` of whole maps from their pairs of ends."""
    order = np.lexsort((c["feature_id"], maps))
    two = lambda a, z: np.stack([c[a][order], c[z][order]], 1).ravel() + 0.0
    x, y, line, m = two("ax", "zx"), two("ay", "zy"), np.repeat(np.arange(len(order)), 2), np.repeat(maps[order], 2)
    _finite(m, x, y)
    k = Clusters(m, x, y, line, tolerance, own)
    return {"map": m, "feature_id": c["feature_id"][order][line], "side": np.tile(np.array([0, 1]), len(order)), "x": x, "y": y, "rx": k.root_x, "ry": k.root_y, "size": k.size, "cluster_x": k.cx, "cluster_y": k.cy}


def _clusters_by_cells(ends: DataFrame, tolerance: float, own: bool) -> DataFrame:
    c = F.col
    ends = cut(ends)
    roots = connected_components(spot_links(ends, tolerance, own))
    rows = ends.withColumn("id", F.struct("map_id", "x", "y")).join(roots, "id", "left")
    rows = rows.withColumn("root", F.coalesce("root", "id"))
    groups = rows.groupBy("root").agg(
        F.count("*").alias("size"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min("feature_id").alias("_lo"), F.max("feature_id").alias("_hi"),
    )
    out = rows.join(groups, "root")
    paired = c("size") >= 2 if own else c("_lo") != c("_hi")
    return out.select(
        *KEYS, "side", "x", "y", F.struct(c("root.x"), c("root.y")).alias("cluster"),
        F.when(paired, c("size")).otherwise(1).alias("size"),
        F.when(paired, c("cx")).otherwise(c("x")).alias("cluster_x"), F.when(paired, c("cy")).otherwise(c("y")).alias("cluster_y"),
    )


def near_ends(v: DataFrame, tolerance: float) -> DataFrame:
    """For every end with an end of another trail within tolerance: the nearest such end.

    Coordinates keep their two least trails only, which is enough to answer for every end, so one
    crowded spot does not multiply.
    """
    return _near_ends(cut(trail_ends(v)), tolerance)


def _near_ends(ends: DataFrame, tolerance: float) -> DataFrame:
    c = F.col
    per_trail = ends.groupBy("map_id", "x", "y", "feature_id").agg(F.min("side").alias("side"))
    two = top_by(per_trail, ["map_id", "x", "y"], [c("feature_id")], 2)
    size = max(tolerance, 1e-9)
    there = point_cells(two, size).select(
        "map_id", "_cx", "_cy", c("x").alias("nx"), c("y").alias("ny"), c("feature_id").alias("near_feature_id"), c("side").alias("near_side")
    )
    met = point_cells_around(ends, size).join(there, ["map_id", "_cx", "_cy"]).where("feature_id <> near_feature_id")
    d2 = distance2(c("x"), c("y"), c("nx"), c("ny"))
    met = met.withColumn("d2", d2).where(c("d2") <= tolerance * tolerance)
    best = met.groupBy(*KEYS, "side").agg(F.min(F.struct("d2", "near_feature_id", "near_side")).alias("b"))
    return best.select(*KEYS, "side", "b.near_feature_id", "b.near_side", F.sqrt("b.d2").alias("distance"))


def nearest_segment(ends: DataFrame, segs: DataFrame, tolerance: float) -> DataFrame:
    """For each end: the nearest segment of another trail within tolerance, ties by trail then segment.

    Ends and segments of a map meet in one task; those of a map that is too large for it meet in cells.
    """
    c = F.col
    if not numbered_ids(ends, segs) or not 0 < tolerance < math.inf or ends.schema["feature_id"] != segs.schema["feature_id"]:
        return _nearest_by_cells(ends, segs, tolerance)
    dots = ends.select(*KEYS, c("side").cast("bigint").alias("at"), c("x").alias("x1"), c("y").alias("y1"), F.lit(None).cast("double").alias("x2"), F.lit(None).cast("double").alias("y2"), F.lit(True).alias("_end"))
    path = segs.where("x1 <> x2 or y1 <> y2").select(*KEYS, c("seg").cast("bigint").alias("at"), "x1", "y1", "x2", "y2", F.lit(False).alias("_end"))
    fields = [ends.schema["feature_id"], ends.schema["side"], StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("on_feature_id", segs.schema["feature_id"].dataType), segs.schema["seg"], *(StructField(k, DoubleType()) for k in ("t", "hx", "hy", "d2"))]
    found, rest = by_maps(dots.unionByName(path), partial(_nearest_together, tolerance), fields, ["feature_id", "at"])
    if rest is None:
        return found
    some = rest.where("_end").select(*KEYS, c("at").cast(ends.schema["side"].dataType).alias("side"), c("x1").alias("x"), c("y1").alias("y"))
    return found.unionByName(_nearest_by_cells(some, rest.where("not _end").select(*KEYS, c("at").cast(segs.schema["seg"].dataType).alias("seg"), "x1", "y1", "x2", "y2"), tolerance))


def _nearest_together(tolerance: float, c: Columns, maps: np.ndarray) -> Columns:
    """``nearest_segment`` of whole maps."""
    end, seg = np.flatnonzero(c["_end"]), np.flatnonzero(~c["_end"])
    _, line = np.unique(c["feature_id"], return_inverse=True)
    _finite(maps[end], c["x1"][end], c["y1"][end])
    _finite(maps[seg], *(c[k][seg] for k in ("x1", "y1", "x2", "y2")))
    keys = (c["y1"][end], c["x1"][end], c["at"][end], line[end], maps[end])
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    end = end[order[new]]
    p, s, t, hx, hy, d2 = nearest(maps[end], c["x1"][end], c["y1"][end], line[end], maps[seg], line[seg], c["at"][seg], tuple(c[k][seg] for k in ("x1", "y1", "x2", "y2")), tolerance)
    e, g = end[p], seg[s]
    return {"map": maps[e], "feature_id": c["feature_id"][e], "side": c["at"][e], "x": c["x1"][e], "y": c["y1"][e], "on_feature_id": c["feature_id"][g], "seg": c["at"][g], "t": t, "hx": hx, "hy": hy, "d2": d2}


def _nearest_by_cells(ends: DataFrame, segs: DataFrame, tolerance: float) -> DataFrame:
    c = F.col
    path = segs.where("x1 <> x2 or y1 <> y2").select("map_id", c("feature_id").alias("on_feature_id"), "seg", "x1", "y1", "x2", "y2")

    def near(met: DataFrame) -> DataFrame:
        met = met.where("feature_id <> on_feature_id").withColumn("_p", project_on_segment(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2")))
        return met.where(c("_p.d2") <= tolerance * tolerance).select(
            *KEYS, "side", "x", "y", F.struct(c("_p.d2").alias("d2"), "on_feature_id", "seg", c("_p.t").alias("t"), c("_p.x").alias("hx"), c("_p.y").alias("hy")).alias("b")
        )

    met = met_in_cells(cut(ends.select(*KEYS, "side", "x", "y")), cut(path), ["map_id"], tolerance * 4, tolerance, near)
    best = met.groupBy(*KEYS, "side", "x", "y").agg(F.min("b").alias("b"))
    return best.select(*KEYS, "side", "x", "y", "b.on_feature_id", "b.seg", "b.t", "b.hx", "b.hy", "b.d2")


INSIDE = "t > 1e-9 and t < 1 - 1e-9"


def _inside(t: np.ndarray) -> np.ndarray:
    return (t > 1e-9) & (t < 1 - 1e-9)


def maps_needing_cleanup(v: DataFrame, tolerance: float) -> DataFrame:
    """Per map: would snapping change anything? Says so without rebuilding a line."""
    v = v.select(*KEYS, "idx", "x", "y")
    if not numbered_ids(v) or not 0 < tolerance < math.inf:
        return _cleanup_by_cells(v, tolerance)
    found, rest = by_maps(v, partial(_cleanup_together, tolerance), [StructField("needs_cleanup", BooleanType())], ["feature_id"])
    return found if rest is None else found.unionByName(_cleanup_by_cells(rest, tolerance))


def _cleanup_together(tolerance: float, c: Columns, maps: np.ndarray) -> Columns:
    net = Net(c, maps)
    line, _, row = net.ends()
    m, x, y = net.maps[row], net.x[row] + 0.0, net.y[row] + 0.0
    head, spot, a, _ = linked_spots(m, x, y, line, tolerance, False)
    dirty = np.zeros(int(maps.max()) + 1, bool)
    dirty[m[head[a]]] = True
    # A pair apart decides its map; in the others, ends without another trail's end look for segments.
    low, high = least_and_greatest(spot, line, len(head))
    lone = np.flatnonzero((low == high)[spot] & ~dirty[m])
    at, seg, path = net.segments()
    open_ = np.flatnonzero(~dirty[net.line_map[at]])
    p, _, t, _, _, d2 = nearest(m[lone], x[lone], y[lone], line[lone], net.line_map[at[open_]], at[open_], seg[open_], tuple(k[open_] for k in path), tolerance)
    dirty[m[lone[p[(d2 > 0) | _inside(t)]]]] = True
    return {"map": np.arange(len(dirty)), "needs_cleanup": dirty}


def _cleanup_by_cells(v: DataFrame, tolerance: float) -> DataFrame:
    c = F.col
    v = cut(v)
    ends = cut(trail_ends(v))
    # A pair apart needs a move and decides its map; only the other maps look for segments.
    moved = cut(spot_links(ends, tolerance).select(c("a.map_id").alias("map_id")).distinct())
    open_ends = ends.join(moved, "map_id", "left_anti")
    lone = open_ends.join(_near_ends(open_ends, tolerance), [*KEYS, "side"], "left_anti")
    path = segments(v.join(moved, "map_id", "left_anti"))
    hits = _nearest_by_cells(lone, path, tolerance).where(f"d2 > 0 or ({INSIDE})").select("map_id").distinct()
    dirty = moved.unionByName(hits).withColumn("needs_cleanup", F.lit(True))
    return v.select("map_id").distinct().join(dirty, "map_id", "left").fillna(False, ["needs_cleanup"])


def snap_ends(v: DataFrame, tolerance: float) -> DataFrame:
    """New vertices of every trail that snapping changes: (map_id, feature_id, idx, x, y).

    Clustered ends move to their mean, lone ends onto the nearest other trail, which gains a vertex
    there. A map is snapped whole in one task; one that is too large for it goes through cells.
    """
    v = v.select(*KEYS, "idx", "x", "y")
    if not tolerance > 0 or math.isinf(tolerance):
        return v.limit(0)
    if not numbered_ids(v):
        return _snap_by_cells(v, tolerance)
    found, rest = by_maps(v, partial(_snap_together, tolerance), [v.schema["feature_id"], StructField("idx", LongType()), StructField("x", DoubleType()), StructField("y", DoubleType())], ["feature_id"])
    return found if rest is None else found.unionByName(_snap_by_cells(rest, tolerance))


def _snap_together(tolerance: float, c: Columns, maps: np.ndarray) -> Columns:
    net = Net(c, maps)
    line, _, row = net.ends()
    m, x, y = net.maps[row], net.x[row] + 0.0, net.y[row] + 0.0
    k = Clusters(m, x, y, line, tolerance, False)
    lone = np.flatnonzero(k.size < 2)
    at, seg, path = net.segments()
    p, s, t, hx, hy, _ = nearest(m[lone], x[lone], y[lone], line[lone], net.line_map[at], at, seg, path, tolerance)
    tx, ty = np.where(k.size < 2, x, k.cx), np.where(k.size < 2, y, k.cy)
    tx[lone[p]], ty[lone[p]] = hx, hy
    moved = (tx != x) | (ty != y)
    new = np.flatnonzero(_inside(t))
    new = new[np.lexsort((t[new], hy[new], hx[new], s[new]))]
    first = np.ones(len(new), bool)
    first[1:] = (s[new][1:] != s[new][:-1]) | (hx[new][1:] != hx[new][:-1]) | (hy[new][1:] != hy[new][:-1])
    new = new[first]
    changed = np.zeros(len(net.first), bool)
    changed[line[moved]] = changed[at[s[new]]] = True
    px, py = net.x.copy(), net.y.copy()
    px[row[moved]], py[row[moved]] = tx[moved], ty[moved]
    base = np.flatnonzero(changed[net.of])
    of = np.concatenate([net.of[base], at[s[new]]])
    order = np.lexsort((np.concatenate([np.zeros(len(base)), t[new]]), np.concatenate([net.idx[base], seg[s[new]]]), of))
    of = of[order]
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    idx = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
    return {"map": net.line_map[of], "feature_id": net.ids[of], "idx": idx, "x": np.concatenate([px[base], hx[new]])[order], "y": np.concatenate([py[base], hy[new]])[order]}


def _snap_by_cells(v: DataFrame, tolerance: float) -> DataFrame:
    """Inserted rows carry (segment, t) and one running count renumbers the line."""
    c = F.col
    v = cut(v)
    clusters = cut(_clusters_by_cells(trail_ends(v), tolerance, False))
    hits = cut(_nearest_by_cells(clusters.where("size < 2"), segments(v), tolerance))
    targets = clusters.where("size >= 2").select(*KEYS, "side", "x", "y", c("cluster_x").alias("tx"), c("cluster_y").alias("ty")).unionByName(
        hits.select(*KEYS, "side", "x", "y", c("hx").alias("tx"), c("hy").alias("ty"))
    )
    inserted = hits.where(INSIDE).groupBy("map_id", c("on_feature_id").alias("feature_id"), "seg", c("hx").alias("x"), c("hy").alias("y")).agg(F.min("t").alias("t"))
    moved = targets.where("x <> tx or y <> ty")
    changed = moved.select(*KEYS).unionByName(inserted.select(*KEYS)).distinct()
    top = v.groupBy(*KEYS).agg(F.max("idx").alias("_top"))
    side = F.when(c("idx") == 0, 0).when(c("idx") == c("_top"), 1)
    base = v.join(changed, KEYS, "left_semi").join(top, KEYS).withColumn("side", side)
    base = base.join(moved.select(*KEYS, "side", "tx", "ty"), [*KEYS, "side"], "left")
    base = base.select(*KEYS, c("idx").cast("double").alias("_at"), F.coalesce("tx", "x").alias("x"), F.coalesce("ty", "y").alias("y"))
    added = inserted.select(*KEYS, (c("seg") + c("t")).alias("_at"), "x", "y")
    return renumber(base.unionByName(added), KEYS, "_at")


def keep_valid_routes(features: DataFrame, edited: DataFrame) -> DataFrame:
    """Features of edited lines, their route cleared where the new geometry no longer fits it."""
    c = F.col
    facts = ring_facts(edited)
    joined = features.join(facts, KEYS).withColumn("_bad", route_reason(c("route_kind"), c("route_direction")).isNotNull())
    keep = lambda n: F.when(~c("_bad"), c(n)).alias(n)
    return joined.select(*[keep(n) if n in ("route_kind", "route_direction") else c(n) for n in features.columns])


def count_snapped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per map: how many ends of edited trails moved. Lines meet with both ends in one row."""
    c = F.col
    ends = ("ax", "ay", "zx", "zy")
    old = _end_pairs(before).withColumnsRenamed({k: f"o{k}" for k in ends})
    both = _end_pairs(after).join(old, KEYS)
    moved = lambda p: F.count_if((c(f"{p}x") != c(f"o{p}x")) | (c(f"{p}y") != c(f"o{p}y")))
    return both.groupBy("map_id").agg((moved("a") + moved("z")).alias("snapped"))


def apply_edit(features: DataFrame, v: DataFrame, updated: DataFrame, updated_v: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop removed lines, replace updated ones, and put new ones right after ``after_id``.

    ``updated`` has the feature columns plus ``after_id`` (null for a replacement). Order is kept in
    (seq, sub_seq).
    """
    c = F.col
    f = features if "sub_seq" in features.columns else features.withColumn("sub_seq", F.lit(0).cast("bigint"))
    old_seq = f.select("map_id", c("feature_id").alias("_fid"), c("seq").alias("_seq"), c("sub_seq").alias("_sub"))
    place = updated.withColumn("_fid", F.coalesce("after_id", "feature_id")).drop("seq", *(["sub_seq"] if "sub_seq" in updated.columns else []))
    place = place.join(old_seq, ["map_id", "_fid"]).withColumn("seq", c("_seq")).withColumn(
        "sub_seq", c("_sub") + F.when(c("after_id").isNotNull(), 1).otherwise(0)
    )
    gone = removed.select(*KEYS).unionByName(updated.select(*KEYS)).distinct()
    out_f = f.join(gone, KEYS, "left_anti").unionByName(place.select(*f.columns))
    out_v = v.join(gone, KEYS, "left_anti").unionByName(updated_v.select(*v.columns))
    return out_f, out_v


def split_trails(v: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cut lines at an interior vertex ``at``; the second part takes ``new_id``. Bad cuts do nothing."""
    c = F.col
    top = v.groupBy(*KEYS).agg(F.max("idx").alias("_top"))
    good = cuts.join(top, KEYS).where("at > 0 and at < _top").select(*KEYS, "at", "new_id")
    rows = v.join(good, KEYS)
    first = rows.where("idx <= at").drop("at", "new_id")
    second = rows.where("idx >= at").withColumn("feature_id", c("new_id")).withColumn("idx", c("idx") - c("at")).drop("at", "new_id")
    return first.unionByName(second)


def split_features(features: DataFrame, cuts: DataFrame) -> DataFrame:
    """Attributes of the new second parts: name gets " (2)", route is cleared."""
    c = F.col
    rows = features.join(cuts, KEYS).withColumn("after_id", c("feature_id"))
    return rows.select(*[
        c("new_id").alias("feature_id") if n == "feature_id"
        else F.concat(c("name"), F.lit(" (2)")).alias("name") if n == "name"
        else F.lit(None).cast("string").alias(n) if n in ("route_kind", "route_direction")
        else c(n)
        for n in features.columns
    ], "after_id")


def join_pairs(v: DataFrame, pairs: DataFrame) -> DataFrame:
    """Join trail ``b_id`` onto ``a_id`` by the closest of four end pairings, first one on ties."""
    c = F.col
    at = F.struct("x", "y")
    ends = v.groupBy(*KEYS).agg(F.max("idx").alias("top"), F.min_by(at, "idx").alias("s"), F.max_by(at, "idx").alias("e"))
    a = ends.select("map_id", *[c(n).alias(f"a_{n}") for n in ("top", "s", "e")], c("feature_id").alias("a_id"))
    b = ends.select("map_id", *[c(n).alias(f"b_{n}") for n in ("top", "s", "e")], c("feature_id").alias("b_id"))
    rows = pairs.where("a_id <> b_id").join(a, ["map_id", "a_id"]).join(b, ["map_id", "b_id"])
    gap = lambda p, q: distance2(c(p)["x"], c(p)["y"], c(q)["x"], c(q)["y"])
    option = F.least(*[
        F.struct(gap(p, q).alias("d2"), F.lit(k).alias("k")) for k, (p, q) in enumerate([("a_e", "b_s"), ("a_e", "b_e"), ("a_s", "b_s"), ("a_s", "b_e")])
    ])
    rows = rows.withColumn("_o", option).withColumn("_skip", F.when(c("_o.d2") <= 0.25, 1).otherwise(0))
    rows = rows.select("map_id", "a_id", "b_id", "a_top", "b_top", (c("_o.k") >= 2).alias("_ra"), (c("_o.k") % 2 == 1).alias("_rb"), "_skip")
    left = v.join(rows.withColumnRenamed("a_id", "feature_id"), KEYS).withColumn(
        "idx", F.when(c("_ra"), c("a_top") - c("idx")).otherwise(c("idx"))
    )
    right = v.withColumnRenamed("feature_id", "b_id").join(rows, ["map_id", "b_id"])
    right = right.withColumn("_i", F.when(c("_rb"), c("b_top") - c("idx")).otherwise(c("idx"))).where("_i >= _skip")
    right = right.withColumn("idx", c("a_top") + 1 + c("_i") - c("_skip")).withColumn("feature_id", c("a_id"))
    cols = v.columns
    return left.select(*cols).unionByName(right.select(*cols))


def connect(v: DataFrame, links: DataFrame) -> DataFrame:
    """Insert junction vertices at both ends of each link and add the connector line.

    ``links`` has new_id and, for sides a and b, id, seg, x, y. Returns the vertices of changed
    trails and of the connectors. A spot that is already a vertex of the line is not added again.
    """
    c = F.col
    side = lambda s: links.select("map_id", c(f"{s}_id").alias("feature_id"), c(f"{s}_seg").alias("seg"), c(f"{s}_x").alias("x"), c(f"{s}_y").alias("y"))
    segs = segments(v.select(*KEYS, "idx", "x", "y"))
    spots = side("a").unionByName(side("b")).distinct().join(segs, [*KEYS, "seg"])
    spots = spots.where("not (x = x1 and y = y1) and not (x = x2 and y = y2)")
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    len2 = dx * dx + dy * dy
    t = ((c("x") - c("x1")) * dx + (c("y") - c("y1")) * dy) / F.when(len2 == 0, 1.0).otherwise(len2)
    # Order inside a segment follows t; the spot always stays between its two vertices.
    slot = c("seg") + F.least(F.greatest(t, F.lit(1e-9)), F.lit(1 - 1e-9))
    added = spots.select(*KEYS, slot.alias("_at"), "x", "y")
    earlier = v.select(*KEYS, "x", "y").distinct()
    added = added.join(earlier, [*KEYS, "x", "y"], "left_anti")
    base = v.join(added.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, c("idx").cast("double").alias("_at"), "x", "y")
    lines = renumber(base.unionByName(added.select(*base.columns)), KEYS, "_at")
    bridge = links.select("map_id", c("new_id").alias("feature_id"), F.posexplode(F.array(
        F.struct(c("a_x").alias("x"), c("a_y").alias("y")), F.struct(c("b_x").alias("x"), c("b_y").alias("y"))
    )).alias("idx", "p"))
    bridge = bridge.select(*KEYS, c("idx").cast("bigint").alias("idx"), c("p.x").alias("x"), c("p.y").alias("y"))
    return lines.select(*KEYS, "idx", "x", "y").unionByName(bridge)


def split_candidates(v: DataFrame, at: DataFrame, tolerance: float) -> DataFrame:
    """Split each line near the point (px, py): at an interior vertex within tolerance, else at the
    nearest spot of its nearest segment. Splits at an end are refused. New parts take ``new_id``."""
    c = F.col
    top = v.groupBy(*KEYS).agg(F.max("idx").alias("_top"))
    rows = v.join(at, KEYS).join(top, KEYS)
    d2 = distance2(c("x"), c("y"), c("px"), c("py"))
    near = rows.where((c("idx") > 0) & (c("idx") < c("_top")) & (d2 <= tolerance * tolerance))
    # The last of equally near vertices is taken.
    vertex = near.groupBy(*KEYS).agg(F.min(F.struct(d2.alias("d2"), (-c("idx")).alias("i"))).alias("b")).select(*KEYS, (-c("b.i")).alias("at"))
    rest = at.join(vertex, KEYS, "left_anti")
    spot = project_points(rest.select(*KEYS, c("px").alias("x"), c("py").alias("y")), v, [])
    spot = spot.join(top, KEYS).where("not (seg = 0 and t = 0) and not (seg = _top - 1 and t = 1)")
    spot = spot.select(*KEYS, "seg", c("x").alias("sx"), c("y").alias("sy")).join(at.select(*KEYS, "new_id"), KEYS)
    by_vertex = split_trails(v, vertex.join(at.select(*KEYS, "new_id"), KEYS))
    cols = v.columns
    body = v.join(spot, KEYS)
    left = body.where("idx <= seg").select(*cols)
    right = body.where("idx > seg").withColumn("feature_id", c("new_id")).withColumn("idx", c("idx") - c("seg")).select(*cols)
    cut_row = lambda fid, idx: spot.select("map_id", fid.alias("feature_id"), idx.alias("idx"), c("sx").alias("x"), c("sy").alias("y"))
    ends = cut_row(c("feature_id"), c("seg") + 1).unionByName(cut_row(c("new_id"), F.lit(0).cast("bigint")))
    return by_vertex.select(*KEYS, "idx", "x", "y").unionByName(left.unionByName(right).select(*KEYS, "idx", "x", "y")).unionByName(ends)


def interior_branches(centers: DataFrame, v: DataFrame, tolerance: float) -> DataFrame:
    """Centers (map_id, center_id, x, y) that some line passes within tolerance of, more than the
    tolerance away from both of its own ends."""
    c = F.col
    segs = cut(measured_segments(v))

    def near(met: DataFrame) -> DataFrame:
        met = met.withColumn("_p", project_on_segment(c("px"), c("py"), c("x1"), c("y1"), c("x2"), c("y2")))
        met = met.withColumn("_along", c("d1") + c("_p.t") * (c("d2") - c("d1")))
        return met.where((c("_p.d2") <= tolerance * tolerance) & (c("_along") > tolerance)).select(*KEYS, "center_id", "_along")

    spots = cut(centers.select("map_id", "center_id", c("x").alias("px"), c("y").alias("py")))
    met = met_in_cells(spots, segs, ["map_id"], max(tolerance * 4, 1.0), tolerance, near, "px", "py")
    total = segs.groupBy(*KEYS).agg(F.max("d2").alias("_length"))
    return met.join(total, KEYS).where(c("_length") - c("_along") > tolerance).select("map_id", "center_id").distinct()


def assemble_chains(v: DataFrame, links: DataFrame) -> DataFrame:
    """Order and orient linked lines: (map_id, feature_id, chain_id, pos, entry).

    ``links`` joins ports (a_id, a_side) and (b_id, b_side), each port at most once. A chain starts
    at its free port of least (id, side); a ring is opened at side 0 of its least line. Positions
    come from pointer doubling. Lines without links are not listed.
    """
    c = F.col
    node = lambda i: F.struct("map_id", c(i).alias("feature_id"))
    links = cut(links.select("map_id", "a_id", "a_side", "b_id", "b_side"))
    groups = cut(connected_components(links.select(node("a_id").alias("a"), node("b_id").alias("b"))))
    member = groups.select(c("id.map_id").alias("map_id"), c("id.feature_id").alias("a_id"), c("root.feature_id").alias("chain_id"))
    tagged = links.join(member, ["map_id", "a_id"])
    sizes = member.groupBy("map_id", "chain_id").agg(F.count("*").alias("_members"))
    edges = tagged.groupBy("map_id", "chain_id").agg(F.count("*").alias("_links"))
    rings = sizes.join(edges, ["map_id", "chain_id"]).where("_links >= _members").select("map_id", "chain_id", F.lit(True).alias("_ring"))
    tagged = tagged.join(rings, ["map_id", "chain_id"], "left")
    opens = ((c("a_id") == c("chain_id")) & (c("a_side") == 0)) | ((c("b_id") == c("chain_id")) & (c("b_side") == 0))
    tagged = tagged.where(F.coalesce(~(c("_ring") & opens), F.lit(True)))
    step = lambda p, q: tagged.select(
        F.struct("map_id", c(f"{p}_id").alias("feature_id"), (1 - c(f"{p}_side")).alias("entry")).alias("id"),
        F.struct("map_id", c(f"{q}_id").alias("feature_id"), c(f"{q}_side").alias("entry")).alias("nxt"),
    )
    steps = step("a", "b").unionByName(step("b", "a"))
    states = member.select(
        F.explode(F.array(*[F.struct("map_id", c("a_id").alias("feature_id"), F.lit(e).alias("entry")) for e in (0, 1)])).alias("id")
    )
    ranked = list_rank(states.join(steps, "id", "left"))
    lists = ranked.groupBy("tail").agg(F.max_by("id", "rank").alias("_head"), F.max("rank").alias("_len"))
    rows = ranked.join(lists, "tail").join(
        member.select("map_id", c("a_id").alias("_f"), "chain_id"), (c("id.map_id") == c("map_id")) & (c("id.feature_id") == c("_f"))
    )
    first = rows.groupBy("map_id", "chain_id").agg(F.min("_head").alias("_first"))
    rows = rows.join(first, ["map_id", "chain_id"]).where("_head = _first")
    return rows.select("map_id", c("id.feature_id").alias("feature_id"), "chain_id", (c("_len") - c("rank")).alias("pos"), c("id.entry").alias("entry"))


def chain_vertices(v: DataFrame, chains: DataFrame, drop_first: bool = True) -> DataFrame:
    """Vertices of assembled chains; each part after the first drops its shared first point."""
    c = F.col
    top = v.groupBy(*KEYS).agg(F.max("idx").alias("_top"))
    parts = chains.join(top, KEYS).withColumn("_skip", F.when((c("pos") > 0) & F.lit(drop_first), 1).otherwise(0))
    parts = running(parts, ["map_id", "chain_id"], c("_top") + 1 - c("_skip"), "_from", idx="pos", inclusive=False)
    rows = v.join(parts, KEYS).withColumn("_i", F.when(c("entry") == 1, c("_top") - c("idx")).otherwise(c("idx")))
    rows = rows.where("_i >= _skip")
    return rows.select("map_id", c("chain_id").alias("feature_id"), (c("_from") + c("_i") - c("_skip")).cast("bigint").alias("idx"), "x", "y")


def _compact(ends: DataFrame, tolerance: float) -> DataFrame:
    """Clusters whose every two ends are within tolerance.

    Boxes decide most clusters; for the rest only spots that are lowest or highest at their x, which
    hold the farthest pair, are compared.
    """
    c = F.col
    box = ends.groupBy("map_id", "cluster").agg(
        F.max("x").alias("_x2"), F.min("x").alias("_x1"), F.max("y").alias("_y2"), F.min("y").alias("_y1")
    )
    w, h = c("_x2") - c("_x1"), c("_y2") - c("_y1")
    sure = w * w + h * h <= tolerance * tolerance
    maybe = box.where(~sure & (w <= tolerance) & (h <= tolerance)).select("map_id", "cluster")
    rim = ends.join(maybe, ["map_id", "cluster"], "left_semi").groupBy("map_id", "cluster", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    rim = rim.select("map_id", "cluster", "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    other = rim.select("map_id", "cluster", c("x").alias("ox"), c("y").alias("oy"))
    wide = rim.join(other, ["map_id", "cluster"]).where(distance2(c("x"), c("y"), c("ox"), c("oy")) > tolerance * tolerance).select("map_id", "cluster").distinct()
    return box.where(sure).select("map_id", "cluster").unionByName(maybe.join(wide, ["map_id", "cluster"], "left_anti"))


def auto_join(v: DataFrame, selected: DataFrame, tolerance: float) -> dict[str, DataFrame]:
    """Join selected lines end to end where exactly two of them meet and nothing else passes.

    Returns ``vertices`` of changed lines, ``removed`` ids, per-map ``counts`` of chains and
    ambiguous junctions, and ``ambiguous`` ids. A map is joined whole in one task; one that is too
    large for it goes through cells.
    """
    c = F.col
    v = v.select(*KEYS, "idx", "x", "y")
    picked = selected.select(*KEYS)
    if not numbered_ids(v, picked) or not 0 < tolerance < math.inf:
        return _join_by_cells(v, picked, tolerance)
    # Selected lines come along as rows without a place, so that they need no shuffle of their own.
    marks = picked.distinct().select(*KEYS, *[F.lit(None).cast(v.schema[k].dataType).alias(k) for k in ("idx", "x", "y")], F.lit(True).alias("_sel"))
    fields = [StructField("kind", IntegerType()), v.schema["feature_id"], StructField("idx", LongType()), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("n", LongType())]
    found, rest = by_maps(v.withColumn("_sel", F.lit(False)).unionByName(marks), partial(_join_together, tolerance), fields, ["feature_id"])
    of = lambda k: found.where(c("kind") == k)
    out = {
        "vertices": of(0).select(*KEYS, "idx", "x", "y"), "removed": of(1).select(*KEYS),
        "counts": of(2).select("map_id", c("idx").alias("chains"), c("n").alias("ambiguous_junctions")), "ambiguous": of(3).select(*KEYS),
    }
    if rest is None:
        return out
    more = _join_by_cells(rest.where("not _sel").drop("_sel"), rest.where("_sel").select(*KEYS), tolerance)
    return {k: df.unionByName(more[k]) for k, df in out.items()}


def _passed(net: Net, maps: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which places some line passes within tolerance, more than the tolerance away from both of its own ends."""
    at, seg, path = net.segments()
    dist = net.lengths()
    d1 = dist[net.first[at] + seg]
    step, total = dist[net.first[at] + seg + 1] - d1, dist[net.first[at] + net.top[at]]
    out = np.zeros(len(x), bool)
    for s, p in met_by_segments(Places(maps, x, y, max(tolerance * 4, 1.0)), net.line_map[at], path, tolerance):
        t, _, _, d2 = project(x[p], y[p], *(k[s] for k in path))
        along = d1[s] + t * step[s]
        out[p[(d2 <= tolerance * tolerance) & (along > tolerance) & (total[s] - along > tolerance)]] = True
    return out


def _tight(group: np.ndarray, n: int, x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which groups have every two of their ends within tolerance: by their boxes, else by their places that are lowest or highest at their x."""
    box = [np.full(n, np.inf), np.full(n, np.inf), np.full(n, -np.inf), np.full(n, -np.inf)]
    np.minimum.at(box[0], group, x), np.minimum.at(box[1], group, y), np.maximum.at(box[2], group, x), np.maximum.at(box[3], group, y)
    with np.errstate(invalid="ignore"):
        w, h = box[2] - box[0], box[3] - box[1]
    tight = w * w + h * h <= tolerance * tolerance
    maybe = ~tight & (w <= tolerance) & (h <= tolerance)
    order = np.lexsort((y, x, group))
    order = order[maybe[group[order]]]
    g, px = group[order], x[order]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = (g[1:] != g[:-1]) | (px[1:] != px[:-1])
    rim = np.unique(order[np.concatenate([np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])])]) if len(order) else order
    rim = rim[np.argsort(group[rim], kind="stable")]
    first = np.flatnonzero(np.diff(group[rim], prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(rim))):
        i = rim[a:b]
        tight[group[i[0]]] = all(((x[k] - x[i]) ** 2 + (y[k] - y[i]) ** 2 <= tolerance * tolerance).all() for k in i)
    return tight


def _chains(n: int, a: np.ndarray, a_side: np.ndarray, b: np.ndarray, b_side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``assemble_chains`` of lines 0 to ``n - 1``, numbered in order of their ids: (line, chain's least line, pos, entry)."""
    chain = components(n, a, b)
    members = np.unique(np.concatenate([a, b]))
    ring = np.bincount(chain[a], minlength=n) >= np.maximum(np.bincount(chain[members], minlength=n), 1)
    opens = ((a == chain[a]) & (a_side == 0)) | ((b == chain[a]) & (b_side == 0))
    keep = ~(ring[chain[a]] & opens)
    a, a_side, b, b_side = a[keep], a_side[keep], b[keep], b_side[keep]
    # A state is a line and the side at which it is entered; it is left at the other.
    nxt = np.full(2 * n, -1)
    nxt[2 * a + 1 - a_side], nxt[2 * b + 1 - b_side] = 2 * b + b_side, 2 * a + a_side
    rank, tail = (nxt >= 0).astype(np.int64), np.where(nxt >= 0, nxt, np.arange(2 * n))
    while (nxt >= 0).any():
        on = np.flatnonzero(nxt >= 0)
        ahead = nxt[on]
        rank[on] += rank[ahead]
        tail[on], nxt[on] = tail[ahead], nxt[ahead]
    state = np.repeat(2 * members, 2) + np.tile(np.array([0, 1]), len(members))
    head, length = np.full(2 * n, -1), np.zeros(2 * n, np.int64)
    order = state[np.argsort(rank[state], kind="stable")]
    head[tail[order]], length[tail[order]] = order, rank[order]  # the last one, of the highest rank, stays
    first = np.full(n, 2 * n)
    np.minimum.at(first, chain[state // 2], head[tail[state]])
    state = state[head[tail[state]] == first[chain[state // 2]]]
    return state // 2, chain[state // 2], length[tail[state]] - rank[state], state % 2


def _join_together(tolerance: float, c: Columns, maps: np.ndarray) -> Columns:
    """``auto_join`` of whole maps; kind 0 are vertices, 1 removed lines, 2 counts (idx chains, n junctions), 3 ambiguous lines."""
    real = ~c["_sel"]
    net = Net({k: c[k][real] for k in ("feature_id", "idx", "x", "y")}, maps[real])
    n, n_maps = len(net.first), int(maps.max()) + 1
    # Numbers of the selected lines among the net's.
    ids, code = np.unique(np.concatenate([net.ids, c["feature_id"][~real]]), return_inverse=True)
    of_line, of_mark = net.line_map * len(ids) + code[:n], maps[~real] * len(ids) + code[n:]
    picked = np.isin(of_line, of_mark)
    line, side, row = net.ends()
    m, x, y = net.maps[row], net.x[row] + 0.0, net.y[row] + 0.0
    _, group = np.unique(Clusters(m, x, y, line, tolerance, True).root, return_inverse=True)
    g = int(group.max()) + 1 if len(group) else 0
    # Ends are in order of (line, side), so a group's first and last are its least and greatest ports.
    last, first = np.zeros(g, np.int64), np.zeros(g, np.int64)
    last[group], first[group[::-1]] = np.arange(len(group)), np.arange(len(group))[::-1]
    size = np.bincount(group, minlength=g)
    some = np.bincount(group, picked[line], g)
    mean = lambda v: np.bincount(group, v, g) / np.maximum(size, 1)
    gx, gy = np.where(size > 2, x[first], mean(x)), np.where(size > 2, y[first], mean(y))
    live = (size >= 2) & (some > 0)
    tight, branch = _tight(group, g, x, y, tolerance), np.zeros(g, bool)
    at = np.flatnonzero(live)
    branch[at] = _passed(net, m[first[at]], gx[at], gy[at], tolerance)
    unclear = live & ((size > 2) | branch | ~tight)
    usable = live & tight & (some == size) & ~branch
    pair = (size == 2) & (line[first] != line[last])
    goes = (usable & (pair | (size > 2)))[group]
    px, py = net.x.copy(), net.y.copy()
    px[row[goes]], py[row[goes]] = gx[group[goes]], gy[group[goes]]
    apart = np.zeros(n, bool)
    np.logical_or.at(apart, line[goes], (px[row[goes]] != x[goes]) | (py[row[goes]] != y[goes]))
    k = np.flatnonzero(usable & pair)
    part, chain, pos, entry = _chains(n, line[first[k]], side[first[k]], line[last[k]], side[last[k]])
    order = np.lexsort((pos, chain))
    part, chain, pos, entry = part[order], chain[order], pos[order], entry[order]
    skip = (pos > 0).astype(np.int64)
    count = net.size[part] - skip
    begin = np.cumsum(count) - count
    head = begin[np.flatnonzero(pos == 0)][np.cumsum(pos == 0) - 1] if len(pos) else begin
    of = np.repeat(np.arange(len(part)), count)
    step = np.arange(len(of)) - begin[of] + skip[of]
    source = net.first[part[of]] + np.where(entry[of] == 1, net.top[part[of]] - step, step)
    in_chain = np.zeros(n, bool)
    in_chain[part] = True
    alone = np.flatnonzero((picked & apart & ~in_chain)[net.of])
    gone = np.flatnonzero(part != chain)
    chains, junctions = np.bincount(net.line_map[part[pos == 0]], minlength=n_maps), np.bincount(m[first[unclear]], minlength=n_maps)
    counted = np.flatnonzero(chains + junctions)
    odd = np.unique(line[unclear[group] & picked[line]])
    pieces = [
        (0, net.line_map[chain[of]], net.ids[chain[of]], np.arange(len(of)) - head[of], px[source], py[source], None),
        (0, net.maps[alone], net.line_id[alone], net.idx[alone], px[alone], py[alone], None),
        (1, net.line_map[part[gone]], net.ids[part[gone]], None, None, None, None),
        (2, counted, None, chains[counted], None, None, junctions[counted]),
        (3, net.line_map[odd], net.ids[odd], None, None, None, None),
    ]
    column = lambda k, kind: np.concatenate([np.zeros(len(p[1]), kind) if p[k] is None else p[k].astype(kind) for p in pieces])
    return {
        "kind": np.concatenate([np.full(len(p[1]), p[0]) for p in pieces]), "map": column(1, int), "feature_id": column(2, int), "idx": column(3, int),
        "x": column(4, float), "y": column(5, float), "n": column(6, int),
    }


def _join_by_cells(v: DataFrame, selected: DataFrame, tolerance: float) -> dict[str, DataFrame]:
    c = F.col
    picked = selected.select(*KEYS).distinct().withColumn("_sel", F.lit(True))
    ends = cut(_clusters_by_cells(trail_ends(v), tolerance, True).join(picked, KEYS, "left").fillna(False, ["_sel"]))
    port = F.struct("feature_id", "side")
    groups = ends.groupBy("map_id", "cluster").agg(
        F.count("*").alias("n"), F.max("_sel").alias("any"), F.min("_sel").alias("all"), F.min(port).alias("p1"), F.max(port).alias("p2"),
        F.min_by(F.struct("x", "y"), port).alias("first"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
    ).where("n >= 2 and any")
    groups = groups.withColumn("x", F.when(c("n") > 2, c("first.x")).otherwise(c("mx"))).withColumn("y", F.when(c("n") > 2, c("first.y")).otherwise(c("my")))
    groups = cut(groups)
    compact = _compact(ends.join(groups, ["map_id", "cluster"], "left_semi"), tolerance).withColumn("compact", F.lit(True))
    branch = interior_branches(groups.select("map_id", c("cluster").alias("center_id"), "x", "y"), v, tolerance)
    branch = branch.select("map_id", c("center_id").alias("cluster"), F.lit(True).alias("branch"))
    judged = groups.join(compact, ["map_id", "cluster"], "left").join(branch, ["map_id", "cluster"], "left").fillna(False, ["compact", "branch"])
    judged = cut(judged.withColumn("unclear", (c("n") > 2) | c("branch") | ~c("compact")))
    usable = judged.where("compact and all and not branch")
    pair = (c("n") == 2) & (c("p1.feature_id") != c("p2.feature_id"))
    moves = ends.join(usable.where(pair | (c("n") > 2)).select("map_id", "cluster", c("x").alias("tx"), c("y").alias("ty")), ["map_id", "cluster"])
    moves = moves.select(*KEYS, "side", "tx", "ty")
    links = usable.where(pair).select(
        "map_id", c("p1.feature_id").alias("a_id"), c("p1.side").alias("a_side"), c("p2.feature_id").alias("b_id"), c("p2.side").alias("b_side")
    )
    top = v.groupBy(*KEYS).agg(F.max("idx").alias("_top"))
    rows = v.join(top, KEYS).withColumn("side", F.when(c("idx") == 0, 0).when(c("idx") == c("_top"), 1))
    rows = rows.join(moves, [*KEYS, "side"], "left")
    apart = F.coalesce((c("tx") != c("x")) | (c("ty") != c("y")), F.lit(False))
    rows = rows.withColumn("_moved", apart).withColumn("x", F.coalesce("tx", "x")).withColumn("y", F.coalesce("ty", "y"))
    rows = cut(rows.select(*KEYS, "idx", "x", "y", "_moved"))
    chains = cut(assemble_chains(rows, links))
    joined = chain_vertices(rows.select(*KEYS, "idx", "x", "y"), chains)
    alone = rows.join(chains, KEYS, "left_anti").join(picked.select(*KEYS), KEYS, "left_semi")
    touched = alone.where("_moved").select(*KEYS).distinct()
    vertices = joined.unionByName(alone.join(touched, KEYS, "left_semi").select(*KEYS, "idx", "x", "y"))
    unclear = judged.where("unclear")
    ambiguous = ends.where("_sel").join(unclear.select("map_id", "cluster"), ["map_id", "cluster"], "left_semi").select(*KEYS).distinct()
    counts = chains.groupBy("map_id").agg(F.count_if(c("pos") == 0).alias("chains")).join(
        unclear.groupBy("map_id").agg(F.count("*").alias("ambiguous_junctions")), "map_id", "full"
    ).fillna(0)
    return {
        "vertices": vertices, "removed": chains.where("feature_id <> chain_id").select(*KEYS), "counts": counts, "ambiguous": ambiguous,
    }
