"""From colour masks to candidate lines: thinning, skeleton graph, bridging, pruning, chaining."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField

from cairnfield.functions.plane import distance2
from cairnfield.operators import pixels as P
from cairnfield.operators.graph import connected_components, greedy_match
from cairnfield.operators.grid import point_cells, point_cells_around
from cairnfield.operators.lines import pixel_length, segments
from cairnfield.operators.ordered import number_rows
from cairnfield.operators.pixels import MASK, neighbours8
from cairnfield.operators.simplify import keep_vertices, renumber
from cairnfield.operators.together import Columns, Net, Refused, by_maps, numbered_ids, parts_of, refuse_more, spread
from cairnfield.operators.topology import assemble_chains, chain_vertices
from cairnfield.session import cut, sends_little

BLOCK, HALO = 256, 32
ROUNDS = HALO // 2


def _ring(m: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of every cell, clockwise from north."""
    p = np.pad(m, 1)
    h, w = m.shape
    at = lambda dy, dx: p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w]
    return [at(-1, 0), at(-1, 1), at(0, 1), at(1, 1), at(1, 0), at(1, -1), at(0, -1), at(-1, -1)]


def _thin_once(m: np.ndarray) -> bool:
    """One round of two simultaneous deletion steps, in place; True when a cell was deleted."""
    changed = False
    for step in (0, 1):
        n = _ring(m)
        count = sum(k.astype(np.int8) for k in n)
        turns = sum(((~a) & b).astype(np.int8) for a, b in zip(n, n[1:] + n[:1]))
        north, east, south, west = n[0], n[2], n[4], n[6]
        blocked = (north & east & south) | (east & south & west) if step == 0 else (north & east & west) | (north & south & west)
        gone = m & (count >= 2) & (count <= 6) & (turns == 1) & ~blocked
        if gone.any():
            m &= ~gone
            changed = True
    return changed


def _settle_corners(m: np.ndarray, open_: np.ndarray, own: slice) -> None:
    """Remove staircase corners as a scan by rows would, in place, as far as the known cells allow.

    ``m`` has the cells that are there and ``open_`` those of them that are not decided yet. A cell is
    kept at once where no outcome of its earlier neighbours (west and the row above) makes it a corner,
    and judged once they all are decided. Its later neighbours wait for it, so they are still there. All
    ready cells are judged together; cells outside ``own`` are looked at only.
    """
    side = m.shape[1] + 2
    there, waits = np.pad(m, 1).ravel(), np.pad(open_, 1).ravel()
    inner = np.zeros_like(m)
    inner[own, own] = True
    todo = np.flatnonzero(np.pad(inner & open_, 1).ravel())
    while len(todo):
        look = lambda step: (there[todo + step], waits[todo + step])
        (n, un), (w, uw), (ne, une), (nw, unw) = look(-side), look(-1), look(1 - side), look(-1 - side)
        e, s, sw, se = there[todo + 1], there[todo + side], there[todo + side - 1], there[todo + side + 1]
        no_n, no_w = ~n | un, ~w | uw
        corner = (n & e & ~s & no_w & ~sw) | (e & s & no_n & no_w & (~nw | unw)) | (s & w & no_n & ~e & (~ne | une)) | (w & n & ~e & ~s & ~se)
        ready = ~(un | uw | une | unw)
        there[todo[corner & ready]] = False
        settled = ready | ~corner
        if not settled.any():
            break
        waits[todo[settled]] = False
        todo = todo[~settled]
    m[:], open_[:] = there.reshape(-1, side)[1:-1, 1:-1], (there & waits).reshape(-1, side)[1:-1, 1:-1]


def _drop_corners(cells: DataFrame) -> DataFrame:
    """Cells without staircase corners, the same for every size of block.

    A round settles every block as far as its neighbours' decided cells reach; only blocks with undecided cells
    go into the next round, with one ring of cells around them. A chain of corners costs a round a border
    that it crosses.
    """
    c, size = F.col, BLOCK
    home = {"_bx": F.floor(c("x") / size), "_by": F.floor(c("y") / size)}
    at = [*MASK, "_bx", "_by"]
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in MASK) + ", x int, y int, open boolean, own boolean"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        left, top = int(pdf["_bx"].iloc[0]) * size - 1, int(pdf["_by"].iloc[0]) * size - 1
        m, open_ = np.zeros((size + 2, size + 2), bool), np.zeros((size + 2, size + 2), bool)
        y, x = pdf["y"].to_numpy() - top, pdf["x"].to_numpy() - left
        m[y, x], open_[y, x] = True, pdf["open"].to_numpy(dtype=bool)
        _settle_corners(m, open_, slice(1, -1))
        y, x = np.nonzero(m[1:-1, 1:-1])
        out = {k: pdf[k].iloc[0] for k in MASK}
        out.update(x=(x + left + 1).astype("int32"), y=(y + top + 1).astype("int32"), open=open_[y + 1, x + 1], own=True)
        return pd.DataFrame(out, index=range(len(x)))

    around = lambda v: F.array_distinct(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.floor((c(v) + k) / size)))
    spread = lambda df: df.withColumn("_bx", F.explode(around("x"))).withColumn("_by", F.explode(around("y")))
    state = cut(cells.select(*MASK, "x", "y").withColumns({"open": F.lit(True), "own": F.lit(True)}))
    done = None
    while True:
        left = state.where("own and open").withColumns(home).select(*at).distinct()
        closed = state.withColumns(home).join(left, at, "left_anti").drop("_bx", "_by")
        part = closed.where("own").select(*MASK, "x", "y")
        done = part if done is None else done.unionByName(part)
        if state.where("own and open").isEmpty():
            return done
        ring = spread(closed).join(left, at, "left_semi").drop("_bx", "_by").distinct().withColumn("own", F.lit(False))
        moved = spread(state).join(left, at, "left_semi").groupBy(*at).applyInPandas(settle, schema)
        state = cut(moved.unionByName(ring))


def _in_blocks(mask: DataFrame, work, extra: str) -> DataFrame:
    """Run ``work`` on square blocks with a halo; only a block's own cells come back.

    A cell depends on cells at most one step away per deletion step, so a halo of ``HALO`` cells
    makes ``HALO`` steps exact. Blocks bound the group size whatever the raster's size.
    """
    c = F.col
    spread = lambda v: F.sequence(F.floor((c(v) - HALO) / BLOCK), F.floor((c(v) + HALO) / BLOCK))
    rows = mask.withColumn("_bx", F.explode(spread("x"))).withColumn("_by", F.explode(spread("y")))
    kinds = dict(mask.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in MASK) + ", x int, y int" + extra

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(pdf["_bx"].iloc[0]) * BLOCK, int(pdf["_by"].iloc[0]) * BLOCK
        side = BLOCK + 2 * HALO
        m = np.zeros((side, side), bool)
        m[pdf["y"].to_numpy() - by + HALO, pdf["x"].to_numpy() - bx + HALO] = True
        flag = work(m)
        y, x = np.nonzero(m[HALO:-HALO, HALO:-HALO])
        out = {k: pdf[k].iloc[0] for k in MASK}
        out.update(x=(x + bx).astype("int32"), y=(y + by).astype("int32"))
        if extra:
            out["changed"] = bool(flag)
        return pd.DataFrame(out, index=range(len(x)))

    return rows.groupBy(*MASK, "_bx", "_by").applyInPandas(run, schema)


def _many_rounds(m: np.ndarray) -> bool:
    changed = True
    for _ in range(ROUNDS):
        changed = _thin_once(m)
        if not changed:
            break
    return changed


@sends_little
def thin(mask: DataFrame) -> DataFrame:
    """One-cell-wide skeleton. Every pass does sixteen exact rounds per block, until none deletes; corners go last."""
    cells = mask.select(*MASK, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    while True:
        out = cut(_in_blocks(cells, _many_rounds, ", changed boolean"))
        cells = out.drop("changed")
        if out.where("changed").limit(1).isEmpty():
            break
    return _drop_corners(cells)


def _key(map_cols: list[str] = MASK) -> Column:
    return F.struct(*map_cols)


@sends_little
def skeleton_graph(skeleton: DataFrame, factor: int = 1) -> dict[str, DataFrame]:
    """Nodes, edges and edge points of a skeleton.

    Cells with other than two neighbours form node clusters; runs of two-neighbour cells are
    edges, ordered by pointer doubling; loops without a node get one at their first cell. Places are
    in pixels, a cell being ``factor`` pixels wide. Column ``raster`` is (map_id, chip_id), cells are numbers in row-major order.
    """
    c = F.col
    wide = 1 << 31
    code = lambda x, y: (c(y).cast("bigint") * wide + c(x)).alias("cell")
    cells = cut(skeleton.select(_key().alias("raster"), *MASK, code("x", "y"), "x", "y"))
    pairs = neighbours8(cells).select("raster", c("cell"), (c("ny").cast("bigint") * wide + c("nx")).alias("other"))
    pairs = cut(pairs.join(cells.select("raster", c("cell").alias("other")), ["raster", "other"]))
    degree = pairs.groupBy("raster", "cell").agg(F.count("*").alias("deg"), F.min("other").alias("n0"), F.max("other").alias("n1"))
    rows = cut(cells.join(degree, ["raster", "cell"], "left").fillna(0, ["deg"]))
    is_path = c("deg") == 2
    path = rows.where(is_path).select("raster", "cell", "n0", "n1", "x", "y")
    nodes = rows.where(~is_path)
    kind = rows.select("raster", c("cell").alias("other"), is_path.alias("other_path"))
    sided = pairs.join(kind, ["raster", "other"]).join(rows.select("raster", "cell", "deg", "n0"), ["raster", "cell"])
    same = sided.where("deg <> 2 and not other_path and cell < other")
    ident = lambda n: F.struct("raster", c(n).alias("cell"))
    roots = connected_components(same.select(ident("cell").alias("a"), ident("other").alias("b")))
    node_of = nodes.withColumn("id", ident("cell")).join(roots, "id", "left").select(
        "raster", "cell", F.coalesce("root.cell", "cell").alias("node"), "x", "y"
    )
    node_of = cut(node_of)
    spot = lambda v: (c(v) + 0.5) * factor
    centre = node_of.groupBy("raster", "node").agg(F.avg(spot("x")).alias("x"), F.avg(spot("y")).alias("y"))
    # A cell's port 0 is its lower neighbour, port 1 its higher one.
    port = F.when(c("other") == c("n0"), 0).otherwise(1)
    inner = sided.where("deg = 2").select("raster", "cell", "other", "other_path", port.alias("side"))
    there = inner.where("other_path").select("raster", c("cell").alias("other"), c("other").alias("cell"), c("side").alias("b_side"))
    links = inner.where("other_path and cell < other").join(there, ["raster", "cell", "other"])
    links = links.select(c("raster").alias("map_id"), c("cell").alias("a_id"), c("side").alias("a_side"), c("other").alias("b_id"), "b_side")
    chained = cut(assemble_chains(path, links)).withColumnsRenamed({"map_id": "raster", "feature_id": "cell", "chain_id": "edge"})
    alone = path.join(chained.select("raster", "cell"), ["raster", "cell"], "left_anti").select(
        "raster", "cell", c("cell").alias("edge"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("entry")
    )
    order = chained.select("raster", "cell", "edge", "pos", "entry").unionByName(alone)
    ends = order.groupBy("raster", "edge").agg(F.max("pos").alias("last"))
    order = cut(order.join(ends, ["raster", "edge"]).join(path, ["raster", "cell"]))
    touch = inner.where("not other_path").join(node_of.select("raster", c("cell").alias("other"), "node"), ["raster", "other"]).select("raster", "cell", "side", "node")
    meet = order.join(touch, ["raster", "cell"])
    is_a = (c("pos") == 0) & (c("side") == c("entry"))
    is_b = (c("pos") == c("last")) & (c("side") == 1 - c("entry"))
    tied = meet.groupBy("raster", "edge").agg(F.max(F.when(is_a, c("node"))).alias("a"), F.max(F.when(is_b, c("node"))).alias("b"))
    first = order.where("pos = 0").select("raster", "edge", "last", c("cell").alias("first_cell"), "x", "y")
    edges = first.join(tied, ["raster", "edge"], "left")
    ring = c("a").isNull() & c("b").isNull()
    stub = (c("last") == 0) & (c("a") == c("b"))
    edges = edges.withColumn("ring", ring).withColumn("stub", F.coalesce(stub, F.lit(False)))
    edges = cut(edges.withColumn("a", F.coalesce("a", "first_cell")).withColumn("b", F.when(c("stub") | c("b").isNull(), c("first_cell")).otherwise(c("b"))))
    extra = edges.where("ring or stub").select("raster", c("first_cell").alias("node"), spot("x").alias("x"), spot("y").alias("y"))
    all_nodes = cut(centre.unionByName(extra))
    inside = order.join(edges.select("raster", "edge", "stub"), ["raster", "edge"]).where("not stub")
    inside = inside.select("raster", "edge", (c("pos") + 1).alias("idx"), spot("x").alias("x"), spot("y").alias("y"))
    # A loop starts on its own first cell, which the head repeats.
    rings = edges.where("ring").select("raster", "edge", F.lit(True).alias("_ring"))
    inside = inside.join(rings, ["raster", "edge"], "left").where("_ring is null or idx > 1").drop("_ring")
    cap = lambda end, idx: edges.select("raster", "edge", c(end).alias("node"), idx.cast("bigint").alias("idx")).join(all_nodes, ["raster", "node"]).select("raster", "edge", "idx", "x", "y")
    pts = inside.unionByName(cap("a", F.lit(0))).unionByName(cap("b", c("last") + 2))
    pts = renumber(pts, ["raster", "edge"])
    length = pixel_length(pts, ["raster", "edge"])
    edges = edges.join(length, ["raster", "edge"], "left").fillna(0.0, ["length_px"])
    return {"nodes": all_nodes, "edges": cut(edges.select("raster", "edge", "a", "b", c("length_px").alias("len"))), "points": cut(pts)}


def _edge_dirs(edges: DataFrame, points: DataFrame, nodes: DataFrame, reach: Column) -> DataFrame:
    """Both ends of every edge with the unit vector to its first point ``reach`` away, else (0, 0)."""
    c = F.col
    both = edges.select("raster", "edge", "len", F.posexplode(F.array("a", "b")).alias("end", "node"))
    tips = both.join(nodes, ["raster", "node"]).withColumnsRenamed({"x": "nx", "y": "ny"}).withColumn("reach", reach)
    rows = tips.join(points, ["raster", "edge"], "left")
    far = F.hypot(c("x") - c("nx"), c("y") - c("ny")) >= c("reach")
    at = F.struct("x", "y")
    seen = rows.groupBy("raster", "edge", "end", "node", "len", "nx", "ny", "reach").agg(
        F.when(c("end") == 0, F.min_by(at, F.when(far, c("idx")))).otherwise(F.max_by(at, F.when(far, c("idx")))).alias("t")
    )
    dx, dy = F.coalesce(c("t.x") - c("nx"), F.lit(0.0)), F.coalesce(c("t.y") - c("ny"), F.lit(0.0))
    norm = F.hypot(dx, dy)
    unit = lambda d: F.when(norm > 0, d / F.nullif(norm, F.lit(0.0))).otherwise(0.0)
    return seen.select("raster", "edge", "end", "node", "len", "nx", "ny", "reach", unit(dx).alias("dx"), unit(dy).alias("dy"))


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.select("raster", F.explode(F.array("a", "b")).alias("node")).groupBy("raster", "node").agg(F.count("*").alias("deg"))


def _dot_chain(graph: dict[str, DataFrame], gap: float) -> DataFrame:
    """Edges that string single dots together and tie their strings to line ends.

    Two dots within 2.5 gaps are linked if each is among the other's two nearest, so every dot has
    two links at most and every group of dots is strung, however small. A dot and a line end are
    linked if each is the other's nearest within that reach. Ties go to the lower node number.
    """
    c = F.col
    reach = gap * 2.5
    deg = _degrees(graph["edges"])
    nodes = graph["nodes"].join(deg, ["raster", "node"], "left").fillna(0, ["deg"])
    dots = cut(nodes.where("deg = 0").select("raster", "node", "x", "y"))
    tips = nodes.where("deg = 1").select("raster", c("node").alias("m"), c("x").alias("mx"), c("y").alias("my"))

    def mutual(others: DataFrame, most: int) -> DataFrame:
        met = point_cells_around(dots, reach).join(point_cells(others, reach, "mx", "my"), ["raster", "_cx", "_cy"])
        met = met.withColumn("len", F.hypot(c("x") - c("mx"), c("y") - c("my"))).where((c("len") < reach) & (c("node") != c("m")))
        # As many rows of one dot as other dots lie within reach.
        rank = lambda own, other: F.row_number().over(Window.partitionBy("raster", own).orderBy("len", other))
        best = met.select("raster", "node", "m", "len", rank("node", "m").alias("_r"), rank("m", "node").alias("_q"))
        return best.where((c("_r") <= most) & (c("_q") <= most)).select("raster", c("node").alias("a"), c("m").alias("b"), "len")

    strung = mutual(dots.select("raster", c("node").alias("m"), c("x").alias("mx"), c("y").alias("my")), 2).where("a < b")
    return cut(strung.unionByName(mutual(tips, 1)))


@sends_little
def bridge_links(graph: dict[str, DataFrame], gap: float, reach: Column) -> DataFrame:
    """Gaps to close between line ends that point at each other, each end used once, cheapest first."""
    c = F.col
    deg = _degrees(graph["edges"]).where("deg = 1").select("raster", "node")
    dirs = _edge_dirs(graph["edges"], graph["points"], graph["nodes"], reach).join(deg, ["raster", "node"], "left_semi")
    ends = cut(dirs.select("raster", "edge", "node", "len", "nx", "ny", "reach", (-c("dx")).alias("ox"), (-c("dy")).alias("oy")))
    size = gap * 4
    right = point_cells(ends.select("raster", *[c(n).alias(f"q_{n}") for n in ends.columns if n != "raster"]), size, "q_nx", "q_ny")
    met = point_cells_around(ends, size, "nx", "ny").join(right, ["raster", "_cx", "_cy"]).where("node < q_node")
    met = met.where((c("edge") != c("q_edge")) | (c("len") >= 4 * gap))
    dist = F.hypot(c("q_nx") - c("nx"), c("q_ny") - c("ny"))
    met = met.withColumn("d", dist).where((c("d") <= size) & (c("d") >= 1e-6))
    vx, vy = (c("q_nx") - c("nx")) / c("d"), (c("q_ny") - c("ny")) / c("d")
    met = met.withColumn("c1", c("ox") * vx + c("oy") * vy).withColumn("c2", -(c("q_ox") * vx + c("q_oy") * vy))
    need = lambda n: F.when(c(n) < c("reach"), -0.25).otherwise(0.55)
    met = met.where((c("c1") >= need("len")) & (c("c2") >= need("q_len")))
    links = met.select(
        F.struct("raster", c("node").alias("cell")).alias("a"), F.struct("raster", c("q_node").alias("cell")).alias("b"), (c("d") * (3 - c("c1") - c("c2"))).alias("cost"), c("d").alias("len")
    )
    best = greedy_match(links, ["cost"])
    return best.select(c("a.raster").alias("raster"), c("a.cell").alias("a"), c("b.cell").alias("b"), "len")


def _with_edges(graph: dict[str, DataFrame], new: DataFrame, kind: int) -> dict[str, DataFrame]:
    """Add straight edges between nodes, numbered by their own position within a kind.

    Edge ids are cell numbers below 2^62; the two kinds of added edges have ranges of their own above.
    """
    c = F.col
    new = cut(number_rows(new, ["raster"], [c("a"), c("b")], "edge", start=(1 << 62) + ((kind - 1) << 61)))
    edges = graph["edges"].unionByName(new.select("raster", "edge", "a", "b", "len"))
    ends = new.select("raster", "edge", F.posexplode(F.array("a", "b")).alias("idx", "node")).join(graph["nodes"], ["raster", "node"])
    points = graph["points"].unionByName(ends.select("raster", "edge", c("idx").cast("bigint").alias("idx"), "x", "y"))
    return {"nodes": graph["nodes"], "edges": cut(edges), "points": cut(points)}


@sends_little
def bridge(graph: dict[str, DataFrame], gap: float, reach: Column) -> dict[str, DataFrame]:
    """String dots together, then close gaps between line ends that point at each other."""
    if gap <= 0:
        return graph
    graph = _with_edges(graph, _dot_chain(graph, gap), 1)
    return _with_edges(graph, bridge_links(graph, gap, reach), 2)


@sends_little
def prune(graph: dict[str, DataFrame], spur: Column, rounds: int | None = None) -> dict[str, DataFrame]:
    """Drop short dead ends at junctions, round by round until none is left, or in ``rounds`` rounds."""
    c = F.col
    edges = graph["edges"]
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        deg = _degrees(edges)
        at = lambda n: deg.select("raster", c("node").alias(n), c("deg").alias(f"deg_{n}"))  # noqa: E731,B023
        rows = edges.join(at("a"), ["raster", "a"]).join(at("b"), ["raster", "b"])
        loose = ((c("deg_a") == 1) & (c("deg_b") >= 3)) | ((c("deg_b") == 1) & (c("deg_a") >= 3))
        bad = cut(rows.where((c("a") != c("b")) & (c("len") < spur) & loose).select("raster", "edge"))
        if bad.isEmpty():
            break
        edges = cut(edges.join(bad, ["raster", "edge"], "left_anti"))
    return {**graph, "edges": edges, "points": cut(graph["points"].join(edges.select("raster", "edge"), ["raster", "edge"], "left_semi"))}


@sends_little
def trace_lines(graph: dict[str, DataFrame], reach: Column, eps: float, min_length: float) -> DataFrame:
    """Lines through junctions by straightest continuation, simplified, long enough and not label-like."""
    c = F.col
    dirs = cut(_edge_dirs(graph["edges"], graph["points"], graph["nodes"], reach).select("raster", "edge", "end", "node", "dx", "dy"))
    n = dirs.groupBy("raster", "node").agg(F.count("*").alias("n"))
    rows = dirs.join(n, ["raster", "node"])
    other = rows.select("raster", "node", *[c(k).alias(f"q_{k}") for k in ("edge", "end", "dx", "dy")])
    # A node joins few edges, bounded by the cells around its cluster.
    met = rows.where("n >= 2").join(other, ["raster", "node"]).where("edge < q_edge")
    met = met.withColumn("dot", F.when(c("n") == 2, -2.0).otherwise(c("dx") * c("q_dx") + c("dy") * c("q_dy"))).where("dot <= -0.7")
    port = lambda e, s: F.struct("raster", c(e).alias("edge"), c(s).alias("end"))
    pairs = greedy_match(met.select(port("edge", "end").alias("a"), port("q_edge", "q_end").alias("b"), "dot"), ["dot"])
    links = pairs.select(
        c("a.raster").alias("map_id"), c("a.edge").alias("a_id"), c("a.end").alias("a_side"), c("b.edge").alias("b_id"), c("b.end").alias("b_side")
    )
    v = cut(graph["points"].select(c("raster").alias("map_id"), c("edge").alias("feature_id"), "idx", "x", "y"))
    chains = cut(assemble_chains(v, links))
    lone = v.join(chains.select("map_id", "feature_id"), ["map_id", "feature_id"], "left_anti")
    lines = chain_vertices(v, chains).unionByName(lone)
    slim = keep_vertices(cut(lines), eps, F.lit(False))
    return cut(filter_lines(cut(renumber(slim)), min_length))


def filter_lines(v: DataFrame, min_length: float) -> DataFrame:
    """Lines of at least ``min_length`` whose course is not the tight curl of a label; adds length_px."""
    c = F.col
    keys = ["map_id", "feature_id"]
    at = F.struct("x", "y")
    ends = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by(at, "idx").alias("_a"), F.max_by(at, "idx").alias("_z"))
    chord = F.hypot(c("_a.x") - c("_z.x"), c("_a.y") - c("_z.y"))
    label = (c("length_px") < 500) & (c("length_px") / F.greatest(chord, F.lit(1.0)) > 1.5)
    good = ends.join(pixel_length(v), keys).where((c("length_px") >= min_length) & (c("_n") >= 2) & ~label).select(*keys, "length_px")
    return v.join(good, keys)


def _evidence(info: DataFrame, v: DataFrame, px: DataFrame, most: int | None) -> DataFrame:
    """Of each candidate: shares of samples that found ink (support) and the exact ink (core), mean width and mean of its square, and its ends _a and _z.

    Pixels and lines of a map meet in one task; those of a map that is too large for it meet in a join.
    """
    c = F.col
    keys = ["map_id", "candidate_id"]
    lines = v.select("map_id", c("candidate_id").alias("feature_id"), "idx", "x", "y")
    if not numbered_ids(lines, info.select("map_id"), px.select("map_id")) or not all(isinstance(info.schema[k].dataType, IntegralType) for k in ("candidate_id", "chip_id")):
        return _evidence_by_join(info, v, px, most)
    none = lambda k, *names: [F.lit(None).cast(k).alias(n) for n in names]
    long, dbl = (lambda n, a: c(n).cast("long").alias(a)), (lambda n, a: c(n).cast("double").alias(a))
    inked = px.where("x is not null and y is not null and r is not null and g is not null and b is not null")
    dots = inked.select("map_id", *none("long", "feature_id", "idx"), dbl("x", "x"), dbl("y", "y"), dbl("r", "r"), dbl("g", "g"), dbl("b", "b"), F.lit(0).alias("_role"))
    path = lines.select("map_id", long("feature_id", "feature_id"), long("idx", "idx"), dbl("x", "x"), dbl("y", "y"), *none("double", "r", "g", "b"), F.lit(1).alias("_role"))
    asked = info.select("map_id", long("candidate_id", "feature_id"), long("chip_id", "idx"), dbl("length_px", "x"), dbl("tolerance", "y"), dbl("ir", "r"), dbl("ig", "g"), dbl("ib", "b"), F.lit(2).alias("_role"))
    names = ("support", "core", "width", "w2", "ax", "ay", "zx", "zy")
    fields = [StructField("feature_id", LongType()), StructField("n", LongType()), *(StructField(k, DoubleType()) for k in names)]
    found, rest = by_maps(dots.unionByName(path).unionByName(asked), partial(_evidence_together, most), fields, ["_role"])
    at = lambda p: F.struct(c(f"{p}x").alias("x"), c(f"{p}y").alias("y")).alias(f"_{p}")
    out = found.select("map_id", c("feature_id").cast(info.schema["candidate_id"].dataType).alias("candidate_id"), at("a"), at("z"), *[F.when(c("n") > 0, c(k)).alias(k) for k in names[:4]])
    if rest is None:
        return out
    ids = cut(rest.select("map_id").distinct())
    few = [df.join(ids, "map_id", "left_semi") for df in (info, v, px)]
    return out.unionByName(_evidence_by_join(*few, most).select(*out.columns))


def _evidence_together(most: int | None, c: Columns, maps: np.ndarray) -> Columns:
    """``_evidence`` of whole maps: role 0 are pixels, 1 vertices, 2 candidates with chip (idx), length (x), tolerance (y) and ink."""
    dot, way, own = (np.flatnonzero(c["_role"] == k) for k in (0, 1, 2))
    net = Net({k: c[k][way] for k in ("feature_id", "idx", "x", "y")}, maps[way])
    own = own[np.lexsort((c["feature_id"][own], maps[own]))]
    m, ids, chip = maps[own], c["feature_id"][own], c["idx"][own]
    values = [c[k][own] for k in ("x", "y", "r", "g", "b")]
    least = np.iinfo(np.int64).min
    bad = (ids == least) | (chip == least) | ~np.all([np.isfinite(k) for k in values], axis=0)
    bad[1:] |= (m[1:] == m[:-1]) & (ids[1:] == ids[:-1])
    # One ink and tolerance a chip of a map.
    by = np.lexsort((chip, m))
    new = np.ones(len(by), bool)
    new[1:] = (m[by][1:] != m[by][:-1]) | (chip[by][1:] != chip[by][:-1])
    bad[by[1:]] |= ~new[1:] & np.any([k[by][1:] != k[by][:-1] for k in values[1:]], axis=0)
    far = ~((np.abs(c["x"][dot]) < 1 << 19) & (np.abs(c["y"][dot]) < 1 << 19))
    if bad.any() or far.any() or (net.line_id == least).any():
        raise Refused(np.concatenate([m[bad], maps[dot][far], net.maps[net.line_id == least]]))
    ink = np.empty(len(own), np.int64)
    ink[by] = np.cumsum(new) - 1
    head = by[new]  # a candidate of each ink
    # The candidates' lines; a line that nobody asks for is left out.
    _, code = np.unique(np.concatenate([net.ids, ids]), return_inverse=True)
    name = (np.concatenate([net.line_map, m]).astype(np.int64) << 32) + code
    line_name, own_name = name[:len(net.ids)], name[len(net.ids):]
    cand = np.minimum(np.searchsorted(own_name, line_name), max(len(own) - 1, 0))
    asked = own_name[cand] == line_name if len(own) else np.zeros(len(line_name), bool)
    cell = lambda x, y: ((x + (1 << 20)).astype(np.int64) << 21) + (y + (1 << 20)).astype(np.int64)
    # Pixels near each ink, as sorted numbers of (ink, place).
    dot = dot[np.argsort(maps[dot], kind="stable")]
    begin, end = np.searchsorted(maps[dot], m[head]), np.searchsorted(maps[dot], m[head], "right")
    near, exact = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (a, b) in enumerate(zip(begin, end)):
        part, (_, tolerance, *rgb) = dot[a:b], [float(x[head[k]]) for x in values]
        d2, tol = sum((c[n][part] - x) ** 2 for n, x in zip("rgb", rgb)), max(0.0, tolerance)
        place = (k << 42) + cell(c["x"][part], c["y"][part])
        near.append(np.sort(place[d2 <= tol * tol]))
        exact.append(np.sort(place[d2 <= min(tol * tol, min(tol, 24.0) ** 2)]))
    near, exact = np.concatenate(near), np.concatenate(exact)

    def among(places: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.floor(x + 0.5), np.floor(y + 0.5)
        inside = (np.abs(x) < 1 << 19) & (np.abs(y) < 1 << 19)
        want = (of << 42) + cell(np.where(inside, x, 0), np.where(inside, y, 0))
        at = np.minimum(np.searchsorted(places, want), max(len(places) - 1, 0))
        return inside & (places[at] == want) if len(places) else np.zeros(len(x), bool)

    of, _, (x1, y1, x2, y2) = net.segments()
    some = asked[of] & ((x1 != x2) | (y1 != y2))
    of, x1, y1, x2, y2 = (k[some] for k in (of, x1, y1, x2, y2))
    span = np.hypot(x2 - x1, y2 - y1)
    apart = 2.0 if most is None else np.maximum(2.0, values[0][cand[of]] / most)
    n = np.maximum(1, np.ceil(span / apart)).astype(np.int64)
    refuse_more(net.line_map[of], n + 1)
    total = np.zeros((4, len(own)))
    count = np.bincount(cand[of], n + 1, len(own)).astype(np.int64)
    for part in parts_of((n + 1) * 25):
        seg, step = spread(n[part] + 1)
        s = part.start + seg
        t = step / n[s]
        x, y, k = x1[s] + (x2[s] - x1[s]) * t, y1[s] + (y2[s] - y1[s]) * t, ink[cand[of[s]]]
        nx, ny = -(y2[s] - y1[s]) / span[s], (x2[s] - x1[s]) / span[s]
        found, core = (np.any([among(places, k, x + i, y + j) for j in (-1, 0, 1) for i in (-1, 0, 1)], axis=0) for places in (near, exact))
        w = found.astype(float)
        for side in (-1, 1):
            hit = [among(near, k, x + nx * (i * side), y + ny * (i * side)) for i in range(1, 9)]
            w += np.cumprod(hit, axis=0).sum(0)
        for row, value in enumerate((found, core, w, w * w)):
            total[row] += np.bincount(cand[of[s]], value, len(own))
    shown = np.flatnonzero(asked)
    a, z = net.first[shown], net.first[shown] + net.top[shown]
    mean = total[:, cand[shown]] / np.maximum(count[cand[shown]], 1)
    return {
        "map": net.line_map[shown], "feature_id": net.ids[shown], "n": count[cand[shown]], **dict(zip(("support", "core", "width", "w2"), mean)),
        "ax": net.x[a], "ay": net.y[a], "zx": net.x[z], "zy": net.y[z],
    }


def _evidence_by_join(info: DataFrame, v: DataFrame, px: DataFrame, most: int | None) -> DataFrame:
    c = F.col
    keys = ["map_id", "candidate_id"]
    segs = segments(v.select(*keys, "idx", "x", "y"), keys).where("x1 <> x2 or y1 <> y2").join(info.select(*keys, "chip_id", "length_px"), keys)
    span = F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))
    apart = F.lit(2.0) if most is None else F.greatest(F.lit(2.0), c("length_px") / most)
    count = F.greatest(F.lit(1), F.ceil(span / apart))
    rows = segs.withColumn("_s", span).withColumn("_n", count).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), c("_n"))))
    t = c("_k") / c("_n")
    rows = rows.select(
        *keys, "chip_id", "seg", "_k", (c("x1") + (c("x2") - c("x1")) * t).alias("x"), (c("y1") + (c("y2") - c("y1")) * t).alias("y"),
        (-(c("y2") - c("y1")) / c("_s")).alias("nx"), ((c("x2") - c("x1")) / c("_s")).alias("ny"),
    )
    probe = lambda side, step, x, y: F.struct(F.lit(side).alias("side"), F.lit(step).alias("step"), F.floor(x + 0.5).cast("int").alias("px"), F.floor(y + 0.5).cast("int").alias("py"))
    around = [probe(0, 0, c("x") + dx, c("y") + dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    across = [probe(side, k, c("x") + c("nx") * (k * side), c("y") + c("ny") * (k * side)) for side in (-1, 1) for k in range(1, 9)]
    looks = rows.select(*keys, "chip_id", "seg", "_k", F.explode(F.array(*around, *across)).alias("p")).select(*keys, "chip_id", "seg", "_k", "p.*")
    ink = px.join(info.select("map_id", "chip_id", "ir", "ig", "ib", "tolerance").distinct(), "map_id")
    d2 = (c("r") - c("ir")) * (c("r") - c("ir")) + (c("g") - c("ig")) * (c("g") - c("ig")) + (c("b") - c("ib")) * (c("b") - c("ib"))
    tol = F.greatest(F.lit(0.0), c("tolerance"))
    ink = ink.withColumn("_d2", d2).where(c("_d2") <= tol * tol)
    exact = F.least(tol, F.lit(24.0))
    ink = ink.select("map_id", "chip_id", c("x").alias("px"), c("y").alias("py"), (c("_d2") <= exact * exact).alias("exact"))
    seen = looks.join(ink, ["map_id", "chip_id", "px", "py"], "left").withColumn("hit", c("exact").isNotNull())
    miss = lambda side: F.coalesce(F.min(F.when((c("side") == side) & ~c("hit"), c("step"))), F.lit(9)) - 1
    at0 = c("side") == 0
    sample = seen.groupBy(*keys, "seg", "_k").agg(
        F.max(at0 & c("hit")).alias("found"), F.max(at0 & F.coalesce("exact", F.lit(False))).alias("exact"), (miss(-1) + miss(1)).alias("w")
    )
    sample = sample.withColumn("w", (c("w") + c("found").cast("int")).cast("double"))
    agg = sample.groupBy(*keys).agg(
        F.avg(c("found").cast("double")).alias("support"), F.avg(c("exact").cast("double")).alias("core"), F.avg("w").alias("width"), F.avg(c("w") * c("w")).alias("w2")
    )
    at = F.struct("x", "y")
    ends = v.groupBy(*keys).agg(F.min_by(at, "idx").alias("_a"), F.max_by(at, "idx").alias("_z"))
    return ends.join(agg, keys, "left")


def candidate_confidence(cands: DataFrame, v: DataFrame, px: DataFrame, chips: DataFrame, most: int | None = None) -> DataFrame:
    """Evidence between 0 and 1 that each candidate is a trail drawn in its chip's ink.

    ``cands`` has (map_id, candidate_id, chip_id, length_px, min_length_px, tolerance). Samples lie
    two pixels apart along the whole line, or as far apart as ``most`` samples need, if asked for;
    each probes its 3x3 surroundings and up to eight steps to either side.
    """
    c = F.col
    keys = ["map_id", "candidate_id"]
    info = cands.join(chips.select("map_id", "chip_id", c("r").alias("ir"), c("g").alias("ig"), c("b").alias("ib")), ["map_id", "chip_id"])
    rows = info.join(_evidence(info, v, px, most), keys, "left")
    one = lambda e: F.least(F.lit(1.0), F.greatest(F.lit(0.0), e))
    spread = F.sqrt(F.greatest(F.lit(0.0), c("w2") - c("width") * c("width")))
    chord = F.hypot(c("_a.x") - c("_z.x"), c("_a.y") - c("_z.y"))
    # fixed values: weights of the evidence
    line = one(
        0.2 * c("support") + 0.53 * c("core") + 0.17 * F.exp(-F.greatest(F.lit(0.0), c("width") - 2) / 2)
        + 0.04 / (1 + spread / F.greatest(c("width"), F.lit(1.0))) + 0.03 * one(F.sqrt(chord / c("length_px")))
        + 0.03 * one(c("length_px") / F.greatest(F.lit(1.0), c("min_length_px") * 4))
    )
    hsl = P.rgb_to_hsl(c("ir"), c("ig"), c("ib"))
    rows = rows.withColumn("_line", line).withColumn("_hsl", hsl)
    quality = one((c("_hsl.s") - 0.25) / 0.45) * one((0.78 - c("_hsl.l")) / 0.4)
    return rows.select(*keys, F.coalesce(one(c("_line") * (0.4 + 0.6 * quality)), F.lit(0.0)).alias("confidence"))


@sends_little
def find_trails(px: DataFrame, maps: DataFrame, chips: DataFrame, tolerance: float = 60.0, gap: float = 0.0, min_length: float = 50.0, factor: int = 1) -> dict[str, DataFrame]:
    """Candidate lines of every chip of every map, with confidence.

    A chip's own ``tolerance`` counts where it has one. Tracing works on cells of ``factor`` pixels;
    by default on all pixels, whatever the raster's size. Lengths are in pixels throughout.

    Steps: colour mask, grown edges, closing, components, thinning, filled shapes out, skeleton
    graph, bridging, pruning, chaining.
    """
    c = F.col
    own = c("tolerance") if "tolerance" in chips.columns else F.lit(None)
    inks = chips.withColumn("tolerance", F.coalesce(own.cast("double"), F.lit(float(tolerance))))
    r = P.closing_radius(gap, factor)
    mask = P.grow_mask(cut(P.color_mask(px, inks, factor)), px, inks, factor)
    labelled = cut(P.drop_specks(cut(P.components(cut(P.close_mask(mask, maps, r, factor))))))
    skeleton = P.drop_filled(cut(thin(labelled.select(*MASK, "x", "y"))), labelled, r)
    graph = skeleton_graph(skeleton, factor)
    reach = F.lit(float(max(8, 4 * r) * factor))
    graph = bridge(graph, gap, reach)
    graph = prune(graph, F.lit(float(max(6 * factor, (2 * r + 5) * factor, 0.15 * min_length))))
    lines = trace_lines(graph, reach, max(1.0, 0.9 * factor), min_length)
    flat = lines.select(c("map_id.map_id").alias("map_id"), c("map_id.chip_id").alias("chip_id"), c("feature_id").alias("line"), "idx", "x", "y", "length_px")
    ident = F.concat_ws("-", c("map_id").cast("string"), c("chip_id").cast("string"), c("line").cast("string"))
    flat = flat.withColumn("candidate_id", ident)
    cands = flat.groupBy("map_id", "candidate_id", "chip_id").agg(F.max("length_px").alias("length_px"))
    cands = cut(cands.withColumn("min_length_px", F.lit(float(min_length))).join(inks.select("map_id", "chip_id", "tolerance"), ["map_id", "chip_id"]))
    v = flat.select("map_id", "candidate_id", "idx", "x", "y")
    return {"candidates": cut(cands.join(candidate_confidence(cands, v, px, inks), ["map_id", "candidate_id"])), "vertices": v}


