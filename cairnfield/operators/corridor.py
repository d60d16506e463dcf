"""Refining lines along the ink: the cheapest way through the pixels of a corridor, station to station."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.color import color_distance
from cairnfield.functions.geo import clamp, round_half_up
from cairnfield.operators.grid import box_cells, point_cells
from cairnfield.operators.lines import measured_segments
from cairnfield.operators.ordered import running, with_next
from cairnfield.operators.review import LINE, moved_stations
from cairnfield.operators.simplify import _keep_in_range
from cairnfield.session import cut

#: Pixels between stations and between guides, least price of a step, weight of the distance, share of
#: a way's pixels that must show the ink, and tolerance of the drawn line.
STATION, GUIDE, STEP_PRICE, PULL, SUPPORT, STRAIGHT = 60, 10, 0.2, 2.0, 0.6, 0.9
RUN = [*LINE, "idx"]


def _guides(v: DataFrame, pinned: DataFrame | None) -> DataFrame:
    """Points of each line every ten pixels from the station before, with that station's distance ``d0``.

    An edge knows its stations without a join: the last pinned vertex before it (a running maximum) and the
    multiples of 60 on it.
    """
    c = F.col
    edges = measured_segments(v.select(*LINE, "idx", "x", "y"), LINE).withColumn("idx", c("seg"))
    held = F.when(c("idx") == 0, c("d1"))
    if pinned is not None:
        edges = edges.join(pinned.select(*LINE, "idx", F.lit(True).alias("_pin")).distinct(), [*LINE, "idx"], "left")
        held = F.when(c("_pin") | (c("idx") == 0), c("d1"))
    edges = running(edges, LINE, held, "_from", how="max")
    # Multiples of ten behind a station at a multiple of 60, and tens counted from a pinned vertex up to the next such station.
    lo, hi = F.floor(c("d1") / GUIDE) + 1, F.floor(c("d2") / GUIDE)
    tens = F.transform(F.when(lo <= hi, F.sequence(lo, hi)), lambda k: k * F.lit(float(GUIDE)))
    far = F.least(c("d2"), (F.floor(c("_from") / STATION) + 1) * F.lit(float(STATION)))
    lo2, hi2 = F.floor((c("d1") - c("_from")) / GUIDE) + 1, F.floor((far - c("_from")) / GUIDE)
    own = F.transform(F.when(lo2 <= hi2, F.sequence(lo2, hi2)), lambda k: c("_from") + k * F.lit(float(GUIDE)))
    base = lambda d: F.floor(d / STATION) * F.lit(float(STATION))
    none = F.array().cast("array<double>")
    both = F.concat(
        F.filter(F.coalesce(tens, none), lambda d: base(d) >= c("_from")),
        F.filter(F.coalesce(own, none), lambda d: base(d) < c("_from")),
    )
    rows = edges.withColumn("d", F.explode(both))
    t = (c("d") - c("d1")) / (c("d2") - c("d1"))
    return rows.select(
        *LINE, F.greatest(c("_from"), base(c("d"))).alias("d0"), "d", (c("x1") + (c("x2") - c("x1")) * t).alias("gx"), (c("y1") + (c("y2") - c("y1")) * t).alias("gy")
    )


def _runs(v: DataFrame, st: DataFrame, pinned: DataFrame | None) -> DataFrame:
    """Runs between neighbouring stations with their hand line ``hand``, at most eight points long."""
    c = F.col
    runs = with_next(st, LINE, {"x": "ax", "y": "ay", "d": "d0"}, back=True).where("d0 is not null")
    guides = _guides(v, pinned).join(runs.select(*RUN, "d0", c("d").alias("_end")), [*LINE, "d0"]).where("d > d0 and d < _end")
    # A run is 60 pixels long at most, so it has five guides or six.
    packed = guides.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct("d", "gx", "gy"))).alias("_g"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    inner = F.coalesce(F.transform("_g", lambda g: point(g["gx"], g["gy"])), F.array().cast("array<struct<x:double,y:double>>"))
    hand = F.concat(F.array(point(c("ax"), c("ay"))), inner, F.array(point(c("x"), c("y"))))
    return runs.join(packed, RUN, "left").select(*RUN, "ink_r", "ink_g", "ink_b", hand.alias("hand"))


def _away(x: Column, y: Column) -> Column:
    """Distance of a pixel from the hand line of its run."""

    def edge(a: Column, b: Column) -> Column:
        vx, vy = b["x"] - a["x"], b["y"] - a["y"]
        t = clamp(((x - a["x"]) * vx + (y - a["y"]) * vy) / F.coalesce(F.nullif(vx * vx + vy * vy, F.lit(0.0)), F.lit(1.0)), 0.0, 1.0)
        return F.hypot(x - a["x"] - t * vx, y - a["y"] - t * vy)

    hand = F.col("hand")
    size = F.size(hand)
    return F.array_min(F.zip_with(F.slice(hand, 1, size - 1), F.slice(hand, 2, size - 1), edge))


_MOVES = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def cheapest_way(cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]] | None:
    """Cells (row, column) of the cheapest way over a grid of prices; infinite ones are not entered.

    A step to one of the eight neighbours costs its length times 0.2 plus the price of the cell it enters; a step
    out of the start costs no price. All cells are relaxed at once until none changes, so the work is
    the grid times the number of steps. Of equal ways the one whose last steps come first by row and column is taken.
    """
    rows, cols = cost.shape
    price = np.full((rows + 2, cols + 2), np.inf)
    price[1:-1, 1:-1] = cost
    dist = np.full_like(price, np.inf)
    s, g = (start[0] + 1, start[1] + 1), (goal[0] + 1, goal[1] + 1)
    if not (np.isfinite(price[s]) and np.isfinite(price[g])):
        return None
    dist[s] = 0.0
    length = {m: np.sqrt(2.0) if m[0] and m[1] else 1.0 for m in _MOVES}
    enter = {m: length[m] * (STEP_PRICE + price) for m in _MOVES}
    around = [(s[0] + dy, s[1] + dx) for dy, dx in _MOVES]
    for (dy, dx), cell in zip(_MOVES, around):
        if np.isfinite(price[cell]):
            dist[cell] = length[dy, dx] * STEP_PRICE
    inner = (slice(1, -1), slice(1, -1))
    while True:
        new = dist[inner].copy()
        for dy, dx in _MOVES:
            np.minimum(new, dist[1 - dy:rows + 1 - dy, 1 - dx:cols + 1 - dx] + enter[dy, dx][inner], out=new)
        if not (new < dist[inner]).any():
            break
        dist[inner] = new
    if not np.isfinite(dist[g]):
        return None
    way = [g]
    while way[-1] != s:
        y, x = way[-1]
        step = lambda m: STEP_PRICE * length[m] if (y - m[0], x - m[1]) == s else enter[m][y, x]  # noqa: E731, B023
        _, dy, dx = min((dist[y - m[0], x - m[1]] + step(m), -m[0], -m[1]) for m in _MOVES)
        way.append((y + dy, x + dx))
    return [(y - 1, x - 1) for y, x in way[::-1]]


def _follow(corridor: float, tolerance: float):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        x, y = rows["px"].to_numpy(), rows["py"].to_numpy()
        left, top = x.min(), y.min()
        tint = np.full((y.max() - top + 1, x.max() - left + 1), np.inf)
        cost = tint.copy()
        tint[y - top, x - left] = rows["tint"]
        cost[y - top, x - left] = rows["tint"] / max(1.0, tolerance) + (rows["away"] / max(1.0, corridor)) ** 2 * PULL
        ends = [(int(first[f"{p}y"] - top), int(first[f"{p}x"] - left)) for p in "se"]
        inside = all(0 <= r < cost.shape[0] and 0 <= q < cost.shape[1] for r, q in ends)
        way = cheapest_way(cost, *ends) if inside else None
        out = {k: [first[k]] for k in RUN}
        if way is None:
            return pd.DataFrame({**out, "confidence": [None], "path": [None]})
        at = np.array(way)
        share = float((tint[at[:, 0], at[:, 1]] <= tolerance).mean())
        wx, wy = at[:, 1] + float(left), at[:, 0] + float(top)
        keep = sorted({0, len(at) - 1, *_keep_in_range(np.arange(len(at)), wx, wy, STRAIGHT)})
        return pd.DataFrame({**out, "confidence": [share], "path": [[{"x": wx[k], "y": wy[k]} for k in keep[1:]]]})

    return solve


def refine_paths(
    v: DataFrame, px: DataFrame, maps: DataFrame, inks: DataFrame, corridor: float, tolerance: float, pinned: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Lines led along their ink: ``vertices`` (map_id, feature_id, idx, x, y) and ``runs`` between stations.

    Stations lie every 60 pixels and are moved as in ``moved_stations``. From station to station the line follows the
    cheapest way through the pixels at most ``corridor`` from the hand line: a pixel's price is its colour's distance
    from the ink in tolerances, plus twice the square of its distance in corridors. A run is refined when 60 % of that
    way's pixels are within ``tolerance``, and ends on its station's pixel; otherwise it goes straight to the next station. A run's row has its
    first and last vertex, ``confidence`` (0 where no way leads through, as where pixels are absent) and ``refined``. A
    line none of whose runs is refined, without ink or of one vertex, stays as it was, as one run.

    Runs are separate groups whose pixels a corridor bounds, whatever the length of the line; only pixels inside it are
    shuffled. ``maps`` has the size of each raster; ``inks`` one row a line, vertices and pixels no nulls.
    """
    c = F.col
    v = v.select(*LINE, "idx", "x", "y")
    inks = inks.select(*LINE, "ink_r", "ink_g", "ink_b").where("ink_r is not null and ink_g is not null and ink_b is not null")
    inked = v.join(inks.select(*LINE), LINE, "left_semi")
    st = moved_stations(inked, px, inks, corridor, tolerance, pinned)
    runs = _runs(inked, st, pinned)
    least = lambda f: F.array_min(F.transform("hand", lambda p: p[f]))
    most = lambda f: F.array_max(F.transform("hand", lambda p: p[f]))
    pad = F.lit(float(corridor))
    sized = runs.join(maps.select("map_id", "width", "height"), "map_id").withColumns({
        "_x0": F.greatest(F.lit(0), F.floor(least("x") - pad)), "_x1": F.least(c("width") - 1, F.ceil(most("x") + pad)),
        "_y0": F.greatest(F.lit(0), F.floor(least("y") - pad)), "_y1": F.least(c("height") - 1, F.ceil(most("y") + pad)),
    }).where("_x0 <= _x1 and _y0 <= _y1")
    end = lambda p, f, lo, hi: clamp(round_half_up(p[f]), c(lo), c(hi)).cast("int")
    a, b = F.element_at("hand", 1), F.element_at("hand", -1)
    sized = sized.withColumns({"sx": end(a, "x", "_x0", "_x1"), "sy": end(a, "y", "_y0", "_y1"), "ex": end(b, "x", "_x0", "_x1"), "ey": end(b, "y", "_y0", "_y1")})
    # A cell's side is that of a usual run's box, which then meets four cells or so.
    side = STATION + 2 * corridor
    cells = box_cells(sized, side, "_x0", "_y0", "_x1", "_y1")
    look = point_cells(px.select("map_id", c("x").alias("px"), c("y").alias("py"), "r", "g", "b"), side, "px", "py")
    met = cells.join(look, ["map_id", "_cx", "_cy"]).where("px between _x0 and _x1 and py between _y0 and _y1")
    end_pixel = ((c("px") == c("sx")) & (c("py") == c("sy"))) | ((c("px") == c("ex")) & (c("py") == c("ey")))
    met = met.withColumn("away", _away(c("px"), c("py"))).where((c("away") <= corridor) | end_pixel)
    tint = color_distance(c("r"), c("g"), c("b"), c("ink_r"), c("ink_g"), c("ink_b"))
    fields = met.select(*RUN, "sx", "sy", "ex", "ey", c("px").cast("int").alias("px"), c("py").cast("int").alias("py"), tint.alias("tint"), "away")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.select(*RUN).schema)
    ways = fields.groupBy(*RUN).applyInPandas(_follow(corridor, tolerance), f"{kinds}, confidence double, path array<struct<x:double,y:double>>")
    good = c("confidence") >= SUPPORT
    straight = F.array(F.struct(c("_x").alias("x"), c("_y").alias("y")))
    ends = st.where("idx > 0").select(*RUN, c("x").alias("_x"), c("y").alias("_y"))
    done = cut(ends.join(ways, RUN, "left").select(
        *RUN, F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(good, F.lit(False)).alias("refined"), F.when(good, c("path")).otherwise(straight).alias("path")
    ))
    led = done.groupBy(*LINE).agg(F.max("refined").alias("_any")).where("_any").select(*LINE)
    kept = done.join(led, LINE, "left_semi").withColumn("_run", c("idx")).withColumn("idx", c("idx") - 1)
    # Vertices are placed by a running count of those before; the first station is vertex 0.
    placed = cut(running(kept, LINE, F.size("path").cast("bigint"), "_before", inclusive=False))
    new = placed.select(*LINE, F.posexplode("path").alias("_k", "p"), "_before").select(*LINE, (c("_before") + c("_k") + 1).alias("idx"), "p.x", "p.y")
    heads = st.where("idx = 0").join(led, LINE, "left_semi").select(*LINE, c("idx").cast("bigint").alias("idx"), "x", "y")
    same = v.join(led, LINE, "left_anti")
    whole = same.groupBy(*LINE).agg(F.max("idx").cast("bigint").alias("last")).where("last > 0")
    out = placed.select(*LINE, c("_run").alias("idx"), c("_before").cast("bigint").alias("first"), (c("_before") + F.size("path")).cast("bigint").alias("last"), "refined", "confidence")
    left = whole.select(*LINE, F.lit(1).cast("bigint").alias("idx"), F.lit(0).cast("bigint").alias("first"), "last", F.lit(False).alias("refined"), F.lit(0.0).alias("confidence"))
    return {"vertices": heads.unionByName(new).unionByName(same.select(*LINE, c("idx").cast("bigint").alias("idx"), "x", "y")), "runs": out.unionByName(left)}
