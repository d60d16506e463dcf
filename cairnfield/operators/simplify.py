"""Fewer and smoother vertices, with ends and junctions held in place."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.operators.ordered import CHUNK, chunk_of, running, with_next
from cairnfield.session import cut

KEYS = ["map_id", "feature_id"]


def renumber(v: DataFrame, keys: Sequence[str] = KEYS, order: str = "idx") -> DataFrame:
    """Dense ``idx`` from 0 in ``order``, through chunk totals."""
    out = running(v, keys, F.lit(1).cast("bigint"), "_new", idx=order)
    return out.withColumn("idx", F.col("_new") - 1).drop("_new", *([order] if order != "idx" else []))


def junctions(v: DataFrame) -> DataFrame:
    """Coordinates used by two different trails, or by a trail and an area."""
    trail = F.when(F.col("kind") == "trail", F.col("feature_id"))
    spots = v.where("kind <> 'poi'").groupBy("map_id", "x", "y").agg(
        F.min(trail).alias("_lo"), F.max(trail).alias("_hi"), F.max(F.col("kind") == "area").alias("_area")
    )
    return spots.where("_lo <> _hi or (_lo is not null and _area)").select("map_id", "x", "y")


def _keep_in_range(idx: np.ndarray, x: np.ndarray, y: np.ndarray, eps: float) -> list[int]:
    """Interior positions one range keeps; the first farthest vertex splits it."""
    kept: list[int] = []
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        chord = np.hypot(dx, dy)
        if chord > 1e-6:
            away = np.abs(dy * x[a + 1:b] - dx * y[a + 1:b] + x[b] * y[a] - y[b] * x[a])
            limit = eps * chord
        else:
            away, limit = np.hypot(x[a + 1:b] - x[a], y[a + 1:b] - y[a]), eps
        far = int(np.argmax(away))
        if away[far] > limit:
            mid = a + 1 + far
            kept.append(int(idx[mid]))
            todo += [(a, mid), (mid, b)]
    return kept


def _interior_ranges(v: DataFrame, keys: list[str], fixed: Column) -> DataFrame:
    """Vertices between fixed ones, with the fixed neighbours' positions ``lo`` and ``hi``."""
    c = F.col
    top = v.groupBy(*keys).agg(F.max("idx").alias("_top"))
    rows = v.join(top, keys).withColumn("_fix", F.coalesce(fixed, F.lit(False)) | (c("idx") == 0) | (c("idx") == c("_top")))
    rows = running(rows, keys, F.when(c("_fix"), c("idx")), "lo", how="max")
    rows = rows.withColumn("_rev", c("_top") - c("idx"))
    rows = running(rows, keys, F.when(c("_fix"), c("_rev")), "_rhi", idx="_rev", how="max")
    return rows.withColumn("hi", c("_top") - c("_rhi")).drop("_rev", "_rhi", "_top")


def keep_vertices(v: DataFrame, eps: float, fixed: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """The vertices of open lines that stay within ``eps``; ends and ``fixed`` ones always stay.

    Ranges of more than ``CHUNK`` vertices are split level by level with one aggregate and one
    chunked join per round; shorter ranges are finished in vectorised tasks.
    """
    c = F.col
    keys = list(keys)
    cols = v.columns
    rows = cut(_interior_ranges(v, keys, fixed))
    anchors = rows.where("_fix")
    inner = rows.where("not _fix").select(*keys, "idx", "x", "y", "lo", "hi")
    at = lambda p: anchors.select(*keys, c("idx").alias(p), c("x").alias(f"{p}x"), c("y").alias(f"{p}y"))
    inner = inner.join(at("lo"), [*keys, "lo"]).join(at("hi"), [*keys, "hi"])
    kept: list[DataFrame] = []
    small = inner.where(c("hi") - c("lo") <= CHUNK)
    big = inner.where(c("hi") - c("lo") > CHUNK)
    while not big.limit(1).isEmpty():
        dx, dy = c("hix") - c("lox"), c("hiy") - c("loy")
        chord = F.hypot(dx, dy)
        away = F.when(
            chord > 1e-6, F.abs(dy * c("x") - dx * c("y") + c("hix") * c("loy") - c("hiy") * c("lox"))
        ).otherwise(F.hypot(c("x") - c("lox"), c("y") - c("loy")))
        limit = F.when(chord > 1e-6, chord * eps).otherwise(F.lit(float(eps)))
        far = big.withColumn("_o", away > limit).groupBy(*keys, "lo", "hi").agg(
            F.max(F.struct(away.alias("m"), (-c("idx")).alias("i"), "_o", "x", "y")).alias("_f")
        ).where("_f._o").select(*keys, "lo", "hi", (-c("_f.i")).alias("_m"), c("_f.x").alias("_fx"), c("_f.y").alias("_fy"))
        far = cut(far)
        kept.append(far.select(*keys, c("_m").alias("idx")))
        spread = far.withColumn("_c", F.explode(F.sequence(chunk_of(c("lo")), chunk_of(c("hi"))))).drop("hi")
        halves = big.withColumn("_c", chunk_of(c("idx"))).join(spread, [*keys, "lo", "_c"]).where("idx <> _m")
        before = c("idx") < c("_m")
        halves = halves.select(
            *keys, "idx", "x", "y",
            F.when(before, c("lo")).otherwise(c("_m")).alias("lo"), F.when(before, c("_m")).otherwise(c("hi")).alias("hi"),
            F.when(before, c("lox")).otherwise(c("_fx")).alias("lox"), F.when(before, c("loy")).otherwise(c("_fy")).alias("loy"),
            F.when(before, c("_fx")).otherwise(c("hix")).alias("hix"), F.when(before, c("_fy")).otherwise(c("hiy")).alias("hiy"),
        )
        halves = cut(halves)
        small = small.unionByName(halves.where(c("hi") - c("lo") <= CHUNK))
        big = halves.where(c("hi") - c("lo") > CHUNK)

    # A range holds at most CHUNK vertices here, so its array is bounded.
    packed = small.groupBy(*keys, "lo", "lox", "loy", "hix", "hiy").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    packed = packed.select(*keys, "lox", "loy", "hix", "hiy", c("p.idx").alias("i"), c("p.x").alias("px"), c("p.y").alias("py"))

    @F.pandas_udf("array<bigint>")
    def choose(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for lox, loy, hix, hiy, i, px, py in it:
            yield pd.Series([
                _keep_in_range(
                    np.concatenate([[-1], ids, [-1]]), np.concatenate([[x0], xs, [x1]]), np.concatenate([[y0], ys, [y1]]), eps
                )
                for x0, y0, x1, y1, ids, xs, ys in zip(lox, loy, hix, hiy, i, px, py)
            ])

    fine = packed.select(*keys, F.explode(choose("lox", "loy", "hix", "hiy", "i", "px", "py")).alias("idx"))
    for part in kept:
        fine = fine.unionByName(part)
    fine = fine.unionByName(anchors.select(*keys, "idx"))
    return v.join(fine, [*keys, "idx"], "left_semi").select(*cols)


def _opened(v: DataFrame, pins: Column) -> DataFrame:
    """Rings as closed open lines that start at their first pinned vertex; trails as they are."""
    c = F.col
    ring = c("kind") == "area"
    head = v.where(ring).groupBy(*KEYS).agg(F.count("*").alias("_n"), F.min(F.when(pins, c("idx"))).alias("_f"))
    rows = v.join(head, KEYS, "left")
    turned = F.when(ring, F.pmod(c("idx") - F.coalesce("_f", F.lit(0)), c("_n"))).otherwise(c("idx"))
    rows = rows.withColumn("_t", turned)
    rows = rows.withColumn("idx", F.explode(F.when(ring & (c("_t") == 0), F.array(c("_t"), c("_n"))).otherwise(F.array(c("_t")))))
    return rows.drop("_t", "_n", "_f")


def _closed_again(v: DataFrame) -> DataFrame:
    """Drop the repeated last vertex of rings."""
    top = v.where("kind = 'area'").groupBy(*KEYS).agg(F.max("idx").alias("_top"))
    return v.join(top, KEYS, "left").where("_top is null or idx < _top").drop("_top")


def _pinned(v: DataFrame, pins: DataFrame | None) -> DataFrame:
    if pins is None:
        return v.withColumn("_pin", F.lit(False))
    marks = pins.select("map_id", "x", "y", F.lit(True).alias("_pin"))
    return v.join(marks, ["map_id", "x", "y"], "left").withColumn("_pin", F.coalesce("_pin", F.lit(False)))


def _simplify_chunked(marked: DataFrame, eps: float) -> DataFrame:
    """Simplify lines of any length in chunks; ``_pin`` stays with the vertices."""
    c = F.col
    marked = cut(marked)
    opened = cut(renumber(_opened(marked, c("_pin"))))
    slim = _closed_again(keep_vertices(opened, eps, c("_pin")))
    slim = cut(renumber(slim).select("map_id", "feature_id", "idx", "x", "y", "kind", "_pin"))
    few = slim.where("kind = 'area'").groupBy(*KEYS).agg(F.count("*").alias("_n"), F.max("_pin").alias("_any")).where("_n < 3")
    whole = marked.join(few, KEYS).where(c("_any") | (c("idx") < 3)).drop("_n", "_any")
    rest = slim.join(few.select(*KEYS), KEYS, "left_anti")
    return rest.unionByName(whole.select(*rest.columns))


def _smooth_chunked(marked: DataFrame) -> DataFrame:
    """Smooth lines of any length in chunks.

    Every edge gives up to two points and every held vertex itself, so one look at the next vertex
    and one running count place all of them.
    """
    c = F.col
    marked = cut(marked)
    rows = renumber(_opened(marked, c("_pin")))
    top = rows.groupBy(*KEYS).agg(F.max("idx").alias("_top"))
    rows = rows.join(top, KEYS).withColumn(
        "_held", c("_pin") | ((c("kind") == "trail") & ((c("idx") == 0) | (c("idx") == c("_top"))))
    )
    rows = with_next(rows, KEYS, {"x": "_nx", "y": "_ny", "_held": "_nh"})
    near = lambda a, b: F.floor((a * 0.75 + b * 0.25) * 100 + 0.5) / 100
    none = F.lit(None).cast("struct<x:double,y:double>")
    spot = lambda when, x, y: F.when(when, F.struct(x.alias("x"), y.alias("y"))).otherwise(none)
    edge = c("_nx").isNotNull()
    # The repeated last vertex of a ring was already given as its first.
    self_ = spot(c("_held") & ((c("kind") == "trail") | (c("idx") < c("_top"))), c("x"), c("y"))
    first = spot(edge & ~c("_held"), near(c("x"), c("_nx")), near(c("y"), c("_ny")))
    second = spot(edge & ~c("_nh"), near(c("_nx"), c("x")), near(c("_ny"), c("y")))
    out = rows.withColumn("_p", F.filter(F.array(self_, first, second), lambda p: p.isNotNull()))
    out = running(out, KEYS, F.size("_p").cast("bigint"), "_at", inclusive=False)
    out = out.select("map_id", "feature_id", "kind", "_at", F.posexplode("_p").alias("_k", "_q"))
    return out.select(
        "map_id", "feature_id", (c("_at") + c("_k")).cast("bigint").alias("idx"), c("_q.x").alias("x"), c("_q.y").alias("y"), "kind"
    )


def _lengths(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, line and position of all vertices of lines that begin at ``off``."""
    n = np.diff(off)
    own = np.repeat(np.arange(len(n)), n)
    return n, own, np.arange(off[-1]) - off[:-1][own]


def _offsets(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _open_lines(off: np.ndarray, pin: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and vertices of lines as ``_opened`` gives them."""
    n, own, at = _lengths(off)
    start = np.zeros(len(n), np.int64)
    first = np.flatnonzero(pin & ring[own])[::-1]
    start[own[first]] = at[first]  # the first pin is written last
    wide = _offsets(n + ring)
    _, own, at = _lengths(wide)
    return wide, off[:-1][own] + (start[own] + at) % n[own]


def _keep_in_lines(keep: np.ndarray, x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """``_keep_in_range`` for the ranges between kept vertices of many lines, one level a round."""
    keep = keep.copy()
    at = np.flatnonzero(keep)
    a, b = at[:-1], at[1:]
    while True:
        a, b = a[b - a > 1], b[b - a > 1]
        if not len(a):
            return keep
        off = _offsets(b - a - 1)
        _, own, i = _lengths(off)
        i += a[own] + 1
        dx, dy = x[b] - x[a], y[b] - y[a]
        chord = np.hypot(dx, dy)
        long = chord > 1e-6
        away = np.where(
            long[own], np.abs(dy[own] * x[i] - dx[own] * y[i] + (x[b] * y[a])[own] - (y[b] * x[a])[own]),
            np.hypot(x[i] - x[a][own], y[i] - y[a][own]),
        )
        most = np.maximum.reduceat(away, off[:-1])
        far = np.flatnonzero(away == most[own])
        far = i[far[np.unique(own[far], return_index=True)[1]]]
        split = most > np.where(long, eps * chord, eps)
        a, b, far = a[split], b[split], far[split]
        keep[far] = True
        a, b = np.concatenate([a, far]), np.concatenate([far, b])


def _simplify_lines(off: np.ndarray, x: np.ndarray, y: np.ndarray, pin: np.ndarray, ring: np.ndarray, eps: float) -> tuple:
    wide, g = _open_lines(off, pin, ring)
    n, own, at = _lengths(wide)
    last = at == n[own] - 1
    keep = _keep_in_lines(pin[g] | (at == 0) | last, x[g], y[g], eps) & ~(last & ring[own])
    # A ring of less than three vertices stays whole if pinned, else with its first three.
    few = ring & (np.add.reduceat(keep, wide[:-1], dtype=np.int64) < 3)
    held = np.logical_or.reduceat(pin, off[:-1])
    g = np.where(few[own], off[:-1][own] + at, g)
    keep = np.where(few[own], ~last & (held[own] | (at < 3)), keep)
    g = g[keep]
    return _offsets(np.bincount(own[keep], minlength=len(n))), x[g], y[g], pin[g]


def _smooth_lines(off: np.ndarray, x: np.ndarray, y: np.ndarray, pin: np.ndarray, ring: np.ndarray) -> tuple:
    wide, g = _open_lines(off, pin, ring)
    n, own, at = _lengths(wide)
    x, y, edge, trail = x[g], y[g], at < n[own] - 1, ~ring[own]
    held = pin[g] | (trail & ((at == 0) | ~edge))
    near = lambda p, q: np.floor((p * 0.75 + q * 0.25) * 100 + 0.5) / 100
    after = lambda p: np.concatenate([p[1:], p[:1]])
    given = np.stack([held & (trail | edge), edge & ~held, edge & ~after(held)], axis=1)
    spots = lambda p: np.stack([p, near(p, after(p)), near(after(p), p)], axis=1)[given]
    return _offsets(np.bincount(own, given.sum(axis=1), len(n))), spots(x), spots(y)


def _packed(marked: DataFrame) -> DataFrame:
    """One row per chunk of a line, its vertices in order; ``_plain`` chunks hold finite places only."""
    c = F.col
    plain = F.coalesce((F.abs("x") < 1e15) & (F.abs("y") < 1e15), F.lit(False))
    rows = marked.groupBy(*KEYS, "kind", chunk_of(c("idx")).alias("_c")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "x", "y", "_pin"))).alias("_p"), F.bool_and(plain).alias("_plain")
    )
    return rows.select(*KEYS, "kind", "_c", "_plain", *[c(f"_p.{k}").alias(k) for k in ("idx", "x", "y", "_pin")])


#: Vertices that one step of a vectorised task takes, and a line more at most.
STEP = 1 << 18


def _rework_lines(lines: DataFrame, eps: float, smoothing: bool) -> DataFrame:
    """Simplify and smooth lines of one chunk each, all in one vectorised pass."""

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def rework(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for px, py, pins, rings in it:
            off = px.offsets.to_numpy().astype(np.int64)
            off -= off[0]
            x, y, pin, ring = (k.to_numpy(zero_copy_only=False) for k in (px.flatten(), py.flatten(), pins.flatten(), rings))
            n, sx, sy = [np.zeros(1, np.int64)], [], []
            begin = 0
            while begin < len(ring):
                end = min(len(ring), int(np.searchsorted(off, off[begin] + STEP)))
                s, k = slice(off[begin], off[end]), off[begin:end + 1] - off[begin]
                part = (k, x[s], y[s], pin[s])
                if eps > 0:
                    part = _simplify_lines(*part, ring[begin:end], eps)
                if smoothing:
                    part = _smooth_lines(*part, ring[begin:end])
                n.append(np.diff(part[0]))
                sx.append(part[1])
                sy.append(part[2])
                begin = end
            spots = pa.StructArray.from_arrays([pa.array(np.concatenate(k or [np.zeros(0)])) for k in (sx, sy)], ["x", "y"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(n)).astype(np.int32)), spots)

    spots = lines.select(*KEYS, "kind", F.posexplode(rework("x", "y", "_pin", F.col("kind") == "area")).alias("_at", "_q"))
    return spots.select("map_id", "feature_id", F.col("_at").cast("bigint").alias("idx"), "_q.x", "_q.y", "kind")


def _reworked(v: DataFrame, eps: float, smoothing: bool, pins: DataFrame | None) -> DataFrame:
    """Simplify, then smooth. Lines of one chunk are packed once and done whole; longer ones take chunked joins."""
    lines = cut(_packed(_pinned(v.where("kind <> 'poi'"), pins)))
    odd = lines.where("not (_plain and _c <=> 0)")
    if odd.isEmpty():
        return _rework_lines(lines, eps, smoothing)
    odd = cut(odd.select(*[F.col(k).alias(f"_{k}") for k in KEYS]).distinct())
    same = F.col("map_id").eqNullSafe(F.col("_map_id")) & F.col("feature_id").eqNullSafe(F.col("_feature_id"))
    short = _rework_lines(lines.join(odd, same, "left_anti"), eps, smoothing)
    out = lines.join(odd, same, "left_semi").select(*KEYS, "kind", F.inline(F.arrays_zip("idx", "x", "y", "_pin")))
    if eps > 0:
        out = _simplify_chunked(out, eps)
    if smoothing:
        out = _smooth_chunked(out)
    return short.unionByName(out.select(*short.columns))


def simplify(v: DataFrame, eps: float, pins: DataFrame | None = None) -> DataFrame:
    """Simplify trails and rings; coordinates in ``pins`` stay. Rings keep at least three vertices."""
    return v if eps <= 0 else _reworked(v, eps, False, pins)


def smooth(v: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """One corner-cutting pass to two decimals; line ends and pinned vertices stay."""
    return _reworked(v, 0.0, True, pins)


def simplify_maps(v: DataFrame, eps: float, smoothing: bool) -> DataFrame:
    """Simplify then smooth all lines, junctions held; points are passed through."""
    if eps <= 0 and not smoothing:
        return v
    out = _reworked(v, eps, smoothing, cut(junctions(v)))
    pois = v.where("kind = 'poi'")
    return out.unionByName(pois.select(*out.columns))


def simplify_report(before: DataFrame, after: DataFrame) -> DataFrame:
    count = lambda df, name: df.groupBy("map_id").agg(F.count("*").alias(name))
    return count(before, "vertices_before").join(count(after, "vertices_after"), "map_id", "left")
