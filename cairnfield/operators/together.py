"""Whole maps in one task: rows are shuffled once, by map, and what a map's lines have to do with each other stays in memory.

``by_maps`` gives whole maps to a vectorised function and hands back untouched those that are too large, too crowded or
not made of dense lines of finite places; these go through the joins. ``Net`` holds the lines of some maps as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegralType, StructField, StructType

from cairnfield.session import cut

#: A map of at most this many rows is worked on in one task; maps are taken together up to GROUP_ROWS.
MAP_ROWS, GROUP_ROWS = 1 << 17, 1 << 15
#: Strips that a map's segments pass, and pairs of places that are compared in one task, at most.
STRIPS, PAIRS = 1 << 22, 1 << 24
#: Pairs that are worked out at once.
SHEET = 1 << 20

Columns = dict[str, np.ndarray]


class Refused(Exception):
    """Maps (by their numbers in a group) that a task does not take."""

    def __init__(self, maps: np.ndarray):
        super().__init__("maps for the joins")
        self.maps = np.unique(maps)


def numbered_ids(*tables: DataFrame) -> bool:
    """Whether maps and lines have whole numbers as ids, as arrays need them."""
    return all(isinstance(df.schema[k].dataType, IntegralType) for df in tables for k in ("map_id", "feature_id") if k in df.columns)


def by_maps(rows: DataFrame, work: Callable[[Columns, np.ndarray], Columns], fields: list[StructField], needed: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``work`` of all rows of each map that fits a task, written, and the rows of the other maps, or None.

    ``work`` gets the columns but ``map_id`` of some whole maps, and the maps' numbers 0, 1, ...; it gives ``fields`` and, as ``map``, the number of each
    result's map. A map with a null in a ``needed`` column, and a null map, is left to the joins. A task holds ``GROUP_ROWS`` rows, or one map.
    """
    names = [f.name for f in rows.schema.fields if f.name != "map_id"]
    left = [StructField(f"left_{f.name}", f.dataType) for f in rows.schema.fields]
    schema = StructType([StructField("map_id", rows.schema["map_id"].dataType), *fields, *left, StructField("_left", BooleanType())])
    arrow = to_arrow_schema(schema)

    def give_back(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        cols = [pa.nulls(n, arrow.field(0).type), *(pa.nulls(n, arrow.field(f.name).type) for f in fields)]
        cols += [table.column(f.name[5:]).cast(arrow.field(f.name).type) for f in left]
        yield from pa.table([*cols, pa.array(np.ones(n, bool))], schema=arrow).to_batches(max_chunksize=1 << 16)

    def done(table: pa.Table, maps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole maps, numbered row by row; those that are refused go back, the others once more."""
        ids = table.column("map_id").combine_chunks()
        bad = np.unique(np.concatenate([maps[table.column(k).is_null().to_numpy()] for k in ("map_id", *needed)]))
        while True:
            if len(bad):
                off = np.isin(maps, bad)
                yield from give_back(table.filter(pa.array(off)))
                table, ids, maps = table.filter(pa.array(~off)), ids.filter(pa.array(~off)), maps[~off]
            if not table.num_rows:
                return
            _, first, dense = np.unique(maps, return_index=True, return_inverse=True)
            try:
                # A null of a column that may have it becomes the least number.
                columns = {k: _filled(table.column(k)) for k in names}
                out = work(columns, dense)
            except Refused as no:
                bad = maps[first][no.maps]
                continue
            n = len(out["map"])
            cols = [ids.take(pa.array(first)).take(pa.array(out["map"].astype(np.int64)))]
            cols += [pa.array(out[f.name]).cast(arrow.field(f.name).type) for f in fields]
            cols += [pa.nulls(n, arrow.field(f.name).type) for f in left]
            yield from pa.table([*cols, pa.array(np.zeros(n, bool))], schema=arrow).to_batches(max_chunksize=1 << 16)
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # whole maps, and the first rows of the last one
        own = 0  # rows of the last map that are held
        giant = False  # the last map is too large and goes back as it comes
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.concat_tables(held)
                held.clear()
                yield from done(table, _numbers(table.column("map_id").combine_chunks()))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            key = table.column("map_id").combine_chunks()
            number = _numbers(key)
            at = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(number))
            for a, b in zip(at[:-1], at[1:]):
                part, name = table.slice(a, b - a), key[int(a)].as_py()
                if last is None or name != last[0]:
                    if sum(len(t) for t in held) >= GROUP_ROWS:
                        yield from flush()
                    last, own, giant = (name,), 0, False
                if not giant and own + len(part) > MAP_ROWS:
                    giant = True
                    for k in range(len(held) - 1, -1, -1):  # its first rows go back, too
                        if held[k].column("map_id")[0].as_py() == name:
                            yield from give_back(held.pop(k))
                if giant:
                    yield from give_back(part)
                else:
                    held.append(part)
                    own += len(part)
        yield from flush()

    by = rows.repartition("map_id").sortWithinPartitions("map_id")
    out = cut(by.mapInArrow(run, schema))
    result = out.where("not _left").select("map_id", *(f.name for f in fields))
    rest = out.where("_left").select(*(f"left_{n}" for n in rows.columns)).toDF(*rows.columns)
    return result, None if rest.isEmpty() else rest


def _filled(values: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(values.type):
        return values.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
    return values.fill_null(False if pa.types.is_boolean(values.type) else float("nan")).to_numpy()


def _numbers(key: pa.Array) -> np.ndarray:
    """Numbers 0, 1, ... of equal neighbours, nulls among them."""
    if not len(key):
        return np.zeros(0, np.int64)
    value, gone = key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False)
    new = np.zeros(len(value), np.int64)
    new[1:] = (value[1:] != value[:-1]) | (gone[1:] != gone[:-1])
    return np.cumsum(new)


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: the number of the entry that each of the counted belongs to, and its place there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - (np.cumsum(n) - n)[of]


class Places:
    """Places of maps in vertical strips, in order of their height in the strip."""

    def __init__(self, maps: np.ndarray, x: np.ndarray, y: np.ndarray, width: float):
        self.width = width
        strip = np.floor(x / width)
        if len(x) and not np.abs(strip).max() < 1 << 31:
            raise Refused(maps[~(np.abs(strip) < 1 << 31)])
        code = (maps.astype(np.int64) << 33) + strip.astype(np.int64) + (1 << 32)
        self.order = np.lexsort((y, code))
        self.codes, self.start = np.unique(code[self.order], return_index=True)
        self.start = np.append(self.start, len(x))
        self.base = y.min() if len(y) else 0.0
        self.span = (y.max() - self.base if len(y) else 0.0) + 1.0
        rank = np.repeat(np.arange(len(self.codes)), np.diff(self.start))
        # Strip and height in one number; its rounding is made up for by a wider look.
        self.key = rank * self.span + (y[self.order] - self.base)
        self.slack = 8 * np.spacing(max(1.0, len(self.codes) * self.span + abs(self.base)))

    def between(self, maps: np.ndarray, strip: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range in ``order`` of the places of a strip between two heights, or a little more."""
        if not len(self.codes):
            return np.zeros(len(maps), np.int64), np.zeros(len(maps), np.int64)
        want = (maps.astype(np.int64) << 33) + strip + (1 << 32)
        at = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
        there = self.codes[at] == want
        inside = lambda v: at * self.span + np.clip(v - self.base, -1.0, self.span)
        a = np.clip(np.searchsorted(self.key, inside(low) - self.slack, "left"), self.start[at], self.start[at + 1])
        b = np.clip(np.searchsorted(self.key, inside(high) + self.slack, "right"), self.start[at], self.start[at + 1])
        return a, np.where(there, np.maximum(a, b), a)


def refuse_more(maps: np.ndarray, n: np.ndarray, most: int | None = None) -> None:
    """Refuses maps of more than ``most`` counted entries, PAIRS if it is not given."""
    most = PAIRS if most is None else most
    total = np.bincount(maps, n) if len(maps) else np.zeros(0)
    if (total > most).any():
        raise Refused(np.flatnonzero(total > most))


def near_pairs(maps: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of one map within ``tolerance``, each once."""
    # Wide enough that rounding never puts two near places two strips apart.
    width = max(tolerance * (1 + 1e-9), 1e-9)
    places = Places(maps, x, y, width)
    strip = np.floor(x / width).astype(np.int64)
    reach = tolerance * (1 + 1e-12)
    looks = [places.between(maps, strip + k, y - reach, y + reach) for k in (0, 1)]
    for a, b in looks:
        refuse_more(maps, b - a, PAIRS)
    for k, (a, b) in enumerate(looks):
        for part in parts_of(b - a):
            of, step = spread((b - a)[part])
            i = part.start + of
            j = places.order[a[i] + step]
            dx, dy = x[i] - x[j], y[i] - y[j]
            ok = (dx * dx + dy * dy <= tolerance * tolerance) & ((i < j) if k == 0 else True)
            yield i[ok], j[ok]


def parts_of(n: np.ndarray) -> Iterator[slice]:
    """Ranges of entries of about SHEET counted ones."""
    total, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SHEET, "right")))
        yield slice(begin, end)
        begin = end


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each number's component."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def project(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(t, x, y, d2) as ``project_on_segment`` has them."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    with np.errstate(all="ignore"):
        t = np.where(len2 == 0, 0.0, np.clip(((px - x1) * dx + (py - y1) * dy) / len2, 0.0, 1.0))
    x, y = x1 + t * dx, y1 + t * dy
    return t, x, y, (px - x) * (px - x) + (py - y) * (py - y)


def met_by_segments(places: Places, maps: np.ndarray, line: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pad: float, over: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segment, place) of all places within ``pad`` of a segment of their map, or up to ``over`` above it, and some more."""
    x1, y1, x2, y2 = line
    w = places.width
    with np.errstate(all="ignore"):
        first, last = np.floor((np.minimum(x1, x2) - pad) / w), np.floor((np.maximum(x1, x2) + pad) / w)
        slope = np.where(x1 == x2, 0.0, (y2 - y1) / (x2 - x1))
    far = ~((np.abs(first) < 1 << 31) & (np.abs(last) < 1 << 31))
    if far.any():
        raise Refused(maps[far])
    n = (last - first).astype(np.int64) + 1
    refuse_more(maps, n, STRIPS)
    met = np.zeros(int(maps.max()) + 1 if len(maps) else 0)
    low_x, high_x = np.minimum(x1, x2), np.maximum(x1, x2)
    low_y, high_y = np.minimum(y1, y2), np.maximum(y1, y2)
    # A hair of slack keeps rounding at borders from losing a place; more are harmless.
    hair = 1e-9 * (1.0 + high_y - low_y + np.abs(y1) + np.abs(y2)) + 1e-6 * w
    for part in parts_of(n):
        of, step = spread(n[part])
        s = part.start + of
        strip = first[s].astype(np.int64) + step
        left, right = np.clip(strip * w - pad, low_x[s], high_x[s]), np.clip((strip + 1) * w + pad, low_x[s], high_x[s])
        ya, yb = y1[s] + (left - x1[s]) * slope[s], y1[s] + (right - x1[s]) * slope[s]
        steep = x1[s] == x2[s]
        low = np.where(steep, low_y[s], np.maximum(np.minimum(ya, yb) - hair[s], low_y[s])) - pad - hair[s]
        high = np.where(steep, high_y[s], np.minimum(np.maximum(ya, yb) + hair[s], high_y[s])) + pad + hair[s]
        if over is not None:
            high = high + over[s]
        a, b = places.between(maps[s], strip, low, high)
        some = b > a
        a, k, s = a[some], (b - a)[some], s[some]
        met += np.bincount(maps[s], k, len(met))
        if (met > PAIRS).any():
            raise Refused(np.flatnonzero(met > PAIRS))
        for sheet in parts_of(k):
            of, step = spread(k[sheet])
            i = sheet.start + of
            yield s[i], places.order[a[i] + step]


class Net:
    """Dense lines of some maps, in order of map, line and vertex; a map with another row is refused."""

    def __init__(self, c: Columns, maps: np.ndarray):
        order = np.lexsort((c["idx"], c["feature_id"], maps))
        self.maps, self.line_id, self.idx = maps[order], c["feature_id"][order], c["idx"][order]
        self.x, self.y = c["x"][order], c["y"][order]
        new = np.ones(len(order), bool)
        new[1:] = (self.maps[1:] != self.maps[:-1]) | (self.line_id[1:] != self.line_id[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(order)))
        self.of = np.cumsum(new) - 1
        bad = ~(np.isfinite(self.x) & np.isfinite(self.y)) | (self.idx != np.arange(len(order)) - self.first[self.of])
        if bad.any():
            raise Refused(self.maps[bad])
        #: Of each line: its map, id and last position.
        self.line_map, self.ids, self.top = self.maps[self.first], self.line_id[self.first], self.size - 1

    def segments(self) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Line and position of each segment, and its ends; its first vertex's row is ``first[line] + seg``."""
        at = np.flatnonzero(self.idx < self.top[self.of])
        return self.of[at], self.idx[at], (self.x[at], self.y[at], self.x[at + 1], self.y[at + 1])

    def lengths(self) -> np.ndarray:
        """Distance along its line up to each vertex, added up in order."""
        step = np.zeros(len(self.x))
        step[1:] = np.hypot(np.diff(self.x), np.diff(self.y))
        step[self.first] = 0.0
        out = step.copy()
        some = np.flatnonzero(self.top >= 1)
        short = some[self.top[some] < 64]
        for k in range(1, int(self.top[short].max(initial=0)) + 1):
            at = self.first[short[self.top[short] >= k]] + k
            out[at] = out[at - 1] + step[at]
        for k in some[self.top[some] >= 64]:
            own = slice(self.first[k], self.first[k] + self.size[k])
            out[own] = np.cumsum(step[own])
        return out

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, side and row of both ends of the lines with two vertices."""
        two = np.flatnonzero(self.top >= 1)
        line, side = np.repeat(two, 2), np.tile(np.array([0, 1]), len(two))
        return line, side, self.first[line] + side * self.top[line]


def spots_of(maps: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places in order of (map, x, y): the first row of each, and the place of every row."""
    order = np.lexsort((y, x, maps))
    new = np.ones(len(order), bool)
    m, a, b = maps[order], x[order], y[order]
    new[1:] = (m[1:] != m[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    spot = np.empty(len(order), np.int64)
    spot[order] = np.cumsum(new) - 1
    return order[new], spot


def least_and_greatest(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group 0 to ``n - 1``."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, group, value)
    np.maximum.at(high, group, value)
    return low, high


def linked_spots(maps: np.ndarray, x: np.ndarray, y: np.ndarray, line: np.ndarray, tolerance: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of ends, and the pairs of them within tolerance: (first row of each place, place of each row, a, b).

    Two places of one and the same lone line are no pair unless ``own``.
    """
    head, spot = spots_of(maps, x, y)
    low, high = least_and_greatest(spot, line, len(head))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if tolerance > 0:
        for i, j in near_pairs(maps[head], x[head], y[head], tolerance):
            ok = own | ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            a.append(i[ok])
            b.append(j[ok])
    return head, spot, np.concatenate(a), np.concatenate(b)


class Clusters:
    """Ends of lines tied by places within tolerance: of each end (row ``k``) its place's root, its cluster's size and mean."""

    def __init__(self, maps: np.ndarray, x: np.ndarray, y: np.ndarray, line: np.ndarray, tolerance: float, own: bool):
        head, spot, a, b = linked_spots(maps, x, y, line, tolerance, own)
        self.root = components(len(head), a, b)[spot]
        n = np.bincount(self.root, minlength=len(head))
        low, high = least_and_greatest(self.root, line, len(head))
        paired = (n >= 2 if own else low != high)[self.root]
        mean = lambda v: (np.bincount(self.root, v, len(head)) / np.maximum(n, 1))[self.root]
        self.size = np.where(paired, n[self.root], 1)
        self.cx, self.cy = np.where(paired, mean(x), x), np.where(paired, mean(y), y)
        self.root_x, self.root_y = x[head][self.root], y[head][self.root]


def nearest(maps: np.ndarray, x: np.ndarray, y: np.ndarray, line: np.ndarray, seg_map: np.ndarray, seg_line: np.ndarray, seg: np.ndarray, path: tuple, tolerance: float) -> tuple[np.ndarray, ...]:
    """For places of lines: the nearest segment of another line within tolerance, ties by line then position.

    (place, segment's number, t, x, y, d2) of those that have one. ``line`` and ``seg_line`` are numbers in order of the lines' ids.
    """
    real = np.flatnonzero((path[0] != path[2]) | (path[1] != path[3]))
    sm, sl = seg_map[real], seg_line[real]
    ends = tuple(p[real] for p in path)
    got: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (int, int, float, float, float, float))]
    for s, p in met_by_segments(Places(maps, x, y, 4 * tolerance), sm, ends, tolerance):
        other = sl[s] != line[p]
        s, p = s[other], p[other]
        t, hx, hy, d2 = project(x[p], y[p], *(e[s] for e in ends))
        ok = d2 <= tolerance * tolerance
        got.append((p[ok], real[s[ok]], t[ok], hx[ok], hy[ok], d2[ok]))
    p, s, t, hx, hy, d2 = (np.concatenate(k) for k in zip(*got))
    order = np.lexsort((hy, hx, t, seg[s], seg_line[s], d2, p))
    best = order[np.diff(p[order], prepend=-1) != 0]
    return tuple(k[best] for k in (p, s, t, hx, hy, d2))
