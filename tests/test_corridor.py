"""Refining along the corridor against a plain search with a heap, and against the drawn truth."""

import heapq
import math
import random

import numpy as np
import pytest

from cairnfield.operators import corridor as K
from cairnfield.operators.simplify import _keep_in_range

W, H, INK, TOL, CORRIDOR = 420, 130, (200, 30, 40), 60.0, 12.0


def _truth(x):
    return 65 + 30 * math.sin(x / 45)


def _raster(seed=4, dash=None):
    rng = random.Random(seed)
    near = {}
    for k in range(8 * W):
        x = k / 8
        if dash and int(x) % dash[0] >= dash[1]:
            continue
        for dy in (-1, 0, 1):
            near[round(x), round(_truth(x)) + dy] = True
    noise = lambda: rng.randint(-9, 9)
    return {(x, y): tuple(max(0, min(255, v + noise())) for v in (INK if (x, y) in near else (236, 240, 228))) for x in range(W) for y in range(H)}


def _hand(seed=2, step=10):
    rng = random.Random(seed)
    return [(float(x), _truth(x) + rng.uniform(-4, 4)) for x in range(10, W - 9, step)]


def _at(pts, d):
    for (ax, ay), (bx, by) in zip(pts, pts[1:]):
        n = math.hypot(bx - ax, by - ay)
        if d <= n or (bx, by) == pts[-1]:
            return ax + (bx - ax) * min(1, d / n), ay + (by - ay) * min(1, d / n)
        d -= n


def _search(img, hand):
    """Cheapest way from the first to the last point of ``hand`` by a heap of open pixels."""
    def away(x, y):
        best = math.inf
        for (ax, ay), (bx, by) in zip(hand, hand[1:]):
            vx, vy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((x - ax) * vx + (y - ay) * vy) / ((vx * vx + vy * vy) or 1.0)))
            best = min(best, math.hypot(x - ax - t * vx, y - ay - t * vy))
        return best

    half = lambda p: (math.floor(p[0] + 0.5), math.floor(p[1] + 0.5))
    start, goal = half(hand[0]), half(hand[-1])
    dist, back, open_, closed = {start: 0.0}, {}, [(0.0, start)], set()
    while open_:
        d, p = heapq.heappop(open_)
        if p in closed:
            continue
        closed.add(p)
        if p == goal:
            break
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                q = (p[0] + dx, p[1] + dy)
                if q == p or q not in img or away(*q) > CORRIDOR:
                    continue
                price = 0.0 if p == start else math.dist(img[q], INK) / TOL + (away(*q) / CORRIDOR) ** 2 * 2
                new = d + math.hypot(dx, dy) * (0.2 + price)
                if new < dist.get(q, math.inf):
                    dist[q], back[q] = new, p
                    heapq.heappush(open_, (new, q))
    way = [goal]
    while way[-1] != start:
        way.append(back[way[-1]])
    return way[::-1]


def _plain(img, pts, pins=()):
    """The whole refinement of one line in plain Python."""
    far = np.concatenate([[0], np.cumsum([math.dist(a, b) for a, b in zip(pts, pts[1:])])])
    held = {0.0: pts[0], float(far[-1]): pts[-1], **{float(far[k]): pts[k] for k in pins}}
    stops = sorted({*held, *(60.0 * k for k in range(1, int(far[-1] // 60) + 1))})
    places = []
    for d in stops:
        p = held.get(d) or _at(pts, d)
        if d not in held:
            lo, hi = [math.floor(v - CORRIDOR) for v in p], [math.ceil(v + CORRIDOR) for v in p]
            price, y, x = min((math.dist(img[x, y], INK) + math.hypot(x - p[0], y - p[1]) * TOL / CORRIDOR, y, x) for y in range(lo[1], hi[1] + 1) for x in range(lo[0], hi[0] + 1) if (x, y) in img)
            p = (float(x), float(y)) if price <= TOL else p
        places.append(p)
    out, runs = [places[0]], []
    for k in range(1, len(stops)):
        inner = [_at(pts, stops[k - 1] + 10 * j) for j in range(1, 7) if stops[k - 1] + 10 * j < stops[k]]
        way = _search(img, [places[k - 1], *inner, places[k]])
        share = sum(math.dist(img[p], INK) <= TOL for p in way) / len(way)
        if share >= 0.6:
            x, y = (np.array(a, float) for a in zip(*way))
            out += [tuple(map(float, way[i])) for i in sorted({len(way) - 1, *_keep_in_range(np.arange(len(way)), x, y, 0.9)})]
        else:
            out.append(places[k])
        runs.append((len(out) - 1, share))
    return out, runs


def _frames(spark, img, lines):
    px = spark.createDataFrame([(1, x, y, *v) for (x, y), v in img.items()], "map_id int, x int, y int, r int, g int, b int")
    v = spark.createDataFrame([(1, f, k, *p) for f, pts in lines.items() for k, p in enumerate(pts)], "map_id int, feature_id string, idx bigint, x double, y double")
    maps = spark.createDataFrame([(1, W, H)], "map_id int, width int, height int")
    return v, px, maps


def _line(out, f):
    return [(r.x, r.y) for r in out["vertices"].where(f"feature_id = '{f}'").orderBy("idx").collect()]


def test_cheapest_way_costs_what_a_heap_finds():
    rng = np.random.default_rng(3)
    for _ in range(20):
        cost = rng.uniform(0, 3, (rng.integers(1, 14), rng.integers(1, 14)))
        cost[rng.random(cost.shape) < 0.2] = np.inf
        cost[0, 0], cost[-1, -1] = 1.0, 1.0
        goal = (cost.shape[0] - 1, cost.shape[1] - 1)
        dist, open_ = {(0, 0): 0.0}, [(0.0, (0, 0))]
        while open_:
            d, p = heapq.heappop(open_)
            for q in [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]:
                if 0 <= q[0] <= goal[0] and 0 <= q[1] <= goal[1] and np.isfinite(cost[q]):
                    new = d + math.dist(p, q) * (0.2 + (0 if p == (0, 0) else cost[q]))
                    if new < dist.get(q, math.inf):
                        dist[q] = new
                        heapq.heappush(open_, (new, q))
        way = K.cheapest_way(cost, (0, 0), goal)
        if goal not in dist:
            assert way is None
            continue
        assert way[0] == (0, 0) and way[-1] == goal
        price = sum(math.dist(p, q) * (0.2 + (0 if p == (0, 0) else cost[q])) for p, q in zip(way, way[1:]))
        assert price == pytest.approx(dist[goal], abs=1e-9)


def test_refined_line_equals_a_plain_search(spark):
    img, pts = _raster(), _hand()
    v, px, maps = _frames(spark, img, {"a": pts, "b": pts})
    inks = spark.createDataFrame([(1, f, *INK) for f in "ab"], "map_id int, feature_id string, ink_r int, ink_g int, ink_b int")
    pins = spark.createDataFrame([(1, "b", 11), (1, "b", 25)], "map_id int, feature_id string, idx bigint")
    out = K.refine_paths(v, px, maps, inks, CORRIDOR, TOL, pins)
    for f, held in (("a", ()), ("b", (11, 25))):
        want, runs = _plain(img, pts, held)
        np.testing.assert_allclose(_line(out, f), want, atol=1e-9)
        got = out["runs"].where(f"feature_id = '{f}'").orderBy("idx").collect()
        assert [r["last"] for r in got] == [n for n, _ in runs] and [r.confidence for r in got] == pytest.approx([s for _, s in runs])
        assert [r["first"] for r in got] == [0, *[n for n, _ in runs[:-1]]]
    assert {(120.0, float(round(pts[11][1]))), (260.0, float(round(pts[25][1])))} <= set(_line(out, "b"))


@pytest.mark.parametrize("dash", [None, (14, 9)])
def test_hand_drawn_line_comes_within_two_pixels_of_the_truth(spark, dash):
    img, pts = _raster(dash=dash), _hand(9)
    v, px, maps = _frames(spark, img, {"a": pts})
    inks = spark.createDataFrame([(1, "a", *INK)], "map_id int, feature_id string, ink_r int, ink_g int, ink_b int")
    line = _line(K.refine_paths(v, px, maps, inks, CORRIDOR, TOL), "a")
    drawn = [_at(line, d) for d in np.arange(0, sum(math.dist(a, b) for a, b in zip(line, line[1:])), 1.0)]
    truth = [(x / 2, _truth(x / 2)) for x in range(20, 2 * (W - 10))]
    close = lambda a, b: sum(min(math.dist(p, q) for q in b) <= 2 for p in a) / len(a)
    assert close(drawn, truth) >= 0.95 and close(truth, drawn) >= 0.95


def test_lines_without_support_stay(spark):
    """No ink known, ink of another colour, one vertex, outside the raster, and a hole that no way crosses."""
    img = {p: v for p, v in _raster().items() if not 200 <= p[0] < 230}
    far = [(-90.0, -50.0), (-20.0, -50.0)]
    level = [(150.0, 64.0), (170.0, 64.0), (260.0, 64.0)]
    v, px, maps = _frames(spark, img, {"none": _hand()[:9], "other": _hand()[:9], "dot": [(5.0, 5.0)], "far": far, "hole": level})
    inks = spark.createDataFrame([(1, "none", None, None, None), (1, "other", 0, 0, 255), *[(1, f, *INK) for f in ("dot", "far", "hole")]], "map_id int, feature_id string, ink_r int, ink_g int, ink_b int")
    out = K.refine_paths(v, px, maps, inks, CORRIDOR, TOL)
    for f, pts in {"none": _hand()[:9], "other": _hand()[:9], "dot": [(5.0, 5.0)], "far": far, "hole": level}.items():
        assert _line(out, f) == pts, f
    got = {(r.feature_id, r.idx, r["first"], r["last"], r.refined, r.confidence) for r in out["runs"].collect()}
    assert got == {("none", 1, 0, 8, False, 0.0), ("other", 1, 0, 8, False, 0.0), ("far", 1, 0, 1, False, 0.0), ("hole", 1, 0, 2, False, 0.0)}


def test_no_lines(spark):
    v, px, maps = _frames(spark, {(0, 0): INK}, {"a": [(0.0, 0.0)]})
    inks = spark.createDataFrame([], "map_id int, feature_id string, ink_r int, ink_g int, ink_b int")
    out = K.refine_paths(v.limit(0), px, maps, inks, CORRIDOR, TOL)
    assert out["vertices"].count() == 0 and out["runs"].count() == 0
