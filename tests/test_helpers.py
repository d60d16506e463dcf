"""Ordered, graph and line helpers against plain Python on small data."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cairnfield.functions.text import fixed
from cairnfield.operators import ordered
from cairnfield.operators.graph import connected_components, greedy_match, list_rank
from cairnfield.operators.lines import _within
from cairnfield.operators.simplify import _keep_in_range, keep_vertices, renumber


def test_running_and_next_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 4)
    values = [random.Random(1).randint(-5, 9) for _ in range(70)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, idx bigint, v bigint")
    got = {r.idx: r.s for r in ordered.running(df, ["k"], F.col("v"), "s").collect()}
    assert [got[i] for i in range(70)] == list(np.cumsum(values))
    top = {r.idx: r.s for r in ordered.running(df, ["k"], F.col("v"), "s", how="max").collect()}
    assert [top[i] for i in range(70)] == list(np.maximum.accumulate(values))
    nxt = {r.idx: r.n for r in ordered.with_next(df, ["k"], {"v": "n"}).collect()}
    assert [nxt[i] for i in range(69)] == values[1:] and nxt[69] is None


def test_number_rows_is_row_number(spark):
    rows = [(i % 3, (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, v int")
    for k in range(3):
        want = {v: n + 1 for n, v in enumerate(sorted(v for a, v in rows if a == k))}
        got = {r.v: r.rn for r in ordered.number_rows(df, ["k"], [F.col("v")]).where(f"k = {k}").collect()}
        assert got == want


def test_components_and_list_rank(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(30)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for e in edges for x in e if any(x in g and g[0] != g[1] for g in edges)}
    assert got == want
    nodes = spark.createDataFrame([(i, i + 1 if i < 22 else None) for i in range(23)], "id bigint, nxt bigint")
    assert {r.id: r["rank"] for r in list_rank(nodes).collect()} == {i: 22 - i for i in range(23)}


def test_greedy_match_equals_walk(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 20), rng.randint(0, 20), rng.random()) for _ in range(60)]
    links = [x for x in links if x[0] != x[1]]
    used, want = set(), set()
    for a, b, d in sorted(links, key=lambda t: (t[2], t[0], t[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = greedy_match(spark.createDataFrame(links, "a int, b int, d double"), ["d"])
    assert {(r.a, r.b) for r in got.collect()} == want


def test_long_lines_split_like_short_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 200
    x, y = np.arange(n, dtype=float), rng.normal(0, 3, n).cumsum()
    keep = sorted({0, n - 1, *_keep_in_range(np.arange(n), x, y, 2.0)})
    df = spark.createDataFrame([(1, 1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "map_id int, feature_id int, idx bigint, x double, y double")
    from cairnfield.operators import simplify

    monkeypatch.setattr(simplify, "CHUNK", 16)
    monkeypatch.setattr(ordered, "CHUNK", 16)
    got = sorted(r.idx for r in keep_vertices(df, 2.0, F.lit(False)).collect())
    assert got == keep
    again = renumber(df.where("idx % 3 = 0")).orderBy("idx").collect()
    assert [r.x for r in again] == [float(v) for v in range(0, n, 3)]


def test_near_interval_against_sampling(spark):
    """The interval of a segment near another one: its ends are at the tolerance, all samples agree."""
    rng = random.Random(5)
    # The first pair just leaves the other's start before its own end.
    rows = [(0, 1545.0, 1268.0, 219.0, 236.0, 218.0, 241.0, 50.0, 368.0)]
    for i in range(1, 1500):
        p = [rng.choice([rng.uniform(0, 40), float(rng.randint(0, 12))]) for _ in range(8)]
        if i % 5 == 0:
            p[5], p[1] = p[7], p[3]
        if i % 7 == 0:
            p[6:8] = p[4:6]
        if i % 11 == 0:
            p[4:8] = p[0:4]
        rows.append((i, *p))
    pairs = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double, u1 double, w1 double, u2 double, w2 double")
    got = {r.id: (r.lo, r.hi) for r in _within(pairs, 5.0).collect()}

    def away(x1, y1, x2, y2, u1, w1, u2, w2, t):
        x, y, vx, vy = x1 + (x2 - x1) * t - u1, y1 + (y2 - y1) * t - w1, u2 - u1, w2 - w1
        k = max(0.0, min(1.0, (x * vx + y * vy) / (vx * vx + vy * vy))) if vx or vy else 0.0
        return math.hypot(x - k * vx, y - k * vy)

    for i, *p in rows:
        if p[0:2] == p[2:4]:
            assert i not in got
            continue
        near = [k / 500 for k in range(501) if away(*p, k / 500) <= 5]
        if i not in got:
            assert len(near) < 2
            continue
        lo, hi = got[i]
        assert lo == 0 or abs(away(*p, lo) - 5) < 1e-6
        assert hi == 1 or abs(away(*p, hi) - 5) < 1e-6
        assert away(*p, lo) < 5 + 1e-6 and away(*p, hi) < 5 + 1e-6
        assert not near or (near[0] >= lo - 1e-9 and near[-1] <= hi + 1e-9)


def test_fixed_rounds_as_printf_does(spark):
    values = [1.25, 1.35, 250.125, 250.375, 0.125, -0.125, 0.05, 2.5, 3.5, 146625.0 / 1000, 1.005, 8.345, -1234.5678905]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[fixed(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 6)]).collect()
    for row in rows:
        assert [row[f"d{d}"] for d in (0, 1, 2, 6)] == [f"{row.v:.{d}f}" for d in (0, 1, 2, 6)]
