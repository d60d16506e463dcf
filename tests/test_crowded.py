"""Pairs of boxes in crowded cells, near intervals and unions against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnfield.functions.plane import project_on_segment
from cairnfield.operators import lines as L
from cairnfield.operators.grid import met_in_cells, paired_boxes

BOX = "k string, {0}id long, {0}l double, {0}t double, {0}r double, {0}b double"


def boxes(rng, n, spread, sides):
    out = []
    for k in range(n):
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        out.append((rng.choice("ab"), k, x, y, x + rng.choice(sides), y + rng.choice(sides)))
    return out


def pairs(spark, a, b, **more):
    da, db = spark.createDataFrame(a, BOX.format("p")), spark.createDataFrame(b, BOX.format("q"))
    c = F.col
    got = paired_boxes(da, db, ["k"], (c("pl"), c("pt"), c("pr"), c("pb")), (c("ql"), c("qt"), c("qr"), c("qb")), **more)
    return got


def brute(a, b):
    return sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[4] and y[2] <= x[4] and x[3] <= y[5] and y[3] <= x[5])


@pytest.mark.parametrize("spread, sides, load", [(100.0, [0.0, 1.0, 5.0], 50), (3.0, [0.0, 0.5], 40), (1000.0, [0.0, 2.0, 900.0], 100), (0.0, [0.0], 100)])
def test_each_pair_once_however_crowded(spark, spread, sides, load):
    rng = random.Random(3)
    a, b = boxes(rng, 150, spread, sides), boxes(rng, 120, spread, sides)
    got = sorted((r.pid, r.qid) for r in pairs(spark, a, b, load=load).select("pid", "qid").collect())
    assert got == brute(a, b)


def test_no_task_compares_a_whole_crowded_cell(spark):
    # All boxes in one place: the largest group of one join key stays within the stated bound.
    a, b = [("a", k, 5.0, 5.0, 6.0, 6.0) for k in range(400)], [("a", k, 5.5, 5.5, 7.0, 7.0) for k in range(300)]
    df = pairs(spark, a, b, load=1000)
    assert df.count() == 120_000
    assert "distinct" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    # Half the boxes far away from a crowd that can be parted: quarters are split, and nothing is lost.
    rng = random.Random(4)
    a, b = boxes(rng, 300, 1.0, [0.01]) + boxes(rng, 20, 1e6, [0.01]), boxes(rng, 300, 1.0, [0.01])
    got = sorted((r.pid, r.qid) for r in pairs(spark, a, b, load=60).select("pid", "qid").collect())
    assert got == brute(a, b)


def test_empty_and_null_boxes(spark):
    rows = [("a", 1, None, 0.0, 1.0, 1.0), (None, 2, 0.0, 0.0, 1.0, 1.0), ("a", 3, 0.0, 0.0, 1.0, 1.0)]
    assert [(r.pid, r.qid) for r in pairs(spark, rows, [("a", 9, 1.0, 1.0, 2.0, 2.0)]).collect()] == [(3, 9)]
    assert pairs(spark, [], rows).count() == 0


def test_union_length_merges_in_tasks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(3), lo := rng.randrange(60) / 4, lo + rng.randrange(1, 12) / 4) for _ in range(200)]
    monkeypatch.setattr(L, "MERGE_ROWS", 16)
    df = spark.createDataFrame(rows, "k string, j int, lo double, hi double").repartition(3)
    got = {(r.k, r.j): r.covered for r in L.union_length(df, ["k", "j"]).collect()}
    want = {}
    for k, j in {(r[0], r[1]) for r in rows}:
        want[k, j] = sum(any(lo <= q / 4 < hi for a, b, lo, hi in rows if (a, b) == (k, j)) for q in range(100)) / 4
    assert got == pytest.approx(want)


def _nearest(p, e):
    dx, dy = e[2] - e[0], e[3] - e[1]
    t = max(0.0, min(1.0, ((p[0] - e[0]) * dx + (p[1] - e[1]) * dy) / (dx * dx + dy * dy)))
    return (p[0] - e[0] - t * dx) ** 2 + (p[1] - e[1] - t * dy) ** 2


@pytest.mark.parametrize("together", [1_000_000, 90])
def test_cells_are_listed_behind_the_shuffle(spark, together):
    rng = random.Random(6)
    p = [(k % 3, k, rng.uniform(-300, 300), rng.uniform(-300, 300)) for k in range(300)]
    e = [(k % 3, k, *(rng.uniform(-300, 300) for _ in range(4))) for k in range(250)]
    points, segs = spark.createDataFrame(p, "m long, p long, x double, y double"), spark.createDataFrame(e, "m long, s long, x1 double, y1 double, x2 double, y2 double")
    plans = []

    def then(met):
        d2 = project_on_segment(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))["d2"]
        plans.append(met._jdf.queryExecution().executedPlan().toString())
        return met.where(d2 <= 64).select("p", "s")

    got = sorted((r.p, r.s) for r in met_in_cells(points, segs, ["m"], 32.0, 8.0, then, together=together).collect())
    assert got == sorted((a[1], b[1]) for a in p for b in e if a[0] == b[0] and _nearest(a[2:], b[2:]) <= 64)
    assert "_cx" not in "".join(x.split("Exchange hashpartitioning(")[1].split("]")[0] for x in plans[0].split("\n") if "Exchange hashpartitioning(" in x)


def test_nearest_segments_and_hausdorff_are_the_same_by_list_and_by_cell(spark, monkeypatch):
    rng = random.Random(7)
    v = [(1, k, i, rng.uniform(0, 900), rng.uniform(0, 900)) for k in (1, 2, 3) for i in range(9)]
    lines = spark.createDataFrame(v, "map_id long, feature_id long, idx long, x double, y double")
    at = spark.createDataFrame([(1, k % 3 + 1, k, rng.uniform(-500, 900), rng.uniform(0, 900)) for k in range(30)], "map_id long, feature_id long, p long, x double, y double")
    a, b = (lines.where(f"feature_id = {k}").drop("feature_id") for k in (1, 2))
    out = []
    for load in (1_000_000, 1):
        monkeypatch.setattr(L, "LOAD", load)
        out.append((sorted(map(tuple, L.project_points(at, lines, ["p"]).collect())), L.hausdorff(a, b, 20.0, ["map_id"]).collect()[0].hausdorff))
    assert len(out[0][0]) == 30 and out[0][0] == out[1][0] and out[0][1] == pytest.approx(out[1][1])


def test_stations_on_vertices_are_one(spark, monkeypatch):
    v = spark.createDataFrame([(1, 1, i, x, 0.0) for i, x in enumerate([0.0, 10.0, 10.0, 25.0, 30.0])] + [(1, 2, 0, 5.0, 5.0)], "map_id long, feature_id long, idx long, x double, y double")
    pin = spark.createDataFrame([(1, 1, 1), (1, 1, 3)], "map_id long, feature_id long, idx long")
    for chunk in (4096, 2):
        monkeypatch.setattr(L, "CHUNK", chunk)
        got = sorted((r.feature_id, r.d, r.x, r.pinned) for r in L.stations(v, 5.0, pin).collect())
        assert got == [(1, 5.0 * k, 5.0 * k, k in (0, 2, 5, 6)) for k in range(7)] + [(2, 0.0, 5.0, True)]
        plan = L.stations(v, 5.0)._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan.split("Aggregate")[0]


def test_two_lists_of_edges_meet_in_arrays(spark):
    rng = random.Random(8)
    rows = [(k, s, i, rng.uniform(0, 200), rng.uniform(0, 200)) for k in range(40) for s in (0, 1) for i in range(rng.randint(1, 6))]
    v = spark.createDataFrame(rows, "k long, s int, idx long, x double, y double")
    df = L.hausdorff(v.where("s = 0").drop("s"), v.where("s = 1").drop("s"), 7.0, ["k"])
    assert "array_min" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k in range(40):
        line = [[(x, y) for q, t, _, x, y in rows if (q, t) == (k, s)] for s in (0, 1)]
        edges = [list(zip(p, p[1:])) or [(p[0], p[0])] for p in line]
        far = 0.0
        for own, other in (edges, edges[::-1]):
            for (ax, ay), (bx, by) in own:
                n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / 7.0))
                for i in range(n + 1):
                    p = (ax + (bx - ax) * i / n, ay + (by - ay) * i / n)
                    far = max(far, min(math.dist(p, a) ** 2 if a == b else _nearest(p, (*a, *b)) for a, b in other))
        want[k] = math.sqrt(far)
    assert {r.k: r.hausdorff for r in df.collect()} == pytest.approx(want)
