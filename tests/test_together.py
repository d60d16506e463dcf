"""Whole maps in one task against the joins through cells, and maps that are too large or unfit for a task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import hits as H
from cairnfield.operators import lines as L
from cairnfield.operators import together
from cairnfield.operators import topology as T
from cairnfield.operators import trace as R

V = "map_id long, feature_id long, idx long, x double, y double"
TOL = 8.0


def net(spark, maps=5, lines=45, side=220):
    """Short lines on a coarse grid, so that ends share places, lie near each other, run into segments, close rings and stack up."""
    rng = random.Random(11)
    rows = []
    for m in range(maps):
        for f in range(lines):
            pts = [(rng.randrange(side // 5) * 5.0, rng.randrange(side // 5) * 5.0 + rng.choice([0.0, 0.0, 0.3])) for _ in range(rng.randint(1, 6))]
            if rng.random() < 0.1 and len(pts) > 2:
                pts.append(pts[0])
            rows += [(m, f * 7 + m, i, x, y) for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, V)


def table(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, tuple) else x for x in r) for r in df.select(*sorted(df.columns)).collect())


def all_of(v, picked):
    ends = T.endpoint_clusters(v, TOL)
    joined = T.auto_join(v, picked, TOL)
    return [
        table(ends), table(T.nearest_segment(ends.where("size < 2"), L.segments(v), TOL)), table(T.maps_needing_cleanup(v, 0.5)), table(T.snap_ends(v, TOL)),
        *(table(joined[k]) for k in ("vertices", "removed", "counts", "ambiguous")),
    ]


def test_maps_in_one_task_are_as_by_cells(spark, monkeypatch):
    v = net(spark).repartition(3).cache()
    picked = v.where("feature_id % 5 <> 2").select("map_id", "feature_id")
    whole = all_of(v, picked)
    assert all(whole)
    monkeypatch.setattr(T, "numbered_ids", lambda *_: False)
    assert whole == all_of(v, picked)


@pytest.mark.parametrize("name, value", [("MAP_ROWS", 90), ("GROUP_ROWS", 1)])
def test_maps_that_a_task_refuses_go_through_cells(spark, monkeypatch, name, value):
    v = net(spark, 4, 40).unionByName(net(spark, 1, 9).withColumn("map_id", F.lit(9).cast("long"))).cache()
    want = table(T.snap_ends(v, TOL))
    met = []
    by_cells = T._snap_by_cells
    monkeypatch.setattr(T, "_snap_by_cells", lambda rest, tol: met.append(rest.select("map_id").distinct().count()) or by_cells(rest, tol))
    monkeypatch.setattr(together, name, value)
    assert want == table(T.snap_ends(v, TOL))
    assert met == ([4] if name == "MAP_ROWS" else [])


@pytest.mark.parametrize("name, value", [("PAIRS", 300), ("STRIPS", 5000), ("SHEET", 3)])
def test_crowded_maps_are_refused_and_sheets_change_nothing(monkeypatch, name, value):
    rng = np.random.default_rng(5)
    n = 4 * 60
    maps, line, idx = np.repeat([0, 1, 2], n), np.tile(np.repeat(np.arange(60), 4), 3), np.tile(np.arange(4), n * 3 // 4)
    x, y = rng.uniform(0, 300, n * 3), rng.uniform(0, 300, n * 3)
    x[maps == 1], y[maps == 1] = x[maps == 1] * 100, y[maps == 1] * 100
    c = {"feature_id": line, "idx": idx, "x": x, "y": y}
    want = T._snap_together(TOL, c, maps)
    monkeypatch.setattr(together, name, value)
    if name == "SHEET":
        got = T._snap_together(TOL, c, maps)
        assert all(np.array_equal(want[k], got[k]) for k in want) and len(want["x"])
    else:
        with pytest.raises(together.Refused) as no:
            T._snap_together(TOL, c, maps)
        assert list(no.value.maps) == ([1] if name == "STRIPS" else [0, 2])


def test_one_shuffle_by_map(spark):
    """Rows leave their tasks once, by map: nothing else in the plan moves them."""
    v = net(spark)
    plans = []
    keep = together.cut
    together.cut = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
    try:
        T.snap_ends(v, TOL)
    finally:
        together.cut = keep
    assert len(plans) == 1 and plans[0].count("Exchange") == 1


def test_odd_places_and_gaps_are_left_to_the_joins(spark):
    odd = [(1, 1, 0, 0.0, 0.0), (1, 1, 1, float("nan"), 5.0), (2, 1, 0, 0.0, 0.0), (2, 1, 2, 5.0, 5.0), (3, 1, 0, 0.0, 0.0), (3, 1, 1, 50.0, 0.0), (3, 2, 0, 3.0, 0.0), (3, 2, 1, 60.0, 60.0)]
    v = spark.createDataFrame(odd, V)
    got = {(r.map_id, r.feature_id, r.idx): (r.x, r.y) for r in T.snap_ends(v, TOL).where("map_id = 3").collect()}
    assert got[3, 1, 0] == got[3, 2, 0] == (1.5, 0.0)
    assert T.endpoint_clusters(v, TOL).where("map_id < 3").count() == 4


def test_nearest_feature_in_one_task_is_as_by_cells(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for m in range(2):
        for f in range(40):
            kind, n = rng.choice([("trail", 4), ("area", 5), ("area", 1), ("poi", 1)])
            rows += [(m, f, i, rng.randrange(40) * 10.0, rng.randrange(40) * 10.0, kind) for i in range(n)]
    v = spark.createDataFrame(rows, f"{V}, kind string").cache()
    points = spark.createDataFrame([(m, k, rng.randrange(80) * 5.0, rng.randrange(80) * 5.0) for m in range(3) for k in range(300)], "map_id long, pid long, x double, y double").cache()
    got = table(H.nearest_feature(points, v, ["pid"]))
    monkeypatch.setattr(H, "numbered_ids", lambda *_: False)
    assert got == table(H.nearest_feature(points, v, ["pid"])) and len(got) > 300


def test_evidence_in_one_task_is_as_by_join(spark, monkeypatch):
    rng = random.Random(13)
    px = spark.createDataFrame([(m, x, y, *rng.choice([(200, 30, 30), (215, 40, 30), (240, 236, 220)])) for m in range(2) for x in range(30) for y in range(30)], "map_id long, x int, y int, r int, g int, b int")
    v = spark.createDataFrame([(m, f, i, rng.uniform(-4, 34), rng.uniform(-4, 34)) for m in range(2) for f in range(9) for i in range(f % 4 + 1)], V).withColumnRenamed("feature_id", "candidate_id")
    chips = spark.createDataFrame([(m, k, 200 - k, 30, 30 + k) for m in range(2) for k in (1, 2)], "map_id long, chip_id int, r int, g int, b int")
    cands = v.select("map_id", "candidate_id").distinct().withColumns({"chip_id": (F.col("candidate_id") % 2 + 1).cast("int"), "length_px": F.lit(50.0), "min_length_px": F.lit(20.0), "tolerance": F.lit(40.0)})
    run = lambda most: table(R.candidate_confidence(cands, v, px, chips, most))
    got = run(None), run(5)
    monkeypatch.setattr(R, "numbered_ids", lambda *_: False)
    assert got == (run(None), run(5)) and len(got[0]) == 18 and len({r[1] for r in got[0]}) > 6
