"""Steps whose cost must not grow faster than their tables."""

import random

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import anchors as A
from cairnfield.operators import lines as L
from cairnfield.operators import ordered
from cairnfield.operators import pixels as P
from cairnfield.operators import simplify as simple
from cairnfield.operators import trace as T
from cairnfield.session import cut, small_broadcasts
from cairnfield.streaming import live as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_demand_is_made_unique_before_it_meets_maps(spark):
    rng = random.Random(5)
    fixes = [(d, 27.0 + rng.uniform(0, 0.004), -80.3 + rng.uniform(0, 0.004)) for d in range(30) for _ in range(6)]
    changes = spark.createDataFrame(fixes, "device_id bigint, lat double, lon double")
    low = S.detail_cell_at(changes).agg(F.min("cell_x").alias("x"), F.min("cell_y").alias("y")).first()
    saved = [(m, (low.x + m % 3) * 1024, (low.y + m % 4) * 1024, 2048, 2048) for m in range(25)]
    maps = spark.createDataFrame(saved, "map_id bigint, origin_x bigint, origin_y bigint, width int, height int")
    want = sorted(S.tile_demand(changes, maps, ["device_id"]).select("device_id", "map_id", "x", "y").distinct().collect())
    for block in (3, 1024):
        got = S.tile_demand_once(changes, maps, ["device_id"], block).select("device_id", "map_id", "x", "y")
        assert sorted(got.collect()) == want
        head = plan(got).split("Join")[0]
        assert "Generate explode" in head and "Aggregate" not in head and "Distinct" not in head


def test_mesh_nodes_are_listed_behind_the_join(spark):
    maps = spark.createDataFrame([(1, 2000, 1500), (2, 300, 900), (3, 10, 10)], "map_id bigint, width int, height int")
    fits = spark.range(1, 4).select(
        F.col("id").alias("map_id"), (F.col("id") < 3).alias("ok"), F.lit("affine").alias("method"), F.lit(38.0).alias("lat0"), F.lit(-78.0).alias("lon0"),
        F.lit(87000.0).alias("kx"), F.lit(111000.0).alias("ky"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(1.0).alias("scale"),
        F.array(*[F.lit(float(k)) for k in (1, 2, 3, -2, 1, 4)]).alias("affine"), F.expr("cast(null as array<struct<u:double,v:double>>)").alias("controls"),
        F.expr("cast(null as array<double>)").alias("w_e"), F.expr("cast(null as array<double>)").alias("w_n"),
    )
    mesh = A.overlay_mesh(fits, maps, 8)
    # Nodes are listed above the join in the plan: one row a map meets its fit.
    assert plan(mesh).rfind("explode") < plan(mesh).find("Join")
    rows = mesh.collect()
    assert sorted((r.map_id, r.row, r.col) for r in rows) == [(1, i, j) for i in range(7) for j in range(9)] + [(2, i, j) for i in range(9) for j in range(4)]
    back = A.apply_fit(mesh.select("map_id", "row", "col", "x", "y"), fits).collect()
    assert sorted(rows) == sorted(back)
    assert max((r.x, r.y) for r in rows if r.map_id == 1) == (2000.0, 1500.0)


def lines(rng, n, first):
    rows = []
    for k in range(n):
        x, y = rng.randrange(0, 60), rng.randrange(0, 60)
        for idx in range(rng.randrange(1, 5)):
            rows.append((k % 3, first + k, idx, float(x), float(y)))
            x, y = (x, y) if rng.random() < 0.1 else (rng.choice([x, rng.randrange(0, 60)]), rng.choice([y, rng.randrange(0, 60)]))
    return rows


def test_few_segments_of_a_map_meet_in_one_task_and_give_what_cells_give(spark):
    rng = random.Random(8)
    schema = "map_id int, line_id bigint, idx bigint, x double, y double"
    found, truth = lines(rng, 60, 0), [*lines(rng, 50, 1000), (7, 5000, 0, 1.0, 1.0), (7, 5000, 1, 9.0, 1.0)]
    f, t = spark.createDataFrame(found, schema), spark.createDataFrame(truth, schema)
    seg = lambda v: L.segments(v, ["map_id", "line_id"]).withColumn("seg_id", F.struct("line_id", "seg"))
    whole, cells = (L.capsule_intervals(seg(f), seg(t), 3.0, ["map_id"], load=load) for load in (1 << 20, 20))
    assert "CoGroup" in plan(whole) and "Join" not in plan(whole)
    assert sorted(whole.collect()) == sorted(cells.collect())
    assert whole.count() > 200
    one, many = (sorted(L.line_match(f, t, 3.0, load=load).collect()) for load in (1 << 20, 20))
    assert [r.map_id for r in one] == [0, 1, 2, 7] and one[3].recall == 0.0 and one[3].precision == 1.0
    for a, b in zip(one, many):
        assert abs(a.recall - b.recall) < 1e-12 and abs(a.precision - b.precision) < 1e-12


def test_tables_of_small_files_and_many_rows_are_not_sent_through_the_driver(spark, monkeypatch):
    rows = cut(spark.range(100_000).select((F.col("id") % 50_000).alias("k"), F.lit(1).alias("one")))
    both = lambda: rows.join(rows.select("k", F.col("one").alias("two")), "k")

    def kind(df):
        df.count()
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    assert "BroadcastHashJoin" in kind(both().groupBy().count())
    with small_broadcasts(spark, 100_000):
        assert "BroadcastHashJoin" not in kind(both().groupBy().count())
    assert spark.conf.get(name) == before

    class Seen(Exception):
        pass

    def stop(df):
        raise Seen(df.sparkSession.conf.get(name))

    monkeypatch.setattr(T, "cut", stop)
    cells = spark.createDataFrame([(1, 1, 0, 0)], "map_id bigint, chip_id int, x int, y int")
    for step in (T.thin, T.skeleton_graph):
        with pytest.raises(Seen, match="-1"):
            step(cells)
        assert spark.conf.get(name) == before


def test_ink_around_points_is_shuffled_once_a_side(spark, monkeypatch):
    px = spark.range(90 * 80).select((F.col("id") % 1 + 1).cast("int").alias("map_id"), (F.col("id") % 90).cast("int").alias("x"), F.floor(F.col("id") / 90).cast("int").alias("y"))
    px = px.withColumns({k: F.when((F.col("x") == 64) & (F.col("y") == 63), n).otherwise(240) for k, n in (("r", 200), ("g", 30), ("b", 30))})
    points = spark.createDataFrame([(1, 7, 62.1, 63.2), (1, 8, 66.4, 64.4), (1, 9, 20.0, 20.0)], "map_id int, pid int, x double, y double")
    plans, write = [], P.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(P, "cut", seen)
    got = {r.pid: (r.r, r.g, r.b) for r in P.pick_ink(points, px, ["pid"], 3.0).collect()}
    assert got == {7: (200, 30, 30), 8: (200, 30, 30), 9: (240, 240, 240)}
    assert [p.count("Exchange ") for p in plans] == [2]


def crossing_lines(rng, n):
    rows = []
    for k in range(n):
        kind, long = rng.choice(["trail", "trail", "area", "poi"]), rng.random() < 0.15
        for idx in range(1 if kind == "poi" else rng.randrange(17, 60) if long else rng.randrange(1, 9)):
            rows.append((k % 4, k, idx, rng.randrange(0, 40) / 4, rng.randrange(0, 40) / 4, kind))
    for idx in range(5):  # a ring back on one place, and lines with no place
        rows += [(0, n, idx, 3.0, 3.0, "area"), (1, n + 1, idx, None if idx == 2 else idx * 2.0, 1.0, "trail"), (2, n + 2, idx, float("nan") if idx == 3 else 1.0, idx * 2.0, "area")]
    return rows


def test_short_lines_are_reworked_in_one_pass_and_as_chunks_are(spark, monkeypatch):
    v = spark.createDataFrame(crossing_lines(random.Random(12), 300), "map_id int, feature_id bigint, idx bigint, x double, y double, kind string")
    pins = cut(simple.junctions(v))
    assert pins.count() > 50
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select("map_id", "feature_id", "idx", "x", "y", "kind").collect())
    thin = simple._simplify_chunked(cut(simple._pinned(v.where("kind <> 'poi'"), pins)), 2.0)
    want = rows(simple._smooth_chunked(thin).unionByName(v.where("kind = 'poi'")))
    assert rows(simple.simplify(v, 2.0, pins)) == rows(thin)
    assert rows(simple.simplify_maps(v, 2.0, True)) == want
    monkeypatch.setattr(simple, "STEP", 40)
    monkeypatch.setattr(simple, "CHUNK", 16)
    monkeypatch.setattr(ordered, "CHUNK", 16)
    assert rows(simple.simplify_maps(v, 2.0, True)) == want

    written = []
    monkeypatch.setattr(simple, "cut", lambda df: written.append(df) or cut(df))
    short = v.where("idx < 16 and x between 0 and 10")
    out = simple.simplify_maps(short, 2.0, True)
    assert len(written) == 2 and "Join" not in plan(out) and "Window" not in plan(out)
    assert "Window" not in plan(written[1]) and plan(written[1]).count("Join") == 1
