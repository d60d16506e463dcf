import random
import time
import xml.dom.minidom

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import trace as T
from cairnfield.sources import documents as D
from cairnfield.sources import gpx as G
from cairnfield.sources import projects as P
from cairnfield.streaming import live as S

GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1.5" lon="2"/><wpt lat="99" lon="2"/><wpt lat="3" lon="4"><name>A &amp; B</name></wpt>
<trk><name>T</name><trkseg><trkpt lat="1" lon="1"/><trkpt lat="x" lon="1"/><trkpt lat="2" lon="2"><ele>7</ele></trkpt></trkseg><trkseg><trkpt lat="5" lon="5"/></trkseg></trk></gpx>"""


def test_gpx_files_and_text_agree(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    files = {(r.point_id, r.name, r.lat, r.ele) for r in G.read_gpx(spark, str(tmp_path)).collect()}
    text = {(r.point_id, r.name, r.lat, r.ele) for r in G.from_gpx_text(spark.createDataFrame([("a", GPX)], "f string, x string"), "f", "x").collect()}
    assert files == text
    assert {("wpt-1", "Waypoint 1", 1.5, None), ("wpt-2", "A & B", 3.0, None), ("trk-1-1-2", "T pt 2", 2.0, 7.0)} <= files


def test_documents_are_well_formed(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, 0, "trail", "<a> & \"b\" 'c'", "#abc", "n<", None, "one-way", None), (1, 2, 1, "poi", "p", "zz", "", "Water", None, None)],
                              "map_id int, feature_id int, seq int, kind string, name string, color string, notes string, poi_type string, route_kind string, route_direction string")
    geo = spark.createDataFrame([(1, 1, 0, 38.0, -78.0, "trail"), (1, 1, 1, 38.1, -78.1, "trail"), (1, 2, 0, 38.2, -78.2, "poi")], "map_id int, feature_id int, idx bigint, lat double, lon double, kind string")
    lengths = spark.createDataFrame([(1, 1, 1234.5)], "map_id int, feature_id int, length_m double")
    docs = spark.createDataFrame([(1, "Map & co")], "map_id int, name string")
    for make in (D.gpx_parts, D.kml_parts):
        text = "".join(r.text for r in make(docs, f, geo, lengths).orderBy(*D.ORDER).collect())
        xml.dom.minidom.parseString(text.encode())
    out = str(tmp_path / "g")
    D.write_geojson(out, docs, f, geo, lengths)
    import json
    from pathlib import Path

    text = "".join(p.read_text() for p in sorted(Path(out, "map_id=1").glob("*.txt")))
    parsed = json.loads(text)
    assert [x["geometry"]["type"] for x in parsed["features"]] == ["LineString", "Point"]


def test_project_versions(spark):
    docs = [(i, '{"version": %d, "name": "m", "features": [{"id": "f", "kind": "trail", "pts": [[0,0],[1,1]], "route": {"kind": "one-way"}}]}' % i) for i in (3, 4, 5)]
    ok, bad = P.from_project_text(spark.createDataFrame(docs, "k int, j string"), "k", "j")
    assert {(r.map_id, r.version) for r in ok.collect()} == {(3, 4), (4, 4)} and [r.map_id for r in bad.collect()] == [5]
    assert {r.map_id: r.route_kind for r in P.tables(ok)["features"].collect()} == {3: None, 4: "one-way"}


def scan_corners(m):
    """Staircase corners removed cell by cell in scan order, each seeing earlier removals."""
    p = np.pad(m, 1)
    for y, x in zip(*np.nonzero(p)):
        n, e, s, w = p[y - 1, x], p[y, x + 1], p[y + 1, x], p[y, x - 1]
        if (n and e and not (s or w or p[y + 1, x - 1])) or (e and s and not (n or w or p[y - 1, x - 1])) or (s and w and not (n or e or p[y - 1, x + 1])) or (w and n and not (e or s or p[y + 1, x + 1])):
            p[y, x] = False
    m[:] = p[1:-1, 1:-1]


def test_thinning_blocks_equal_whole(spark, monkeypatch):
    m = np.zeros((60, 90), bool)
    m[5:55, 10:24] = m[20:30, 10:80] = True
    want = m.copy()
    while T._thin_once(want):
        pass
    scan_corners(want)
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = [(1, 1, int(x), int(y)) for y, x in zip(*np.nonzero(m))]
    got = T.thin(spark.createDataFrame(rows, "map_id int, chip_id int, x int, y int"))
    assert {(r.y, r.x) for r in got.collect()} == set(zip(*map(list, np.nonzero(want))))


def test_corners_settle_as_a_scan_does():
    rng = np.random.default_rng(2)
    for _ in range(300):
        m = rng.random((13, 17)) < rng.choice([0.3, 0.5, 0.7])
        want, open_ = m.copy(), m.copy()
        scan_corners(want)
        T._settle_corners(m, open_, slice(0, None))
        assert (m == want).all() and not open_.any()


@pytest.mark.parametrize("block", [64, 256, 4096])
def test_long_staircases_in_blocks_of_any_size(spark, monkeypatch, block):
    k = np.arange(1000)
    m = np.zeros((1010, 1300), bool)
    m[k, k + 3] = m[k, k + 4] = True
    m[k, 1290 - k] = m[k, 1291 - k] = True
    want = m.copy()
    scan_corners(want)
    assert 0 < want.sum() < m.sum()
    monkeypatch.setattr(T, "BLOCK", block)
    rows = spark.createDataFrame(pd.DataFrame({"map_id": 1, "chip_id": 1, "x": np.nonzero(m)[1], "y": np.nonzero(m)[0]}))
    got = T._drop_corners(rows.selectExpr("map_id", "chip_id", "cast(x as int) x", "cast(y as int) y")).toPandas()
    assert set(zip(got.y, got.x)) == set(zip(*np.nonzero(want)))


def test_columns_of_wide_rasters_stay_apart(spark):
    wide = 1 << 20
    cells = [(1, 1, wide + k, 0) for k in range(4)] + [(1, 1, k, 1) for k in range(4)]
    graph = T.skeleton_graph(spark.createDataFrame(cells, "map_id int, chip_id int, x int, y int"))
    assert graph["edges"].count() == 2 and graph["nodes"].count() == 4


def test_request_rates_stream_equals_batch(spark, tmp_path):
    rows = [("s" if i % 3 else "t", 1, "k", i * 100, 1, 200, 10 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "source_id string, map_id bigint, key string, s bigint, attempt int, status int, bytes bigint")
    df = df.withColumn("ts", F.timestamp_seconds("s")).withColumn("retry_after_s", F.lit(None).cast("double"))
    cols = ["source_id", "map_id", "key", "ts", "attempt", "status", "bytes", "retry_after_s"]
    for part in range(3):
        df.where(F.col("s") % 3 == part).select(*cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rates = S.request_rates(S.requests(spark, str(tmp_path / "in"), "1 day"))
    q = rates.writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("rates").groupBy("window_start", "source_id").agg(F.max("requests").alias("n"), F.max("bytes").alias("b"))
    want = S.request_rates(df).select("window_start", "source_id", "requests", "bytes")
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("idle_s", [None, 900.0])
def test_cell_changes_of_shuffled_fixes_equal_batch(spark, tmp_path, idle_s):
    """Fixes arrive up to eight minutes late in five micro-batches; one comes after the watermark."""
    rng = random.Random(6)
    fixes = [(d, 20 * k + d + (3000 if k > 40 else 0), 27.0 + (k // 4 % 3) * 0.002) for d in (1, 2, 3) for k in range(80)]
    arrived = sorted(fixes, key=lambda f: f[1] + rng.uniform(0, 480))
    batches = [arrived[k:k + 48] for k in range(0, 240, 48)] + [[(99, 50_000, 27.0)], [(99, 50_001, 27.0)], [(1, 30, 28.0), (99, 90_000, 27.0)], [(99, 90_001, 27.0)]]
    frame = lambda rows: spark.createDataFrame([(*r, -80.3, 1.0) for r in rows], "device_id bigint, s bigint, lat double, lon double, accuracy_m double").withColumn("ts", F.timestamp_seconds("s"))
    for rows in batches:
        frame(rows).select("device_id", "ts", "lat", "lon", "accuracy_m").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    read = spark.readStream.schema(S.FIX_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = S.cell_changes_stream(S.usable_fixes(read).withWatermark("ts", "10 minutes"), idle_s)
    name = f"cells_{'all' if idle_s is None else 'idle'}"
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    progress = q.recentProgress
    q.stop()
    got = sorted((r.device_id, r.ts, r.cell_x, r.cell_y) for r in spark.table(name).where("device_id < 99").collect())
    want = S.cell_changes(frame(fixes).withColumn("event_id", F.col("s")), idle_s=idle_s)
    assert got == sorted((r.device_id, r.ts, r.cell_x, r.cell_y) for r in want.collect()) and len(got) == (60 if idle_s is None else 63)
    assert sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators) == 1
    total = progress[-1].stateOperators[0].numRowsTotal
    # Idle devices have ended; without an end their last cells stay.
    assert total <= 8 if idle_s else total >= 3


def test_pixels_of_a_png_and_a_broken_file(spark, tmp_path):
    import struct
    import zlib

    from cairnfield.sources.images import read_pixels, unreadable_images

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes([10 * y + x, y, x]) * 1 + bytes([1, 2, 3]) * 2 for y in range(4) for x in [0])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    (tmp_path / "im").mkdir()
    (tmp_path / "im" / "a.png").write_bytes(png)
    (tmp_path / "im" / "b.png").write_bytes(b"not an image")
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in read_pixels(spark, str(tmp_path / "im")).collect()}
    assert got == {(x, y): (10 * y, y, 0, 255) if x == 0 else (1, 2, 3, 255) for x in range(3) for y in range(4)}
    assert {(r.x, r.y) for r in read_pixels(spark, str(tmp_path / "im"), 2).collect()} == {(x, y) for x in range(2) for y in range(2)}
    assert [r.map_id for r in unreadable_images(spark, str(tmp_path / "im")).collect()] == ["b.png"]


def test_dots_are_strung_with_edges_of_their_own(spark):
    """Dots met in the order 5-3-7-2-9 behind a line end: every edge has its own id and two points."""
    from cairnfield.operators import trace as T

    raster = "named_struct('map_id', 1, 'chip_id', 1) as raster"
    spots = {1: 0.0, 5: 14.0, 3: 18.0, 7: 22.0, 2: 26.0, 9: 30.0, 11: -10.0}
    nodes = spark.createDataFrame([(k, x, 0.0) for k, x in spots.items()], "node bigint, x double, y double").selectExpr(raster, "node", "x", "y")
    edges = spark.createDataFrame([(11, 11, 1, 10.0)], "edge bigint, a bigint, b bigint, len double").selectExpr(raster, "edge", "a", "b", "len")
    points = spark.createDataFrame([(11, 0, -10.0, 0.0), (11, 1, 0.0, 0.0)], "edge bigint, idx bigint, x double, y double").selectExpr(raster, "edge", "idx", "x", "y")
    out = T.bridge({"nodes": nodes, "edges": edges, "points": points}, 6.0, F.lit(8.0))
    made = out["edges"].collect()
    pairs = {frozenset((r.a, r.b)) for r in made}
    assert {frozenset(p) for p in ((1, 11), (1, 5), (5, 3), (3, 7), (7, 2), (2, 9))} <= pairs
    assert len({r.edge for r in made}) == len(made)
    assert {r["count"] for r in out["points"].groupBy("edge").count().collect()} == {2}


def test_gpx_text_is_read_once(spark):
    df = G.from_gpx_text(spark.createDataFrame([("a", GPX), ("b", "no xml"), ("c", None)], "f string, x string"), "f", "x")
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("from_xml(") == 1
    assert {r.file for r in df.collect()} == {"a"} and df.count() == 5
