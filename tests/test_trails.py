"""Dashed and dotted trails come out as one line each."""

import pytest

from cairnfield.operators import trace
from cairnfield.plans import raster
from cairnfield.plans.registry import QUERIES


class Asked(Exception):
    pass


def _gap_of_query(spark, monkeypatch):
    def stop(px, maps, chips, tolerance=60.0, gap=0.0, *rest):
        raise Asked(gap)

    with monkeypatch.context() as m:
        m.setattr(raster.T, "find_trails", stop)
        m.setattr(raster.C, "pixels", lambda *a: None)
        m.setattr(raster, "_maps", lambda *a: None)
        m.setattr(raster, "_chips", lambda *a: spark.range(0))
        with pytest.raises(Asked) as asked:
            QUERIES["r11_find_trails"](spark, "")
    return asked.value.args[0]


def test_broken_trails_are_one_line(spark, monkeypatch):
    gap = _gap_of_query(spark, monkeypatch)
    ink = {(x, y) for x in range(10, 110) for y in (10, 11, 12) if x % 20 < 12}
    ink |= {(x + dx, 40 + dy) for x in range(10, 110, 12) for dx in (0, 1, 2) for dy in (0, 1, 2)}
    rows = [(1, x, y, *((200, 30, 30) if (x, y) in ink else (255, 255, 255)), 255) for x in range(120) for y in range(50)]
    px = spark.createDataFrame(rows, "map_id long, x int, y int, r int, g int, b int, a int")
    maps = spark.createDataFrame([(1, 120, 50)], "map_id long, width int, height int")
    chips = spark.createDataFrame([(1, 1, "red", 200, 30, 30)], "map_id long, chip_id int, name string, r int, g int, b int")
    found = trace.find_trails(px, maps, chips, 40.0, gap, 20.0)
    ends = found["vertices"].groupBy("candidate_id").agg({"x": "max", "y": "max"}).join(found["vertices"].groupBy("candidate_id").agg({"x": "min", "y": "min"}), "candidate_id")
    lines = sorted((r["min(y)"], r["max(y)"], r["min(x)"], r["max(x)"]) for r in ends.collect())
    assert len(lines) == 2
    for (y0, y1, x0, x1), y in zip(lines, (11, 41), strict=True):
        assert abs(y0 - y) <= 1 and abs(y1 - y) <= 1 and x0 <= 14 and x1 >= 102, lines
