import numpy as np
from cairnfield.operators import anchors, pixels, review


def test_asked_values_are_taken(spark):
    assert pixels.closing_radius(28.0) == 7 and pixels.closing_radius(0.0) == 0
    assert review.corridor_px(0.05) == 80.0 and review.corridor_px(4.0) == 1.0
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 200, 30, 30)], "map_id long, pid long, x double, y double, ir int, ig int, ib int")
    px = spark.createDataFrame([(1, 45, 0, 200, 30, 30)], "map_id long, x int, y int, r int, g int, b int")
    assert [(r.ink_x, r.ink_y) for r in pixels.snap_to_ink(points, px, ["pid"], 10.0, 50.0).collect()] == [(45, 0)]


def test_newton_goes_on_until_it_arrives():
    # e = u + r^2 log r^2 about one bend, n = v; a far start takes more than 20 steps.
    cu, cv = np.array([0.0]), np.array([0.0])
    w_e, w_n = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.0, 0.0, 0.0, 1.0])
    u, v = anchors._newton_steps(np.array([1e9]), np.array([0.0]), np.array([50.0]), np.array([0.0]), cu, cv, w_e, w_n)
    assert abs(u[0] ** 2 * np.log(u[0] ** 2) + u[0] - 50) < 1e-6 and v[0] == 0
