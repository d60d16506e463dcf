import math

import numpy as np

from cairnfield.operators import anchors as A


def _scene(spark, requested, rows):
    a = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], "map_id bigint, anchor_id bigint, x double, y double, lat double, lon double")
    m = spark.createDataFrame([(1, 1000, 800, requested)], "map_id bigint, width int, height int, requested string")
    return a, m


def _grid(bend=0.0):
    return [(x, y, 38.6 - y * 1e-5 + bend * x * y * 1e-9, -78.4 + x * 1.2e-5) for x in (50, 400, 900) for y in (60, 420, 760)]


def test_affine_matches_lstsq(spark):
    rows = _grid(3.0)
    a, m = _scene(spark, "affine", rows)
    fit = A.fit_anchors(a, m).collect()[0]
    assert fit.method == "affine" and fit.ok
    lat0 = np.mean([r[2] for r in rows])
    u = np.array([((r[0] - 500) / 1000, (r[1] - 400) / 1000, 1) for r in rows])
    north = np.linalg.lstsq(u, np.array([(r[2] - lat0) * fit.ky for r in rows]), rcond=None)[0]
    assert np.allclose(fit.affine[3:], north, atol=1e-6)


def test_rubber_sheet_interpolates_and_inverts(spark):
    a, m = _scene(spark, "tps", _grid(2.0))
    fits = A.fit_anchors(a, m)
    assert fits.collect()[0].method == "tps"
    for r in A.apply_fit(a.select("map_id", "anchor_id", "x", "y"), fits).join(a.withColumnsRenamed({"lat": "la", "lon": "lo"}).select("anchor_id", "la", "lo"), "anchor_id").collect():
        assert math.isclose(r.lat, r.la, abs_tol=1e-9) and math.isclose(r.lon, r.lo, abs_tol=1e-9)
    back = A.invert_fit(a.select("map_id", "anchor_id", "lat", "lon"), fits).join(a.withColumnsRenamed({"x": "ax", "y": "ay"}).select("anchor_id", "ax", "ay"), "anchor_id")
    assert all(abs(r.x - r.ax) < 1e-3 and abs(r.y - r.ay) < 1e-3 for r in back.collect())


def test_left_out_equals_refit(spark):
    rows = _grid(25.0)
    for method in ("affine", "similarity", "tps"):
        a, m = _scene(spark, method, rows)
        loo = {r.anchor_id: r.loo_residual_m for r in A.loo_residuals(a, A.fit_anchors(a, m), m).collect()}
        rest = a.where("anchor_id <> 4")
        p = A.apply_fit(a.where("anchor_id = 4").select("map_id", "x", "y"), A.fit_anchors(rest, m)).collect()[0]
        lat, lon = rows[4][2:]
        dy, dx = (p.lat - lat) * 111319.49, (p.lon - lon) * 111319.49 * math.cos(math.radians(lat))
        assert math.isclose(loo[4], math.hypot(dx, dy), rel_tol=1e-3, abs_tol=1e-3)


def test_failures_stay_as_rows(spark):
    a, m = _scene(spark, "auto", [(1, 1, 38, -78), (1, 1, 38, -78)])
    assert A.fit_anchors(a, m).collect()[0].reason == "degenerate"
    assert A.fit_anchors(a.limit(1), m).collect()[0].need == 1


def test_folded_sheets_are_inverted_at_their_controls():
    # Targets in no order over random controls: the sheet folds, and the straight guess leads away from some of them.
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(60):
        n = 7
        cu, cv, te, tn = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n), rng.uniform(-900, 900, n), rng.uniform(-900, 900, n)
        r2 = (cu[:, None] - cu) ** 2 + (cv[:, None] - cv) ** 2
        flat = np.column_stack([np.ones(n), cu, cv])
        full = np.block([[r2 * np.log(np.where(r2 > 0, r2, 1.0)), flat], [flat.T, np.zeros((3, 3))]])
        w_e, w_n = (np.linalg.solve(full, np.append(t, [0, 0, 0])) for t in (te, tn))
        line = np.linalg.lstsq(flat, np.column_stack([te, tn]), rcond=None)[0]
        u, v = np.linalg.solve(line[1:].T, np.column_stack([te, tn]).T - line[0][:, None])
        with np.errstate(all="ignore"):
            missed += np.isnan(A._newton_steps(u, v, te, tn, cu, cv, w_e, w_n)[0]).sum()
            gu, gv = A._newton_from_controls(u, v, te, tn, cu, cv, w_e, w_n)
        k = np.hypot(gu[:, None] - cu, gv[:, None] - cv) ** 2
        k = k * np.log(np.where(k > 0, k, 1.0))
        for w, t in ((w_e, te), (w_n, tn)):
            assert np.allclose(w[n] + w[n + 1] * gu + w[n + 2] * gv + k @ w[:n], t, atol=1e-5)
    assert missed > 0
