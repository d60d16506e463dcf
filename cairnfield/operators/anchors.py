"""Control points to map fits: frames, least squares, checks, projection both ways.

All moments are Spark's mergeable central moments (``avg``, ``var_pop``, ``covar_pop``), so one
partial aggregation per map is enough and a map with very many anchors is no hot spot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.constants import (
    AFFINE_DET_FLOOR,
    LOOSE_RMS_M,
    MIN_SPREAD_RATIO,
    OUTLIER_FACTOR,
    OUTLIER_MIN_M,
    PIVOT_FLOOR,
    SCALE_MAX,
    SCALE_MIN,
)
from cairnfield.functions.geo import D2R, METERS_PER_DEGREE, finite, haversine_m
from cairnfield.functions.text import fixed, format_residual, whole
from cairnfield.operators.ordered import number_rows
from cairnfield.session import cut


def usable_anchors(anchors: DataFrame) -> DataFrame:
    return anchors.where(finite(F.col("lat"), F.col("lon"), F.col("x"), F.col("y")))


def anchor_moments(usable: DataFrame) -> DataFrame:
    """Per map: n, means and centred sums of the four coordinates."""
    n = F.count("*")
    pair = lambda a, b: (F.covar_pop(a, b) * n).alias(f"s_{a}_{b}")
    return usable.groupBy("map_id").agg(
        n.alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in ("x", "y", "lat", "lon")],
        pair("x", "x"), pair("x", "y"), pair("y", "y"),
        pair("x", "lat"), pair("x", "lon"), pair("y", "lat"), pair("y", "lon"),
    )


def with_ratio(df: DataFrame, out: str, n: Column, sxx: str, sxy: str, syy: str) -> DataFrame:
    """Add the minor over major singular value of centred points; 0 for fewer than three.

    Steps are separate columns so that generated code stays small.
    """
    c = F.col
    major = (c(sxx) + c(syy) + F.hypot(c(sxx) - c(syy), 2 * c(sxy))) / 2
    minor = F.greatest(F.lit(0.0), c(sxx) * c(syy) - c(sxy) * c(sxy))
    return df.withColumns({"_major": major, "_minor": minor}).withColumn(
        out, F.when((n >= 3) & (c("_major") > 0), F.sqrt(c("_minor")) / c("_major")).otherwise(0.0)
    ).drop("_major", "_minor")


def _without(total: str, a: str, b: str) -> Column:
    """A centred sum after one anchor (the row's own) is left out."""
    da, db = F.col(a) - F.col(f"m_{a}"), F.col(b) - F.col(f"m_{b}")
    return F.col(total) - da * db * F.col("n") / (F.col("n") - 1)


def spread(anchors: DataFrame) -> DataFrame:
    """Per map: spread ratio, affine support, and support after dropping each anchor in turn."""
    usable = usable_anchors(anchors)
    moments = anchor_moments(usable)
    return _support(usable, moments).select("map_id", "n", "ratio", "supported", "independent")


def _with_left_out(rows: DataFrame) -> DataFrame:
    """Add the centred sums and the spread ratio of the map without the row's own anchor."""
    rows = rows.withColumns({
        f"w_{a[0]}{b}" if b not in "xy" else f"w_{a}{b}": _without(f"s_{a}_{b}", a, b)
        for a, b in (("x", "x"), ("x", "y"), ("y", "y"), ("x", "lat"), ("x", "lon"), ("y", "lat"), ("y", "lon"))
    })
    return with_ratio(rows, "w_ratio", F.col("n") - 1, "w_xx", "w_xy", "w_yy")


def _support(usable: DataFrame, moments: DataFrame) -> DataFrame:
    rows = _with_left_out(usable.select("map_id", "x", "y", "lat", "lon").join(moments.where("n >= 4"), "map_id"))
    each = rows.groupBy("map_id").agg(F.min("w_ratio").alias("_least"))
    out = with_ratio(moments.join(each, "map_id", "left"), "ratio", F.col("n"), "s_x_x", "s_x_y", "s_y_y")
    return (
        out.withColumn("supported", F.col("ratio") >= MIN_SPREAD_RATIO)
        .withColumn("independent", F.coalesce(F.col("_least") >= MIN_SPREAD_RATIO, F.lit(False)))
        .drop("_least")
    )


def _frame(df: DataFrame) -> DataFrame:
    size = F.greatest("width", "height").cast("double")
    return (
        df.withColumn("lat0", F.col("m_lat"))
        .withColumn("lon0", F.col("m_lon"))
        .withColumn("kx", F.cos(F.col("m_lat") * D2R) * METERS_PER_DEGREE)
        .withColumn("ky", F.lit(METERS_PER_DEGREE))
        .withColumn("cx", F.col("width") / 2)
        .withColumn("cy", F.col("height") / 2)
        .withColumn("scale", F.when(size == 0, 1.0).otherwise(size))
    )


def fit_frames(anchors: DataFrame, maps: DataFrame) -> DataFrame:
    """Local metre frame of every map with at least two usable anchors."""
    moments = anchor_moments(usable_anchors(anchors)).where("n >= 2")
    return _frame(moments.join(maps, "map_id")).select(
        "map_id", F.col("n").alias("anchor_count"), "lat0", "lon0", "kx", "ky", "cx", "cy", "scale"
    )


def _solved(df: DataFrame) -> DataFrame:
    """Similarity (p, q) and affine (e_u, e_v, n_u, n_v) coefficients in the metre frame."""
    c = F.col
    s = c("scale")
    parts = df.withColumns({
        "_uu": c("s_x_x") / (s * s), "_uv": c("s_x_y") / (s * s), "_vv": c("s_y_y") / (s * s),
        "_ue": c("s_x_lon") * c("kx") / s, "_ve": c("s_y_lon") * c("kx") / s,
        "_un": c("s_x_lat") * c("ky") / s, "_vn": c("s_y_lat") * c("ky") / s,
        "mu": (c("m_x") - c("cx")) / s, "mv": (c("m_y") - c("cy")) / s,
    })
    parts = parts.withColumns({"_det": c("_uu") * c("_vv") - c("_uv") * c("_uv"), "_pivot": F.greatest("_uu", F.abs("_uv"))})
    fine = (c("n") >= 3) & (c("_pivot") >= PIVOT_FLOOR) & (F.abs("_det") >= c("_pivot") * PIVOT_FLOOR)
    parts = parts.withColumns({"_d": F.when(fine, c("_det")), "_r": F.when(c("_uu") + c("_vv") >= PIVOT_FLOOR, c("_uu") + c("_vv"))})
    parts = parts.withColumns({
        "p": (c("_ue") - c("_vn")) / c("_r"), "q": (c("_ve") + c("_un")) / c("_r"),
        "e_u": (c("_vv") * c("_ue") - c("_uv") * c("_ve")) / c("_d"), "e_v": (c("_uu") * c("_ve") - c("_uv") * c("_ue")) / c("_d"),
        "n_u": (c("_vv") * c("_un") - c("_uv") * c("_vn")) / c("_d"), "n_v": (c("_uu") * c("_vn") - c("_uv") * c("_un")) / c("_d"),
    }).drop("_uu", "_uv", "_vv", "_ue", "_ve", "_un", "_vn", "_det", "_pivot", "_d", "_r")
    return (
        parts.withColumn("det", F.coalesce(c("e_u") * c("n_v") - c("e_v") * c("n_u"), F.lit(0.0)))
        .withColumn("has_aff", F.abs("det") > AFFINE_DET_FLOOR)
        .withColumn("has_sim", c("p").isNotNull())
    )


SIM = "array(p, q, -(p*mu + q*mv), q, -p, -(q*mu - p*mv))"
AFF = "array(e_u, e_v, -(e_u*mu + e_v*mv), n_u, n_v, -(n_u*mu + n_v*mv))"


def fit_similarity(anchors: DataFrame, maps: DataFrame) -> DataFrame:
    df = _solved(_frame(anchor_moments(usable_anchors(anchors)).where("n >= 2").join(maps, "map_id")))
    return df.where("has_sim").select("map_id", F.col("n").alias("anchor_count"), F.expr(SIM).alias("affine"))


def fit_affine(anchors: DataFrame, maps: DataFrame) -> DataFrame:
    df = _solved(_frame(anchor_moments(usable_anchors(anchors)).where("n >= 3").join(maps, "map_id")))
    return df.where("has_aff").select("map_id", F.col("n").alias("anchor_count"), F.expr(AFF).alias("affine"))


FIT_COLUMNS = [
    "map_id", "ok", "reason", "need", "requested", "method", "anchor_count", "lat0", "lon0", "kx", "ky",
    "cx", "cy", "scale", "affine", "controls", "w_e", "w_n", "independent", "det",
]


def fit_anchors(anchors: DataFrame, maps: DataFrame, tps: bool = True) -> DataFrame:
    """One row per map: the resolved method and its model, or why there is none.

    ``tps=False`` leaves the rubber-sheet solve out and keeps its companion affine only.
    """
    usable = usable_anchors(anchors)
    moments = anchor_moments(usable)
    df = maps.join(_support(usable, moments), "map_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    df = _solved(_frame(df))
    c = F.col
    auto = F.when((c("n") >= 4) & c("has_aff") & c("supported"), "affine").otherwise("similarity")
    wanted = F.when(c("requested") == "auto", auto).otherwise(c("requested"))
    wanted = F.when((wanted == "affine") & ~c("has_aff"), "similarity").when(
        (wanted == "tps") & ((c("n") < 4) | ~c("has_aff")), F.when(c("has_aff"), "affine").otherwise("similarity")
    ).otherwise(wanted)
    method = F.when((wanted == "similarity") & ~c("has_sim"), "affine").otherwise(wanted)
    reason = F.when(c("n") < 2, "too-few").when(~c("has_sim") & ~c("has_aff"), "degenerate")
    df = (
        df.withColumn("reason", reason)
        .withColumn("ok", c("reason").isNull())
        .withColumn("need", F.when(c("n") < 2, 2 - c("n")).otherwise(0).cast("int"))
        .withColumn("method", F.when(c("ok"), method))
        .withColumn("affine", F.when(c("ok"), F.when(c("method") == "similarity", F.expr(SIM)).otherwise(F.expr(AFF))))
        .withColumn("anchor_count", c("n"))
    )
    no_array = F.lit(None).cast("array<double>")
    no_controls = F.lit(None).cast("array<struct<u:double,v:double>>")
    base = df.withColumn("controls", no_controls).withColumn("w_e", no_array).withColumn("w_n", no_array)
    # One row per map from here on; cutting keeps every later filter from repeating the algebra.
    base = cut(base.select(*FIT_COLUMNS))
    if not tps:
        return base
    solved = fit_tps(usable, base.where("method = 'tps'"))
    joined = base.drop("controls", "w_e", "w_n").join(solved.drop("loo"), "map_id", "left")
    # A singular rubber-sheet system falls back to its companion affine.
    method = F.when((c("method") == "tps") & c("w_e").isNull(), "affine").otherwise(c("method"))
    return cut(joined.withColumn("method", method).select(*FIT_COLUMNS))


def _kernel(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1.0)), 0.0)


def _tps_matrix(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    n = len(u)
    full = np.zeros((n + 3, n + 3))
    full[:n, :n] = _kernel((u[:, None] - u) ** 2 + (v[:, None] - v) ** 2)
    full[:n, n] = full[n, :n] = 1.0
    full[:n, n + 1] = full[n + 1, :n] = u
    full[:n, n + 2] = full[n + 2, :n] = v
    return full


def _solve_tps(table: pa.Table) -> pa.Table:
    """Solve one map's rubber sheet; its unknowns are coupled, so one task holds one map's anchors."""
    get = lambda name: table.column(name).to_numpy()
    order = np.argsort(table.column("anchor_id").to_numpy(zero_copy_only=False), kind="stable")
    u, v, east, north = (get(name)[order].astype(float) for name in ("u", "v", "e", "n"))
    ids = table.column("anchor_id").take(pa.array(order)).to_pylist()
    lat, lon = get("lat")[order], get("lon")[order]
    kx, ky = get("kx")[0], get("ky")[0]
    n = len(u)
    row = {"map_id": [table.column("map_id")[0].as_py()], "controls": [None], "w_e": [None], "w_n": [None], "loo": [None]}
    full = _tps_matrix(u, v)
    try:
        inverse = np.linalg.inv(full)
    except np.linalg.LinAlgError:
        inverse = None
    if inverse is not None and np.isfinite(inverse).all() and np.abs(full).max() * np.abs(inverse).max() < 1e15:
        zero = np.zeros(3)
        w_e = np.linalg.solve(full, np.concatenate([east, zero]))
        w_n = np.linalg.solve(full, np.concatenate([north, zero]))
        row["controls"] = [[{"u": a, "v": b} for a, b in zip(u, v)]]
        row["w_e"], row["w_n"] = [w_e.tolist()], [w_n.tolist()]
        diagonal = np.diag(inverse)[:n]
        if n >= 5 and (np.abs(diagonal) >= 1e-15).all():
            # Leaving one control out moves the sheet by weight / inverse diagonal at that control.
            row["loo"] = [[
                {"anchor_id": i, "lat": float(a), "lon": float(b)}
                for i, a, b in zip(ids, lat - w_n[:n] / diagonal / ky, lon - w_e[:n] / diagonal / kx)
            ]]
    loo = pa.struct([("anchor_id", table.schema.field("anchor_id").type), ("lat", pa.float64()), ("lon", pa.float64())])
    kinds = {
        "map_id": table.schema.field("map_id").type, "controls": pa.list_(_POINT), "w_e": pa.list_(pa.float64()),
        "w_n": pa.list_(pa.float64()), "loo": pa.list_(loo),
    }
    return pa.table({name: pa.array(row[name], type=kind) for name, kind in kinds.items()})


_POINT = pa.struct([("u", pa.float64()), ("v", pa.float64())])


def fit_tps(usable: DataFrame, fits: DataFrame) -> DataFrame:
    """Rubber-sheet weights and closed-form left-out predictions for the maps in ``fits``."""
    c = F.col
    rows = usable.join(fits.select("map_id", "lat0", "lon0", "kx", "ky", "cx", "cy", "scale"), "map_id").select(
        "map_id", "anchor_id", "lat", "lon", "kx", "ky",
        ((c("x") - c("cx")) / c("scale")).alias("u"), ((c("y") - c("cy")) / c("scale")).alias("v"),
        ((c("lon") - c("lon0")) * c("kx")).alias("e"), ((c("lat") - c("lat0")) * c("ky")).alias("n"),
    )
    kind = dict(usable.dtypes)
    schema = (
        f"map_id {kind['map_id']}, controls array<struct<u:double,v:double>>, w_e array<double>, w_n array<double>,"
        f" loo array<struct<anchor_id:{kind['anchor_id']},lat:double,lon:double>>"
    )
    return rows.groupBy("map_id").applyInArrow(_solve_tps, schema)


def _uv(x: Column, y: Column) -> tuple[Column, Column]:
    return (x - F.col("cx")) / F.col("scale"), (y - F.col("cy")) / F.col("scale")


def _affine_en(u: Column, v: Column) -> tuple[Column, Column]:
    a = F.col("affine")
    return a[0] * u + a[1] * v + a[2], a[3] * u + a[4] * v + a[5]


def _model_en(u: Column, v: Column) -> tuple[Column, Column]:
    """East and north metres of the full model; control terms are folded where there are any."""
    flat = _affine_en(u, v)

    def sheet(weights: str) -> Column:
        w = F.col(weights)
        n = F.size("controls")
        base = w[n] + w[n + 1] * u + w[n + 2] * v

        def bend(pair: Column) -> Column:
            du, dv = u - pair["controls"]["u"], v - pair["controls"]["v"]
            r2 = du * du + dv * dv
            return F.when(r2 > 0, pair["w"] * r2 * F.ln(r2)).otherwise(0.0)

        pairs = F.arrays_zip("controls", F.slice(w, 1, n).alias("w"))
        return F.aggregate(pairs, base, lambda acc, pair: acc + bend(pair))

    is_tps = F.col("method") == "tps"
    return F.when(is_tps, sheet("w_e")).otherwise(flat[0]), F.when(is_tps, sheet("w_n")).otherwise(flat[1])


MODEL = ["map_id", "method", "lat0", "lon0", "kx", "ky", "cx", "cy", "scale", "affine", "controls", "w_e", "w_n"]


def apply_fit(points: DataFrame, fits: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``lat`` and ``lon`` to pixel rows of fitted maps."""
    keep = [c for c in points.columns if c not in ("lat", "lon")]
    return _placed(points.select(*keep).join(fits.where("ok").select(*MODEL), "map_id"), keep, x, y)


def _placed(joined: DataFrame, keep: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``keep`` with ``lat`` and ``lon`` of rows that carry their map's model."""
    e, n = _model_en(*_uv(F.col(x), F.col(y)))
    return joined.withColumn("_e", e).withColumn("_n", n).select(
        *keep,
        (F.col("lat0") + F.col("_n") / F.col("ky")).alias("lat"),
        (F.col("lon0") + F.col("_e") / F.col("kx")).alias("lon"),
    )


def invert_fit(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Add pixel ``x`` and ``y`` to lat/lon rows; null where the model cannot be inverted.

    Straight models are a closed form. Rubber sheets run Newton steps, vectorised over bounded
    slices of a map's points, so a map with very many points is spread over many tasks.
    """
    c = F.col
    keep = [col for col in points.columns if col not in ("x", "y")]
    joined = points.select(*keep).join(fits.where("ok").select(*MODEL), "map_id")
    a = c("affine")
    det = a[0] * a[4] - a[1] * a[3]
    te = (c("lon") - c("lon0")) * c("kx") - a[2]
    tn = (c("lat") - c("lat0")) * c("ky") - a[5]
    safe = F.when(F.abs(det) >= 1e-12, det)
    start = joined.withColumn("_u", (a[4] * te - a[1] * tn) / safe).withColumn("_v", (a[0] * tn - a[3] * te) / safe)
    straight = start.where("method <> 'tps'").select(
        *keep, (c("_u") * c("scale") + c("cx")).alias("x"), (c("_v") * c("scale") + c("cy")).alias("y")
    )
    bent = start.where("method = 'tps'").withColumn("_e", te + a[2]).withColumn("_n", tn + a[5])
    bent = bent.select(*keep, "_u", "_v", "_e", "_n", "scale", "cx", "cy")
    sizes = bent.groupBy("map_id").agg(F.ceil(F.count("*") / 20000).cast("int").alias("_slices"))
    bent = bent.join(sizes, "map_id").withColumn(
        "_slice", F.pmod(F.xxhash64("lat", "lon"), F.col("_slices")).cast("int")
    ).drop("_slices")
    models = fits.where("ok and method = 'tps'").join(sizes, "map_id").select(
        "map_id", "controls", "w_e", "w_n", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")
    )
    plain = points.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", x double, y double"

    def newton(points_part: pa.Table, model_part: pa.Table) -> pa.Table:
        if points_part.num_rows == 0 or model_part.num_rows == 0:
            empty = pa.array([], pa.float64())
            return points_part.slice(0, 0).select(keep).append_column("x", empty).append_column("y", empty)
        controls = model_part.column("controls")[0].as_py()
        cu = np.array([p["u"] for p in controls])
        cv = np.array([p["v"] for p in controls])
        w_e = np.array(model_part.column("w_e")[0].as_py())
        w_n = np.array(model_part.column("w_n")[0].as_py())
        col = lambda name: points_part.column(name).to_numpy().astype(float)
        u, v = _newton_from_controls(col("_u"), col("_v"), col("_e"), col("_n"), cu, cv, w_e, w_n)
        x, y = u * col("scale") + col("cx"), v * col("scale") + col("cy")
        out = points_part.select(keep)
        return out.append_column("x", pa.array(x, from_pandas=True)).append_column("y", pa.array(y, from_pandas=True))

    turned = bent.groupBy("map_id", "_slice").cogroup(models.groupBy("map_id", "_slice")).applyInArrow(newton, schema)
    return straight.unionByName(turned)


#: Newton steps in a row that may come no nearer to the target.
STALLED = 100


def _newton_steps(u, v, te, tn, cu, cv, w_e, w_n):
    """Newton steps until 1e-7 m; NaN where the derivative vanishes or STALLED steps bring a point no nearer."""
    n = len(cu)
    out_u, out_v = np.full(len(u), np.nan), np.full(len(u), np.nan)
    live = np.arange(len(u))
    u, v = u.copy(), v.copy()
    best, stalled = np.full(len(u), np.inf), np.zeros(len(u), int)
    while len(live):
        du, dv = u[live, None] - cu, v[live, None] - cv
        r2 = du * du + dv * dv
        log = np.log(np.where(r2 > 0, r2, 1.0))
        k, dk = r2 * log, np.where(r2 > 0, 2 * (log + 1), 0.0)
        value = lambda w: w[n] + w[n + 1] * u[live] + w[n + 2] * v[live] + k @ w[:n]  # noqa: E731,B023
        de, dn = value(w_e) - te[live], value(w_n) - tn[live]
        off = np.hypot(de, dn)
        done = off < 1e-7
        stalled[live] = np.where(off < best[live], 0, stalled[live] + 1)
        best[live] = np.fmin(best[live], off)
        out_u[live[done]], out_v[live[done]] = u[live[done]], v[live[done]]
        eu, ev = w_e[n + 1] + (dk * du) @ w_e[:n], w_e[n + 2] + (dk * dv) @ w_e[:n]
        nu, nv = w_n[n + 1] + (dk * du) @ w_n[:n], w_n[n + 2] + (dk * dv) @ w_n[:n]
        jac = eu * nv - ev * nu
        go = ~done & np.isfinite(jac) & (np.abs(jac) >= 1e-12) & (stalled[live] < STALLED)
        jac = np.where(go, jac, 1.0)
        u[live] -= np.where(go, (nv * de - ev * dn) / jac, 0.0)
        v[live] -= np.where(go, (eu * dn - nu * de) / jac, 0.0)
        live = live[go & np.isfinite(u[live]) & np.isfinite(v[live])]
    return out_u, out_v


def _newton_from_controls(u, v, te, tn, cu, cv, w_e, w_n):
    """Newton steps from the straight guess and, where they do not arrive, from one control after the other, the nearest to the target first."""
    n = len(cu)
    r2 = (cu[:, None] - cu) ** 2 + (cv[:, None] - cv) ** 2
    k = r2 * np.log(np.where(r2 > 0, r2, 1.0))
    ce, cn = (w[n] + w[n + 1] * cu + w[n + 2] * cv + k @ w[:n] for w in (w_e, w_n))
    out_u, out_v = _newton_steps(u, v, te, tn, cu, cv, w_e, w_n)
    lost = np.flatnonzero(np.isnan(out_u) & np.isfinite(te) & np.isfinite(tn))
    near = np.argsort(np.hypot(te[lost, None] - ce, tn[lost, None] - cn), axis=1, kind="stable")
    for turn in range(n):
        still = np.isnan(out_u[lost])
        lost, near = lost[still], near[still]
        if not len(lost):
            break
        start = near[:, turn]
        out_u[lost], out_v[lost] = _newton_steps(cu[start], cv[start], te[lost], tn[lost], cu, cv, w_e, w_n)
    return out_u, out_v


def anchor_residuals(anchors: DataFrame, fits: DataFrame) -> DataFrame:
    """Metres between each usable anchor and its model; rubber sheets use their companion affine."""
    c = F.col
    joined = usable_anchors(anchors).join(fits.where("ok"), "map_id")
    e, n = _affine_en(*_uv(c("x"), c("y")))
    east, north = (c("lon") - c("lon0")) * c("kx"), (c("lat") - c("lat0")) * c("ky")
    return joined.select("map_id", "anchor_id", F.hypot(e - east, n - north).alias("residual_m"))


def fit_quality(anchors: DataFrame, fits: DataFrame) -> DataFrame:
    """Fits plus rms, metres per pixel and the checked, mirrored and implausible-scale flags."""
    c = F.col
    rms = anchor_residuals(anchors, fits).groupBy("map_id").agg(
        F.sqrt(F.avg(c("residual_m") * c("residual_m"))).alias("rms")
    )
    sim = c("method") == "similarity"
    mpp = F.when(sim, F.hypot(c("affine")[0], c("affine")[1])).otherwise(F.sqrt(F.abs(c("det")))) / c("scale")
    needs = c("requested").isin("affine", "tps") | ((c("requested") == "auto") & (c("anchor_count") >= 4))
    return (
        fits.join(rms, "map_id", "left")
        .withColumn("meters_per_pixel", F.when(c("ok"), mpp))
        .withColumn(
            "checked",
            c("ok") & (c("anchor_count") > F.when(sim, 2).otherwise(3)) & (~needs | F.coalesce("independent", F.lit(False))),
        )
        .withColumn("mirrored", c("ok") & ~sim & (c("det") > 0))
        .withColumn(
            "implausible_scale",
            c("ok") & ((c("meters_per_pixel") < SCALE_MIN) | (c("meters_per_pixel") > SCALE_MAX)),
        )
    )


def loo_residuals(anchors: DataFrame, fits: DataFrame, maps: DataFrame) -> DataFrame:
    """Metres by which a fit of the other anchors misses each anchor (maps with four or more).

    Affine and four-anchor rubber sheets use residual / (1 - leverage); similarity refits from the
    centred sums minus the anchor's own part; larger rubber sheets use their closed form.
    """
    c = F.col
    usable = usable_anchors(anchors)
    moments = anchor_moments(usable).where("n >= 4")
    rows = usable.join(moments, "map_id").join(
        fits.where("ok").select("map_id", "method", "requested", "anchor_count", "scale", "cx", "cy"), "map_id"
    )
    rows = _with_left_out(rows).where((c("method") == "similarity") | (c("w_ratio") >= MIN_SPREAD_RATIO))
    n = c("n")
    rows = rows.withColumns({"_dx": c("x") - c("m_x"), "_dy": c("y") - c("m_y"), "_det": F.nullif(c("s_x_x") * c("s_y_y") - c("s_x_y") * c("s_x_y"), F.lit(0.0))})
    # Affine: residual over (1 - leverage), in degrees per axis.
    slope = {}
    for name in ("lat", "lon"):
        sx, sy = c(f"s_x_{name}"), c(f"s_y_{name}")
        slope[f"_bx_{name}"] = (c("s_y_y") * sx - c("s_x_y") * sy) / c("_det")
        slope[f"_by_{name}"] = (c("s_x_x") * sy - c("s_x_y") * sx) / c("_det")
    pull = c("s_y_y") * c("_dx") * c("_dx") - 2 * c("s_x_y") * c("_dx") * c("_dy") + c("s_x_x") * c("_dy") * c("_dy")
    rows = rows.withColumns({**slope, "_free": F.nullif(1 - 1 / n - pull / c("_det"), F.lit(0.0))})

    def axis(name: str) -> Column:
        miss = c(name) - c(f"m_{name}") - c(f"_bx_{name}") * c("_dx") - c(f"_by_{name}") * c("_dy")
        return c(name) - miss / c("_free")

    # Similarity: means and sums without the anchor give the refit in its own frame.
    rows = rows.withColumns({
        f"_l_{name}": (n * c(f"m_{name}") - c(name)) / (n - 1) for name in ("lat", "lon", "x", "y")
    })
    rows = rows.withColumns({
        "_kx": F.cos(c("_l_lat") * D2R) * METERS_PER_DEGREE, "_u": (c("x") - c("_l_x")) / c("scale"),
        "_v": (c("y") - c("_l_y")) / c("scale"),
        "_rr": F.when((c("w_xx") + c("w_yy")) / (c("scale") * c("scale")) >= PIVOT_FLOOR, (c("w_xx") + c("w_yy")) / c("scale")),
    })
    rows = rows.withColumns({
        "_p": (c("w_xlon") * c("_kx") - c("w_ylat") * METERS_PER_DEGREE) / c("_rr"),
        "_q": (c("w_ylon") * c("_kx") + c("w_xlat") * METERS_PER_DEGREE) / c("_rr"),
    })
    sim_lat = c("_l_lat") + (c("_q") * c("_u") - c("_p") * c("_v")) / METERS_PER_DEGREE
    sim_lon = c("_l_lon") + (c("_p") * c("_u") + c("_q") * c("_v")) / c("_kx")
    is_sim = c("method") == "similarity"
    flat = rows.where("method <> 'tps' or n < 5").select(
        "map_id", "anchor_id", "lat", "lon",
        F.when(is_sim, sim_lat).otherwise(axis("lat")).alias("_plat"),
        F.when(is_sim, sim_lon).otherwise(axis("lon")).alias("_plon"),
    )
    sheets = fit_tps(usable, _frame(moments.join(maps, "map_id")).join(
        fits.where("ok and method = 'tps'").select("map_id"), "map_id", "left_semi").where("n >= 5"))
    predicted = sheets.select("map_id", F.explode("loo").alias("_l")).select(
        "map_id", c("_l.anchor_id").alias("anchor_id"), c("_l.lat").alias("_plat"), c("_l.lon").alias("_plon")
    )
    bent = rows.where("method = 'tps' and n >= 5").select("map_id", "anchor_id", "lat", "lon").join(
        predicted, ["map_id", "anchor_id"]
    )
    both = flat.unionByName(bent).where(c("_plat").isNotNull() & c("_plon").isNotNull())
    return both.select(
        "map_id", "anchor_id", haversine_m(c("lat"), c("lon"), c("_plat"), c("_plon")).alias("loo_residual_m")
    )


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Interpolated median per key without gathering a key's values in one place."""
    numbered = number_rows(df.select(*keys, value), keys, [F.col(value)], "_k")
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    middle = numbered.join(total, keys).where(
        (F.col("_k") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_k") == F.floor(F.col("_n") / 2) + 1)
    )
    return middle.groupBy(*keys).agg(F.avg(value).alias(out))


def outliers(anchors: DataFrame, quality: DataFrame, loo: DataFrame) -> DataFrame:
    """Flag anchors that disagree with the rest of a checked fit."""
    c = F.col
    limits = exact_median(loo, ["map_id"], "loo_residual_m", "_median").select(
        "map_id", F.greatest(F.lit(OUTLIER_MIN_M), c("_median") * OUTLIER_FACTOR).alias("_limit")
    )
    rows = (
        anchor_residuals(anchors, quality)
        .join(quality.where("ok").select("map_id", "rms", "checked"), "map_id")
        .join(loo, ["map_id", "anchor_id"], "left")
        .join(limits, "map_id", "left")
    )
    by_loo = c("loo_residual_m") > c("_limit")
    by_rms = c("residual_m") > F.greatest(F.lit(OUTLIER_MIN_M), c("rms") * OUTLIER_FACTOR)
    flag = c("checked") & F.when(c("loo_residual_m").isNotNull(), by_loo).otherwise(by_rms)
    return rows.select("map_id", "anchor_id", "residual_m", "loo_residual_m", flag.alias("outlier"))


def fit_status(quality: DataFrame, flagged: DataFrame, anchor_counts: DataFrame) -> DataFrame:
    """Message and tone of every map's fit. ``anchor_counts`` counts all anchors, usable or not."""
    c = F.col
    odd = flagged.groupBy("map_id").agg(F.max("outlier").alias("_odd"))
    df = quality.join(odd, "map_id", "left").join(anchor_counts, "map_id", "left")
    count, has_odd = F.coalesce("anchors", F.lit(0)), F.coalesce("_odd", F.lit(False))
    # fixed values: method names and messages
    names = (
        F.when(c("method") == "similarity", "scale and rotate").when(c("method") == "affine", "stretch to fit")
        .otherwise("rubber sheet")
    )
    mpp = c("meters_per_pixel")
    scale = F.when(mpp >= 1, F.concat(fixed(mpp, 1), F.lit(" m"))).otherwise(F.concat(whole(mpp * 100), F.lit(" cm")))
    placed = F.concat(F.lit("Placed using "), names, F.lit(". About "), scale, F.lit(" per map pixel."))
    agree = F.concat(
        placed, F.lit(" Anchors agree within "), F.replace(format_residual(c("rms")), F.lit("±"), F.lit("")),
        F.lit(" on average."),
    )
    odd_text = F.lit(" The red anchor is the odd one out: re-check its spot or coordinates.")
    loose_text = F.lit(" That’s loose. If the map is hand-drawn, try the rubber sheet method with more anchors.")
    thin = ~c("checked") & (count >= 4) & (c("requested") != "similarity")
    loose = c("rms") > LOOSE_RMS_M
    text = (
        F.when(c("reason") == "degenerate", "These anchors sit on top of each other. Spread them across the map.")
        .when(~c("ok") & (count == 0), "")
        .when(
            ~c("ok"),
            F.concat(
                F.lit("Add "), c("need").cast("string"), F.lit(" more anchor"),
                F.when(c("need") == 1, "").otherwise("s"), F.lit(" with coordinates to place the map."),
            ),
        )
        .when(
            c("mirrored"),
            "The anchors describe a mirror image. Latitude and longitude may be swapped on one of them.",
        )
        .when(
            c("implausible_scale"),
            F.concat(placed, F.lit(" That scale looks wrong for a park map; check each anchor’s coordinates.")),
        )
        .when(
            thin,
            "These anchors do not spread far enough across the map to check a stretch in every direction. "
            "Add an anchor farther from their line to confirm the fit.",
        )
        .when(~c("checked"), F.concat(placed, F.lit(" Add another anchor so the fit can be checked.")))
        .when(has_odd, F.concat(agree, odd_text))
        .when(loose, F.concat(agree, loose_text))
        .otherwise(agree)
    )
    tone = (
        F.when(~c("ok"), F.lit(None))
        .when(c("mirrored") | c("implausible_scale"), "warn")
        .when(~c("checked"), "good")
        .when(has_odd | loose, "warn")
        .otherwise("good")
    )
    return df.select("map_id", text.alias("text"), tone.alias("tone"))


def overlay_mesh(fits: DataFrame, maps: DataFrame, cells: int) -> DataFrame:
    """Row-major grid nodes over each fitted map, shaped by its aspect, with lat/lon."""
    c = F.col
    count = max(1, int(cells + 0.5))
    w, h = F.greatest(c("width"), F.lit(0)).cast("double"), F.greatest(c("height"), F.lit(0)).cast("double")
    aspect = w / F.greatest(h, F.lit(2.220446049250313e-16))
    near = lambda v: F.greatest(F.lit(1), F.floor(v + 0.5)).cast("int")
    # Nodes are listed behind the join, so that a map is one row in the shuffle and not one a node.
    fitted = maps.select("map_id", "width", "height").join(fits.where("ok").select(*MODEL).repartition("map_id"), "map_id")
    grid = (
        fitted.withColumn("cols", F.when(aspect >= 1, F.lit(count)).otherwise(near(aspect * count)))
        .withColumn("rows", F.when(aspect >= 1, near(F.lit(float(count)) / aspect)).otherwise(F.lit(count)))
        .withColumn("row", F.explode(F.sequence(F.lit(0), c("rows"))))
        .withColumn("col", F.explode(F.sequence(F.lit(0), c("cols"))))
        .withColumn("x", w * c("col") / c("cols"))
        .withColumn("y", h * c("row") / c("rows"))
    )
    return _placed(grid, ["map_id", "row", "col", "x", "y"])


def overlay_quad(fits: DataFrame, maps: DataFrame) -> DataFrame:
    """Corner rows south-west, south-east, north-east, north-west of every fitted map."""
    corners = maps.select(
        "map_id",
        F.posexplode(F.expr(
            "array(struct(0D x, double(height) y), struct(double(width) x, double(height) y),"
            " struct(double(width) x, 0D y), struct(0D x, 0D y))"
        )).alias("corner", "_p"),
    ).select("map_id", "corner", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    return apply_fit(corners, fits)
