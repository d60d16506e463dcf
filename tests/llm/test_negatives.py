"""Hard negatives against brute force over all rows."""

import math
import random

from pyspark.sql import functions as F

from cairnfield.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, q int"


def brute(rows, n_pos=5, n_neg=10):
    known = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(math.floor(256 * x)) > negatives.LIMIT for x in v):
            continue
        known.append((vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for a_id, a_label, a in sorted({(i, lab, tuple(q)) for i, lab, q in known if i % 100 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, q, strict=False)), i, lab) for i, lab, q in known)
        positives = [(i, -s) for s, i, lab in scored if lab == a_label and i != a_id][:n_pos]
        for p_id, p in positives:
            fit = [(i, -s) for s, i, lab in scored if lab != a_label and 30 * p <= -100 * s <= 90 * p][:n_neg]
            out += [(a_id, p_id, k + 1, i, p, s) for k, (i, s) in enumerate(fit)]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **more).drop("positive_rank").collect())


def vectors(n, dims, seed, grain=8):
    rng = random.Random(seed)
    # Coarse components and a common vector make many equal scores.
    common = [rng.randint(-grain, grain) / grain for _ in range(dims)]
    return [(k, common if rng.random() < 0.3 else [rng.randint(-grain, grain) / grain for _ in range(dims)], rng.randrange(3), "s", 1) for k in range(n)]


def test_agrees_with_brute_force_in_small_blocks_and_passes(spark):
    rows = vectors(700, 6, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert len(want) > 100
    assert got(df) == want
    assert got(df, block_rows=37, pass_anchors=2) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [*vectors(120, 4, 2), (None, [1.0] * 4, 1, None, 1), (200, None, 1, None, 1), (300, [1.0, 0.0, 0.0, 0.0], None, None, 1), (301, [inf, 0.0, 0.0, 0.0], 1, None, 1),
            (302, [nan, 0.0, 0.0, 0.0], 1, None, 1), (303, [None, 1.0, 0.0, 0.0], 1, None, 1), (304, [3e38, 0.0, 0.0, 0.0], 1, None, 1), (400, [], 1, None, 1), (500, [0.0] * 4, 1, None, 1),
            (600, [1.0, 1.0], 1, None, 1), (700, [1.0, 1.0, 0.5, 0.25, 2.0, -1.0], 2, None, 1), (701, [1.0, 1.0, 0.5, 0.25, 2.0, -0.5], 2, None, 1)]
    rows += [rows[5], rows[100]]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame(rows[1:50], SCHEMA)) == []


def test_large_components_stay_exact(spark):
    big = float((1 << 26) // 256 - 1)
    rows = [(k, [big - k % 5, -big + (k * 7) % 11, big], k % 2, "s", 1) for k in range(300)]
    assert got(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))) == brute(rows)


def test_stops_before_all_rows_are_met():
    import numpy as np

    rng = np.random.default_rng(3)
    q = rng.integers(-50, 50, (4000, 3))
    block = negatives.Sorted(np.arange(4000), np.zeros(4000, int), q)
    best, met = negatives.Best(5), 0
    for rows, scores, threshold in block.access(np.array([40, -3, 0])):
        best.add(block.ids[rows], scores)
        met += len(rows)
        if threshold is not None and not best.open(threshold):
            break
    assert met < 1000
    score = q @ np.array([40, -3, 0])
    assert best.ids.tolist() == np.lexsort((np.arange(4000), -score))[:5].tolist()


def test_label_column_may_be_an_expression(spark):
    rows = vectors(300, 4, 5)
    moved = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab, s, q) for i, v, lab, s, q in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))) == brute(moved)
