"""Evidence along lines that are long enough for any hidden sampling limit to show."""

import math

import pytest

from cairnfield.operators.trace import candidate_confidence

END = 1200


def _expected(step):
    """Confidence of the line (0, 10) to (END, 10) from samples ``step`` apart, in plain Python."""
    ink = {(x, y) for x in range(-2, END + 3) for y in (9, 10, 11) if x % 16 < 7}
    n = math.ceil(END / step)
    found, width = [], []
    for k in range(n + 1):
        x = math.floor(END * k / n + 0.5)
        hit = any((math.floor(END * k / n + dx + 0.5), 10 + dy) in ink for dx in (-1, 0, 1) for dy in (-1, 0, 1))
        reach = [next((d for d in range(1, 9) if (x, 10 + side * d) not in ink), 9) - 1 for side in (-1, 1)]
        found.append(hit)
        width.append(sum(reach) + hit)
    mean = lambda v: sum(v) / len(v)
    support, w = mean(found), mean(width)
    spread = math.sqrt(max(0.0, mean([v * v for v in width]) - w * w))
    line = 0.73 * support + 0.17 * math.exp(-max(0.0, w - 2) / 2) + 0.04 / (1 + spread / max(w, 1.0)) + 0.06
    high, low = 200 / 255, 30 / 255
    light, saturation = (high + low) / 2, (high - low) / (1 - abs(high + low - 1))
    unit = lambda t: min(1.0, max(0.0, t))
    quality = unit((saturation - 0.25) / 0.45) * unit((0.78 - light) / 0.4)
    return unit(unit(line) * (0.4 + 0.6 * quality))


@pytest.mark.parametrize("most,step", [(None, 2.0), (100, 12.0)])
def test_confidence_looks_at_the_whole_line(spark, most, step):
    px = spark.createDataFrame([(1, x, y, 200, 30, 30) for x in range(-2, END + 3) for y in (9, 10, 11) if x % 16 < 7], "map_id int, x int, y int, r int, g int, b int")
    chips = spark.createDataFrame([(1, 1, 200, 30, 30)], "map_id int, chip_id int, r int, g int, b int")
    v = spark.createDataFrame([(1, "a", 0, 0.0, 10.0), (1, "a", 1, float(END), 10.0)], "map_id int, candidate_id string, idx bigint, x double, y double")
    cands = spark.createDataFrame([(1, "a", 1, float(END), 20.0, 40.0)], "map_id int, candidate_id string, chip_id int, length_px double, min_length_px double, tolerance double")
    got = candidate_confidence(cands, v, px, chips, most).first().confidence
    assert got == pytest.approx(_expected(step), abs=1e-9)
    assert abs(_expected(2.0) - _expected(12.0)) > 1e-4
