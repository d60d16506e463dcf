"""Plane geometry and pacing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnfield.constants import BASE_DELAY_MS, MAX_DELAY_MS, MAX_WORKING_SIDE
from cairnfield.functions.geo import clamp, round_half_up


def distance2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def project_on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """STRUCT<t, x, y, d2>: nearest point of a segment; t is 0 for a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        clamp(((px - x1) * dx + (py - y1) * dy) / F.nullif(len2, F.lit(0.0)), 0.0, 1.0)
    )
    x, y = x1 + t * dx, y1 + t * dy
    return F.struct(t.alias("t"), x.alias("x"), y.alias("y"), distance2(px, py, x, y).alias("d2"))


def _entry_exit(start: Column, delta: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Parameter range in which one coordinate of a segment lies between two bounds."""
    first = (low - start) / F.nullif(delta, F.lit(0.0))
    last = (high - start) / F.nullif(delta, F.lit(0.0))
    inside = (start >= low) & (start <= high)
    still = delta == 0
    return (
        F.when(still, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(first, last)),
        F.when(still, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(first, last)),
    )


def segment_intersects_rect(
    x1: Column, y1: Column, x2: Column, y2: Column, left: Column, top: Column, right: Column, bottom: Column
) -> Column:
    """Closed segment meets closed rectangle, also when no end lies inside."""
    ax, bx = _entry_exit(x1, x2 - x1, left, right)
    ay, by = _entry_exit(y1, y2 - y1, top, bottom)
    return F.greatest(F.lit(0.0), ax, ay) <= F.least(F.lit(1.0), bx, by)


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the edge (x1,y1)-(x2,y2) crosses the ray from (px,py) to the right."""
    straddles = (y1 > py) != (y2 > py)
    return straddles & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def working_size(width: Column, height: Column, cap: int = MAX_WORKING_SIDE) -> Column:
    k = F.least(F.lit(1.0), F.lit(float(cap)) / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(1), round_half_up(v * k)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"), (k < 1).alias("scaled"))


def retry_delay_ms(attempt: Column, retry_after_s: Column, u: Column) -> Column:
    """Exponential delay with jitter between half and full, never below the server's own wait."""
    grown = F.least(
        F.lit(float(MAX_DELAY_MS)), F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)) * BASE_DELAY_MS
    )
    jittered = round_half_up(grown * (clamp(u, 0.0, 1.0) * 0.5 + 0.5))
    asked = F.when(retry_after_s >= 0, retry_after_s * 1000)
    return F.greatest(jittered.cast("double"), F.coalesce(asked, F.lit(0.0)))
