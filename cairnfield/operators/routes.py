"""Bulk route labels on trails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.operators.lines import KEYS, close_as_loop, reverse_lines, ring_facts
from cairnfield.session import cut


def set_routes(v: DataFrame, commands: DataFrame, tolerance: float) -> dict[str, DataFrame]:
    """Apply route commands (want = loop, one-way or clear; optional want_direction).

    ``verdicts`` has one row per command with the refusal or the new direction; ``vertices`` has the
    geometry of every accepted loop, closed and turned to the wanted direction.
    """
    c = F.col
    facts = ring_facts(v).select(*KEYS, "n", "touching", "first")
    loops = close_as_loop(v, tolerance).withColumnRenamed("error", "_loop_error").withColumnRenamed("direction", "_turn")
    rows = commands.join(facts, KEYS).join(loops, KEYS)
    # fixed values: refusal texts
    one_way = F.when(c("n") < 2, "A one-way trail needs at least 2 points.").when(
        c("touching"), "A closed trail cannot be marked as a one-way route."
    )
    error = F.when(c("want") == "loop", c("_loop_error")).when(c("want") == "one-way", one_way)
    rows = rows.withColumn("error", error)
    good_loop = (c("want") == "loop") & c("error").isNull()
    direction = F.when(good_loop, F.coalesce("want_direction", "_turn"))
    rows = cut(rows.withColumn("direction", direction).withColumn("_flip", good_loop & (c("direction") != c("_turn"))))
    top = v.groupBy(*KEYS).agg(F.max("idx").alias("_top"))
    closed = v.join(rows.where("direction is not null").select(*KEYS, "first", "_flip"), KEYS).join(top, KEYS)
    last = c("idx") == c("_top")
    closed = closed.withColumn("x", F.when(last, c("first.x")).otherwise(c("x"))).withColumn("y", F.when(last, c("first.y")).otherwise(c("y")))
    stay = closed.where("not _flip").select(*KEYS, "idx", "x", "y")
    turned = reverse_lines(closed.where("_flip").select(*KEYS, "idx", "x", "y"))
    return {
        "verdicts": rows.select(*KEYS, "want", "error", "direction"),
        "vertices": stay.unionByName(turned.select(*stay.columns)),
    }


def choose_start(v: DataFrame, sides: DataFrame) -> DataFrame:
    """Make the wanted end (side 0 or 1) the first vertex of one-way trails."""
    return v.join(sides.where("side = 0").select(*KEYS), KEYS, "left_semi").unionByName(
        reverse_lines(v, sides.where("side = 1"))
    )
