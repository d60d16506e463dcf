"""Proximity joins rewritten as equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.session import cut


def cell(value: Column, size: float | Column) -> Column:
    return F.floor(value / size).cast("bigint")


def point_cells(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """One row per point with its own cell."""
    return df.withColumn("_cx", cell(F.col(x), F.lit(size))).withColumn("_cy", cell(F.col(y), F.lit(size)))


def point_cells_around(df: DataFrame, size: float, x: str = "x", y: str = "y", ring: int = 1) -> DataFrame:
    """One row per point and cell of its (2 ring + 1)^2 neighbourhood."""
    steps = F.array(*[F.lit(i) for i in range(-ring, ring + 1)])
    return (
        df.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .withColumn("_cx", (cell(F.col(x), F.lit(size)) + F.col("_dx")).cast("bigint"))
        .withColumn("_cy", (cell(F.col(y), F.lit(size)) + F.col("_dy")).cast("bigint"))
        .drop("_dx", "_dy")
    )


def segment_cells(df: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """One row per segment (x1,y1)-(x2,y2) and cell its padded path passes.

    Columns of cells come from the x range; within a column only the rows that the segment covers
    there are listed, so a long diagonal costs its length and not its bounding box.
    """
    s, p = F.lit(float(size)), F.lit(float(pad))
    lo_x, hi_x = F.least("x1", "x2"), F.greatest("x1", "x2")
    lo_y, hi_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    cols = df.withColumn("_cx", F.explode(F.sequence(cell(lo_x - p, s), cell(hi_x + p, s))))
    dx = F.col("x2") - F.col("x1")
    left = F.greatest(F.col("_cx") * s - p, lo_x)
    right = F.least((F.col("_cx") + 1) * s + p, hi_x)
    ya = F.col("y1") + (F.col("y2") - F.col("y1")) * (left - F.col("x1")) / F.nullif(dx, F.lit(0.0))
    yb = F.col("y1") + (F.col("y2") - F.col("y1")) * (right - F.col("x1")) / F.nullif(dx, F.lit(0.0))
    # A hair of slack keeps rounding at cell borders from losing a cell; extra cells are harmless.
    slack = F.lit(1e-6 * float(size))
    low = F.greatest(F.coalesce(F.least(ya, yb), lo_y) - slack, lo_y) - p
    high = F.least(F.coalesce(F.greatest(ya, yb), hi_y) + slack, hi_y) + p
    return cols.withColumn("_cy", F.explode(F.sequence(cell(low, s), cell(high, s))))


def box_cells(df: DataFrame, size: float, left: str, top: str, right: str, bottom: str) -> DataFrame:
    s = F.lit(float(size))
    return df.withColumn(
        "_cx", F.explode(F.sequence(cell(F.col(left), s), cell(F.col(right), s)))
    ).withColumn("_cy", F.explode(F.sequence(cell(F.col(top), s), cell(F.col(bottom), s))))


#: Segments of one key that are kept together; a key with more is dealt out in zones of ``ZONE`` cells a side.
TOGETHER, ZONE = 1_000_000, 16
#: Segments that a task gets of the others.
PART_ROWS = 250_000
SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def met_in_cells(points: DataFrame, segs: DataFrame, keys: list[str], size: float, pad: float, then: Callable[[DataFrame], DataFrame], x: str = "x", y: str = "y", together: int = TOGETHER) -> DataFrame:
    """``then`` of all rows of points and segments that share a key and a cell of the segment's padded path, written.

    A long segment passes many cells, so rows are shuffled by key alone, and cells are listed and
    looked up behind the shuffle, where they cost neither disk nor memory: points are the hash
    table. Keys with more than ``together`` rows on a side are shuffled by zones of cells, so that no
    task gets a whole one. Both inputs are read more than once and should be written tables.
    """
    c = F.col
    n_segs, n_points = (df.groupBy(*keys).agg(F.count("*").alias("_n")) for df in (segs, points))
    hot = cut(n_segs.where(c("_n") > together).select(*keys).union(n_points.where(c("_n") > together).select(*keys)).distinct().withColumn("_hot", F.lit(True)))
    points = point_cells(points, size, x, y)
    none, on = F.lit(0).cast("bigint"), [*keys]
    if not hot.isEmpty():
        on = [*keys, "_zx", "_zy"]
        zone = lambda v: F.floor(c(v) / ZONE).cast("bigint")
        points = points.join(hot, keys, "left").withColumns({"_zx": F.when(c("_hot"), zone("_cx")).otherwise(none), "_zy": F.when(c("_hot"), zone("_cy")).otherwise(none)}).drop("_hot")
        spread = segment_cells(segs.join(hot.select(*keys), keys, "left_semi"), size * ZONE, pad).withColumnsRenamed({"_cx": "_zx", "_cy": "_zy"})
        segs = segs.join(hot.select(*keys), keys, "left_anti").withColumns({"_zx": none, "_zy": none}).unionByName(spread)
    parts = max(int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions")), segs.count() // PART_ROWS + 1)
    path = segment_cells(segs.repartition(parts, *on), size, pad)
    if not hot.isEmpty():
        # A zone lists its own cells alone; the others' are looked up there.
        inside = (F.floor(c("_cx") / ZONE) == c("_zx")) & (F.floor(c("_cy") / ZONE) == c("_zy"))
        path = path.join(F.broadcast(hot), keys, "left").where(c("_hot").isNull() | inside).drop("_hot")
    met = path.join(points.repartition(parts, *on).hint("shuffle_hash"), [*on, "_cx", "_cy"])
    with together_by_some_keys(points.sparkSession):
        return cut(then(met.drop("_zx", "_zy", "_cx", "_cy")))


@contextmanager
def together_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Joins written inside take rows as they lie when both sides are dealt out by some of the join's keys."""
    before = spark.conf.get(SUBSET_KEYS)
    spark.conf.set(SUBSET_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(SUBSET_KEYS, before)


#: Pairs that one cell, or one block of a cell that cannot be split, compares at most.
LOAD = 1_000_000
#: Sides of boxes from one size class to the next, and deepest split of a cell in one round.
CLASS_STEP, DEEPEST, ROUNDS = 4, 5, 6


def _boxes(df: DataFrame, box: tuple[Column, Column, Column, Column], size: float) -> DataFrame:
    """Boxes as _x0 to _y1 and the size class in which one covers four cells at most."""
    x0, y0, x1, y1 = box
    rows = df.withColumns({"_x0": x0.cast("double"), "_y0": y0.cast("double"), "_x1": x1.cast("double"), "_y1": y1.cast("double")})
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    return rows.withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log(float(CLASS_STEP), F.greatest(side, F.lit(1e-300)) / size))).cast("int"))


def _spread(rows: DataFrame, classes: list[int], size: float) -> DataFrame:
    """One row a box, size class from its own on and cell; cells are named by their size and place."""
    up = rows.withColumn("_k", F.explode(F.filter(F.array(*[F.lit(k) for k in classes]), lambda k: k >= F.col("_own"))))
    up = up.withColumn("_s", F.lit(size) * F.pow(F.lit(float(CLASS_STEP)), F.col("_k")))
    across = up.withColumn("_cx", F.explode(F.sequence(cell(F.col("_x0"), F.col("_s")), cell(F.col("_x1"), F.col("_s")))))
    return across.withColumn("_cy", F.explode(F.sequence(cell(F.col("_y0"), F.col("_s")), cell(F.col("_y1"), F.col("_s")))))


def _into_quarters(rows: DataFrame, heavy: DataFrame, at: list[str]) -> DataFrame:
    """Rows of heavy cells in those of the cells' parts that their boxes meet; a cell is split ``_d`` times at once."""
    c = F.col
    n = F.pow(F.lit(2.0), c("_d")).cast("bigint")
    part = c("_s") / n
    down = rows.join(heavy.select(*at, "_d"), at).withColumns({"_n": n, "_t": part})
    down = down.withColumn("_px", F.explode(F.sequence(F.greatest(cell(c("_x0"), c("_t")), c("_cx") * c("_n")), F.least(cell(c("_x1"), c("_t")), c("_cx") * c("_n") + c("_n") - 1))))
    down = down.withColumn("_py", F.explode(F.sequence(F.greatest(cell(c("_y0"), c("_t")), c("_cy") * c("_n")), F.least(cell(c("_y1"), c("_t")), c("_cy") * c("_n") + c("_n") - 1))))
    return down.withColumns({"_s": c("_t"), "_cx": c("_px"), "_cy": c("_py")}).drop("_d", "_n", "_t", "_px", "_py")


def paired_boxes(
    a: DataFrame, b: DataFrame, keys: list[str], box_a: tuple[Column, Column, Column, Column], box_b: tuple[Column, Column, Column, Column], size: float | None = None, load: int = LOAD, rounds: int = ROUNDS,
) -> DataFrame:
    """All pairs of rows of ``a`` and ``b`` with equal keys whose boxes (left, top, right, bottom) meet, each once.

    Boxes are put into cells of their size. Cells are counted on both sides, and those with more than
    ``load`` pairs are split in quarters, several times at once where the count says so, until none is
    left or splitting no longer parts their boxes; what is crowded then is compared in blocks of
    ``load`` pairs. A pair belongs to the one cell that holds the least corner of what its boxes share,
    so no pair is met twice. Columns of ``a`` and ``b`` must differ except for the keys; null boxes
    meet nothing.
    """
    c = F.col
    if size is None:
        side = lambda df, box: df.agg(F.avg(F.greatest(box[2] - box[0], box[3] - box[1]))).first()[0] or 1.0
        size = max(side(a, box_a), side(b, box_b))
    # Powers of two, so that cells of all sizes nest without rounding.
    size = 2.0 ** math.ceil(math.log2(max(size, 1e-6)))
    own, other = (_boxes(df, box, size).where("_x0 is not null and _y0 is not null and _x1 >= _x0 and _y1 >= _y0") for df, box in ((a, box_a), (b, box_b)))
    # A handful of size classes, one value each.
    classes = sorted(r[0] for r in own.select("_own").union(other.select("_own")).distinct().collect())
    own, other = cut(_spread(own, classes, size)), cut(_spread(other, classes, size))
    at = [*keys, "_k", "_s", "_cx", "_cy"]
    done: list[tuple[DataFrame, DataFrame, int]] = []
    # Rows are few beside their pairs, so tasks are dealt by pairs and not by bytes.
    tasks = lambda pairs: max(1, min(1 << 15, int((pairs or 0) // load) + 1))
    before = None
    for step in range(rounds + 1):
        n_own, n_other = own.groupBy(*at).agg(F.count("*").alias("_na")), other.groupBy(*at).agg(F.count("*").alias("_nb"))
        met = cut(n_own.join(n_other, at).withColumn("_load", c("_na") * c("_nb")))
        crowded = met.where(c("_load") > load)
        every, total = met.agg(F.sum("_load"), F.sum(F.when(c("_load") > load, c("_load")))).first()
        if total is None:
            done.append((own, other, tasks(every)))
            break
        if step == rounds or (before is not None and total > before / 2):
            # Their boxes lie on each other: blocks of both sides, so that no task gets a whole cell.
            edge = max(1, math.isqrt(load))
            blocks = met.select(*at, F.ceil(c("_na") / edge).alias("_ba"), F.ceil(c("_nb") / edge).alias("_bb")).where(c("_na") * c("_nb") > 0)
            salt = lambda df: F.pmod(F.xxhash64(*(c(f"`{x}`") for x in df.columns if not x.startswith("_"))), F.lit(1 << 30))
            mine = own.withColumn("_h", salt(a)).join(blocks, at).withColumn("_ia", c("_h") % c("_ba")).withColumn("_ib", F.explode(F.sequence(F.lit(0).cast("bigint"), c("_bb") - 1))).drop("_h", "_ba", "_bb")
            theirs = other.withColumn("_h", salt(b)).join(blocks, at).withColumn("_ib", c("_h") % c("_bb")).withColumn("_ia", F.explode(F.sequence(F.lit(0).cast("bigint"), c("_ba") - 1))).drop("_h", "_ba", "_bb")
            done.append((mine, theirs, tasks(every)))
            break
        calm = met.where(c("_load") <= load).select(*at)
        done.append((own.join(calm, at, "left_semi"), other.join(calm, at, "left_semi"), tasks(every - total)))
        heavy = crowded.select(*at, F.least(F.lit(DEEPEST), F.greatest(F.lit(1), F.ceil(F.log(4.0, c("_load") / load)))).cast("int").alias("_d"))
        before = total
        own, other = cut(_into_quarters(own, heavy, at)), cut(_into_quarters(other, heavy, at))
    out = None
    for mine, theirs, n in done:
        on = [x for x in (*at, "_ia", "_ib") if x in mine.columns]
        theirs = theirs.withColumnsRenamed({"_x0": "_u0", "_y0": "_v0", "_x1": "_u1", "_y1": "_v1", "_own": "_other"})
        pairs = mine.repartition(n, *on).hint("merge").join(theirs.repartition(n, *on), on).where((F.greatest("_own", "_other") == c("_k")) & (c("_x0") <= c("_u1")) & (c("_u0") <= c("_x1")) & (c("_y0") <= c("_v1")) & (c("_v0") <= c("_y1")))
        home = pairs.where((cell(F.greatest("_x0", "_u0"), c("_s")) == c("_cx")) & (cell(F.greatest("_y0", "_v0"), c("_s")) == c("_cy")))
        part = home.select(*a.columns, *(x for x in b.columns if x not in keys))
        out = part if out is None else out.unionByName(part)
    return out
