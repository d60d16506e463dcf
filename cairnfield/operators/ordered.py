"""Ordered work on long sequences without putting a whole sequence into one task.

A line, a device log or a tile queue may hold a large part of all rows. The helpers here cut a
sequence into chunks of ``CHUNK`` positions, work inside chunks, and carry only one row per chunk
between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.session import cut

CHUNK = 4096


def chunk_of(idx: Column) -> Column:
    return F.floor(idx / F.lit(CHUNK))


def with_next(
    df: DataFrame, keys: Sequence[str], cols: dict[str, str], idx: str = "idx", back: bool = False
) -> DataFrame:
    """Add the next (or previous) row's ``cols`` (source -> new name); ``idx`` is dense from 0.

    The first row of a chunk is also sent to the chunk before it, so the window is keyed by
    (keys, chunk) and no task sees more than ``CHUNK + 1`` rows of one sequence.
    """
    own = chunk_of(F.col(idx))
    if back:
        edge, other = F.col(idx) % CHUNK == CHUNK - 1, own + 1
    else:
        edge, other = (F.col(idx) % CHUNK == 0) & (F.col(idx) > 0), own - 1
    spread = df.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(edge, F.array(own, other)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    step = F.lag if back else F.lead
    for source, name in cols.items():
        spread = spread.withColumn(name, step(source).over(w))
    return spread.where("_chunk = _own").drop("_chunk", "_own")


def running(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    idx: str = "idx",
    how: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Running sum or max in ``idx`` order, through two levels of chunk totals."""
    fold = {"sum": F.sum, "max": F.max}[how]
    keys = list(keys)
    rows = df.withColumn("_v", value).withColumn("_c", chunk_of(F.col(idx)))
    rows = rows.withColumn("_cc", chunk_of(F.col("_c")))
    totals = rows.groupBy(*keys, "_c", "_cc").agg(fold("_v").alias("_t"))
    outer = totals.groupBy(*keys, "_cc").agg(fold("_t").alias("_tt"))
    w_outer = Window.partitionBy(*keys).orderBy("_cc").rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.withColumn("_oo", fold("_tt").over(w_outer)).drop("_tt")
    w_mid = Window.partitionBy(*keys, "_cc").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    mid = totals.withColumn("_o", fold("_t").over(w_mid)).drop("_t")
    mid = _null_join(mid, outer, [*keys, "_cc"])
    combine = _add if how == "sum" else F.greatest
    mid = mid.select(*keys, "_c", combine(F.col("_o"), F.col("_oo")).alias("_base"))
    end = 0 if inclusive else -1
    w_in = Window.partitionBy(*keys, "_c").orderBy(idx).rowsBetween(Window.unboundedPreceding, end)
    rows = rows.withColumn("_r", fold("_v").over(w_in))
    joined = _null_join(rows, mid, [*keys, "_c"])
    return joined.withColumn(out, combine(F.col("_r"), F.col("_base"))).drop(
        "_v", "_c", "_cc", "_r", "_base"
    )


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _null_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on keys that may be null (every left key exists on the right)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = term if cond is None else cond & term
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn", start: int = 1
) -> DataFrame:
    """Exact ``row_number`` for keys of any size.

    Rows are range-partitioned by (keys, order) and stored with their partition number, numbered
    inside (keys, partition), and shifted by the counts of the partitions before.
    """
    keys = list(keys)
    placed = cut(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id())
    )
    counts = placed.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys, "_pid").orderBy(*order)
    numbered = placed.withColumn("_rn", F.row_number().over(w))
    joined = _null_join(numbered, offsets, [*keys, "_pid"])
    return joined.withColumn(out, (F.col("_rn") + F.col("_off") + F.lit(start - 1)).cast("bigint")).drop(
        "_pid", "_rn", "_off"
    )


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows per key. Spark trims each partition to ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
