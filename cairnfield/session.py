"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys on the large side of a join are split at run time, also when that costs a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "cairnfield", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's defaults; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local master may fall back to its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="cairnfield-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a loop's plan stays short.

    The rows survive lost executors. Reading files also gives the planner real sizes: a
    checkpointed plan keeps its estimates, which multiply with every join of a loop.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most that one table of a step under ``small_broadcasts`` may send through the driver.
BROADCAST_BYTES = 1 << 20


@contextmanager
def small_broadcasts(spark: SparkSession, most: int = BROADCAST_BYTES) -> Iterator[None]:
    """Tables written inside are sent to all tasks only if their rows were counted to take ``most`` bytes.

    Files of cells and numbers shrink so far that a table of 10 MB may be hundreds of MB of rows, and a
    loop sends one after the other through the driver. Here joins are planned with a shuffle, and adaptive execution turns those
    into broadcasts whose shuffled rows are small indeed, so what reaches the driver does not grow with the tables.
    """
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": str(most)}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sends_little(step: Callable) -> Callable:
    """``step`` of a table, or of a graph's tables, under ``small_broadcasts``; joins that it leaves unwritten are not covered."""

    @wraps(step)
    def run(given, *args, **more):
        df = next(iter(given.values())) if isinstance(given, dict) else given
        with small_broadcasts(df.sparkSession):
            return step(given, *args, **more)

    return run
