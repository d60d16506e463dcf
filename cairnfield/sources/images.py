"""Raster files as pixel rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels that leave a task in one batch.
STRIP_PIXELS = 1 << 18
PIXELS = "map_id string, x int, y int, r smallint, g smallint, b smallint, a smallint"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("image.origin", "/"), -1)
    return spark.read.format("image").option("dropInvalid", False).load(path).select(name.alias("map_id"), "image.*")


def unreadable_images(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, reason) of files under ``path`` that are no image that Spark can decode."""
    return _raw(spark, path).where("height <= 0 or width <= 0").select("map_id", F.lit("not a readable image").alias("reason"))


def read_pixels(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """(map_id, x, y, r, g, b, a) of every readable image under ``path``; see ``unreadable_images`` for the others.

    All pixels, or with a ``stride`` those whose coordinates are multiples of it, numbered anew. An
    image's bytes are viewed once, and its pixels leave in strips of rows.
    """

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["nChannels"]
                cells = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], n)[::stride, ::stride]
                high, wide = cells.shape[:2]
                step = max(1, STRIP_PIXELS // wide)
                for top in range(0, high, step):
                    part = cells[top : top + step].reshape(-1, n)
                    # Bytes are blue, green, red and, with four channels, alpha; one channel is grey.
                    blue, green, red = (part[:, 0],) * 3 if n == 1 else (part[:, 0], part[:, 1], part[:, 2])
                    alpha = part[:, 3] if n == 4 else np.full(len(part), 255)
                    at = np.arange(len(part))
                    cols = [pa.array([row["map_id"]] * len(part)), pa.array((at % wide).astype(np.int32)), pa.array((top + at // wide).astype(np.int32))]
                    cols += [pa.array(v.astype(np.int16)) for v in (red, green, blue, alpha)]
                    yield pa.RecordBatch.from_arrays(cols, names=["map_id", "x", "y", "r", "g", "b", "a"])

    good = _raw(spark, path).where("height > 0 and width > 0")
    return good.select("map_id", "height", "width", "nChannels", "data").mapInArrow(strips, PIXELS)
