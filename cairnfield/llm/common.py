"""Shared helpers: tables, folds, and vectorised word hashes over batches of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators.ordered import number_rows
from cairnfield.session import cut

#: Bytes of text whose hashes are worked on at once; one longer text is worked on alone.
CHUNK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python by the thousand, as whole texts may be long; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "1000")


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold 16 MB, or a thousand rows, at most; a session's own settings stay."""
    small_batches(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(16 << 20))


def crc_fold(id_col: str, parts: int) -> Column:
    """Remainder of the CRC-32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that ``df`` does not use yet."""
    taken = {x.lower() for x in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def kept_apart(docs: DataFrame, keep: Sequence[Column], text: str, made: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Kept columns under working names, with the text as ``body`` behind them, and what gives a result with the ``made`` columns behind them their own names back.

    A kept column of the name of a made one gets leading underscores.
    """
    base = docs.select(*keep, F.col(f"`{text}`").cast("string"))
    taken, names = {x.lower() for x in made}, []
    for c in base.columns[:-1]:
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        names.append(c)
    return base.toDF(*(f"k{k}" for k in range(len(names))), "body"), lambda out: out.toDF(*names, *made)


NULL_ID = np.iinfo(np.int64).min


def with_text_key(docs: DataFrame, out: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with a long ``out``: one number for each id and text, in the order of ids, a null id first.

    Where no id has two texts this is the id itself. Otherwise ids and text hashes, without the texts,
    are put in order and numbered, so that rows which share an id by mistake stay apart.
    """
    own, sign = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))
    pairs = docs.select(F.coalesce(own, F.lit(NULL_ID)).alias("_id"), sign.alias("_h"))
    if pairs.groupBy("_id").agg((F.min("_h") != F.max("_h")).alias("two")).where("two").isEmpty():
        return docs.withColumn(out, F.coalesce(own, F.lit(NULL_ID)))
    a, b = fresh(docs, "_id", "_h")
    numbers = cut(number_rows(pairs.distinct(), [], [F.col("_id"), F.col("_h")], out, 0)).toDF(a, b, out)
    return docs.withColumn(a, F.coalesce(own, F.lit(NULL_ID))).withColumn(b, sign).join(numbers, [a, b]).drop(a, b)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base, or of its inverse, modulo 2^64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 2), INVERSE if inverse else BASE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK_BYTES:  # those of one huge text are not kept
            _powers[key] = have
    return have[:n]


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans from running sums of the whole."""
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values times powers, led by 0, and the inverse powers that shift spans to 0."""
    n = len(values) + 1
    prefix = np.zeros(n, np.uint64)
    np.cumsum(values * powers(n - 1), out=prefix[1:])
    return prefix, powers(n, True)


def laid_out(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with \\n after each, and the texts' offsets in them; null texts count as empty."""
    empty, end = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    col = pc.fill_null(texts.cast(pa.large_string()), empty)
    col = pc.binary_join_element_wise(pc.utf8_lower(col) if lower else col, empty, end)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


class Texts:
    """Word spans and hashes of a run of texts, laid out in one byte array with \\n after each.

    Words are runs without the bytes 0x20 and 0x09 to 0x0D; null texts count as empty.
    """

    def __init__(self, texts: pa.Array):
        self.buf, self.at = laid_out(texts)
        b = self.buf
        self.blank = (b == 32) | ((b >= 9) & (b <= 13))
        step = np.diff(self.blank.view(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        self.first = np.searchsorted(self.starts, self.at)
        self.n_words = np.diff(self.first)
        self._prefix: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        if self._prefix is None:
            self._prefix = running(self.buf.astype(np.uint64) + np.uint64(1))
        return self._prefix

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p, inverse = self.prefix
        return span_hashes(p, starts, ends, inverse)

    def word_hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def docs_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``n`` entries."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p, inverse = running(h | np.uint64(1))
    k = np.arange(len(h) - n + 1)
    return span_hashes(p, k, k + n, inverse)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive offsets, empty spans included."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about ``limit`` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    total, begin = np.cumsum(size), 0
    while begin < len(total):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
