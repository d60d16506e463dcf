"""Hard negatives by Fagin's threshold algorithm over sorted per-dimension lists.

Every task cuts its rows into blocks. A block keeps one list of its rows a dimension, sorted by that
component. An anchor reads the lists from the end that its own component's sign favours (sorted
access), scores each row it meets for the first time by the whole integer product (random access),
and stops once the threshold, the best score that an unseen row can still have, falls strictly
below the kth score of every window that is still open. Equal scores are settled by the smaller id,
so the threshold must be strictly below. What a task knows of a window is carried to its later
blocks; the tasks' winners meet in Spark.

Anchors are taken in passes of ``PASS_ANCHORS`` at most: one pass sends so many vectors to the tasks,
which is the only broadcast, and reads the rows once for positives and once for negatives.

Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do
rows with a component beyond +-``LIMIT``, whose products could pass 64 bits. Vectors of unequal
length are compared as if the shorter one ended in zeros. Rows that repeat an id are rows of their
own, but no row counts as another row for an anchor with the same id; equal anchors count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm.common import batch_of, bounded_batches
from cairnfield.session import cut

PASS_ANCHORS = 16384
BLOCK_ROWS = 8192
#: Least and greatest component after scaling; 2^26 squared times 512 dimensions stays within 64 bits.
LIMIT = 1 << 26
FIRST_DEPTH = 8


def scaled(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """Rows that take part as (vec_id, label, q), q the floors of 256 times each component."""
    whole = lambda v: F.floor(v.cast("double") * 256)
    fits = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float(LIMIT)) & (F.abs(whole(v)) <= LIMIT), F.lit(False))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", fits))
    return rows.select("vec_id", "label", F.transform("v", lambda v: whole(v).cast("int")).alias("q"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of one matrix, ended by zeros where shorter than ``width``."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    wide = max(width, int(n.max()) if len(n) else 0)
    out = np.zeros((len(n), wide), np.int64)
    out[np.arange(wide) < n[:, None]] = flat
    return out


class Sorted:
    """A block of rows with its sorted lists. Scores are exact: doubles only where no sum can pass 2^52."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels = ids, labels
        self.order = np.argsort(q, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(q, self.order, 0)
        self.q = q.astype(np.float64)
        self.norm = float(np.sqrt((self.q**2).sum(1)).max()) if len(q) else 0.0
        self.q_int = q
        self.seen = np.zeros(len(ids), bool)

    def product(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if self.norm * float(np.sqrt((a.astype(np.float64) ** 2).sum())) < 2.0**52:
            return (self.q[rows] @ a.astype(np.float64)).astype(np.int64)
        return (self.q_int[rows] * a).sum(1)

    def access(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows met for the first time, their scores, and the threshold after them (None: all are met)."""
        n, live = len(self.ids), np.flatnonzero(a)
        if not n:
            return
        if not len(live):
            yield np.arange(n), np.zeros(n, np.int64), None
            return
        up = a[live] > 0
        weight, depth, step, met = a[live], 0, FIRST_DEPTH, []
        try:
            while depth < n:
                to = min(n, depth + step)
                # The list's far end for a positive component, its near end for a negative one.
                down = self.order[n - to : n - depth, live[up]].ravel()
                rise = self.order[depth:to, live[~up]].ravel()
                found = np.concatenate((down, rise))
                found = np.unique(found[~self.seen[found]])
                self.seen[found] = True
                met.append(found)
                edge = np.where(up, self.values[n - to, live], self.values[to - 1, live])
                depth, step = to, step * 2
                yield found, self.product(found, a), None if depth == n else int(edge @ weight)
        finally:
            for found in met:
                self.seen[found] = False


class Best:
    """The first ``k`` of a window: higher scores first, ties by smaller id."""

    __slots__ = ("high", "ids", "k", "low", "scores")

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = np.ones(len(scores), bool) if self.low is None else (scores >= self.low) & (scores <= self.high)
        if len(self.scores) == self.k:
            ok &= scores >= self.scores[-1]
        if not ok.any():
            return
        ids, scores = np.concatenate((self.ids, ids[ok])), np.concatenate((self.scores, scores[ok]))
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[first], scores[first]

    def open(self, threshold: int) -> bool:
        """True while an unseen row, of this score at most, could still enter."""
        if self.low is not None and threshold < self.low:
            return False
        return len(self.scores) < self.k or threshold >= self.scores[-1]


def search(block: Sorted, a: np.ndarray, keep, windows: list[Best]) -> None:
    """Threshold algorithm of one anchor in one block; ``keep`` says which rows may enter."""
    for rows, scores, threshold in block.access(a):
        ok = keep(rows)
        for w in windows:
            w.add(block.ids[rows[ok]], scores[ok])
        if threshold is None or not any(w.open(threshold) for w in windows):
            return


def blocks(batches: Iterator[pa.RecordBatch], width: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of at most ``limit`` rows at once."""
    held: list[pa.RecordBatch] = []
    n = 0

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        col = lambda c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        return col("vec_id").to_numpy(zero_copy_only=False), col("label").to_numpy(zero_copy_only=False), matrix(col("q"), width)

    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            part = batch.slice(at, limit)
            if n + part.num_rows > limit and held:
                yield out()
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield out()


def _anchors(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = max((len(r.q) for r in rows), default=0)
    q = np.zeros((len(rows), wide), np.int64)
    for k, r in enumerate(rows):
        q[k, : len(r.q)] = r.q
    return np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int64), q


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if len(a) == width else np.concatenate((a, np.zeros(width - len(a), np.int64)))


POSITIVE = "a long, vec_id long, score long"
NEGATIVE = "a long, positive_rank int, positive_id long, positive_score long, vec_id long, score long"


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score ns with low * score <= 100 * ns <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def hard_negatives(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", anchors: Column | None = None,
    n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, pass_anchors: int = PASS_ANCHORS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each anchor and each of its ``n_positives`` nearest rows of the same label, the first
    ``n_negatives`` rows of other labels whose score is within ``low`` to ``high`` hundredths of the positive's.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score and
    positive_rank. A positive with a negative score has an empty window. An empty table, or one
    without anchors, gives no row.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = scaled(df, vec_id, vector, F.col(label) if isinstance(label, str) else label)
    wanted = (F.col("vec_id") % 100 == 0) if anchors is None else anchors
    # Half a pass on average, so that no pass exceeds its bound by chance of the hash.
    asked = rows.where(wanted).distinct()
    passes = -(-asked.count() // pass_anchors)
    out = None
    spread = cut(asked.withColumn("_p", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(2 * max(1, passes))))) if passes > 1 else asked
    for p in range(2 * passes if passes > 1 else passes):
        chosen = spread.where(F.col("_p") == p) if passes > 1 else spread
        # Bounded by pass_anchors: one pass, and the driver forgets it before the next.
        ids, labels, q = _anchors(chosen.select("vec_id", "label", "q").collect())
        if not len(ids):
            continue
        part = _one_pass(rows, ids, labels, q, n_positives, n_negatives, low, high, block_rows)
        if passes > 1:
            part = cut(part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    return out


def _one_pass(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, n_pos: int, n_neg: int, low: int, high: int, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((ids, labels, q))

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, a_q = sent.value
        best = [Best(n_pos) for _ in a_ids]
        for b_ids, b_labels, b_q in blocks(batches, a_q.shape[1], block_rows):
            for lab in np.intersect1d(a_labels, b_labels):
                own = np.flatnonzero(b_labels == lab)
                block = Sorted(b_ids[own], b_labels[own], b_q[own])
                for k in np.flatnonzero(a_labels == lab):
                    search(block, _widened(a_q[k], b_q.shape[1]), lambda r, k=k, block=block: block.ids[r] != a_ids[k], [best[k]])
        yield _packed(best, positive_schema)

    def _packed(best: list[Best], schema: pa.Schema) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        return batch_of(schema, at, np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best]))

    positive_schema = pa.schema([("a", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    nearest = Window.partitionBy("a").orderBy(F.desc("score"), "vec_id")
    met = rows.mapInArrow(positives, POSITIVE).withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= n_pos)
    # pass_anchors times n_positives rows at most.
    found = sorted((r.a, r.r, r.vec_id, r.score) for r in met.collect())
    pairs = spark.sparkContext.broadcast(np.array(found, np.int64).reshape(-1, 4))
    negative_schema = pa.schema([("a", pa.int64()), ("positive_rank", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, a_q = sent.value
        known = pairs.value
        # Positives of one anchor with equal scores share a window.
        windows: dict[int, dict[int, Best]] = {}
        for a, _, _, score in known.tolist():
            if score >= 0:
                windows.setdefault(a, {}).setdefault(score, Best(n_neg, *window_of(score, low, high)))
        for b_ids, b_labels, b_q in blocks(batches, a_q.shape[1], block_rows):
            block = Sorted(b_ids, b_labels, b_q)
            for a, mine in windows.items():
                search(block, _widened(a_q[a], b_q.shape[1]), lambda r, a=a, block=block: block.labels[r] != a_labels[a], list(mine.values()))
        for at in range(0, len(known), 4096):
            part = [(row, windows[row[0]][row[3]]) for row in known[at : at + 4096].tolist() if row[3] >= 0]
            if part:
                n = [len(b.ids) for _, b in part]
                col = lambda k, part=part, n=n: np.repeat(np.array([row[k] for row, _ in part], np.int64), n)
                yield batch_of(negative_schema, col(0), col(1).astype(np.int32), col(2), col(3), np.concatenate([b.ids for _, b in part]), np.concatenate([b.scores for _, b in part]))

    names = spark.createDataFrame([(k, int(x)) for k, x in enumerate(ids)], "a long, anchor_id long")
    best = Window.partitionBy("a", "positive_rank").orderBy(F.desc("score"), "vec_id")
    ranked = rows.mapInArrow(negatives, NEGATIVE).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_neg)
    return ranked.join(F.broadcast(names), "a").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank",
    )
