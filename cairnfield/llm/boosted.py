"""Quality rules as gradient-boosted trees over document statistics, with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import Texts, kept_apart, slices, small_batches
from cairnfield.llm.documents import RATIOS, base_counts, ratios
from cairnfield.llm.quality_pu import bounded, sigmoid, with_ratios

#: Expected number of labelled rows of each label that the fit reads at most.
SAMPLE = 10_000
TREES, DEPTH, BINS, RATE, LEAST = 60, 3, 64, 0.15, 20
#: Statistics of which more can only lower a text's score.
FALLING = ("symbols", "dup_lines", "repeat3", "same_next", "shout")
CUT = 0.3


class Trees:
    """Complete binary trees in flat arrays: node k has children 2k+1 and 2k+2."""

    def __init__(self, feature: np.ndarray, limit: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.limit, self.value, self.start = feature, limit, value, start

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for all rows; every step moves all rows in all trees one level down."""
        inner = self.feature.shape[1]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))
        row = np.arange(len(x))[:, None]
        while len(self.feature) and node.size and node[0, 0] < inner:
            right = x[row, self.feature[tree, node]] > self.limit[tree, node]
            node = 2 * node + 1 + right
        total = self.value[tree, node - inner].sum(1) if len(self.feature) else np.zeros(len(x))
        return sigmoid(self.start + total)


def fit(x: np.ndarray, y: np.ndarray, falling: list[int], trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost logistic loss on binned features. A split on a falling feature must not raise the score
    on its right side, and the subtrees on either side stay on their side of the middle."""
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else 0.0
    inner, n = (1 << depth) - 1, x.shape[1]
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(n)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(n) * BINS
    z = np.full(len(y), start)
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    falls = np.zeros(n, bool)
    falls[falling] = True
    for t in range(trees):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p)
        rows: dict[int, np.ndarray] = {0: np.arange(len(y))}
        bound: dict[int, tuple[float, float]] = {0: (-np.inf, np.inf)}
        for k in range(2 * inner + 1):
            own, (lo, hi) = rows[k], bound[k]
            if k >= inner:
                v = g[own].sum() / (h[own].sum() + 1.0) if len(own) else 0.0
                value[t, k - inner] = RATE * np.clip(v, lo, hi)
                z[own] += value[t, k - inner]
                continue
            at = flat[own].ravel()
            sums = [np.bincount(at, np.repeat(w[own], n), n * BINS).reshape(n, BINS).cumsum(1) for w in (g, h)] + [np.bincount(at, minlength=n * BINS).reshape(n, BINS).cumsum(1)]
            (gl, hl, cl), (ga, ha, ca) = sums, (s[:, -1:] for s in sums)
            left, right = np.clip(gl / (hl + 1), lo, hi), np.clip((ga - gl) / (ha - hl + 1), lo, hi)
            gain = gl * gl / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga * ga / (ha + 1)
            bad = (cl < LEAST) | (ca - cl < LEAST) | (falls[:, None] & (right > left))
            for f, e in enumerate(edges):
                bad[f, len(e) :] = True
            gain = np.where(bad, -1, gain)
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] <= 1e-6:  # no split: all rows go left, and both sides keep the bounds
                rows[2 * k + 1], rows[2 * k + 2] = own, own[:0]
                bound[2 * k + 1] = bound[2 * k + 2] = (lo, hi)
                continue
            feature[t, k], limit[t, k] = f, edges[f][b]
            go = binned[own, f] > b
            rows[2 * k + 1], rows[2 * k + 2] = own[~go], own[go]
            mid = (left[f, b] + right[f, b]) / 2
            bound[2 * k + 1], bound[2 * k + 2] = ((max(lo, mid), hi), (lo, min(hi, mid))) if falls[f] else ((lo, hi), (lo, hi))
    return Trees(feature, limit, value, start)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most about ``sample`` labelled rows of each label, chosen by a hash of their id.

    Null ids and labels are left out, and repeated ids take their greatest label. Without rows of
    both labels the model is a constant (0.5 without any).
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.max(quality) > 0).cast("int").alias("_q"))
    chosen = bounded(known, "_q", sample, "_id")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    got = with_ratios(rows, "_text", [F.col("_id"), F.col("_q")]).orderBy("_id").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(RATIOS))
    return fit(x, got["_q"].to_numpy(float), [RATIOS.index(f) for f in FALLING])


def judge(docs: DataFrame, model: Trees, keep: list[Column], text: str = "text", cut: float = CUT, least_words: int = 50) -> DataFrame:
    """The kept columns, the base counts, base_failed, score and kept.

    Base rule: fewer than ``least_words`` words, or more than half of them in three-word windows
    that occur twice. Null and empty texts have no words, so they fail it. A kept column of the name of one
    of these gets a leading underscore.
    """
    small_batches(docs.sparkSession)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base, named = kept_apart(docs, keep, text, (*counts, "base_failed", "score", "kept"))
    names = base.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                t = Texts(part.column("body"))
                c = base_counts(t)
                failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                s = shared.value.score(ratios(t, c).astype(float))
                cols = [part.column(x) for x in names] + [pa.array(c[x], pa.int64()) for x in counts] + [pa.array(failed), pa.array(s, pa.float64()), pa.array(~failed & (s >= cut))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *counts, "base_failed", "score", "kept"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema.fields[:-1])
    return named(base.mapInArrow(run, f"{schema}{', '.join(f'{x} long' for x in counts)}, base_failed boolean, score double, kept boolean"))
