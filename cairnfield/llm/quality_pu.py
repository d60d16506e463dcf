"""A quality classifier learnt from trusted positives and unlabelled text (non-negative risk)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import Texts, kept_apart, slices, small_batches
from cairnfield.llm.documents import RATIOS, base_counts, ratios

#: Expected number of rows of each kind (positive, unlabelled, trusted negative) that the fit reads at most.
SAMPLE = 12_000
STEPS, BATCH, HIDDEN = 1500, 512, 16


def with_ratios(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The kept columns and ``x``, the text's ratios."""
    small_batches(docs.sparkSession)
    base = docs.select(*keep, F.col(text).alias("_body"))
    names = base.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_body"):
                t = Texts(part.column("_body"))
                x = ratios(t, base_counts(t))
                arr = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(RATIOS)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [arr], names=[*names, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{schema}, x array<float>")


def bounded(rows: DataFrame, key: str, size: int, id_col: str) -> DataFrame:
    """Rows of each value of ``key`` by a hash of their id, ``size`` of each value in expectation; all, where there are fewer."""
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(key) == value, F.lit(min(1.0, size / n))).otherwise(share)
    return rows.where(u < share)


class Network:
    """One hidden layer; trained by Adam on a given gradient of its output."""

    def __init__(self, n: int, rng: np.random.Generator):
        self.p = [rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        self.x, self.h = x, np.tanh(x @ self.p[0] + self.p[1])
        return self.h @ self.p[2] + self.p[3][0]

    def step(self, grad: np.ndarray, rate: float) -> None:
        back = grad[:, None] * self.p[2] * (1 - self.h**2)
        g = [self.x.T @ back, back.sum(0), self.h.T @ grad, np.array([grad.sum()])]
        self.t += 1
        for p, d, m, v in zip(self.p, g, self.m, self.v, strict=True):
            d = d + 1e-4 * p
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 3) -> Network:
    """Minimise prior * R_p+ + max(0, R_u- - prior * R_p-) with the sigmoid loss.

    Where a batch's negative part falls below zero, the step instead undoes it, as the method asks.
    """
    rng = np.random.default_rng(seed)
    net = Network(pos.shape[1], rng)
    for k in range(STEPS):
        a, b = pos[rng.integers(0, len(pos), BATCH)], unl[rng.integers(0, len(unl), BATCH)]
        s = sigmoid(net(np.concatenate([a, b])))
        slope = s * (1 - s)  # of the loss sigmoid(z) of calling a row positive
        negative = s[BATCH:].mean() - prior * s[:BATCH].mean()
        grad = np.concatenate([np.full(BATCH, -prior), np.zeros(BATCH)])  # from R_p+, loss sigmoid(-z)
        part = np.concatenate([np.full(BATCH, -prior), np.ones(BATCH)])
        grad = -part if negative < 0 else grad + part
        net.step(grad * slope / BATCH, 0.01 * (1 - k / STEPS))
    return net


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, c = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(25):
        p = sigmoid(x @ w)
        g = x.T @ (c * (p - y)) / len(x) + ridge * w
        h = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in unlabelled text, from trusted positives and unlabelled rows alone.

    A classifier tells half of the positives from the unlabelled rows. Above any score, the share of
    unlabelled rows over the share of held-back positives is the class share plus what negatives add;
    the least such ratio, each with the error that its counts allow, is the estimate.
    """
    half = len(pos) // 2
    if not half or not len(unl):
        return 0.5
    n = min(half, len(unl))
    y = np.concatenate([np.ones(half), np.zeros(len(unl))])
    weight = np.concatenate([np.full(half, n / half), np.full(len(unl), n / len(unl))])  # as if both were equally many
    w = fit_logistic(np.concatenate([pos[:half], unl]), y, weight)
    z_pos, z_unl = (np.sort(np.column_stack([x, np.ones(len(x))]) @ w)[::-1] for x in (pos[half:], unl))
    p = np.arange(1, len(z_pos) + 1) / len(z_pos)
    u = np.searchsorted(-z_unl, -z_pos, "right") / len(z_unl)
    error = 1 / np.sqrt(len(z_pos)) + 1 / np.sqrt(len(z_unl))
    best = int(np.argmin((u + error) / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


class Model:
    """Scaling, network and calibration; an untrained one scores 0.5."""

    def __init__(self, pos: np.ndarray, unl: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int):
        self.net = None
        if not len(pos) or not len(unl):
            return
        both = np.concatenate([pos, unl])
        self.mean, self.std = both.mean(0), both.std(0) + 1e-3
        p, u, n = self.scaled(pos), self.scaled(unl), self.scaled(neg) if len(neg) else neg
        self.prior = class_prior(p, u)
        # What the labels say of the share serves the calibration alone, which rests on labelled rows.
        share = float(np.clip(n_pos / max(n_pos + n_neg, 1), 0.01, 0.99))
        self.net = fit_nnpu(p, u, self.prior)
        z_pos = self.net(p)
        if len(neg):
            z = np.concatenate([z_pos, self.net(n)])
            y = np.concatenate([np.ones(len(p)), np.zeros(len(n))])
            weight = np.concatenate([np.full(len(p), share / len(p)), np.full(len(n), (1 - share) / len(n))]) * len(z)
            self.line = fit_logistic(z[:, None], y, weight)
        else:
            self.line = np.array([1.0, 0.0])
        self.net.x = self.net.h = None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(x), 0.5)
        return sigmoid(self.net(self.scaled(x)) * self.line[0] + self.line[1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", sample: int = SAMPLE, unlabelled: Column | None = None) -> Model:
    """Fit on a sample of at most about ``sample`` rows a kind: positives, unlabelled, trusted negatives.

    ``labels`` has one row a labelled document (null ids and labels are left out, repeated ids take
    their greatest label); documents that it does not name, and that meet ``unlabelled`` if given,
    are the unlabelled text. The fold is chosen from ids alone, before any text is read.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(quality).alias("_q"))
    ids = docs.select(F.col(doc_id).alias("_id")).where("_id is not null").join(known, "_id", "left")
    kind = F.when(F.col("_q") == 1, 1).when(F.col("_q") == 0, 0).when(F.lit(True) if unlabelled is None else unlabelled, 2)
    kinds = ids.withColumn(doc_id, F.col("_id")).withColumn("_kind", kind).where("_kind is not null")
    n = {r[0]: r[1] for r in kinds.groupBy("_kind").count().collect()}
    chosen = bounded(kinds, "_kind", sample, "_id").select("_id", "_kind").distinct()
    # Few ids by the bound above; the texts are read once and only theirs are kept.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    x = with_ratios(rows, "_text", [F.col("_id"), F.col("_kind")]).orderBy("_id").toPandas()
    by = [np.array(x.loc[x["_kind"] == k, "x"].tolist(), float).reshape(-1, len(RATIOS)) for k in (1, 2, 0)]
    return Model(*by, n.get(1, 0), n.get(0, 0))


def score(docs: DataFrame, model: Model, keep: list[Column], text: str = "text", cut: float = 0.3) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 from ``cut`` on). Null and empty texts are scored by their zero ratios. A kept column called score or predicted gets a leading underscore."""
    small_batches(docs.sparkSession)
    base, named = kept_apart(docs, keep, text, ("score", "predicted"))
    names = base.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                t = Texts(part.column("body"))
                s = shared.value.score(ratios(t, base_counts(t)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema.fields[:-1])
    return named(base.mapInArrow(run, f"{schema}score double, predicted int"))
