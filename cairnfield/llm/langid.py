"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import fresh, laid_out, slices, small_batches

#: Features: all byte pairs, then byte triples by hash.
PAIRS, TRIPLES = 1 << 16, 1 << 16
FEATURES = PAIRS + TRIPLES
#: Bytes of text whose features are held at once.
PART_BYTES = 1 << 18
#: A code has at most this many bits; a table may have at most this many languages.
MAX_BITS, MAX_LANGUAGES = 63, 200
#: Below this lead over the second codeword, as a share of the code's length, a text is ambiguous.
AMBIGUOUS = 0.02


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the letters' pairs and triples of lower-cased whole texts, and the row of each."""
    raw, at = laid_out(texts, lower=True)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    # Runs of other bytes become one blank, so that only the words' own letters and edges count.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[-1:] = True
    row = np.searchsorted(at, np.flatnonzero(keep), "right") - 1
    b = np.where(letter, raw, 32)[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (b[:-1] << 8) | b[1:]
    three = PAIRS + ((((two[:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16))
    ok2, ok3 = row[:-1] == row[1:], row[:-2] == row[2:]
    f = np.concatenate([two[ok2], three[ok3]]).astype(np.int64)
    r = np.concatenate([row[:-1][ok2], row[:-2][ok3]])
    return f, r


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, one row a language: exhaustive for few languages, else the best of random codes by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = [[1 if l == 0 or k >> (l - 1) & 1 else -1 for l in range(n)] for k in range((1 << (n - 1)) - 1)]
        return np.array(bits, float).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, MAX_BITS))
        m = m[:, np.abs(m.sum(0)) < n]  # a bit that all share says nothing
        gram = m @ m.T
        np.fill_diagonal(gram, -1e9)
        d = (m.shape[1] - gram.max()) / 2
        if d > far:
            best, far = m, d
    return best


def language_counts(docs: DataFrame, text: str, lang: str, languages: list[str]) -> np.ndarray:
    """Feature counts by language over all given rows: each task sums its own rows before anything is shuffled."""
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                f, r = features(part.column("text"))
                who = np.array([number.get(x, -1) for x in part.column("lang").to_pylist()])
                for i in np.unique(who[who >= 0]):
                    total[i] = total.get(i, 0) + np.bincount(f[who[r] == i], minlength=FEATURES)
        for i, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([int(i)], pa.int32()), "counts": pa.array([v.astype(np.int64).tobytes()], pa.binary())})

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(FEATURES, np.int64)
        for frame in rows:
            for x in frame["counts"]:
                total += np.frombuffer(x, np.int64)
        yield pd.DataFrame({"lang": [key[0]], "counts": [total.tobytes()]})

    small_batches(docs.sparkSession)
    parts = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(count, "lang int, counts binary")
    out = np.zeros((len(languages), FEATURES))
    # One row of a fixed size for each language.
    for row in parts.groupBy("lang").applyInPandas(add, "lang int, counts binary").toLocalIterator():
        out[row["lang"]] = np.frombuffer(row["counts"], np.int64)
    return out


class Model:
    """Weights of one binary classifier a bit, and the codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, code_matrix(len(languages))
        # Each language weighs the same in the mean of its side, whatever its share of the rows.
        p = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True) if len(languages) else counts
        w = []
        for bit in self.code.T:
            plus, minus = p[bit > 0], p[bit < 0]
            w.append(np.log(plus.mean(0)) - np.log(minus.mean(0)) if len(plus) and len(minus) else np.ones(FEATURES))
        self.weights = np.array(w, np.float32).T.copy() if w else np.zeros((FEATURES, 1), np.float32)
        usual = np.abs(p @ self.weights).mean(0) if len(languages) else np.ones(1)
        self.weights /= np.maximum(usual, 1e-6).astype(np.float32)

    def margins(self, f: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
        """Mean evidence of each bit for each row; a language's usual text gives about +1 or -1."""
        out = np.zeros((n, self.weights.shape[1]))
        seen = np.bincount(r, minlength=n)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(r, self.weights[:, k][f], n)
        return out / np.maximum(seen, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by logistic loss, its probability, and its lead over the second as a share of the bits."""
        bits = self.code.shape[1]
        loss = np.logaddexp(0, -2 * margins[:, None, :] * self.code[None]).sum(2)
        best = loss.argmin(1)
        e = np.exp(loss.min(1)[:, None] - loss)
        score = 1 / e.sum(1)
        if len(self.languages) < 2:
            return best, score, np.ones(len(best))
        two = np.sort(loss, 1)[:, :2]
        return best, score, (two[:, 1] - two[:, 0]) / bits


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with text and a language. No such row gives a model that knows no language."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    languages = sorted(r[0] for r in known.groupBy(F.col(lang)).count().select(lang).limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; merge rare ones first")
    return Model(languages, language_counts(known, text, lang, languages) if languages else np.zeros((0, FEATURES)))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str | Column] | None = None, kept_text: str | None = None) -> DataFrame:
    """Add lang_pred, score, margin and ambiguous to the kept columns (all, by default).

    If one of the kept columns holds the text, ``kept_text`` names it, and texts travel once.

    A null text, one without a letter, or a model without languages gives ``und``, score 0 and
    margin 0, and is ambiguous. Columns of the input with these names are replaced.
    """
    new = ["lang_pred", "score", "margin", "ambiguous"]
    small_batches(docs.sparkSession)
    if keep is None:
        keep = [c for c in docs.columns if c.lower() not in new]
        kept_text = text if text in keep else None
    names = fresh(docs, "_body", "_letter")
    base = docs.select(*keep, *([] if kept_text else [F.col(text).alias(names[0])]), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(names[1]))
    body, letter = kept_text or names[0], names[1]
    kept = [f for f in base.schema.fields if f.name not in names]
    shared = base.sparkSession.sparkContext.broadcast(model)
    schema = "{}, lang_pred string, score double, margin double, ambiguous boolean".format(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for part in slices(batch, body, PART_BYTES):
                n = part.num_rows
                f, r = features(part.column(body))
                best, score, lead = m.decode(m.margins(f, r, n)) if m.languages else (np.zeros(n, int), np.zeros(n), np.zeros(n))
                sure = part.column(letter).to_numpy(zero_copy_only=False) & bool(m.languages)
                score, lead = np.where(sure, score, 0.0), np.where(sure, lead, 0.0)
                pred = [m.languages[i] if ok else "und" for i, ok in zip(best, sure, strict=True)]
                cols = [part.column(x.name) for x in kept] + [pa.array(pred, pa.string()), pa.array(score), pa.array(lead), pa.array(lead < AMBIGUOUS)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.name for x in kept] + new)

    return base.mapInArrow(run, schema)
