"""Removal of repeated fixed-length word windows, found by Rabin-Karp hashes.

Every window of every text is hashed. A task first settles the windows that repeat among its own
rows, so that each hash leaves a task once, however hot it is. The first places of all hashes then
meet by hash range, packed column by column: about nine bytes a window cross the network. What
comes back is the places to remove, merged into maximal intervals per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import Texts, fresh, grams, slices, small_batches, with_text_key

WORDS = 20
#: Windows that a task gathers before it sends their first places on.
FLUSH_WINDOWS = 1 << 20
#: Bytes of text whose windows make one hash range, and whose removals make one group of documents.
RANGE_BYTES = 8 << 20
#: Bytes kept of each hash beside its range.
HASH_BYTES = 7
PACKED = "part int, kind int, hashes binary, ids binary, counts binary, starts binary"
MARKS = "part int, ids binary, starts binary, lengths binary"


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _open(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(a)))


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _marks(ids: np.ndarray, starts: np.ndarray, parts: int) -> Iterator[tuple]:
    """Windows to remove, ordered by document and start, as runs of successive starts by group of documents."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(ids)))
    ids, starts = ids[at], starts[at]
    part = _part_of(ids, parts)
    order = np.argsort(part, kind="stable")
    lo, n = _runs(part[order])
    for a, k in zip(lo, n, strict=True):
        s = order[a : a + k]
        yield int(part[s[0]]), _squeeze(ids[s]), _squeeze(starts[s].astype(np.int32)), _squeeze(length[s].astype(np.int32))


def _frame(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.split()[1] == "int" else pa.binary() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def _hash_windows(width: int, ranges: int, groups: int):
    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, ids, starts = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((starts, ids))  # batches come in any order of ids
        h, ids, starts = h[order], ids[order], starts[order]
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        s = h[order]
        again[order[1:]] = s[1:] == s[:-1]
        # The same document at the same start (a repeated row) is no earlier window.
        lo, n = _runs(s)
        lead = np.repeat(order[lo], n)
        same = (ids[order] == ids[lead]) & (starts[order] == starts[lead])
        again[order[same]] = False
        rows = [(p, 1, None, i, ln, st) for p, i, st, ln in _marks(ids[again], starts[again], groups)] if again.any() else []
        firsts = np.zeros(len(h), bool)
        firsts[order[lo]] = True
        h, ids, starts = h[firsts], ids[firsts], starts[firsts]
        part = (((h >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        lo, n = _runs(part[order])
        for a, k in zip(lo, n, strict=True):
            sel = order[a : a + k]
            first, count = _runs(ids[sel])
            rows.append((int(part[sel[0]]), 0, h[sel].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes(), _squeeze(ids[sel][first]), _squeeze(count.astype(np.int32)), _squeeze(np.diff(starts[sel].astype(np.int32), prepend=np.int32(0)))))
        return _frame(PACKED, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "body"):
                t = Texts(part.column("body"))
                h = grams(t.word_hashes(), width)
                doc = t.docs_of_words()
                ok = np.flatnonzero(doc[: len(h)] == doc[width - 1 :]) if len(h) else np.zeros(0, np.int64)
                if len(ok):
                    ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                    held.append((h[ok], ids[doc[ok]], (ok - t.first[doc[ok]]).astype(np.int32)))
                    size += len(ok)
                if size >= FLUSH_WINDOWS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _settle(groups: int):
    """Of one hash range: all first places but the earliest of each hash are to be removed."""

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hs, ids, starts, out = [], [], [], []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.kind == 1:
                    out.append((row.part, row.ids, row.starts, row.counts))
                    continue
                raw = np.frombuffer(row.hashes, np.uint8).reshape(-1, HASH_BYTES)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :HASH_BYTES] = raw
                hs.append(wide.view(np.uint64).ravel())
                ids.append(np.repeat(_open(row.ids, np.int64), _open(row.counts, np.int32)))
                starts.append(np.cumsum(_open(row.starts, np.int32)).astype(np.int32))
        if hs:
            h, doc, at = np.concatenate(hs), np.concatenate(ids), np.concatenate(starts)
            order = np.argsort(h, kind="stable")
            s = h[order]
            many = np.zeros(len(s), bool)
            many[1:] = s[1:] == s[:-1]
            many[:-1] |= many[1:]
            sel = order[many]
            order = np.lexsort((at[sel], doc[sel], h[sel]))
            sel = sel[order]
            lo, n = _runs(h[sel])
            lead = np.repeat(sel[lo], n)
            # A repeated row has its windows at the same place of the same document.
            later = sel[(doc[sel] != doc[lead]) | (at[sel] != at[lead])]
            later = later[np.lexsort((at[later], doc[later]))]
            if len(later):
                out += list(_marks(doc[later], at[later], groups))
        if out:
            yield pd.DataFrame(out, columns=["part", "ids", "starts", "lengths"])

    return run


def _merge(width: int):
    """Removals of a group of documents as maximal word intervals, one row a document."""

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, starts, lengths = [], [], []
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids.append(_open(row.ids, np.int64))
                starts.append(_open(row.starts, np.int32))
                lengths.append(_open(row.lengths, np.int32))
        ids, starts, lengths = np.concatenate(ids), np.concatenate(starts).astype(np.int64), np.concatenate(lengths)
        order = np.lexsort((starts, ids))
        ids, starts, ends = ids[order], starts[order], (starts + lengths)[order] + width - 1
        lo, n = _runs(ids)
        rows = []
        for a, k in zip(lo, n, strict=True):
            s, e = starts[a : a + k], np.maximum.accumulate(ends[a : a + k])
            new = np.ones(k, bool)
            new[1:] = s[1:] > e[:-1]
            first = np.flatnonzero(new)
            rows.append((ids[a], s[first], e[np.append(first[1:] - 1, k - 1)]))
        yield pd.DataFrame(rows, columns=["id", "lo", "hi"])

    return run


def repeated_intervals(docs: DataFrame, text: str, key: str, width: int = WORDS) -> DataFrame:
    """Maximal word intervals [lo, hi) to remove, as (id, lo array, hi array) by the long ``key``; texts without any are left out.

    A window goes if its words also start earlier: under a smaller key, or earlier in the same text.
    Rows with the same key are one text: a window at the same place of it is not earlier.
    """
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = int(min(max(1, total // RANGE_BYTES), 1 << 20))
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
    packed = slim.mapInArrow(_hash_windows(width, parts, parts), PACKED)
    return packed.groupBy("part").applyInPandas(_settle(parts), MARKS).groupBy("part").applyInPandas(_merge(width), "id long, lo array<long>, hi array<long>")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WORDS, spaced: bool = False) -> DataFrame:
    """Every row of ``docs`` plus n_words, n_removed, kept_sha256 and kept_text.

    Words are runs without ASCII blanks. ``kept_text`` joins the kept words by one space; with
    ``spaced`` it is instead the text with the removed words cut out, null for a null text, so a
    text that loses nothing stays as it is. ``kept_sha256`` always hashes the words joined by one
    space. Null and empty texts have no words. Columns of the input with the new names are replaced.
    Earlier is what stands in a smaller doc_id (a null one is smallest) or earlier in the same
    document. Rows that share a doc_id but not the text are documents of their own, in the order of
    their texts' hashes; rows that share both are one, and lose the same words.
    """
    new = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in new])
    key, lo, hi, body = fresh(base, "_key", "_lo", "_hi", "_body")
    keyed = with_text_key(base, key, text, doc_id)
    spans = repeated_intervals(keyed, text, key, width).select(F.col("id").alias(key), F.col("lo").alias(lo), F.col("hi").alias(hi))
    joined = keyed.withColumn(body, F.col(text)).join(spans, key, "left")
    kept = [f for f in base.schema.fields if f.name != text or not spaced]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_words long, n_removed long, kept_sha256 string, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, body):
                t = Texts(part.column(body))
                los, his = part.column(lo).to_pylist(), part.column(hi).to_pylist()
                raw, null = t.buf.tobytes(), part.column(body).is_null().to_pylist()
                removed, shas, texts = [], [], []
                for k in range(part.num_rows):
                    a, z = t.first[k], t.first[k + 1]
                    keep = np.ones(z - a, bool)
                    for x, y in zip(los[k] or (), his[k] or ()):
                        keep[x:y] = False
                    ends, starts = t.ends[a:z], t.starts[a:z]
                    # Runs of kept words keep their bytes; only the blanks between words are made plain.
                    edge = np.flatnonzero(np.diff(keep.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                    pieces = [raw[starts[i] : ends[j - 1]] for i, j in zip(edge[::2], edge[1::2], strict=True)]
                    joined_words = b" ".join(b" ".join(p.split()) for p in pieces)
                    removed.append(int(len(keep) - keep.sum()))
                    shas.append(hashlib.sha256(joined_words).hexdigest())
                    if not spaced:
                        texts.append(joined_words)
                    elif null[k]:
                        texts.append(None)
                    else:
                        texts.append(b" ".join(pieces) if removed[-1] else raw[t.at[k] : t.at[k + 1] - 1])
                cols = [part.column(f.name) for f in kept] + [pa.array(t.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + new)

    return joined.select(*[f.name for f in kept], body, lo, hi).mapInArrow(run, schema)
