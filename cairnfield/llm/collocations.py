"""Phrase collocations by direct-address tiling of frequency-ranked ids.

Words that are frequent enough get ids by falling frequency. Two neighbours are a cell of a square
whose sides are the ids; the square is cut into tiles of ``TILE`` x ``TILE`` cells. A task counts a
well filled tile by one dense ``bincount`` and all thinly filled ones together as sorted coordinates
(COO); the counts of all tasks are summed in Spark. Frequent pairs are ranked and numbered in turn,
and texts become runs of pair numbers, so that the same tiles count triples as pairs of pairs that
overlap, and phrases of four words as pairs of triples. A phrase can only be frequent if the two that
it is made of are, so nothing frequent is lost.

A dictionary goes to tasks in slices of ``SLICE`` entries; where there are more, texts are numbered
in as many passes, each of which fills in its own entries. Nothing is capped.

A null or unknown language is ``und``. Null and empty texts hold no word. A text over ``LONG`` bytes
is worked on in parts cut at piece ends; one without a piece end is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm.common import bounded_batches, laid_out, slices
from cairnfield.operators.ordered import number_rows, top_by
from cairnfield.session import cut

TILE = 1024
#: Pairs from which a tile is counted densely, and pairs that a task gathers before it counts.
DENSE = TILE * TILE // 64
FLUSH_PAIRS = 1 << 22
FLUSH_WORDS = 1 << 20
SLICE = 1_000_000
LONG = 1 << 22
ROW_IDS = 1 << 14

_END = np.zeros(256, bool)
_END[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
_GAP = _END.copy()
_GAP[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(texts: pa.Array, limit: int) -> pa.Array:
    """The texts, those over ``limit`` bytes cut at piece ends."""
    size = pc.fill_null(pc.binary_length(texts), 0)
    if not len(texts) or pc.max(size).as_py() <= limit:
        return texts
    out: list[bytes] = []
    for text in texts.cast(pa.binary()).to_pylist():
        raw = text or b""
        if len(raw) > limit:
            ends = np.flatnonzero(_END[np.frombuffer(raw, np.uint8)]) + 1
            at = np.unique(ends[np.searchsorted(ends, np.arange(limit, len(raw), limit), "right") - 1]) if len(ends) else ends
            at = [0, *(int(x) for x in at if x < len(raw)), len(raw)]
            out += [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
        else:
            out.append(raw)
    return pa.array(out, pa.large_binary()).cast(pa.large_string())


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and after which of them a piece ends."""
    raw, _ = laid_out(texts)
    raw = _LOWER[raw]
    gap = _GAP[raw]
    step = np.diff(gap.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[~gap]))])
    stops = np.concatenate(([0], np.cumsum(_END[raw]))) if len(raw) else np.zeros(1, np.int64)
    last = np.append(stops[starts[1:]] > stops[ends[:-1]], True) if len(starts) else np.zeros(0, bool)
    return words, last


def by_language(batch: pa.RecordBatch, limit: int = LONG) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language at a time, about ``limit`` bytes of them."""
    for part in slices(batch, "text", limit):
        langs = part.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, part.column("text").filter(pa.array(codes == k)) if len(langs.dictionary) > 1 else part.column("text")


def pair_counts(a: np.ndarray, b: np.ndarray, tile: int = TILE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as keys a * 2^32 + b, and how often each occurs."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side = int(max(a.max(), b.max())) // tile + 1
    at = (a // tile).astype(np.int64) * side + b // tile
    if side <= 256:
        at = at.astype(np.uint16)  # sorted by radix
    order = np.argsort(at, kind="stable")
    a, b, at = a[order], b[order], at[order]
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    end = np.append(begin[1:], len(at))
    keys, counts, thin = [], [], np.ones(len(at), bool)
    for s, e in zip(begin[end - begin >= dense], end[end - begin >= dense], strict=True):
        top, left = int(a[s]) // tile * tile, int(b[s]) // tile * tile
        cells = np.bincount((a[s:e] - top).astype(np.int64) * tile + (b[s:e] - left), minlength=tile * tile)
        full = np.flatnonzero(cells)
        keys.append((full // tile + top) << 32 | (full % tile + left))
        counts.append(cells[full])
        thin[s:e] = False
    coo = np.sort(a[thin].astype(np.int64) << 32 | b[thin])
    if len(coo):
        first = np.flatnonzero(np.concatenate(([True], coo[1:] != coo[:-1])))
        keys.append(coo[first])
        counts.append(np.diff(np.append(first, len(coo))))
    return np.concatenate(keys).astype(np.int64), np.concatenate(counts).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """Words by language with their counts, and one row a language with a null word and the count of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        rows: dict[str, int] = {}
        total: dict[str, int] = {}

        def merged(lang: str) -> pa.Table:
            t = pa.concat_tables(held[lang]).group_by("word").aggregate([("f", "sum")])
            return pa.table({"word": t.column("word"), "f": t.column("f_sum")})

        def out(lang: str, t: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in t.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)).cast(pa.string()), part.column(0).cast(pa.string()), part.column(1)], names=["lang", "word", "f"])

        for batch in batches:
            for lang, texts in by_language(batch):
                for at in range(0, len(parts := _parts(texts, LONG)), 1000):
                    words, _ = words_of(parts.slice(at, 1000))
                    if not len(words):
                        continue
                    coded = words.dictionary_encode()
                    n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    held.setdefault(lang, []).append(pa.table({"word": coded.dictionary, "f": n}))
                    rows[lang] = rows.get(lang, 0) + len(n)
                    total[lang] = total.get(lang, 0) + len(words)
                if rows.get(lang, 0) > FLUSH_WORDS:
                    t = merged(lang)
                    if len(t) > FLUSH_WORDS // 2:
                        yield from out(lang, t)
                        held[lang], rows[lang] = [], 0
                    else:
                        held[lang], rows[lang] = [t], len(t)
        for lang in held:
            if held[lang]:
                yield from out(lang, merged(lang))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "f"])

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _packed(seqs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs of ids as rows of about ``ROW_IDS`` ids, cut only at marks (-1), which no phrase crosses."""
    ids = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
    if not len(ids):
        return
    known = ids >= 0
    ids = ids[known | np.concatenate(([False], known[:-1]))].astype(np.int32)  # one mark stands for any number
    marks = np.flatnonzero(ids < 0)
    at = np.unique(marks[np.minimum(np.searchsorted(marks, np.arange(ROW_IDS, len(ids), ROW_IDS)), len(marks) - 1)]) if len(marks) else marks
    rows = [part.tobytes() for part in np.split(ids, at) if len(part) > 1]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])


def number_words(docs: DataFrame, words: DataFrame, n_words: int, slice_size: int) -> DataFrame:
    """Texts as packed runs of word ids, -1 for words without one and between pieces."""
    spark = docs.sparkSession
    n_passes = max(1, -(-n_words // slice_size))
    rows = docs.withColumn("ids", F.lit(None).cast("binary")) if n_passes > 1 else docs
    for p in range(n_passes):
        known: dict[str, tuple[list, list]] = {}
        part = words.where((F.col("id") >= p * slice_size) & (F.col("id") < (p + 1) * slice_size)).select("lang", "word", "id").toArrow()
        for lang in part.column("lang").unique().to_pylist():
            own = part.filter(pc.equal(part.column("lang"), lang))
            known[lang] = (own.column("word").combine_chunks().cast(pa.large_string()), own.column("id").to_numpy().astype(np.int32))
        sent, last = spark.sparkContext.broadcast(known), p == n_passes - 1

        def codes(lang: str, words: pa.Array, sent=sent) -> np.ndarray:
            if lang not in sent.value or not len(words):
                return np.full(len(words), -1, np.int32)
            value_set, ids = sent.value[lang]
            coded = words.dictionary_encode()
            at = pc.index_in(coded.dictionary, value_set=value_set)
            own = np.append(ids, np.int32(-1))[pc.fill_null(at, len(ids)).to_numpy()]
            return own[coded.indices.to_numpy()]

        def whole(batches: Iterator[pa.RecordBatch], codes=codes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, texts in by_language(batch):
                    for at in range(0, len(parts := _parts(texts, LONG)), 1000):
                        words, ends = words_of(parts.slice(at, 1000))
                        yield from _packed([_with_ends(codes(lang, words), ends)])

        def some(batches: Iterator[pa.RecordBatch], codes=codes, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", LONG):
                    langs, texts, held = part.column("lang").to_pylist(), part.column("text"), part.column("ids").to_pylist()
                    filled, packed = [], []
                    for k, lang in enumerate(langs):
                        words, ends = words_of(texts.slice(k, 1))
                        ids = codes(lang, words)
                        if held[k] is not None:
                            ids = np.maximum(ids, np.frombuffer(held[k], np.int32))
                        if last:
                            packed.append(_with_ends(ids, ends))
                        else:
                            filled.append(ids.tobytes())
                    if last:
                        yield from _packed(packed)
                    else:
                        yield pa.RecordBatch.from_arrays([part.column("lang"), texts, pa.array(filled, pa.binary())], names=["lang", "text", "ids"])

        rows = cut(rows.mapInArrow(whole if n_passes == 1 else some, "ids binary" if last else "lang string, text string, ids binary"))
    return rows


def _with_ends(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ids with a -1 after each piece."""
    out = np.full(len(ids) + int(ends.sum()), -1, np.int32)
    out[np.arange(len(ids)) + np.concatenate(([0], np.cumsum(ends)[:-1])) if len(ids) else np.zeros(0, np.int64)] = ids
    return out


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose id and the next one are known, and the keys of those pairs."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, ids[at].astype(np.int64) << 32 | ids[at + 1]


def number_pairs(seqs: DataFrame, pairs: DataFrame, n_pairs: int, slice_size: int) -> DataFrame:
    """Runs of ids as runs of the ids of their frequent neighbours."""
    spark = seqs.sparkSession
    n_passes = max(1, -(-n_pairs // slice_size))
    rows = seqs.withColumn("next", F.lit(None).cast("binary")) if n_passes > 1 else seqs
    for p in range(n_passes):
        part = pairs.where((F.col("id") >= p * slice_size) & (F.col("id") < (p + 1) * slice_size)).select("key", "id").toArrow()
        key, ids = part.column("key").to_numpy(), part.column("id").to_numpy().astype(np.int32)
        order = np.argsort(key)
        sent, last = spark.sparkContext.broadcast((key[order], ids[order])), p == n_passes - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            keys, numbers = sent.value
            for batch in batches:
                held = batch.column("next").to_pylist() if "next" in batch.schema.names else [None] * batch.num_rows
                raw, out = batch.column("ids").to_pylist(), []
                for have, before in zip(raw, held, strict=True):
                    seq = np.frombuffer(have, np.int32)
                    at, pair = neighbours(seq)
                    now = np.full(len(seq) - 1, -1, np.int32)
                    if len(keys) and len(at):
                        place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                        now[at] = np.where(keys[place] == pair, numbers[place], -1)
                    if before is not None:
                        now = np.maximum(now, np.frombuffer(before, np.int32))
                    out.append(now)
                if last:
                    for now in out:
                        yield from _packed([now])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("ids"), pa.array([x.tobytes() for x in out], pa.binary())], names=["ids", "next"])

        rows = cut(rows.mapInArrow(run, "ids binary" if last else "ids binary, next binary"))
    return rows


def count_pairs(seqs: DataFrame, flush: int = FLUSH_PAIRS, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """Neighbouring ids as keys first * 2^32 + second, with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            pair = np.concatenate(held)
            held.clear()
            keys, counts = pair_counts((pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), tile, dense)
            for at in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 18)]), pa.array(counts[at : at + (1 << 18)])], names=["key", "f"])

        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                _, pair = neighbours(np.frombuffer(raw, np.int32))
                held.append(pair)
                n += len(pair)
                if n >= flush:
                    yield from out()
                    n = 0
        if n:
            yield from out()

    return seqs.select("ids").mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def _joined(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """Phrases of a pair's two halves put together. heads and tails hold the counts of all first and last parts, the whole included."""
    x = below.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("_p"), F.col("heads").alias("_h"))
    y = below.select(F.col("id").alias("y"), "last", F.col("tails").alias("_t"))
    both = pairs.withColumn("x", F.shiftright("key", 32)).withColumn("y", F.expr("key & 4294967295L")).join(x, "x").join(y, "y")
    return both.select("id", "key", "x", "y", "f", "lang", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", F.array_append("_h", F.col("f")).alias("heads"), F.array_append("_t", F.col("f")).alias("tails"))


def _scored(level: DataFrame, n_words: int) -> DataFrame:
    """The lowest score over all cuts, ties to the shortest first part; in decimals, as products may pass 64 bits."""
    score = "cast(cast(f as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(heads[k - 1] as decimal(20,0)) + cast(tails[n - k - 1] as decimal(20,0))) as bigint)"
    cuts = F.expr(f"array_min(transform(sequence(1, {n_words - 1}), k -> struct({score.replace('n - k', f'{n_words} - k')} as score, k as k, heads[k - 1] as l, tails[{n_words} - k - 1] as r)))")
    return level.withColumn("_c", cuts).select("id", "lang", "phrase", F.col("f").alias("a"), "_c.l", "_c.r", "_c.score")


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, inside: int = 80, top: int = 2000, slice_size: int = SLICE,
    flush: int = FLUSH_PAIRS, tile: int = TILE, dense: int = DENSE,
) -> DataFrame:
    """The first ``top`` phrases of 2 to ``longest`` words of each language by score, then count, then phrase.

    A phrase occurs ``least`` times at least. Its score is floor(2,000,000 a / (l + r)) at the cut into a
    first and a rest that makes it lowest, with counts a, l and r of phrase, first and rest. A phrase
    that lies in a longer one with ``inside`` hundredths of its count is left out. Returns lang, rank
    (from 1), phrase, a, l, r, n (words of the language) and score.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    counted = cut(count_words(docs).where((F.col("f") >= least) | F.col("word").isNull()))
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    words = cut(number_rows(counted.where(F.col("word").isNotNull()).where(F.col("f") >= least), [], [F.desc("f"), F.col("lang"), F.col("word")], "id", 0))
    n_below = words.count()
    seqs = number_words(docs, words, n_below, slice_size)
    level = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    levels: list[DataFrame] = []
    for size in range(2, longest + 1):
        frequent = count_pairs(seqs, flush, tile, dense).where(F.col("f") >= least)
        pairs = cut(number_rows(frequent, [], [F.desc("f"), F.col("key")], "id", 0))
        level = cut(_joined(pairs, level))
        levels.append(level)
        if size < longest:
            seqs = number_pairs(seqs, pairs, pairs.count(), slice_size)
    found = None
    for k, level in enumerate(levels):
        kept = _scored(level, k + 2)
        if k + 1 < len(levels):
            # A phrase inside one longer by two words is inside one longer by one that is as frequent at least.
            ends = levels[k + 1].select(F.explode(F.array("x", "y")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
            kept = kept.join(ends, "id", "left").where(F.expr(f"_f is null or 100 * cast(_f as decimal(20,0)) < {int(inside)} * cast(a as decimal(20,0))"))
        kept = kept.select("lang", "phrase", "a", "l", "r", "score")
        found = kept if found is None else found.unionByName(kept)
    # A language may hold most phrases: salted parts are cut to the first of each before they meet.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    few = top_by(found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(32))), ["lang", "_salt"], order, top).drop("_salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

