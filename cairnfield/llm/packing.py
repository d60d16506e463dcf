"""Packing of tokenised documents into sequences of bounded length by best-two-fit."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.common import fresh, slices, small_batches
from cairnfield.session import cut

SEQUENCE = 2048
SEPARATOR = 0
#: Chunks of text whose ids a worker remembers; it forgets all of them when so many are held.
REMEMBERED = 800_000
#: Pieces that one task packs. Each group leaves one sequence part empty at most beyond what one packing of all would.
GROUP = 200_000


#: ASCII marks that may follow a word in its chunk; not the apostrophe, which may belong to it.
MARKS = b'.,!?;:)"#$%&(*+-/<=>@[\\]^_`{|}~'


def _plain(head: bytes) -> bool:
    """Whether a chunk is letters alone that normalising leaves as they are."""
    s = head.decode()
    return s.isalpha() and s == s.lower() and unicodedata.is_normalized("NFC", s)


class ChunkTokenizer:
    """Ids of whole texts, remembered by blank-separated chunk.

    Only for tokenizers that never join characters across ASCII blanks and drop the blanks, as the
    word-level ones do; then a text's ids are its chunks' ids in order.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        same = [self.inner.encode(x, add_special_tokens=False).ids for x in ("ABCXYZ'S", "abcxyz's")]
        self.lowers = same[0] == same[1]
        self.forget()
        self._plain_words()

    def _plain_words(self) -> None:
        """A tokenizer of the same model for words of letters alone, where the vocabulary marks word ends.

        For those, normalising and finding words in the text are the larger part of the work, and
        both leave them as they are.
        """
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.plain = None
        vocab = self.inner.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for w, k in vocab.items() if w.endswith("</w>")]] = True
        if not self.lowers or not self.ends.any():
            return
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The letters that stand for bytes: itself for an ASCII one, by pairs for the others.
        self.letters = {k: k for k in range(128)}
        for k in range(128, 2048):
            raw = chr(k).encode()
            shown = byte_level.pre_tokenize_str(chr(k))[0][0]
            self.letters.update(zip(raw, map(ord, shown), strict=True))
        for k in range(0xE0, 0xF5):  # lead bytes of longer letters
            lead = {0xE0: 0x800, 0xED: 0xD000}.get(k, (k & 15) << 12) if k < 0xF0 else max(0x10000, (k & 7) << 18)
            self.letters[k] = ord(byte_level.pre_tokenize_str(chr(lead))[0][0][0])
        plain = Tokenizer.from_str(self.inner.to_str())
        plain.normalizer, plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        probe = [b"straight", "größe".encode(), "что".encode(), "日本".encode()]
        self.plain = plain
        got, length = self._encode_plain(probe)
        want = [self.inner.encode(x.decode(), add_special_tokens=False).ids for x in probe]
        if got.tolist() != [i for w in want for i in w] or length.tolist() != [len(w) for w in want]:
            self.plain = None

    def _encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.plain.encode_batch_fast([b" ".join(words).decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.number), len(words)
        end = self.at[n]
        if end + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (end + len(ids)))
        if n + m + 1 > len(self.at):
            self.at = np.resize(self.at, 2 * (n + m + 1))
        self.ids[end : end + len(ids)] = ids
        self.at[n + 1 : n + m + 1] = end + np.cumsum(lengths)
        self.number.update(zip(words, range(n, n + m), strict=True))

    def _single(self, words: list[bytes]) -> None:
        got = [x.ids for x in self.inner.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        self._keep(words, np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64))

    def _learn(self, words: list[bytes]) -> None:
        if self.plain is None:
            self._single(words)
            return
        # Letters, then perhaps ASCII marks, which the tokenizer takes as a word of their own.
        heads = [w.rstrip(MARKS) for w in words]
        easy = [h.isalpha() and h.islower() or _plain(h) for h in heads]
        if rest := [w for w, ok in zip(words, easy, strict=True) if not ok]:
            self._single(rest)
        words, heads = [w for w, ok in zip(words, easy, strict=True) if ok], [h for h, ok in zip(heads, easy, strict=True) if ok]
        tails = [w[len(h) :] for w, h in zip(words, heads, strict=True)]
        known = {t: k for k, t in enumerate(dict.fromkeys(tails))}
        tail_ids = [self.inner.encode(t.decode(), add_special_tokens=False).ids for t in known]
        flat, size = np.array([i for x in tail_ids for i in x], np.uint32), np.array([len(x) for x in tail_ids], np.int64)
        for k in range(0, len(words), 4000):
            ids, length = self._encode_plain(heads[k : k + 4000])
            which = np.fromiter(map(known.__getitem__, tails[k : k + 4000]), np.int64, len(length))
            total = length + size[which]
            out = np.zeros(total.sum(), np.uint32)
            start = np.cumsum(total) - total
            out[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(len(ids))] = ids
            own = size[which]
            run = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(start + length, own) + run] = flat[np.repeat((np.cumsum(size) - size)[which], own) + run]
            self._keep(words[k : k + 4000], out, total)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offsets of the texts in them."""
        # Of bytes, split() knows the ASCII blanks only, and lower() the ASCII letters only: the
        # tokenizer drops case as well, but for special tokens written out in a text.
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts] if self.lowers else [t.split() for t in texts]
        words = [w for c in chunks for w in c]
        number = self.number
        new = set(words).difference(number)
        if new:
            if len(number) + len(new) > REMEMBERED:
                self.forget()
                number, new = self.number, set(words)
            self._learn(list(new))
        k = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        start = self.at[k]
        length = self.at[k + 1] - start
        to = np.zeros(len(k) + 1, np.int64)
        np.cumsum(length, out=to[1:])
        ids = self.ids[np.repeat(start - to[:-1], length) + np.arange(to[-1])]
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(c) for c in chunks], out=first[1:])
        return ids, to[first]


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with the separator id, and cut those over ``limit`` into pieces.

    One row a piece: doc_id, piece (from 0), start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers) and, if asked for, the ids. A null text counts as empty and gives the
    separator alone. Repeated rows give repeated pieces; a null doc_id stays null.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "body"):
                ids, at = tok.encode([x or b"" for x in part.column("body").cast(pa.binary()).to_pylist()])
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for k in range(part.num_rows):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(SEPARATOR)).astype("<u4")
                    for p, lo in enumerate(range(0, len(own), limit)):
                        one = own[lo : lo + limit]
                        row.append(k)
                        piece.append(p)
                        start.append(lo)
                        length.append(len(one))
                        crc.append(zlib.crc32(one.tobytes()))
                        if with_ids:
                            held.append(one.astype(np.int32))
                cols = [part.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(held, pa.list_(pa.int32()))] if with_ids else []), names=names + (["ids"] if with_ids else []))

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).mapInArrow(run, schema)


class _Stock:
    """How many pieces of each length are left; finds the largest that fits a gap."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.count = np.bincount(lengths, minlength=limit + 1).tolist()
        self.have = 0  # bit n is set while pieces of length n are left
        for n, c in enumerate(self.count):
            if c:
                self.have |= 1 << n

    def largest(self, gap: int) -> int:
        """0 if none fits."""
        return (self.have & ((1 << (gap + 1)) - 1)).bit_length() - 1 if gap > 0 and self.have & ((1 << (gap + 1)) - 1) else 0

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.have ^= 1 << n

    def give(self, n: int) -> None:
        self.count[n] += 1
        self.have |= 1 << n

    def best_two(self, gap: int, over: int) -> tuple[int, int] | None:
        """Two left lengths whose sum is largest, at most ``gap`` and above ``over``."""
        best, pair = over, None
        left = self.have & ((1 << gap) - 1)
        while left:
            a = left.bit_length() - 1
            if 2 * a <= best:  # the second is no longer than the first
                break
            left ^= 1 << a
            b = self.largest(min(a, gap - a))
            if b == a and self.count[a] < 2:
                b = self.largest(min(a - 1, gap - a))
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == gap:
                    break
        return pair


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Greedy: the longest left opens a bin, then the longest that fits, again and again.

    Where a gap stays that nothing fits, the bin's smallest piece goes back if two left pieces fill
    the gap with its room more tightly; so on until the bin is full or no exchange helps.
    """
    stock = _Stock(lengths, limit)
    plan: list[list[int]] = []
    while stock.have:
        first = stock.largest(limit)
        stock.take(first)
        own, gap = [first], limit - first
        while True:
            while n := stock.largest(gap):
                stock.take(n)
                own.append(n)
                gap -= n
            if not gap or len(own) < 2 or not stock.have:
                break
            small = min(own[1:])
            two = stock.best_two(gap + small, small)
            if two is None:
                break
            own.remove(small)
            stock.give(small)
            for n in two:
                stock.take(n)
                own.append(n)
            gap += small - sum(two)
        plan.append(own)
    # Pieces of one length are alike: hand them out in their order.
    flat = np.array([n for own in plan for n in own], np.int64)
    bins = np.repeat(np.arange(len(plan)), [len(own) for own in plan])
    total = np.cumsum(flat) - flat
    at = np.flatnonzero(np.diff(bins, prepend=-1))
    offset = total - np.repeat(total[at], np.diff(np.append(at, len(flat))))
    slot, item = np.argsort(flat, kind="stable"), np.argsort(lengths, kind="stable")
    out_bin, out_off = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    out_bin[item], out_off[item] = bins[slot], offset[slot]
    return out_bin, out_off


def pack(parts: DataFrame, limit: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``limit``.

    Pieces are dealt at random to as many groups as hold ``group`` pieces each, and each group is
    packed on its own; sequence ids count within (group number) * 2^32. No pieces give no rows.
    """
    name, size = fresh(parts, "_group", "_length")
    # Written once: the pieces are thin, but finding them reads and tokenises all texts.
    base = cut(parts.drop("sequence_id", "offset").withColumn(size, F.col("length")))
    n = base.count()
    groups = max(1, -(-n // group))
    deal = F.pmod(F.xxhash64(F.col("doc_id"), F.col("piece"), F.lit(1)), F.lit(groups)).cast("long")
    fields = base.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name != size) + ", sequence_id long, offset long"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bins, offset = best_two_fit(frame[size].to_numpy(np.int64), limit)
        out = frame.drop(columns=[name, size])
        return out.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offset)

    return base.withColumn(name, deal).groupBy(name).applyInPandas(run, schema)
