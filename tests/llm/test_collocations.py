"""Phrases against a plain count, and the tiles against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cairnfield.llm import collocations

SCHEMA = "doc_id long, lang string, text string, phrase string, n int"


def brute(rows, least, top=2000, longest=4, inside=80):
    counts, n = defaultdict(Counter), Counter()
    for _, lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            longer = [b for h, b in f.items() if len(h) > len(g) and b >= least and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not any(100 * b >= inside * a for b in longer):
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "aa", "é", "É", "x-y", " ", "#1", "\U0001f600"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words[: 3 + k % 8]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ", ", "?!"]) for _ in range(rng.randint(0, 60)))
        rows.append((k, rng.choice(["en", "en", "de", None, "und", ""]), rng.choice([text, text, " " + text]), "p", 1))
    return [*rows, (None, None, None, None, None), (1, "en", "", None, None), (2, "fr", "one", None, None), *rows[:5]]


def got(df, **more):
    return sorted(tuple(r) for r in collocations.mine(df, **more).collect())


def test_agrees_with_a_plain_count(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 5)
    assert len(want) > 60 and any(len(x[2].split(" ")) == 4 for x in want)
    assert got(df, least=5) == want


def test_slices_tiles_and_flushes_change_nothing(spark):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert got(df, least=4, slice_size=7, flush=50, tile=2, dense=3, top=9) == brute(rows, 4, top=9)


def test_nothing_frequent(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame(made(3)[:2], SCHEMA), least=10_000) == []


def test_long_texts_are_cut_at_piece_ends(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LONG", 64)
    rows = [(k, "en", " ".join(["one two three, two three four"] * 30), None, 1) for k in range(3)] + [(9, "en", "no end in this " * 40, None, 1)]
    got_parts = collocations._parts(pa.array([r[2] for r in rows], pa.large_string()), 64)
    assert "".join(got_parts.to_pylist()) == "".join(r[2] for r in rows) and len(got_parts) > 30
    text = "alpha beta gamma. " * 300_000  # 5.4 MB
    df = spark.createDataFrame([(1, "en", text, None, 1)], SCHEMA)
    assert [(r.phrase, r.a, r.n) for r in collocations.mine(df).collect()] == [("alpha beta gamma", 300_000, 900_000)]


def test_pair_counts():
    rng = np.random.default_rng(1)
    for tile, dense in ((4, 2), (4, 10_000), (1024, 100)):
        a, b = (rng.zipf(1.5, 5000).clip(0, 2000) - 1).astype(np.int32), (rng.zipf(1.5, 5000).clip(0, 300_000) - 1).astype(np.int32)
        keys, counts = collocations.pair_counts(a, b, tile, dense)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(((a.astype(np.int64) << 32) | b).tolist())


def test_rows_are_cut_at_marks_only(monkeypatch):
    monkeypatch.setattr(collocations, "ROW_IDS", 8)
    rng = random.Random(5)
    ids = np.array([rng.choice([-1, 1, 2, 3]) for _ in range(500)], np.int32)
    pairs = Counter(collocations.neighbours(ids)[1].tolist())
    rows = [np.frombuffer(r, np.int32) for b in collocations._packed([ids]) for r in b.column(0).to_pylist()]
    assert len(rows) > 20 and sum((Counter(collocations.neighbours(r)[1].tolist()) for r in rows), Counter()) == pairs


def test_scores_beyond_64_bits(spark):
    big = 5_000_000_000_000_000_000
    level = spark.createDataFrame([(1, "en", "a b", big, [big + 2, big], [big + 1, big])], "id long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    assert collocations._scored(level, 2).first().score == 2000000 * big // (2 * big + 3)
