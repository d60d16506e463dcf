"""Operators on words and shingles against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairnfield.llm import boosted, chosen_path, contain, langid, packing, quality_pu, toxicity, windows
from cairnfield.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    stock = [f"w{k}" for k in range(400)]
    shared = prose(rng, 60, stock)
    rows = [(k, prose(rng, rng.randint(1, 120), stock)) for k in range(60)]
    rows += [(100, shared), (101, f"start {shared}\n\tend"), (102, shared), (103, f"{shared} x {shared}"), (104, None), (105, ""), (106, "one two"), (107, "one  two"), (None, shared), (108, "z " * 300)]
    for k in range(5):  # near copies of one text
        own = shared.split()
        own[k * 7] = f"new{k}"
        rows.append((200 + k, " ".join(own)))
    return rows + [(100, shared)]  # a repeated row


def test_windows_match_brute_force(spark, corpus):
    docs = spark.createDataFrame([(*r, 1, "x") for r in corpus], f"{DOCS}, n_words int, _Key string")
    got = windows.remove_repeats(docs, width=20)
    assert got.columns == ["doc_id", "text", "_Key", "n_words", "n_removed", "kept_sha256", "kept_text"]
    seen, want = {}, {}
    for i, text in sorted({(-1 if i is None else i, t) for i, t in corpus}, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    rows = got.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == want[-1 if r.doc_id is None else r.doc_id]
    spaced = {r.doc_id: r.kept_text for r in windows.remove_repeats(docs, spaced=True).collect()}
    assert spaced[104] is None and spaced[107] == "one  two" and spaced[105] == ""


def test_windows_across_flushes(spark, corpus, monkeypatch):
    whole = {r.doc_id: r.kept_sha256 for r in windows.remove_repeats(spark.createDataFrame(corpus, DOCS)).collect()}
    monkeypatch.setattr(windows, "FLUSH_WINDOWS", 10)
    monkeypatch.setattr(windows, "RANGE_BYTES", 2000)
    parts = windows.remove_repeats(spark.createDataFrame(corpus, DOCS).repartition(5)).collect()
    assert {r.doc_id: r.kept_sha256 for r in parts} == whole


def test_windows_empty_table(spark):
    assert windows.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def brute_classes(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i] if sets[i] is not None else i, i)
    same = {i: rep[s if s is not None else i] for i, s in sets.items()}
    up, links = {i: same[i] for i in sets}, Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    reps = [i for i in sets if same[i] == i and sets[i]]
    for a in reps:
        for b in reps:
            if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (top(same[i]), same[i], links[same[i]]) for i in sets}


@pytest.mark.parametrize("small,block", [(200, 8 << 20), (2, 600)])
def test_near_copies_match_brute_force(spark, corpus, monkeypatch, small, block):
    """Also with buckets that count as large, and with clusters of several blocks."""
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(*r, 0) for r in corpus], f"{DOCS}, class_id int")
    want = brute_classes([r for r in corpus if r[0] is not None])
    got = {r.doc_id: (r.class_id, r.same_id, r.n_links) for r in chosen_path.near_copies(docs).collect()}
    assert got == want
    assert chosen_path.near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_reach_the_recall():
    assert chosen_path.runs_needed(0.9999, 0.8, 1) < chosen_path.runs_needed(0.9999, 0.8, 3) < 40


def test_containment_matches_brute_force(spark, corpus):
    rng = random.Random(9)
    text = dict((r for r in corpus if r[0] is not None))
    items = [(1, " ".join(text[100].split()[10:40]).upper()), (2, text[100].replace(" ", ", ")), (3, "one two"), (4, None), (5, ""), (None, text[100]), (6, prose(rng, 20, ["q", "r", "s"]))]
    items.append((7, " ".join(text[100].split()[:25] + ["odd"] * 4)))
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    shingle = lambda t: {tuple(split(t)[k : k + 5]) for k in range(len(split(t)) - 4)}
    want = {(d, i) for d, t in text.items() for i, q in items if i is not None and shingle(q) and 5 * len(shingle(q) & shingle(t)) >= 4 * len(shingle(q))}
    docs = spark.createDataFrame([(*r, 1, "s") for r in corpus], f"{DOCS}, item_id int, value string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contain.find_items(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 5
    left = contain.without_items(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in corpus if i not in {d for d, _ in want})
    assert contain.find_items(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert contain.find_items(spark.createDataFrame([], DOCS), bench).count() == 0


def test_containment_by_shuffle(spark, corpus, monkeypatch):
    monkeypatch.setattr(contain, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(corpus, DOCS)
    bench = docs.where("doc_id = 100").selectExpr("doc_id as item_id", "text")
    assert {r.doc_id for r in contain.find_items(docs, bench).collect()} >= {100, 101, 102, 103}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(tokenizer_path())
    odd = "A \x1f b c ́x \0\0 q <|endoftext|> É Σίσυφος ΑΣ. it's 'tis z 123 ½ DON'T <|ENDOFTEXT|>"
    texts = [(1, odd), (2, None), (3, ""), (4, "many words here " * 1500), (5, odd), (None, "x")]
    docs = spark.createDataFrame([(*r, 0) for r in texts], f"{DOCS}, offset int")
    rows = packing.pack(packing.pieces(docs, tokenizer_path(), with_ids=True)).collect()
    for i, text in texts:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = inner.encode(text or "", add_special_tokens=False).ids + [0]
        assert [x for r in own for x in r.ids] == ids
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and r.start == 2048 * r.piece
    check_sequences(rows)
    assert packing.pack(packing.pieces(spark.createDataFrame([], DOCS), tokenizer_path())).count() == 0


def check_sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_in_groups_and_tightness(spark):
    rng = random.Random(2)
    parts = spark.createDataFrame([(k, 0, rng.randint(1, 2048)) for k in range(3000)], "doc_id long, piece int, length long")
    for group in (10_000, 700):
        rows = packing.pack(parts, group=group).collect()
        assert len(rows) == 3000
        check_sequences(rows)
        least = sum(r.length for r in rows) / 2048
        assert len({r.sequence_id for r in rows}) <= least * 1.05 + 5


def test_two_for_one_fills_the_gap():
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(np.bincount(bins, [6, 3, 2, 2])) == [3, 10]


def labelled(spark, rng, n=240):
    good = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    rows = []
    for k in range(n):
        bad, rude = k % 4 == 0, k % 5 == 0
        w = [rng.choice(good) + rng.choice(good) for _ in range(rng.randint(60, 120))]
        if bad:
            w = [x + rng.choice(["###", "$$$", "&&&"]) if rng.random() < 0.5 else x for x in w]
        if rude:
            for at in rng.sample(range(len(w)), 8):
                w[at] = rng.choice(["scoundrel", "nitwit"])
        rows.append((k, " ".join(w), int(not bad), int(rude)))
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows] + [(900, None, "x"), (901, "", "x"), (None, "q", "x")], f"{DOCS}, score string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 3] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r for r in rows}


def test_classifiers_hold_out(spark):
    from pyspark.sql import functions as F

    docs, labels, truth = labelled(spark, random.Random(3))
    keep = [F.col("doc_id")]
    model = quality_pu.train(docs, labels, sample=1000)
    got = {r.doc_id: r for r in quality_pu.score(docs, model, keep).collect()}
    held = [k for k in truth if k % 3 == 0]
    assert np.mean([got[k].predicted == truth[k][2] for k in held]) > 0.95
    assert len(got) == 243 and all(0 <= r.score <= 1 for r in got.values())
    rules = boosted.train(docs, labels)
    kept = {r.doc_id: r for r in boosted.judge(docs, rules, keep).collect()}
    assert np.mean([kept[k].kept == bool(truth[k][2]) for k in held]) > 0.95
    assert kept[900].base_failed and not kept[901].kept and kept[900].n_words == 0
    rude = toxicity.train(docs, labels)
    tox = {r.doc_id: r for r in toxicity.score(docs, rude, keep).collect()}
    assert np.mean([(tox[k].score > 0.5) == bool(truth[k][3]) for k in held]) > 0.95
    assert 0 <= tox[900].score <= 1


def test_classifiers_without_labels(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_pu.score(docs, quality_pu.train(docs, none), [F.col("doc_id")]).collect()} == {0.5}
    assert boosted.judge(docs, boosted.train(docs, none), [F.col("doc_id")]).count() == 2
    assert all(r.score < 1e-6 for r in toxicity.score(docs, toxicity.train(docs, none), [F.col("doc_id")]).collect())
    empty = spark.createDataFrame([], DOCS)
    assert quality_pu.score(empty, quality_pu.train(empty, none), [F.col("doc_id")]).count() == 0


def test_base_counts_match_brute_force(spark, corpus):
    from pyspark.sql import functions as F

    extra = [(300, "a b\n\na b\n a b\nc #x $y é|ñ\r\nc #x $y é|ñ"), (301, "a b c a b c d"), (302, "\n\n \n"), (303, "x x x x")]
    docs = spark.createDataFrame(corpus + extra, DOCS)
    trees = boosted.fit(np.zeros((0, 1)), np.zeros(0), [])
    for r in boosted.judge(docs, trees, [F.col("doc_id"), F.col("text").alias("t")]).collect():
        text, w = r.t or "", words(r.t)
        lines, seen, dup = text.split("\n"), set(), 0
        for x in lines:
            dup += bool(words(x)) and x in seen
            seen.add(x)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_trees_fall_where_they_must():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 2))
    y = (x[:, 1] + 0.3 * np.sin(12 * x[:, 0]) > 0.5).astype(float)
    model = boosted.fit(x, y, [0])
    grid = np.linspace(0, 1, 50)
    for other in (0.2, 0.5, 0.8):
        s = model.score(np.column_stack([grid, np.full(50, other)]))
        assert (np.diff(s) <= 1e-12).all()
    assert np.mean((boosted.fit(x, y, []).score(x) > 0.5) == (y > 0)) > 0.95


def test_language_codes(spark):
    rng = random.Random(4)
    stock = {"aa": ["katu", "mikko", "suuri", "talo"], "bb": ["der", "schnell", "hund", "und"], "cc": ["le", "chien", "vite", "eau"], "dd": ["что", "где", "там", "дом"]}
    rows = [(k, prose(rng, rng.randint(5, 60), stock[lang]), lang) for k in range(80) for lang in stock]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, "hund und der", None)]
    docs = spark.createDataFrame(rows, f"{DOCS}, lang string").selectExpr("*", "1 as score")
    model = langid.train(docs.where("doc_id % 2 = 1"))
    assert model.languages == ["aa", "bb", "cc", "dd"] and model.code.shape == (4, 7)
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "margin", "ambiguous"]
    out = got.collect()
    assert np.mean([r.lang_pred == r.lang for r in out if r.doc_id < 80 and r.doc_id % 2 == 0]) > 0.98
    odd = {r.doc_id: r for r in out if r.doc_id >= 900}
    assert [odd[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid.train(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_codes_for_many_languages_keep_apart():
    m = langid.code_matrix(30)
    gram = m @ m.T
    np.fill_diagonal(gram, -99)
    assert m.shape[0] == 30 and (m.shape[1] - gram.max()) / 2 >= 12


def test_toxicity_keeps_words_of_one_stem_apart(spark):
    from pyspark.sql import functions as F

    rude, kind = [f"abcdx{k:03d}" for k in range(80)], [f"abcdy{k:03d}" for k in range(80)]
    rows = [(k, f"{(rude if k % 2 else kind)[k // 2 % 80]} {(rude if k % 2 else kind)[k // 2 * 7 % 80]}") for k in range(960)]
    docs = spark.createDataFrame([(k, t) for k, t in rows], DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    asked = spark.createDataFrame([(1000 + k, w) for k, w in enumerate(rude + kind)], DOCS)
    got = {r.doc_id: r.log_ratio for r in toxicity.score(asked, toxicity.train(docs, labels), [F.col("doc_id")]).collect()}
    assert all(got[1000 + k] > 0.5 for k in range(80)) and all(got[1080 + k] < -0.5 for k in range(80))


def test_toxicity_keeps_rare_words_whatever_the_corpus(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"plain words here {'zork' if k % 2 and k < 6 else ''} number {k % 7}", k % 2) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    asked = spark.createDataFrame([(1000, "zork"), (1001, "quux")], DOCS)
    got = {r.doc_id: r.log_ratio for r in toxicity.score(asked, toxicity.train(docs, labels), [F.col("doc_id")]).collect()}
    assert got[1000] > got[1001] + 1
    assert 0 < toxicity.discount(5, 3) < 1 and 0 < toxicity.discount(10**9, 1) < 1


def test_long_conversations_keep_their_messages(spark, tmp_path):
    from cairnfield.llm import queries

    far = (1 << 63) - 5
    for name, rows in (("long", [(1, t, f"first {t} of one") for t in range(1203)] + [(2, t, f"then {t} of two") for t in range(300)]), ("far", [(c, t, f"said {t} in {c}") for c in (-far, 3, far) for t in range(4)])):
        spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / name / "conversations.parquet"))
        got = queries.QUERIES["op9_quote_threads"](spark, str(tmp_path / name)).orderBy("message").collect()
        assert [r.text for r in got] == [x[2] for x in rows]
        assert [r.position for r in got] == [x[1] for x in rows] and len({r.thread for r in got}) == len({x[0] for x in rows})


def test_short_items_are_never_missed(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    items = [(k, " ".join(word() for _ in range(5 + k % 3))) for k in range(400)]
    docs = [(k, " ".join([*(word() for _ in range(300)), text, *(word() for _ in range(300))])) for k, text in items]
    got = contain.find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k, _ in items}
    for n in (10, 11, 15, 40, 1000):
        k = contain.shared_least(n, 0.8)
        x = contain.crowding(k)
        assert (1 - (1 - np.exp(-x)) / x) ** k <= 1.01 * contain.MISS
