"""Quotation linking, rollups and the pipeline's stages on small tables."""

import random

import pytest

from cairnfield.llm import quotes, rollup
from cairnfield.llm.windows import remove_repeats

MAIL = "message long, text string"


def test_quote_levels_and_threads(spark):
    rows = [
        (1, "Hello there everybody\nthis is the plan"),
        (2, "> Hello there everybody\n> this is   the PLAN\n\nI agree with that plan"),
        (3, ">> Hello there everybody\n> > this is the plan\n> I agree with that plan\n\nSo do I myself"),
        (4, "> this is the plan\nonly a part of it was quoted"),
        (5, "a fresh start without quotes"),
        (6, "> nobody ever said this here\nwho knows"),
        (7, None),
        (8, ""),
        (None, "Hello there everybody"),
        (5, "a fresh start without quotes"),
        (9, "Hello there everybody\nthis is the plan"),
        (10, "> Hello there everybody\n> this is the plan\nlate answer goes to the nearest"),
    ]
    got = {r.message: r for r in quotes.conversations(spark.createDataFrame([(*r, 0) for r in rows], f"{MAIL}, depth int")).collect()}
    assert sorted(got) == list(range(1, 11))
    assert {k: r.parent for k, r in got.items()} == {1: None, 2: 1, 3: 2, 4: 1, 5: None, 6: None, 7: None, 8: None, 9: None, 10: 9}
    assert [got[k].thread for k in (1, 2, 3, 4, 9, 10)] == [1, 1, 1, 1, 9, 9]
    assert [got[k].depth for k in (1, 2, 3, 4, 10)] == [0, 1, 2, 1, 1]
    assert [got[k].position for k in (1, 2, 3, 4, 10)] == [0, 1, 2, 3, 1] and got[1].n_thread == 4
    assert got[3].text == "\nSo do I myself" and got[7].text is None and got[8].text == ""
    assert quotes.conversations(spark.createDataFrame([], MAIL)).count() == 0


def test_long_reply_chain_and_spans(spark):
    rows = [(0, "message number 0 in the chain")] + [(k, f"> message number {k - 1} in the chain\nmessage number {k} in the chain") for k in range(1, 70)]
    got = quotes.conversations(spark.createDataFrame(rows, MAIL)).collect()
    assert all(r.thread == 0 and r.depth == r.message == r.position for r in got)
    spans = quotes.positions(spark.createDataFrame([(k, k % 2, None, False, 0, "") for k in range(40)], "message long, thread long, parent long, ambiguous boolean, depth long, text string"), span=3)
    assert all(r.position == r.message // 2 and r.n_thread == 20 for r in spans.collect())


def test_own_words_that_follow_a_quote_are_not_the_quote(spark):
    got = quotes.passages(spark.createDataFrame([(1, "> a\n> b\nc\n>> d\n>\n>> e")], MAIL)).collect()
    assert [(r.level, r.passage, r.body) for r in sorted(got, key=lambda r: r.n_line)] == [(1, 1, "a"), (1, 1, "b"), (0, 2, "c"), (2, 3, "d"), (2, 3, "e")]


CHANGES = "doc_id long, op string, source string, lang string, version string, tokens long, chars long"


def totals(store):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens, r.chars) for r in store.totals().collect()}


def test_rollup_follows_changes(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "store"))
    assert totals(store) == {}
    frame = lambda *rows: spark.createDataFrame(list(rows), CHANGES)
    first = frame((1, "insert", "a", "en", "v1", 10, 50), (2, "insert", "a", "en", "v1", 5, 20), (3, "insert", None, None, "v1", 7, 7), (1, "insert", "a", "en", "v1", 10, 50), (None, "insert", "a", "en", "v1", 9, 9), (4, "insert", "b", "fr", "v2", None, None))
    assert store.apply(1, first)
    assert not store.apply(1, frame((9, "insert", "z", "en", "v1", 1, 1)))
    assert totals(store) == {("a", "en", "v1"): (2, 15, 70), (None, None, "v1"): (1, 7, 7), ("b", "fr", "v2"): (1, 0, 0)}
    assert store.apply(2, frame((1, "revise", "b", "en", "v1", 12, 50), (2, "delete", None, None, "v1", None, None), (8, "delete", None, None, "v1", None, None), (5, "revise", "a", "en", "v1", 1, 1)))
    assert totals(store) == {("b", "en", "v1"): (1, 12, 50), ("a", "en", "v1"): (1, 1, 1), (None, None, "v1"): (1, 7, 7), ("b", "fr", "v2"): (1, 0, 0)}
    assert store.apply(3, frame((6, "insert", "a", "en", "v1", 3, 3), (6, "delete", "a", "en", "v1", 3, 3)))
    assert store.apply(4, frame())
    assert totals(store)[("a", "en", "v1")] == (1, 1, 1)


def test_failed_attempt_is_not_counted(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "store"))
    spark.createDataFrame([(1, "a", "en", "v1", 1, 10, 10)], rollup.ENTRY).write.parquet(str(tmp_path / "store/entries/batch=7"))
    spark.createDataFrame([("a", "en", "v1", 1, 10, 10)], rollup.DELTA).write.parquet(str(tmp_path / "store/deltas/batch=7"))
    assert totals(store) == {}
    assert store.apply(7, spark.createDataFrame([(1, "insert", "a", "en", "v1", 4, 4)], CHANGES))
    assert totals(store) == {("a", "en", "v1"): (1, 4, 4)}


def test_a_small_batch_reads_its_own_slots(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "store"), slots=16)
    rows = [(k, "insert", "a", "en", "v1", 2, 3) for k in range(400)]
    store.apply(1, spark.createDataFrame(rows, CHANGES))
    with pytest.raises(ValueError):
        rollup.Rollup(spark, str(tmp_path / "store"), slots=8).apply(2, spark.createDataFrame(rows, CHANGES))
    only = spark.createDataFrame([(17, "v1"), (900, "v1")], "doc_id long, version string")
    standing = store.standing(only=only)
    assert [(r.doc_id, r.docs, r.tokens) for r in standing.collect()] == [(17, 1, 2)]
    slots = {f.split("/slot=")[1].split("/")[0] for f in standing.inputFiles() if "/slot=" in f}
    assert len(slots) == 16
    plan = standing._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot" in plan.split("PartitionFilters")[1]
    # A failed attempt's slots do not outlive it.
    store.apply(1, spark.createDataFrame(rows, CHANGES))
    spark.createDataFrame([(k, "b", "en", "v1", 1, 9, 9, k) for k in range(16)], rollup.ENTRY + ", slot int").write.partitionBy("slot").parquet(str(tmp_path / "store/entries/batch=2"))
    assert store.apply(2, spark.createDataFrame([(5, "revise", "a", "en", "v1", 7, 7)], CHANGES))
    assert totals(store) == {("a", "en", "v1"): (400, 399 * 2 + 7, 399 * 3 + 7)} and store.standing().count() == 400


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(8)
    stock = {"en": "the cat sat on my warm mat while dogs ran far from home".split(), "de": "der hund lief schnell durch den wald und fand einen alten knochen".split()}
    text = lambda lang, n: " ".join(rng.choice(stock[lang]) + rng.choice(stock[lang]) for _ in range(n))
    rows = [(k, text("de" if k % 3 == 0 else "en", 80), "de" if k % 3 == 0 else "en") for k in range(30)]
    item = text("en", 30)
    base = rows[1][1]
    near = " ".join(base.split()[:-1] + ["other"])
    part = " ".join(rows[2][1].split()[10:60])
    rows += [(50, base, "en"), (51, near, "en"), (52, f"{text('en', 40)} {part} {text('en', 40)}", "en"), (53, f"{text('en', 50)} {item} {text('en', 50)}", "en"), (54, "12345 ---", "en"), (55, None, None), (None, text("en", 60), "en")]
    full = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_stages(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by = {"documents": docs}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{k}")
        docs = by[name] = spark.read.parquet(f"{folder}/stage{k}")
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in by.items()}
    assert ids["documents"] - ids["language"] == {54, 55}
    assert ids["language"] - ids["near_copies"] == {50, 51}
    assert ids["repeats"] == ids["near_copies"]
    assert ids["repeats"] - ids["benchmarks"] == {53}
    cut = {r.doc_id: r for r in by["repeats"].collect()}
    want = {r.doc_id: r.kept_text for r in remove_repeats(by["near_copies"]).collect()}
    assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in cut.values())
    assert len(cut[52].text.split()) == 80
    assert {r.doc_id for r in by["packing"].collect()} == ids["benchmarks"]
    rows = P.run(spark, folder)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(str, rows.select(key).collect())) == sorted(map(str, by["packing"].select(key).collect()))


def test_pipeline_on_no_rows(spark, folder):
    import corpus_pipeline as P

    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_an_answer_goes_to_the_message_it_quotes_most(spark):
    rows = [
        (10, "the same first words here\nonly the first says this one"), (20, "the same first words here"), (21, "> the same first words here\nso the nearest"),
        (30, "> only the first says this one\nan own line between\n> the same first words here\nanswer"), (40, "one quoted line of somebody"), (41, "another quoted line of somebody"),
        (42, "> one quoted line of somebody\nand\n> another quoted line of somebody\nwhose"),
    ]
    rows += [(100 + k, "a very common line of all") for k in range(50)] + [(200, "> a very common line of all\nyes")]
    got = {r.message: (r.parent, r.ambiguous) for r in quotes.conversations(spark.createDataFrame(rows, MAIL)).collect()}
    assert got[21] == (20, False) and got[30] == (20, False) and got[42] == (41, True) and got[200] == (149, False) and got[10] == (None, False)


def test_nearest_earlier_over_spans(spark):
    rng = random.Random(6)
    asked = [(rng.randrange(400), 1, k, rng.randrange(3), rng.randrange(2)) for k in range(200)]
    said = [(rng.randrange(400), 0, 0, rng.randrange(3), rng.randrange(2)) for k in range(30)]
    schema = "message long, level int, passage int, hash long, kind int"
    got = quotes.nearest_earlier(spark.createDataFrame(asked, schema), spark.createDataFrame(said, schema), span=7)
    want = [(m, 1, p, k, max(s[0] for s in said if s[3:] == (h, k) and s[0] < m)) for m, _, p, h, k in asked if any(s[3:] == (h, k) and s[0] < m for s in said)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_rows_that_share_an_id_keep_their_own_words(spark):
    a, b = " ".join(f"a{k}" for k in range(25)), " ".join(f"b{k}" for k in range(25))
    docs = spark.createDataFrame([(1, a), (7, a), (7, b), (7, b), (None, a), (None, b)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text[0], r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(0, "a", 0), (0, "b", 0), (1, "a", 25), (7, "a", 25), (7, "b", 25), (7, "b", 25)]
    got = sorted((r.doc_id, r.text[0], r.n_removed) for r in remove_repeats(docs.where("doc_id is not null")).collect())
    assert got == [(1, "a", 0), (7, "a", 25), (7, "b", 0), (7, "b", 0)]


def test_the_pipeline_keeps_one_row_of_equal_ones(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{k}" for k in range(25)), " ".join(f"b{k}" for k in range(25))
    docs = spark.createDataFrame([(1, a, "x", [1]), (1, a, "w", [2]), (2, a, "x", None), (3, b, "x", None), (3, b, "x", None), (3, "c d e f g h", "x", None), (None, a, "x", None), (None, a, "x", None)], "doc_id long, text string, _key string, more array<int>")
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text[0], r["_key"]) for r in got.collect()) == [(0, "a", "x"), (0, "a", "x"), (1, "a", "w"), (3, "b", "x"), (3, "c", "x")]
