"""The toxicity models against a plain computation, the class prior at known shares, and kept columns of any name."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import boosted, quality_pu, toxicity


def pairs_of(text):
    words = text.split()
    return list(zip(["^", *words], words))  # noqa: B905


def brute_ratios(rows, corpus, asked):
    """Log ratios of the words of each asked text, and of the words alone, by Kneser-Ney as written down."""
    n = [Counter(p for t, y in rows if y == k for p in pairs_of(t)) for k in (0, 1)]
    vocabulary = {w for c in n for _, w in c}
    every = Counter(w for t in corpus for w in t.split())
    total = sum(every.values())
    base = {w: (every[w] + 0.5) / (total + 0.5 * (len(vocabulary) + 1)) for w in vocabulary}
    word, pair, lead, free = [], [], [], []
    for c in n:
        follows = Counter(w for _, w in c)
        less = toxicity.discount(sum(v == 1 for v in follows.values()), sum(v == 2 for v in follows.values()))
        kinds = sum(follows.values())
        free.append(less * len(follows) / kinds)
        word.append({w: max(follows[w] - less, 0) / kinds + free[-1] * base[w] for w in vocabulary})
        less = toxicity.discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()))
        context, after = Counter(), Counter()
        for (b, _), v in c.items():
            context[b] += v
            after[b] += 1
        lead.append({b: less * after[b] / context[b] for b in context})
        pair.append((c, less, context))
    out = []
    for text in asked:
        ratios = []
        for b, w in pairs_of(text):
            alone = math.log(word[1][w] / word[0][w]) if w in vocabulary else math.log(free[1] / free[0])
            if b in lead[0] and b in lead[1]:
                if w in vocabulary:
                    p = [max(c[b, w] - less, 0) / context[b] + lead[k][b] * word[k][w] if (b, w) in c else lead[k][b] * word[k][w] for k, (c, less, context) in enumerate(pair)]
                    ratios.append((math.log(p[1] / p[0]), alone))
                else:
                    ratios.append((math.log(lead[1][b] / lead[0][b]) + alone, alone))
            else:
                ratios.append((alone, alone))
        out.append(ratios)
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [(" ".join([rng.choice(words[: 20 + 40 * (rng.random() < 0.3)]) for _ in range(rng.randint(0, 25))] + ["rude"] * (y and rng.random() < 0.8)), y) for y in (rng.random() < 0.3 for _ in range(n))]


def test_ratios_agree_with_a_plain_kneser_ney(spark):
    rows = made(1, 200)
    df = spark.createDataFrame([(t, bool(y), k % 2) for k, (t, y) in enumerate(rows)], "body string, toxic boolean, half long").repartition(3)
    corpus = [t for t, _ in rows] + [t for t, _ in made(2, 100)] + ["unseen words here w1"]
    got = toxicity.pair_counts(df).toPandas()
    before, w, c = got["before"].to_numpy(), got["w"].to_numpy(), got[["c0", "c1", "c2", "c3"]].to_numpy()
    vocabulary = np.unique(w)
    shared, total = toxicity.shared_counts(spark.createDataFrame([(t,) for t in corpus], "body string"), vocabulary)
    assert total == sum(len(t.split()) for t in corpus)
    model = toxicity.kneser_ney(before, w, np.stack([c[:, 0] + c[:, 2], c[:, 1] + c[:, 3]], 1), vocabulary, shared, total)
    asked = [t for t, _ in made(3, 40)] + ["never met", "rude", "w3 never w4", ""]
    want = [x for text in brute_ratios(rows, corpus, asked) for x in text]
    by_pair, by_word = toxicity.log_ratios(toxicity.LowerTexts(pa.array(asked)), model)
    assert np.allclose(by_pair, [x[0] for x in want], atol=1e-4) and np.allclose(by_word, [x[1] for x in want], atol=1e-4)


def test_the_fit_is_bounded_by_its_parameter(spark):
    rows = [(k, t, int(y)) for k, (t, y) in enumerate(made(4, 600))]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    whole, part = toxicity.train(docs, labels), toxicity.train(docs, labels, fit_bytes=2000)
    assert 0 < len(part.ratios.pairs) < len(whole.ratios.pairs) / 2
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, whole, [F.col("doc_id")], cut=0.5).collect()}
    rude = [k for k, t, y in rows if "rude" in t]
    assert np.mean([got[k] for k in rude]) > 0.95 and np.mean([got[k] for k, t, _ in rows if "rude" not in t]) < 0.2


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_class_prior(share):
    rng = np.random.default_rng(5)
    pos, neg = rng.normal(1.5, 1, (6000, 4)), rng.normal(-1.5, 1, (6000, 4))
    n = int(6000 * share)
    assert abs(quality_pu.class_prior(pos[:3000], np.concatenate([pos[-n:], neg[: 6000 - n]])) - share) < 0.07



def test_every_labelled_row_is_counted(spark):
    # Over 5 MB of text a class; each row has a word of its own.
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat(concat('w', id, ' some filler '), 300) as text", "cast(id % 2 as int) as toxic")
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert len(model.ratios.words) == 3002


def test_kept_columns_of_any_name(spark):
    names = ["doc_id", "score", "Predicted", "kept", "x", "_body", "body", "n_words", "log_ratio", "toxic", "quality", "k0"]
    docs = spark.createDataFrame([(k, f"some text number {k}", *["y"] * 11) for k in range(40)] + [(None, None, *[None] * 11)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[1:]))
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(40)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")).withColumn("score", F.lit(1))
    keep = [F.col(f"`{c}`") for c in names]
    for train, score, made in ((quality_pu.train, quality_pu.score, ["score", "predicted"]), (toxicity.train, toxicity.score, ["score", "predicted", "log_ratio"]), (boosted.train, boosted.judge, ["base_failed", "score", "kept"])):
        got = score(docs, train(docs, labels), keep)
        assert len({c.lower() for c in got.columns}) == len(got.columns) and got.columns[-len(made) :] == made
        rows = got.collect()
        assert len(rows) == 41 and {r["_score"] for r in rows} == {"y", None} and {r["body"] for r in rows} == {"y", None}
