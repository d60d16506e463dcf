"""One query an operator over the given tables, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import boosted, chosen_path, collocations, contain, html_text, langid, negatives, packing, quality_pu, quotes, rollup, toxicity, windows
from cairnfield.llm.common import crc_fold, table
from cairnfield.session import cut, shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; it is on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


@query("op1_language_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    fold = crc_fold("doc_id", 4)
    model = langid.train(docs.where(fold != 2))
    return langid.identify(docs, model, keep=[F.col("doc_id"), (fold == 2).alias("held_out")])


@query("op2_quality")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs, fold = table(spark, sf, "documents"), crc_fold("doc_id", 5)
    model = quality_pu.train(docs, table(spark, sf, "labels").where(fold != 0), unlabelled=fold != 0)
    return quality_pu.score(docs, model, [F.col("doc_id"), (fold == 0).alias("held_out")], cut=0.3)


WORDS_SQL = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _shingles_sql(table_name: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM (SELECT {key}, {WORDS_SQL} AS w FROM {table_name} WHERE {key} IS NOT NULL) WHERE len(w) >= 5"


@query(
    "op3_decontaminate",
    f"""WITH d AS ({_shingles_sql("documents", "doc_id")}), b AS ({_shingles_sql("benchmark", "item_id")}),
s AS (SELECT item_id, COUNT(*) AS n_item FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, COUNT(*) AS n_shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment FROM m JOIN s USING (item_id) WHERE n_shared >= 0.8 * n_item""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return contain.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_toxicity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs, fold = table(spark, sf, "documents"), crc_fold("doc_id", 3)
    model = toxicity.train(docs, table(spark, sf, "labels").where(fold != 1))
    return toxicity.score(docs, model, [F.col("doc_id"), (fold == 1).alias("held_out")], cut=0.7)


@query(
    "op5_substring_dedup",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
x AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(range(20)) AS o) WHERE k > 1),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS kept, COUNT(*) AS n FROM p ANTI JOIN x ON x.doc_id = p.doc_id AND x.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return windows.remove_repeats(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op6_near_copies",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) > 0),
f AS (SELECT doc_id, COUNT(*) AS n, string_agg(g, chr(1) ORDER BY g) AS f FROM g GROUP BY doc_id),
s AS (SELECT doc_id, n, MIN(doc_id) OVER (PARTITION BY f) AS same_id, COUNT(*) OVER (PARTITION BY f) AS n_same FROM f),
h AS (SELECT g.doc_id, g.g, s.n FROM g JOIN s ON s.doc_id = g.doc_id AND s.same_id = g.doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING COUNT(*) * 5 >= 4 * (a.n + b.n - COUNT(*))),
c AS (SELECT a AS x, a AS y FROM l UNION SELECT c.x, l.b FROM c JOIN l ON l.a = c.y),
m AS (SELECT x, MIN(y) AS class_id FROM c GROUP BY x), k AS (SELECT a, COUNT(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(m.class_id, s.same_id, d.doc_id) AS class_id, coalesce(s.same_id, d.doc_id) AS same_id, coalesce(s.n_same, 1) AS n_same, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN m ON m.x = s.same_id LEFT JOIN k ON k.a = s.same_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return chosen_path.near_copies(table(spark, sf, "documents"))


@query("op7_quality_rules")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return boosted.judge(docs, boosted.train(docs, table(spark, sf, "labels")), [F.col("doc_id")])


@query("op8_packing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf, "documents"), tokenizer_path()))


def message_ids(turns: DataFrame) -> DataFrame:
    """Turns with ``message``: conversation times a stride plus turn. The stride is 1000 or the least power of ten beyond that holds all turns, so that ids of two conversations never meet; conversations are numbered in order where their own ids would leave no room."""
    low, high, first, last = turns.agg(F.min("turn"), F.max("turn"), F.min("conv_id"), F.max("conv_id")).first()
    stride = 1000
    while low is not None and max(high, 0) - min(low, 0) >= stride:
        stride *= 10
    at = F.col("conv_id").cast("long")
    if first is not None and max(abs(first), abs(last)) >= (1 << 62) // stride:
        ranked = turns.select("conv_id").distinct().orderBy("conv_id").rdd.map(lambda r: r[0]).zipWithIndex()
        turns, at = turns.join(cut(turns.sparkSession.createDataFrame(ranked, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, _rank long")), "conv_id"), F.col("_rank")
    return turns.withColumn("message", at * stride + F.col("turn")).drop("_rank")


def mail(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as a mailbox: every turn quotes the turn before it, and that one's first line in a deeper level."""
    turns = table(spark, sf, "conversations").where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    turns = message_ids(cut(turns))
    marked = lambda text, mark: F.regexp_replace(text, "(?m)^", mark)
    own = turns.select("message", "conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("t1"))
    deeper = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.split("text", "\n")[0].alias("t2"))
    both = own.join(before, ["conv_id", "turn"], "left").join(deeper, ["conv_id", "turn"], "left")
    return both.select("message", F.concat_ws("\n", marked(F.col("t2"), "> > "), marked(F.col("t1"), "> "), "text").alias("text"))


_THREADS_SQL = r"""WITH RECURSIVE turns AS (SELECT conv_id, turn, MIN(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
mail AS (SELECT a.conv_id * 1000 + a.turn AS message, concat_ws(chr(10), '> > ' || split_part(c.text, chr(10), 1), '> ' || replace(b.text, chr(10), chr(10) || '> '), a.text) AS text
 FROM turns a LEFT JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN turns c ON c.conv_id = a.conv_id AND c.turn = a.turn - 2),
l AS (SELECT message, unnest(l) AS raw, unnest(range(len(l))) AS k FROM (SELECT message, string_split_regex(text, '\r?\n') AS l FROM mail)),
q AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^[ \t]*(?:>[ \t]*)+'), '[ \t]', '', 'g')) AS level, trim(regexp_replace(lower(regexp_replace(raw, '^[ \t]*(?:>[ \t]*)+', '')), '\s+', ' ', 'g')) AS body FROM l),
p AS (SELECT *, SUM(step) OVER (PARTITION BY message ORDER BY k) AS passage FROM (SELECT *, CASE WHEN level <> coalesce(LAG(level) OVER (PARTITION BY message ORDER BY k), -1) THEN 1 ELSE 0 END AS step FROM q WHERE body <> '')),
w AS (SELECT message, level, passage, string_agg(body, ' ' ORDER BY k) AS h, 1 AS kind FROM p GROUP BY message, level, passage UNION ALL SELECT message, level, passage, body, 0 FROM p WHERE length(body) >= 12),
said AS (SELECT DISTINCT h, kind, message FROM w WHERE level = 0),
hit AS (SELECT a.message, a.level, a.kind, a.h, a.passage, MAX(s.message) AS origin FROM (SELECT DISTINCT message, level, kind, h, passage FROM w WHERE level > 0) a JOIN said s ON s.h = a.h AND s.kind = a.kind AND s.message < a.message GROUP BY a.message, a.level, a.kind, a.h, a.passage),
byo AS (SELECT message, level, kind, origin, COUNT(*) AS n FROM hit GROUP BY message, level, kind, origin),
rk AS (SELECT *, RANK() OVER (PARTITION BY message ORDER BY level, 1 - kind, n DESC) AS r FROM byo),
link AS (SELECT message, MAX(origin) AS parent, COUNT(*) > 1 AS ambiguous FROM rk WHERE r = 1 GROUP BY message),
tree AS (SELECT m.message, m.message AS thread, CAST(0 AS BIGINT) AS depth FROM mail m ANTI JOIN link ON link.message = m.message UNION ALL SELECT link.message, tree.thread, tree.depth + 1 FROM tree JOIN link ON link.parent = tree.message)
SELECT t.message, t.thread, link.parent, coalesce(link.ambiguous, false) AS ambiguous, t.depth, ROW_NUMBER() OVER (PARTITION BY t.thread ORDER BY t.message) - 1 AS position, COUNT(*) OVER (PARTITION BY t.thread) AS n_thread,
 coalesce((SELECT string_agg(raw, chr(10) ORDER BY k) FROM q WHERE q.message = t.message AND level = 0), '') AS text FROM tree t LEFT JOIN link ON link.message = t.message"""


@query("op9_quote_threads", _THREADS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.conversations(cut(mail(spark, sf)))


#: Batches of the rollup's query: all documents arrive, the least source is deleted, and texts of the least language
#: that others have grow by a line and move to another source, in both tokenizer versions.
_TOTALS_SQL = r"""WITH gone AS (SELECT MIN(source) AS s FROM documents), moved AS (SELECT MIN(lang) AS l FROM documents, gone WHERE source IS DISTINCT FROM s),
d AS (SELECT CASE WHEN lang = l THEN 'moved' ELSE source END AS source, lang, coalesce(text, '') || CASE WHEN lang = l THEN chr(10) || 'Second edition, revised.' ELSE '' END AS text FROM documents, gone, moved WHERE source IS DISTINCT FROM s)
SELECT source, lang, version, CAST(COUNT(*) AS BIGINT) AS docs, CAST(SUM(n) AS BIGINT) AS tokens, CAST(SUM(chars) AS BIGINT) AS chars FROM (
 SELECT source, lang, version,
  CASE version WHEN 'words-1' THEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ELSE length(regexp_replace(regexp_replace(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+', 'a', 'g'), '[\x20\x09-\x0D]+', '', 'g')) END AS n, length(text) AS chars
 FROM d, (SELECT unnest(['words-1', 'marks-1']) AS version)) GROUP BY source, lang, version"""


@query("op10_token_rollup", _TOTALS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    kept = rollup.Rollup(spark, f"{shared_folder(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    both = lambda rows, op: rollup.counted(rows, "words-1", op).unionByName(rollup.counted(rows, "marks-1", op))
    kept.apply(1, both(docs, "insert"))
    source = docs.agg(F.min("source")).first()[0]
    gone = docs.where(F.col("source") == source)
    kept.apply(2, both(gone.withColumn("text", F.lit(None).cast("string")), "delete"))
    others = docs.where(~F.col("source").eqNullSafe(F.lit(source)))
    lang = others.agg(F.min("lang")).first()[0]
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nSecond edition, revised."))
    moved = others.where(F.col("lang") == lang).withColumns({"source": F.lit("moved"), "text": text})
    kept.apply(3, both(moved, "revise"))
    kept.apply(3, both(moved, "revise"))  # a repeated delivery changes nothing
    return kept.totals()


_NEGATIVES_SQL = r"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.vec_id <> b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND other QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(ROW_NUMBER() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY ROW_NUMBER() OVER w <= 10"""


@query("op13_hard_negatives", _NEGATIVES_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf, "embeddings"), label=label).drop("positive_rank")


_PHRASES_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS p FROM d)),
g AS (SELECT lang, k, w[i:i+k-1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
n AS (SELECT lang, COUNT(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, g, COUNT(*) AS f FROM g GROUP BY lang, k, g HAVING COUNT(*) >= 30),
c AS (SELECT lang, k, g, f, unnest(range(1, k)) AS j FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.g, c.f AS a, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.j] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.j+1:c.k]
 QUALIFY ROW_NUMBER() OVER (PARTITION BY c.lang, c.g ORDER BY CAST(2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT), c.j) = 1),
i AS (SELECT DISTINCT b.lang, b.g FROM (SELECT lang, f, k, m, unnest(range(1, k - m + 2)) AS i, g FROM f, (SELECT unnest(range(2, 4)) AS m) WHERE k > m) o JOIN f b ON b.lang = o.lang AND b.g = o.g[o.i:o.i+o.m-1] AND 100 * o.f >= 80 * b.f)
SELECT s.lang, CAST(ROW_NUMBER() OVER t AS BIGINT) AS rank, array_to_string(s.g, ' ') AS phrase, a, l, r, n.n, score FROM s ANTI JOIN i ON i.lang = s.lang AND i.g = s.g JOIN n ON n.lang = s.lang
WINDOW t AS (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.g, ' ')) QUALIFY ROW_NUMBER() OVER t <= 2000"""


@query("op11_collocations", _PHRASES_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(table(spark, sf, "documents"))


@query("op12_html_extraction")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))
