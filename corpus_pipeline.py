"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage works on all rows that the one before it kept. The first four return the columns of
documents; the last returns one row a packed piece. A row with a null doc_id cannot be matched and
stays in the filtering stages. An empty table gives empty results of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from cairnfield.llm.chosen_path import near_copies
from cairnfield.llm.common import fresh, table, with_text_key
from cairnfield.llm.contain import without_items
from cairnfield.llm.langid import identify, train
from cairnfield.llm.queries import tokenizer_path
from cairnfield.llm.packing import pack, pieces
from cairnfield.llm.windows import remove_repeats
from cairnfield.session import cut


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the codes decide; those without a letter and ambiguous ones go.

    Learns from all rows that name a language. If none does, nothing can be rejected but texts
    without a letter.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = [f.name for f in docs.schema.fields]
    hidden = dict(zip(named, fresh(docs, *(f"_c{k}" for k in range(len(named)))), strict=True))
    judged = identify(docs, model, keep=[F.col(c).alias(hidden[c]) for c in named], kept_text=hidden["text"])
    return judged.where("lang_pred <> 'und' and not ambiguous").select(*(F.col(hidden[c]).alias(c) for c in named))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of every group of near copies, once.

    Rows that share a doc_id but not the text are compared as documents of their own. Of rows that share
    both, the one with the least other columns stays.
    """
    key, = fresh(docs, "_key")
    keyed = with_text_key(docs.where("doc_id is not null"), key)
    copies = near_copies(keyed.select(F.col(key).alias("doc_id"), "text"))
    # Rows that are alone in their group are most; only the others are named.
    extra = cut(copies.where("doc_id <> class_id").select(F.col("doc_id").alias(key)))
    kept = keyed.join(extra, key, "left_anti")
    again = cut(kept.groupBy(key).count().where("count > 1").select(key))
    order = [F.col(f"`{c}`") for c in docs.columns if isinstance(docs.schema[c].dataType, AtomicType)]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    once = kept.join(again, key, "left_semi").withColumn(f"{key}_n", first).where(F.col(f"{key}_n") == 1)
    rows = kept.join(again, key, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
    return rows.unionByName(docs.where("doc_id is null"))


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that started earlier; n_chars follows the text. A text that nothing is left of stays, empty."""
    done = remove_repeats(docs, spaced=True).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def benchmarks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_items(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces with their place in a sequence."""
    return pack(pieces(docs, tokenizer_path()))


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_each_group),
    ("repeats", repeats_cut),
    ("benchmarks", benchmarks_out),
    ("packing", packed),
]

#: Language models, similarity groups and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
