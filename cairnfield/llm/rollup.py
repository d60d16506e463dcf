"""Delta-maintained token counts: signed changes by batch, additive totals, idempotent commits.

The store is a folder with two ledgers. ``entries`` has the signed rows of every batch by document:
an insert adds one, a delete takes the standing one away, a revision does both; they lie in slots by a
hash of doc_id, and a batch reads only the slots and documents that it changes. ``deltas`` has their
sums by source, language and tokenizer version. A batch writes both under its own number and then a
commit row; a batch whose commit row exists is not applied again, and what a failed attempt left
without one is overwritten. Totals are sums over committed deltas, so they never need a rescan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the ledger; a store keeps the number that it was begun with.
SLOTS = 64
ENTRY = "doc_id long, source string, lang string, version string, docs long, tokens long, chars long"
DELTA = "source string, lang string, version string, docs long, tokens long, chars long"
COMMIT = "batch long, changed long, slots int"
KEYS = ("source", "lang", "version")
SUMS = ("docs", "tokens", "chars")


def count_words(text: Column) -> Column:
    """Version ``words-1``: runs without ASCII blanks."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")


def count_marks(text: Column) -> Column:
    """Version ``marks-1``: runs of ASCII letters and digits and bytes beyond ASCII, and every other visible character alone."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Za-z0-9\\u0080-\\x{10FFFF}]+", "a"), "[ \\t\\n\\x0B\\f\\r]+", "")).cast("long")


COUNTERS = {"words-1": count_words, "marks-1": count_marks}


class Rollup:
    """Totals kept in ``folder``, a path that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, slots: int = SLOTS):
        self.spark, self.folder, self.slots = spark, folder.rstrip("/"), slots

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.slots)).cast("int")

    def _read(self, part: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{part}"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], f"{schema}, batch long" if part != "commits" else schema)
        return self.spark.read.schema(f"{schema}, batch long" if part != "commits" else schema).parquet(path)

    def committed(self) -> DataFrame:
        return self._read("commits", COMMIT).select("batch").distinct()

    def _of_committed(self, part: str, schema: str) -> DataFrame:
        # One number a batch: as many rows as batches were ever applied, joined by size.
        return self._read(part, schema).join(self.committed(), "batch", "left_semi")

    def standing(self, but: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """What each document counts for now, one row a document and tokenizer version.

        ``but`` leaves out a batch; ``only`` (doc_id, version) reads the ledger's rows of these documents alone.
        """
        entries = self._of_committed("entries", f"{ENTRY}, slot int").where(F.lit(True) if but is None else F.col("batch") != but)
        if only is not None:
            # As many numbers as there are slots at most; a small batch opens few of the ledger's folders.
            slots = [r.slot for r in only.select(self._slot().alias("slot")).distinct().collect()]
            if len(slots) < self.slots:
                entries = entries.where(F.col("slot").isin(slots))
            entries = entries.join(only, ["doc_id", "version"], "left_semi")
        # A document's signed rows sum to nothing but in the group that it stands in.
        return entries.groupBy("doc_id", *KEYS).agg(*(F.sum(x).alias(x) for x in SUMS)).where("docs <> 0")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (doc_id, op, source, lang, version, tokens, chars); False if the batch was applied before.

        ``op`` is insert, revise or delete; the last two name the document and version, and a
        delete needs no other column. An insert of a standing document counts as a revision, a
        revision or deletion of none that stands as an insert or as nothing. Of several changes to
        one document and version in a batch, a delete wins, then the greatest counts. Rows with a null
        id, op or version are left out; null source and language are groups of their own, and null
        counts are zero.
        """
        commits = self._read("commits", COMMIT)
        begun = commits.select("slots").first()
        if begun and begun.slots != self.slots:
            raise ValueError(f"this store has {begun.slots} slots")
        if not commits.where(F.col("batch") == batch).isEmpty():
            return False
        known = changes.where("doc_id is not null and op in ('insert', 'revise', 'delete') and version is not null")
        rank = F.struct((F.col("op") == "delete").alias("gone"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), "source", "lang")
        new = known.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(F.max(rank).alias("c"))
        plus = new.where("not c.gone").select("doc_id", "c.source", "c.lang", "version", F.lit(1).cast("long").alias("docs"), "c.tokens", "c.chars")
        minus = self.standing(batch, new.select("doc_id", "version")).select("doc_id", *KEYS, *(-F.col(x) for x in SUMS)).toDF("doc_id", *KEYS, *SUMS)
        path = f"{self.folder}/entries/batch={int(batch)}"
        # Slots together, large ones in several files; static, or an attempt's other slots would outlive it.
        rows = plus.unionByName(minus).withColumn("slot", self._slot()).hint("rebalance", "slot")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slot").parquet(path)
        entries = self.spark.read.schema(ENTRY).parquet(path)
        # Partial sums in every task: a hot source leaves a task as a few rows.
        delta = entries.groupBy(*KEYS).agg(*(F.sum(x).alias(x) for x in SUMS)).where("docs <> 0 or tokens <> 0 or chars <> 0")
        delta.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={int(batch)}")
        self.spark.createDataFrame([(int(batch), entries.count(), self.slots)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/of={int(batch)}")
        return True

    def totals(self) -> DataFrame:
        """Sums by source, language and tokenizer version; groups that hold no document are left out."""
        deltas = self._of_committed("deltas", DELTA)
        return deltas.groupBy(*KEYS).agg(*(F.sum(x).alias(x) for x in SUMS)).where("docs <> 0")


def counted(docs: DataFrame, version: str, op: str | Column = "insert", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Changes of one tokenizer version for rows of a document table with source and lang."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.lit(op) if isinstance(op, str) else op).alias("op"), "source", "lang", F.lit(version).alias("version"),
        COUNTERS[version](F.col(text)).alias("tokens"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"),
    )
