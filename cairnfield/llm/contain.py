"""Benchmark decontamination: size-partitioned MinHash containment search, native expressions only.

Documents fall into partitions by their number of words, each up to twice the size of the one
before. A document's sketch hashes all its shingles once, deals the hashes to equal ranges, and
keeps the least of each range. A partition's number of ranges grows with its size, so that of the
shingles that any item shares with a document some stay their ranges' least, but for a stated chance.
Items with too few shingles for that are looked up among all shingles of a document. An item meets a document on any common sketch value; all such pairs are then
verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.session import cut

SHINGLE = 5
CONTAINMENT = 0.8
#: A contained item is missed with about this chance at most.
MISS = 2.8e-6
#: Items that share fewer shingles than this when they are just contained meet all of a document's shingles.
FEW = 8
#: Rows up to this number, counted beforehand, are sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: str, value) -> Column:
    """``value`` of the first place of each run of five words; null for shorter arrays."""
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), value))


def _hashes(words: str) -> Column:
    return _runs(words, lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(SHINGLE))))


def _strings(words: str) -> Column:
    return F.array_distinct(_runs(words, lambda i: F.array_join(F.slice(F.col(words), i + 1, SHINGLE), " ")))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shared_least(n: int, threshold: float) -> int:
    """Shingles that a document shares at least with an item of ``n`` that it contains."""
    return max(1, math.ceil(threshold * n - 1e-9))


def crowding(shared: int) -> float:
    """Shingles a range may hold on average, so that none of ``shared`` ones is its range's least with a chance of MISS only."""
    low, high = 0.0, 1e9
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if (1 + math.expm1(-x) / x) ** shared <= MISS else (low, x)
    return low


def sketches(docs: DataFrame, crowd: float) -> DataFrame:
    """Sketch values of (doc_id, w) rows, one row a value; a range holds ``crowd`` shingles on average at most."""
    size = F.size("w").cast("long")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(size)) + 1)  # the partition's bound
    bits = F.least(F.greatest(F.ceil(F.log2(upper / crowd)), F.lit(1)), F.lit(62)).cast("int")
    hashed = docs.where(size >= SHINGLE).select("doc_id", (64 - bits).alias("shift"), F.sort_array(_hashes("w")).alias("h"))
    part = lambda x: F.call_function("shiftright", x, F.col("shift"))
    # In order, the least hash of a range is the first one whose range differs from the one before.
    first = F.filter("h", lambda x, j: (j == 0) | (part(x) != part(F.get(F.col("h"), j - 1))))
    return hashed.select("doc_id", F.explode(first).alias("value"))


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", threshold: float = CONTAINMENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with containment of at least ``threshold``.

    Containment is the share of an item's distinct five-word shingles that the whole document has.
    Words are lower-cased runs of letters and digits. Items and documents with fewer than five
    words, null or empty texts have no shingle and match nothing. Rows with a null id are left out;
    of rows that repeat an id, the greatest containment counts. No match gives no rows.
    """
    known = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), word_list(F.col(item_text)).alias("w"))
    known = cut(known.where(F.size("w") >= SHINGLE).select("item_id", _strings("w").alias("s"), F.array_distinct(_hashes("w")).alias("g")))
    sizes = {r[0]: r[1] for r in known.groupBy(F.size("s")).count().collect()}
    total = sum(n * k for n, k in sizes.items())
    short = [n for n in sizes if shared_least(n, threshold) < FEW]
    long = [n for n in sizes if n not in short]
    words = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), word_list(F.col(text)).alias("w"))
    few = F.size("s") <= max(short, default=0)
    keys = lambda of: known.where(of).select("item_id", F.explode("g").alias("value")).distinct()
    crowd = crowding(shared_least(min(long, default=1 << 20), threshold))
    met = sketches(words, crowd).join(_sent(keys(~few), total), "value").select("doc_id", "item_id")
    if short:
        every = words.where(F.size("w") >= SHINGLE).select("doc_id", F.explode(_hashes("w")).alias("value"))
        met = met.unionByName(every.join(_sent(keys(few), total), "value").select("doc_id", "item_id"))
    met = cut(met.distinct())
    rows = met.count()
    pairs = _sent(met, rows)
    exact = words.join(pairs, "doc_id").select("doc_id", "item_id", _strings("w").alias("d"))
    exact = exact.join(_sent(known.select("item_id", "s"), total), "item_id")
    shared = exact.select("doc_id", "item_id", F.size("s").cast("long").alias("n_item"), F.size(F.array_intersect("s", "d")).cast("long").alias("n_shared"))
    found = shared.where(F.col("n_shared") >= threshold * F.col("n_item"))
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def without_items(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows with a null id stay."""
    doc_id = names.get("doc_id", "doc_id")
    hit = cut(find_items(docs, items, **names).select(F.col("doc_id").alias(doc_id)).distinct())
    return docs.join(_sent(hit, hit.count()), doc_id, "left_anti")
