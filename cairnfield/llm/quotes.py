"""Quotation linking: threads from quoted passages, native expressions only.

A message's lines carry quote levels (runs of ``>``, blanks between them allowed). A passage is a
maximal run of lines of one level. Passages are normalised and hashed; a quoted passage is joined
to the message that first said it unquoted, and so is each of its lines, for quotations that were
cut short. The message quoted at the least level is the parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.session import cut

QUOTE = r"^[ \t]*(?:>[ \t]*)+"
#: A line with fewer normalised characters is no evidence on its own.
LEAST_LINE = 12
#: Parent pointers are followed by doubling; a chain of 2^40 replies is refused.
MAX_ROUNDS = 40


def quote_level(line: Column) -> Column:
    """Number of ``>`` marks that lead a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[ \t]", "")).cast("int")


def normal(text: Column) -> Column:
    """Lower case, blanks as one space, no blank ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame, text: str = "text") -> DataFrame:
    """Passages of (message, ..) rows: message, level, passage, n_line, line_hash and pass_hash, one row a line.

    Blank lines belong to no passage and do not end one. ``text`` may be null: no rows.
    """
    line = F.posexplode(F.split(F.col(text), r"\r?\n")).alias("n_line", "raw")
    lines = messages.select("message", line).select("message", "n_line", quote_level(F.col("raw")).alias("level"), normal(F.regexp_replace("raw", QUOTE, "")).alias("body"))
    lines = lines.where("body <> ''")
    # Within one message only, so a window holds one text's lines.
    order = Window.partitionBy("message").orderBy("n_line")
    step = (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int")
    numbered = lines.withColumn("step", step).withColumn("passage", F.sum("step").over(order))
    whole = F.concat_ws(" ", F.collect_list("body").over(Window.partitionBy("message", "passage").orderBy("n_line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return numbered.select("message", "level", "passage", "n_line", "body", F.xxhash64("body").alias("line_hash"), F.xxhash64(whole).alias("pass_hash"))


def link_quotes(messages: DataFrame, text: str = "text") -> DataFrame:
    """Parents: (message, parent, matched) for messages with a quotation whose origin is known.

    ``messages`` has a long ``message`` that orders them in time, without nulls or repeats. A quoted
    passage (else a quoted line) comes from the nearest earlier message with it among its own words.
    The parent is the origin of the most passages of the least quoted level that has a known one, whole
    passages before lines; of equal ones the nearest, and the row is then ``ambiguous``. Later
    messages are never parents, so links make no cycle.
    """
    rows = cut(passages(messages, text))
    whole = lambda df: df.select("message", "level", "passage", F.col("pass_hash").alias("hash"), F.lit(1).alias("kind")).distinct()
    line = lambda df: df.where(F.length("body") >= LEAST_LINE).select("message", "level", "passage", F.col("line_hash").alias("hash"), F.lit(0).alias("kind")).distinct()
    asked = cut(whole(rows.where("level > 0")).unionByName(line(rows.where("level > 0"))))
    own = rows.where("level = 0")
    said = whole(own).unionByName(line(own)).join(asked.select("hash", "kind").distinct(), ["hash", "kind"], "left_semi")
    hits = nearest_earlier(asked, said)
    # Messages quote few passages: sums by message and origin first, then one row a message.
    by = hits.groupBy("message", "level", "kind", "origin").agg(F.count("*").alias("n"))
    best = by.groupBy("message", "level", "kind").agg(F.max(F.struct("n", "origin")).alias("b"), F.min(F.struct((-F.col("n")).alias("n"), "origin")).alias("other"), F.sum("n").alias("sum"))
    one = best.groupBy("message").agg(F.min(F.struct("level", (1 - F.col("kind")).alias("partial"), "b", "other")).alias("c"), F.sum("sum").alias("matched"))
    # The nearest and the farthest of the origins with the most passages differ where there are several.
    return one.select("message", F.col("c.b.origin").alias("parent"), "matched", (F.col("c.b.origin") != F.col("c.other.origin")).alias("ambiguous"))


def nearest_earlier(asked: DataFrame, said: DataFrame, span: int = 4096) -> DataFrame:
    """``asked`` rows with ``origin``, the greatest smaller message of ``said`` with their hash and kind; others are left out.

    A passage may be said and quoted by a large part of all messages: windows hold one hash within a
    span of messages, and between spans goes one row each.
    """
    part = F.floor(F.col("message") / span).alias("part")
    both = asked.select("hash", "kind", "message", "level", "passage", part, F.lit(None).cast("long").alias("of")).unionByName(said.select("hash", "kind", "message", "level", "passage", part, F.col("message").alias("of")))
    inside = Window.partitionBy("hash", "kind", "part").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("hash", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy("hash", "kind", "part").agg(F.max("of").alias("last")).withColumn("before", F.max("last").over(ahead)).select("hash", "kind", "part", "before")
    found = both.withColumn("here", F.max("of").over(inside)).where("of is null").join(spans, ["hash", "kind", "part"])
    return found.withColumn("origin", F.coalesce("here", "before")).where("origin is not null").select("message", "level", "passage", "kind", "origin")


def without_quotes(text: Column) -> Column:
    """The lines of level 0, joined again; null stays null."""
    return F.array_join(F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(QUOTE)), "\n")


def conversations(messages: DataFrame, text: str = "text", id_col: str = "message") -> DataFrame:
    """Chat rows in reply order: message, thread, parent, ambiguous, depth, position, n_thread and text without quotes.

    A message without a known parent opens its thread, whose id is its own. ``depth`` counts replies
    from there, ``position`` numbers a thread's messages in time order from 0. Rows with a null id
    are left out; of rows that repeat an id the least text counts (null before any). Null and empty
    texts are messages without quotes. An empty table gives no rows.
    """
    known = messages.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("message")).agg(F.min(F.col(text)).alias("text"))
    known = cut(known)
    links = cut(link_quotes(known))
    # Pointer doubling over replies only: each round doubles the steps that a pointer covers, and
    # those that have reached a message without a parent drop out.
    at = links.select("message", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open"))
    for _ in range(MAX_ROUNDS):
        over = at.select(F.col("message").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = at.where("open").join(over, "up", "left")
        moved = moved.select("message", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("open"))
        at = cut(at.where("not open").unionByName(moved))
        if at.where("open").isEmpty():
            break
    else:
        raise ValueError("a chain of replies is too long")
    roots = at.select("message", F.col("up").alias("root"), "depth")
    out = known.join(links.select("message", "parent", "ambiguous"), "message", "left").join(roots, "message", "left")
    out = out.select("message", F.coalesce("root", "message").alias("thread"), "parent", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), without_quotes(F.col("text")).alias("text"))
    return positions(out)


def positions(rows: DataFrame, span: int = 4096) -> DataFrame:
    """Number each thread's messages in order. Long threads are numbered span by span of ids, so no task holds one whole."""
    part = F.floor(F.col("message") / span)
    own = rows.withColumn("part", part)
    sizes = own.groupBy("thread", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("thread").orderBy("part")
    before = sizes.select("thread", "part", (F.sum("n").over(ahead) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("thread")).alias("n_thread"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("thread", "part").orderBy("message")) - 1)
    return ranked.join(before, ["thread", "part"]).select("message", "thread", "parent", "ambiguous", "depth", (F.col("before") + F.col("rank")).alias("position"), "n_thread", "text")
