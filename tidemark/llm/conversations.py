"""Quotation linking: conversations in reply order, without their quotes.

A line that begins with ``>`` marks, blanks between them allowed, is a quote; the number of marks is its
level. Quoted lines are normalised (A-Z lower-cased, runs other than letters and digits become one space) and
hashed, as are the lines that each message wrote itself. A quoted line of the least level of its
passages refers to the latest earlier message of the conversation that wrote it; the message that
most of them refer to (the later one of equals) is the parent. A message that finds none this way is
looked up by passages: lines of one level that follow each other are joined, so line breaks don't count,
and the hashes of all windows of ``WINDOW`` words (each Han or kana character is one), of whole passages
of fewer words and of their short lines are sought in the joined text that earlier messages wrote; a
short one has to be a whole line or passage there. The least level that finds anything decides, so where
the quoted message is missing, one that it quoted becomes the parent. Parents lead to roots and depths by
pointer doubling, and messages are put in reply order: by root, then by turn, so each follows what it
answers. Attribution lines ("On ... wrote:") right above a quote go with it.

Only DataFrame functions; lookups are running maxima over bucketed (conversation, line) keys, so
neither a hot conversation nor a line that thousands of messages share meets in one task, and no
pairs of quoting and quoted messages are made.

Defined results: a null or empty text writes and quotes nothing and stays, as its clean text, empty;
messages without quotes, or whose quotes nobody wrote earlier, start a thread; repeated rows are
messages of their own with equal links; a null conv_id or turn: no links, and the place is null; an
empty table gives no rows. Other columns than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scale, store

_MARKS = r"^[ \t]*>[> \t]*"
_WROTE = r"(?i)^[ \t]*on .* wrote:[ \t]*$"
MIN_LINE = 3  # normalised characters; shorter lines refer to nothing
TURNS = 512  # turns per bucket
WINDOW = 5  # words
_QUOTES = r"(?dm)^[ \t]*>"  # in a whole text
_NO_BLANKS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])"  # scripts whose lines break between any two characters


def _normal(c: Column) -> Column:
    lower = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " "))


def _written(lines: Column) -> Column:
    """Lines that are neither quotes nor attributions of the next line."""
    quoted = lambda c: c.rlike(_MARKS)
    return F.filter(lines, lambda c, i: ~quoted(c) & ~(c.rlike(_WROTE) & F.coalesce(quoted(F.get(lines, i + 1)), F.lit(False))))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean text, quoted and own line hashes, and levels of each message."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    base = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", lines.alias("lines"))
    quoted = F.transform(
        F.filter("lines", lambda c: c.rlike(_MARKS)),
        lambda c: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(c, _MARKS, 0), "[^>]", "")).alias("level"),
            _normal(F.regexp_replace(c, _MARKS, "")).alias("line")))
    keep = lambda c: F.length(c) >= MIN_LINE
    out = base.select("conv_id", "turn", "role", _written(F.col("lines")).alias("written"), F.filter(quoted, lambda q: keep(q.line)).alias("quoted"))
    least = F.array_min(F.transform("quoted", lambda q: q.level))
    return out.select(
        "conv_id", "turn", "role",
        F.trim(F.array_join("written", "\n"), F.lit("\n ")).alias("clean_text"),
        F.transform(F.filter("quoted", lambda q: q.level == least), lambda q: F.xxhash64(q.line)).alias("asked"),
        F.array_distinct(F.transform(F.filter(F.transform("written", _normal), keep), lambda c: F.xxhash64(c))).alias("own"),
        F.size("quoted").alias("n_quoted_lines"),
        F.coalesce(F.array_max(F.transform("quoted", lambda q: q.level)), F.lit(0)).alias("max_level"),
    )


def _parents(asked: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) from asked lines (conv_id, turn, level, line) and written ones: the least level decides."""
    wanted = asked.select("conv_id", "line").distinct()
    wrote = own.join(wanted, ["conv_id", "line"], "left_semi").withColumn("level", F.lit(0))
    # an asking row stands before the writing rows of its turn, so only earlier turns count
    both = asked.withColumn("kind", F.lit(0)).unionByName(wrote.withColumn("kind", F.lit(1))).withColumn("block", F.floor(F.col("turn") / TURNS))
    seen = scale.before(both, ["conv_id", "line"], ["block"], [F.col("turn"), F.col("kind")], F.when(F.col("kind") == 1, F.col("turn")), "source", "max")
    votes = seen.filter("kind = 0 and source is not null").groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), "n", "source")).alias("reply_to"))


def parents(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of each message that quotes whole lines of an earlier one."""
    known = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    asked = known.select("conv_id", "turn", F.lit(0).alias("level"), F.explode("asked").alias("line"))
    return _parents(asked, known.select("conv_id", "turn", F.explode("own").alias("line")))


def units(messages: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, turn, level, line): distinct hashes of windows, short passages and short lines, quoted or written (level 0)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    marked = lambda c: c.rlike(_MARKS)
    level = lambda c, i: (
        F.when(marked(c), F.length(F.regexp_replace(F.regexp_extract(c, _MARKS, 0), "[^>]", "")))
        .when(c.rlike(_WROTE) & F.coalesce(marked(F.get(F.col("lines"), i + 1)), F.lit(False)), -1).otherwise(0))
    said = F.transform("lines", lambda c, i: F.struct(
        level(c, i).alias("level"),
        F.trim(F.regexp_replace(F.regexp_replace(_normal(F.regexp_replace(c, _MARKS, "")), _NO_BLANKS, " $1 "), " +", " ")).alias("line")))
    some = messages.select("conv_id", "turn", lines.alias("lines")).select("conv_id", "turn", F.explode(F.array(said)).alias("said"))
    levels = F.filter(F.array_distinct(F.transform("said", lambda x: x.level)), lambda x: x > 0 if quoted else x == 0)
    some = some.select("conv_id", "turn", "said", F.explode(levels).alias("level"))
    joined = F.array_join(F.transform("said", lambda x: F.when(x.level == F.col("level"), x.line).otherwise("\x01")), " ")
    short = F.transform(F.filter("said", lambda x: (x.level == F.col("level")) & (F.length(x.line) >= (MIN_LINE if quoted else 1))), lambda x: x.line)
    short = F.filter(short, lambda c: F.size(F.split(c, " ")) < WINDOW)
    texts = F.concat(F.split(joined, "\x01"), short)
    some = some.select("conv_id", "turn", "level", F.explode(texts).alias("text"))
    some = some.select("conv_id", "turn", "level", F.explode(F.array(F.filter(F.split("text", " +"), lambda c: c != ""))).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("words"), i, F.lit(WINDOW))))
    return some.select("conv_id", "turn", "level", F.explode(hashed).alias("line")).distinct()


def passage_parents(messages: DataFrame, linked: DataFrame) -> DataFrame | None:
    """(conv_id, turn, reply_to) by passages of the messages that quote and aren't ``linked``; None if there are none."""
    known = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text").filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    asking = store.table(known.filter(F.col("text").rlike(_QUOTES)).join(linked, ["conv_id", "turn"], "left_anti"), "asking")
    if asking.isEmpty():
        return None
    # messages of the conversations that ask, by blocks of turns: a hot conversation is dealt out
    known = known.withColumn("block", F.floor(F.col("turn") / TURNS))
    blocks = known.select("conv_id", "block").distinct().join(asking.select("conv_id").distinct(), "conv_id", "left_semi")
    own = units(known.join(blocks, ["conv_id", "block"], "left_semi"), False)
    return _parents(units(asking, True), own.drop("level"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, root, depth) of each linked message, by pointer doubling."""
    now = store.table(links.withColumn("root", F.col("reply_to")).withColumn("depth", F.lit(1)), "threads")
    for _ in range(64):
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        nxt = now.join(up, ["conv_id", "root"], "left")
        nxt = store.table(nxt.select("conv_id", "turn", "reply_to", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "threads")
        moved = nxt.filter("moved").limit(1).count()
        store.drop_table(now)
        now = nxt.drop("moved")
        if not moved:
            break
    return now


def in_reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean_text, n_quoted_lines, max_level, reply_to, root, depth and position of each message."""
    parsed = store.table(parse(messages), "messages")
    links = store.table(parents(parsed), "links")
    if (more := passage_parents(messages, links)) is not None:
        links = links.unionByName(more)
    linked = threads(links)
    out = parsed.drop("asked", "own").join(linked, ["conv_id", "turn"], "left")
    out = out.withColumn("root", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    some = out.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).withColumn("_block", F.floor(F.col("turn") / TURNS))
    placed = scale.before(some, ["conv_id"], ["root", "_block"], [F.col("turn")], F.lit(1), "position").drop("_block")
    none = out.filter(F.col("conv_id").isNull() | F.col("turn").isNull()).withColumn("position", F.lit(None).cast("int"))
    cols = ["conv_id", "turn", "role", "clean_text", "n_quoted_lines", "max_level", "reply_to", "root", "depth", "position"]
    return placed.select(*cols).unionByName(none.select(*cols)).withColumn("position", F.col("position").cast("long"))
