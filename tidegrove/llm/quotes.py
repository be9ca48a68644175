"""Quotation linking: conversations in reply order, without quoted text.

Lines that begin with ">" marks are quotations, at the level of their number of marks, however many. Neighbouring quoted
lines of one level are a passage, without the marks. Passages and pieces of messages, without their own quotations,
are normalised (A-Z lowered, words ``[^\\x20\\x09-\\x0D]+`` joined by blanks) and hashed. Pieces are whole messages, their
paragraphs, and stretches of their lines: of those that begin with the first line of some passage, the ones as many lines
long as such a passage, so that a quotation of any lines is found and nothing is hashed that nobody could have quoted.

A passage is joined on its hash with the pieces, and the message that it quotes at the least level, the latest before it
in the same conversation, is its parent; where a conversation has none, the earliest such message of a conversation with
a smaller id. A message without a link follows the turn before it. Conversations that links connect are one thread.

Only ids and hashes are joined; texts travel once, to make repeated rows one, and are written once. Windows run within
stretches of ``STRETCH`` turns, and over the stretches' last turns, so that no conversation has to fit in one task.

Defined cases: lines end at a line feed, with or without a carriage return; null and empty texts have no words and are
linked to nothing; a passage of fewer than ``LEAST`` words isn't linked, as it would match by chance; rows that repeat
conversation and turn are made one, the first by role and text; a null conv_id is a conversation like any other, behind
all those with an id, and a null turn is before all others; messages that quote only are empty without their
quotations; an empty table gives an empty one. A message that quotes a later one is linked only to an earlier one, so
there are no cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut, free

LEAST, STRETCH = 4, 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"^((?:[ \t]*>)+)[ \t]?"
#: What stands for a null conv_id and a null turn in joins.
_NO_CONV, _NO_TURN = 2**63 - 1, -(2**63)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+", " "))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[ \t]", ""))


def split_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` with ``own``, the text without quotations, and ``quoted``: an array of (level, passage, head, n) for the
    runs of quoted lines; head is the first of a passage's ``n`` lines with a word."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    parsed = F.transform(lines, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line")))
    rows = messages.withColumn("parsed", parsed)
    begins = F.expr("filter(sequence(1, size(parsed)), i -> i = 1 or parsed[i - 1].level <> parsed[i - 2].level)")
    rows = rows.withColumn("begins", begins).withColumn("ends", F.expr("concat(slice(begins, 2, size(begins)), array(size(parsed) + 1))"))
    runs = F.expr("transform(arrays_zip(begins, ends), r -> slice(parsed, r.begins, r.ends - r.begins))")
    quoted = F.transform(F.filter(runs, lambda r: r[0]["level"] > 0), lambda r: F.struct(r[0]["level"].alias("level"), F.transform(r, lambda x: normal(x["line"])).alias("lines")))
    full = F.transform(quoted, lambda q: F.struct(q["level"].alias("level"), F.filter(q["lines"], lambda x: x != "").alias("lines")))
    full = F.filter(full, lambda q: F.size(q["lines"]) > 0)
    out = F.transform(full, lambda q: F.struct(q["level"].alias("level"), F.array_join(q["lines"], " ").alias("passage"), q["lines"][0].alias("head"), F.size(q["lines"]).alias("n")))
    own = F.array_join(F.transform(F.filter("parsed", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    none = F.array().cast("array<struct<level:int,passage:string,head:string,n:int>>")
    return rows.withColumn("own", own).withColumn("quoted", F.when(F.size("begins") + F.col("parsed")[0]["level"] > 1, out).otherwise(none)).drop("parsed", "begins", "ends")


def _words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.translate(text, " ", "")) + 1)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _pieces(parsed: DataFrame, quotes: DataFrame) -> DataFrame:
    """(c, t, digest) of whole messages and paragraphs, and of stretches of lines that begin and end as some passage may."""
    large = F.array_distinct(F.concat(F.array(normal(F.col("own"))), F.transform(F.split("own", "\n[ \t]*\n"), normal)))
    large = parsed.select("c", "t", F.explode(large).alias("piece")).where(_words(F.col("piece")) >= LEAST).select("c", "t", _digest(F.col("piece")).alias("digest"))
    lines = parsed.select("c", "t", F.filter(F.transform(F.split("own", "\n"), normal), lambda x: x != "").alias("lines"))
    heads = lines.select("c", "t", F.posexplode(F.transform("lines", lambda x: F.xxhash64(x))).alias("i", "head"))
    asked = quotes.select("head", "n").distinct()  # a hash that is equal by chance costs a comparison of digests, no more
    begun = heads.join(asked, "head").groupBy("c", "t").agg(F.collect_list(F.struct("i", "n")).alias("begun"))  # lines of one message
    stretches = lines.join(begun, ["c", "t"]).select("c", "t", "lines", F.explode("begun").alias("b")).where("b.i + b.n <= size(lines)")
    stretches = stretches.select("c", "t", F.array_join(F.slice("lines", F.col("b.i") + 1, F.col("b.n")), " ").alias("piece"))
    stretches = stretches.select("c", "t", _digest(F.col("piece")).alias("digest"))
    wanted = quotes.select("digest").distinct()
    return large.unionByName(stretches).join(wanted, "digest", "left_semi").distinct()


def _latest_before(quotes: DataFrame, pieces: DataFrame) -> DataFrame:
    """(c, t, level, digest, before) of the quotes: the latest earlier turn of the conversation with that piece. Both are put
    in order of turns; no pairs are made."""
    both = quotes.select("c", "t", "digest", "level", F.lit(None).cast("bigint").alias("piece"))
    both = both.unionByName(pieces.select("c", "t", "digest", F.lit(None).cast("int").alias("level"), F.col("t").alias("piece")))
    both = both.withColumn("_b", F.floor(F.col("t") / STRETCH))
    inside = Window.partitionBy("c", "digest", "_b").orderBy("t", F.col("piece").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)  # a message's own pieces stand behind its quotes
    last = both.groupBy("c", "digest", "_b").agg(F.max("piece").alias("last"))
    over = Window.partitionBy("c", "digest").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("earlier", F.max("last").over(over)).drop("last")
    found = both.withColumn("inside", F.max("piece").over(inside)).where("level is not null").join(last, ["c", "digest", "_b"])
    return found.select("c", "t", "level", "digest", F.coalesce("inside", "earlier").alias("before"))


def link(messages: DataFrame) -> DataFrame:
    """A table (c, t, role, own, how, pc, pt, n_quotes, n_linked, position): each message and the conversation and turn that it
    answers; how is quote, turn or root."""
    fields = [F.coalesce(F.col("conv_id").cast("bigint"), F.lit(_NO_CONV)).alias("c"), F.coalesce(F.col("turn").cast("bigint"), F.lit(_NO_TURN)).alias("t"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    single = messages.select(*fields).groupBy("c", "t").agg(F.min(F.struct("role", "text")).alias("m")).select("c", "t", "m.role", "m.text")
    parsed = cut(split_quotes(single).drop("text"), "quotes")
    quotes = parsed.select("c", "t", F.explode("quoted").alias("q")).where(_words(F.col("q.passage")) >= LEAST)
    asked = cut(quotes.select("c", "t", "q.level", _digest(F.col("q.passage")).alias("digest"), F.xxhash64("q.head").alias("head"), "q.n"), "quotes-asked")
    pieces = cut(_pieces(parsed, asked), "quotes-pieces")
    quotes = asked.drop("head", "n")
    earliest = pieces.groupBy("digest").agg(F.min(F.struct("c", "t")).alias("e"))
    linked = _latest_before(quotes, pieces).join(earliest, "digest", "left")
    parent = F.when(F.col("before").isNotNull(), F.struct("c", F.col("before").alias("t"))).when(F.col("e.c") < F.col("c"), F.col("e"))
    linked = linked.select("c", "t", "level", parent.alias("p"), F.col("before").isNotNull().alias("inside"))
    best = linked.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n_passages"), F.count("p").alias("n_linked"), F.max(F.when(F.col("p").isNotNull(), F.struct(-F.col("level"), "inside", "p"))).alias("b"))
    rows = _with_previous(parsed.select("c", "t", "role", "own", F.size("quoted").cast("bigint").alias("n_quotes"))).join(best, ["c", "t"], "left")
    how = F.when(F.col("b.p").isNotNull(), "quote").when(F.col("before").isNotNull(), "turn").otherwise("root")
    conv, turn = F.when(F.col("b.p").isNotNull(), F.col("b.p.c")).when(F.col("before").isNotNull(), F.col("c")), F.coalesce("b.p.t", "before")
    out = rows.select("c", "t", "role", "own", how.alias("how"), conv.alias("pc"), turn.alias("pt"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "position")
    out = cut(out, "quotes-linked")
    free(parsed, asked, pieces)
    return out


def _with_previous(rows: DataFrame) -> DataFrame:
    """``rows`` with before, the turn before in the conversation, and position, the place in it. Both are told within a
    stretch of turns, and then by the stretches before. Texts stay out of the windows."""
    keys = rows.select("c", "t", F.floor(F.col("t") / STRETCH).alias("_b"))
    within = Window.partitionBy("c", "_b").orderBy("t")
    stretches = keys.groupBy("c", "_b").agg(F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("c").orderBy("_b")
    past = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select("c", "_b", F.lag("last").over(over).alias("_last"), past.alias("_past"))
    keys = keys.withColumn("_in", F.lag("t").over(within)).withColumn("_i", F.row_number().over(within)).join(stretches, ["c", "_b"])
    keys = keys.select("c", "t", F.coalesce("_in", "_last").alias("before"), (F.col("_past") + F.col("_i") - 1).cast("bigint").alias("position"))
    return rows.join(keys, ["c", "t"])


def link_conversations(messages: DataFrame) -> DataFrame:
    """Every message, linked, with thread_conv, the least conversation of those that links connect, and position, the place
    in the own conversation. Ordered by (thread_conv, conv_id, position), nulls last, every message stands behind what it
    answers: links go to earlier turns or to smaller conversations."""
    linked = link(messages)
    roots = components(linked.where("pc <> c").select(F.col("c").alias("a"), F.col("pc").alias("b")).distinct())
    threads = roots.join(roots.groupBy("root").agg(F.min("node").alias("thread")), "root").select(F.col("node").alias("c"), "thread")
    rows = linked.join(threads, "c", "left").withColumn("thread", F.coalesce("thread", "c"))
    conv = lambda name: F.when(F.col(name) != _NO_CONV, F.col(name))
    turn = lambda name: F.when(F.col(name) != _NO_TURN, F.col(name))
    return rows.select(conv("c").alias("conv_id"), turn("t").alias("turn"), "role", "own", "how", conv("pc").alias("parent_conv"), turn("pt").alias("parent_turn"), "n_quotes", "n_linked", conv("thread").alias("thread_conv"), "position")
