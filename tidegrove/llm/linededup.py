"""Lines that several documents hold, dropped from all but one of them, in DataFrame and SQL functions only.

A text is split at line feeds. A line's key is the line without the blanks (0x20, 0x09 to 0x0D) at both ends and with A-Z
lowered; keys of at least ``MIN_CHARS`` code points count. Lines are exploded and only hashes of their keys (128 bits), a
key of their row and their position travel: documents are counted by hash, with sums and minima that Spark combines before
it shuffles, so a line that very many documents hold is a few rows there. The hashes over the threshold are written, and
lines join them on the hash; one side of that join is unique, so that adaptive execution can split the other at a hot line.
What comes back to a text is the set of its positions to drop. The text itself is shuffled once, split into lines.

Defined cases: a null or empty text is one empty line. A document is a doc_id: rows that share one are the same document
to the count and keep their lines or lose them by their own text; equal rows get equal results. A null doc_id is one
document behind all others, as if it were 2**63 - 1. A line that stands several times in the document that keeps it, stays
there every time. Two different keys have the same hash with a probability of 2**-128. An empty table gives an empty one.
Columns besides doc_id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

MIN_CHARS, MIN_DOCS = 10, 2
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH, _ROW = ["h0", "h1"], ["d", "t0", "t1"]


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _digest(value: Column, names: list[str]) -> list[Column]:
    return [F.xxhash64(F.lit(k), value).alias(name) for k, name in enumerate(names)]


def split_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, d, t0, t1, lines): the id, the key of the row and its lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("d")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), order, *_digest(text, _ROW[1:]), F.split(text, "\n", -1).alias("lines"))


def repeated_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(d, t0, t1, dropped): of each row that loses lines, their positions from 0, as a set."""
    lines = rows.select(*_ROW, F.posexplode_outer("lines").alias("at", "line")).where(F.char_length(F.btrim("line", F.lit(_BLANK))) >= min_chars)
    lines = lines.select(*_ROW, "at", *_digest(line_key(F.col("line")), _HASH))
    if min_docs == 2:  # least and greatest differ: two documents at least
        held = lines.groupBy(*_HASH).agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last")
    else:
        held = lines.select(*_HASH, "d").distinct().groupBy(*_HASH).agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    held = cut(held.select(*_HASH, "first"), "lines-held")
    return lines.join(held, _HASH).where("d <> first").groupBy(*_ROW).agg(F.collect_set("at").alias("dropped"))


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row, the text without the lines that an earlier document holds."""
    rows = split_rows(docs)
    # `lines` is made below the join, so the optimiser can't put the split into the function that looks lines up
    joined = rows.join(repeated_lines(rows, min_chars, min_docs), _ROW, "left").withColumn("n", F.size("lines"))
    kept = F.expr("if(dropped is null, lines, transform(array_except(sequence(0, n - 1), dropped), i -> lines[i]))")
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("bigint")
    return joined.select("doc_id", F.col("n").cast("bigint").alias("n_lines"), n_dropped.alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
