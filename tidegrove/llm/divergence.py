"""How far the sources of a language use its words differently: an audit over integer dictionaries.

Terms (runs of letters A-Z, lowered, and of all that isn't ASCII) are counted in tasks: of a slice of texts the distinct
hashes are sorted, a term's id is its place among them (searchsorted), and counts are summed by group and id; what a task
has seen leaves it as rows (lang, term, source, count, documents), so a frequent term is one row for each task and source,
however often it stands. Spark sums these in one shuffle by language and term and keeps the terms of enough documents.

Kept terms of a language get gapless ids in the order of their UTF-8 bytes (``ordinals.py``) and are cut into chunks of
``CHUNK`` ids. A task takes one chunk: its sorted terms, and dense vectors of the chunk for each group by bincount. What
a pair of groups differs by is summed over chunks by Spark, and of terms each chunk gives its first ``TOP``. As ids are
in the terms' order, ties go by id. No task sees a whole dictionary, and languages with more than ``BLOCK`` sources have a
task for each chunk and two blocks of sources.

All numbers are integers of 64 bits. 10**9 * (count+1) is divided digit by digit, three at a time, so sums of up to
9 * 10**15 are exact, and so are sums of f, which can't be over (10**9 + V) ** 2.

Defined cases: null text, lang and source are ''. Each row is a document, also if rows repeat or share a doc_id. Every
(lang, source) that occurs is a group; one without terms has count 0 for each kept term. A language with no kept term has
value 0 for each pair and no terms; one with one source has no pairs. An empty table gives an empty one. Columns besides
these three are never read. Two terms of one task have the same hash with a probability of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .ordinals import numbered
from .shared import cut, free

MIN_DOCS, TOP, SCALE, SMOOTH = 3, 200, 10**9, 1
#: Ids in a chunk, and sources in a block: a task has CHUNK x BLOCK counts at most.
CHUNK, BLOCK = 1 << 15, 128
#: Rows that a task gathers before it passes them on, and bytes that it looks at together.
GATHERED, SLICE = 1 << 20, 1 << 21
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_COUNTED = "lang string, term string, source string, n bigint, docs bigint"
_FOUND = "lang string, source string, part string, item string, id bigint, value bigint"
_RESULT = pa.schema([*((c, pa.string()) for c in ("lang", "source", "part", "item")), ("id", pa.int64()), ("value", pa.int64())])


def term_words(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, W.Words]:
    """The lowered bytes, and the terms of some texts."""
    data = W._LOWER[texts.data]
    starts, ends = W.spans(data, texts.offsets, ~_TERM)
    return data, starts, ends, W.Words(starts, ends, W.span_hash(data, starts, ends), np.searchsorted(starts, texts.offsets))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of bytes as strings."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


class Counts:
    """What a task has counted: a sorted array of hashes with their terms, and sums by (group, hash)."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.known, self.terms = np.zeros(0, np.uint64), pa.array([], pa.large_string())
        self.parts, self.rows = [], 0

    def add(self, texts: W.Texts, group: np.ndarray) -> None:
        """``group`` has the number of each text's group."""
        data, starts, ends, found = term_words(texts)
        if not len(starts):
            return
        own, first, ids = np.unique(found.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(len(self.known) - 1, 0))
        new = self.known[at] != own if len(self.known) else np.ones(len(own), bool)
        if new.any():
            both = np.append(self.known, own[new])
            order = np.argsort(both, kind="stable")
            terms = pa.concat_arrays([self.terms, _strings(data, starts[first[new]], ends[first[new]])])
            self.known, self.terms = both[order], terms.take(pa.array(order))
        key, n = np.unique(W.owner(found.first) * len(own) + ids, return_counts=True)  # by text and id
        text, ids = np.divmod(key, len(own))
        self.parts.append(self.summed(group[text], own[ids], n, np.ones(len(n), np.int64)))
        self.rows += len(self.parts[-1][0])

    @staticmethod
    def summed(group: np.ndarray, value: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((group, value))
        group, value = group[order], value[order]
        at = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (group[1:] != group[:-1])))
        return group[at], value[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)

    def compact(self) -> None:
        if len(self.parts) > 1:
            self.parts = [self.summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.rows = len(self.parts[0][0]) if self.parts else 0

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        """Rows by term, so that equal ones are neighbours."""
        self.compact()
        lang, source = (pa.array(x, pa.string()) for x in zip(*self.groups, strict=True)) if self.groups else (None, None)
        for lo in range(0, self.rows, 1 << 16):
            group, value, n, docs = (x[lo : lo + (1 << 16)] for x in self.parts[0])
            term = self.terms.take(pa.array(np.searchsorted(self.known, value))).cast(pa.string())
            group = pa.array(group)
            yield pa.RecordBatch.from_arrays([lang.take(group), term, source.take(group), pa.array(n), pa.array(docs)], ["lang", "term", "source", "n", "docs"])
        self.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        lang, source, text = (batch.column(k) for k in range(3))
        groups = counts.groups
        group = np.array([groups.setdefault(x, len(groups)) for x in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
        for texts in W.slices(text, SLICE):
            counts.add(texts, group[texts.rows])
            if counts.rows > 2 * GATHERED:
                counts.compact()
                if counts.rows > GATHERED:
                    yield from counts.rows_out()
    yield from counts.rows_out()


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, counts, total): the terms in at least ``min_docs`` rows of the language, how often by source, and in all.
    One shuffle by language and term: both sums are over what then lies together."""
    rows = plain(docs).mapInArrow(_count, _COUNTED)
    each = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    count = F.struct("source", "n")
    return each.groupBy("lang", "term").agg(F.collect_list(count).alias("counts"), F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")


def smoothed(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), three decimal digits at a time."""
    whole = n + SMOOTH * v
    out, rest = np.zeros(count.shape, np.int64), count + SMOOTH
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _audit(kept: pa.Table, groups: pa.Table) -> pa.Table:
    """A chunk of kept terms and two blocks of a language's groups: what each group of the first block has apart from each
    of the second, and, if the blocks are one, the group's foremost terms."""
    if not len(groups):  # no source fell into these blocks
        return _RESULT.empty_table()
    kept, groups = kept.sort_by("id"), groups.sort_by("source")
    ids, width = kept.column("id").to_numpy(), len(kept)  # gapless, so a term's place in the chunk is its place here
    lang, x, y, v, lang_n = (groups.column(c)[0].as_py() for c in ("lang", "x", "y", "v", "lang_n"))
    sources = groups.column("source").combine_chunks()
    names, n, block = sources.to_pylist(), groups.column("n").to_numpy(), groups.column("block").to_numpy()
    counts = kept.column("counts").combine_chunks()
    entries = counts.flatten()
    row = np.repeat(np.arange(width), pc.list_value_length(counts).to_numpy(zero_copy_only=False))
    source = pc.index_in(entries.field("source"), sources).to_numpy(zero_copy_only=False).astype(np.int64)
    dense = np.bincount(source * width + row, entries.field("n").to_numpy(zero_copy_only=False), len(names) * width)  # exact to 2**53
    dense = dense.astype(np.int64).reshape(len(names), width)
    p = np.stack([smoothed(dense[k], int(n[k]), v) for k in range(len(names))]) if width else np.zeros(dense.shape, np.int64)
    out: list[tuple] = []
    for a in np.flatnonzero(block == x):
        for b in np.flatnonzero(block == y):
            if a != b:
                out.append((lang, names[a], "pair", names[b], 0, int(apart(p[a], p[b]).sum())))
    if x == y and width:
        q = smoothed(kept.column("total").to_numpy(), lang_n, v)
        terms = kept.column("term")
        for a in range(len(names)):
            more = np.flatnonzero((dense[a] > 0) & (p[a] > q))
            value = apart(p[a][more], q[more])
            for k in np.argsort(-value, kind="stable")[:TOP]:
                out.append((lang, names[a], "term", terms[int(more[k])].as_py(), int(ids[more[k]]), int(value[k])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT) if out else _RESULT.empty_table()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) as the module says; ranks of terms go to ``TOP``."""
    first = cut(kept_terms(docs, min_docs), "divergence-terms")
    kept = numbered(first, ["lang"], ["term"], "divergence", fixed=True)
    free(first)
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    pairs = plain(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n"])
    pairs = cut(pairs, "divergence-groups")
    langs = pairs.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    langs = cut(langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").fillna(0, ["v"]), "divergence-langs")
    # both sides have a row for each chunk and ordered pair of blocks in which they are needed
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).otherwise(0)
    wide = pairs.join(langs, "lang").withColumn("block", block)
    chunks = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("v") / CHUNK) - 1, F.lit(0).cast("bigint")))
    places = F.expr("flatten(transform(sequence(0, blocks - 1), o -> if(o = block, array(struct(block as x, block as y)), array(struct(block as x, o as y), struct(o as x, block as y)))))")
    wide = wide.withColumn("chunk", F.explode(chunks)).withColumn("at", F.explode(places)).select("lang", "chunk", "at.x", "at.y", "source", "n", "block", "v", "lang_n")
    every = F.expr("flatten(transform(sequence(0, blocks - 1), x -> transform(sequence(0, blocks - 1), y -> struct(x, y))))")
    thin = kept.withColumn("chunk", F.expr(f"idx div {CHUNK}")).join(langs.select("lang", "blocks"), "lang").withColumn("at", F.explode(every))
    inside = F.expr("filter(counts, c -> blocks = 1 or pmod(xxhash64(c.source), blocks) in (at.x, at.y))")
    thin = thin.select("lang", "chunk", "at.x", "at.y", F.col("idx").alias("id"), "term", inside.alias("counts"), "total")
    key = ["lang", "chunk", "x", "y"]
    found = thin.groupBy(*key).cogroup(wide.groupBy(*key)).applyInArrow(_audit, _FOUND)
    found = cut(found, "divergence-found")
    group = ["lang", "source", "part"]
    pair = found.where("part = 'pair'").groupBy(*group, "item").agg(F.sum("value").alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")))
    term = found.where("part = 'term'").withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "id"))).where(F.col("rank") <= TOP)
    return pair.select(*group, "item", "value", "rank").unionByName(term.select(*group, "item", "value", "rank"))
