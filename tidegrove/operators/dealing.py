"""Rows over parts of equal work, over a whole table.

Rows are ranked by size, and each ``parts`` neighbours, a run, go one to each part, runs in turn forwards and backwards.
Neighbours are of nearly one size: what the parts differ by after any number of runs is at most the largest size less the least,
as the sizes that runs span don't overlap, and counts differ by one at most. No task sees more than a stretch of one size's rows.

``differenced`` goes on from the ranks with the largest differencing method. Each run is a tuple of ``parts`` sizes. Tasks take
``TOGETHER`` neighbouring runs and merge them, always the two tuples that differ most within, the fullest part of one with the
emptiest of the other; what is left of a task is again one tuple, and so on, level by level, until one tuple is left. A merged
tuple never differs more within than the two it was made of, so neither does the last one, whatever the number of levels.

Defined cases: a null size counts as nothing. The key is unique and not null; rows of one size stand by the key.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table
from ..streaming.growth import fixed

#: Stretches of the key's hash that the rows of one size are cut into; runs that a task merges.
STRETCHES, TOGETHER = 256, 512


def by_size(rows: DataFrame, key: str, size: str) -> DataFrame:
    """(key, size, place): places from 0, the largest first. Rows are counted by size and stretch of the key; only the
    sums over sizes, one row for each distinct size, are made in one task."""
    d = rows.select(key, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size))
    bounds = d.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))  # one row
    real = lambda c: F.col(c).cast("double")
    stretch = F.floor((real(key) - real("_lo")) / (real("_hi") - real("_lo") + 1) * STRETCHES)
    d = d.join(F.broadcast(bounds)).withColumn("_s", stretch).drop("_lo", "_hi")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = d.groupBy(size, "_s").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(size).agg(F.sum("_n").alias("_n")).withColumn("_before", before(Window.orderBy(F.desc(size)))).drop("_n")
    starts = counts.withColumn("_inside", before(Window.partitionBy(size).orderBy("_s"))).join(sizes, size).select(size, "_s", (F.col("_inside") + F.col("_before")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(size, "_s").orderBy(key)) - 1 + F.col("_start")
    return d.join(starts, [size, "_s"]).select(key, size, place.cast("bigint").alias("place"))


def dealt(place: Column, parts: int) -> Column:
    """The part of a place: run by run, forwards and backwards."""
    inside = F.pmod(place, F.lit(parts))
    return F.when(F.floor(place / parts) % 2 == 0, inside).otherwise(parts - 1 - inside).cast("int")


def difference(tuples: np.ndarray) -> np.ndarray:
    """For each tuple the part that each of its members goes to: the two tuples that differ most within are merged until one
    is left."""
    n, k = tuples.shape

    def entry(slots: list, tie: int) -> tuple:
        slots.sort(key=lambda s: -s[0])
        return (slots[-1][0] - slots[0][0], tie, slots)

    heap = [entry([(int(x), (i, j)) for j, x in enumerate(row)], i) for i, row in enumerate(tuples.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, one = heapq.heappop(heap)
        two = heapq.heappop(heap)[2]
        heapq.heappush(heap, entry([(a + b, (x, y)) for (a, x), (b, y) in zip(one, reversed(two), strict=True)], tie))
    out = np.zeros((n, k), np.int32)
    for part, (_, tree) in enumerate(heap[0][2] if heap else []):
        todo = [tree]
        while todo:
            x = todo.pop()
            if isinstance(x[0], tuple):
                todo += x
            else:
                out[x] = part
    return out


def differenced(rows: DataFrame, key: str, size: str, parts: int) -> DataFrame:
    """(key, size, part) of every row. Counts of parts differ by one at most, loads by what the sizes of one run span."""
    placed = by_size(rows, key, size).withColumn("group", F.expr(f"place div {parts * TOGETHER}"))
    kinds = dict(placed.dtypes)

    def runs(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        sizes = group[size].to_numpy(np.int64)
        tuples = np.append(sizes, np.zeros(-len(sizes) % parts, np.int64)).reshape(-1, parts)
        return group.assign(part=difference(tuples).ravel()[: len(sizes)])[[key, size, "group", "part"]]

    out = fixed(placed.groupBy("group").applyInPandas(runs, f"{key} {kinds[key]}, {size} bigint, group bigint, part int"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.coalesce(F.try_element_at(F.col("m"), p), F.lit(0).cast("bigint")))
    tuples = out.groupBy("group", "part").agg(F.sum(size).alias("load")).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("part", "load"))).alias("m")).select("group", loads.alias("loads"))

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("group")
        loads = np.stack(group["loads"].to_numpy())
        return group.assign(moves=list(difference(loads)))[["group", "upper", "loads", "moves"]]

    while tuples.agg(F.max("group")).first()[0]:
        level = tuples.withColumn("upper", F.expr(f"`group` div {TOGETHER}")).groupBy("upper").applyInPandas(merged, "group bigint, upper bigint, loads array<bigint>, moves array<int>")
        level = fixed(level)
        moved = out.join(level.select("group", "upper", "moves"), "group")
        out = fixed(moved.select(key, size, F.col("upper").alias("group"), F.col("moves")[F.col("part")].alias("part")))
        each = level.select("upper", F.explode(F.arrays_zip("loads", "moves")).alias("x")).groupBy(F.col("upper").alias("group"), F.col("x.moves").alias("part")).agg(F.sum("x.loads").alias("load"))
        tuples = each.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("part", "load"))).alias("m")).select("group", loads.alias("loads"))
    return out.select(key, size, "part")


RANK_SQL = "WITH r AS (SELECT doc_id, c, row_number() OVER (ORDER BY c DESC, doc_id) - 1 AS i FROM (SELECT doc_id, {work} AS c FROM documents)), p AS (SELECT doc_id, c, CASE WHEN (i // {parts}) % 2 = 0 THEN i % {parts} ELSE {parts} - 1 - i % {parts} END AS part FROM r) "
_CHARS = "coalesce(n_chars, 0)"


def _loads(spark, sf_dir, parts: int, work: Column | None = None) -> DataFrame:
    """(part, n, load) of all documents, dealt."""
    size = F.col("n_chars") if work is None else work
    d = by_size(table(spark, sf_dir, "documents").select("doc_id", size.alias("size")), "doc_id", "size")
    return d.groupBy(dealt(F.col("place"), parts).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("load"))


@query(RANK_SQL.format(work=_CHARS, parts=8) + "SELECT part::INT AS part, count(*) AS n, sum(c)::BIGINT AS chars FROM p GROUP BY part")
def greedy_partition(spark, sf_dir, parts: int = 8):
    """All documents over eight parts of equal count and nearly equal length: the loads."""
    return _loads(spark, sf_dir, parts).withColumnRenamed("load", "chars")


@query(RANK_SQL.format(work=f"24576 * {_CHARS} + {_CHARS} * {_CHARS}", parts=4) + "SELECT part::INT AS rank, count(*) AS n, sum(c)::BIGINT AS work FROM p GROUP BY part")
def balance_batch(spark, sf_dir, ranks: int = 4):
    """All rows to ranks of about equal work, 24576 L + L**2: the loads."""
    c = F.coalesce("n_chars", F.lit(0))
    return _loads(spark, sf_dir, ranks, 24576 * c + c * c).select(F.col("part").alias("rank"), "n", F.col("load").alias("work"))


MICRO_SQL = RANK_SQL.replace("WITH r AS", "WITH m AS (SELECT greatest(1, ceil(sum(coalesce(n_chars, 0)) / 200000.0))::BIGINT AS parts FROM documents), r AS").replace("FROM r)", "FROM r, m)")


@query(MICRO_SQL.format(work=_CHARS, parts="parts") + ", b AS (SELECT part, count(*) AS n, sum(c) AS chars FROM p GROUP BY part), o AS (SELECT *, row_number() OVER (ORDER BY chars, part) - 1 AS k, count(*) OVER () AS m FROM b) SELECT (CASE WHEN k % 2 = 0 THEN k // 2 ELSE m - 1 - k // 2 END)::BIGINT AS batch, n, chars::BIGINT AS chars FROM o")
def micro_batches(spark, sf_dir, most: int = 200000):
    """As many batches as the sum of characters needs, of equal count and nearly equal length; the shortest stand at both
    ends. One row is read for their number."""
    parts = max(1, -(-int(table(spark, sf_dir, "documents").agg(F.sum("n_chars")).first()[0] or 0) // most))
    b = by_size(_loads(spark, sf_dir, parts), "part", "load")  # by load, the largest first
    k = F.lit(parts) - 1 - F.col("place")
    # equal loads stand by part: places from the end count them backwards, so they are counted from the front again
    same = Window.partitionBy("load")
    first, last = F.min("place").over(same), F.max("place").over(same)
    k = F.lit(parts) - 1 - (first + last - F.col("place"))
    b = b.withColumn("k", k).join(_loads(spark, sf_dir, parts).select("part", "n"), "part")
    end = F.when(F.col("k") % 2 == 0, F.expr("k div 2")).otherwise(F.lit(parts) - 1 - F.expr("k div 2"))
    return b.select(end.cast("bigint").alias("batch"), "n", F.col("load").alias("chars"))


@query("WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT i // greatest(1, n // 8) AS p, sum(c) AS s FROM (SELECT coalesce(n_chars, 0) AS c, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), n GROUP BY 1) SELECT 'before' AS what, max(s)::BIGINT AS hi, min(s)::BIGINT AS lo, (max(s) - min(s))::BIGINT AS apart FROM p")
def seqlen_unbalance(spark, sf_dir, parts: int = 8):
    """Largest and least load of parts of neighbouring documents; the rows over a multiple of the parts are one of their own."""
    from .algebra import numbered

    d = numbered(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("c")), "doc_id")
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))  # one row
    p = d.join(F.broadcast(n)).groupBy(F.expr(f"_i div greatest(1, n div {parts})")).agg(F.sum("c").alias("s"))
    return p.agg(F.max("s").alias("hi"), F.min("s").alias("lo")).select(F.lit("before").alias("what"), "hi", "lo", (F.col("hi") - F.col("lo")).alias("apart"))


@query(RANK_SQL.format(work=_CHARS, parts=8) + ", s AS (SELECT sum(c) AS s FROM p GROUP BY part) SELECT 'after' AS what, max(s)::BIGINT AS hi, min(s)::BIGINT AS lo, round(avg(s), 4) AS mean FROM s")
def seqlen_balanced(spark, sf_dir, parts: int = 8):
    """The same after the documents were dealt by size."""
    p = _loads(spark, sf_dir, parts)
    return p.agg(F.max("load").alias("hi"), F.min("load").alias("lo"), rnd(F.avg("load"), 4).alias("mean")).select(F.lit("after").alias("what"), "hi", "lo", "mean")


@query()
def karmarkar_karp(spark, sf_dir, parts: int = 8):
    """All documents over eight parts by differencing. SQL can't express it; it is held against its bound and brute force."""
    return differenced(table(spark, sf_dir, "documents"), "doc_id", "n_chars", parts)
