"""Deterministic preparation of datasets: caps, balance, strata, quotas, splits.

Documents with labels are the rows; source is the type, quality the verdict. "Random" order is a key that depends on the
row's id and a seed alone, so results do not depend on partitions. A type may hold a third of all rows: ranks are told
within stretches of the key's range, by counts of the stretches before, so that no type has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table

SEED, STRETCHES = 42, 256
ROWS_SQL = f"WITH d AS (SELECT doc_id, source, lang, quality, toxic, n_chars, (doc_id % 2147483648 * 2654435761 + {SEED}) % 4294967296 AS h FROM documents JOIN labels USING (doc_id)) "


def order_key(column: str = "doc_id", seed: int = SEED) -> Column:
    """An order that mixes ids, the same in every engine. The id is taken modulo 2**31, so that no product is too large."""
    return F.pmod(F.pmod(F.col(column), F.lit(1 << 31)) * F.lit(2654435761) + seed, F.lit(4294967296))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return keyed(d)


def ranked(df: DataFrame, *by: str, key: str = "doc_id") -> DataFrame:
    """``df`` with r, a row's place from 1 among the rows that agree in ``by``, in the order of h and the key. A group is
    cut into ``STRETCHES`` stretches of h; rows are numbered within a stretch and moved up by the stretches before."""
    keys = [F.col(c).alias(f"_{c}") for c in by]
    cut = df.withColumn("_p", F.floor(F.col("h") * STRETCHES / 4294967296))
    past = Window.partitionBy(*(f"_{c}" for c in by)).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = Window.partitionBy(*by, "_p").orderBy("h", key)
    out = cut.withColumn("_k", F.row_number().over(own)).join(before, same)
    return out.withColumn("r", F.col("_k") + F.col("_before")).drop("_p", "_q", "_n", "_before", "_k", *(f"_{c}" for c in by))


def keyed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` with its order key h."""
    return df.withColumn("h", order_key(key))


def _sizes(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))


def _by(df: DataFrame, limits: DataFrame, by: str) -> DataFrame:
    """``df`` with the limits of each row's kind; kinds are few, and a null one is a kind."""
    other = limits.withColumnRenamed(by, "_by")
    return df.join(F.broadcast(other), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def capped(df: DataFrame, by: str, key: str = "doc_id", least: int = 10) -> DataFrame:
    """The rows of ``df`` (with h), of each kind at most so many: the larger of the third quartile and the median of the kinds'
    sizes, or ``least``."""
    cap = _sizes(df, by).agg(F.greatest(rnd(F.expr("percentile(_size, 0.75)")), rnd(F.expr("percentile(_size, 0.5)")), F.lit(least)).alias("_cap"))
    return ranked(df, by, key=key).join(F.broadcast(cap)).where("r <= _cap").drop("r", "_cap")  # one row


def balanced(df: DataFrame, by: str, verdict: str, key: str = "doc_id") -> DataFrame:
    """Every verdict of a kind down to the rarest one's size; kinds with one verdict stay as they are, and so do rows without
    one."""
    told = df.where(F.col(verdict).isNotNull())
    m = _sizes(told, by, verdict).groupBy(by).agg(F.min("_size").alias("_m"), F.count(F.lit(1)).alias("_k"))
    kept = _by(ranked(told, by, verdict, key=key), m, by).where("_k < 2 OR r <= _m").drop("r", "_m", "_k")
    return kept.unionByName(df.where(F.col(verdict).isNull()))


def capped_verdicts(df: DataFrame, by: str, verdict: str, key: str = "doc_id", times: int = 2, least: int = 3) -> DataFrame:
    """Of each verdict of a kind at most ``times`` the median verdict's size, or ``least``."""
    m = _sizes(df, by, verdict).groupBy(by).agg(F.greatest(F.expr("percentile(_size, 0.5)") * times, F.lit(least)).alias("_cap"))
    return _by(ranked(df, by, verdict, key=key), m, by).where("r <= _cap").drop("r", "_cap")


def spread_over(df: DataFrame, by: str, budget: int, key: str = "doc_id") -> DataFrame:
    """``budget`` rows: an equal part of it for each kind, then the next rows in order until it is used up."""
    per = df.select(by).distinct().agg(F.floor(F.lit(budget) / F.count(F.lit(1))).alias("_per"))
    r = ranked(df, by, key=key).join(F.broadcast(per)).withColumn("_first", F.col("r") <= F.col("_per"))  # one row
    return r.orderBy(F.desc("_first"), "h", key).limit(budget).drop("r", "_per", "_first")


def in_proportion(df: DataFrame, by: str, total: int, key: str = "doc_id") -> DataFrame:
    """One row of every kind, the rest of ``total`` in proportion to what is left of it, by largest remainders."""
    c = _sizes(df, by)
    t = c.agg(F.sum("_size").alias("_t"), F.count(F.lit(1)).alias("_k"))
    share = F.coalesce(F.try_divide((F.col("_size") - 1) * (total - F.col("_k")), F.col("_t") - F.col("_k")), F.lit(0.0))
    f = c.join(F.broadcast(t)).withColumn("_q", 1 + F.floor(share)).withColumn("_frac", share - F.floor(share))  # one row
    every = Window.partitionBy(F.lit(0))  # a row a kind
    g = f.withColumn("_quota", F.col("_q") + F.when(F.row_number().over(every.orderBy(F.desc("_frac"), by)) <= total - F.sum("_q").over(every), 1).otherwise(0))
    return _by(ranked(df, by, key=key), g.select(by, "_quota"), by).where("r <= _quota").drop("r", "_quota")


@query(ROWS_SQL + ", c AS (SELECT source, count(*) AS c FROM d GROUP BY source), q AS (SELECT greatest(quantile_cont(c, .75)::INT, quantile_cont(c, .5)::INT, 10) AS cap FROM c) SELECT doc_id, source FROM d, q QUALIFY row_number() OVER (PARTITION BY source ORDER BY h, doc_id) <= any_value(cap) OVER ()")
def cap_per_type(spark, sf_dir):
    return capped(rows(spark, sf_dir), "source").select("doc_id", "source")


@query(ROWS_SQL + ", c AS (SELECT source, quality, count(*) AS c FROM d GROUP BY ALL), m AS (SELECT source, min(c) AS m, count(*) AS k FROM c GROUP BY source) SELECT doc_id, source, quality FROM d JOIN m USING (source) QUALIFY k < 2 OR row_number() OVER (PARTITION BY source, quality ORDER BY h, doc_id) <= m")
def balance_binary(spark, sf_dir):
    return balanced(rows(spark, sf_dir), "source", "quality").select("doc_id", "source", "quality")


@query(ROWS_SQL + ", c AS (SELECT source, n_chars // 500 AS v, count(*) AS c FROM d GROUP BY ALL), m AS (SELECT source, greatest(median(c) * 2, 3) AS cap FROM c GROUP BY source) SELECT doc_id FROM d JOIN m USING (source) QUALIFY row_number() OVER (PARTITION BY source, n_chars // 500 ORDER BY h, doc_id) <= cap")
def cap_numeric_verdict(spark, sf_dir):
    return capped_verdicts(rows(spark, sf_dir).withColumn("v", F.floor(F.col("n_chars") / 500)), "source", "v").select("doc_id")


@query(ROWS_SQL + ", k AS (SELECT 100 // count(DISTINCT source) AS per FROM d), r AS (SELECT doc_id, h, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) <= (SELECT per FROM k) AS first FROM d) SELECT doc_id FROM r ORDER BY first DESC, h, doc_id LIMIT 100")
def stratified_val_sample(spark, sf_dir, budget: int = 100):
    return spread_over(rows(spark, sf_dir), "source", budget).select("doc_id")


@query(ROWS_SQL + """, c AS (SELECT source, count(*) AS c FROM d GROUP BY source), t AS (SELECT sum(c) AS t, count(*) AS k FROM c),
f AS (SELECT source, c, 1 + floor((c - 1) * (100 - k) / (t - k)::DOUBLE) AS q, (c - 1) * (100 - k) / (t - k)::DOUBLE - floor((c - 1) * (100 - k) / (t - k)::DOUBLE) AS frac FROM c, t),
g AS (SELECT source, (q + CASE WHEN row_number() OVER (ORDER BY frac DESC, source) <= 100 - sum(q) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f)
SELECT doc_id, source FROM d JOIN g USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY h, doc_id) <= quota""")
def stratified_proportional(spark, sf_dir, total: int = 100):
    return in_proportion(rows(spark, sf_dir), "source", total).select("doc_id", "source")


@query(ROWS_SQL + """, c AS (SELECT source, count(*) AS c FROM d GROUP BY source), o AS (SELECT source, c, row_number() OVER (ORDER BY c, source) AS i, count(*) OVER () AS k FROM c),
w AS (WITH RECURSIVE r(i, source, quota, remaining) AS (SELECT 0::BIGINT, ''::VARCHAR, 0::BIGINT, 150::BIGINT UNION ALL
 SELECT o.i, o.source, least(o.c, r.remaining // (o.k - o.i + 1)), r.remaining - least(o.c, r.remaining // (o.k - o.i + 1)) FROM r JOIN o ON o.i = r.i + 1) SELECT source, quota FROM r WHERE i > 0)
SELECT source, quota FROM w""")
def waterfill_allocation(spark, sf_dir, target: int = 150):
    """Equal shares; what small types can't fill goes to larger ones: types from small to large, folded over an array."""
    c = rows(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    a = c.agg(F.array_sort(F.collect_list(F.struct("c", "source"))).alias("a"))  # a row a type
    share = "least(x.c, (s.left div (size(a) - size(s.done))))"
    w = a.selectExpr(f"""aggregate(a, named_struct('left', {target}L, 'done', cast(array() as array<struct<source:string,quota:bigint>>)),
        (s, x) -> named_struct('left', s.left - {share}, 'done', array_append(s.done, named_struct('source', x.source, 'quota', {share})))).done AS done""")
    return w.selectExpr("inline(done)")


@query(ROWS_SQL + ", r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS i, count(*) OVER () AS n FROM d) SELECT doc_id, CASE WHEN i < floor(n * 0.94) THEN 'train' WHEN i < floor(n * 0.94) + floor(n * 0.013) THEN 'val' ELSE 'test' END AS split FROM r")
def split_train_val_test(spark, sf_dir):
    """94 : 1.3 : rest. Cut points are two order statistics of the key, so no row is ranked in one task: rows left of a
    cut are compared with it."""
    d = rows(spark, sf_dir).select("doc_id", "h")
    n = d.count()
    a, b = int(n * 0.94), int(n * 0.94) + int(n * 0.013)
    key = F.struct("h", "doc_id")
    # the cut keys from counts by leading bits of the key (at most 4096 rows), then within one such stretch
    cuts = []
    counts = {r["p"]: r["count"] for r in d.groupBy(F.shiftright("h", 20).alias("p")).count().collect()}
    for at in (a, b):
        before = 0
        for p in sorted(counts):
            if before + counts[p] > at:
                inside = d.where(F.shiftright("h", 20) == p).orderBy("h", "doc_id").limit(at - before + 1).agg(F.max(key).alias("k")).first()["k"]
                cuts.append(F.struct(F.lit(inside["h"]).alias("h"), F.lit(inside["doc_id"]).alias("doc_id")))
                break
            before += counts[p]
        else:
            cuts.append(None)
    left = lambda c: F.lit(True) if c is None else key < c
    return d.select("doc_id", F.when(left(cuts[0]), "train").when(left(cuts[1]), "val").otherwise("test").alias("split"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def topk_longest(spark, sf_dir, k: int = 50):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(k)


@query("SELECT doc_id, lang FROM documents WHERE n_chars BETWEEN 256 AND 4096")
def filter_length_range(spark, sf_dir, lo: int = 256, hi: int = 4096):
    return table(spark, sf_dir, "documents").where(F.col("n_chars").between(lo, hi)).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE coalesce(source, '') NOT IN ('src0', 'src3')")
def filter_not_in_types(spark, sf_dir, types: tuple = ("src0", "src3")):
    return table(spark, sf_dir, "documents").where(~F.coalesce("source", F.lit("")).isin(*types)).select("doc_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t-\\r]+'))::INT AS n_words FROM documents WHERE len(regexp_extract_all(text, '[^ \\t-\\r]+')) <= 300")
def filter_token_budget(spark, sf_dir, most: int = 300):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([^ \\t-\\r]+)"))).alias("n_words"))
    return d.where(F.col("n_words") <= most)


@query(ROWS_SQL + ", c AS (SELECT source, count(*) AS c FROM d WHERE toxic = 1 GROUP BY source) SELECT s.source, greatest(10 - coalesce(c, 0), 0)::BIGINT AS needed FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN c USING (source) WHERE coalesce(c, 0) < 10")
def topup_deficit(spark, sf_dir, least: int = 10):
    have = rows(spark, sf_dir).where("toxic = 1").groupBy("source").count()
    every = table(spark, sf_dir, "documents").select("source").distinct()
    return every.join(have, "source", "left").select("source", F.greatest(least - F.coalesce("count", F.lit(0)), F.lit(0)).alias("needed")).where("needed > 0")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels USING (doc_id)")
def anti_join_fill(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT d.doc_id, d.lang FROM documents d SEMI JOIN labels USING (doc_id)")
def semi_join_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
