"""Choosing, ordering and dealing rows: samples, quotas, weights, permutations, partitions of equal work.

Documents with labels are the rows, as in ``sampling``. Orders come from keys of the rows; ``dealing`` has partitions of equal work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table
from .algebra import numbered
from .sampling import ROWS_SQL, order_key, ranked, rows


def bucket_of(kind: Column, sub: Column, verdict: Column) -> Column:
    """(kind, sub-kind, verdict class): numbers are one class, texts as they are, none is none."""
    number = F.try_to_number(verdict, F.lit("S9999999999.999999"))
    shown = F.when(verdict.isNull(), "none").when(number.isNotNull(), "number").otherwise(F.lower(verdict))
    return F.concat_ws("/", F.coalesce(kind, F.lit("")), F.coalesce(sub, F.lit("")), shown)


@query(ROWS_SQL + "SELECT source || '/' || lang || '/' || CASE WHEN toxic = 1 THEN 'number' WHEN quality = 1 THEN 'yes' ELSE 'none' END AS bucket, count(*) AS n FROM d GROUP BY ALL")
def bucket_key(spark, sf_dir):
    verdict = F.when(F.col("toxic") == 1, "3.5").when(F.col("quality") == 1, "Yes")
    return rows(spark, sf_dir).groupBy(bucket_of(F.col("source"), F.col("lang"), verdict).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(ROWS_SQL + ", c AS (SELECT source, count(*) AS c, count(*) OVER () AS k FROM d GROUP BY source), q AS (SELECT source, least(c, 150 // k) AS quota FROM c) SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS place FROM d JOIN q USING (source) QUALIFY place <= quota")
def balanced_subset(spark, sf_dir, target: int = 150):
    """An equal quota for each type, or all it has; the rows in a seeded order within their type."""
    d = rows(spark, sf_dir)
    k = d.agg(F.countDistinct("source").alias("k"))
    quota = d.groupBy("source").count().join(F.broadcast(k)).select("source", F.least("count", F.floor(F.lit(target) / F.col("k"))).alias("quota"))  # one row
    return ranked(d, "source").join(quota, "source").where("r <= quota").select("doc_id", "source", F.col("r").alias("place"))


@query(ROWS_SQL + ", k AS (SELECT 80 // count(DISTINCT lang) AS per FROM d), r AS (SELECT doc_id, lang, h, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) <= (SELECT per FROM k) AS first FROM d) SELECT doc_id, lang, first FROM r ORDER BY first DESC, h, doc_id LIMIT 80")
def ood_cap(spark, sf_dir, most: int = 80):
    """At most so many held-out rows: an equal share for each type, then others in order."""
    d = rows(spark, sf_dir)
    per = d.agg(F.floor(F.lit(most) / F.countDistinct("lang")).alias("per"))
    r = ranked(d, "lang").join(F.broadcast(per)).withColumn("first", F.col("r") <= F.col("per"))  # one row
    return r.orderBy(F.desc("first"), "h", "doc_id").limit(most).select("doc_id", "lang", "first")


@query(ROWS_SQL + "SELECT doc_id FROM d ORDER BY h, doc_id LIMIT 40")
def sample_n(spark, sf_dir, n: int = 40):
    """n rows without replacement, the same ones wherever they are drawn."""
    return rows(spark, sf_dir).orderBy("h", "doc_id").limit(n).select("doc_id")


@query("WITH s AS (SELECT p_partkey AS k FROM part ORDER BY (p_partkey % 2147483648 * 2654435761 + 42) % 4294967296, p_partkey LIMIT 30) SELECT k, p_size AS size, coalesce(n, 0) AS lines FROM s JOIN part ON p_partkey = k LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY ALL) USING (k)")
def aligned_sample(spark, sf_dir, n: int = 30):
    """The same drawn ids from two tables."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    drawn = p.withColumn("h", order_key("k")).orderBy("h", "k").limit(n).drop("h")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).join(drawn, "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("lines"))
    return drawn.join(lines, "k", "left").select("k", "size", F.coalesce("lines", F.lit(0)).alias("lines"))


@query(ROWS_SQL + "SELECT doc_id, CASE WHEN h < 4294967296 * 0.3 THEN 'In other words: ' || source ELSE source END AS question, h < 4294967296 * 0.3 AS paraphrased FROM d")
def tag_paraphrase(spark, sf_dir, share: float = 0.3):
    """A seeded share of the rows gets another question and a flag."""
    d = rows(spark, sf_dir)
    chosen = F.col("h") < 4294967296 * share
    return d.select("doc_id", F.when(chosen, F.concat(F.lit("In other words: "), "source")).otherwise(F.col("source")).alias("question"), chosen.alias("paraphrased"))


#: Kinds and, within them, types with their weights.
WEIGHTS = {"series": (0.5, {"mean": 2.0, "range": 1.0, "trend": 1.0}), "cross": (0.3, {"rank": 1.0, "pair": 3.0}), "text": (0.2, {"description": 1.0})}


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """The name that a number in [0, 1) falls on, by weight."""
    total, at, out = sum(weights.values()), 0.0, None
    for name, w in list(weights.items())[:-1]:
        at += w / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    last = list(weights)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def _cases(u: str, weights: dict[str, float]) -> str:
    total, at, out = sum(weights.values()), 0.0, ""
    for name, w in list(weights.items())[:-1]:
        at += w / total
        out += f"WHEN {u} < {at!r}::DOUBLE THEN '{name}' "
    last = list(weights)[-1]
    return f"CASE {out}ELSE '{last}' END" if out else f"'{last}'"


@query(ROWS_SQL + f", u AS (SELECT doc_id, h / 4294967296.0::DOUBLE AS a, ((doc_id + 7) % 2147483648 * 2654435761 + 42) % 4294967296 / 4294967296.0::DOUBLE AS b FROM d), k AS (SELECT *, {_cases('a', {n: w for n, (w, _) in WEIGHTS.items()})} AS kind FROM u) SELECT doc_id, kind, CASE kind " + " ".join(f"WHEN '{n}' THEN {_cases('b', t)}" for n, (_, t) in WEIGHTS.items()) + " END AS type FROM k")
def weighted_choice_2level(spark, sf_dir):
    """A kind by weight, then a type within it by weight, from two seeded numbers of the row."""
    u = rows(spark, sf_dir).withColumn("next", F.col("doc_id") + 7).select("doc_id", (F.col("h") / 4294967296.0).alias("a"), (order_key("next") / 4294967296.0).alias("b"))
    kind = u.withColumn("kind", weighted(F.col("a"), {n: w for n, (w, _) in WEIGHTS.items()}))
    chosen = None
    for n, (_, t) in WEIGHTS.items():
        chosen = F.when(F.col("kind") == n, weighted(F.col("b"), t)) if chosen is None else chosen.when(F.col("kind") == n, weighted(F.col("b"), t))
    return kind.select("doc_id", "kind", chosen.alias("type"))


@query("SELECT r_regionkey AS k FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) FROM range(3) UNION ALL SELECT (SELECT min(r_regionkey) FROM region) FROM range(2)")
def padding(spark, sf_dir, last: int = 3, first: int = 2):
    """The last row and the first row again, so many times."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    again = lambda end, n: r.agg(end("k").alias("k")).select("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("k")
    return r.unionByName(again(F.max, last)).unionByName(again(F.min, first))


@query("SELECT n_nationkey AS k, (n_nationkey * 7 + 3) % 25 AS place, o.n_name AS name FROM nation n JOIN (SELECT n_nationkey AS j, n_name FROM nation) o ON o.j = (n_nationkey * 7 + 3) % 25")
def reorder(spark, sf_dir):
    """Rows by a table of places: row k of the result is row place of the input."""
    n = table(spark, sf_dir, "nation")
    order = n.select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("place"))
    return order.join(n.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name")), "place").select("k", "place", "name")


def shuffled(*lists: str, seed: Column) -> Column:
    """Parallel lists in one seeded order, as an array of structs."""
    zipped = F.transform(F.arrays_zip(*lists), lambda x, i: F.struct(F.xxhash64(seed, i).alias("_h"), x.alias("x")))
    return F.transform(F.array_sort(zipped), lambda x: x["x"])


@query("SELECT conv_id, count(*) AS n, string_agg(turn::VARCHAR || role, ',' ORDER BY turn) AS members FROM conversations GROUP BY conv_id")
def shuffle_aligned(spark, sf_dir):
    """Two lists of a conversation shuffled alike; sorted again they are what they were."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", F.col("m.turn").alias("turns"), F.col("m.role").alias("roles"))
    s = c.select("conv_id", shuffled("turns", "roles", seed=F.col("conv_id")).alias("s"))
    return s.select("conv_id", F.size("s").cast("bigint").alias("n"), F.array_join(F.transform(F.array_sort("s"), lambda x: F.concat(x["turns"].cast("string"), x["roles"])), ",").alias("members"))


@query("SELECT e.e AS epoch, i // 16 AS batch, count(*) AS n, min(k) AS first, max(k) AS last FROM (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), range(2) e(e) GROUP BY ALL")
def make_iterator(spark, sf_dir, size: int = 16, epochs: int = 2):
    """Numbers of batches of the rows for each epoch: what a trainer reads one after the other."""
    p = numbered(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k")
    e = p.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))))
    return e.groupBy("epoch", F.floor(F.col("_i") / size).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


@query("SELECT 'both' AS what, doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only', doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels)")
def intersect_except(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return a.intersect(b).select(F.lit("both").alias("what"), "doc_id").unionByName(a.exceptAll(b).distinct().select(F.lit("only").alias("what"), "doc_id"))


@query("SELECT source, lang FROM documents GROUP BY source, lang")
def debug_distinct(spark, sf_dir):
    """One row of each kind and sub-kind, to look at."""
    return table(spark, sf_dir, "documents").select("source", "lang").dropDuplicates(["source", "lang"])
