"""Reports over evaluated rows: labels joined with documents; quality is the accuracy, toxic a second verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import length_bucket
from ..registry import query, rnd, table

ROWS = "WITH d AS (SELECT d.doc_id, source, lang, n_chars, quality, toxic, CASE WHEN n_chars <= 256 THEN 'le256' WHEN n_chars <= 768 THEN 'le768' WHEN n_chars <= 1536 THEN 'le1536' ELSE 'gt1536' END AS bucket FROM documents d JOIN labels USING (doc_id)) "
BUCKETS = ["le256", "le768", "le1536", "gt1536"]


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.withColumn("bucket", length_bucket(F.col("n_chars")))


@query(ROWS + "SELECT source, round(avg(quality), 4) AS accuracy, round(avg(toxic), 4) AS toxic, count(*) AS n FROM d GROUP BY source")
def task_summary(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("source").agg(rnd(F.avg("quality"), 4).alias("accuracy"), rnd(F.avg("toxic"), 4).alias("toxic"), F.count(F.lit(1)).alias("n"))


@query(ROWS + "SELECT lang, " + ", ".join(f"round(avg(quality) FILTER (bucket = '{b}'), 4) AS {b}" for b in BUCKETS) + " FROM d GROUP BY lang")
def length_bucket_pivot(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("lang").pivot("bucket", BUCKETS).agg(rnd(F.avg("quality"), 4))


@query(ROWS + "SELECT bucket, round(avg(quality), 4) AS accuracy, count(*) AS n FROM d GROUP BY bucket")
def length_bucket_overall(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("bucket").agg(rnd(F.avg("quality"), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(ROWS + "SELECT lang, sum(quality * toxic)::BIGINT AS tp, sum(quality * (1 - toxic))::BIGINT AS fp, sum((1 - quality) * toxic)::BIGINT AS fn, round(CASE WHEN sum(quality) + sum(toxic) = 0 THEN 1 ELSE 2 * sum(quality * toxic) / (sum(quality) + sum(toxic))::DOUBLE END, 4) AS f1 FROM d GROUP BY lang")
def micro_f1(spark, sf_dir):
    """Hits and misses pooled before the ratio is taken."""
    q, t = F.col("quality"), F.col("toxic")
    return evaluated(spark, sf_dir).groupBy("lang").agg(F.sum(q * t).alias("tp"), F.sum(q * (1 - t)).alias("fp"), F.sum((1 - q) * t).alias("fn"), rnd(F.when(F.sum(q) + F.sum(t) == 0, 1.0).otherwise(2 * F.sum(q * t) / (F.sum(q) + F.sum(t))), 4).alias("f1"))


@query(ROWS + "SELECT source, lang, grouping_id(source, lang)::BIGINT AS level, count(*) AS n FROM d GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def distribution_log(spark, sf_dir):
    return evaluated(spark, sf_dir).cube("source", "lang").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


@query(ROWS + ", c AS (SELECT source, count(*) AS n FROM d GROUP BY source) SELECT source, n, round(n / sum(n) OVER ()::DOUBLE, 4) AS share, n / sum(n) OVER ()::DOUBLE > 0.25 AS dominant, n < 20 AS rare FROM c")
def generation_balance(spark, sf_dir):
    c = evaluated(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row a type
    return c.select("source", "n", rnd(F.col("n") / total, 4).alias("share"), (F.col("n") / total > 0.25).alias("dominant"), (F.col("n") < 20).alias("rare"))


@query(ROWS + ", c AS (SELECT source, avg(quality) FILTER (toxic = 1) AS a1, avg(quality) FILTER (toxic = 0) AS a0 FROM d GROUP BY source) SELECT source, round(a1, 4) AS acc_toxic, round(a0, 4) AS acc_clean, coalesce(a1 < 0.05 OR a0 < 0.05, false) AS collapse, coalesce(abs(a1 - a0) > 0.3, false) AS skew FROM c")
def class_accuracy(spark, sf_dir):
    c = evaluated(spark, sf_dir).groupBy("source").agg(F.avg(F.when(F.col("toxic") == 1, F.col("quality"))).alias("a1"), F.avg(F.when(F.col("toxic") == 0, F.col("quality"))).alias("a0"))
    return c.select("source", rnd("a1", 4).alias("acc_toxic"), rnd("a0", 4).alias("acc_clean"), F.coalesce((F.col("a1") < 0.05) | (F.col("a0") < 0.05), F.lit(False)).alias("collapse"), F.coalesce(F.abs(F.col("a1") - F.col("a0")) > 0.3, F.lit(False)).alias("skew"))


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS lo, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.99), 4) AS p99, max(n_chars) AS hi FROM documents GROUP BY lang")
def describe_lengths(spark, sf_dir):
    p = lambda x: rnd(F.expr(f"percentile(n_chars, {x})"), 4)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("n_chars"), 4).alias("mean"), rnd(F.stddev_samp("n_chars"), 4).alias("std"), F.min("n_chars").alias("lo"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("n_chars").alias("hi"))


@query("SELECT lang, " + ", ".join(f"round(avg((n_chars <= {c})::INT), 4) AS le{c}" for c in (256, 512, 1024, 2048, 4096)) + " FROM documents GROUP BY lang")
def survival_grid(spark, sf_dir):
    """The share of rows under each of five caps."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*(rnd(F.avg((F.col("n_chars") <= c).cast("int")), 4).alias(f"le{c}") for c in (256, 512, 1024, 2048, 4096)))


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) = 1")
def shortest_example_per_type(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(F.struct("n_chars", "doc_id")).alias("m"))
    return d.select("source", "m.doc_id", "m.n_chars")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT source, count(*) AS c FROM documents GROUP BY source) SELECT greatest(round(quantile_cont(c, 0.75)), round(quantile_cont(c, 0.5)), 100)::BIGINT AS cap FROM c")
def quantile_of_counts(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source").count()
    return c.agg(F.greatest(rnd(F.expr("percentile(count, 0.75)")), rnd(F.expr("percentile(count, 0.5)")), F.lit(100)).cast("bigint").alias("cap"))


@query(ROWS + ", a AS (SELECT source, avg(quality) AS m FROM d WHERE lang = 'en' GROUP BY source), b AS (SELECT source, avg(quality) AS m FROM d WHERE lang <> 'en' GROUP BY source) SELECT source, round(a.m, 4) AS en, round(b.m, 4) AS other, round(b.m - a.m, 4) AS delta FROM a JOIN b USING (source)")
def join_models(spark, sf_dir):
    """Two result sets by task, from one pass."""
    en = F.col("lang") == "en"
    m = evaluated(spark, sf_dir).groupBy("source").agg(F.avg(F.when(en, F.col("quality"))).alias("a"), F.avg(F.when(~en, F.col("quality"))).alias("b")).where("a is not null and b is not null")
    return m.select("source", rnd("a", 4).alias("en"), rnd("b", 4).alias("other"), rnd(F.col("b") - F.col("a"), 4).alias("delta"))


@query("SELECT l_returnflag AS k, round(max(l_quantity), 4) AS max_quantity, round(min(l_discount), 4) AS min_discount, round(avg(l_tax), 4) AS mean_tax FROM lineitem GROUP BY ALL")
def reduce_metrics(spark, sf_dir):
    """Metrics reduced as their names say: max, min, else mean."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(rnd(F.max("l_quantity"), 4).alias("max_quantity"), rnd(F.min("l_discount"), 4).alias("min_discount"), rnd(F.avg("l_tax"), 4).alias("mean_tax"))
