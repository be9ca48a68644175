"""Statistics of groups of scored rows: order lines are the samples, their order the group, quantity / 50 the score.

Every estimator is one or two windows over the group, so the groups are shuffled once. Sample deviations are used, and
a group of one has mean 0 and deviation 1 where the estimator divides by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table

SCORE_SQL = "WITH s AS (SELECT l_orderkey AS g, l_linenumber AS i, l_partkey AS p, l_suppkey AS q, l_quantity / 50 AS s, l_extendedprice AS len FROM lineitem), w AS (SELECT *, avg(s) OVER g AS mu, stddev_samp(s) OVER g AS sd, var_samp(s) OVER g AS va, count(*) OVER g AS c, sum(s) OVER g AS t, sum(s * len) OVER g / sum(len) OVER g AS ob FROM s WINDOW g AS (PARTITION BY g)) "
G = lambda: Window.partitionBy("g")  # noqa: E731  columns need a session
KEYS = ["g", "i", "p", "q"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), (F.col("l_quantity") / 50).alias("s"), F.col("l_extendedprice").alias("len"))


# Estimators: what a score is worth within its group. ``group`` is the group's window; a null score has a null worth and counts
# nowhere.


def normalised(score: Column, group) -> Column:
    """By the group's mean and deviation; a group of one by 0 and 1."""
    n = F.count(score).over(group)
    return F.when(n == 1, score / (1 + 1e-6)).otherwise((score - F.avg(score).over(group)) / (F.stddev_samp(score).over(group) + 1e-6))


def normalised_floored(score: Column, group) -> Column:
    """The same with the variance held above a floor; a group of one is worth 0."""
    n = F.count(score).over(group)
    return F.when(n == 1, 0.0 * score).otherwise((score - F.avg(score).over(group)) / F.sqrt(F.greatest(F.var_samp(score).over(group), F.lit(1e-6))))


def leave_one_out(score: Column, group) -> Column:
    """Less the mean of the others; a group of one keeps its score."""
    n = F.count(score).over(group)
    return F.when(n == 1, score).otherwise(score * n / (n - 1) - F.avg(score).over(group) * n / (n - 1))


def leave_one_out_from_sum(score: Column, group) -> Column:
    """The same from the group's sum; a group of one is worth 0."""
    n = F.count(score).over(group)
    return F.when(n == 1, 0.0 * score).otherwise((n * score - F.sum(score).over(group)) / F.greatest(n - 1, F.lit(1)))


def less_weighted_mean(score: Column, group, weight: Column) -> Column:
    """Less the group's mean weighted by length."""
    return score - F.try_divide(F.sum(weight * score).over(group), F.sum(F.when(score.isNotNull(), weight)).over(group))


def _windowed(name: str, worth, sql: str):
    def run(spark, sf_dir):
        return scores(spark, sf_dir).select(*KEYS, rnd(worth(F.col("s"), G()), 4).alias("adv"))

    query(SCORE_SQL + f"SELECT g, i, p, q, round({sql}, 4) AS adv FROM w", name)(run)


_windowed("grpo_advantage", normalised, "CASE WHEN c = 1 THEN s / (1 + 1e-6) ELSE (s - mu) / (sd + 1e-6) END")
_windowed("grpo_vectorized", normalised_floored, "CASE WHEN c = 1 THEN 0 ELSE (s - mu) / sqrt(greatest(va, 1e-6)) END")
_windowed("rloo", leave_one_out, "CASE WHEN c = 1 THEN s ELSE s * c / (c - 1) - mu * c / (c - 1) END")
_windowed("rloo_vectorized", leave_one_out_from_sum, "CASE WHEN c = 1 THEN 0 ELSE (c * s - t) / greatest(c - 1, 1) END")
_windowed("opo", lambda s, g: less_weighted_mean(s, g, F.col("len")), "s - ob")


@query(SCORE_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, i) AS k, lead(s) OVER (PARTITION BY g ORDER BY s DESC, i) AS s2 FROM w WHERE c >= 2) SELECT g, i, round(s - s2, 4) AS adv FROM r WHERE k = 1")
def grpo_passk(spark, sf_dir):
    """The best row's lead over the second best; groups of one are left out."""
    o = G().orderBy(F.desc("s"), "i")
    r = scores(spark, sf_dir).withColumn("k", F.row_number().over(o)).withColumn("s2", F.lead("s").over(o))
    return r.where("k = 1 AND s2 IS NOT NULL").select("g", "i", rnd(F.col("s") - F.col("s2"), 4).alias("adv"))


@query(SCORE_SQL + ", b AS (SELECT *, s - mu AS d FROM w), t AS (SELECT avg(d) AS m, var_samp(d) AS v FROM b) SELECT g, i, p, q, round((d - m) / sqrt(v + 1e-8), 4) AS adv FROM b, t")
def rpp_baseline(spark, sf_dir):
    """Scores less their group's mean, whitened over all rows."""
    b = scores(spark, sf_dir).withColumn("d", F.col("s") - F.avg("s").over(G()))
    t = b.agg(F.avg("d").alias("m"), F.var_samp("d").alias("v"))
    return b.join(F.broadcast(t)).select(*KEYS, rnd((F.col("d") - F.col("m")) / F.sqrt(F.col("v") + 1e-8), 4).alias("adv"))  # one row


@query(SCORE_SQL + ", n AS (SELECT count(*) / nullif(count(*) FILTER (s <> 0), 0)::DOUBLE AS alpha FROM s) SELECT g, i, p, q, round(alpha * (s - mu), 4) AS adv FROM w, n")
def gpg(spark, sf_dir):
    d = scores(spark, sf_dir)
    n = d.agg(F.try_divide(F.count(F.lit(1)), F.count(F.when(F.col("s") != 0, 1))).alias("alpha"))  # null if all scores are 0
    return d.withColumn("mu", F.avg("s").over(G())).join(F.broadcast(n)).select(*KEYS, rnd(F.col("alpha") * (F.col("s") - F.col("mu")), 4).alias("adv"))  # one row


@query(SCORE_SQL + "SELECT g, count(*) AS n, round(CASE WHEN count(*) = 1 THEN 0 ELSE avg(s) END, 4) AS mean, round(CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(s) END, 4) AS std FROM s GROUP BY g")
def group_mean_std(spark, sf_dir):
    n = F.count(F.lit(1))
    return scores(spark, sf_dir).groupBy("g").agg(n.alias("n"), rnd(F.when(n == 1, 0.0).otherwise(F.avg("s")), 4).alias("mean"), rnd(F.when(n == 1, 1.0).otherwise(F.stddev_samp("s")), 4).alias("std"))


@query("SELECT DISTINCT source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS idx FROM documents")
def group_index(spark, sf_dir):
    """Labels to 0..G-1: labels are made distinct first, so that few rows are ranked."""
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.withColumn("idx", F.dense_rank().over(Window.orderBy("source")) - 1)


@query("SELECT l_orderkey AS g, l_returnflag AS vote FROM (SELECT l_orderkey, l_returnflag, count(*) AS c, min(l_linenumber) AS f FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, f, l_returnflag) = 1")
def majority_vote(spark, sf_dir):
    """The commonest value; of equals the one seen first."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("vote")).agg(F.count(F.lit(1)).alias("c"), F.min("l_linenumber").alias("f"))
    return v.groupBy("g").agg(F.min_by("vote", F.struct(-F.col("c"), "f", "vote")).alias("vote"))


@query(SCORE_SQL + ", o AS (SELECT g, s, c, row_number() OVER (PARTITION BY g ORDER BY s, i, p, q) AS k FROM w) SELECT g, " + ", ".join(f"round(sum(s * (pow(k / c::DOUBLE, {n}) - pow((k - 1) / c::DOUBLE, {n}))), 4) AS best{n}, round(sum(s * (pow((c - k + 1) / c::DOUBLE, {n}) - pow((c - k) / c::DOUBLE, {n}))), 4) AS worst{n}" for n in (2, 4)) + " FROM o GROUP BY g")
def best_worst_of_n(spark, sf_dir):
    """The exact expectation of the best and worst of n draws with replacement, instead of resampling."""
    o = scores(spark, sf_dir).withColumn("c", F.count(F.lit(1)).over(G())).withColumn("k", F.row_number().over(G().orderBy("s", "i", "p", "q")))
    up = lambda x, n: F.pow(x / F.col("c"), F.lit(float(n)))
    k, c = F.col("k"), F.col("c")
    cols = [f(n) for n in (2, 4) for f in (lambda n: rnd(F.sum(F.col("s") * (up(k, n) - up(k - 1, n))), 4).alias(f"best{n}"), lambda n: rnd(F.sum(F.col("s") * (up(c - k + 1, n) - up(c - k, n))), 4).alias(f"worst{n}"))]
    return o.groupBy("g").agg(*cols)


@query("SELECT l_shipmode_len AS k, round(avg(m), 4) AS mean, round(avg(sd), 4) AS std, count(*) AS groups FROM (SELECT l_suppkey % 7 AS l_shipmode_len, l_orderkey, avg(l_discount) AS m, coalesce(stddev_pop(l_discount), 0) AS sd FROM lineitem GROUP BY ALL) GROUP BY ALL")
def validation_metrics(spark, sf_dir):
    """Means and deviations of groups, then their means by source."""
    l = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("k"), "l_orderkey").agg(F.avg("l_discount").alias("m"), F.stddev_pop("l_discount").alias("sd"))  # noqa: E741
    return l.groupBy("k").agg(rnd(F.avg("m"), 4).alias("mean"), rnd(F.avg("sd"), 4).alias("std"), F.count(F.lit(1)).alias("groups"))


@query("SELECT l_orderkey AS g, l_linenumber AS i, l_partkey AS p, round(sum(l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_discount DESC ROWS UNBOUNDED PRECEDING), 4) AS ret FROM lineitem")
def remax_returns(spark, sf_dir):
    """Sums from each step to the end; steps that agree in all keys are taken by their reward."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_discount")).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), rnd(F.sum("l_discount").over(w), 4).alias("ret"))


def first_return(rewards, gamma: float):
    """The discounted sum of an array of rewards: a fold from its end."""
    return F.aggregate(F.reverse(rewards), F.lit(0.0), lambda a, r: r + gamma * a)


@query("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS t, unnest(embedding)::DOUBLE AS r FROM embeddings) SELECT a.vec_id, round(sum(b.r * pow(0.9, b.t - 1)), 4) AS first_return FROM e b JOIN (SELECT DISTINCT vec_id FROM e) a USING (vec_id) GROUP BY a.vec_id")
def reinforce_pp_return(spark, sf_dir, gamma: float = 0.9):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return e.select("vec_id", rnd(first_return(F.col("x"), gamma), 4).alias("first_return"))


@query("SELECT l_orderkey AS g, l_linenumber AS i, l_partkey AS p, round(d, 6) AS k1, round(abs(d), 6) AS k_abs, round(d * d / 2, 6) AS k2, round(greatest(least(exp(-d) - 1 + d, 10), -10), 6) AS k3 FROM (SELECT *, l_discount - l_tax AS d FROM lineitem)")
def kl_penalty(spark, sf_dir):
    d = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), rnd(d, 6).alias("k1"), rnd(F.abs(d), 6).alias("k_abs"), rnd(d * d / 2, 6).alias("k2"), rnd(F.greatest(F.least(F.exp(-d) - 1 + d, F.lit(10.0)), F.lit(-10.0)), 6).alias("k3"))


@query("SELECT l_returnflag AS k, round(sum(l_tax) FILTER (l_discount > 0.02), 4) AS masked_sum, round(avg(l_tax) FILTER (l_discount > 0.02), 6) AS masked_mean, round(var_samp(l_tax) FILTER (l_discount > 0.02), 8) AS masked_var FROM lineitem GROUP BY ALL")
def masked_stats(spark, sf_dir):
    x = F.when(F.col("l_discount") > 0.02, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(rnd(F.sum(x), 4).alias("masked_sum"), rnd(F.avg(x), 6).alias("masked_mean"), rnd(F.var_samp(x), 8).alias("masked_var"))


@query("WITH m AS (SELECT l_orderkey AS g, sum(l_tax) AS s, avg(l_tax) AS a, count(*) AS n FROM lineitem GROUP BY ALL) SELECT round(sum(s) / sum(n), 6) AS token_mean, round(avg(s), 6) AS seq_mean_token_sum, round(avg(a), 6) AS seq_mean_token_mean FROM m")
def agg_loss_modes(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_tax").alias("s"), F.avg("l_tax").alias("a"), F.count(F.lit(1)).alias("n"))
    return m.agg(rnd(F.sum("s") / F.sum("n"), 6).alias("token_mean"), rnd(F.avg("s"), 6).alias("seq_mean_token_sum"), rnd(F.avg("a"), 6).alias("seq_mean_token_mean"))
