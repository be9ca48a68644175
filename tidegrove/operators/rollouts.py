"""Steps of sampled answers: returns from the end, weights against another policy, masks, and what a batch looks like.

An order is an answer, its lines the steps: discount is the reward of a step, tax the value told for it, quantity / 50 the
score. Array forms take one row a step sequence; long forms are windows over it. Logarithms of ratios are clamped before
the exponential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table

LOG_CLAMP = 20.0
STEP_SQL = """WITH st AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_quantity) AS t, l_discount AS r, l_tax AS v, l_quantity / 50 AS s, l_partkey % 11 AS token, l_discount - l_tax AS lr FROM lineitem) """


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, t, r, v, s, token, lr): steps from 1; lr is the logarithm of a ratio of probabilities."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity")
    li = table(spark, sf_dir, "lineitem").withColumn("t", F.row_number().over(order).cast("bigint"))
    return li.select(F.col("l_orderkey").alias("g"), "t", F.col("l_discount").alias("r"), F.col("l_tax").alias("v"), (F.col("l_quantity") / 50).alias("s"), (F.col("l_partkey") % 11).alias("token"), (F.col("l_discount") - F.col("l_tax")).alias("lr"))


def sequences(rows: DataFrame, *columns: str) -> DataFrame:
    """One row a sequence: each column's values in the order of steps."""
    got = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("t", *columns))).alias("x"))  # the steps of one answer
    return got.select("g", *(F.col(f"x.{c}").alias(c) for c in columns))


def advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages of an array of steps, by a fold from the end: delta + gamma lam times the next one's."""
    step = lambda a, x: (x["r"] + gamma * a["next"] - x["v"]) + gamma * lam * a["adv"]
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("adv"), F.array().cast("array<double>").alias("out"))
    done = F.aggregate(F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"))), start, lambda a, x: F.struct(x["v"].alias("next"), step(a, x).alias("adv"), F.array_append(a["out"], step(a, x)).alias("out")))
    return F.reverse(done["out"])


@query(STEP_SQL + ", d AS (SELECT *, r + 0.99 * coalesce(lead(v) OVER (PARTITION BY g ORDER BY t), 0) - v AS d FROM st) SELECT a.g, a.t, round(sum(b.d * pow(0.99 * 0.95, b.t - a.t)), 6) AS adv, round(sum(b.d * pow(0.99 * 0.95, b.t - a.t)) + any_value(a.v), 6) AS ret FROM d a JOIN d b ON a.g = b.g AND b.t >= a.t GROUP BY a.g, a.t")
def gae(spark, sf_dir, gamma: float = 0.99, lam: float = 0.95):
    s = sequences(steps(spark, sf_dir), "r", "v")
    a = s.select("g", "v", advantages(F.col("r"), F.col("v"), gamma, lam).alias("adv")).select("g", F.posexplode(F.arrays_zip("v", "adv")).alias("i", "x"))
    return a.select("g", (F.col("i") + 1).cast("bigint").alias("t"), rnd(F.col("x.adv"), 6).alias("adv"), rnd(F.col("x.adv") + F.col("x.v"), 6).alias("ret"))


@query(STEP_SQL + "SELECT g, t, round(s - 0.05 * lr, 6) AS reward FROM st")
def reward_with_kl(spark, sf_dir, beta: float = 0.05):
    """A score less its share of the divergence."""
    return steps(spark, sf_dir).select("g", "t", rnd(F.col("s") - beta * F.col("lr"), 6).alias("reward"))


@query(STEP_SQL + ", m AS (SELECT avg(s) AS mu, var_samp(s) AS va FROM st WHERE t <= 4) SELECT g, t, round((s - mu) / sqrt(va + 1e-8), 4) AS white, round((s - mu) / sqrt(va + 1e-8) + mu, 4) AS shifted FROM st, m WHERE t <= 4")
def masked_whiten(spark, sf_dir, most: int = 4):
    """Scores under the mask to mean 0 and variance 1; shifted: with their mean again."""
    d = steps(spark, sf_dir).where(F.col("t") <= most)
    m = d.agg(F.avg("s").alias("mu"), F.var_samp("s").alias("va"))
    w = (F.col("s") - F.col("mu")) / F.sqrt(F.col("va") + 1e-8)
    return d.join(F.broadcast(m)).select("g", "t", rnd(w, 4).alias("white"), rnd(w + F.col("mu"), 4).alias("shifted"))  # one row


def until_end(tokens: Column, end: Column) -> Column:
    """1 up to the first end token, itself too; all 1 without one."""
    at = F.array_position(tokens, end)
    return F.transform(tokens, lambda x, i: ((at == 0) | (i < at)).cast("int"))


@query(STEP_SQL + ", e AS (SELECT g, min(t) FILTER (token = 0) AS e FROM st GROUP BY g) SELECT g, sum(CASE WHEN e IS NULL OR t <= e THEN 1 ELSE 0 END)::BIGINT AS kept, count(*) AS n FROM st JOIN e USING (g) GROUP BY g")
def response_mask(spark, sf_dir, end: int = 0):
    m = sequences(steps(spark, sf_dir), "token").select("g", until_end(F.col("token"), F.lit(end).cast("bigint")).alias("m"))
    return m.select("g", F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("kept"), F.size("m").cast("bigint").alias("n"))


def ratio(log_ratio: Column) -> Column:
    return F.exp(F.greatest(F.lit(-LOG_CLAMP), F.least(F.lit(LOG_CLAMP), log_ratio)))


@query(STEP_SQL + ", w AS (SELECT g, t, least(exp(lr), 1.02) AS token, least(exp(sum(lr) OVER (PARTITION BY g)), 1.02) AS seq FROM st), m AS (SELECT avg(token) AS mt FROM w) SELECT g, t, round(token, 6) AS token_weight, round(seq, 6) AS sequence_weight, round(token / mt, 6) AS normalised FROM w, m")
def importance_weights(spark, sf_dir, most: float = 1.02):
    """Ratios cut off above, by step or by the whole sequence; normalised: with mean 1 over the batch."""
    w = steps(spark, sf_dir).select("g", "t", F.least(ratio(F.col("lr")), F.lit(most)).alias("token"), F.least(ratio(F.sum("lr").over(Window.partitionBy("g"))), F.lit(most)).alias("seq"))
    return w.join(F.broadcast(w.agg(F.avg("token").alias("mean")))).select("g", "t", rnd("token", 6).alias("token_weight"), rnd("seq", 6).alias("sequence_weight"), rnd(F.col("token") / F.col("mean"), 6).alias("normalised"))  # one row


@query(STEP_SQL + ", w AS (SELECT g, t, exp(lr) BETWEEN 0.95 AND 1.08 AS ok, exp(sum(lr) OVER (PARTITION BY g)) BETWEEN 0.8 AND 1.25 AS whole, min(exp(lr)) OVER (PARTITION BY g) < 0.93 AS veto FROM st) SELECT g, t, ok AS token_kept, whole AS sequence_kept, ok AND whole AND NOT veto AS kept FROM w")
def rejection_mask(spark, sf_dir, token: tuple = (0.95, 1.08), sequence: tuple = (0.8, 1.25), veto: float = 0.93):
    """Steps, and whole sequences, whose ratios are out of bounds are not trained on; one ratio under ``veto`` drops all."""
    g = Window.partitionBy("g")
    x = steps(spark, sf_dir).select("g", "t", ratio(F.col("lr")).alias("x"), ratio(F.sum("lr").over(g)).alias("whole")).withColumn("least", F.min("x").over(g))
    ok, whole = F.col("x").between(*token), F.col("whole").between(*sequence)
    return x.select("g", "t", ok.alias("token_kept"), whole.alias("sequence_kept"), (ok & whole & (F.col("least") >= veto)).alias("kept"))


@query(STEP_SQL + ", q AS (SELECT g, sum(lr) AS w, avg(lr) AS m, avg(-v) AS lp FROM st GROUP BY g) SELECT round((SELECT avg(-lr) FROM st), 8) AS kl, round((SELECT avg(exp(lr) - 1 - lr) FROM st), 8) AS k3, round((SELECT avg(exp(-lp)) FROM q), 6) AS perplexity, round((SELECT avg(exp(2 * w)) FROM q) - 1, 6) AS chi2, round((SELECT pow(sum(exp(lr)), 2) / sum(pow(exp(lr), 2)) / count(*) FROM st), 6) AS sample_size")
def offpolicy_metrics(spark, sf_dir):
    """How far the sampling policy is away: divergences by step, perplexity and chi square by sequence, effective sample size."""
    d = steps(spark, sf_dir)
    r = ratio(F.col("lr"))
    t = d.agg(rnd(F.avg(-F.col("lr")), 8).alias("kl"), rnd(F.avg(r - 1 - F.col("lr")), 8).alias("k3"), rnd(F.pow(F.sum(r), F.lit(2.0)) / F.sum(r * r) / F.count(F.lit(1)), 6).alias("sample_size"))
    q = d.groupBy("g").agg(F.sum("lr").alias("w"), F.avg(-F.col("v")).alias("lp"))
    s = q.agg(rnd(F.avg(F.exp(-F.col("lp"))), 6).alias("perplexity"), rnd(F.avg(ratio(2 * F.col("w"))) - 1, 6).alias("chi2"))
    return t.join(F.broadcast(s))  # a row each


@query(STEP_SQL + ", q AS (SELECT g, round(abs(avg(s) - 0.5), 6) AS d FROM st GROUP BY g), w AS (SELECT g, pow(d, 2) AS power, CASE WHEN d = (SELECT max(d) FROM q) OR d = (SELECT min(d) FROM q) THEN 1.0 ELSE 0.0 END AS ends FROM q) SELECT g, round(power / (SELECT sum(power) FROM w), 8) AS power, round(ends / (SELECT sum(ends) FROM w), 8) AS ends FROM w")
def pf_weights(spark, sf_dir, power: float = 2.0):
    """Preference weights of answers by the distance of their score from even: a power of it, or its extremes alone. Distances are
    rounded, so that equal extremes are equal in whatever order they were summed."""
    return preferences(spark, sf_dir, power).select("g", rnd("power", 8).alias("power"), rnd("ends", 8).alias("ends"))


def preferences(spark, sf_dir, power: float = 2.0) -> DataFrame:
    """The weights of ``pf_weights`` in full: among millions of answers each is so small that eight digits don't hold it."""
    q = steps(spark, sf_dir).groupBy("g").agg(rnd(F.abs(F.avg("s") - 0.5), 6).alias("d"))
    b = q.agg(F.max("d").alias("hi"), F.min("d").alias("lo"))
    w = q.join(F.broadcast(b)).select("g", F.pow("d", F.lit(power)).alias("power"), ((F.col("d") == F.col("hi")) | (F.col("d") == F.col("lo"))).cast("double").alias("ends"))  # one row
    total = w.agg(F.sum("power").alias("p"), F.sum("ends").alias("e"))
    return w.join(F.broadcast(total)).select("g", (F.col("power") / F.col("p")).alias("power"), (F.col("ends") / F.col("e")).alias("ends"))  # one row


def resampled(weighted: DataFrame, key: str, weight: str, seed: int = 42) -> DataFrame:
    """(key, drawn): as many draws as rows, by weight, systematically: draw i falls at (i + u) / n of the summed weights, so a
    row is drawn floor(n w) or one more times. Sums are taken within stretches of the key and moved up by those before; a row
    begins where the one before it ends, to the last digit, so that no draw is lost or made twice."""
    from .algebra import STRETCHES

    stretch = F.pmod(F.xxhash64(key), F.lit(STRETCHES))
    rows = weighted.withColumn("_b", stretch)
    sizes = rows.groupBy("_b").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_b")  # STRETCHES rows at most
    upto, every = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("_b", F.sum("_w").over(upto).alias("_end"), F.sum("_n").over(every).alias("_all"), F.sum("_w").over(every).alias("_total"))
    sizes = sizes.withColumn("_before", F.coalesce(F.lag("_end").over(order), F.lit(0.0)))
    own = Window.partitionBy("_b").orderBy(key)
    rows = rows.withColumn("_own", F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_last", F.lead(F.lit(1)).over(own).isNull())
    end = F.when(F.col("_last"), F.col("_end")).otherwise(F.least(F.col("_before") + F.col("_own"), F.col("_end")))
    rows = rows.join(F.broadcast(sizes), "_b").withColumn("_to", F.ceil(end * F.col("_all") / F.col("_total") - (seed % 97) / 97.0))  # draws that fall before its end
    first = F.ceil(F.col("_before") * F.col("_all") / F.col("_total") - (seed % 97) / 97.0)
    return rows.select(key, (F.col("_to") - F.coalesce(F.lag("_to").over(own), first)).cast("bigint").alias("drawn"))


@query("SELECT count(*) AS rows, count(*) AS drawn, true AS fair FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def pf_resample(spark, sf_dir):
    """A batch drawn again by preference: as many rows, each about as often as its weight says."""
    w = preferences(spark, sf_dir)
    d = resampled(w, "g", "power").join(w, "g")
    n = w.count()
    return d.agg(F.count(F.lit(1)).alias("rows"), F.sum("drawn").alias("drawn"), F.every(F.abs(F.col("drawn") - n * F.col("power")) < 1.01).alias("fair"))


@query(STEP_SQL + ", q AS (SELECT g, avg(s) AS score, sum(r) AS reward, count(*) AS len FROM st GROUP BY g) SELECT round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(avg(reward), 6) AS reward_mean, round(avg(len), 6) AS length_mean, max(len) AS length_max, min(len) AS length_min, round(avg((len >= 7)::INT), 6) AS clip_ratio, round(avg((len <= 1)::INT), 6) AS aborted_ratio FROM q")
def data_metrics(spark, sf_dir, clip: int = 7):
    """Scores, rewards and lengths of a batch's answers, how many were cut off, how many came to nothing."""
    q = steps(spark, sf_dir).groupBy("g").agg(F.avg("s").alias("score"), F.sum("r").alias("reward"), F.count(F.lit(1)).alias("len"))
    n = F.col("len")
    return q.agg(rnd(F.avg("score"), 6).alias("score_mean"), rnd(F.max("score"), 6).alias("score_max"), rnd(F.min("score"), 6).alias("score_min"), rnd(F.avg("reward"), 6).alias("reward_mean"), rnd(F.avg(n), 6).alias("length_mean"), F.max(n).alias("length_max"), F.min(n).alias("length_min"), rnd(F.avg((n >= clip).cast("int")), 6).alias("clip_ratio"), rnd(F.avg((n <= 1).cast("int")), 6).alias("aborted_ratio"))


@query("SELECT event_type AS section, round(sum(value), 4) AS seconds, count(*) AS tokens, round(sum(value) * 1000 / count(*), 4) AS ms_a_token FROM events GROUP BY event_type")
def timing_per_token(spark, sf_dir):
    """Seconds of each section, and milliseconds for each of its tokens."""
    n, s = F.count(F.lit(1)), F.sum("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("section")).agg(rnd(s, 4).alias("seconds"), n.alias("tokens"), rnd(s * 1000 / n, 4).alias("ms_a_token"))


@query("SELECT user_id % 4 AS step, count(*) AS tokens, round(sum(value), 4) AS seconds, round(count(*) / (sum(value) * 8), 6) AS tokens_a_second FROM events GROUP BY ALL")
def throughput(spark, sf_dir, devices: int = 8):
    """Tokens a second and device of each step."""
    n, s = F.count(F.lit(1)), F.sum("value")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("step")).agg(n.alias("tokens"), rnd(s, 4).alias("seconds"), rnd(n / (s * devices), 6).alias("tokens_a_second"))


def padded_rows(rows: DataFrame, values: str, batch: str, fill: Column, least: int = 0) -> DataFrame:
    """``rows`` with lists of one length in each batch: the longest list's, ``least`` at least; filled at the end. The longest
    is found by a maximum that Spark combines before its shuffle, so lists don't travel for it."""
    size = rows.groupBy(batch).agg(F.greatest(F.max(F.size(values)), F.lit(least)).alias("_size"))
    return rows.join(size, batch).withColumn(values, F.concat(values, F.array_repeat(fill, F.col("_size") - F.size(values)))).drop("_size")


@query(STEP_SQL + ", a AS (SELECT g, list(token ORDER BY t) AS x FROM st GROUP BY g), m AS (SELECT g // 16 AS batch, greatest(3, max(len(x))) AS size FROM a GROUP BY 1) SELECT g, batch, len(x) AS n, array_to_string(list_concat(x, list_transform(range(size - len(x)), lambda i: -1)), ' ') AS tokens FROM a JOIN m ON g // 16 = batch")
def pad_2d(spark, sf_dir, size: int = 16, least: int = 3):
    """Tokens of the answers of a batch as lists of one length."""
    a = sequences(steps(spark, sf_dir), "token").withColumn("batch", F.expr(f"g div {size}")).withColumn("n", F.size("token").cast("bigint"))
    p = padded_rows(a, "token", "batch", F.lit(-1).cast("bigint"), least)
    return p.select("g", "batch", "n", F.array_join("token", " ").alias("tokens"))
