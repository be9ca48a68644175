"""The best and the worst of m draws with replacement, as resampling would estimate them, in closed form.

Of n sorted values the k-th is the best of m draws with probability (k / n)^m - ((k - 1) / n)^m. Mean and deviation over
infinitely many resamples are sums over one window of the group: nothing is drawn and no row is multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, rnd
from .groupstats import SCORE_SQL, scores


def best_and_worst(rows: DataFrame, key: str, value: str, draws: int) -> DataFrame:
    """(key, draws, best_mean, best_std, worst_mean, worst_std); null values are left out."""
    w = Window.partitionBy(key)
    k, n = F.row_number().over(w.orderBy(value)), F.count(F.lit(1)).over(w)
    r = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"), k.alias("k"), n.alias("n"))
    best = F.pow(F.col("k") / F.col("n"), draws) - F.pow((F.col("k") - 1) / F.col("n"), draws)
    worst = F.pow((F.col("n") - F.col("k") + 1) / F.col("n"), draws) - F.pow((F.col("n") - F.col("k")) / F.col("n"), draws)
    v = F.col("v")
    s = r.groupBy(key).agg(*(F.sum(x).alias(a) for x, a in ((v * best, "b1"), (v * v * best, "b2"), (v * worst, "w1"), (v * v * worst, "w2"))))
    std = lambda one, two: rnd(F.sqrt(F.greatest(F.lit(0.0), F.col(two) - F.col(one) * F.col(one))), 4)
    return s.select(key, F.lit(draws).alias("draws"), rnd("b1", 4).alias("best_mean"), std("b1", "b2").alias("best_std"), rnd("w1", 4).alias("worst_mean"), std("w1", "w2").alias("worst_std"))


def _of(draws: int):
    sql = SCORE_SQL + f""", r AS (SELECT g, s AS v, row_number() OVER (PARTITION BY g ORDER BY s) AS k, count(*) OVER (PARTITION BY g) AS n FROM s WHERE s IS NOT NULL),
    x AS (SELECT g, v, pow(k / n, {draws}) - pow((k - 1) / n, {draws}) AS b, pow((n - k + 1) / n, {draws}) - pow((n - k) / n, {draws}) AS w FROM r),
    y AS (SELECT g, sum(v * b) AS b1, sum(v * v * b) AS b2, sum(v * w) AS w1, sum(v * v * w) AS w2 FROM x GROUP BY g)
    SELECT g, {draws} AS draws, round(b1, 4) AS best_mean, round(sqrt(greatest(0, b2 - b1 * b1)), 4) AS best_std, round(w1, 4) AS worst_mean, round(sqrt(greatest(0, w2 - w1 * w1)), 4) AS worst_std FROM y"""

    def run(spark, sf_dir):
        return best_and_worst(scores(spark, sf_dir).select("g", "s"), "g", "s", draws)

    query(sql, f"bootstrap_best_worst_{draws}")(run)


_of(2)
_of(8)
