"""Queries over one series: each user's events in time order are a series, indexed from 0.

Long form (sid, pos, value, n). Everything is one window to number the points and one or two aggregations by series, so
all statistics of a series share a shuffle. Means of intervals are means of rounded means of 16 points, as the data
model wants them; extrema take the first of equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table

CHUNK = 16
#: The long form in SQL, in front of all checks.
SERIES_SQL = """WITH s AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    value, event_type, count(*) OVER (PARTITION BY user_id) AS n FROM events) """
CHUNK_SQL = SERIES_SQL + ", c AS (SELECT sid, any_value(n) AS n, pos // 16 AS k, round(avg(value), 2) AS m FROM s GROUP BY sid, pos // 16) "


def long_series(events: DataFrame, key: str = "user_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    whole = Window.partitionBy(key)
    return events.select(F.col(key).alias("sid"), (F.row_number().over(order) - 1).alias("pos"), "value", "event_type", F.count(F.lit(1)).over(whole).alias("n"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_series(table(spark, sf_dir, "events"))


def first_max(value: Column = None, pos: Column = None) -> Column:
    """Position of the largest value, the first of equals."""
    return F.max_by("pos", F.struct("value", -F.col("pos")))


def first_min() -> Column:
    return F.min_by("pos", F.struct("value", "pos"))


def part(condition: Column) -> Column:
    return F.when(condition, F.col("value"))


def chunks(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """(sid, n, k, m): rounded means of stretches of points."""
    return points.groupBy("sid", F.floor(F.col("pos") / size).alias("k")).agg(F.max("n").alias("n"), rnd(F.avg("value"), 2).alias("m"))


#: Columns need a session, so these are made when asked for.
HALF = lambda: F.floor(F.col("n") / 2)
THIRD = lambda: F.floor(F.col("n") / 3)
QUARTER = lambda: F.floor(F.col("n") / 4)
POS = lambda: F.col("pos")


def quarter() -> Column:
    """0 to 3; the last quarter takes the rest."""
    return F.when(QUARTER() == 0, 3).otherwise(F.least(F.floor(POS() / QUARTER()), F.lit(3)))


def with_moments(points: DataFrame) -> DataFrame:
    """``points`` with mean mu and deviation sd of their series. Sums are taken in the order of time, whatever tasks read the
    points, as a value that equals the mean is above or below it by the last digit of the sum."""
    w = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumn("mu", F.avg("value").over(w)).withColumn("sd", F.stddev_pop("value").over(w))


def statistics(points: DataFrame) -> DataFrame:
    """The summary of every series."""
    p = with_moments(points)
    prev = F.lag(F.signum(F.col("value") - rnd("mu", 2))).over(Window.partitionBy("sid").orderBy("pos"))
    p = p.withColumn("crossed", (prev != F.signum(F.col("value") - rnd("mu", 2))).cast("int"))
    return p.groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.max("mu"), 4).alias("mean"), rnd(F.max("sd"), 4).alias("std"), F.max("value").alias("max"), F.min("value").alias("min"),
        first_max().alias("max_pos"), first_min().alias("min_pos"), rnd(F.max("value") - F.min("value"), 4).alias("range"),
        rnd(F.expr("percentile(value, 0.5)"), 4).alias("median"), rnd(F.expr("percentile(value, 0.25)"), 4).alias("q25"), rnd(F.expr("percentile(value, 0.75)"), 4).alias("q75"),
        F.sum((F.abs(F.col("value") - F.col("mu")) > 2 * F.col("sd")).cast("int")).alias("outliers"),
        F.coalesce(F.sum("crossed"), F.lit(0)).alias("mean_crossings"), F.sum((F.col("value") > F.col("mu")).cast("int")).alias("above_mean"),
        F.sum((F.col("value") > F.col("mu") + F.col("sd")).cast("int")).alias("above_mean_std"), F.sum((F.col("value") < F.col("mu") - F.col("sd")).cast("int")).alias("below_mean_std"),
        rnd(F.avg(part(POS() < HALF())), 4).alias("first_half_mean"), rnd(F.avg(part(POS() >= HALF())), 4).alias("second_half_mean"),
        rnd(F.stddev_pop(part(POS() < HALF())), 4).alias("first_half_std"), rnd(F.stddev_pop(part(POS() >= HALF())), 4).alias("second_half_std"),
    )


@query(SERIES_SQL + """, m AS (SELECT sid, avg(value) AS mu, stddev_pop(value) AS sd FROM s GROUP BY sid),
p AS (SELECT *, CASE WHEN lag(sign(value - round(mu, 2))) OVER (PARTITION BY sid ORDER BY pos) <> sign(value - round(mu, 2)) THEN 1 ELSE 0 END AS crossed FROM s JOIN m USING (sid))
SELECT sid, count(*) AS n, round(max(mu), 4) AS mean, round(max(sd), 4) AS std, max(value) AS max, min(value) AS min, min(pos) FILTER (value = mx)::INT AS max_pos, min(pos) FILTER (value = mn)::INT AS min_pos,
 round(max(value) - min(value), 4) AS range, round(quantile_cont(value, .5), 4) AS median, round(quantile_cont(value, .25), 4) AS q25, round(quantile_cont(value, .75), 4) AS q75,
 count(*) FILTER (abs(value - mu) > 2 * sd) AS outliers, sum(crossed)::BIGINT AS mean_crossings, count(*) FILTER (value > mu) AS above_mean, count(*) FILTER (value > mu + sd) AS above_mean_std, count(*) FILTER (value < mu - sd) AS below_mean_std,
 round(avg(value) FILTER (pos < n // 2), 4) AS first_half_mean, round(avg(value) FILTER (pos >= n // 2), 4) AS second_half_mean,
 round(stddev_pop(value) FILTER (pos < n // 2), 4) AS first_half_std, round(stddev_pop(value) FILTER (pos >= n // 2), 4) AS second_half_std
FROM (SELECT *, max(value) OVER (PARTITION BY sid) AS mx, min(value) OVER (PARTITION BY sid) AS mn FROM p) GROUP BY sid""")
def series_statistics(spark, sf_dir):
    return statistics(series(spark, sf_dir))


def _chunk_query(size: int):
    def run(spark, sf_dir):
        return chunks(series(spark, sf_dir), size).groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: F.format_string("%.2f", x["m"])), ",").alias("means"))

    sql = SERIES_SQL + f"SELECT sid, string_agg(printf('%.2f', m), ',' ORDER BY k) AS means FROM (SELECT sid, pos // {size} AS k, round(avg(value), 2) AS m FROM s GROUP BY ALL) GROUP BY sid"
    query(sql, f"chunk_means_{size}")(run)


_chunk_query(16)
_chunk_query(32)


@query(CHUNK_SQL + "SELECT sid, round(avg(m), 4) AS mean FROM c GROUP BY sid")
def global_chunk_mean(spark, sf_dir):
    return chunks(series(spark, sf_dir)).groupBy("sid").agg(rnd(F.avg("m"), 4).alias("mean"))


@query(SERIES_SQL + "SELECT sid, round(avg(m), 4) AS mean FROM (SELECT sid, (pos - 10) // 16 AS k, round(avg(value), 2) AS m FROM s WHERE pos BETWEEN 10 AND 40 GROUP BY ALL) GROUP BY sid")
def interval_mean(spark, sf_dir, a: int = 10, b: int = 40):
    """Mean of the rounded chunk means of points a to b, both in; chunks start at a."""
    p = series(spark, sf_dir).where(POS().between(a, b))
    return p.groupBy("sid", F.floor((POS() - a) / CHUNK).alias("k")).agg(rnd(F.avg("value"), 2).alias("m")).groupBy("sid").agg(rnd(F.avg("m"), 4).alias("mean"))


@query(SERIES_SQL + "SELECT sid, round(stddev_pop(value), 4) AS std FROM s WHERE pos BETWEEN 10 AND 40 GROUP BY sid")
def interval_std(spark, sf_dir, a: int = 10, b: int = 40):
    return series(spark, sf_dir).where(POS().between(a, b)).groupBy("sid").agg(rnd(F.stddev_pop("value"), 4).alias("std"))


@query(SERIES_SQL + "SELECT DISTINCT sid, first_value(pos) OVER (PARTITION BY sid ORDER BY value DESC, pos)::INT AS max_pos, first_value(pos) OVER (PARTITION BY sid ORDER BY value, pos)::INT AS min_pos, max(value) OVER (PARTITION BY sid) AS max, min(value) OVER (PARTITION BY sid) AS min FROM s")
def extrema_positions(spark, sf_dir):
    return series(spark, sf_dir).groupBy("sid").agg(first_max().alias("max_pos"), first_min().alias("min_pos"), F.max("value").alias("max"), F.min("value").alias("min"))


@query(SERIES_SQL + "SELECT sid, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM s GROUP BY sid")
def percentile_k(spark, sf_dir):
    return series(spark, sf_dir).groupBy("sid").agg(*(rnd(F.expr(f"percentile(value, {p / 100})"), 4).alias(f"p{p}") for p in (10, 25, 50, 75, 90)))


def _aggregate(name: str, columns, sql: dict[str, str], having: str | None = None):
    """A query that is one aggregation by series."""

    def run(spark, sf_dir):
        out = series(spark, sf_dir).groupBy("sid").agg(*(c.alias(n) for n, c in columns().items()))
        return out.where(having) if having else out

    text = SERIES_SQL + "SELECT * FROM (SELECT sid, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + " FROM s GROUP BY sid)" + (f" WHERE {having}" if having else "")
    query(text, name)(run)


def _avg(c: Column) -> Column:
    return F.avg(part(c))


_H1 = lambda: POS() < HALF()
_H2 = lambda: POS() >= HALF()
_Q1 = lambda: POS() < QUARTER()
_Q4 = lambda: POS() >= 3 * QUARTER()
_T1 = lambda: POS() < THIRD()
_T3 = lambda: POS() >= F.col("n") - THIRD()
_std = lambda c: F.stddev_pop(part(c))
_aggregate("half_mean_diff", lambda: {"diff": rnd(F.abs(_avg(_H1()) - _avg(_H2())), 4)}, {"diff": "round(abs(avg(value) FILTER (pos < n // 2) - avg(value) FILTER (pos >= n // 2)), 4)"})
_aggregate("half_mean_compare", lambda: {"first_higher": _avg(_H1()) > _avg(_H2())}, {"first_higher": "avg(CASE WHEN pos < n // 2 THEN value END) > avg(CASE WHEN pos >= n // 2 THEN value END)"})
_aggregate("third_mean_shift", lambda: {"shifted": F.abs(_avg(_T1()) - _avg(_T3())) > 10}, {"shifted": "abs(avg(value) FILTER (pos < n // 3) - avg(value) FILTER (pos >= n - n // 3)) > 10"})
_aggregate("condition_recovery", lambda: {"recovered": F.abs(_avg(_Q1()) - _avg(_Q4())) < 10}, {"recovered": "abs(avg(value) FILTER (pos < n // 4) - avg(value) FILTER (pos >= 3 * (n // 4))) < 10"})
_aggregate("interval_comparison", lambda: {"first_higher": _avg(POS().between(0, 19)) > _avg(POS().between(20, 39))}, {"first_higher": "avg(value) FILTER (pos <= 19) > avg(value) FILTER (pos BETWEEN 20 AND 39)"})
_aggregate("range_query", lambda: {"range": rnd(F.max("value") - F.min("value"), 2)}, {"range": "round(max(value) - min(value), 2)"})
_aggregate("normalized_range", lambda: {"ratio": F.when(F.stddev_pop("value") >= 0.01, rnd((F.max("value") - F.min("value")) / F.stddev_pop("value"), 4))}, {"ratio": "CASE WHEN stddev_pop(value) >= .01 THEN round((max(value) - min(value)) / stddev_pop(value), 4) END"}, "ratio IS NOT NULL")
_aggregate("volatility_change", lambda: {"rose": rnd(_std(_H2()), 2) > rnd(_std(_H1()), 2)}, {"rose": "round(stddev_pop(value) FILTER (pos >= n // 2), 2) > round(stddev_pop(value) FILTER (pos < n // 2), 2)"})
_aggregate("max_first_half", lambda: {"yes": first_max() < F.max(HALF())}, {"yes": "arg_max(pos, struct_pack(v := value, p := -pos)) < max(n // 2)"})
_aggregate("extrema_same_half", lambda: {"yes": (first_max() < F.max(HALF())) == (first_min() < F.max(HALF()))}, {"yes": "(arg_max(pos, struct_pack(v := value, p := -pos)) < max(n // 2)) = (arg_min(pos, struct_pack(v := value, p := pos)) < max(n // 2))"})
_aggregate("max_before_min", lambda: {"yes": first_max() < first_min()}, {"yes": "arg_max(pos, struct_pack(v := value, p := -pos)) < arg_min(pos, struct_pack(v := value, p := pos))"})
_aggregate("extrema_distance", lambda: {"gap": F.abs(first_max() - first_min()).cast("bigint")}, {"gap": "abs(arg_max(pos, struct_pack(v := value, p := -pos)) - arg_min(pos, struct_pack(v := value, p := pos)))"})
_aggregate("median_mean_close", lambda: {"yes": F.abs(F.expr("percentile(value, 0.5)") - F.avg("value")) < 10}, {"yes": "abs(median(value) - avg(value)) < 10"})
_aggregate("std_exceeds_half_range", lambda: {"yes": F.stddev_pop("value") > (F.max("value") - F.min("value")) / 4}, {"yes": "stddev_pop(value) > (max(value) - min(value)) / 4"})
_aggregate("threshold_duration", lambda: {"above": F.sum((F.col("value") > 50).cast("bigint"))}, {"above": "count(*) FILTER (value > 50)"})
_aggregate("global_std", lambda: {"std": rnd(F.stddev_pop("value"), 4)}, {"std": "round(stddev_pop(value), 4)"})
_aggregate("max_value", lambda: {"max": F.max("value")}, {"max": "max(value)"})
_aggregate("min_value", lambda: {"min": F.min("value")}, {"min": "min(value)"})


@query(SERIES_SQL + """, m AS (SELECT sid, round(avg(value), 2) AS mu FROM s GROUP BY sid),
x AS (SELECT sid, pos, sign(value - mu) AS g, lag(sign(value - mu)) OVER (PARTITION BY sid ORDER BY pos) AS h FROM s JOIN m USING (sid))
SELECT sid, count(*) FILTER (g <> h) AS crossings, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (g <> h), '') AS at FROM x GROUP BY sid""")
def mean_crossings(spark, sf_dir):
    p = series(spark, sf_dir)
    p = p.join(p.groupBy("sid").agg(rnd(F.avg("value"), 2).alias("mu")), "sid").withColumn("g", F.signum(F.col("value") - F.col("mu")))
    p = p.withColumn("hit", F.lag("g").over(Window.partitionBy("sid").orderBy("pos")) != F.col("g"))
    return p.groupBy("sid").agg(F.count(F.when(F.col("hit"), 1)).alias("crossings"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit"), POS()))), ",").alias("at"))


@query(SERIES_SQL + """, z AS (SELECT *, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd FROM s WINDOW w AS (PARTITION BY sid))
SELECT sid, count(*) FILTER (abs(value - mu) > 2 * sd) AS outliers, round(count(*) FILTER (abs(value - mu) > 2 * sd) / count(*)::DOUBLE, 4) AS fraction, arg_max(pos, struct_pack(d := abs(value - mu), p := -pos))::INT AS extreme_pos FROM z GROUP BY sid""")
def outliers_2sigma(spark, sf_dir):
    w = Window.partitionBy("sid")
    z = series(spark, sf_dir).withColumn("d", F.abs(F.col("value") - F.avg("value").over(w))).withColumn("sd", F.stddev_pop("value").over(w))
    hit = F.count(F.when(F.col("d") > 2 * F.col("sd"), 1))
    return z.groupBy("sid").agg(hit.alias("outliers"), rnd(hit / F.count(F.lit(1)), 4).alias("fraction"), F.max_by("pos", F.struct("d", -POS())).alias("extreme_pos"))


@query(SERIES_SQL + """, q AS (SELECT sid, least(pos // greatest(n // 4, 1), 3) AS q, avg(value) AS m FROM s GROUP BY ALL)
SELECT sid, string_agg('Q' || (q + 1), '>' ORDER BY round(m, 4) DESC, q) AS ordering, count(DISTINCT round(m, 4)) = 4 AS strict FROM q GROUP BY sid""")
def quarter_ordering(spark, sf_dir):
    q = series(spark, sf_dir).groupBy("sid", quarter().alias("q")).agg(rnd(F.avg("value"), 4).alias("m"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "q")))
    return q.groupBy("sid").agg(F.array_join(F.transform(ranked, lambda x: F.concat(F.lit("Q"), x["q"] + 1)), ">").alias("ordering"), (F.countDistinct("m") == 4).alias("strict"))


@query(SERIES_SQL + """, q AS (SELECT sid, least(pos // greatest(n // 4, 1), 3) AS q, round(avg(value), 2) AS m, max(value) AS mx FROM s GROUP BY ALL)
SELECT sid, (arg_max(q, struct_pack(m := m, p := -q)) = arg_max(q, struct_pack(v := mx, p := -q))) AS yes FROM q GROUP BY sid""")
def max_in_highest_mean_quarter(spark, sf_dir):
    q = series(spark, sf_dir).groupBy("sid", quarter().alias("q")).agg(rnd(F.avg("value"), 2).alias("m"), F.max("value").alias("mx"))
    return q.groupBy("sid").agg((F.max_by("q", F.struct("m", -F.col("q"))) == F.max_by("q", F.struct("mx", -F.col("q")))).alias("yes"))


@query(CHUNK_SQL + ", g AS (SELECT *, avg(m) OVER (PARTITION BY sid) AS gm FROM c) SELECT sid, max(abs(m - gm)) < 25 AS stable FROM g GROUP BY sid")
def chunk_stability(spark, sf_dir):
    c = chunks(series(spark, sf_dir)).withColumn("gm", F.avg("m").over(Window.partitionBy("sid")))
    return c.groupBy("sid").agg((F.max(F.abs(F.col("m") - F.col("gm"))) < 25).alias("stable"))


@query(CHUNK_SQL + ", d AS (SELECT sid, m - lag(m) OVER (PARTITION BY sid ORDER BY k) AS d FROM c) SELECT sid, CASE WHEN bool_and(d > 0) THEN 'increasing' WHEN bool_and(d < 0) THEN 'decreasing' ELSE 'neither' END AS monotone FROM d GROUP BY sid HAVING count(d) > 0")
def chunk_monotone(spark, sf_dir):
    d = chunks(series(spark, sf_dir)).withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy("sid").orderBy("k"))).where("d is not null")
    return d.groupBy("sid").agg(F.when(F.every(F.col("d") > 0), "increasing").when(F.every(F.col("d") < 0), "decreasing").otherwise("neither").alias("monotone"))


@query(CHUNK_SQL + "SELECT sid, arg_max(k, struct_pack(m := m, k := -k)) AS chunk, max(m) AS mean FROM c GROUP BY sid")
def max_mean_chunk_pos(spark, sf_dir):
    return chunks(series(spark, sf_dir)).groupBy("sid").agg(F.max_by("k", F.struct("m", -F.col("k"))).alias("chunk"), F.max("m").alias("mean"))


@query(CHUNK_SQL + ", g AS (SELECT *, avg(m) OVER (PARTITION BY sid) AS gm FROM c) SELECT sid, round(count(*) FILTER (m > gm) / count(*)::DOUBLE, 4) AS share FROM g GROUP BY sid")
def chunk_above_proportion(spark, sf_dir):
    return above_mean_share(chunks(series(spark, sf_dir)))


def above_mean_share(means: DataFrame) -> DataFrame:
    """(sid, share) of the chunks whose mean is above that of all. Means are in hundredths, so that sums are whole numbers: exact,
    and the same in whatever order tasks bring the chunks."""
    w = Window.partitionBy("sid")
    c = means.withColumn("h", F.round(F.col("m") * 100))
    c = c.withColumn("above", F.col("h") * F.count("h").over(w) > F.sum("h").over(w))
    return c.groupBy("sid").agg(rnd(F.count_if("above") / F.count(F.lit(1)), 4).alias("share"))


@query(SERIES_SQL + ", q AS (SELECT sid, avg(value) FILTER (pos < n // 4) AS a, avg(value) FILTER (pos >= n // 4 AND pos < 3 * (n // 4)) AS b, avg(value) FILTER (pos >= 3 * (n // 4)) AS c FROM s GROUP BY sid) SELECT sid, abs(a - c) < 15 AND abs(b - (a + c) / 2) > 5 AS recovered FROM q")
def symmetric_recovery(spark, sf_dir):
    q = series(spark, sf_dir).groupBy("sid").agg(_avg(_Q1()).alias("a"), _avg((POS() >= QUARTER()) & (POS() < 3 * QUARTER())).alias("b"), _avg(_Q4()).alias("c"))
    return q.select("sid", ((F.abs(F.col("a") - F.col("c")) < 15) & (F.abs(F.col("b") - (F.col("a") + F.col("c")) / 2) > 5)).alias("recovered"))


@query("""WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, round(avg(v), 4) AS offset, round(greatest(max(abs(v - m)) / 3, 1), 4) AS scaling FROM (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS m FROM e) GROUP BY vec_id""")
def encode_offset_scale(spark, sf_dir):
    """Offset and scale that bring an array within three of its mean; JVM array functions, no shuffle."""
    e = table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    e = e.withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x"))
    return e.select("vec_id", rnd("m", 4).alias("offset"), rnd(F.greatest(F.array_max(F.transform("x", lambda v: F.abs(v - F.col("m")))) / 3, F.lit(1.0)), 4).alias("scaling"))
