"""Queries that are kept for evaluation: two or more simple queries put together.

All build on the segments and points of a series, joined on the series with a range condition. Series that a query does
not fit (too few segments, types or events) are left out, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, rnd
from .generators import MADE_SQL, _made, points
from .segments import SEGMENT_SQL, in_segment, local_events, segment, segment_means, segments
from .series import CHUNK, HALF, POS, SERIES_SQL, part, series

MEANS_SQL = SEGMENT_SQL + ", m AS (SELECT g.sid, seg, any_value(type) AS type, any_value(start) AS start, any_value(stop) AS stop, any_value(dur) AS dur, round(avg(value), 2) AS m FROM g JOIN s ON s.sid = g.sid AND s.pos BETWEEN start AND stop GROUP BY g.sid, seg) "
#: Segments of made series in SQL; their points are called s as well.
MADE_SEGMENT_SQL = MADE_SQL + ", s AS (SELECT sid, pos, value, n, '' AS event_type FROM v) " + SEGMENT_SQL[len(SERIES_SQL) :]
one = lambda: F.count(F.lit(1))
by = lambda: Window.partitionBy("sid")


@query(SEGMENT_SQL + ", x AS (SELECT g.sid, type, count(*) AS c, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, round(max(value) - min(value), 2) AS range FROM g JOIN s ON s.sid = g.sid AND pos BETWEEN start AND stop GROUP BY ALL), y AS (SELECT *, count(*) OVER (PARTITION BY sid) AS types FROM x) SELECT sid, type, mean, std, range FROM y WHERE types >= 2 AND c >= 4")
def conditional_stat(spark, sf_dir):
    """Mean, deviation and range of the points of each type; series of one type and types of under 4 points are left out."""
    p = series(spark, sf_dir)
    x = in_segment(p, segment(p)).groupBy("sid", "type").agg(one().alias("c"), rnd(F.avg("value"), 2).alias("mean"), rnd(F.stddev_pop("value"), 2).alias("std"), rnd(F.max("value") - F.min("value"), 2).alias("range"))
    return x.withColumn("types", one().over(by())).where("types >= 2 AND c >= 4").drop("types", "c")


@query(SEGMENT_SQL + """, q AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dur DESC, seg) AS l, row_number() OVER (PARTITION BY sid ORDER BY dur, seg) AS sh, count(*) OVER (PARTITION BY sid) AS c FROM g),
e AS (SELECT *, count(*) OVER (PARTITION BY sid) AS events FROM ev)
SELECT q.sid, max(value) FILTER (l = 1) AS max_in_longest, min(value) FILTER (sh = 1) AS min_in_shortest FROM q JOIN e ON e.sid = q.sid AND pos BETWEEN start AND stop WHERE c >= 2 AND events >= 2 AND (l = 1 OR sh = 1) GROUP BY q.sid""")
def nested_extrema(spark, sf_dir):
    """The largest event of the longest segment, the smallest of the shortest, the first of equals; null without one."""
    g = segments(spark, sf_dir).withColumn("l", F.row_number().over(by().orderBy(F.desc("dur"), "seg"))).withColumn("sh", F.row_number().over(by().orderBy("dur", "seg")))
    g = g.withColumn("c", one().over(by())).where("c >= 2 AND (l = 1 OR sh = 1)")
    e = local_events(spark, sf_dir).withColumn("events", one().over(by())).where("events >= 2")
    hit = e.join(g, "sid").where("pos BETWEEN start AND stop")
    return hit.groupBy("sid").agg(F.max(F.when(F.col("l") == 1, F.col("value"))).alias("max_in_longest"), F.min(F.when(F.col("sh") == 1, F.col("value"))).alias("min_in_shortest"))


@query(SEGMENT_SQL + """, t AS (SELECT g.sid, type, any_value(d) AS d, count(ev.pos) AS c FROM g JOIN (SELECT sid, type, sum(dur) AS d FROM g GROUP BY ALL) USING (sid, type) LEFT JOIN ev ON ev.sid = g.sid AND ev.pos BETWEEN start AND stop GROUP BY g.sid, type),
z AS (SELECT sid, type, round(c / d, 6) AS x, sum((c > 0)::INT) OVER (PARTITION BY sid) AS busy, sum(c) OVER (PARTITION BY sid) AS events FROM t WHERE d > 0),
h AS (SELECT *, max(x) OVER (PARTITION BY sid) AS hi, min(x) OVER (PARTITION BY sid) AS lo FROM z WHERE busy >= 2 AND events >= 3)
SELECT sid, CASE WHEN count(*) FILTER (x = hi) > 1 THEN 'equal' ELSE min(type) FILTER (x = hi) END AS highest, CASE WHEN count(*) FILTER (x = lo) > 1 THEN 'equal' ELSE min(type) FILTER (x = lo) END AS lowest FROM h GROUP BY sid""")
def event_density_extremes(spark, sf_dir):
    """Types with most and fewest events to a point, ``equal`` for ties; three events in two types are needed."""
    g = segments(spark, sf_dir)
    n = in_segment(local_events(spark, sf_dir), g).groupBy("sid", "type").agg(one().alias("c"))
    t = g.groupBy("sid", "type").agg(F.sum("dur").alias("d")).where("d > 0").join(n, ["sid", "type"], "left").fillna(0, ["c"])
    z = t.withColumn("x", rnd(F.col("c") / F.col("d"), 6)).withColumn("busy", F.sum((F.col("c") > 0).cast("int")).over(by())).withColumn("events", F.sum("c").over(by())).where("busy >= 2 AND events >= 3")
    z = z.withColumn("hi", F.max("x").over(by())).withColumn("lo", F.min("x").over(by()))

    def named(end: str):
        at = F.col("x") == F.col(end)
        return F.when(F.count_if(at) > 1, "equal").otherwise(F.min(F.when(at, F.col("type"))))

    return z.groupBy("sid").agg(named("hi").alias("highest"), named("lo").alias("lowest"))


@query(MEANS_SQL + "SELECT m.sid, type, count(*) FILTER (m > mu) AS above, count(*) FILTER (m < mu) AS below FROM m JOIN (SELECT sid, round(avg(value), 2) AS mu FROM s GROUP BY sid) USING (sid) GROUP BY m.sid, type HAVING count(*) >= 2")
def conditional_count(spark, sf_dir):
    """Segments of a type whose mean is above or below the series' mean; types of one segment are left out."""
    mu = series(spark, sf_dir).groupBy("sid").agg(rnd(F.avg("value"), 2).alias("mu"))
    m = segment_means(spark, sf_dir).join(mu, "sid")
    return m.groupBy("sid", "type").agg(F.count_if(F.col("m") > F.col("mu")).alias("above"), F.count_if(F.col("m") < F.col("mu")).alias("below"), one().alias("c")).where("c >= 2").drop("c")


@query(MEANS_SQL + """, w AS (SELECT *, round(abs(lead(m) OVER (PARTITION BY sid ORDER BY seg) - m), 4) AS shift, count(*) OVER (PARTITION BY sid) AS c FROM m),
x AS (SELECT *, arg_max(seg, struct_pack(a := coalesce(shift, -1), b := -seg)) OVER (PARTITION BY sid) AS cut FROM w WHERE c >= 3),
y AS (SELECT sid, seg <= cut AS early, type, sum(dur) AS d, min(seg) AS f FROM x GROUP BY ALL),
z AS (SELECT sid, early, type FROM y QUALIFY row_number() OVER (PARTITION BY sid, early ORDER BY d DESC, f) = 1)
SELECT sid, min(type) <> max(type) AS reversed FROM z GROUP BY sid""")
def trend_reversal(spark, sf_dir):
    """Whether the type that fills most before the largest shift of means is another one after it; 3 segments at least."""
    shift = rnd(F.abs(F.lead("m").over(by().orderBy("seg")) - F.col("m")), 4)
    m = segment_means(spark, sf_dir).withColumn("shift", F.coalesce(shift, F.lit(-1.0))).withColumn("c", one().over(by())).where("c >= 3")
    m = m.withColumn("cut", F.max_by("seg", F.struct("shift", -F.col("seg"))).over(by()))
    m = m.join(segments(spark, sf_dir).select("sid", "seg", "dur"), ["sid", "seg"])
    d = m.groupBy("sid", (F.col("seg") <= F.col("cut")).alias("early"), "type").agg(F.sum("dur").alias("d"), F.min("seg").alias("f"))
    top = d.groupBy("sid", "early").agg(F.max_by("type", F.struct("d", -F.col("f"))).alias("type"))
    return top.groupBy("sid").agg((F.min("type") != F.max("type")).alias("reversed"))


@query(MEANS_SQL + "SELECT sid, arg_min(m, seg) > arg_max(m, seg) AS first_higher FROM m GROUP BY sid HAVING count(*) >= 2 AND round(abs(arg_min(m, seg) - arg_max(m, seg)), 2) >= 0.1")
def segment_stat_compare(spark, sf_dir):
    """Whether the first segment's mean is above the last's; a difference under 0.1 is left out."""
    m = segment_means(spark, sf_dir).groupBy("sid").agg(F.min_by("m", "seg").alias("a"), F.max_by("m", "seg").alias("b"), one().alias("c"))
    return m.where("c >= 2").where(rnd(F.abs(F.col("a") - F.col("b")), 2) >= 0.1).select("sid", (F.col("a") > F.col("b")).alias("first_higher"))


def interval_means(p: DataFrame, segs: DataFrame) -> DataFrame:
    """(sid, seg, type, m): the mean of rounded means of 16 points, counted from each segment's start."""
    hit = p.select("sid", "pos", "value").join(segs, "sid").where("pos BETWEEN start AND stop")
    c = hit.groupBy("sid", "seg", "type", F.floor((POS() - F.col("start")) / CHUNK).alias("k")).agg(rnd(F.avg("value"), 2).alias("m"))
    return c.groupBy("sid", "seg", "type").agg(rnd(F.avg("m"), 2).alias("m"))


@query(SEGMENT_SQL + """, c AS (SELECT g.sid, seg, type, (pos - start) // 16 AS k, round(avg(value), 2) AS m FROM g JOIN s ON s.sid = g.sid AND pos BETWEEN start AND stop GROUP BY ALL), m AS (SELECT sid, seg, type, round(avg(m), 2) AS m FROM c GROUP BY ALL),
mu AS (SELECT sid, round(avg(m), 2) AS mu FROM (SELECT sid, pos // 16 AS k, round(avg(value), 2) AS m FROM s GROUP BY ALL) GROUP BY sid)
SELECT sid, bool_and(CASE type WHEN 'increase' THEN m > mu WHEN 'decrease' THEN m < mu ELSE true END) AS follows FROM m JOIN mu USING (sid) GROUP BY sid HAVING count(*) >= 2""")
def trend_follows_mean(spark, sf_dir):
    """Whether rising segments lie above the series' mean and falling ones below; steady ones don't matter."""
    p = series(spark, sf_dir)
    mu = p.groupBy("sid", F.floor(POS() / CHUNK).alias("k")).agg(rnd(F.avg("value"), 2).alias("m")).groupBy("sid").agg(rnd(F.avg("m"), 2).alias("mu"))
    ok = F.when(F.col("type") == "increase", F.col("m") > F.col("mu")).when(F.col("type") == "decrease", F.col("m") < F.col("mu")).otherwise(True)
    return interval_means(p, segment(p)).join(mu, "sid").groupBy("sid").agg(F.every(ok).alias("follows"), one().alias("c")).where("c >= 2").drop("c")


@query(SEGMENT_SQL + ", l AS (SELECT sid, type FROM g QUALIFY row_number() OVER (PARTITION BY sid ORDER BY dur DESC, seg DESC) = 1 AND count(*) OVER (PARTITION BY sid) >= 2) SELECT g.sid, l.type AS type, round(sum(dur) FILTER (g.type = l.type) / sum(dur), 2) AS share FROM g JOIN l USING (sid) GROUP BY g.sid, l.type HAVING sum(dur) > 0")
def longest_type_fraction(spark, sf_dir):
    """The share of the whole that the type of the longest segment, the last of equals, fills."""
    g = segments(spark, sf_dir)
    top = g.groupBy("sid").agg(F.max_by("type", F.struct("dur", "seg")).alias("top"), F.sum("dur").alias("total"), one().alias("c")).where("c >= 2 AND total > 0")
    d = g.groupBy("sid", F.col("type").alias("top")).agg(F.sum("dur").alias("d"))
    return top.join(d, ["sid", "top"]).select("sid", F.col("top").alias("type"), rnd(F.col("d") / F.col("total"), 2).alias("share"))


@query(SEGMENT_SQL + ", l AS (SELECT sid, start, stop FROM g QUALIFY row_number() OVER (PARTITION BY sid ORDER BY dur DESC, seg) = 1), x AS (SELECT sid, pos FROM ev QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(value) DESC, pos) = 1) SELECT sid, pos BETWEEN start AND stop AS yes FROM x JOIN l USING (sid)")
def max_amp_in_longest_segment(spark, sf_dir):
    """Whether the strongest event lies in the longest segment; the first of equals for both."""
    l = segments(spark, sf_dir).groupBy("sid").agg(F.max_by(F.struct("start", "stop"), F.struct("dur", -F.col("seg"))).alias("l"))  # noqa: E741
    x = local_events(spark, sf_dir).groupBy("sid").agg(F.max_by("pos", F.struct(F.abs("value"), -POS())).alias("pos"))
    return x.join(l, "sid").select("sid", POS().between(F.col("l.start"), F.col("l.stop")).alias("yes"))


@query(MADE_SQL + """, c AS (SELECT sid, n, pos < n // 2 AS early, CASE WHEN pos < n // 2 THEN pos ELSE pos - n // 2 END // 16 AS k, round(avg(value), 2) AS m FROM v WHERE n >= 32 GROUP BY ALL),
h AS (SELECT sid, early, round(avg(m), 2) AS m FROM c GROUP BY ALL) SELECT sid, round(max(m) - min(m), 2) AS diff, round(max(m) - min(m), 2) > any_value(amplitude) AS over FROM h JOIN u USING (sid) GROUP BY sid""")
def cycle_mean_trend(spark, sf_dir):
    """Whether the halves' means are further apart than the season's amplitude; series of 32 points or more."""
    p = points(_made(spark, sf_dir).where("n >= 32"), keep=("n", "amplitude"))
    early = POS() < HALF()
    c = p.groupBy("sid", "amplitude", early.alias("early"), F.floor(F.when(early, POS()).otherwise(POS() - HALF()) / CHUNK).alias("k")).agg(rnd(F.avg("value"), 2).alias("m"))
    h = c.groupBy("sid", "amplitude", "early").agg(rnd(F.avg("m"), 2).alias("m"))
    diff = rnd(F.max("m") - F.min("m"), 2)
    return h.groupBy("sid", "amplitude").agg(diff.alias("diff")).select("sid", "diff", (F.col("diff") > F.col("amplitude")).alias("over"))


@query(MADE_SEGMENT_SQL + ", l AS (SELECT sid, start, stop FROM g WHERE true QUALIFY row_number() OVER (PARTITION BY sid ORDER BY dur DESC, seg DESC) = 1 AND count(*) OVER (PARTITION BY sid) >= 2 AND dur >= 4), sd AS (SELECT l.sid, round(stddev_pop(value), 2) AS sd FROM l JOIN s ON s.sid = l.sid AND pos BETWEEN start AND stop GROUP BY l.sid) SELECT sid, sd AS std, " + ", ".join(f"amplitude > round({m} * sd, 2) AS over{m}" for m in (1, 2, 3)) + " FROM sd JOIN u USING (sid)")
def amplitude_vs_segment_std(spark, sf_dir):
    """Whether the season's amplitude is above 1, 2 or 3 deviations of the longest segment, the last of equals."""
    made = _made(spark, sf_dir)
    p = points(made)
    l = segment(p).groupBy("sid").agg(F.max_by(F.struct("start", "stop", "dur"), F.struct("dur", "seg")).alias("l"), one().alias("c")).where("c >= 2 AND l.dur >= 4")  # noqa: E741
    sd = p.join(l, "sid").where("pos BETWEEN l.start AND l.stop").groupBy("sid").agg(rnd(F.stddev_pop("value"), 2).alias("std"))
    return sd.join(made, "sid").select("sid", "std", *((F.col("amplitude") > rnd(m * F.col("std"), 2)).alias(f"over{m}") for m in (1, 2, 3)))


@query(MADE_SQL + "SELECT sid, period > 0 AS periodic, round(period, 1)::DOUBLE AS period, round(n / period::DOUBLE, 1) AS cycles, amplitude > round(sd, 2) AS over_std, amplitude > round(r, 2) / 4 AS over_quarter_range FROM u JOIN (SELECT sid, stddev_pop(value) AS sd, max(value) - min(value) AS r FROM v GROUP BY sid) USING (sid)")
def periodicity(spark, sf_dir):
    """Period, number of cycles, and the season's amplitude against the deviation and range of the points."""
    made = _made(spark, sf_dir)
    t = points(made).groupBy("sid").agg(rnd(F.stddev_pop("value"), 2).alias("sd"), rnd(F.max("value") - F.min("value"), 2).alias("r"))
    return made.join(t, "sid").select("sid", (F.col("period") > 0).alias("periodic"), rnd(F.col("period").cast("double"), 1).alias("period"), rnd(F.col("n") / F.col("period"), 1).alias("cycles"), (F.col("amplitude") > F.col("sd")).alias("over_std"), (F.col("amplitude") > F.col("r") / 4).alias("over_quarter_range"))


@query(MADE_SQL + "SELECT sid, amplitude > round(sd, 2) AS over_std, round(amplitude / r, 4) AS share, amplitude > round(r, 2) / 4 AS over_quarter_range FROM u JOIN (SELECT sid, stddev_pop(value) AS sd, max(value) - min(value) AS r FROM v GROUP BY sid) USING (sid) WHERE r > 0")
def amplitude_vs_range(spark, sf_dir):
    """The season's amplitude against the deviation of all points and a quarter of their range; flat series are left out."""
    made = _made(spark, sf_dir)
    t = points(made).groupBy("sid").agg(F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("r")).where("r > 0")
    a = F.col("amplitude")
    return made.join(t, "sid").select("sid", (a > rnd("sd", 2)).alias("over_std"), rnd(a / F.col("r"), 4).alias("share"), (a > rnd("r", 2) / 4).alias("over_quarter_range"))
