"""Trend segments of series, and events in them.

A series is cut into steps of ``STEP`` points; a step rises or falls if its rounded mean differs from the one before by
more than 5 % of the series' range, else it keeps steady. Equal steps in a row are one segment [start, end] of points.
Events are points of type "error". Joins of events with segments are equi-joins on the series with a range condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, rnd
from .series import SERIES_SQL, series

STEP = 8
SEGMENT_SQL = SERIES_SQL + """, k AS (SELECT sid, any_value(n) AS n, pos // 8 AS k, round(avg(value), 2) AS m, min(pos) AS a, max(pos) AS b FROM s GROUP BY sid, pos // 8),
r AS (SELECT sid, (max(value) - min(value)) * 0.05 AS t FROM s GROUP BY sid),
d AS (SELECT k.*, m - lag(m) OVER (PARTITION BY sid ORDER BY k) AS d FROM k),
ty AS (SELECT sid, n, k, a, b, CASE WHEN d > t THEN 'increase' WHEN d < -t THEN 'decrease' ELSE 'keep steady' END AS type FROM d JOIN r USING (sid) WHERE d IS NOT NULL),
ch AS (SELECT *, CASE WHEN type IS DISTINCT FROM lag(type) OVER (PARTITION BY sid ORDER BY k) THEN 1 ELSE 0 END AS c FROM ty),
gr AS (SELECT *, sum(c) OVER (PARTITION BY sid ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS seg FROM ch),
g AS (SELECT sid, seg::INT AS seg, any_value(type) AS type, min(a)::INT AS start, max(b)::INT AS stop, (max(b) - min(a))::INT AS dur FROM gr GROUP BY sid, seg),
ev AS (SELECT sid, pos::INT AS pos, value FROM s WHERE event_type = 'error') """


def segment(points: DataFrame) -> DataFrame:
    """(sid, seg, type, start, stop, dur) by gaps and islands; all windows share the partitioning by series."""
    by = Window.partitionBy("sid").orderBy("k")
    steps = points.groupBy("sid", F.floor(F.col("pos") / STEP).alias("k")).agg(rnd(F.avg("value"), 2).alias("m"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    whole = Window.partitionBy("sid")
    t = (F.max("hi").over(whole) - F.min("lo").over(whole)) * 0.05
    typed = steps.withColumn("t", t).withColumn("d", F.col("m") - F.lag("m").over(by)).where("d is not null")
    typed = typed.withColumn("type", F.when(F.col("d") > F.col("t"), "increase").when(F.col("d") < -F.col("t"), "decrease").otherwise("keep steady"))
    runs = typed.withColumn("c", F.when(F.lag("type").over(by).eqNullSafe(F.col("type")), 0).otherwise(1))
    runs = runs.withColumn("seg", (F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return runs.groupBy("sid", "seg").agg(F.first("type").alias("type"), F.min("a").alias("start"), F.max("b").alias("stop"), (F.max("b") - F.min("a")).alias("dur"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(series(spark, sf_dir))


def local_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).where("event_type = 'error'").select("sid", "pos", "value")


def in_segment(events: DataFrame, segs: DataFrame) -> DataFrame:
    """Events with the segment that holds them, both ends in; a point on a border belongs to the first."""
    e, g = events.alias("e"), segs.alias("g")
    hit = e.join(g, (F.col("e.sid") == F.col("g.sid")) & F.col("e.pos").between(F.col("g.start"), F.col("g.stop")))
    return hit.select(F.col("e.sid").alias("sid"), "e.pos", "e.value", "g.seg", "g.type")


@query(SEGMENT_SQL + "SELECT * FROM g")
def trend_segments(spark, sf_dir):
    return segments(spark, sf_dir)


@query(SEGMENT_SQL + "SELECT sid, type, count(*) AS n, sum(dur)::BIGINT AS duration FROM g GROUP BY sid, type")
def segment_count_by_type(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("sid", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("duration"))


@query(SEGMENT_SQL + "SELECT sid, count(*) AS n FROM g GROUP BY sid")
def segment_count(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query(SEGMENT_SQL + "SELECT sid, seg, type, dur FROM g QUALIFY row_number() OVER (PARTITION BY sid ORDER BY dur DESC, seg DESC) = 1")
def longest_segment(spark, sf_dir):
    """The longest; of equals the last."""
    g = segments(spark, sf_dir).groupBy("sid").agg(F.max_by(F.struct("seg", "type", "dur"), F.struct("dur", "seg")).alias("b"))
    return g.select("sid", "b.seg", "b.type", "b.dur")


@query(SEGMENT_SQL + "SELECT sid, seg FROM g QUALIFY rank() OVER (PARTITION BY sid ORDER BY dur) = 1")
def shortest_segments(spark, sf_dir):
    """All of the shortest."""
    g = segments(spark, sf_dir).withColumn("r", F.rank().over(Window.partitionBy("sid").orderBy("dur")))
    return g.where("r = 1").select("sid", "seg")


@query(SEGMENT_SQL + "SELECT sid, type FROM (SELECT sid, type, count(*) AS c, min(seg) AS f FROM g GROUP BY sid, type) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY c DESC, f) = 1")
def dominant_type(spark, sf_dir):
    """The most frequent type; of equals the one seen first."""
    c = segments(spark, sf_dir).groupBy("sid", "type").agg(F.count(F.lit(1)).alias("c"), F.min("seg").alias("f"))
    return c.groupBy("sid").agg(F.max_by("type", F.struct("c", -F.col("f"))).alias("type"))


@query(SEGMENT_SQL + "SELECT sid, type, round(sum(dur) / nullif(sum(sum(dur)) OVER (PARTITION BY sid), 0)::DOUBLE, 4) AS share FROM g GROUP BY sid, type")
def duration_fraction(spark, sf_dir):
    d = segments(spark, sf_dir).groupBy("sid", "type").agg(F.sum("dur").alias("d"))
    total = F.sum("d").over(Window.partitionBy("sid"))
    return d.select("sid", "type", rnd(F.col("d") / F.nullif(total, F.lit(0)), 4).alias("share"))


@query(SEGMENT_SQL + "SELECT sid, p || '>' || type AS pair, count(*) AS n FROM (SELECT *, lag(type) OVER (PARTITION BY sid ORDER BY seg) AS p FROM g) WHERE p IS NOT NULL GROUP BY ALL")
def transitions(spark, sf_dir):
    g = segments(spark, sf_dir).withColumn("p", F.lag("type").over(Window.partitionBy("sid").orderBy("seg"))).where("p is not null")
    return g.groupBy("sid", F.concat_ws(">", "p", "type").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query(SEGMENT_SQL + "SELECT sid, list(type ORDER BY seg) = list(type ORDER BY seg DESC) AS palindrome, string_agg(type, ';' ORDER BY seg) AS types FROM g GROUP BY sid")
def symmetric_trend_sequence(spark, sf_dir):
    g = segments(spark, sf_dir).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "type"))), lambda x: x["type"]).alias("t"))
    return g.select("sid", (F.reverse("t") == F.col("t")).alias("palindrome"), F.array_join("t", ";").alias("types"))


@query(SEGMENT_SQL + ", m AS (SELECT g.sid, seg, type, round(avg(value), 2) AS m FROM g JOIN s ON s.sid = g.sid AND s.pos BETWEEN start AND stop GROUP BY ALL) SELECT sid, seg, m > lead(m) OVER (PARTITION BY sid ORDER BY seg) AS higher FROM m QUALIFY lead(m) OVER (PARTITION BY sid ORDER BY seg) IS NOT NULL")
def segment_mean_compare(spark, sf_dir):
    m = segment_means(spark, sf_dir)
    nxt = F.lead("m").over(Window.partitionBy("sid").orderBy("seg"))
    return m.select("sid", "seg", (F.col("m") > nxt).alias("higher")).where("higher is not null")


def segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series(spark, sf_dir)
    return in_segment(p, segment(p)).groupBy("sid", "seg", "type").agg(rnd(F.avg("value"), 2).alias("m"), F.count(F.lit(1)).alias("points"))


@query(SEGMENT_SQL + ", m AS (SELECT g.sid, seg, round(avg(value), 2) AS m FROM g JOIN s ON s.sid = g.sid AND s.pos BETWEEN start AND stop GROUP BY ALL), dd AS (SELECT sid, seg, round(abs(m - lag(m) OVER (PARTITION BY sid ORDER BY seg)), 4) AS shift FROM m) SELECT sid, count(*) AS changes, max(shift) AS largest, arg_max(seg, struct_pack(a := shift, b := -seg)) AS at FROM dd WHERE shift IS NOT NULL GROUP BY sid")
def change_points(spark, sf_dir):
    shift = rnd(F.abs(F.col("m") - F.lag("m").over(Window.partitionBy("sid").orderBy("seg"))), 4)
    d = segment_means(spark, sf_dir).withColumn("shift", shift).where("shift is not null")
    return d.groupBy("sid").agg(F.count(F.lit(1)).alias("changes"), F.max("shift").alias("largest"), F.max_by("seg", F.struct("shift", -F.col("seg"))).alias("at"))


@query(SEGMENT_SQL + ", m AS (SELECT g.sid, seg, type, round(avg(value), 2) AS m FROM g JOIN s ON s.sid = g.sid AND s.pos BETWEEN start AND stop GROUP BY ALL) SELECT sid, type, round(avg(m), 4) AS mean FROM m GROUP BY sid, type")
def conditional_mean_by_type(spark, sf_dir):
    return segment_means(spark, sf_dir).groupBy("sid", "type").agg(rnd(F.avg("m"), 4).alias("mean"))


@query(SEGMENT_SQL + ", m AS (SELECT g.sid, seg, any_value(greatest(1, stop - start + 1)) AS w, round(avg(value), 2) AS m FROM g JOIN s ON s.sid = g.sid AND s.pos BETWEEN start AND stop GROUP BY g.sid, seg) SELECT sid, round(sum(m * w) / sum(w), 4) AS mean FROM m GROUP BY sid")
def duration_weighted_mean(spark, sf_dir):
    return segment_means(spark, sf_dir).groupBy("sid").agg(rnd(F.sum(F.col("m") * F.col("points")) / F.sum("points"), 4).alias("mean"))


@query(SEGMENT_SQL + ", x AS (SELECT sid, arg_max(pos, struct_pack(v := value, p := -pos)) AS p FROM s GROUP BY sid), l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY sid ORDER BY dur DESC, seg) = 1) SELECT sid, p BETWEEN start AND stop AS yes FROM x JOIN l USING (sid)")
def peak_in_longest_segment(spark, sf_dir):
    """Of segments equally long the first counts here."""
    p = series(spark, sf_dir)
    peak = p.groupBy("sid").agg(F.max_by("pos", F.struct("value", -F.col("pos"))).alias("p"))
    longest = segment(p).groupBy("sid").agg(F.max_by(F.struct("start", "stop"), F.struct("dur", -F.col("seg"))).alias("l"))
    return peak.join(longest, "sid").select("sid", F.col("p").between(F.col("l.start"), F.col("l.stop")).alias("yes"))


@query(SEGMENT_SQL + ", x AS (SELECT sid, arg_max(pos, struct_pack(v := value, p := -pos)) AS p FROM s GROUP BY sid) SELECT sid, type FROM x JOIN g USING (sid) WHERE p BETWEEN start AND stop")
def max_in_trend_type(spark, sf_dir):
    p = series(spark, sf_dir)
    peak = p.groupBy("sid").agg(F.max_by("pos", F.struct("value", -F.col("pos"))).alias("pos"), F.max("value").alias("value"))
    return in_segment(peak, segment(p)).select("sid", "type")


@query(SEGMENT_SQL + "SELECT sid, type FROM g WHERE 24 BETWEEN start AND stop")
def segment_type_at_pos(spark, sf_dir, pos: int = 24):
    return segments(spark, sf_dir).where(F.lit(pos).between(F.col("start"), F.col("stop"))).select("sid", "type")


@query(SEGMENT_SQL + ", o AS (SELECT sid, type, sum(greatest(0, least(40, stop) - greatest(10, start))) AS o FROM g GROUP BY sid, type), rr AS (SELECT *, rank() OVER (PARTITION BY sid ORDER BY o DESC) AS k FROM o) SELECT sid, CASE WHEN count(*) > 1 THEN 'equal' ELSE min(type) END AS dominant FROM rr WHERE k = 1 GROUP BY sid")
def trend_dominance(spark, sf_dir, a: int = 10, b: int = 40):
    """The type that fills most of [a, b]."""
    over = F.greatest(F.lit(0), F.least(F.lit(b), F.col("stop")) - F.greatest(F.lit(a), F.col("start")))
    o = segments(spark, sf_dir).groupBy("sid", "type").agg(F.sum(over).alias("o"))
    o = o.withColumn("k", F.rank().over(Window.partitionBy("sid").orderBy(F.desc("o")))).where("k = 1")
    return o.groupBy("sid").agg(F.when(F.count(F.lit(1)) > 1, "equal").otherwise(F.min("type")).alias("dominant"))


@query(SEGMENT_SQL + "SELECT g.sid, g.seg, any_value(type) AS type, count(ev.pos) AS events FROM g LEFT JOIN ev ON ev.sid = g.sid AND ev.pos BETWEEN start AND stop GROUP BY g.sid, g.seg")
def events_per_segment(spark, sf_dir):
    g, e = segments(spark, sf_dir).alias("g"), local_events(spark, sf_dir).alias("e")
    j = g.join(e, (F.col("g.sid") == F.col("e.sid")) & F.col("e.pos").between(F.col("g.start"), F.col("g.stop")), "left")
    return j.groupBy(F.col("g.sid").alias("sid"), "g.seg").agg(F.first("g.type").alias("type"), F.count("e.pos").alias("events"))


@query(SEGMENT_SQL + "SELECT g.sid, type, round(100.0 * count(ev.pos) / any_value(d), 4) AS density FROM g JOIN (SELECT sid, type, greatest(1, sum(dur)) AS d FROM g GROUP BY ALL) t USING (sid, type) LEFT JOIN ev ON ev.sid = g.sid AND ev.pos BETWEEN start AND stop GROUP BY g.sid, type")
def event_density_by_trend(spark, sf_dir):
    """Events to 100 points of each type."""
    g = segments(spark, sf_dir)
    n = in_segment(local_events(spark, sf_dir), g).groupBy("sid", "type").agg(F.count(F.lit(1)).alias("c"))
    d = g.groupBy("sid", "type").agg(F.greatest(F.lit(1), F.sum("dur")).alias("d"))
    return d.join(n, ["sid", "type"], "left").select("sid", "type", rnd(100.0 * F.coalesce("c", F.lit(0)) / F.col("d"), 4).alias("density"))


@query(SEGMENT_SQL + "SELECT sid, bool_or(type = 'increase') AS yes FROM ev JOIN g USING (sid) WHERE pos BETWEEN start AND stop GROUP BY sid")
def event_in_trend_type(spark, sf_dir):
    return in_segment(local_events(spark, sf_dir), segments(spark, sf_dir)).groupBy("sid").agg(F.some(F.col("type") == "increase").alias("yes"))


@query(SEGMENT_SQL + ", dd AS (SELECT sid, pos, lead(pos) OVER (PARTITION BY sid ORDER BY pos) - pos AS gap FROM ev) SELECT sid, min(pos) AS first, max(pos) AS last, max(gap) AS largest_gap, min(gap) AS smallest_gap FROM dd GROUP BY sid")
def event_gaps(spark, sf_dir):
    d = local_events(spark, sf_dir).withColumn("gap", F.lead("pos").over(Window.partitionBy("sid").orderBy("pos")) - F.col("pos"))
    return d.groupBy("sid").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("gap").alias("largest_gap"), F.min("gap").alias("smallest_gap"))


@query(SERIES_SQL + "SELECT sid, event_type, count(*) AS n, max(abs(value)) AS amplitude FROM s GROUP BY sid, event_type")
def event_count_by_type(spark, sf_dir):
    return series(spark, sf_dir).groupBy("sid", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("amplitude"))


@query(SERIES_SQL + "SELECT sid, event_type FROM s QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(value) DESC, pos) = 1")
def max_amplitude_event(spark, sf_dir):
    return series(spark, sf_dir).groupBy("sid").agg(F.max_by("event_type", F.struct(F.abs("value"), -F.col("pos"))).alias("event_type"))


@query(SEGMENT_SQL + ", x AS (SELECT sid, arg_max(pos, struct_pack(v := value, p := -pos)) AS p FROM s GROUP BY sid) SELECT sid, min(abs(pos - p))::INT AS distance, min(abs(pos - p)) <= 3 AS near FROM ev JOIN x USING (sid) GROUP BY sid")
def event_near_extremum(spark, sf_dir):
    p = series(spark, sf_dir)
    peak = p.groupBy("sid").agg(F.max_by("pos", F.struct("value", -F.col("pos"))).alias("p"))
    d = local_events(spark, sf_dir).join(peak, "sid").groupBy("sid").agg(F.min(F.abs(F.col("pos") - F.col("p"))).alias("distance"))
    return d.withColumn("near", F.col("distance") <= 3)


@query(SEGMENT_SQL + "SELECT sid, pos AS nearest, abs(pos - 20) <= 3 AS near FROM ev QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(pos - 20), pos) = 1")
def event_at_position(spark, sf_dir, target: int = 20):
    """The event nearest to a position, and whether it is within three points."""
    e = local_events(spark, sf_dir).groupBy("sid").agg(F.min_by("pos", F.struct(F.abs(F.col("pos") - target), "pos")).alias("nearest"))
    return e.withColumn("near", F.abs(F.col("nearest") - target) <= 3)


@query(SEGMENT_SQL + ", t AS (SELECT sid, stddev_pop(value) AS sd, max(value) - min(value) AS r FROM s GROUP BY sid) SELECT sid, max(abs(value)) > 2 * any_value(sd) AS over_std, max(abs(value)) > any_value(r) / 2 AS over_half_range FROM ev JOIN t USING (sid) GROUP BY sid")
def event_amplitude_vs_std(spark, sf_dir):
    t = series(spark, sf_dir).groupBy("sid").agg(F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("r"))
    return local_events(spark, sf_dir).join(t, "sid").groupBy("sid").agg((F.max(F.abs("value")) > 2 * F.first("sd")).alias("over_std"), (F.max(F.abs("value")) > F.first("r") / 2).alias("over_half_range"))
