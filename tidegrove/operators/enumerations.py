"""Lists and judgments over one series: what is longest, strongest, commonest, with all winners of a tie.

Winners are rows of rank 1 in a window over the series, so a tie needs no second pass. Runs of one event type are found
by gaps and islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, rnd
from .held_out import MEANS_SQL, by, one
from .segments import SEGMENT_SQL, in_segment, local_events, segment, segment_means, segments
from .series import CHUNK_SQL, HALF, POS, SERIES_SQL, chunks, part, series

#: Runs of points of one event type in SQL: (sid, event_type, start, stop, top), all points of a run next to each other.
RUN_SQL = SERIES_SQL + """, i AS (SELECT *, pos - row_number() OVER (PARTITION BY sid, event_type ORDER BY pos) AS isle FROM s),
run AS (SELECT sid, event_type, min(pos)::INT AS start, max(pos)::INT AS stop, max(abs(value)) AS top FROM i GROUP BY sid, event_type, isle) """


def runs(points: DataFrame) -> DataFrame:
    isle = POS() - F.row_number().over(Window.partitionBy("sid", "event_type").orderBy("pos"))
    return points.withColumn("isle", isle).groupBy("sid", "event_type", "isle").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.max(F.abs("value")).alias("top")).drop("isle")


def listed(values: Column, ordered_by: str) -> Column:
    """Values joined by commas in the order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordered_by).alias("o"), values.alias("v")))), lambda x: x["v"]), ", ")


def winners(rows: DataFrame, measure: Column, *keys: str) -> DataFrame:
    """The rows with the largest measure of each group, all of a tie."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(measure.desc()))).where("_r = 1").drop("_r")


@query(SEGMENT_SQL + "SELECT sid, string_agg(type || ' ' || start || '-' || stop, ', ' ORDER BY seg) AS segments FROM g GROUP BY sid")
def trend_enumeration(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("sid").agg(listed(F.concat("type", F.lit(" "), "start", F.lit("-"), "stop"), "seg").alias("segments"))


@query(SEGMENT_SQL + "SELECT sid, string_agg(pos || ': ' || printf('%.2f', value), ', ' ORDER BY pos) AS events FROM ev GROUP BY sid")
def event_enumeration(spark, sf_dir):
    return local_events(spark, sf_dir).groupBy("sid").agg(listed(F.concat("pos", F.lit(": "), F.format_string("%.2f", "value")), "pos").alias("events"))


@query(RUN_SQL + "SELECT sid, event_type, start, stop, 'widest' AS what FROM run QUALIFY rank() OVER (PARTITION BY sid ORDER BY stop - start DESC) = 1 UNION ALL SELECT sid, event_type, start, stop, 'narrowest' FROM run QUALIFY rank() OVER (PARTITION BY sid ORDER BY stop - start) = 1")
def span_winners(spark, sf_dir):
    """The widest and narrowest runs of one event type, all of a tie."""
    r = runs(series(spark, sf_dir))
    span = F.col("stop") - F.col("start")
    return winners(r, span, "sid").withColumn("what", F.lit("widest")).unionByName(winners(r, -span, "sid").withColumn("what", F.lit("narrowest"))).select("sid", "event_type", "start", "stop", "what")


@query(RUN_SQL + "SELECT sid, event_type, top, what FROM (SELECT *, 'highest' AS what FROM run QUALIFY rank() OVER (PARTITION BY sid ORDER BY top DESC) = 1 UNION ALL SELECT *, 'lowest' FROM run QUALIFY rank() OVER (PARTITION BY sid ORDER BY top) = 1)")
def amplitude_winners(spark, sf_dir):
    """The runs with the highest and lowest amplitude, all of a tie."""
    r = runs(series(spark, sf_dir))
    return winners(r, F.col("top"), "sid").withColumn("what", F.lit("highest")).unionByName(winners(r, -F.col("top"), "sid").withColumn("what", F.lit("lowest"))).select("sid", "event_type", "top", "what")


@query(RUN_SQL + "SELECT sid, event_type, count(*) AS n, count(*) FILTER (top > 50) AS strong, count(*) FILTER (top > 50 AND stop > start) AS strong_and_wide FROM run GROUP BY sid, event_type")
def run_counts(spark, sf_dir, amplitude: float = 50):
    """Runs by type, by amplitude, and by both."""
    strong = F.col("top") > amplitude
    return runs(series(spark, sf_dir)).groupBy("sid", "event_type").agg(one().alias("n"), F.count_if(strong).alias("strong"), F.count_if(strong & (F.col("stop") > F.col("start"))).alias("strong_and_wide"))


@query(SEGMENT_SQL + "SELECT sid, string_agg(seg::VARCHAR, ', ' ORDER BY seg) AS longest, max(dur) AS dur FROM (SELECT * FROM g QUALIFY rank() OVER (PARTITION BY sid ORDER BY dur DESC) = 1) GROUP BY sid")
def longest_segments(spark, sf_dir):
    return winners(segments(spark, sf_dir), F.col("dur"), "sid").groupBy("sid").agg(listed(F.col("seg").cast("string"), "seg").alias("longest"), F.max("dur").cast("int").alias("dur"))


@query(SEGMENT_SQL + ", t AS (SELECT sid, p || '>' || type AS pair, count(*) AS n FROM (SELECT *, lag(type) OVER (PARTITION BY sid ORDER BY seg) AS p FROM g) WHERE p IS NOT NULL GROUP BY ALL) SELECT sid, string_agg(pair, ', ' ORDER BY pair) AS commonest, max(n) AS n FROM (SELECT * FROM t QUALIFY rank() OVER (PARTITION BY sid ORDER BY n DESC) = 1) GROUP BY sid")
def most_common_transition(spark, sf_dir):
    g = segments(spark, sf_dir).withColumn("p", F.lag("type").over(by().orderBy("seg"))).where("p is not null")
    t = g.groupBy("sid", F.concat_ws(">", "p", "type").alias("pair")).agg(one().alias("n"))
    return winners(t, F.col("n"), "sid").groupBy("sid").agg(listed(F.col("pair"), "pair").alias("commonest"), F.max("n").alias("n"))


@query(SEGMENT_SQL + """, c AS (SELECT g.sid, g.seg, any_value(type) AS type, count(ev.pos) AS n FROM g LEFT JOIN ev ON ev.sid = g.sid AND ev.pos BETWEEN start AND stop GROUP BY g.sid, g.seg), t AS (SELECT sid, type, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
a AS (SELECT sid, string_agg(seg::VARCHAR, ', ' ORDER BY seg) AS segs FROM (SELECT * FROM c QUALIFY rank() OVER (PARTITION BY sid ORDER BY n DESC) = 1) GROUP BY sid), b AS (SELECT sid, string_agg(type, ', ' ORDER BY type) AS types, max(n) AS events FROM (SELECT * FROM t QUALIFY rank() OVER (PARTITION BY sid ORDER BY n DESC) = 1) GROUP BY sid) SELECT sid, segs, types, events FROM a JOIN b USING (sid)""")
def most_events(spark, sf_dir):
    """Segments and types with most events; those without count as zero."""
    g = segments(spark, sf_dir)
    n = in_segment(local_events(spark, sf_dir), g).groupBy("sid", "seg").agg(one().alias("n"))
    c = g.join(n, ["sid", "seg"], "left").fillna(0, ["n"])
    a = winners(c, F.col("n"), "sid").groupBy("sid").agg(listed(F.col("seg").cast("string"), "seg").alias("segs"))
    b = winners(c.groupBy("sid", "type").agg(F.sum("n").alias("n")), F.col("n"), "sid").groupBy("sid").agg(listed(F.col("type"), "type").alias("types"), F.max("n").alias("events"))
    return a.join(b, "sid")


@query(SEGMENT_SQL + """, t AS (SELECT sid, type, sum(dur)::BIGINT AS d FROM g GROUP BY ALL), z AS (SELECT *, max(d) OVER (PARTITION BY sid) AS hi, min(d) OVER (PARTITION BY sid) AS lo FROM t),
x AS (SELECT sid, string_agg(type, ', ' ORDER BY type) FILTER (d = hi) AS longest, string_agg(type, ', ' ORDER BY type) FILTER (d = lo) AS shortest, max(CASE WHEN type = 'increase' THEN d END) AS up, max(CASE WHEN type = 'decrease' THEN d END) AS down FROM z GROUP BY sid)
SELECT sid, longest, shortest, CASE WHEN up > down THEN 'increase' WHEN down > up THEN 'decrease' WHEN up = down THEN 'equal' END AS longer, abs(up - down) AS difference FROM x""")
def duration_proportion(spark, sf_dir):
    """Types that last longest and shortest, and rises against falls; null where one of these is not there."""
    t = segments(spark, sf_dir).groupBy("sid", "type").agg(F.sum("dur").alias("d")).withColumn("hi", F.max("d").over(by())).withColumn("lo", F.min("d").over(by()))
    named = lambda end: F.array_join(F.array_sort(F.collect_list(F.when(F.col("d") == F.col(end), F.col("type")))), ", ")
    of = lambda kind: F.max(F.when(F.col("type") == kind, F.col("d")))
    x = t.groupBy("sid").agg(named("hi").alias("longest"), named("lo").alias("shortest"), of("increase").alias("up"), of("decrease").alias("down"))
    longer = F.when(F.col("up") > F.col("down"), "increase").when(F.col("down") > F.col("up"), "decrease").when(F.col("up") == F.col("down"), "equal")
    return x.select("sid", "longest", "shortest", longer.alias("longer"), F.abs(F.col("up") - F.col("down")).alias("difference"))


@query(SEGMENT_SQL + "SELECT sid, coalesce(string_agg(start::VARCHAR, ', ' ORDER BY seg) FILTER (seg > 0), '') AS at, count(*) - 1 AS changes FROM g GROUP BY sid")
def change_point_positions(spark, sf_dir):
    """Where segments after the first start."""
    g = segments(spark, sf_dir).groupBy("sid").agg(F.array_sort(F.collect_list(F.when(F.col("seg") > 0, F.col("start")))).alias("at"), (one() - 1).alias("changes"))
    return g.select("sid", F.array_join("at", ", ").alias("at"), "changes")


@query(SEGMENT_SQL + ", dd AS (SELECT sid, pos, lead(pos) OVER (PARTITION BY sid ORDER BY pos) AS nxt FROM (SELECT DISTINCT sid, pos FROM ev)) SELECT sid, min(pos) AS first, max(pos) AS last, arg_max(pos || '-' || nxt, struct_pack(a := nxt - pos, b := -pos)) AS largest, arg_min(pos || '-' || nxt, struct_pack(a := nxt - pos, b := pos)) AS smallest FROM dd GROUP BY sid HAVING count(nxt) > 0")
def temporal_position(spark, sf_dir):
    """The first and last event, and between which events the largest and smallest gap is; the first of equals."""
    d = local_events(spark, sf_dir).select("sid", "pos").distinct().withColumn("nxt", F.lead("pos").over(by().orderBy("pos")))
    gap, pair = F.col("nxt") - POS(), F.concat_ws("-", "pos", "nxt")
    some = F.col("nxt").isNotNull()
    return d.groupBy("sid").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max_by(F.when(some, pair), F.when(some, F.struct(gap, -POS()))).alias("largest"), F.min_by(F.when(some, pair), F.when(some, F.struct(gap, POS()))).alias("smallest"), F.count("nxt").alias("c")).where("c > 0").drop("c")


@query(SERIES_SQL + """, t AS (SELECT sid, any_value(n) AS n, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, round(min(value), 2) AS lo, round(max(value), 2) AS hi, round(max(value) - min(value), 2) AS r,
 round(avg(value) FILTER (pos < n // 2), 2) AS m1, round(avg(value) FILTER (pos >= n // 2), 2) AS m2, round(stddev_pop(value) FILTER (pos < n // 2), 2) AS s1, round(stddev_pop(value) FILTER (pos >= n // 2), 2) AS s2, round(max(abs(value)) FILTER (event_type = 'error'), 2) AS amp FROM s GROUP BY sid)
SELECT sid, lo < 5 AS min_below, hi > 100 AS max_above, coalesce(amp > round(2 * std, 2), false) AS amplitude_over_std, r > round(4 * std, 2) AS range_over_std, s1 > 0 AND s2 >= round(1.2 * s1, 2) AS half_volatility, r > 0 AND round(abs(m2 - m1), 2) > round(0.05 * r, 2) AS half_mean_shift FROM t""")
def statistic_judgments(spark, sf_dir):
    """Yes or no for thresholds on extrema, amplitude, range, the halves' deviations and means."""
    p = series(spark, sf_dir)
    h1, h2 = POS() < HALF(), POS() >= HALF()
    t = p.groupBy("sid").agg(
        rnd(F.stddev_pop("value"), 2).alias("std"), rnd(F.min("value"), 2).alias("lo"), rnd(F.max("value"), 2).alias("hi"), rnd(F.max("value") - F.min("value"), 2).alias("r"),
        rnd(F.avg(part(h1)), 2).alias("m1"), rnd(F.avg(part(h2)), 2).alias("m2"), rnd(F.stddev_pop(part(h1)), 2).alias("s1"), rnd(F.stddev_pop(part(h2)), 2).alias("s2"), rnd(F.max(F.abs(part(F.col("event_type") == "error"))), 2).alias("amp"),
    )
    c = F.col
    return t.select("sid", (c("lo") < 5).alias("min_below"), (c("hi") > 100).alias("max_above"), F.coalesce(c("amp") > rnd(2 * c("std"), 2), F.lit(False)).alias("amplitude_over_std"), (c("r") > rnd(4 * c("std"), 2)).alias("range_over_std"),
                    ((c("s1") > 0) & (c("s2") >= rnd(1.2 * c("s1"), 2))).alias("half_volatility"), ((c("r") > 0) & (rnd(F.abs(c("m2") - c("m1")), 2) > rnd(0.05 * c("r"), 2))).alias("half_mean_shift"))


@query(SEGMENT_SQL + """, w AS (SELECT sid, string_agg(type, '>' ORDER BY seg) FILTER (seg < 3) AS phases, count(*) AS c FROM g GROUP BY sid),
e AS (SELECT g.sid, bool_or(type = 'increase' AND round(value, 2) > 50) AS hit FROM ev JOIN g ON ev.sid = g.sid AND pos BETWEEN start AND stop GROUP BY g.sid)
SELECT sid, c >= 3 AND phases = 'keep steady>increase>decrease' AS multi_phase, coalesce(hit, false) AS trend_local FROM w LEFT JOIN e USING (sid)""")
def phase_judgments(spark, sf_dir, phases: tuple[str, ...] = ("keep steady", "increase", "decrease"), trend: str = "increase", amplitude: float = 50):
    """Whether a series starts with these phases, and whether a strong event lies in a segment of the type."""
    g = segments(spark, sf_dir)
    w = g.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "type"))), lambda x: x["type"]).alias("t"))
    e = in_segment(local_events(spark, sf_dir), g).groupBy("sid").agg(F.some((F.col("type") == trend) & (rnd("value", 2) > amplitude)).alias("hit"))
    first = (F.size("t") >= len(phases)) & (F.slice("t", 1, len(phases)) == F.array(*map(F.lit, phases)))
    return w.join(e, "sid", "left").select("sid", first.alias("multi_phase"), F.coalesce("hit", F.lit(False)).alias("trend_local"))


@query(SERIES_SQL + "SELECT a.sid, count(*) > 0 AS yes, min(b.pos - a.pos)::INT AS gap FROM s a JOIN s b ON a.sid = b.sid AND a.event_type = 'error' AND b.event_type = 'click' AND b.pos > a.pos AND b.pos - a.pos <= 6 GROUP BY a.sid")
def sequential_events(spark, sf_dir, a: str = "error", b: str = "click", gap: int = 6):
    """Series in which b follows a within the gap, and the least distance: one window in place of a range join, as the
    next b after each a is the nearest."""
    nxt = F.min(F.when(F.col("event_type") == b, POS())).over(by().orderBy("pos").rowsBetween(1, gap))
    d = series(spark, sf_dir).withColumn("nxt", nxt).where((F.col("event_type") == a) & F.col("nxt").isNotNull())
    return d.groupBy("sid").agg(F.lit(True).alias("yes"), F.min(F.col("nxt") - POS()).alias("gap"))


@query(SEGMENT_SQL + "SELECT sid, bool_or(abs(pos - 20) <= 5) AS yes FROM ev GROUP BY sid")
def event_within(spark, sf_dir, point: int = 20, threshold: int = 5):
    return local_events(spark, sf_dir).groupBy("sid").agg(F.some(F.abs(POS() - point) <= threshold).alias("yes"))


@query(CHUNK_SQL + ", f AS (SELECT sid, arg_min(m, k) AS a, arg_max(m, k) AS b, max(m) - min(m) AS r FROM c WHERE k BETWEEN 0 AND 2 GROUP BY sid) SELECT sid, CASE WHEN r = 0 OR abs(b - a) < 0.1 * r THEN 'keep steady' WHEN b > a THEN 'increase' ELSE 'decrease' END AS trend FROM f")
def windowed_trend(spark, sf_dir, first: int = 0, last: int = 2):
    """The trend of a stretch of chunk means, steady under a tenth of their range."""
    f = chunks(series(spark, sf_dir)).where(F.col("k").between(first, last)).groupBy("sid").agg(F.min_by("m", "k").alias("a"), F.max_by("m", "k").alias("b"), (F.max("m") - F.min("m")).alias("r"))
    d = F.col("b") - F.col("a")
    return f.select("sid", F.when((F.col("r") == 0) | (F.abs(d) < 0.1 * F.col("r")), "keep steady").when(d > 0, "increase").otherwise("decrease").alias("trend"))


@query(MEANS_SQL + ", p AS (SELECT sid, seg, m AS a, lead(m) OVER (PARTITION BY sid ORDER BY seg) AS b FROM m) SELECT sid, seg, CASE WHEN abs(a - b) <= 0.05 * greatest(abs(a), abs(b)) THEN 'equal' WHEN a > b THEN 'higher' ELSE 'lower' END AS verdict FROM p WHERE b IS NOT NULL")
def segment_compare_banded(spark, sf_dir, band: float = 0.05):
    """Each segment's mean against the next one's; means within the band are equal."""
    m = segment_means(spark, sf_dir).withColumn("b", F.lead("m").over(by().orderBy("seg"))).where("b is not null")
    a, b = F.col("m"), F.col("b")
    return m.select("sid", "seg", F.when(F.abs(a - b) <= band * F.greatest(F.abs(a), F.abs(b)), "equal").when(a > b, "higher").otherwise("lower").alias("verdict"))


@query(SEGMENT_SQL + """, t AS (SELECT sid, string_agg(type, ', then ' ORDER BY seg) AS types FROM g GROUP BY sid), e AS (SELECT sid, count(*) AS c FROM ev GROUP BY sid), b AS (SELECT sid, any_value(n) AS n, round(avg(value), 2) AS mean, round(min(value), 2) AS lo, round(max(value), 2) AS hi FROM s GROUP BY sid)
SELECT sid, 'Over ' || n || ' points the series is at ' || printf('%.2f', mean) || ' on average (' || printf('%.2f', lo) || ' to ' || printf('%.2f', hi) || '). Trend: ' || coalesce(types, 'unknown') || '. Events: ' || coalesce(c, 0) || '.' AS text FROM b LEFT JOIN t USING (sid) LEFT JOIN e USING (sid)""")
def series_description(spark, sf_dir):
    """A series in words: level, trend, events."""
    return describe(spark, sf_dir)


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series(spark, sf_dir)
    b = p.groupBy("sid").agg(F.max("n").alias("n"), rnd(F.avg("value"), 2).alias("mean"), rnd(F.min("value"), 2).alias("lo"), rnd(F.max("value"), 2).alias("hi"), F.count_if(F.col("event_type") == "error").alias("c"))
    t = segment(p).groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "type"))), lambda x: x["type"]), ", then ").alias("types"))
    said = F.format_string("Over %d points the series is at %.2f on average (%.2f to %.2f). Trend: %s. Events: %d.", "n", "mean", "lo", "hi", F.coalesce("types", F.lit("unknown")), "c")
    return b.join(t, "sid", "left").select("sid", said.alias("text"))
