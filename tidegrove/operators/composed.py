"""Questions put together from others: every statistic by name, judgments of several conditions, descriptions of all parts, and
the same with worked steps; what a held-out set is drawn from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, rnd
from .comparisons import SHAPE_SQL, compared
from .cross import CHANNEL_SQL, WIDTH, channels, pairs
from .generators import MADE_SQL, _made, points
from .segments import SEGMENT_SQL, in_segment, local_events, segment, segments
from .series import CHUNK_SQL, HALF, POS, SERIES_SQL, chunks, first_max, part, series, with_moments

BAND = 0.05

STAT_SQL = SERIES_SQL + """, mm AS (SELECT sid, avg(value) AS mu FROM s GROUP BY sid), sg AS (SELECT sid, pos, value, n, mu, sign(value - round(mu, 2)) AS g FROM s JOIN mm USING (sid)), cr AS (SELECT *, CASE WHEN lag(g) OVER (PARTITION BY sid ORDER BY pos) <> g THEN 1 ELSE 0 END AS c FROM sg),
t AS (SELECT sid, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS hi, min(value) AS lo, median(value) AS med, arg_max(pos, struct_pack(v := value, p := -pos)) AS peak, count(*) FILTER (value > mu) AS above, sum(c) AS crossings, avg(value) FILTER (pos < n // 2) AS h1, avg(value) FILTER (pos >= n // 2) AS h2,
 stddev_pop(value) FILTER (pos < n // 2) AS s1, stddev_pop(value) FILTER (pos >= n // 2) AS s2, avg(value) FILTER (pos < n // 3) AS t1, avg(value) FILTER (pos >= n - n // 3) AS t3, avg(value) FILTER (pos BETWEEN 10 AND 30) AS win FROM cr GROUP BY sid) """


@query(STAT_SQL + """SELECT sid, sub_type, v AS value FROM (SELECT sid, unnest([{'sub_type': 'mean', 'v': round(mean, 2)::VARCHAR}, {'sub_type': 'std', 'v': round(std, 2)::VARCHAR}, {'sub_type': 'max', 'v': round(hi, 2)::VARCHAR}, {'sub_type': 'min', 'v': round(lo, 2)::VARCHAR}, {'sub_type': 'median', 'v': round(med, 2)::VARCHAR}, {'sub_type': 'range', 'v': round(hi - lo, 2)::VARCHAR},
 {'sub_type': 'extrema_pos', 'v': peak::VARCHAR}, {'sub_type': 'threshold_duration', 'v': above::VARCHAR}, {'sub_type': 'mean_crossing', 'v': crossings::BIGINT::VARCHAR}, {'sub_type': 'half_mean_diff', 'v': round(abs(round(h1, 2) - round(h2, 2)), 2)::VARCHAR}, {'sub_type': 'volatility_change', 'v': CASE WHEN round(s2, 2) > round(s1, 2) THEN 'increase' WHEN round(s2, 2) < round(s1, 2) THEN 'decrease' ELSE 'equal' END},
 {'sub_type': 'segment_compare', 'v': CASE WHEN abs(round(h1, 2) - round(h2, 2)) <= 0.05 * greatest(abs(round(h1, 2)), abs(round(h2, 2))) THEN 'equal' WHEN round(h1, 2) > round(h2, 2) THEN 'first half' ELSE 'second half' END}, {'sub_type': 'windowed_mean', 'v': round(win, 2)::VARCHAR}, {'sub_type': 'windowed_trend', 'v': CASE WHEN round(t3, 2) > round(t1, 2) THEN 'increase' WHEN round(t3, 2) < round(t1, 2) THEN 'decrease' ELSE 'keep steady' END}], recursive := true) FROM t)""")
def stat_numerical(spark, sf_dir):
    """All fourteen sub-types of each series from one aggregation, a row each; numbers as text, as answers are."""
    p = with_moments(series(spark, sf_dir)).withColumn("g", F.signum(F.col("value") - rnd("mu", 2)))
    p = p.withColumn("c", (F.lag("g").over(Window.partitionBy("sid").orderBy("pos")) != F.col("g")).cast("int"))
    third = F.floor(F.col("n") / 3)
    a = lambda cond: rnd(F.avg(part(cond)), 2)
    t = p.groupBy("sid").agg(
        rnd(F.avg("value"), 2).alias("mean"), rnd(F.stddev_pop("value"), 2).alias("std"), F.max("value").alias("hi"), F.min("value").alias("lo"), rnd(F.expr("percentile(value, 0.5)"), 2).alias("med"), first_max().alias("peak"), F.count_if(F.col("value") > F.col("mu")).alias("above"), F.coalesce(F.sum("c"), F.lit(0)).alias("crossings"),
        a(POS() < HALF()).alias("h1"), a(POS() >= HALF()).alias("h2"), rnd(F.stddev_pop(part(POS() < HALF())), 2).alias("s1"), rnd(F.stddev_pop(part(POS() >= HALF())), 2).alias("s2"), a(POS() < third).alias("t1"), a(POS() >= F.col("n") - third).alias("t3"), a(POS().between(10, 30)).alias("win"),
    )
    c = F.col
    way = lambda x, y, same: F.when(c(y) > c(x), "increase").when(c(y) < c(x), "decrease").otherwise(same)
    text = lambda x: x.cast("string")
    banded = F.when(F.abs(c("h1") - c("h2")) <= BAND * F.greatest(F.abs("h1"), F.abs("h2")), "equal").when(c("h1") > c("h2"), "first half").otherwise("second half")
    kinds = {"mean": text(c("mean")), "std": text(c("std")), "max": text(rnd("hi", 2)), "min": text(rnd("lo", 2)), "median": text(c("med")), "range": text(rnd(c("hi") - c("lo"), 2)), "extrema_pos": text(c("peak")), "threshold_duration": text(c("above")), "mean_crossing": text(c("crossings")), "half_mean_diff": text(rnd(F.abs(c("h1") - c("h2")), 2)), "volatility_change": way("s1", "s2", "equal"), "segment_compare": banded, "windowed_mean": text(c("win")), "windowed_trend": way("t1", "t3", "keep steady")}
    return t.select("sid", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in kinds.items()))).alias("x")).select("sid", F.col("x.k").alias("sub_type"), F.col("x.v").alias("value"))


@query(SEGMENT_SQL + """, t AS (SELECT sid, round(stddev_pop(value), 2) AS sd, round(max(value) - min(value), 2) AS r, round(avg(value) FILTER (pos < n // 2), 2) AS h1, round(avg(value) FILTER (pos >= n // 2), 2) AS h2, round(stddev_pop(value) FILTER (pos < n // 2), 2) AS s1, round(stddev_pop(value) FILTER (pos >= n // 2), 2) AS s2 FROM s GROUP BY sid),
e AS (SELECT sid, count(*) AS events, max(abs(value)) AS amp FROM ev GROUP BY sid), gg AS (SELECT sid, count(*) AS segs, bool_or(type = 'increase') AS rises FROM g GROUP BY sid)
SELECT sid, rises AND coalesce(events, 0) > 5 AS trend_local, sd > 40 AND rises AS noise_trend, coalesce(amp > 2 * sd, false) AS amplitude_vs_std, r > 4 * sd AS range_vs_std, s1 < 0.9 * s2 AS half_volatility, h2 > 1.1 * h1 AS half_mean_shift, segs >= 3 AND coalesce(events, 0) >= 1 AS phase_event FROM t JOIN gg USING (sid) LEFT JOIN e USING (sid)""")
def segment_judgment(spark, sf_dir):
    """Judgments that join a condition on the trend, the noise, the halves or the events of a series."""
    p = series(spark, sf_dir)
    sd = lambda cond: rnd(F.stddev_pop(part(cond)), 2)
    m = lambda cond: rnd(F.avg(part(cond)), 2)
    first, second, event = POS() < HALF(), POS() >= HALF(), F.col("event_type") == "error"
    t = p.groupBy("sid").agg(rnd(F.stddev_pop("value"), 2).alias("sd"), rnd(F.max("value") - F.min("value"), 2).alias("r"), m(first).alias("h1"), m(second).alias("h2"), sd(first).alias("s1"), sd(second).alias("s2"), F.count_if(event).alias("events"), F.max(F.when(event, F.abs("value"))).alias("amp"))
    g = segment(p).groupBy("sid").agg(F.count(F.lit(1)).alias("segs"), F.some(F.col("type") == "increase").alias("rises"))
    c = F.col
    return t.join(g, "sid").select("sid", (c("rises") & (c("events") > 5)).alias("trend_local"), ((c("sd") > 40) & c("rises")).alias("noise_trend"), F.coalesce(c("amp") > 2 * c("sd"), F.lit(False)).alias("amplitude_vs_std"), (c("r") > 4 * c("sd")).alias("range_vs_std"), (c("s1") < 0.9 * c("s2")).alias("half_volatility"), (c("h2") > 1.1 * c("h1")).alias("half_mean_shift"), ((c("segs") >= 3) & (c("events") >= 1)).alias("phase_event"))


@query(CHUNK_SQL + "SELECT sid, bool_and(d >= 0) AS rising, bool_and(d <= 0) AS falling FROM (SELECT sid, m - lag(m) OVER (PARTITION BY sid ORDER BY k) AS d FROM c) WHERE d IS NOT NULL GROUP BY sid")
def windowed_monotonicity(spark, sf_dir):
    """Whether the means of stretches of 16 points only rise, or only fall."""
    d = chunks(series(spark, sf_dir)).withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy("sid").orderBy("k"))).where("d is not null")
    return d.groupBy("sid").agg(F.every(F.col("d") >= 0).alias("rising"), F.every(F.col("d") <= 0).alias("falling"))


@query(MADE_SQL + "SELECT sid, wave || ' wave of period ' || period || ' and amplitude ' || printf('%.2f', amplitude) AS answer FROM u")
def atomic_periodic_description(spark, sf_dir):
    return _made(spark, sf_dir).select("sid", F.format_string("%s wave of period %d and amplitude %.2f", "wave", "period", "amplitude").alias("answer"))


@query(MADE_SQL + f"SELECT x.sid // {WIDTH} AS sample, x.sid AS a, y.sid AS b, x.period < y.period AS shorter, x.amplitude > y.amplitude AS stronger FROM u x JOIN u y ON x.sid // {WIDTH} = y.sid // {WIDTH} AND x.sid < y.sid")
def cross_period_compare(spark, sf_dir):
    """Whether the first of two channels has the shorter period."""
    m = _made(spark, sf_dir).select("sid", "period", "amplitude").withColumn("sample", F.floor(F.col("sid") / WIDTH))
    return pairs(m).selectExpr("x.sample", "x.sid AS a", "y.sid AS b", "x.period < y.period AS shorter", "x.amplitude > y.amplitude AS stronger")


@query(SEGMENT_SQL + ", t AS (SELECT sid, max(value) - min(value) AS r FROM s GROUP BY sid) SELECT sid, round(max(abs(value)) / any_value(r), 4) AS share, max(abs(value)) > any_value(r) / 2 AS yes FROM ev JOIN t USING (sid) GROUP BY sid")
def range_normalized_amplitude(spark, sf_dir):
    """The strongest event as a share of the range, and whether it is over half."""
    event = F.when(F.col("event_type") == "error", F.abs("value"))
    t = series(spark, sf_dir).groupBy("sid").agg((F.max("value") - F.min("value")).alias("r"), F.max(event).alias("a")).where("a is not null")
    return t.select("sid", rnd(F.col("a") / F.col("r"), 4).alias("share"), (F.col("a") > F.col("r") / 2).alias("yes"))


@query(SHAPE_SQL + "SELECT sample, count(*) FILTER (same) AS alike, count(*) FILTER (against) AS opposite, count(*) FILTER (same) > 0 AND count(*) FILTER (against) > 0 AS mixed FROM cmp WHERE a < b GROUP BY sample")
def mixed_corr_anti(spark, sf_dir):
    """How many pairs of channels go together and how many against each other, and whether a sample has both."""
    return compared(spark, sf_dir).groupBy("sample").agg(F.count_if("same").alias("alike"), F.count_if("against").alias("opposite"), (F.some("same") & F.some("against")).alias("mixed"))


DESCRIBE_SQL = SEGMENT_SQL + ", dt AS (SELECT sid, string_agg(type || ' from ' || start || ' to ' || stop, '; ' ORDER BY seg) AS trend FROM g GROUP BY sid), dl AS (SELECT sid, string_agg('spike at ' || pos, '; ' ORDER BY pos) AS local, count(*) AS k FROM ev GROUP BY sid), dn AS (SELECT sid, CASE WHEN stddev_pop(value) > 40 THEN 'noisy' ELSE 'smooth' END AS noise FROM s GROUP BY sid) "


@query(DESCRIBE_SQL + "SELECT sid, 'Trend: ' || trend || '. Noise: ' || noise || '. Local: ' || coalesce(local, 'none') || '.' AS text, coalesce(k, 0) AS events FROM dt JOIN dn USING (sid) LEFT JOIN dl USING (sid)")
def description(spark, sf_dir):
    """Trend, noise and local changes of each series in words. Seasons are those of made series, in their own query."""
    p = series(spark, sf_dir)
    joined = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), "; ")
    trend = segment(p).groupBy("sid").agg(joined("seg", F.format_string("%s from %d to %d", "type", "start", "stop")).alias("trend"))
    event = F.col("event_type") == "error"
    rest = p.groupBy("sid").agg(F.when(F.stddev_pop("value") > 40, "noisy").otherwise("smooth").alias("noise"), F.array_sort(F.collect_list(F.when(event, F.col("pos")))).alias("at"))
    local = F.when(F.size("at") > 0, F.array_join(F.transform("at", lambda i: F.concat(F.lit("spike at "), i.cast("string"))), "; ")).otherwise("none")
    return trend.join(rest, "sid").select("sid", F.concat(F.lit("Trend: "), "trend", F.lit(". Noise: "), "noise", F.lit(". Local: "), local, F.lit(".")).alias("text"), F.size("at").cast("bigint").alias("events"))


@query(MADE_SQL + "SELECT sid, 'Trend: from ' || printf('%.2f', first) || ' to ' || printf('%.2f', last) || '. Seasonal: ' || wave || ', period ' || period || '.' AS text FROM u")
def seasonal_description(spark, sf_dir):
    return _made(spark, sf_dir).select("sid", F.format_string("Trend: from %.2f to %.2f. Seasonal: %s, period %d.", "first", "last", "wave", "period").alias("text"))


@query(CHUNK_SQL + ", h AS (SELECT sid, round(avg(m) FILTER (k < 2), 2) AS a, round(avg(m) FILTER (k >= 2), 2) AS b, string_agg(printf('%.2f', m), ' ' ORDER BY k) AS shown FROM c GROUP BY sid HAVING count(*) > 2) SELECT sid, 'chunk means ' || shown || '; early ' || printf('%.2f', a) || '; late ' || printf('%.2f', b) AS steps, CASE WHEN b > a THEN 'yes' ELSE 'no' END AS answer FROM h")
def bridge_mean_shift(spark, sf_dir):
    """Whether the late chunks lie above the early ones, with the numbers on the way to the answer."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: F.format_string("%.2f", x["m"]))
    h = chunks(series(spark, sf_dir)).groupBy("sid").agg(rnd(F.avg(F.when(F.col("k") < 2, F.col("m"))), 2).alias("a"), rnd(F.avg(F.when(F.col("k") >= 2, F.col("m"))), 2).alias("b"), F.array_join(m, " ").alias("shown"), F.count(F.lit(1)).alias("n")).where("n > 2")
    return h.select("sid", F.format_string("chunk means %s; early %.2f; late %.2f", "shown", "a", "b").alias("steps"), F.when(F.col("b") > F.col("a"), "yes").otherwise("no").alias("answer"))


@query(SEGMENT_SQL + ", o AS (SELECT sid, type, sum(dur)::BIGINT AS d, string_agg(dur::VARCHAR, ' + ' ORDER BY seg) AS parts, min(seg) AS f FROM g GROUP BY sid, type) SELECT sid, string_agg('- ' || type || ': ' || parts || ' = ' || d, chr(10) ORDER BY f) AS steps, arg_max(type, struct_pack(v := d, f := -f)) AS answer FROM o GROUP BY sid")
def bridge_dominant_trend(spark, sf_dir):
    """The type that fills most of a series, with the sums of its segments."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "dur"))), lambda x: x["dur"].cast("string")), " + ")
    o = segments(spark, sf_dir).groupBy("sid", "type").agg(F.sum("dur").alias("d"), parts.alias("parts"), F.min("seg").alias("f"))
    line = F.format_string("- %s: %s = %d", "type", "parts", "d")
    return o.groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", line.alias("t")))), lambda x: x["t"]), "\n").alias("steps"), F.max_by("type", F.struct("d", -F.col("f"))).alias("answer"))


@query(SEGMENT_SQL + ", i AS (SELECT ev.sid, pos, type FROM ev JOIN g ON ev.sid = g.sid AND pos BETWEEN start AND stop QUALIFY row_number() OVER (PARTITION BY ev.sid, pos ORDER BY seg) = 1) SELECT sid, string_agg(pos || ': ' || type, ', ' ORDER BY pos) AS steps, count(*) FILTER (type = 'increase') AS answer FROM i GROUP BY sid")
def bridge_events_in_trend(spark, sf_dir):
    """How many events fall into rises, with the segment that each falls into."""
    i = in_segment(local_events(spark, sf_dir), segments(spark, sf_dir)).groupBy("sid", "pos").agg(F.min_by("type", "seg").alias("type"))
    line = F.format_string("%d: %s", "pos", "type")
    return i.groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), ", ").alias("steps"), F.count_if(F.col("type") == "increase").alias("answer"))


@query(CHANNEL_SQL + "SELECT sample, string_agg('channel ' || sid || ': mean ' || printf('%.2f', mean), '; ' ORDER BY sid) AS steps, string_agg(sid::VARCHAR, ' > ' ORDER BY mean DESC, sid) AS answer FROM a GROUP BY sample")
def bridge_cross_ordering(spark, sf_dir):
    """The channels of a sample by their means, with the means."""
    line = F.struct("sid", F.format_string("channel %d: mean %.2f", "sid", "mean").alias("t"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), "sid"))), lambda x: x["sid"].cast("string"))
    return channels(spark, sf_dir).groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "; ").alias("steps"), F.array_join(order, " > ").alias("answer"))


def far_from(events, n, threshold: int):
    """The first position that is at least so far from all events; null if there is none."""
    free = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.exists(events, lambda e: F.abs(e - i) < threshold))
    return F.try_element_at(free, F.lit(1))


@query(SEGMENT_SQL + ", nn AS (SELECT sid, any_value(n) AS n FROM s GROUP BY sid), f AS (SELECT nn.sid, r.p FROM nn, (SELECT unnest(range(200)) AS p) r WHERE r.p < n AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.sid = nn.sid AND abs(ev.pos - r.p) < 4)) SELECT nn.sid, min(p)::INT AS pos FROM nn LEFT JOIN f USING (sid) GROUP BY nn.sid")
def far_from_all(spark, sf_dir, threshold: int = 4):
    at = F.collect_list(F.when(F.col("event_type") == "error", F.col("pos")))
    p = series(spark, sf_dir).groupBy("sid").agg(at.alias("at"), F.max("n").cast("int").alias("n"))
    return p.select("sid", far_from(F.col("at"), F.col("n"), threshold).alias("pos"))


@query(SHAPE_SQL + "SELECT a, b, same AS matches, against AS mirrors FROM cmp")
def trend_match(spark, sf_dir):
    """Whether two channels' segments match in number, type and both borders, or match turned upside down; both ways round."""
    c = compared(spark, sf_dir)
    return c.select("a", "b", F.col("same").alias("matches"), F.col("against").alias("mirrors")).unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("same").alias("matches"), F.col("against").alias("mirrors")))


@query(CHANNEL_SQL + "SELECT sample, what, string_agg(sid::VARCHAR, ', ' ORDER BY sid) AS channels, count(*) AS n FROM (SELECT sample, sid, unnest([CASE WHEN h2 > h1 THEN 'rising' END, CASE WHEN h2 < h1 THEN 'falling' END, CASE WHEN std > mean THEN 'unsteady' END, CASE WHEN hi > 200 THEN 'high' END, CASE WHEN peak < 20 THEN 'early peak' END, CASE WHEN type = 'keep steady' THEN 'steady' END, CASE WHEN hi - lo > 150 THEN 'wide' END, CASE WHEN mean > 50 THEN 'above' END]) AS what FROM ch2) WHERE what IS NOT NULL GROUP BY sample, what")
def cross_metric_enumeration(spark, sf_dir):
    """The channels of a sample with each of eight properties."""
    c = F.col
    has = {"rising": c("h2") > c("h1"), "falling": c("h2") < c("h1"), "unsteady": c("std") > c("mean"), "high": c("hi") > 200, "early peak": c("peak") < 20, "steady": c("type") == "keep steady", "wide": c("hi") - c("lo") > 150, "above": c("mean") > 50}
    x = channels(spark, sf_dir).select("sample", "sid", F.explode(F.array(*(F.when(v, F.lit(k)) for k, v in has.items()))).alias("what")).where("what is not null")
    return x.groupBy("sample", "what").agg(F.array_join(F.array_sort(F.collect_list("sid")), ", ").alias("channels"), F.count(F.lit(1)).alias("n"))
