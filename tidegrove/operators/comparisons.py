"""Comparisons of the channels of a sample: who leads in what, which trends agree, whose events coincide.

A channel is brought to one row first. Where pairs are only counted, they are counted from the sizes of groups of equal
trend, without making the pairs; pairs and comparisons with an anchor are made of one row a channel within a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table
from .cross import CHANNEL_SQL, WIDTH, channels, pairs
from .enumerations import listed, winners
from .held_out import by, one
from .segments import local_events, segment, segments
from .series import HALF, POS, part, series

#: One row a channel in SQL with all that can be compared.
PROFILE_SQL = CHANNEL_SQL + f""", gp AS (SELECT sid, min(pos) AS first, max(pos) AS last, count(*) AS events, max(gap) AS gap, max(abs(value)) AS amp FROM (SELECT *, lead(pos) OVER (PARTITION BY sid ORDER BY pos) - pos AS gap FROM ev) GROUP BY sid),
sg AS (SELECT sid, count(*) AS segs, max(dur) AS longest FROM g GROUP BY sid),
pf AS (SELECT sid // {WIDTH} AS sample, a.sid, unnest([{{'what': 'mean', 'v': mean::DOUBLE}}, {{'what': 'std', 'v': std}}, {{'what': 'max', 'v': hi}}, {{'what': 'min', 'v': -lo}}, {{'what': 'range', 'v': round(hi - lo, 4)}}, {{'what': 'segments', 'v': segs::DOUBLE}}, {{'what': 'longest', 'v': longest::DOUBLE}},
 {{'what': 'events', 'v': coalesce(events, 0)::DOUBLE}}, {{'what': 'earliest', 'v': -first::DOUBLE}}, {{'what': 'latest', 'v': last::DOUBLE}}, {{'what': 'gap', 'v': gap::DOUBLE}}, {{'what': 'amplitude', 'v': amp}}]) AS x FROM a JOIN sg USING (sid) LEFT JOIN gp USING (sid)),
fl AS (SELECT sample, sid, x.what AS what, x.v AS v FROM pf WHERE x.v IS NOT NULL) """


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, sid, what, v): every measure of every channel, larger is more; least and earliest are negated."""
    e = local_events(spark, sf_dir).withColumn("gap", F.lead("pos").over(by().orderBy("pos")) - POS())
    e = e.groupBy("sid").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), one().alias("events"), F.max("gap").alias("gap"), F.max(F.abs("value")).alias("amplitude"))
    g = segments(spark, sf_dir).groupBy("sid").agg(one().alias("segs"), F.max("dur").alias("longest"))
    ch = channels(spark, sf_dir).join(g, "sid").join(e, "sid", "left")
    c = F.col
    ways = {"mean": c("mean"), "std": c("std"), "max": c("hi"), "min": -c("lo"), "range": rnd(c("hi") - c("lo"), 4), "segments": c("segs"), "longest": c("longest"), "events": F.coalesce(c("events"), F.lit(0)), "earliest": -c("first"), "latest": c("last"), "gap": c("gap"), "amplitude": c("amplitude")}
    return ch.select("sample", "sid", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), v.cast("double").alias("v")) for k, v in ways.items()))).alias("x")).select("sample", "sid", "x.what", "x.v").where("v is not null")


@query(PROFILE_SQL + "SELECT sample, what, string_agg(sid::VARCHAR, ', ' ORDER BY sid) AS leaders FROM (SELECT *, rank() OVER (PARTITION BY sample, what ORDER BY v DESC) AS k, max(v) OVER w AS hi, min(v) OVER w AS lo FROM fl WINDOW w AS (PARTITION BY sample, what)) WHERE k = 1 AND hi > lo GROUP BY sample, what")
def cross_leaders(spark, sf_dir):
    """Who leads in each measure, with ties; measures in which all are equal are left out."""
    w = Window.partitionBy("sample", "what")
    p = profiles(spark, sf_dir).withColumn("hi", F.max("v").over(w)).withColumn("lo", F.min("v").over(w)).where("hi > lo")
    return winners(p, F.col("v"), "sample", "what").groupBy("sample", "what").agg(listed(F.col("sid").cast("string"), "sid").alias("leaders"))


@query(CHANNEL_SQL + "SELECT sample, count(*) FILTER (mean > 50) AS high, count(*) FILTER (type = 'increase') AS rising, count(*) FILTER (sid IN (SELECT sid FROM ev)) AS with_events, min(type) = max(type) AS all_same FROM ch2 GROUP BY sample")
def cross_counting(spark, sf_dir):
    e = local_events(spark, sf_dir).select("sid").distinct().withColumn("has", F.lit(True))
    return channels(spark, sf_dir).join(e, "sid", "left").groupBy("sample").agg(F.count_if(F.col("mean") > 50).alias("high"), F.count_if(F.col("type") == "increase").alias("rising"), F.count("has").alias("with_events"), (F.min("type") == F.max("type")).alias("all_same"))


@query(CHANNEL_SQL + "SELECT sample, count(*) FILTER (ta = tb) AS concordant, count(*) FILTER (ta = 'increase' AND tb = 'decrease' OR ta = 'decrease' AND tb = 'increase') AS opposite, count(*) AS pairs FROM pr GROUP BY sample")
def cross_trend_pairs(spark, sf_dir):
    """Pairs of channels of equal and of opposite trend, counted from the sizes of the groups."""
    c = channels(spark, sf_dir).groupBy("sample", "type").agg(one().alias("c"))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("type") == kind, F.col("c"))), F.lit(0))
    n = F.sum("c")
    return c.groupBy("sample").agg(F.sum(F.expr("c * (c - 1) div 2")).alias("concordant"), (of("increase") * of("decrease")).alias("opposite"), n.alias("n")).where("n > 1").selectExpr("sample", "concordant", "opposite", "n * (n - 1) div 2 AS pairs")


@query(CHANNEL_SQL + f""", hf AS (SELECT g.sid, seg, type, greatest(0, least(stop, n // 2) - start) AS o1, greatest(0, stop - greatest(start, n // 2)) AS o2 FROM g JOIN (SELECT DISTINCT sid, n FROM s) USING (sid)),
t1 AS (SELECT sid // {WIDTH} AS sample, 1 AS half, type FROM hf QUALIFY row_number() OVER (PARTITION BY sid ORDER BY o1 DESC, seg) = 1), t2 AS (SELECT sid // {WIDTH} AS sample, 2 AS half, type FROM hf QUALIFY row_number() OVER (PARTITION BY sid ORDER BY o2 DESC, CASE WHEN o2 > 0 THEN seg ELSE -seg END) = 1),
cc AS (SELECT sample, half, type, count(*) AS c FROM (FROM t1 UNION ALL FROM t2) GROUP BY ALL), y AS (SELECT sample, sum(c * (c - 1) // 2) FILTER (half = 1)::BIGINT AS early, sum(c * (c - 1) // 2) FILTER (half = 2)::BIGINT AS late FROM cc GROUP BY sample)
SELECT sample, early, late, late > early + 1 AS converge, early > late + 1 AS diverge FROM y""")
def cross_trend_convergence(spark, sf_dir):
    """Pairs of equal trend in each half, and whether there are clearly more or fewer in the second."""
    p = series(spark, sf_dir)
    n = p.groupBy("sid").agg(F.max("n").alias("n"))
    g = segment(p).join(n, "sid").withColumn("o1", F.greatest(F.lit(0), F.least("stop", HALF()) - F.col("start"))).withColumn("o2", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", HALF())))
    late = F.when(F.col("o2") > 0, -F.col("seg")).otherwise(F.col("seg"))
    t = g.groupBy("sid").agg(F.max_by("type", F.struct("o1", -F.col("seg"))).alias("t1"), F.max_by("type", F.struct("o2", late)).alias("t2"))
    t = t.select((F.floor(F.col("sid") / WIDTH)).alias("sample"), F.posexplode(F.array("t1", "t2")).alias("half", "type"))
    c = t.groupBy("sample", "half", "type").agg(one().alias("c")).withColumn("c", F.expr("c * (c - 1) div 2"))
    y = c.groupBy("sample").agg(F.sum(F.when(F.col("half") == 0, F.col("c"))).alias("early"), F.sum(F.when(F.col("half") == 1, F.col("c"))).alias("late"))
    return y.select("*", (F.col("late") > F.col("early") + 1).alias("converge"), (F.col("early") > F.col("late") + 1).alias("diverge"))


@query(CHANNEL_SQL + "SELECT x.sample, x.a, x.b, y.b AS c, x.ta = x.tb AS ab, y.ta = y.tb AS bc, x.ta = y.tb AS ac FROM pr x JOIN pr y ON x.sample = y.sample AND x.b = y.a AND NOT EXISTS (SELECT 1 FROM a z WHERE z.sample = x.sample AND (z.sid > x.a AND z.sid < x.b OR z.sid > y.a AND z.sid < y.b))")
def corr_transitivity(spark, sf_dir):
    """Of channels next to each other by id: whether a and b, b and c, and then a and c have the same trend."""
    w = Window.partitionBy("sample").orderBy("sid")
    t = channels(spark, sf_dir).select("sample", F.col("sid").alias("a"), F.lead("sid").over(w).alias("b"), F.lead("sid", 2).over(w).alias("c"), F.col("type").alias("ta"), F.lead("type").over(w).alias("tb"), F.lead("type", 2).over(w).alias("tc")).where("c is not null")
    return t.selectExpr("sample", "a", "b", "c", "ta = tb AS ab", "tb = tc AS bc", "ta = tc AS ac")


@query(CHANNEL_SQL + "SELECT pr.sample, a, b, round(x.std, 2) >= round(1.1 * y.std, 2) AS std_ratio, round(x.hi - x.lo, 2) >= round(1.1 * (y.hi - y.lo), 2) AS range_ratio, abs(x.h2 - x.h1) >= round(0.03 * (x.hi - x.lo), 2) AND abs(y.h2 - y.h1) >= round(0.03 * (y.hi - y.lo), 2) AS half_shift FROM pr JOIN a x ON x.sid = a JOIN a y ON y.sid = b")
def cross_stat_judgment(spark, sf_dir, k: float = 1.1, share: float = 0.03):
    """Whether a's deviation and range are k times b's, and whether both halves of both are shares of the range apart."""
    p = pairs(channels(spark, sf_dir).withColumn("r", F.col("hi") - F.col("lo")).withColumn("d", F.abs(F.col("h2") - F.col("h1"))))
    far = lambda s: F.col(f"{s}.d") >= rnd(share * F.col(f"{s}.r"), 2)
    return p.select("x.sample", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), (F.col("x.std") >= rnd(k * F.col("y.std"), 2)).alias("std_ratio"), (rnd("x.r", 2) >= rnd(k * F.col("y.r"), 2)).alias("range_ratio"), (far("x") & far("y")).alias("half_shift"))


HALF_STD_SQL = CHANNEL_SQL + f", hs AS (SELECT sid // {WIDTH} AS sample, sid, round(stddev_pop(value) FILTER (pos < n // 2), 2) AS s1, round(stddev_pop(value) FILTER (pos >= n // 2), 2) AS s2 FROM s GROUP BY sid) "


@query(HALF_STD_SQL + "SELECT x.sample, x.sid AS a, y.sid AS b, x.s1 > y.s1 AND x.s2 > y.s2 AS steadier, (x.s2 > x.s1) = (y.s2 > y.s1) AS same_way FROM hs x JOIN hs y ON x.sample = y.sample AND x.sid < y.sid")
def cross_half_volatility(spark, sf_dir):
    """Whether b is the steadier one in both halves, and whether both grow or calm down."""
    hs = series(spark, sf_dir).groupBy("sid").agg(rnd(F.stddev_pop(part(POS() < HALF())), 2).alias("s1"), rnd(F.stddev_pop(part(POS() >= HALF())), 2).alias("s2")).withColumn("sample", F.floor(F.col("sid") / WIDTH))
    return pairs(hs).selectExpr("x.sample", "x.sid AS a", "y.sid AS b", "x.s1 > y.s1 AND x.s2 > y.s2 AS steadier", "(x.s2 > x.s1) = (y.s2 > y.s1) AS same_way")


@query(CHANNEL_SQL + ", o AS (SELECT sid, type, sum(greatest(0, least(40, stop) - greatest(10, start))) AS o FROM g GROUP BY sid, type), rr AS (SELECT *, rank() OVER (PARTITION BY sid ORDER BY o DESC) AS k FROM o), dm AS (SELECT sid, CASE WHEN count(*) > 1 THEN 'equal' ELSE min(type) END AS dom FROM rr WHERE k = 1 GROUP BY sid) SELECT sample, a, b, x.dom = y.dom AS same FROM pr JOIN dm x ON x.sid = a JOIN dm y ON y.sid = b")
def cross_trend_query(spark, sf_dir, a: int = 10, b: int = 40):
    """Whether the types that fill most of [a, b] agree."""
    over = F.greatest(F.lit(0), F.least(F.lit(b), F.col("stop")) - F.greatest(F.lit(a), F.col("start")))
    o = winners(segments(spark, sf_dir).groupBy("sid", "type").agg(F.sum(over).alias("o")), F.col("o"), "sid")
    d = o.groupBy("sid").agg(F.when(one() > 1, "equal").otherwise(F.min("type")).alias("dom")).withColumn("sample", F.floor(F.col("sid") / WIDTH))
    return pairs(d).selectExpr("x.sample", "x.sid AS a", "y.sid AS b", "x.dom = y.dom AS same")


#: How far apart the borders of two segments may lie that are at the same place of their series.
TOLERANCE = 8
SHAPE_SQL = CHANNEL_SQL + f""", sh AS (SELECT sid // {WIDTH} AS sample, sid, count(*) AS k FROM g GROUP BY sid),
mt AS (SELECT x.sid AS a, y.sid AS b, count(*) FILTER (x.type = y.type) AS alike, count(*) FILTER (y.type = CASE x.type WHEN 'increase' THEN 'decrease' WHEN 'decrease' THEN 'increase' ELSE x.type END) AS mirrored
 FROM g x JOIN g y ON x.sid // {WIDTH} = y.sid // {WIDTH} AND x.sid <> y.sid AND x.seg = y.seg AND abs(x.start - y.start) <= {TOLERANCE} AND abs(x.stop - y.stop) <= {TOLERANCE} GROUP BY ALL),
cmp AS (SELECT x.sample, x.sid AS a, y.sid AS b, x.k = y.k AND coalesce(alike, 0) = x.k AS same, x.k = y.k AND coalesce(mirrored, 0) = x.k AS against FROM sh x JOIN sh y ON x.sample = y.sample AND x.sid <> y.sid LEFT JOIN mt ON mt.a = x.sid AND mt.b = y.sid) """


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, sid, shape): the type, start and stop of every segment of a channel, in order."""
    s = F.array_sort(F.collect_list(F.struct("seg", "type", "start", "stop")))
    return segments(spark, sf_dir).groupBy("sid").agg(s.alias("shape")).withColumn("sample", F.floor(F.col("sid") / WIDTH))


def goes_with(x: Column, y: Column, tolerance: int = TOLERANCE, against: bool = False) -> Column:
    """Whether two channels have equally many segments, each of the same type (or, against, rises where the other falls)
    and with both borders within the tolerance."""
    turned = lambda t: F.when(t == "increase", "decrease").when(t == "decrease", "increase").otherwise(t)
    kind = lambda t: turned(t) if against else t
    near = lambda a, b: (b["type"] == kind(a["type"])) & (F.abs(a["start"] - b["start"]) <= tolerance) & (F.abs(a["stop"] - b["stop"]) <= tolerance)
    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda a, b: F.coalesce(near(a, b), F.lit(False))), lambda hit: hit)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, a, b, same, against) of the pairs of channels of each sample."""
    p = pairs(shapes(spark, sf_dir))
    return p.select("x.sample", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), goes_with(F.col("x.shape"), F.col("y.shape")).alias("same"), goes_with(F.col("x.shape"), F.col("y.shape"), against=True).alias("against"))


@query(SHAPE_SQL + "SELECT sample, a, b, CASE WHEN same THEN 'similar' ELSE 'different' END AS correlation, CASE WHEN against THEN 'opposite' ELSE 'not_opposite' END AS anticorrelation FROM cmp WHERE a < b")
def shape_correlation(spark, sf_dir):
    """Whether two channels go through the same trends at the same places, or through opposite ones."""
    return compared(spark, sf_dir).selectExpr("sample", "a", "b", "CASE WHEN same THEN 'similar' ELSE 'different' END AS correlation", "CASE WHEN against THEN 'opposite' ELSE 'not_opposite' END AS anticorrelation")


@query(SHAPE_SQL + ", an AS (SELECT min(sid) AS sid FROM sh GROUP BY sample) SELECT sample, a AS anchor, coalesce(string_agg(b::VARCHAR, ', ' ORDER BY b) FILTER (same), 'none') AS alike, coalesce(string_agg(b::VARCHAR, ', ' ORDER BY b) FILTER (against), 'none') AS opposite FROM cmp JOIN an ON an.sid = a GROUP BY sample, a")
def shape_clustering(spark, sf_dir):
    """The channels that go the anchor's way, and those that go against it; the anchor is the sample's first channel."""
    first = F.min("a").over(Window.partitionBy("sample"))
    c = compared(spark, sf_dir).withColumn("anchor", first).where("a = anchor")
    hit = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.col("b")))), ", ")
    g = c.groupBy("sample", "anchor").agg(hit("same").alias("alike"), hit("against").alias("opposite"))
    return g.select("sample", "anchor", *(F.when(F.col(c) == "", "none").otherwise(F.col(c)).alias(c) for c in ("alike", "opposite")))


@query(SHAPE_SQL + "SELECT cmp.sample, cmp.a, cmp.b, against AND v.std > w.std AS yes FROM cmp JOIN a v ON v.sid = cmp.a JOIN a w ON w.sid = cmp.b WHERE cmp.a < cmp.b")
def anti_judgment(spark, sf_dir):
    """Whether two channels go against each other and the first is the less steady one."""
    s = shapes(spark, sf_dir).join(channels(spark, sf_dir).select("sid", "std"), "sid")
    return pairs(s).select("x.sample", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), (goes_with(F.col("x.shape"), F.col("y.shape"), against=True) & (F.col("x.std") > F.col("y.std"))).alias("yes"))


NEAR_SQL = CHANNEL_SQL + f", nr AS (SELECT sid // {WIDTH} AS sample, sid, coalesce(bool_or(abs(pos - 20) <= 2), false) AS near FROM (SELECT DISTINCT sid FROM s) LEFT JOIN ev USING (sid) GROUP BY sid) "


def near(spark: SparkSession, sf_dir: str, point: int, tolerance: int) -> DataFrame:
    """(sample, sid, near): whether a channel has an event near a point; one aggregation, channels without one too."""
    hit = (F.col("event_type") == "error") & (F.abs(POS() - point) <= tolerance)
    return series(spark, sf_dir).groupBy("sid").agg(F.some(hit).alias("near")).withColumn("sample", F.floor(F.col("sid") / WIDTH))


@query(NEAR_SQL + "SELECT x.sample, x.sid AS a, y.sid AS b, x.near AND y.near AS correlated FROM nr x JOIN nr y ON x.sample = y.sample AND x.sid < y.sid")
def local_correlation(spark, sf_dir, point: int = 20, tolerance: int = 2):
    """Whether both channels have an event near the point."""
    return pairs(near(spark, sf_dir, point, tolerance)).selectExpr("x.sample", "x.sid AS a", "y.sid AS b", "x.near AND y.near AS correlated")


@query(NEAR_SQL + "SELECT sample, coalesce(string_agg(sid::VARCHAR, ', ' ORDER BY sid) FILTER (near), 'none') AS members FROM nr GROUP BY sample")
def local_clustering(spark, sf_dir, point: int = 20, tolerance: int = 2):
    """The channels with an event near the point."""
    m = near(spark, sf_dir, point, tolerance).groupBy("sample").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("near"), F.col("sid")))), ", ").alias("m"))
    return m.select("sample", F.when(F.col("m") == "", "none").otherwise(F.col("m")).alias("members"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k, event_type || ' of ' || printf('%.2f', value) AS property FROM events")
def local_property(spark, sf_dir):
    """A parameter of an event, read from its map, and the event in words."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string,int>"))
    return e.select("event_id", F.try_element_at("p", F.lit("k")).alias("k"), F.format_string("%s of %.2f", "event_type", "value").alias("property"))


@query(CHANNEL_SQL + """, tc AS (SELECT sample, type, count(*) AS c FROM ch2 GROUP BY ALL), dom AS (SELECT sample, min(type) AS type FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY c DESC) AS k FROM tc) WHERE k = 1 GROUP BY sample HAVING count(*) = 1),
x AS (SELECT ch2.sample, ev.sid, ev.pos FROM ev JOIN ch2 USING (sid) JOIN dom ON dom.sample = ch2.sample AND dom.type = ch2.type)
SELECT x.sample, count(DISTINCT x.sid * 100000 + x.pos) AS matched FROM x JOIN x y ON x.sample = y.sample AND x.sid <> y.sid AND abs(x.pos - y.pos) <= 2 GROUP BY x.sample""")
def corr_conditional(spark, sf_dir, tolerance: int = 2):
    """Events of channels of the sample's prevailing trend that another such channel has within the tolerance. The range
    join is one on equal stretches of positions: each event is given the stretches that it can reach."""
    ch = channels(spark, sf_dir)
    top = winners(ch.groupBy("sample", "type").agg(one().alias("c")), F.col("c"), "sample").groupBy("sample").agg(F.min("type").alias("type"), one().alias("k")).where("k = 1").drop("k")
    e = local_events(spark, sf_dir).join(ch.select("sid", "sample", "type"), "sid").join(top, ["sample", "type"]).select("sample", "sid", "pos")
    size = tolerance + 1
    x = e.withColumn("bin", F.explode(F.sequence(F.floor((POS() - tolerance) / size), F.floor((POS() + tolerance) / size))))
    y = e.select("sample", F.col("sid").alias("s2"), F.col("pos").alias("p2"), F.floor(POS() / size).alias("bin"))
    hit = x.join(y, ["sample", "bin"]).where((F.col("sid") != F.col("s2")) & (F.abs(POS() - F.col("p2")) <= tolerance))
    return hit.groupBy("sample").agg(F.countDistinct("sid", "pos").alias("matched"))
