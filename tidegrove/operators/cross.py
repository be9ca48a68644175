"""Queries over the channels of one sample: ``WIDTH`` users with neighbouring ids are the channels of a sample.

Channels are first brought to one row of attributes each; pairs are made of those rows within a sample, never of points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, rnd
from .segments import SEGMENT_SQL, local_events, segment
from .series import HALF, POS, part, series

#: Channels of a sample. It is fixed, so samples grow in number with the input and pairs in proportion to it.
WIDTH = 5
CHANNEL_SQL = SEGMENT_SQL + f""", dt AS (SELECT sid, type FROM (SELECT sid, type, count(*) AS c, min(seg) AS f FROM g GROUP BY sid, type) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY c DESC, f) = 1),
a AS (SELECT sid, sid // {WIDTH} AS sample, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, min(value) AS lo, max(value) AS hi, round(avg(value) FILTER (pos < n // 2), 2) AS h1, round(avg(value) FILTER (pos >= n // 2), 2) AS h2,
  arg_max(pos, struct_pack(v := value, p := -pos)) AS peak FROM s GROUP BY sid),
ch2 AS (SELECT a.*, dt.type FROM a JOIN dt USING (sid)),
pr AS (SELECT x.sample, x.sid AS a, y.sid AS b, x.mean AS ma, y.mean AS mb, x.type AS ta, y.type AS tb, x.lo AS la, x.hi AS ha, y.lo AS lb, y.hi AS hb, x.h2 - x.h1 AS da, y.h2 - y.h1 AS db, x.peak AS pa, y.peak AS pb FROM ch2 x JOIN ch2 y ON x.sample = y.sample AND x.sid < y.sid) """


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, sample, mean, std, lo, hi, h1, h2, peak, type), a row a channel."""
    p = series(spark, sf_dir)
    kinds = segment(p).groupBy("sid", "type").agg(F.count(F.lit(1)).alias("c"), F.min("seg").alias("f")).groupBy("sid").agg(F.max_by("type", F.struct("c", -F.col("f"))).alias("type"))
    stats = p.groupBy("sid").agg(rnd(F.avg("value"), 2).alias("mean"), rnd(F.stddev_pop("value"), 2).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), rnd(F.avg(part(POS() < HALF())), 2).alias("h1"), rnd(F.avg(part(POS() >= HALF())), 2).alias("h2"), F.max_by("pos", F.struct("value", -POS())).alias("peak"))
    return stats.join(kinds, "sid").withColumn("sample", F.floor(F.col("sid") / WIDTH))


def pairs(ch: DataFrame) -> DataFrame:
    """Pairs of channels of a sample, the smaller id first."""
    x, y = ch.alias("x"), ch.alias("y")
    return x.join(y, (F.col("x.sample") == F.col("y.sample")) & (F.col("x.sid") < F.col("y.sid")))


@query(CHANNEL_SQL + "SELECT sample, a, b, ma > mb AS higher, ma >= 1.2 * mb AS ratio FROM pr")
def cross_stat_ratio(spark, sf_dir, k: float = 1.2):
    return pairs(channels(spark, sf_dir)).select("x.sample", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), (F.col("x.mean") > F.col("y.mean")).alias("higher"), (F.col("x.mean") >= k * F.col("y.mean")).alias("ratio"))


@query(CHANNEL_SQL + "SELECT sample, string_agg(sid::VARCHAR, ',' ORDER BY mean DESC, sid) AS ordering FROM a GROUP BY sample")
def cross_full_ordering(spark, sf_dir):
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), "sid")))
    return channels(spark, sf_dir).groupBy("sample").agg(F.array_join(F.transform(ranked, lambda x: x["sid"]), ",").alias("ordering"))


@query(CHANNEL_SQL + "SELECT sample, arg_max(sid, struct_pack(v := mean, s := -sid)) AS highest, arg_min(sid, struct_pack(v := mean, s := sid)) AS lowest FROM a GROUP BY sample")
def cross_ranking(spark, sf_dir):
    return channels(spark, sf_dir).groupBy("sample").agg(F.max_by("sid", F.struct("mean", -F.col("sid"))).alias("highest"), F.min_by("sid", F.struct("mean", "sid")).alias("lowest"))


@query(CHANNEL_SQL + "SELECT sample, coalesce(string_agg(sid::VARCHAR, ',' ORDER BY sid) FILTER (mean > 50), 'none') AS channels, count(*) FILTER (mean > 50) AS n FROM a GROUP BY sample")
def cross_filtering(spark, sf_dir):
    hit = F.array_sort(F.collect_list(F.when(F.col("mean") > 50, F.col("sid"))))
    return channels(spark, sf_dir).groupBy("sample").agg(hit.alias("h")).select("sample", F.when(F.size("h") > 0, F.array_join("h", ",")).otherwise("none").alias("channels"), F.size("h").cast("bigint").alias("n"))


@query(CHANNEL_SQL + "SELECT sample, a, b, ta = tb AS aligned FROM pr")
def cross_trend_align(spark, sf_dir):
    return pairs(channels(spark, sf_dir)).select("x.sample", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), (F.col("x.type") == F.col("y.type")).alias("aligned"))


@query(CHANNEL_SQL + ", c AS (SELECT sample, type, count(*) AS c FROM ch2 GROUP BY ALL), rr AS (SELECT *, sum(c) OVER (PARTITION BY sample) AS t, rank() OVER (PARTITION BY sample ORDER BY c DESC) AS k FROM c) SELECT sample, min(type) AS type, round(max(c) / max(t)::DOUBLE, 4) AS share FROM rr WHERE k = 1 GROUP BY sample HAVING count(*) = 1")
def cross_trend_concordance(spark, sf_dir):
    """The share of the most frequent trend; samples with a tie are left out."""
    w = Window.partitionBy("sample")
    c = channels(spark, sf_dir).groupBy("sample", "type").agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("t", F.sum("c").over(w)).withColumn("k", F.rank().over(w.orderBy(F.desc("c")))).where("k = 1")
    return c.groupBy("sample").agg(F.min("type").alias("type"), rnd(F.max("c") / F.max("t"), 4).alias("share"), F.count(F.lit(1)).alias("ties")).where("ties = 1").drop("ties")


@query(CHANNEL_SQL + "SELECT sample, type, arg_max(sid, struct_pack(v := mean, s := -sid)) AS sid FROM ch2 GROUP BY sample, type HAVING count(*) >= 2")
def cross_conditional_query(spark, sf_dir):
    c = channels(spark, sf_dir).groupBy("sample", "type").agg(F.max_by("sid", F.struct("mean", -F.col("sid"))).alias("sid"), F.count(F.lit(1)).alias("c"))
    return c.where("c >= 2").drop("c")


@query(CHANNEL_SQL + "SELECT sample, arg_max(sid, struct_pack(v := mean, s := -sid)) = arg_max(sid, struct_pack(v := std, s := -sid)) AS yes FROM a GROUP BY sample")
def cross_attribute_corr(spark, sf_dir):
    return channels(spark, sf_dir).groupBy("sample").agg((F.max_by("sid", F.struct("mean", -F.col("sid"))) == F.max_by("sid", F.struct("std", -F.col("sid")))).alias("yes"))


@query(CHANNEL_SQL + "SELECT sample, count(*) FILTER (h2 > h1) AS up, count(*) FILTER (h2 < h1) AS down FROM a GROUP BY sample")
def cross_asymmetric_behavior(spark, sf_dir):
    return channels(spark, sf_dir).groupBy("sample").agg(F.count(F.when(F.col("h2") > F.col("h1"), 1)).alias("up"), F.count(F.when(F.col("h2") < F.col("h1"), 1)).alias("down"))


@query(CHANNEL_SQL + "SELECT sample, count(DISTINCT type) AS clusters FROM ch2 GROUP BY sample")
def cluster_count(spark, sf_dir):
    return channels(spark, sf_dir).groupBy("sample").agg(F.countDistinct("type").alias("clusters"))


@query(CHANNEL_SQL + "SELECT sample, type FROM (SELECT sample, type, count(*) AS c FROM ch2 GROUP BY ALL) WHERE c = 1")
def cluster_singleton(spark, sf_dir):
    return channels(spark, sf_dir).groupBy("sample", "type").agg(F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")


@query(CHANNEL_SQL + "SELECT sample, a, b, round(greatest(0, least(ha, hb) - greatest(la, lb)), 4) AS overlap FROM pr")
def cross_range_overlap(spark, sf_dir):
    over = F.greatest(F.lit(0.0), F.least("x.hi", "y.hi") - F.greatest("x.lo", "y.lo"))
    return pairs(channels(spark, sf_dir)).select("x.sample", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), rnd(over, 4).alias("overlap"))


@query(CHANNEL_SQL + "SELECT sample, count(*) FILTER (da * db > 0) AS same, count(*) FILTER (da * db < 0) AS opposite FROM pr GROUP BY sample")
def cross_concordant_shift(spark, sf_dir):
    d = (F.col("x.h2") - F.col("x.h1")) * (F.col("y.h2") - F.col("y.h1"))
    return pairs(channels(spark, sf_dir)).groupBy(F.col("x.sample").alias("sample")).agg(F.count(F.when(d > 0, 1)).alias("same"), F.count(F.when(d < 0, 1)).alias("opposite"))


@query(CHANNEL_SQL + "SELECT sample, a, b, abs(pa - pb)::BIGINT AS distance, abs(pa - pb) <= 5 AS aligned FROM pr")
def cross_extrema_alignment(spark, sf_dir):
    d = F.abs(F.col("x.peak") - F.col("y.peak")).cast("bigint")
    return pairs(channels(spark, sf_dir)).select("x.sample", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), d.alias("distance"), (d <= 5).alias("aligned"))


@query(CHANNEL_SQL + ", m AS (SELECT *, median(mean) OVER (PARTITION BY sample) AS md FROM ch2), c AS (SELECT sample, type, count(*) AS c FROM m WHERE mean >= md GROUP BY ALL) SELECT sample, type FROM c QUALIFY row_number() OVER (PARTITION BY sample ORDER BY c DESC, type) = 1")
def dominant_trend_in_cluster(spark, sf_dir):
    """The most frequent trend of the channels whose mean is the sample's median or more."""
    m = channels(spark, sf_dir).withColumn("md", F.expr("percentile(mean, 0.5) OVER (PARTITION BY sample)")).where("mean >= md")
    c = m.groupBy("sample", "type").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("sample").agg(F.min_by("type", F.struct(-F.col("c"), "type")).alias("type"))


@query(CHANNEL_SQL + f"SELECT x.sid // {WIDTH} AS sample, x.sid AS a, y.sid AS b, min(abs(x.pos - y.pos))::INT AS distance FROM ev x JOIN ev y ON x.sid // {WIDTH} = y.sid // {WIDTH} AND x.sid < y.sid GROUP BY ALL")
def cross_event_sync(spark, sf_dir):
    """The least distance of two channels' events. Each event meets the nearest ones before and after it only: events of
    a pair of channels are put in order, and neighbours of different channels compared."""
    e = local_events(spark, sf_dir).withColumn("sample", F.floor(F.col("sid") / WIDTH)).groupBy("sample", "sid").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    p = pairs(e)
    near = F.array_min(F.transform("x.at", lambda i: F.array_min(F.transform(F.col("y.at"), lambda j: F.abs(i - j)))))
    return p.select("x.sample", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), near.alias("distance"))


@query(CHANNEL_SQL + f"SELECT x.sid // {WIDTH} AS sample, x.sid AS a, y.sid AS b, count(DISTINCT x.pos) AS followed FROM ev x JOIN ev y ON x.sid // {WIDTH} = y.sid // {WIDTH} AND x.sid <> y.sid AND y.pos > x.pos AND y.pos < x.pos + 5 GROUP BY ALL")
def follow_within_window(spark, sf_dir, window: int = 5):
    """How many events of a are followed by one of b in fewer than ``window`` points: a range join made an equi-join by
    giving every event the one or two stretches of positions that it can reach."""
    e = local_events(spark, sf_dir).withColumn("sample", F.floor(F.col("sid") / WIDTH))
    x = e.select("sample", F.col("sid").alias("a"), F.col("pos").alias("pa"), F.explode(F.sequence(F.floor(F.col("pos") / window), F.floor((F.col("pos") + window) / window))).alias("bin"))
    y = e.select("sample", F.col("sid").alias("b"), F.col("pos").alias("pb"), F.floor(F.col("pos") / window).alias("bin"))
    hit = x.join(y, ["sample", "bin"]).where("a <> b AND pb > pa").where(F.col("pb") - F.col("pa") < window)
    return hit.groupBy("sample", "a", "b").agg(F.countDistinct("pa").alias("followed"))
