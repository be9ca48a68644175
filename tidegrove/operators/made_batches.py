"""More made series: smooth and many-phased trends, batches that agree or disagree with an anchor, and sets that are extended
until they have what was asked for. All draws are digests, as in ``generators``; all points are expressions of their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table
from .generators import _u, spread, uniform

KNOTS, STEP = 6, 12
ID_SQL = "WITH i AS (SELECT s_suppkey AS sid FROM supplier) "


def knots(ids: DataFrame) -> DataFrame:
    """(sid, y): heights of ``KNOTS`` equally spaced points between which a trend runs."""
    return ids.select("sid", F.transform(F.sequence(F.lit(0), F.lit(KNOTS - 1)), lambda k: rnd(100 * uniform("knot", "sid", k), 2)).alias("y"))


def slopes(y: Column) -> Column:
    """The slopes of a curve through equally spaced points that never overshoots: the harmonic mean of the neighbouring
    differences where they have one sign, else 0; at the ends the three-point slope, held to the sign and to three times the
    outer difference."""
    d = F.transform(F.sequence(F.lit(0), F.size(y) - 2), lambda k: F.get(y, k + 1) - F.get(y, k))
    inner = lambda a, b: F.when((a * b) <= 0, 0.0).otherwise(2 * a * b / (a + b))

    def end(a: Column, b: Column) -> Column:
        s = (3 * a - b) / 2
        return F.when(s * a <= 0, 0.0).when((a * b <= 0) & (F.abs(s) > 3 * F.abs(a)), 3 * a).otherwise(s)

    def all_of(d: Column) -> Column:
        n = F.size(d)
        mid = F.transform(F.sequence(F.lit(1), n - 1), lambda k: inner(F.get(d, k - 1), F.get(d, k)))
        return F.concat(F.array(end(d[0], d[1])), mid, F.array(end(F.element_at(d, -1), F.element_at(d, -2))))

    return F.transform(F.array(d), all_of)[0]


def curve(made: DataFrame, smooth: Column) -> DataFrame:
    """(sid, pos, value): the curve through the knots at every ``STEP``-th part of the way; not smooth: straight lines."""
    p = made.withColumn("m", slopes(F.col("y"))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit((KNOTS - 1) * STEP))))
    k = F.least(F.floor(F.col("pos") / STEP), F.lit(KNOTS - 2)).cast("int")
    t = F.col("pos") / STEP - k
    a, b, ma, mb = F.get("y", k), F.get("y", k + 1), F.get("m", k), F.get("m", k + 1)
    bent = (2 * t * t * t - 3 * t * t + 1) * a + (t * t * t - 2 * t * t + t) * ma + (3 * t * t - 2 * t * t * t) * b + (t * t * t - t * t) * mb
    return p.select("sid", "pos", rnd(F.when(smooth, bent).otherwise(a + (b - a) * t), 4).alias("value"))


_knot = lambda k: f"round(100 * {_u('knot', 'sid', str(k))}, 2)"
CURVE_SQL = ID_SQL + f""", y AS (SELECT sid, [{', '.join(_knot(k) for k in range(KNOTS))}] AS y FROM i), d AS (SELECT *, list_transform(range(1, {KNOTS}), lambda k: y[k + 1] - y[k]) AS d FROM y),
e AS (SELECT *, (3 * d[1] - d[2]) / 2 AS s0, (3 * d[{KNOTS - 1}] - d[{KNOTS - 2}]) / 2 AS s1 FROM d),
m AS (SELECT *, list_concat([CASE WHEN s0 * d[1] <= 0 THEN 0 WHEN d[1] * d[2] <= 0 AND abs(s0) > 3 * abs(d[1]) THEN 3 * d[1] ELSE s0 END], list_transform(range(2, {KNOTS}), lambda k: CASE WHEN d[k - 1] * d[k] <= 0 THEN 0 ELSE 2 * d[k - 1] * d[k] / (d[k - 1] + d[k]) END), [CASE WHEN s1 * d[{KNOTS - 1}] <= 0 THEN 0 WHEN d[{KNOTS - 1}] * d[{KNOTS - 2}] <= 0 AND abs(s1) > 3 * abs(d[{KNOTS - 1}]) THEN 3 * d[{KNOTS - 1}] ELSE s1 END]) AS m FROM e),
p AS (SELECT sid, y, m, unnest(range({(KNOTS - 1) * STEP + 1}))::INT AS pos FROM m), q AS (SELECT *, least(pos // {STEP}, {KNOTS - 2}) + 1 AS k, pos / {STEP}::DOUBLE - least(pos // {STEP}, {KNOTS - 2}) AS t FROM p) """


@query(CURVE_SQL + "SELECT sid, pos, round(CASE WHEN sid % 10 > 0 THEN (2*t*t*t - 3*t*t + 1) * y[k] + (t*t*t - 2*t*t + t) * m[k] + (3*t*t - 2*t*t*t) * y[k + 1] + (t*t*t - t*t) * m[k + 1] ELSE y[k] + (y[k + 1] - y[k]) * t END, 4) AS value FROM q")
def gen_curve(spark, sf_dir):
    """Smooth curves through drawn heights; one in ten is of straight lines."""
    ids = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid")))
    return curve(knots(ids), F.col("sid") % 10 > 0)


@query(CURVE_SQL + f"SELECT sid, (k - 1)::BIGINT AS phase, CASE WHEN abs(y[k + 1] - y[k]) < 10 THEN 'keep steady' WHEN y[k + 1] > y[k] THEN 'increase' ELSE 'decrease' END AS type, ((k - 1) * {STEP})::BIGINT AS start, (k * {STEP})::BIGINT AS stop FROM (SELECT DISTINCT sid, k, y FROM q)")
def gen_trend_phases(spark, sf_dir):
    """The phases of trends with several: type, start and stop."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"))
    k = knots(ids).select("sid", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(KNOTS - 2).cast("bigint"))).alias("phase"))
    a, b = F.get("y", F.col("phase").cast("int")), F.get("y", (F.col("phase") + 1).cast("int"))
    kind = F.when(F.abs(b - a) < 10, "keep steady").when(b > a, "increase").otherwise("decrease")
    return k.select("sid", "phase", kind.alias("type"), (F.col("phase") * STEP).alias("start"), ((F.col("phase") + 1) * STEP).alias("stop"))


#: Channels of a made sample: the anchor, some like it, some against it, the rest of their own.
ALIKE, AGAINST, OTHERS = 2, 1, 2


def batches(anchors: DataFrame) -> DataFrame:
    """(sid, channel, relation, pos, value) of samples around the anchors in (sid, y): channels that go the anchor's way at
    their own height and scale, channels that go against it, and channels with knots of their own."""
    relation = F.when(F.col("channel") == 0, "anchor").when(F.col("channel") <= ALIKE, "positive").when(F.col("channel") <= ALIKE + AGAINST, "opposite").otherwise("negative")
    c = anchors.select("sid", "y", F.explode(F.sequence(F.lit(0), F.lit(ALIKE + AGAINST + OTHERS))).alias("channel")).withColumn("relation", relation)
    scale, level = 0.5 + uniform("scale", "sid", F.col("channel")), 50 * uniform("level", "sid", F.col("channel"))
    own = lambda k: 100 * uniform("own", "sid", F.col("channel"), k)
    y = F.transform("y", lambda v, k: rnd(F.when(F.col("relation") == "anchor", v).when(F.col("relation") == "positive", level + scale * v).when(F.col("relation") == "opposite", level + scale * (100 - v)).otherwise(own(k)), 2))
    p = c.withColumn("y", y).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit((KNOTS - 1) * STEP))))
    k = F.least(F.floor(F.col("pos") / STEP), F.lit(KNOTS - 2)).cast("int")
    a, b = F.get("y", k), F.get("y", k + 1)
    return p.select("sid", "channel", "relation", "pos", rnd(a + (b - a) * (F.col("pos") / STEP - k), 4).alias("value"))


_scale, _level = f"(0.5 + {_u('scale', 'sid', 'channel')})", f"(50 * {_u('level', 'sid', 'channel')})"


@query(ID_SQL + f""", c AS (SELECT sid, unnest(range({ALIKE + AGAINST + OTHERS + 1}))::INT AS channel FROM i), r AS (SELECT *, CASE WHEN channel = 0 THEN 'anchor' WHEN channel <= {ALIKE} THEN 'positive' WHEN channel <= {ALIKE + AGAINST} THEN 'opposite' ELSE 'negative' END AS relation FROM c),
k AS (SELECT *, unnest(range({KNOTS}))::INT AS k FROM r), y AS (SELECT *, round(100 * {_u('knot', 'sid', 'k')}, 2) AS v FROM k), z AS (SELECT *, round(CASE relation WHEN 'anchor' THEN v WHEN 'positive' THEN {_level} + {_scale} * v WHEN 'opposite' THEN {_level} + {_scale} * (100 - v) ELSE 100 * {_u('own', 'sid', 'channel', 'k')} END, 2) AS y FROM y),
l AS (SELECT *, lead(y) OVER (PARTITION BY sid, channel ORDER BY k) AS y2 FROM z), p AS (SELECT *, unnest(range({STEP + 1}))::INT AS t FROM l WHERE y2 IS NOT NULL)
SELECT sid, channel, relation, (k * {STEP} + t)::INT AS pos, round(y + (y2 - y) * (t / {STEP}::DOUBLE), 4) AS value FROM p WHERE t < {STEP} OR k = {KNOTS - 2}""")
def gen_mts_batches(spark, sf_dir):
    ids = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid")))
    return batches(knots(ids))


@query("WITH c AS (SELECT range AS sid FROM range(140)), l AS (SELECT sid, (16 + floor(" + _u("extend", "sid") + " * 97))::INT AS n FROM c), k AS (SELECT *, CASE WHEN n <= 48 THEN 'short' WHEN n <= 80 THEN 'middle' ELSE 'long' END AS bucket FROM l WHERE n >= 24) SELECT sid, n, bucket FROM k QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY sid) <= 33")
def length_extension(spark, sf_dir, wanted: int = 100, over: float = 1.4, shortest: int = 24):
    """Lengths for as many new series as are wanted: more are drawn than needed, short ones dropped, and each class of lengths
    gets an equal share."""
    ids = spark.range(int(wanted * over)).withColumnRenamed("id", "sid")
    n = (16 + F.floor(uniform("extend", "sid") * 97)).cast("int")
    k = ids.withColumn("n", n).where(F.col("n") >= shortest).withColumn("bucket", F.when(F.col("n") <= 48, "short").when(F.col("n") <= 80, "middle").otherwise("long"))
    first = F.row_number().over(Window.partitionBy("bucket").orderBy("sid"))  # of the rows that are wanted, not of a table
    return k.withColumn("r", first).where(F.col("r") <= wanted // 3).drop("r")


@query("WITH q AS (SELECT n_nationkey AS sid, 3 AS n, least(3, 1 + floor(" + _u("one-of", "n_nationkey") + " * 3))::INT AS k FROM nation) SELECT sid, k AS picked, 'question ' || k || ' on <|prompt0|>' AS question FROM q")
def select_single_qa(spark, sf_dir):
    """One of the questions of each sample, its places numbered from 0 again."""
    ids = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sid"))
    asked = F.array(*(F.lit(f"question {k} on <|prompt{k + 4}|>") for k in (1, 2, 3)))
    k = F.least(F.lit(3), 1 + F.floor(uniform("one-of", "sid") * 3)).cast("int")
    return ids.select("sid", k.alias("picked"), F.regexp_replace(F.element_at(asked, k), r"<\|prompt[0-9]+\|>", "<|prompt0|>").alias("question"))


@query("WITH m AS (SELECT p_partkey AS id, p_brand AS cluster, (p_partkey % 2147483648 * 2654435761 + 42) % 4294967296 AS h FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY h, id) AS r FROM m), t AS (SELECT min(cluster) AS c FROM m) SELECT id, cluster, CASE WHEN cluster = c THEN 'positive' ELSE 'negative' END AS side FROM r, t WHERE (cluster = c AND r <= 4) OR (cluster <> c AND r = 1)")
def select_metric_clusters(spark, sf_dir, positive: int = 4):
    """Some measures of one named cluster, and one of every other."""
    from .sampling import order_key, ranked

    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster")).withColumn("h", order_key("id"))
    c = m.agg(F.min("cluster").alias("c"))
    own = F.col("cluster") == F.col("c")
    r = ranked(m, "cluster", key="id").join(F.broadcast(c))  # one row
    return r.where((own & (F.col("r") <= positive)) | (~own & (F.col("r") == 1))).select("id", "cluster", F.when(own, "positive").otherwise("negative").alias("side"))
