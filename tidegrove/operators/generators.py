"""Made series: trend + season + noise, one row a point, from ids alone.

Every draw is a digest of (seed, id, what it is for), so a point is the same whichever task makes it and however often
a task is repeated, and series can be made in any partitioning without a shuffle. A series is never held whole: ids are
exploded into points, and each point is an expression of its id and place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, rnd, table

SEED = 42
#: Half of all series have the usual length, the others any from shortest to longest.
USUAL, SHORTEST, LONGEST = 64, 16, 112
#: Bounds of the noise's deviation as a share of the amplitude; changes under this share of the range are steady.
NOISE, STEADY = (0.03, 0.15), 0.10


def uniform(name: str, *parts: Column | str) -> Column:
    """A number above 0, 1 at most, that depends on the seed, the name and the parts."""
    text = F.concat_ws(":", F.lit(f"{SEED}:{name}"), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 1) / 4294967296.0


def normal(name: str, *parts: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(name + "r", *parts))) * F.cos(2 * math.pi * uniform(name + "a", *parts))


def wave(kind: Column, turn: Column) -> Column:
    """sin, square or triangle of a number of turns, between -1 and 1."""
    part = turn - F.floor(turn)
    return F.when(kind == "sin", F.sin(2 * math.pi * part)).when(kind == "square", F.when(part < 0.5, 1.0).otherwise(-1.0)).otherwise(1 - 4 * F.abs(part - 0.5))


def attributes(ids: DataFrame) -> DataFrame:
    """A row of drawn attributes for each ``sid``."""
    u = lambda name: uniform(name, "sid")
    return ids.select(
        "sid", F.when(u("usual") > 0.5, USUAL).otherwise(F.least(F.lit(LONGEST), SHORTEST + F.floor(u("len") * (LONGEST - SHORTEST + 1)))).cast("int").alias("n"),
        F.when(u("wave") < 0.6, "sin").when(u("wave") < 0.8, "square").otherwise("triangle").alias("wave"),
        F.floor(4 + 12 * u("period")).cast("int").alias("period"), rnd(1 + 9 * u("amp"), 2).alias("amplitude"),
        rnd(100 * u("from"), 2).alias("first"), rnd(100 * u("to"), 2).alias("last"), rnd(NOISE[0] + (NOISE[1] - NOISE[0]) * u("noise"), 2).alias("noise"),
    )


def spread(ids: DataFrame) -> DataFrame:
    """A table of few bytes is one task to Spark; what is made of each of its rows is work for all."""
    return ids.repartition(4 * ids.sparkSession.sparkContext.defaultParallelism)


#: Rows that one task reads and rates at most; minutes where a row takes milliseconds.
TASK_ROWS = 100_000


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of a table, ``TASK_ROWS`` a task at most, and some for each core. The scan of a table says little about its rows: a
    file has as many tasks as its bytes ask for, of which those without the start of a row group are empty. So the rows of
    each scan task are counted, from the files' footers; where too many lie in one, or in too few, all are dealt out evenly."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)), F.max("count"), F.sum("count")).first()
    tasks, most, total = held[0], held[1] or 0, held[2] or 0
    return rows if tasks >= cores and most <= TASK_ROWS else rows.repartition(max(4 * cores, -(-total // TASK_ROWS)))


def points(made: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sid, pos, value) of each series described in ``made``, and the attributes to keep."""
    p = made.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    trend = F.col("first") + (F.col("last") - F.col("first")) * F.col("pos") / (F.col("n") - 1)
    season = F.col("amplitude") * wave(F.col("wave"), F.col("pos") / F.col("period"))
    return p.select("sid", "pos", *keep, rnd(trend + season + F.col("noise") * F.col("amplitude") * normal("point", "sid", "pos"), 4).alias("value"))


def derive_trend(first: Column, last: Column, low: Column, high: Column) -> Column:
    """Steady if the change is under a tenth of the range, or there is no range."""
    diff = last - first
    return F.when((high == low) | (F.abs(diff) < STEADY * (high - low)), "keep steady").when(diff > 0, "increase").otherwise("decrease")


def _u(name: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{SEED}:{name}'", *parts])
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)"


MADE_SQL = f"""WITH u AS (SELECT p_partkey AS sid, CASE WHEN {_u("usual", "p_partkey")} > 0.5 THEN {USUAL} ELSE least({LONGEST}, {SHORTEST} + floor({_u("len", "p_partkey")} * {LONGEST - SHORTEST + 1})) END::INT AS n,
    CASE WHEN {_u("wave", "p_partkey")} < 0.6 THEN 'sin' WHEN {_u("wave", "p_partkey")} < 0.8 THEN 'square' ELSE 'triangle' END AS wave, floor(4 + 12 * {_u("period", "p_partkey")})::INT AS period,
    round(1 + 9 * {_u("amp", "p_partkey")}, 2) AS amplitude, round(100 * {_u("from", "p_partkey")}, 2) AS first, round(100 * {_u("to", "p_partkey")}, 2) AS last,
    round({NOISE[0]} + {NOISE[1] - NOISE[0]} * {_u("noise", "p_partkey")}, 2) AS noise FROM part),
    p AS (SELECT *, unnest(range(n))::INT AS pos FROM u), t AS (SELECT *, pos / period::DOUBLE - floor(pos / period::DOUBLE) AS turn FROM p),
    v AS (SELECT sid, n, first, last, pos, round(first + (last - first) * pos / (n - 1) + amplitude * CASE wave WHEN 'sin' THEN sin(2 * pi() * turn) WHEN 'square' THEN CASE WHEN turn < 0.5 THEN 1 ELSE -1 END ELSE 1 - 4 * abs(turn - 0.5) END
    + noise * amplitude * sqrt(-2 * ln({_u("pointr", "sid", "pos")})) * cos(2 * pi() * {_u("pointa", "sid", "pos")}), 4) AS value FROM t) """


def _made(spark, sf_dir):
    return attributes(spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sid"))))


@query(MADE_SQL + "SELECT sid, n, wave, period, amplitude, first, last, noise FROM u")
def gen_attributes(spark, sf_dir):
    return _made(spark, sf_dir)


@query(MADE_SQL + "SELECT sid, pos, value FROM v")
def gen_series(spark, sf_dir):
    return points(_made(spark, sf_dir))


@query(MADE_SQL + "SELECT sid, CASE WHEN max(value) = min(value) OR abs(arg_max(value, pos) - arg_min(value, pos)) < 0.1 * (max(value) - min(value)) THEN 'keep steady' WHEN arg_max(value, pos) > arg_min(value, pos) THEN 'increase' ELSE 'decrease' END AS trend, round(max(value) - min(value), 4) AS span FROM v GROUP BY sid")
def gen_trend_labels(spark, sf_dir):
    """The trend that each made series turned out to have."""
    p = points(_made(spark, sf_dir)).groupBy("sid").agg(F.min_by("value", "pos").alias("a"), F.max_by("value", "pos").alias("b"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return p.select("sid", derive_trend(F.col("a"), F.col("b"), F.col("lo"), F.col("hi")).alias("trend"), rnd(F.col("hi") - F.col("lo"), 4).alias("span"))
