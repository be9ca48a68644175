"""Local changes of made series: spikes, steps, shakes and the like, added to trend, season and noise.

A shape is a list of ramps over a change's own length: each adds its height while it is passed and keeps it after, so
spikes are ramps that cancel and steps are ramps that don't. A series' few changes travel with its row, and each point
adds up its own: no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, rnd
from .generators import MADE_SQL, _made, _u, points, uniform

#: Corner points (place, height) of the upward shapes; a second name is the same upside down.
CORNERS = {
    ("upward spike", "downward spike"): [(0, 0), (0.5, 1), (1, 0)],
    ("continuous upward spike", "continuous downward spike"): [(0, 0), (0.2, 1), (0.35, 0), (0.5, 0.8), (0.65, 0), (0.8, 0.9), (1, 0)],
    ("upward convex", "downward convex"): [(0, 0), (0.2, 1), (0.8, 1), (1, 0)],
    ("sudden increase", "sudden decrease"): [(0, 0), (1, 1)],
    ("rapid rise followed by slow decline", "rapid decline followed by slow rise"): [(0, 0), (0.2, 1), (1, 0)],
    ("slow rise followed by rapid decline", "slow decline followed by rapid rise"): [(0, 0), (0.8, 1), (1, 0)],
    ("decrease after upward spike", "increase after downward spike"): [(0, 0), (0.2, 1), (0.4, 0), (1, -0.5)],
    ("increase after upward spike", "decrease after downward spike"): [(0, 0), (0.2, 1), (0.4, 0.1), (1, 0.5)],
    ("wide upward spike", "wide downward spike"): [(0, 0), (0.4, 0.3), (0.5, 1), (0.6, 0.3), (1, 0)],
}
#: A shake swings through this many radians instead.
SHAKE = 5.0
RAMPS = {name: [(a, b, sign * (h - g)) for (a, g), (b, h) in zip(c, c[1:])] for names, c in CORNERS.items() for name, sign in zip(names, (1, -1), strict=True)}
TYPES = ["shake", *RAMPS]
MOST, SHORTEST = 3, 3


def changes(made: DataFrame) -> DataFrame:
    """``made`` with an array of up to three changes (k, type, start, length, amplitude) that fit into each series."""

    def one(k: Column) -> Column:
        u = lambda name: uniform(name, "sid", k)
        kind = F.element_at(F.array(*map(F.lit, TYPES)), F.least(F.lit(len(TYPES)), 1 + F.floor(u("kind") * len(TYPES))).cast("int"))
        length = (SHORTEST + F.floor(u("length") * 0.15 * F.col("n"))).cast("int")
        return F.struct(k.alias("k"), kind.alias("type"), F.floor(u("start") * (F.col("n") - length)).cast("int").alias("start"), length.alias("length"), rnd(F.col("amplitude") * (0.5 + 2 * u("height")), 2).alias("amplitude"))

    how_many = F.least(F.lit(MOST), F.floor(uniform("changes", "sid") * (MOST + 1))).cast("int")
    return made.withColumn("changes", F.filter(F.transform(F.array(*map(F.lit, range(MOST))), one), lambda c: c["k"] < how_many))


def height(change: Column, pos: Column) -> Column:
    """What a change adds at a place."""
    x = (pos - change["start"]) / change["length"]
    ramps = F.create_map(*(v for name, rows in RAMPS.items() for v in (F.lit(name), F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(d)).alias("d")) for a, b, d in rows)))))
    ramp = lambda total, r: total + r["d"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - r["a"]) / (r["b"] - r["a"])))
    shaken = F.when(x.between(0, 1), F.sin(SHAKE * x) / 2).otherwise(0.0)
    return change["amplitude"] * F.when(change["type"] == "shake", shaken).otherwise(F.aggregate(F.try_element_at(ramps, change["type"]), F.lit(0.0), ramp))


def changed_points(made: DataFrame) -> DataFrame:
    p = points(changes(made), keep=("changes",))
    return p.select("sid", "pos", rnd(F.col("value") + F.aggregate("changes", F.lit(0.0), lambda total, c: total + height(c, F.col("pos"))), 2).alias("value"))


_kinds = ", ".join(f"'{t}'" for t in TYPES)
_ramps = ", ".join(f"('{name}', {float(a)}::DOUBLE, {float(b)}::DOUBLE, {float(d)}::DOUBLE)" for name, rows in RAMPS.items() for a, b, d in rows)
CHANGE_SQL = MADE_SQL + f""", h0 AS (SELECT *, unnest(range({MOST}))::INT AS k FROM u), h1 AS (SELECT sid, k, n, amplitude AS base, [{_kinds}][least({len(TYPES)}, 1 + floor({_u("kind", "sid", "k")} * {len(TYPES)}))::INT] AS type, ({SHORTEST} + floor({_u("length", "sid", "k")} * 0.15::DOUBLE * n))::INT AS length FROM h0 WHERE k < least({MOST}, floor({_u("changes", "sid")} * {MOST + 1}))),
cg AS (SELECT sid, k, type, length, floor({_u("start", "sid", "k")} * (n - length))::INT AS start, round(base * (0.5::DOUBLE + 2 * {_u("height", "sid", "k")}), 2) AS amplitude FROM h1), rp(type, x0, x1, dy) AS (VALUES {_ramps}) """


@query(CHANGE_SQL + "SELECT sid, k, type, start, length, amplitude FROM cg")
def gen_local_changes(spark, sf_dir):
    return changes(_made(spark, sf_dir)).select("sid", F.inline("changes")).select("sid", "k", "type", "start", "length", "amplitude")


@query(CHANGE_SQL + f""", ad AS (SELECT v.sid, v.pos, sum(cg.amplitude * CASE WHEN cg.type = 'shake' THEN CASE WHEN pos BETWEEN start AND start + length THEN sin({SHAKE} * (pos - start) / length::DOUBLE) / 2 ELSE 0 END ELSE (SELECT sum(dy * greatest(0, least(1, ((pos - start) / length::DOUBLE - x0) / (x1 - x0)))) FROM rp WHERE rp.type = cg.type) END) AS x FROM v JOIN cg ON cg.sid = v.sid GROUP BY ALL)
SELECT v.sid, v.pos, round(v.value + coalesce(x, 0), 2) AS value FROM v LEFT JOIN ad USING (sid, pos)""")
def gen_changed_series(spark, sf_dir):
    return changed_points(_made(spark, sf_dir))


@query(CHANGE_SQL + "SELECT type, count(*) AS n, round(avg(length), 4) AS length, round(avg(amplitude), 4) AS amplitude FROM cg GROUP BY type")
def gen_change_mix(spark, sf_dir):
    """How often each type is drawn, and its mean length and amplitude."""
    c = changes(_made(spark, sf_dir)).select(F.inline("changes"))
    return c.groupBy("type").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("length"), 4).alias("length"), rnd(F.avg("amplitude"), 4).alias("amplitude"))
