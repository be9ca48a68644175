"""Scores of answers put together from their parts: a verdict, agreement with listed checks, consistency, evidence.

All are column functions, so a whole answer is scored in one projection. Absent parts are null; a truth without checks
counts as agreed with, and a missing answer takes the floor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query, rnd, table
from .text import FLOOR, set_f1

# Weights of verdict, coherency, verification and evidence by family, and the cap of a wrong verdict.
WEIGHTS = {"verdict": (0.55, 0.05, 0.15, 0.25), "anti_judgment": (0.60, 0.05, 0.20, 0.15), "enumeration": (0.65, 0.0, 0.0, 0.35)}
WRONG_CAP = 0.10


def weighted(family: str, verdict: Column, coherency: Column, verification: Column, evidence: Column, capped: bool = True) -> Column:
    """The weighted sum; capped: a verdict that is not fully right holds it under the cap."""
    total = sum((F.lit(w) * part for w, part in zip(WEIGHTS[family], (verdict, coherency, verification, evidence), strict=True)), F.lit(0.0))
    return F.when(verdict < 1, F.least(total, F.lit(WRONG_CAP))).otherwise(total) if capped else total


def clamped(score: Column) -> Column:
    """Into 0 to 1; null and NaN are 0."""
    return F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def members(text: Column) -> Column:
    """The distinct, trimmed members of a comma-separated list."""
    return F.array_distinct(F.transform(F.split(text, ","), lambda x: F.trim(x)))  # a function of two would be given the place too


def set_verdict(predicted: Column, truth: Column) -> Column:
    """F1 of two arrays, less a tenth for every member too many, half at most."""
    extra = F.size(F.array_distinct(predicted)) - F.size(F.array_distinct(truth))
    one_empty = (F.size(truth) == 0) != (F.size(predicted) == 0)
    return F.when(predicted.isNull(), FLOOR).when(one_empty, 0.0).otherwise(set_f1(predicted, truth) * F.when(extra > 0, F.greatest(F.lit(0.5), 1 - 0.1 * extra)).otherwise(1.0))


def enumeration_verdict(predicted: Column, truth: Column) -> Column:
    """Equal texts, or numbers within 0.01, or the F1 of lists."""
    p, g = (F.try_to_number(x, F.lit("S9999999999.999999")).cast("double") for x in (predicted, truth))
    lists = predicted.contains(",") | truth.contains(",")
    return F.when(truth.isNull(), 1.0).when(predicted.isNull(), FLOOR).when(predicted == truth, 1.0).when(F.abs(p - g) < 0.01, 1.0).when(lists, set_f1(members(predicted), members(truth))).otherwise(0.0)


def consistency(violations: Column) -> Column:
    """A tenth for every violation, 0.7 at least."""
    return F.greatest(F.lit(0.7), 1 - 0.1 * violations)


def evidence(parts: list[Column], violations: Column) -> Column:
    """The mean of the parts that are there, times the consistency; 1 where the truth has no part."""
    there = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(there) == 0, 1.0).otherwise(F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there) * consistency(violations))


def agreement(predicted: Column, truth: Column) -> Column:
    """The share of the truth's map entries that the predicted map has alike; 1 for an empty truth."""
    same = F.filter(F.map_entries(truth), lambda e: F.coalesce(F.try_element_at(predicted, e["key"]) == e["value"], F.lit(False)))
    return F.when(F.coalesce(F.size(truth), F.lit(0)) <= 0, 1.0).otherwise(F.size(same) / F.size(truth))


def choice(predicted: Column, truth: Column) -> Column:
    """A letter A to D."""
    p, g = (F.upper(F.nullif(F.regexp_extract(x, r"(?i)\b([A-D])\b", 1), F.lit(""))) for x in (predicted, truth))
    return F.when(g.isNull(), 1.0).when(p.isNull(), 0.0).when(p == g, 1.0).otherwise(FLOOR)


WORDS_SQL = "WITH w AS (SELECT c.conv_id, c.turn, list_distinct(regexp_extract_all(c.text, '[a-z]+')) AS a, list_distinct(regexp_extract_all(d.text, '[a-z]+')) AS b FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1) "


@query(WORDS_SQL + "SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) * CASE WHEN len(b) > len(a) THEN greatest(0.5, 1 - 0.1 * (len(b) - len(a))) ELSE 1 END END, 4) AS score FROM w")
def set_verdict_of_replies(spark, sf_dir):
    """Each turn's words are the truth, the next turn's the prediction."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([a-z]+)")).alias("w"))
    d = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(d, ["conv_id", "turn"]).select("conv_id", "turn", rnd(set_verdict(F.col("v"), F.col("w")), 4).alias("score"))


@query("SELECT l_orderkey AS g, l_linenumber AS i, l_partkey AS p, CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE CASE WHEN l_returnflag = l_linestatus THEN 1.0 ELSE round(2 / 3.0, 4) END END::DOUBLE AS score FROM lineitem")
def score_enumerations(spark, sf_dir):
    """Answers that are equal, numbers close by, numbers that are not, and lists of which one has a member more."""
    k, q = F.col("l_linenumber") % 4, F.format_string("%d", F.col("l_quantity").cast("int"))
    pair = F.concat_ws(", ", "l_returnflag", "l_linestatus")
    said = F.when(k == 0, q).when(k == 1, F.concat(q, F.lit(".004"))).when(k == 2, F.concat(q, F.lit(".5"))).otherwise(pair)
    truth = F.when(k == 3, F.concat(F.col("l_linestatus"), F.when(F.col("l_returnflag") == F.col("l_linestatus"), ", ").otherwise(""))).otherwise(q)
    truth = F.when((k == 3) & (F.col("l_returnflag") == F.col("l_linestatus")), pair).otherwise(truth)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), rnd(enumeration_verdict(said, truth), 4).alias("score"))


@query("""WITH m AS (SELECT l_orderkey AS g, l_linenumber AS i, bool_or(l_discount > 0.05) AS t, bool_or(l_tax > 0.04) AS p FROM lineitem GROUP BY ALL),
    a AS (SELECT g, avg((t = p)::INT) AS v, count(*) FILTER (t <> p) AS x, avg((t)::INT) AS e FROM m GROUP BY g),
    b AS (SELECT g, v, e * greatest(0.7, 1 - 0.1 * x) AS e, CASE WHEN x = 0 THEN 1.0 ELSE 0.05 END AS d FROM a)
    SELECT g, round(v, 4) AS verification, round(e, 4) AS evidence, round(CASE WHEN d < 1 THEN least(0.55 * d + 0.05 + 0.15 * v + 0.25 * e, 0.1) ELSE 0.55 * d + 0.05 + 0.15 * v + 0.25 * e END, 4) AS score,
    round(0.65 * d + 0.35 * e, 4) AS uncapped FROM b""")
def score_weighted(spark, sf_dir):
    """Order lines are an answer's checks: the discount says what is true, the tax what is predicted."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i")).agg(F.max(F.col("l_discount") > 0.05).alias("t"), F.max(F.col("l_tax") > 0.04).alias("p"))
    a = m.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", "t"))).alias("t"), F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("p"), F.count_if(F.col("t") != F.col("p")).alias("x"), F.avg(F.col("t").cast("int")).alias("e"))  # seven lines an order
    v, e, d, one = agreement(F.col("p"), F.col("t")), evidence([F.col("e"), F.lit(None).cast("double")], F.col("x")), F.when(F.col("x") == 0, 1.0).otherwise(FLOOR), F.lit(1.0)
    return a.select("g", rnd(v, 4).alias("verification"), rnd(e, 4).alias("evidence"), rnd(clamped(weighted("verdict", d, one, v, e)), 4).alias("score"), rnd(weighted("enumeration", d, one, v, e, False), 4).alias("uncapped"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.05 ELSE 0.0 END::DOUBLE AS score FROM nation")
def score_mcq(spark, sf_dir):
    said = F.when(F.col("n_nationkey") % 3 == 0, "answer: (b)").when(F.col("n_nationkey") % 3 == 1, "C").otherwise("none of these")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), choice(said, F.lit("B")).alias("score"))
