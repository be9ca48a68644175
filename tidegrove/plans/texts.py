"""Questions, reasoning and answers in words, for series whose answers are known.

Texts are expressions over one row a series: a template is picked by a digest of the series and the kind of question,
its {fields} are filled in, and the reasoning is the data, a line of ===, the steps, and the answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.reasoning import half_comparison
from ..operators.generators import _u, uniform
from ..operators.series import HALF, POS, SERIES_SQL, part, series
from ..registry import query, rnd

#: Templates by kind of question.
TEMPLATES = {
    "mean": ["What is the mean of {metric}?", "Over all {n} points, what does {metric} average?", "Give the average value of {metric}."],
    "halves": ["Is the first half of {metric} higher than the second on average?", "Does {metric} have the larger mean before point {mid}?"],
    "range": ["How far apart are the largest and smallest value of {metric}?", "What range does {metric} cover over its {n} points?"],
    "largest": ["What is the largest value of {metric}?", "How high does {metric} rise?"],
    "smallest": ["What is the smallest value of {metric}?", "How low does {metric} fall?"],
    "level": ["Does {metric} lie above 50 on average?", "Over its {n} points, is the mean of {metric} over 50?"],
    "change": ["By how much do the means of the two halves of {metric} differ?", "How far does the mean of {metric} move at point {mid}?"],
}


def pick(kind: str, options: list[str]) -> Column:
    """One of the options, by a digest of the series."""
    at = F.least(F.lit(len(options)), 1 + F.floor(uniform(f"text-{kind}", "sid") * len(options))).cast("int")
    return F.element_at(F.array(*map(F.lit, options)), at)


def fill(template: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def compared(a: Column, b: Column) -> Column:
    """"a > b" in two decimals, with a sign that is right for the numbers as they are shown."""
    x, y = rnd(a, 2), rnd(b, 2)
    return F.format_string("%.2f %s %.2f", x, F.when(x > y, ">").when(x < y, "<").otherwise("="), y)


def thought(data: Column, *steps: Column, answer: Column) -> Column:
    return F.concat_ws("\n", F.lit("<think>"), data, F.lit("==="), *steps, F.concat(F.lit("answer: "), answer), F.lit("</think>"))


def _choice(kind: str) -> str:
    options = TEMPLATES[kind]
    return f"[{', '.join(repr(t) for t in options)}][least({len(options)}, 1 + floor({_u('text-' + kind, 'sid')} * {len(options)}))::INT]"


TEXT_SQL = SERIES_SQL + ", t AS (SELECT sid, any_value(n) AS n, any_value(n) // 2 AS mid, round(avg(value), 2) AS mean, round(max(value), 2) AS hi, round(min(value), 2) AS lo, round(max(value) - min(value), 2) AS r, round(avg(value) FILTER (pos < n // 2), 2) AS h1, round(avg(value) FILTER (pos >= n // 2), 2) AS h2 FROM s GROUP BY sid) "


def _rows(spark, sf_dir):
    p = series(spark, sf_dir).groupBy("sid").agg(F.max("n").alias("n"), rnd(F.avg("value"), 2).alias("mean"), rnd(F.max("value"), 2).alias("hi"), rnd(F.min("value"), 2).alias("lo"), rnd(F.max("value") - F.min("value"), 2).alias("r"), rnd(F.avg(part(POS() < HALF())), 2).alias("h1"), rnd(F.avg(part(POS() >= HALF())), 2).alias("h2"))
    return p.withColumn("mid", HALF())


@query(TEXT_SQL + "SELECT sid, kind, replace(replace(replace(q, '{metric}', 'metric ' || sid), '{n}', n::VARCHAR), '{mid}', mid::VARCHAR) AS question, answer FROM (" + " UNION ALL ".join(f"SELECT sid, n, mid, '{k}' AS kind, {_choice(k)} AS q, {a} AS answer FROM t" for k, a in (("mean", "printf('%.2f', mean)"), ("halves", "CASE WHEN h1 > h2 THEN 'yes' ELSE 'no' END"), ("range", "printf('%.2f', r)"), ("largest", "printf('%.2f', hi)"), ("smallest", "printf('%.2f', lo)"), ("level", "CASE WHEN mean > 50 THEN 'yes' ELSE 'no' END"), ("change", "printf('%.2f', round(abs(h1 - h2), 2))"))) + ")")
def made_questions(spark, sf_dir):
    """A question of each kind about each series, with its answer."""
    t = _rows(spark, sf_dir)
    fields = {"metric": F.concat(F.lit("metric "), F.col("sid")), "n": F.col("n"), "mid": F.col("mid")}
    answers = {"mean": F.format_string("%.2f", "mean"), "halves": F.when(F.col("h1") > F.col("h2"), "yes").otherwise("no"), "range": F.format_string("%.2f", "r"), "largest": F.format_string("%.2f", "hi"), "smallest": F.format_string("%.2f", "lo"), "level": F.when(F.col("mean") > 50, "yes").otherwise("no"), "change": F.format_string("%.2f", rnd(F.abs(F.col("h1") - F.col("h2")), 2))}
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), fill(pick(k, v), fields).alias("question"), answers[k].alias("answer")) for k, v in TEMPLATES.items()))
    return t.select("sid", F.inline(rows))


@query(TEXT_SQL + "SELECT sid, '<think>' || chr(10) || 'first_half_mean=' || printf('%.2f', h1) || ' second_half_mean=' || printf('%.2f', h2) || chr(10) || '===' || chr(10) || 'halves: ' || printf('%.2f', h1) || ' ' || CASE WHEN h1 > h2 THEN '>' WHEN h1 < h2 THEN '<' ELSE '=' END || ' ' || printf('%.2f', h2) || chr(10) || 'answer: ' || CASE WHEN h1 > h2 THEN 'first half' WHEN h1 < h2 THEN 'second half' ELSE 'equal' END || chr(10) || '</think>' AS thought, 1.0::DOUBLE AS coherency FROM t")
def made_thoughts(spark, sf_dir):
    """Reasoning about the halves of each series; it must agree with itself."""
    a, b = F.col("h1"), F.col("h2")
    said = F.when(a > b, "first half").when(a < b, "second half").otherwise("equal")
    text = thought(F.format_string("first_half_mean=%.2f second_half_mean=%.2f", a, b), F.concat(F.lit("halves: "), compared(a, b)), answer=said)
    return _rows(spark, sf_dir).select("sid", text.alias("thought")).withColumn("coherency", half_comparison(F.col("thought")))


@query(TEXT_SQL + "SELECT sid, kind, '<think>' || chr(10) || data || chr(10) || '===' || chr(10) || step || chr(10) || 'answer: ' || answer || chr(10) || '</think>' AS thought FROM (SELECT sid, 'range' AS kind, 'max=' || printf('%.2f', hi) || ' min=' || printf('%.2f', lo) AS data, printf('%.2f', hi) || ' - ' || printf('%.2f', lo) || ' = ' || printf('%.2f', r) AS step, printf('%.2f', r) AS answer FROM t UNION ALL SELECT sid, 'level', 'mean=' || printf('%.2f', mean), printf('%.2f', mean) || ' ' || CASE WHEN mean > 50 THEN '>' WHEN mean < 50 THEN '<' ELSE '=' END || ' 50.00 -> ' || CASE WHEN mean > 50 THEN 'met' ELSE 'not met' END, CASE WHEN mean > 50 THEN 'yes' ELSE 'no' END FROM t UNION ALL SELECT sid, 'change', 'first_half_mean=' || printf('%.2f', h1) || ' second_half_mean=' || printf('%.2f', h2), '|' || printf('%.2f', h1) || ' - ' || printf('%.2f', h2) || '| = ' || printf('%.2f', round(abs(h1 - h2), 2)), printf('%.2f', round(abs(h1 - h2), 2)) FROM t)")
def made_reasoning(spark, sf_dir):
    """Data, steps and answer in words for three kinds of questions."""
    two = lambda c: F.format_string("%.2f", c)
    change = rnd(F.abs(F.col("h1") - F.col("h2")), 2)
    over = F.col("mean") > 50
    kinds = {
        "range": thought(F.format_string("max=%.2f min=%.2f", "hi", "lo"), F.format_string("%.2f - %.2f = %.2f", "hi", "lo", "r"), answer=two("r")),
        "level": thought(F.concat(F.lit("mean="), two("mean")), F.concat(compared(F.col("mean"), F.lit(50.0)), F.lit(" -> "), F.when(over, "met").otherwise("not met")), answer=F.when(over, "yes").otherwise("no")),
        "change": thought(F.format_string("first_half_mean=%.2f second_half_mean=%.2f", "h1", "h2"), F.format_string("|%.2f - %.2f| = %.2f", F.col("h1"), F.col("h2"), change), answer=two(change)),
    }
    return _rows(spark, sf_dir).select("sid", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("thought")) for k, t in kinds.items()))))
