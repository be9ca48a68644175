"""Parsing and scoring of answer texts, as column functions.

Answers have a <think> block; the answer is the last "answer:" or "verdict:" line in it. Numbers that can't be read are
null; a truth that can't be read scores 1, a missing answer 0, and a wrong one the floor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query, rnd, table

FLOOR = 0.05
NUMBER = r"(-?[0-9]+\.?[0-9]*)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null. The text, which may be a long expression, is worked out once."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def behind(text: Column, mark: str) -> Column:
    """What comes after the first mark, or null. Without a pattern, as texts are long and marks are plain."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(mark)), F.substr(t, F.locate(mark, t) + len(mark))))


def think(text: Column) -> Column:
    """The first block; of many tags that are not closed each is read once."""
    return let(behind(text, "<think>"), lambda t: F.when(F.contains(t, F.lit("</think>")), F.trim(F.substring_index(t, "</think>", 1))))


def without_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def answer_line(text: Column) -> Column:
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?im)^(?:answer|verdict):[ \t]*(.+)$"), 1), F.lit(-1)))


def first_number(text: Column) -> Column:
    return found(text, NUMBER).cast("double")


def normal_answer(text: Column) -> Column:
    """Lower case, without punctuation and articles, single blanks."""
    out = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\b(a|an|the)\b", " "), r"\s+", " "))


def length_bucket(n: Column) -> Column:
    return F.when(n.isNull(), "unknown").when(n <= 256, "le256").when(n <= 768, "le768").when(n <= 1536, "le1536").otherwise("gt1536")


def relative_accuracy(p: Column, g: Column) -> Column:
    return F.when(g == 0, (p == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(p - g) / F.abs(g))))


def proximity(p: Column, g: Column, k: float = 0.10) -> Column:
    return F.exp(-F.abs(p - g) / (k * F.greatest(F.abs(g), F.lit(1.0))))


def verdict_numeric(prediction: Column, truth: Column) -> Column:
    p, g = first_number(prediction), first_number(truth)
    return F.when(g.isNull(), 1.0).when(p.isNull(), 0.0).otherwise(proximity(p, g))


def verdict_binary(prediction: Column, truth: Column) -> Column:
    """yes or no at the start of an answer line."""
    p, g = (found(F.lower(F.trim(x)), r"\A(yes|no)") for x in (prediction, truth))
    return F.when(g.isNull(), 1.0).when(p.isNull(), 0.0).when(p == g, 1.0).otherwise(FLOOR)


def normal_trend(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("increas"), "increase").when(t.contains("decreas"), "decrease").when(t.contains("steady"), "keep steady")


def set_f1(a: Column, b: Column) -> Column:
    def whole(x: Column) -> Column:
        hit = F.size(F.array_intersect(x["a"], x["b"]))
        total = F.size(F.array_distinct(x["a"])) + F.size(F.array_distinct(x["b"]))
        return F.when(total == 0, 1.0).otherwise(2 * hit / total)

    return let(F.struct(a.alias("a"), b.alias("b")), whole)


def _answers(spark, sf_dir):
    """Answers made of the events: a block with two answer lines, of which the last counts."""
    e = table(spark, sf_dir, "events")
    v = F.format_string("%.2f", F.col("value"))
    made = F.concat(F.lit("<think>look at "), F.col("event_type"), F.lit("\nAnswer: 1\nverdict: "), v, F.lit("\n</think> The trend is increasing, "), F.when(F.col("user_id") % 2 == 0, "Yes").otherwise("no"))
    return e.select("event_id", made.alias("t"), F.col("value"), F.col("user_id"))


ANSWER_SQL = "WITH a AS (SELECT event_id, value, user_id, '<think>look at ' || event_type || chr(10) || 'Answer: 1' || chr(10) || 'verdict: ' || printf('%.2f', value) || chr(10) || '</think> The trend is increasing, ' || CASE WHEN user_id % 2 = 0 THEN 'Yes' ELSE 'no' END AS t FROM events) "


@query(ANSWER_SQL + "SELECT event_id, trim(regexp_extract(t, '(?s)<think>(.*?)</think>', 1), chr(10) || ' ') AS block, trim(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')) AS rest, printf('%.2f', value) AS line, round(printf('%.2f', value)::DOUBLE, 2) AS number FROM a")
def parse_answers(spark, sf_dir):
    a = _answers(spark, sf_dir)
    inner = think(F.col("t"))
    return a.select("event_id", F.btrim(inner, F.lit("\n ")).alias("block"), without_think(F.col("t")).alias("rest"), answer_line(inner).alias("line"), first_number(answer_line(inner)).alias("number"))


@query(ANSWER_SQL + "SELECT event_id, round(exp(-abs(printf('%.2f', value)::DOUBLE - 50) / (0.1 * 50)), 4) AS numeric_score, CASE WHEN user_id % 3 = 0 THEN 0.0 WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.05 END::DOUBLE AS binary_score, 'increase' AS trend, round(greatest(0, least(1, 1 - abs(printf('%.2f', value)::DOUBLE - 50) / 50)), 4) AS relative FROM a")
def score_answers(spark, sf_dir):
    a = _answers(spark, sf_dir)
    line, rest = answer_line(think(F.col("t"))), without_think(F.col("t"))
    said = F.when(F.col("user_id") % 3 == 0, "I think yes").when(F.col("user_id") % 2 == 0, " yes, it is").otherwise("not sure")
    return a.select("event_id", rnd(verdict_numeric(line, F.lit("50")), 4).alias("numeric_score"), verdict_binary(said, F.lit("Yes.")).alias("binary_score"), normal_trend(rest).alias("trend"), rnd(relative_accuracy(first_number(line), F.lit(50.0)), 4).alias("relative"))


@query("SELECT n_nationkey AS k, trim(regexp_replace(regexp_replace(lower('The ' || n_name || ', an  answer!'), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g').regexp_replace('\\s+', ' ', 'g')) AS answer FROM nation")
def normalize_answer(spark, sf_dir):
    said = F.concat(F.lit("The "), F.col("n_name"), F.lit(", an  answer!"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), normal_answer(said).alias("answer"))


@query("SELECT doc_id, CASE WHEN n_chars <= 256 THEN 'le256' WHEN n_chars <= 768 THEN 'le768' WHEN n_chars <= 1536 THEN 'le1536' ELSE 'gt1536' END AS bucket FROM documents")
def length_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", length_bucket(F.col("n_chars")).alias("bucket"))


@query("WITH w AS (SELECT c.conv_id, c.turn, list_distinct(regexp_extract_all(c.text, '[a-z]+')) AS a, list_distinct(regexp_extract_all(d.text, '[a-z]+')) AS b FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 4) AS f1 FROM w")
def set_f1_of_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([a-z]+)")).alias("w"))
    d = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(d, ["conv_id", "turn"]).select("conv_id", "turn", rnd(set_f1(F.col("w"), F.col("v")), 4).alias("f1"))
