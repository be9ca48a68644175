"""Scores of answers against a truth, by the kind of the question: verdict alone, or verdict with what supports it.

Both sides are texts with a <think> block. A kind belongs to one family, a family has one verdict rule. All are column
functions; an unknown kind and a truth without a block fail the job, a prediction without one scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query, rnd, table
from . import reasoning as R
from .parsing import EVENT_TEXT_SQL, _events, _said, _two, answer_set, boxed, final_answer, finite, hash_answer, last_tagged, list_verdict, measure_blocks, normal_verdict, overlong, verifications
from .scoring import WEIGHTS, WRONG_CAP, agreement, clamped, members, set_verdict, weighted
from .text import FLOOR, answer_line, found, normal_answer, proximity, relative_accuracy, set_f1, think

# The kinds of questions by the verdict that they ask for.
FAMILIES = {
    "polymorphic": ["stat_numerical", "periodicity", "change_point"],
    "categorical": ["correlation", "anticorrelation", "cross_trend_query", "segment_trend_dominance", "atomic_cross_ranking", "atomic_periodic_description", "rl_dominant_trend_type", "rl_event_type_at_pos", "rl_max_amplitude_event", "rl_segment_type_at_pos", "rl_type_of_longest", "rl_cross_conditional_query", "rl_cluster_dominant", "rl_corr_count"],
    "set": ["clustering", "anticlustering"],
    "binary": ["cross_stat_judgment", "anti_judgment", "segment_judgment", "yes_no", "atomic_cross_stat_compare", "atomic_cross_trend_align", "rl_amplitude_vs_range", "rl_amplitude_vs_std", "rl_condition_recovery", "rl_event_in_trend_type", "rl_event_near_extremum", "rl_extrema_same_half", "rl_half_mean_compare", "rl_has_periodicity", "rl_interval_comparison", "rl_max_in_first_half", "rl_max_in_trend_type", "rl_mean_shift", "rl_mean_stability", "rl_median_mean_close", "rl_monotonic_chunks", "rl_segment_mean_compare", "rl_volatility_change", "rl_cross_stat_ratio", "rl_cross_event_sync", "rl_cross_period_compare", "rl_cross_attribute_corr", "rl_corr_conditional"],
    "enumeration": ["local_enumeration", "segment_enumeration", "transition_enumeration", "event_segment_enumeration", "temporal_position", "duration_proportion", "cross_metric_enumeration", "atomic_chunked_means", "atomic_cross_filtering", "rl_cross_full_ordering"],
    "numeric": ["atomic_global_mean", "atomic_global_std", "atomic_interval_mean", "atomic_interval_std", "atomic_min_value", "atomic_max_value", "atomic_min_position", "atomic_max_position", "atomic_percentile", "atomic_event_enumeration", "atomic_trend_enumeration", "atomic_cross_counting", "rl_cycle_count", "rl_event_count", "rl_event_count_by_type", "rl_half_mean_diff", "rl_longest_segment", "rl_normalized_range", "rl_period_estimate", "rl_range", "rl_segment_count", "rl_segment_duration", "rl_type_duration_fraction", "rl_cross_trend_concordance", "rl_cluster_count", "rl_cross_asymmetric_behavior"],
    "neutral": ["description", "tsevol"],
}
#: Held-out kinds are never rewarded.
HELD_OUT = "ood_"


def _either(p: Column, g: Column, rule: Column) -> Column:
    """A truth that can't be read scores 1, a missing answer 0."""
    return F.when(g.isNull(), 1.0).when(p.isNull(), 0.0).otherwise(rule)


def numeric(p: Column, g: Column) -> Column:
    near = lambda x: F.when(x["a"].isNull() | x["b"].isNull(), 0.0).otherwise(proximity(x["a"], x["b"]))
    return _either(p, g, R.let(F.struct(finite(p).alias("a"), finite(g).alias("b")), near))


def binary(p: Column, g: Column) -> Column:
    """yes or no at the answer's start; what follows doesn't count."""
    said = F.struct(*(found(F.lower(x), r"\A(yes|no)").alias(n) for n, x in (("a", p), ("b", g))))
    return R.let(said, lambda x: _either(x["a"], x["b"], F.when(x["a"] == x["b"], 1.0).otherwise(FLOOR)))


def categorical(p: Column, g: Column) -> Column:
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"</?\w+>", "")))
    a, b = plain(p), plain(g)
    return _either(p, g, F.when(F.when(a == "steady", "keep steady").otherwise(a) == b, 1.0).otherwise(FLOOR))


def list_score(p: Column, g: Column) -> Column:
    """Proximity place by place, times the shorter length over the longer."""

    def whole(p: Column, g: Column) -> Column:
        n, m = F.size(g), F.size(p)
        total = F.aggregate(F.zip_with(F.slice(p, F.lit(1), n), F.slice(g, F.lit(1), m), lambda a, b: proximity(a, b)), F.lit(0.0), lambda a, x: a + x)
        return F.when(p.isNull() | (n == 0) | (m == 0), 0.0).otherwise(total / n * F.least(n, m) / F.greatest(n, m))

    return R.let(F.struct(p.alias("p"), g.alias("g")), lambda x: whole(x["p"], x["g"]))


def polymorphic(p: Column, g: Column) -> Column:
    """As the truth is: a list, a number, or a word."""

    def whole(p: Column, g: Column, gl: Column, gn: Column) -> Column:
        word = F.when(F.lower(F.trim(p)) == F.lower(F.trim(g)), 1.0).otherwise(FLOOR)
        number = F.coalesce(proximity(finite(p), gn), F.lit(0.0))
        return _either(p, g, F.when(gl.isNotNull(), list_score(list_verdict(p), gl)).when(gn.isNotNull(), number).otherwise(word))

    read = lambda x: F.struct(x["p"].alias("p"), x["g"].alias("g"), list_verdict(x["g"]).alias("gl"), finite(x["g"]).alias("gn"))
    return R.let(R.let(F.struct(p.alias("p"), g.alias("g")), read), lambda x: whole(x["p"], x["g"], x["gl"], x["gn"]))


def set_of(p: Column, g: Column) -> Column:
    """Of whole reasoning blocks, as the set is the first that the reasoning answers."""
    rule = lambda a, b: _either(a, b, F.when((F.size(a) == 0) != (F.size(b) == 0), 0.0).otherwise(set_f1(a, b)))
    return R.let(F.struct(answer_set(p).alias("a"), answer_set(g).alias("b")), lambda x: rule(x["a"], x["b"]))


def enumeration(p: Column, g: Column) -> Column:
    a, b = (F.lower(F.trim(x)) for x in (p, g))
    x, y = finite(a), finite(b)
    full = lambda t: F.filter(members(t), lambda v: v != "")
    lists = F.when(a.contains(",") | b.contains(","), set_f1(full(a), full(b)))
    return _either(p, g, F.when((a == b) | (F.abs(x - y) < 0.01), 1.0).otherwise(F.coalesce(lists, F.lit(0.0))))


RULES = {"polymorphic": polymorphic, "categorical": categorical, "set": set_of, "binary": binary, "enumeration": enumeration, "numeric": numeric, "neutral": lambda p, g: F.lit(0.5)}


def score(prediction: Column, truth: Column, kind: Column) -> Column:
    """0 to 1 for an answer of any kind. Blocks and answer lines are read once, whatever the number of rules."""

    def rated(x: Column) -> Column:
        out = F.when(x["g"].isNull(), F.raise_error("a truth has no reasoning block").cast("double")).when(x["p"].isNull(), 0.0).when(kind.startswith(HELD_OUT), 0.5)
        for family, rule in RULES.items():
            sides = (x["p"], x["g"]) if family == "set" else (x["a"], x["b"])
            out = out.when(kind.isin(*FAMILIES[family]), rule(*sides))
        return R.let(out.otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))).cast("double")), clamped)

    blocks = F.struct(think(prediction).alias("p"), think(truth).alias("g"))
    return R.let(R.let(blocks, lambda t: F.struct(t["p"].alias("p"), t["g"].alias("g"), answer_line(t["p"]).alias("a"), answer_line(t["g"]).alias("b"))), rated)


def _think(*parts) -> Column:
    return _said("<think>", *parts, "\n</think> done")


def _cases() -> list[tuple[str, Column, Column]]:
    """One kind of each family, what is answered to it and what is right, in terms of an event."""
    v, even, c = F.col("v"), F.col("even"), F.col("event_type")
    return [
        ("rl_range", _think("answer: ", _two(v)), _think("answer: 50")),
        ("yes_no", _think("Answer: ", F.when(even, "Yes, or no").otherwise("not so")), _think("answer: yes")),
        ("rl_has_periodicity", _think("answer: ", F.when(even, "maybe yes").otherwise("No.")), _think("answer: no")),
        ("correlation", _think("verdict: <b>", F.when(even, "Steady").otherwise("increase"), "</b>"), _think("answer: keep steady")),
        ("stat_numerical", _think("answer: [", _two(v), ", 2]"), _think("answer: [50, 2, 3]")),
        ("clustering", _think("answer: (Click, B) and (C)"), _think("answer: (", c, ", b)")),
        ("segment_enumeration", _think("answer: ", c, ", b"), _think("answer: b, click")),
        ("description", _think("anything"), _think("some text")),
        ("ood_trend_reversal", _think("answer: 1"), _think("answer: 2")),
        ("rl_segment_count", F.lit("no block"), _think("answer: 2")),
    ]


@query(EVENT_TEXT_SQL + """SELECT event_id, unnest(['rl_range', 'yes_no', 'rl_has_periodicity', 'correlation', 'stat_numerical', 'clustering', 'segment_enumeration', 'description', 'ood_trend_reversal', 'rl_segment_count']) AS kind,
 unnest([round(exp(-abs(v - 50) / 5), 4), CASE WHEN even THEN 1 ELSE 0.05 END, CASE WHEN even THEN 0 ELSE 1 END, CASE WHEN even THEN 1 ELSE 0.05 END, round((exp(-abs(v - 50) / 5) + 1) / 3 * 2 / 3, 4), CASE WHEN event_type = 'click' THEN 1 ELSE 0.5 END, CASE WHEN event_type = 'click' THEN 1 ELSE 0.5 END, 0.5, 0.5, 0.0]::DOUBLE[]) AS score FROM e""")
def compute_score(spark, sf_dir):
    e = _events(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), p.alias("p"), g.alias("g")) for k, p, g in _cases())))
    x = e.select("event_id", each.alias("x"))
    return x.select("event_id", "x.kind", rnd(score(F.col("x.p"), F.col("x.g"), F.col("x.kind")), 4).alias("score"))


@query(EVENT_TEXT_SQL + """SELECT event_id, round(exp(-abs(v - 50) / 5), 4) AS number, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.05 END::DOUBLE AS word, round((exp(-abs(v - 50) / 5) + CASE WHEN even THEN 1 ELSE 0 END) / 2 * CASE WHEN even THEN 1 ELSE 0.5 END, 4) AS list,
CASE WHEN even THEN 0.0 ELSE 1.0 END::DOUBLE AS unread FROM e""")
def verdict_polymorphic(spark, sf_dir):
    """By the truth's form: a number, a word, a list (with a member short, or with a comma at its end), and answers without one."""
    f = lambda p, g: rnd(polymorphic(p, g), 4)
    v, even, c = F.col("v"), F.col("even"), F.col("event_type")
    told = _said("about [", _two(v), F.when(even, ", 2,").otherwise(""), "]")
    return _events(spark, sf_dir).select("event_id", f(_two(v), F.lit("50")).alias("number"), f(c, F.lit("Click")).alias("word"), f(told, F.lit("[50, 2]")).alias("list"), f(F.when(even, c).otherwise("[1,2]"), F.lit("[1, 2]")).alias("unread"))


def near(p: Column, g: Column, scale: Column, k: float) -> Column:
    return F.coalesce(F.exp(-F.abs(p - g) / (k * F.greatest(F.abs(scale), F.lit(1e-6)))), F.lit(0.0))


def mean_of(parts: Column) -> Column:
    """The mean of an array's members that are there; null if none is."""
    mean = lambda there: F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    return R.let(F.filter(parts, lambda x: x.isNotNull()), mean)


def block_score(p: Column, g: Column) -> Column:
    """Of two blocks of one measure the mean over what the truth has: words equal, numbers near, statistics near."""
    part = lambda name, rule: F.when(g[name].isNotNull(), rule(p[name], g[name]))
    word = lambda a, b: F.coalesce((F.lower(a) == F.lower(b)).cast("double"), F.lit(0.0))
    value = lambda a, b: near(a, b, F.greatest(F.abs(b), F.lit(1.0)), 0.10)
    stats = mean_of(F.transform(F.map_entries(g["stats"]), lambda e: value(F.try_element_at(p["stats"], e["key"]), e["value"])))
    return mean_of(F.array(part("trend", word), *(part(n, value) for n in ("period", "amplitude", "first", "last", "noise")), stats))


def evidence_score(prediction: Column, truth: Column) -> Column:
    """Measures of the truth joined by name with those predicted: the mean of their scores, 0 for one that is missing, less a
    tenth for each that the truth has not, 0.7 of it at least. A truth without measures scores 1."""

    def whole(p: Column, g: Column) -> Column:
        each = F.transform(g, lambda b: F.coalesce(R.let(F.try_element_at(F.filter(p, lambda a: a["metric"] == b["metric"]), F.lit(1)), lambda a: F.when(a.isNotNull(), block_score(a, b))), F.lit(0.0)))
        extra = F.size(F.array_except(p["metric"], g["metric"]))
        return F.when(F.size(g) == 0, 1.0).otherwise(mean_of(each) * F.greatest(F.lit(0.7), 1 - 0.1 * extra))

    return R.let(measure_blocks(prediction), lambda p: R.let(measure_blocks(truth), lambda g: whole(p, g)))


def support(prediction: Column, truth: Column, rule, coherency, evidence: Column | None = None) -> dict[str, Column]:
    """Verdict, agreement of the reasoning with itself, comparisons and evidence, of which each family makes its score.
    ``prediction`` and ``truth`` are reasoning blocks; ``evidence`` is their score, if it is known."""
    verdict = rule(answer_line(prediction), answer_line(truth))
    return {"verdict": verdict, "coherency": coherency(prediction), "comparisons": compared(prediction, truth), "evidence": evidence_score(prediction, truth) if evidence is None else evidence}


def supported(family: str, prediction: Column, truth: Column, rule, coherency, evidence: Column | None = None) -> Column:
    """The parts of ``support`` by the family's weights; a wrong verdict holds the score under the cap."""
    parts = support(prediction, truth, rule, coherency, evidence)
    return R.let(F.struct(*(x.alias(n) for n, x in parts.items())), lambda x: weighted(family, *(x[n] for n in parts), family != "enumeration"))


def compared(prediction: Column, truth: Column) -> Column:
    """The agreement of what two reasoning blocks compare."""
    return R.let(F.struct(verifications(prediction).alias("p"), verifications(truth).alias("g")), lambda x: agreement(x["p"], x["g"]))


#: Fixed value: what an answer without a set gets for it.
NO_SET = 0.10


def supported_set(prediction: Column, truth: Column) -> Column:
    """The same for the set of a cluster: F1 of the members less a tenth for each too many; a truth without a set is empty, and a
    wrong set holds nothing under a cap."""
    none = F.array().cast("array<string>")
    verdict = R.let(F.struct(answer_set(prediction).alias("p"), F.coalesce(answer_set(truth), none).alias("g")), lambda s: F.when(s["p"].isNull(), NO_SET).otherwise(set_verdict(s["p"], s["g"])))
    return R.let(verdict, lambda v: weighted("verdict", v, R.cluster_members(prediction), compared(prediction, truth), evidence_score(prediction, truth), False))


def _block(v: Column, more: str = "") -> list:
    return ["metric: A\noverall trend=increase, start=", _two(v), ", end=2, amp=3\nstats: mean=", _two(v), more, "\n===\nvs B: ", F.when(F.col("even"), "PASS").otherwise("FAIL"), "."]


PROOF_SQL = EVENT_TEXT_SQL + ", s AS (SELECT *, (1 + exp(-abs(v - 20) / 2) + 1 + exp(-abs(v - 20) / 2)) / 4 AS ev, CASE WHEN even THEN 1 ELSE 0 END AS ver FROM e) "


@query(PROOF_SQL + "SELECT event_id, round(0.55 + 0.05 * CASE WHEN even THEN 1 ELSE 0 END + 0.15 * ver + 0.25 * ev, 4) AS pair, round(least(0.1, 0.55 * 0.05 + 0.05 * CASE WHEN even THEN 0 ELSE 1 END + 0.15 * ver + 0.25 * ev), 4) AS wrong, round(0.65 + 0.35 * ev, 4) AS enumeration, round(ev, 4) AS description FROM s")
def score_mts_verdict(spark, sf_dir):
    """Whole answers of families with evidence: a pair's verdict right and wrong, a list, a description."""
    v = F.col("v")
    right = _said("metric: A\noverall trend=increase, start=20.00, end=2, amp=3\nstats: mean=20.00\n===\nvs B: PASS.\nanswer: similar")
    told = _said(*_block(v), "\nanswer: similar")
    wrong = _said(*_block(v), "\nanswer: different")
    rule = lambda p, g: categorical(p, g)
    e = _events(spark, sf_dir).select("event_id", right.alias("g"), told.alias("p"), wrong.alias("w")).withColumn("ev", evidence_score(F.col("p"), F.col("g")))
    r = lambda x: rnd(x, 4)
    return e.select("event_id", r(supported("verdict", F.col("p"), F.col("g"), rule, R.pair_verdict, F.col("ev"))).alias("pair"), r(supported("verdict", F.col("w"), F.col("g"), rule, R.pair_verdict)).alias("wrong"), r(WEIGHTS["enumeration"][0] * enumeration(answer_line(F.col("p")), answer_line(F.col("g"))) + WEIGHTS["enumeration"][3] * F.col("ev")).alias("enumeration"), r("ev").alias("description"))


@query(PROOF_SQL + """SELECT event_id, round(0.25 * ev + CASE WHEN even THEN 0.55 + 0.05 + 0.15 WHEN event_type = 'click' THEN 0.55 * 0.72 WHEN event_type = 'view' THEN 0.55 * 0.36 + 0.05 * 0.5 WHEN event_type = 'error' THEN 0.55 * 0.1 + 0.05 * 0.5 ELSE 0.05 END, 4) AS score FROM s""")
def score_mts_set(spark, sf_dir):
    """Answers that name a cluster: the right one, one with a member too many, one with a wrong member, none, and no answer."""
    c = F.col
    checks = F.when(c("even"), "\nvs B: PASS.\nvs C: PASS.").otherwise("\nvs B: FAIL.\nvs C: FAIL.")
    said = F.when(c("even"), "(c, B)").when(c("event_type") == "click", "(B, C, D)").when(c("event_type") == "view", "(C, D, E)").otherwise("()")
    line = F.when(~c("even") & (c("event_type") == "error"), "").otherwise(F.concat(F.lit("\nanswer: "), said))
    told = _said("metric: A\noverall trend=increase, start=", _two(c("v")), ", end=2, amp=3\nstats: mean=", _two(c("v")), "\n===", checks, line)
    truth = F.lit("metric: A\noverall trend=increase, start=20.00, end=2, amp=3\nstats: mean=20.00\n===\nvs B: PASS.\nvs C: PASS.\nanswer: (B, C)")
    e = _events(spark, sf_dir).select("event_id", told.alias("p"), truth.alias("g"))
    return e.select("event_id", rnd(supported_set(c("p"), c("g")), 4).alias("score"))


@query(PROOF_SQL + "SELECT event_id, round(CASE WHEN even THEN 0.55 + 0.05 * CASE WHEN v > 50 THEN 1 ELSE 0 END + 0.15 + 0.25 ELSE least(0.1, 0.55 * 0.05 + 0.05 * CASE WHEN v > 50 THEN 0 ELSE 1 END + 0.15 + 0.25) END, 4) AS score, round(CASE WHEN even THEN 0.60 + 0.05 * CASE WHEN v > 50 THEN 1 ELSE 0 END + 0.20 + 0.15 ELSE least(0.1, 0.60 * 0.05 + 0.05 * CASE WHEN v > 50 THEN 0 ELSE 1 END + 0.20 + 0.15) END, 4) AS anti FROM s")
def score_yes_no(spark, sf_dir):
    """Yes or no with a point of comparison, and the judgment of opposite channels by its own weights."""
    text = _said("x\n===\nnearest point: ", F.when(F.col("v") > 50, "PASS.").otherwise("FAIL."), "\nanswer: ", F.when(F.col("even"), "yes").otherwise("no"))
    e = _events(spark, sf_dir).select("event_id", text.alias("p"), F.lit("x\n===\nanswer: yes").alias("g"))
    parts = support(F.col("p"), F.col("g"), binary, R.yes_or_no)
    e = e.withColumns(parts)  # both families' scores are of the same parts
    f = lambda family: rnd(weighted(family, *map(F.col, parts)), 4)
    return e.select("event_id", f("verdict").alias("score"), f("anti_judgment").alias("anti"))


@query(PROOF_SQL + "SELECT event_id, round(CASE WHEN even THEN 0.55 + 0.05 * 0.5 + 0.15 + 0.25 ELSE least(0.1, 0.55 * 0.05 + 0.05 * 0.5 + 0.15 + 0.25) END, 4) AS score FROM s")
def score_trend_dominance(spark, sf_dir):
    """The prevailing trend with the durations that it is told from; nothing to check in them is neutral."""
    text = _said("x\n===\nanswer: ", F.when(F.col("even"), "steady").otherwise("increase"))
    e = _events(spark, sf_dir).select("event_id", text.alias("p"))
    return e.select("event_id", rnd(supported("verdict", F.col("p"), F.lit("x\n===\nanswer: keep steady"), categorical, lambda p: F.lit(0.5)), 4).alias("score"))


def outcome(text: Column) -> Column:
    """met or not of a passage."""
    t = F.lower(text)
    return F.when(t.rlike(r"\bnot (all )?met\b|\bfail\b"), "not").when(t.rlike(r"\bmet\b|\bpass\b"), "met")


def labelled(text: Column, label: str) -> Column:
    """The passages behind "label 1:", "label 2:", ... up to the next label, summary or line of all conditions: a map."""
    passage = F.lit(rf"(?s)\b{label} [0-9]+:.*?(?=\b{label} [0-9]+:|all conditions:|summary:|\z)")
    cut = lambda x: F.struct(F.substr(F.substring_index(x, ":", 1), F.lit(len(label) + 2)).alias("k"), F.substr(x, F.locate(":", x) + 1).alias("v"))
    first = lambda e, keys: F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(e["v"], F.array_position(e["k"], k).cast("int")))))
    whole = lambda e: R.let(F.array_distinct(e["k"]), lambda keys: F.when(F.size(keys) == F.size(e), F.map_from_entries(e)).otherwise(first(e, keys)))
    return R.let(F.transform(F.regexp_extract_all(F.lower(text), passage, F.lit(0)), cut), whole)


def conditions_score(prediction: Column, truth: Column) -> Column:
    """Conditions of the truth, or its events: told with the same outcome 1, with another a quarter, without one a half, not
    told 0; with two or more also whether all hold, told 1, told without a result a half. A text of neither form is judged by
    its one outcome."""
    return R.let(F.struct(R.reasoning(prediction).alias("p"), R.reasoning(truth).alias("g")), lambda x: _conditions(x["p"], x["g"]))


def _conditions(p: Column, g: Column) -> Column:
    def of(label: str, closing: str, result: str, least: int) -> Column:
        def whole(mine: Column, theirs: Column) -> Column:
            alike = lambda a, b: F.when(a.isNull(), 0.5).when(b.isNull() | (a == b), 1.0).otherwise(0.25)
            told = lambda m, true: F.when(m.isNull(), 0.0).otherwise(R.let(F.struct(outcome(m).alias("a"), outcome(true).alias("b")), lambda x: alike(x["a"], x["b"])))
            each = F.transform(F.map_entries(theirs), lambda e: R.let(F.try_element_at(mine, e["key"]), lambda m: told(m, e["value"])))
            n = F.size(theirs)
            end = F.when(n >= least, F.when(F.lower(p).rlike(f"{closing}[^\\n]*{result}"), 1.0).when(F.lower(p).contains(closing), 0.5).otherwise(0.0))
            total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) + F.coalesce(end, F.lit(0.0))
            return F.when(F.coalesce(n, F.lit(0)) > 0, total / (n + F.when(n >= least, 1).otherwise(0)))

        return R.let(labelled(p, label), lambda mine: R.let(labelled(g, label), lambda theirs: whole(mine, theirs)))

    plain = R.let(F.struct(outcome(p).alias("a"), outcome(g).alias("b")), lambda x: F.when(x["a"].isNull(), 0.0).when(x["b"].isNotNull() & (x["a"] != x["b"]), 0.25).otherwise(1.0))
    return F.coalesce(of("condition", "all conditions:", r"\b(not )?all met\b", 2), of("event", "summary:", r"[0-9]+ of [0-9]+ pass", 1), plain)


@query(EVENT_TEXT_SQL + "SELECT event_id, round((CASE WHEN even THEN 1 ELSE 0.25 END + CASE WHEN v > 50 THEN 1 ELSE 0.5 END + 1) / 3, 4) AS two, round((CASE WHEN even THEN 1 ELSE 0.25 END + 0.5) / 2, 4) AS event, CASE WHEN even THEN 1 ELSE 0.25 END::DOUBLE AS plain, round(CASE WHEN even THEN 0.60 + 0.05 * c + 0.20 * (CASE WHEN even THEN 1 ELSE 0.25 END + CASE WHEN v > 50 THEN 1 ELSE 0.5 END + 1) / 3 + 0.15 ELSE 0.1 END, 4) AS compound FROM (SELECT *, 0.5 AS c FROM e)")
def score_compound(spark, sf_dir):
    met = F.when(F.col("even"), "met").otherwise("not met")
    two = _said("x\n===\ncondition 1: range ", met, "\ncondition 2: level ", F.when(F.col("v") > 50, "-> pass").otherwise("open"), "\nall conditions: not all met\nanswer: ", F.when(F.col("even"), "yes").otherwise("no"))
    truth = F.lit("x\n===\ncondition 1: met\ncondition 2: pass\nall conditions: all met\nanswer: yes")
    event, one = _said("x\n===\nevent 1: ", met, "\nsummary: some"), _said("x\n===\n-> ", met)
    e = _events(spark, sf_dir).select("event_id", two.alias("two"), event.alias("event"), one.alias("one")).withColumn("c", conditions_score(F.col("two"), truth))
    c = F.col("c")
    verdict = binary(answer_line(F.col("two")), answer_line(truth))
    whole = R.let(verdict, lambda v: R.let(0.60 * v + 0.05 * F.lit(0.5) + 0.20 * c + 0.15 * evidence_score(F.col("two"), truth), lambda s: F.when(v < 1, F.least(s, F.lit(WRONG_CAP))).otherwise(s)))
    return e.select("event_id", rnd(c, 4).alias("two"), rnd(conditions_score(F.col("event"), F.lit("x\n===\nevent 1: met\nsummary: 1 of 1 pass")), 4).alias("event"), conditions_score(F.col("one"), F.lit("x\n===\n-> met")).alias("plain"), rnd(whole, 4).alias("compound"))


#: The verdict's worth of an answer without one, where evidence decides.
NO_VERDICT = 0.20


def statistic_score(prediction: Column, truth: Column) -> Column:
    """Four fifths verdict, as the truth is, one fifth evidence; without a verdict half each of a small worth and evidence."""
    p, g = answer_line(prediction), answer_line(truth)
    ev = evidence_score(prediction, truth)
    return F.when(g.isNotNull() & p.isNull(), 0.5 * F.lit(NO_VERDICT) + 0.5 * ev).otherwise(0.8 * polymorphic(p, g) + 0.2 * ev)


@query(EVENT_TEXT_SQL + f"SELECT event_id, round(CASE WHEN even THEN 0.8 * exp(-abs(v - 50) / 5) + 0.2 ELSE 0.5 * {NO_VERDICT} + 0.5 END, 4) AS score FROM e")
def score_stat_numerical(spark, sf_dir):
    text = F.when(F.col("even"), _said("x\n===\nanswer: ", _two(F.col("v")))).otherwise("x\n===\nno more")
    return _events(spark, sf_dir).select("event_id", rnd(statistic_score(text, F.lit("x\n===\nanswer: 50")), 4).alias("score"))


def parameters_score(p: Column, g: Column) -> Column:
    """Of maps of texts the mean over the truth's entries: numbers near by their size, words equal; 1 for an empty truth."""

    def one(p: Column, e: Column) -> Column:
        return R.let(F.struct(F.try_element_at(p, e["key"]).alias("mine"), e["value"].alias("true"), finite(e["value"]).alias("number")), alike)

    def alike(x: Column) -> Column:
        word = F.coalesce((F.lower(F.trim(x["mine"])) == F.lower(F.trim(x["true"]))).cast("double"), F.lit(0.0))
        return F.when(x["number"].isNotNull(), near(finite(x["mine"]), x["number"], x["number"], 0.10)).otherwise(word)

    return R.let(p, lambda told: F.coalesce(mean_of(F.transform(F.map_entries(g), lambda e: one(told, e))), F.lit(1.0)))


def points_score(p: Column, g: Column, length: Column) -> Column:
    """Of arrays of (label, index, value): points of one label, half for the place, half for the value; missing ones are 0."""

    def one(mine: Column, x: Column) -> Column:
        return 0.5 * near(mine["index"], x["index"], length, 0.05) + 0.5 * near(mine["value"], x["value"], F.greatest(F.abs(x["value"]), F.lit(1.0)), 0.10)

    def whole(p: Column, g: Column) -> Column:
        first = lambda x: F.try_element_at(F.filter(p, lambda y: y["label"] == x["label"]), F.lit(1))
        return F.when(F.size(g) == 0, 1.0).when(F.size(p) == 0, 0.0).otherwise(mean_of(F.transform(g, lambda x: R.let(first(x), lambda mine: one(mine, x)))))

    return R.let(F.struct(p.alias("p"), g.alias("g")), lambda x: whole(x["p"], x["g"]))


@query(EVENT_TEXT_SQL + "SELECT event_id, round((exp(-abs(v - 20) / (0.1 * 20)) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / 2, 4) AS params, round((0.5 * exp(-abs(user_id % 7 - 3) / (0.05 * 64)) + 0.5 * exp(-abs(v - 20) / 2)) / 2, 4) AS points FROM e")
def score_params(spark, sf_dir):
    """Parameters by name and key points by label; the second point is missing."""
    from ..operators.preparation import key_points, parameters

    p = _said("period=", _two(F.col("v")), ", shape=", F.col("event_type"), "; peak@(", (F.col("user_id") % 7), ", ", _two(F.col("v")), ")")
    e = _events(spark, sf_dir).withColumn("p", p)
    g = F.lit("period=20, shape=click; peak@(3, 20.0) end@(9, 1.0)")
    return e.select("event_id", rnd(parameters_score(parameters(F.col("p")), F.map_filter(parameters(g), lambda k, v: k.isin("period", "shape"))), 4).alias("params"), rnd(points_score(key_points(F.col("p")), key_points(g), F.lit(64)), 4).alias("points"))


def greedy_pairs(pairs: Column) -> Column:
    """Of an array of (cost, i, j) those that a greedy match takes, cheapest first, each i and j once."""
    empty = F.filter(pairs, lambda x: F.lit(False))
    free = lambda taken, x: ~F.exists(taken, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
    return F.aggregate(F.array_sort(pairs), empty, lambda taken, x: F.when(free(taken, x), F.array_append(taken, x)).otherwise(taken))


def match_events(p: Column, g: Column) -> Column:
    """Pairs (cost, i, j) of arrays of (type, pos): j of the told events for i of the true ones, by type and nearness."""
    like = lambda a, b: F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))
    pairs = F.flatten(F.transform(g, lambda x, i: F.transform(p, lambda y, j: F.when(like(x["type"], y["type"]), F.struct(F.abs(x["pos"] - y["pos"]).cast("double").alias("cost"), i.alias("i"), j.alias("j"))))))
    return greedy_pairs(F.filter(pairs, lambda x: x.isNotNull()))


@query(EVENT_TEXT_SQL + "SELECT event_id, 2 AS n, (x > 6)::INT AS told, CASE WHEN x > 6 THEN 33 - x ELSE x + 7 END::DOUBLE AS cost FROM (SELECT event_id, user_id % 9 AS x FROM e)")
def greedy_match_events(spark, sf_dir):
    """Two true spikes and two told ones: the nearest pair is taken first, what is left is the other."""
    x = (F.col("user_id") % 9).cast("double")
    ev = lambda t, pos: F.struct(F.lit(t).alias("type"), pos.alias("pos"))
    g = F.array(ev("upward spike", x), ev("spike", F.lit(20.0)))
    p = F.array(ev("spike", F.lit(0.0)), ev("Upward Spike", F.lit(13.0)), ev("shake", x))
    m = match_events(p, g)
    e = _events(spark, sf_dir).select("event_id", "user_id", m.alias("m")).withColumn("first", F.filter("m", lambda y: y["i"] == 0)[0]["j"])
    return e.select("event_id", F.size("m").alias("n"), F.col("first").alias("told"), F.aggregate("m", F.lit(0.0), lambda a, y: a + y["cost"]).alias("cost"))


def description_scores(p: Column, g: Column, length: Column) -> Column:
    """Of two structs (trend, first, last, amplitude, periodic, period, noise, strength, events) for each part whether its kind is
    right, and how near its numbers are; null where the truth says nothing."""
    numbers = lambda *names: mean_of(F.array(*(F.when(g[n].isNotNull() & p[n].isNotNull(), relative_accuracy(p[n], g[n])) for n in names)))
    kind = lambda a: F.when(F.lower(a).contains("increas"), "increase").when(F.lower(a).contains("decreas"), "decrease").when(F.lower(a).rlike("steady|stable|flat"), "steady").otherwise(F.lower(a))
    is_noisy = lambda a: F.coalesce(F.lower(a).contains("noisy"), F.lit(False))
    m = match_events(F.coalesce(p["events"], F.array().cast("array<struct<type:string,pos:double>>")), g["events"])
    place = F.transform(m, lambda x: F.greatest(F.lit(0.0), 1 - x["cost"] / length))
    same = lambda ok: F.coalesce(ok.cast("double"), F.lit(0.0))
    return F.struct(
        F.when(g["trend"].isNotNull(), same(kind(p["trend"]) == kind(g["trend"]))).alias("trend_kind"), numbers("first", "last", "amplitude").alias("trend_number"),
        F.when(g["periodic"].isNotNull(), same(p["periodic"] == g["periodic"])).alias("season_kind"), F.when(g["periodic"] & g["period"].isNotNull(), F.coalesce(relative_accuracy(p["period"], g["period"]), F.lit(0.0))).alias("season_number"),
        F.when(g["noise"].isNotNull(), same(is_noisy(p["noise"]) == is_noisy(g["noise"]))).alias("noise_kind"), numbers("strength").alias("noise_number"),
        F.when(F.size(g["events"]) > 0, F.size(m) / F.size(g["events"])).alias("local_kind"), mean_of(place).alias("local_number"),
    )


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE WHEN even THEN 1 ELSE 0 END::DOUBLE AS trend_kind, round((1 + greatest(0, 1 - abs(v - 20) / 20)) / 2, 4) AS trend_number, 1.0::DOUBLE AS season_kind, round(greatest(0, 1 - abs(user_id - 8) / 8.0), 4) AS season_number, 0.0::DOUBLE AS noise_kind, 0.5::DOUBLE AS local_kind, round(1 - 3 / 64.0, 4) AS local_number FROM e")
def desc_perspective(spark, sf_dir):
    ev = lambda *pairs: F.array(*(F.struct(F.lit(t).alias("type"), F.lit(float(a)).alias("pos")) for t, a in pairs))
    of = lambda trend, last, period, noise, events: F.struct(trend.alias("trend"), F.lit(10.0).alias("first"), last.alias("last"), F.lit(None).cast("double").alias("amplitude"), F.lit(True).alias("periodic"), period.cast("double").alias("period"), F.lit(noise).alias("noise"), F.lit(None).cast("double").alias("strength"), events.alias("events"))
    p = of(F.when(F.col("even"), "mostly increasing").otherwise("flat"), F.col("v"), F.col("user_id"), "noisy", ev(("spike", 13), ("dip", 1)))
    g = of(F.lit("increase"), F.lit(20.0), F.lit(8), "smooth", ev(("upward spike", 10), ("shake", 40)))
    e = _events(spark, sf_dir).select("event_id", description_scores(p, g, F.lit(64.0)).alias("s"))
    r = lambda n: rnd(F.col(f"s.{n}"), 4).alias(n)
    return e.select("event_id", r("trend_kind"), r("trend_number"), r("season_kind"), r("season_number"), r("noise_kind"), r("local_kind"), r("local_number"))


def source_score(source: Column, prediction: Column, golds: Column) -> Column:
    """By the data's source: school sums, mathematics, questions of knowledge; another source fails the job."""
    sums = (hash_answer(prediction) == golds[0]).cast("double")
    maths = (final_answer(boxed(prediction)) == final_answer(golds[0])).cast("double")
    said = normal_answer(last_tagged(prediction))
    facts = F.exists(golds, lambda g: normal_answer(g) == said).cast("double")
    known = F.when(source == "sums", sums).when(source.isin("math", "math_500") | source.startswith("aime"), maths).when(source.startswith("facts"), facts)
    return F.coalesce(known.otherwise(F.raise_error(F.concat(F.lit("no score for "), source)).cast("double")), F.lit(0.0))


@query(EVENT_TEXT_SQL + "SELECT event_id, unnest(['sums', 'math', 'aime24', 'facts_en']) AS source, unnest([even::INT, even::INT, 0, (event_type = 'click')::INT]::DOUBLE[]) AS score FROM e")
def default_compute_score(spark, sf_dir):
    c, even = F.col, F.when(F.col("even"), "7").otherwise("8")
    cases = [("sums", _said("so #### ", even), F.array(F.lit("7"))), ("math", _said("it is \\boxed{", even, "}"), F.array(F.lit("7"))), ("aime24", F.lit("nothing"), F.array(F.lit("7"))), ("facts_en", _said("<answer>x</answer><answer>The ", c("event_type"), "</answer>"), F.array(F.lit("Click!"), F.lit("none")))]
    x = _events(spark, sf_dir).select("event_id", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), p.alias("p"), g.alias("g")) for s, p, g in cases))).alias("x"))
    return x.select("event_id", F.col("x.s").alias("source"), source_score(F.col("x.s"), F.col("x.p"), F.col("x.g")).alias("score"))


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE WHEN even THEN 1 ELSE 0.05 END::DOUBLE AS plain, round(CASE WHEN even THEN 1 ELSE 0.05 END + least(0, -(user_id - 8) / 4.0 * 0.5), 4) AS with_penalty FROM e")
def reward_managers(spark, sf_dir):
    """The reward of every answer of a batch, and the same less the penalty of overlong ones. Answers are scored where they
    lie; a reward needs no other row."""
    p = _think("answer: ", F.when(F.col("even"), "yes").otherwise("no"))
    e = _events(spark, sf_dir).withColumn("s", score(p, _think("answer: yes"), F.lit("yes_no")))
    return e.select("event_id", F.col("s").alias("plain"), rnd(F.col("s") + overlong(F.col("user_id"), 12, 4, 0.5), 4).alias("with_penalty"))


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE WHEN even THEN 'similar' ELSE 'different' END AS gt_verdict, 'similar' AS pred_verdict, even AS right, even AS right_normal, CASE WHEN event_type = 'click' THEN 1 ELSE 0.5 END::DOUBLE AS f1, round(user_id / 10.0, 4) AS reasoning_score FROM e")
def parse_and_score(spark, sf_dir):
    """What judges said of an answer, three rows of JSON, put together as one evaluated row."""
    c = F.col
    j = lambda **kw: F.to_json(F.struct(*(v.alias(k) for k, v in kw.items())))
    said = {"gt": j(verdict=F.when(c("even"), "similar").otherwise("different"), entities=F.array(F.lit("b"), F.lit("click"))), "pred": F.concat(F.lit("```json\n"), j(verdict=F.lit("similar"), entities=F.array(c("event_type"), F.lit("b"))), F.lit("\n```")), "judge": j(score=c("user_id") / 10)}
    rows = _events(spark, sf_dir).select("event_id", F.explode(F.array(*(F.struct(F.lit(k).alias("type"), v.alias("said")) for k, v in said.items()))).alias("x")).select("event_id", "x.type", "x.said")
    one = rows.groupBy("event_id").pivot("type", list(said)).agg(F.first("said"))
    from .parsing import json_object

    parsed = lambda n, s: F.from_json(json_object(c(n)), s)
    x = one.select("event_id", parsed("gt", "verdict string, entities array<string>").alias("g"), parsed("pred", "verdict string, entities array<string>").alias("p"), parsed("judge", "score double").alias("j"))
    return x.select("event_id", c("g.verdict").alias("gt_verdict"), c("p.verdict").alias("pred_verdict"), (c("g.verdict") == c("p.verdict")).alias("right"), (normal_verdict(c("g.verdict")) == normal_verdict(c("p.verdict"))).alias("right_normal"), set_f1(c("p.entities"), c("g.entities")).alias("f1"), rnd(c("j.score"), 4).alias("reasoning_score"))
