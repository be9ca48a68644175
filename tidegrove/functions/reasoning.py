"""Whether the reasoning of an answer agrees with itself, as column functions over the text alone.

A text is data, a line of ===, then the reasoning with its last line "answer: ...". Every function gives the share of
its checks that hold; a text that has nothing to check, and a null, gives 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.generators import dealt
from ..registry import query, rnd, table
from .text import behind, found, let

NEUTRAL = 0.5
#: Values this near to each other, as a share of the larger, can be called anything.
EQUAL_BAND = 0.05


def reasoning(text: Column) -> Column:
    """What comes after the first ===, or null."""
    return behind(text, "===")


def holds(check: Column) -> Column:
    return F.coalesce(check.cast("double"), F.lit(NEUTRAL))


def share(checks: Column) -> Column:
    """The share of an array's checks that hold; nulls are not counted."""
    there = F.filter(checks, lambda c: c.isNotNull())
    return F.when(F.size(there) > 0, F.size(F.filter(there, lambda c: c)) / F.size(there)).otherwise(NEUTRAL)


def yes_or_no(text: Column) -> Column:
    """The first PASS or FAIL outside comparisons, thresholds and the answer must be what the answer says."""

    def check(r: Column) -> Column:
        said = F.lower(found(r, r"(?im)^answer:\s*(yes|no)\s*$"))
        lines = F.filter(F.split(F.upper(r), "\n"), lambda line: ~F.trim(line).rlike("^(VS |THRESHOLD|COMPARISON|ANSWER:)") & line.rlike(r"(PASS|FAIL)\."))
        return holds((said == "yes") == ~F.try_element_at(lines, F.lit(1)).contains("FAIL."))

    return let(reasoning(text), check)


def pair_verdict(text: Column) -> Column:
    """similar and opposite follow a PASS, different and not_opposite a FAIL."""

    def check(r: Column) -> Column:
        passed = F.upper(F.coalesce(found(r, r"(?im)^vs\s+.+?(PASS|FAIL)\."), found(r, r"(?im)^.+?(PASS|FAIL)\.")))
        right = lambda said: F.when(said.isin("similar", "opposite"), passed == "PASS").when(said.isin("different", "not_opposite"), passed == "FAIL")
        return holds(let(found(F.lower(r), r"(?m)^answer:\s*(\S+)"), right))

    return let(reasoning(text), check)


def cluster_members(text: Column) -> Column:
    """Every channel that passed must be in the answer's list, every one that failed must not; each line is a check."""

    def lines(r: Column, pattern: str) -> Column:
        part = lambda k: F.regexp_extract_all(r, F.lit(pattern), k)
        return F.zip_with(part(1), part(2), lambda x, y: F.struct(F.lower(F.trim(x)).alias("who"), F.upper(y).alias("what")))

    def check(members: Column, checked: Column) -> Column:
        right = F.transform(checked, lambda c: F.array_contains(members, c["who"]) == (c["what"] == "PASS"))
        none_passed = (~F.exists(checked, lambda c: c["what"] == "PASS")).cast("double")
        return F.when(F.coalesce(F.size(checked), F.lit(0)) <= 0, NEUTRAL).when(members.isNull(), NEUTRAL).when(F.size(members) == 0, none_passed).otherwise(let(right, share))

    def whole(r: Column) -> Column:
        compared = lines(r, r"(?im)^vs\s+(.+?):\s*.*?(PASS|FAIL)\.")
        others = lines(r, r"(?im)^(?!\s*answer:|\s*threshold)(.+?):\s*.*?(PASS|FAIL)\.")
        inside = found(r, r"(?i)answer:\s*\((.*)\)")
        members = F.filter(F.transform(F.split(F.lower(inside), ","), lambda x: F.trim(x)), lambda x: x != "")
        return let(let(compared, lambda c: F.when(F.size(c) > 0, c).otherwise(others)), lambda c: let(members, lambda m: check(m, c)))

    return let(reasoning(text), whole)


def longest_duration(text: Column) -> Column:
    """The answer must be a type of the largest summed duration, or "equal" where there are several."""
    line = F.lit(r"(?m)^\s*[-•*]\s*(increase|decrease|keep steady|steady)\s*:(.*)$")
    number = lambda rest: F.coalesce(found(rest, r"=\s*([\d.]+)[^=]*$"), found(rest, r"^[^=\d]*([\d.]+)[^=]*$")).cast("double")

    def rows(part: Column) -> Column:
        return F.filter(F.arrays_zip(F.regexp_extract_all(part, line, 1).alias("kind"), F.transform(F.regexp_extract_all(part, line, 2), number).alias("n")), lambda x: x["n"].isNotNull())

    def best(listed: Column) -> Column:
        top = F.array_max(F.transform(listed, lambda x: x["n"]))
        return let(top, lambda t: F.transform(F.filter(listed, lambda x: x["n"] == t), lambda x: x["kind"]))

    def check(r: Column) -> Column:
        said = F.trim(F.regexp_replace(found(r, r"(?:answer|verdict):\s*(.+)"), r"</?\w+>", ""))
        right = lambda b: F.when(F.size(b) <= 0, NEUTRAL).otherwise(holds(let(said, lambda x: F.array_contains(b, x) | ((F.size(b) > 1) & (x == "equal")))))
        part = found(r, r"(?s)aggregate durations:(.*?)(?:dominant trend|answer:|\z)")
        return F.coalesce(let(let(rows(part), best), right), F.lit(NEUTRAL))

    return let(F.lower(reasoning(text)), check)


def half_comparison(text: Column) -> Column:
    """The half that the answer names must have the larger value in the data."""
    data = F.when(text.contains("==="), F.substring_index(F.lower(text), "===", 1))
    value = lambda half: F.coalesce(*(found(data, p).cast("double") for p in (rf"{half}_half_mean\s*=\s*([\d.e+-]+)", rf"{half}_half_std\s*=\s*([\d.e+-]+)", rf"{half}_half\s*\[.*?\]:\s*(?:mean|std)\s*=\s*([\d.e+-]+)")))
    said = found(F.lower(reasoning(text)), r"(?:answer|verdict):\s*(first half|second half|equal)")

    def check(a: Column, b: Column, x: Column) -> Column:
        alike = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-6)) < EQUAL_BAND
        return F.when(x.isNull() | a.isNull() | b.isNull(), NEUTRAL).otherwise(holds(F.when(alike, True).otherwise(x == F.when(a > b, "first half").otherwise("second half"))))

    return let(value("first"), lambda a: let(value("second"), lambda b: let(said, lambda x: check(a, b, x))))


def outcome(block: Column) -> Column:
    """Whether a block says met or pass; null if it says nothing."""
    return F.when(block.rlike(r"\bnot\s+met\b"), False).otherwise(found(block, r"\b(met|pass|fail)\b").isin("met", "pass"))


def conditions(text: Column) -> Column:
    """Conditions, their summary and the answer must say the same; or events and the number that passed; or bare outcomes
    and the answer."""

    passed = lambda t: found(t, r"summary:\s*(\d+)\s+of\s+\d+\s+pass").cast("int")
    mixed = lambda b: b.rlike(r"\bevent \d+:|summary:")
    outcomes = lambda parts: F.filter(F.transform(parts, outcome), lambda x: x.isNotNull())

    def blocks(r: Column, label: str, end: str) -> Column:
        return F.transform(F.slice(F.split(r, rf"\b{label} \d+:"), 2, 1 << 30), lambda b: F.regexp_replace(b, rf"(?s)(?:{end}).*", ""))

    def by_condition(conds: Column, plain: Column, summary: Column, said: Column) -> Column:
        has_mixed, all_met, several, alone = F.exists(conds, mixed), F.forall(plain, lambda x: x), F.size(conds) >= 2, F.size(conds) == 1
        return F.array(
            F.when(several & ~has_mixed & (F.size(plain) > 0), summary == all_met), F.when(several, said == summary),
            F.when(alone & (F.size(plain) > 0), said == all_met), F.when(alone & has_mixed & (F.size(plain) == 0), said == (passed(F.try_element_at(conds, F.lit(1))) > 0)),
        )

    def whole(r: Column) -> Column:
        said = found(r, r"(?:answer|verdict):\s*(yes|no)") == "yes"
        summary = let(found(r, r"all conditions:\s*([^\n]*)"), lambda x: F.when(x.rlike(r"\bnot all met\b"), False).when(x.rlike(r"\ball met\b"), True))
        checked = lambda conds: let(let(outcomes(F.filter(conds, lambda b: ~mixed(b))), lambda p: let(summary, lambda x: let(said, lambda y: by_condition(conds, p, x, y)))), share)
        by_event = lambda known: F.when(F.size(known) > 0, passed(r) == F.size(F.filter(known, lambda x: x)))
        bare = F.when(r.rlike(r"\b(?:met|pass|fail)\b"), said == ~r.rlike(r"\bnot\s+met\b|\bfail\b"))
        rest = F.when(r.rlike(r"\bevent \d+:"), holds(let(outcomes(blocks(r, "event", "summary:|answer:")), by_event))).otherwise(holds(bare))
        return let(blocks(r, "condition", "all conditions:|answer:"), lambda conds: F.when(F.size(conds) > 0, checked(conds)).otherwise(rest))

    return let(F.lower(F.coalesce(reasoning(text), text)), whole)


@query("""WITH a AS (SELECT event_id, round(value, 2) AS v, floor(value)::INT AS f, user_id % 2 = 0 AS e, event_type = 'click' AS c, event_type = 'view' AS w FROM events)
SELECT event_id, ((v > 50) = e)::INT::DOUBLE AS yes_no, (c = e)::INT::DOUBLE AS pair, ((CASE WHEN c = e THEN 1 ELSE 0 END + CASE WHEN w THEN 0 ELSE 1 END) / 2)::DOUBLE AS cluster, CASE WHEN f > 30 THEN 0.0 ELSE 1.0 END::DOUBLE AS duration,
CASE WHEN abs(v - 50) / greatest(v, 50) < 0.05 THEN 1.0 WHEN v > 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS half, (((c AND e) = w)::INT + (w = e)::INT) / 2.0::DOUBLE AS condition FROM a""")
def reasoning_coherency(spark, sf_dir):
    """Reasoning made of the events: their values and types decide what is found, their users what is answered."""
    e = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))
    v, even, click, view = rnd("value", 2), F.col("user_id") % 2 == 0, F.col("event_type") == "click", F.col("event_type") == "view"
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    texts = {
        "yes_no": (yes_or_no, said("x\n===\nThreshold 9. FAIL.\nnearest point: ", pick(v > 50, "PASS.", "FAIL."), "\nanswer: ", pick(even, "Yes", "no"))),
        "pair": (pair_verdict, said("x\n===\nvs B: far, ", pick(click, "pass", "FAIL"), ".\nanswer: ", pick(even, "similar", "different"))),
        "cluster": (cluster_members, said("x\n===\nvs B (b): ", pick(click, "PASS.", "FAIL."), "\nvs C: FAIL.\nanswer: (A, ", pick(even, "B (b)", "D"), pick(view, ", C)", ")"))),
        "duration": (longest_duration, said("x\n===\nAggregate durations:\n- increase: 10 + 20 = 30\n- decrease: ", F.floor("value").cast("string"), "\nDominant trend\nanswer: increase")),
        "half": (half_comparison, said("first_half_mean=", F.format_string("%.2f", v), " second_half_mean=50.00\n===\nanswer: first half")),
        "condition": (conditions, said("x\n===\ncondition 1: ", pick(click, "met", "not met"), "\ncondition 2: ", pick(even, "pass", "fail"), "\nall conditions: ", pick(view, "all met", "not all met"), "\nanswer: ", pick(even, "yes", "no"))),
    }
    return e.select("event_id", *(f(t).alias(n) for n, (f, t) in texts.items()))
