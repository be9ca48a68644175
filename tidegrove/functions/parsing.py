"""Reading what an answer says: reasoning blocks, verdicts, lists, segments, blocks of measures, boxed and tagged results.

All are column functions over text. What can't be read is null, never an error. The queries apply them to texts made of the
events, so that what must be read is known.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.generators import dealt
from ..registry import query, rnd, table
from .brackets import last_object, until_closed
from .reasoning import reasoning
from .text import found, let

_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def finite(text: Column) -> Column:
    """A finite number, or null."""
    return let(found(F.trim(text), _FLOAT, 0).try_cast("double"), lambda v: F.when(F.abs(v) < float("inf"), v))


def without_first_think(text: Column) -> Column:
    """Without a reasoning block at the text's start; blocks further on stay."""
    return F.regexp_replace(text, r"(?s)\A<think>.*?</think>\s*", "")


def _section(think: Column) -> Column:
    """The reasoning below ===, or the whole block if it has none."""
    return F.coalesce(reasoning(think), think)


def scalar_answer(think: Column) -> Column:
    """The first word of the first line "answer: ..." of the reasoning, A-Z lowered. ^ stands at line feeds alone."""
    return F.lower(found(_section(think), r"(?imd)^answer:\s*(\S+)"))


def answer_set(think: Column) -> Column:
    """The distinct members, lowered, of the first line "answer: (a, b, ...)" of the reasoning, up to the first bracket that
    closes; null without such a line."""
    inside = found(_section(think), r"(?imd)^answer:\s*\(([^)]*)\)")
    return F.array_distinct(F.filter(F.transform(F.split(inside, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def _passes(line: Column) -> Column:
    """Whether a line says PASS. and not FAIL.; null if it says neither."""
    return let(F.upper(line), lambda x: F.when(x.contains("FAIL."), False).when(x.contains("PASS."), True))


def _checks(think: Column) -> Column:
    """The trimmed lines of the reasoning below ===; null without it."""
    return F.transform(F.split(reasoning(think), "\n"), lambda x: F.trim(x))


def pass_or_fail(think: Column) -> Column:
    """yes for a PASS, no for a FAIL, of the first line below === that says either and is no comparison and no threshold."""
    lines = F.filter(_checks(think), lambda x: _passes(x).isNotNull() & ~x.rlike(r"(?i)\A(vs |threshold|comparison)"))
    return F.when(_passes(F.try_element_at(lines, F.lit(1))), "yes").when(F.size(lines) > 0, "no")


def last_wins(entries: Column) -> Column:
    """A map of (k, v) structs; of equal keys the last counts."""

    def repeated(x: Column) -> Column:
        return F.map_from_arrays(x["d"], F.transform(x["d"], lambda k: F.element_at(x["v"], (F.size(x["r"]) - F.array_position(x["r"], k) + 1).cast("int"))))

    def whole(e: Column, keys: Column) -> Column:
        columns = F.struct(keys.alias("d"), F.reverse(e["k"]).alias("r"), e["v"].alias("v"))
        return F.when(F.size(keys) == F.size(e), F.map_from_entries(e)).otherwise(let(columns, repeated))

    return let(entries, lambda e: F.when(e.isNotNull(), let(F.array_distinct(e["k"]), lambda keys: whole(e, keys))))


def verifications(think: Column) -> Column:
    """Whom an anchor was compared with below ===, and whether that passed: a map, empty without such lines."""
    lines = F.filter(F.coalesce(_checks(think), F.array().cast("array<string>")), lambda x: x.startswith("vs "))
    read = F.transform(lines, lambda x: F.struct(F.trim(found(x, r"\Avs (.+?):")).alias("k"), _passes(x).alias("v")))
    return last_wins(F.filter(read, lambda x: x["k"].isNotNull() & x["v"].isNotNull()))


def listed_segments(text: Column) -> Column:
    """(type, start, stop) triples in the order of the text."""
    part = lambda k: F.regexp_extract_all(text, F.lit(r"\(([a-zA-Z ]+),\s*(-?[0-9]+),\s*(-?[0-9]+)\)"), k)
    return F.transform(F.arrays_zip(part(1).alias("t"), part(2).alias("a"), part(3).alias("b")), lambda x: F.struct(F.trim(x["t"]).alias("type"), x["a"].cast("int").alias("start"), x["b"].cast("int").alias("stop")))


def _last_of_line(name: str, char: str) -> str:
    """A pattern of the value behind a name, of some characters: the last of the first line that has one."""
    return rf"{name}(?={char})(?![^\n]*?{name}{char})({char}+)"


def measure_blocks(think: Column) -> Column:
    """Blocks between lines of --- as an array of (metric, period, amplitude, trend, first, last, segments, noise, stats,
    length); blocks without a metric line are left out."""

    def block(x: Column) -> Column:
        has = lambda name, value: F.when(F.contains(x, F.lit(name)), value)  # noqa: E731 - a block has few of the parts; the others aren't searched for
        number = lambda name, pattern: has(name, let(found(x, pattern).try_cast("double"), lambda v: F.when(F.abs(v) < float("inf"), v)))  # noqa: E731 - the patterns let only a number's characters through
        pairs = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\w+=[0-9.eE+-]+"), 0), lambda y: F.struct(F.substring_index(y, "=", 1).alias("k"), F.substring_index(y, "=", -1).try_cast("double").alias("v")))
        return F.struct(
            has("metric:", F.trim(found(x, r"(?m)^metric:(.*)$"))).alias("metric"), number("season=", r"(?m)^season=[^\n]*period=([0-9.eE+-]+)").alias("period"), number("season=", r"(?m)^season=[^\n]*amp=([0-9.eE+-]+)").alias("amplitude"),
            has("overall trend=", F.trim(found(x, _last_of_line("overall trend=", "[^,\\n]")))).alias("trend"), number("start=", _last_of_line(r"\bstart=", "[0-9.eE+-]")).alias("first"), number("end=", _last_of_line(r"\bend=", "[0-9.eE+-]")).alias("last"),
            has("trend_segments=", let(found(x, r"(?m)^trend_segments=(.*)$"), listed_segments)).alias("segments"), number("noise=", r"(?m)^noise=[^\n]*strength=([0-9.eE+-]+)").alias("noise"),
            has("stats:", last_wins(pairs(found(x, r"(?m)^stats:(.*)$")))).alias("stats"), has("len=", found(x, r"(?m)^len=\s*([0-9]+)\s*$").cast("int")).alias("length"),
        )

    return F.filter(F.transform(F.split(think, r"\n---\n"), block), lambda b: b["metric"].isNotNull())


def dominant(think: Column) -> Column:
    """The type that a comparison of durations names first."""
    return F.lower(found(think, r"(?im)^comparison[^:\n]*:\s*(increase|decrease|keep steady)"))


def bracketed(text: Column) -> Column:
    """The numbers of the first [...]: an empty array for [], null if one of its members has no number."""
    numbers = lambda inside: F.transform(F.split(inside, ","), lambda x: found(x, r"(-?[0-9]+\.?[0-9]*)").cast("double"))
    known = lambda n: F.when(F.forall(n, lambda x: x.isNotNull()), n)
    return let(F.trim(found(text, r"\[([^\[\]]*)\]")), lambda inside: F.when(inside == "", F.array().cast("array<double>")).otherwise(let(numbers(inside), known)))


def list_verdict(text: Column) -> Column:
    """The numbers of the first [...] of a text; null without one, or if a member is no finite number. Empty members don't count."""
    inside = found(text, r"\[([^\]]*)\]")
    numbers = F.transform(F.filter(F.split(inside, ","), lambda x: F.trim(x) != ""), finite)
    return let(numbers, lambda n: F.when(F.forall(n, lambda x: x.isNotNull()), n))


# What is mended in JSON as people and models write it. A quote behind a comma opens a member, also without a blank.
INNER_QUOTE = r'(?<!\\)(?<![\{\[\s:,])"(?![:,\s\}\]])'
MENDED = [(INNER_QUOTE, r'\\"'), (r":\s*True\b", ": true"), (r":\s*False\b", ": false"), (r":\s*None\b", ": null"), (r",\s*([\]}])", "$1")]


def json_object(text: Column) -> Column:
    """The last JSON object of a text: that in the last fence, else the last {...} that is in no other, of any depth; quotes
    in the middle of words, Python's constants and commas before a bracket are mended."""
    fenced = lambda t: F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?is)```(?:json)?\s*(\{.*?\})\s*```"), 1), F.lit(-1))
    out = let(text, lambda t: F.coalesce(fenced(t), last_object(t)))
    for a, b in MENDED:
        out = F.regexp_replace(out, a, b)
    return out


def subject(question: Column) -> Column:
    """What a question is about: a numbered series, or a pair."""
    a, b = (found(question, r"between (.*?) and (.*?)(?:\?|$)", k) for k in (1, 2))
    return F.coalesce(found(question, r"related to (time series [0-9]+)"), F.concat(a, F.lit(", "), b), F.lit("the subject of the question"))


def task_type(kind: Column, question: Column) -> Column:
    """The given kind, else what the question's words suggest."""
    q = F.lower(F.coalesce(question, F.lit("")))
    has = q.contains
    guess = F.when(has("anticorrelat"), "anticorrelation").when(has("opposite") & has("trend"), "anticlustering").when(has("correlation"), "correlation").when(has("find") & has("related"), "clustering").when(has("is there") & has("fluctuation"), "yes_no").otherwise("unknown")
    return F.coalesce(kind, guess)


#: Words that call for a part of a description.
PERSPECTIVES = {"trend": ("trend",), "seasonal": ("periodicity", "seasonal"), "noise": ("noise",), "local": ("local",)}


def perspectives(question: Column) -> Column:
    q = F.lower(question)
    asked = [F.when(q.rlike("|".join(words)), F.lit(name)) for name, words in PERSPECTIVES.items()]
    return F.filter(F.array(*asked), lambda x: x.isNotNull())


def normal_verdict(text: Column) -> Column:
    """Verdicts of comparisons as yes or no; others lowered and trimmed."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("similar", "opposite"), "yes").when(t.isin("different", "not_opposite"), "no").otherwise(t)


def same_name(a: Column, b: Column) -> Column:
    """Whether two names of measures are one but for case, blanks and punctuation, or one holds the other."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    x, y = plain(a), plain(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def last_tagged(text: Column) -> Column:
    """What the last <answer> holds; a text with a single one, which the prompt has, gives none."""
    tags = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    return F.when(F.size(tags) > 1, F.trim(F.element_at(tags, -1)))


def hash_answer(text: Column) -> Column:
    """The number behind the last ####, without commas."""
    return F.regexp_replace(F.try_element_at(F.regexp_extract_all(text, F.lit(r"#### (-?[0-9.,]+)"), 1), F.lit(-1)), "[,$]", "")


def last_number(text: Column) -> Column:
    """The last run of digits, points and commas that isn't a lone point."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), 1), lambda x: ~x.isin("", "."))
    return F.try_element_at(runs, F.lit(-1))


def boxed(text: Column) -> Column:
    r"""What the last \boxed{...} holds, braces of any depth inside; null if that one isn't closed."""
    mark = "\\boxed{"
    return F.when(F.contains(text, F.lit(mark)), until_closed(F.substring_index(text, mark, -1)))


# What stands for one thing in answers of mathematics, and words that say nothing.
SUBSTITUTIONS = {"an ": "", "a ": "", ".$": "$", "\\$": "", "\\ ": "", " ": "", "mbox": "text", ",\\text{and}": ",", "\\text{and}": ",", "\\text{m}": "\\text{}"}
REMOVED = ["square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"]


def final_answer(text: Column) -> Column:
    """An answer without units, wrappers and shorthand: what is behind the last =, in one form."""
    out = F.substring_index(text, "=", -1)
    for a, b in SUBSTITUTIONS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    for a in REMOVED:
        out = F.replace(out, F.lit(a), F.lit(""))
    for a, b in ((r"^.*?\$(.*?)\$.*$", r"$1"), (r"\\(?:text|textbf|overline)\{(.*?)\}", "$1"), (r"\\boxed\{(.*)\}", "$1"), (r"frac([^{])(.)", "frac{$1}{$2}"), (r"sqrt([^{])", "sqrt{$1}"), (r"\$", "")):
        out = F.regexp_replace(out, a, b)
    return F.trim(F.when(F.replace(out, F.lit(","), F.lit("")).rlike("^[0-9]+$"), F.replace(out, F.lit(","), F.lit(""))).otherwise(out))


def listed_text(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    return F.when(n <= 1, F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))).when(n == 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))


def overlong(length: Column, most: int, buffer: int, factor: float) -> Column:
    """What is taken off for the part of an answer that runs into the buffer before the limit."""
    return F.least(F.lit(0.0), -(length - (most - buffer)) / buffer * factor)


EVENT_TEXT_SQL = "WITH e AS (SELECT event_id, user_id, event_type, round(value, 2) AS v, user_id % 2 = 0 AS even FROM events) "


def _events(spark, sf_dir):
    e = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))
    return e.select("event_id", "user_id", "event_type", rnd("value", 2).alias("v"), (F.col("user_id") % 2 == 0).alias("even"))


def _said(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _two(v: Column) -> Column:
    return F.format_string("%.2f", v)


@query(EVENT_TEXT_SQL + "SELECT event_id, 'Result ' || event_type || ' <think>late</think>' AS rest FROM e")
def strip_think_prefix(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", without_first_think(_said("<think>a\nb</think>\n Result ", F.col("event_type"), " <think>late</think>")).alias("rest"))


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE user_id % 4 WHEN 0 THEN printf('%.2f', v) WHEN 1 THEN 'yes' WHEN 2 THEN '-' || user_id WHEN 3 THEN NULL END AS answer FROM e")
def extract_answer_scalar(spark, sf_dir):
    c = F.col
    texts = [_said("answer: wrong\n===\nAnswer: ", _two(c("v")), " it is\nanswer: later"), F.lit("the final answer: no\nanswer: Yes"), _said("x\n===\n", c("event_type"), "\nANSWER:   -", c("user_id")), F.lit("answer: above\n===\nthe answer: inside a line")]
    return _events(spark, sf_dir).select("event_id", scalar_answer(F.element_at(F.array(*texts), (c("user_id") % 4 + 1).cast("int"))).alias("answer"))


@query(EVENT_TEXT_SQL + """SELECT event_id, CASE user_id % 3 WHEN 0 THEN CASE WHEN even THEN 'yes' ELSE 'no' END WHEN 1 THEN 'no' END AS result, CASE user_id % 3 WHEN 0 THEN v > 50 WHEN 1 THEN even END AS near, CASE WHEN user_id % 3 = 0 THEN true END AS far,
CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM e""")
def extract_verification(spark, sf_dir):
    """Lines of comparison as a map, the last of a name, and the result of the line that is none; nothing without ===."""
    c = F.col
    texts = [
        _said("x\n===\nvs near: at ", _two(c("v")), " ", F.when(c("v") > 50, "PASS.").otherwise("fail."), "\nvs far one: Pass.\nnearest point: ", F.when(c("even"), "PASS.").otherwise("FAIL."), "\nlast: FAIL."),
        _said("x\n===\nthreshold 3: PASS.\nvs near: PASS.\n vs near: ", F.when(c("even"), "PASS.").otherwise("FAIL."), "\nVS upper: PASS.\npoint: PASS. or FAIL."),
        _said("vs near: PASS.\npoint: ", c("event_type"), " PASS."),
    ]
    m = verifications(F.col("t"))
    return _events(spark, sf_dir).withColumn("t", F.element_at(F.array(*texts), (c("user_id") % 3 + 1).cast("int"))).select("event_id", pass_or_fail(F.col("t")).alias("result"), m["near"].alias("near"), m["far one"].alias("far"), F.size(m).alias("n"))


@query(EVENT_TEXT_SQL + "SELECT event_id, 2 AS n, 'increase' AS first, user_id::INT AS stop, 'keep steady' AS last FROM e")
def extract_segments(spark, sf_dir):
    s = listed_segments(_said("trend_segments=[(increase, 0, ", F.col("user_id"), "), (keep steady,", F.col("user_id"), ", 9999)]"))
    return _events(spark, sf_dir).select("event_id", F.size(s).alias("n"), s[0]["type"].alias("first"), s[0]["stop"].alias("stop"), s[1]["type"].alias("last"))


@query(EVENT_TEXT_SQL + "SELECT event_id, event_type AS metric, user_id::DOUBLE AS period, v AS amplitude, CASE WHEN even THEN 'increase' ELSE 'decrease' END AS trend, v AS first, 1 AS n_segments, 0.05::DOUBLE AS noise, v AS mean, 64 AS length, 2 AS n FROM e")
def extract_metric_blocks(spark, sf_dir):
    c = F.col
    text = _said("metric: ", c("event_type"), "\nseason=sine, period=", c("user_id"), ", amp=", _two(c("v")), "\noverall trend=", F.when(c("even"), "increase").otherwise("decrease"), ", start=", _two(c("v")), ", end=1.5, amp=2\ntrend_segments=[(increase, 0, 9)]\nnoise=gaussian, strength=0.05\nstats: mean=", _two(c("v")), ", std=3.1\nlen=64\n---\nmetric: other\n---\nnothing here")
    b = measure_blocks(text)
    x = _events(spark, sf_dir).select("event_id", b.alias("b")).withColumn("x", F.col("b")[0])
    return x.select("event_id", "x.metric", "x.period", "x.amplitude", "x.trend", "x.first", F.size("x.segments").alias("n_segments"), "x.noise", F.col("x.stats")["mean"].alias("mean"), "x.length", F.size("b").alias("n"))


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE WHEN even THEN 'increase' ELSE 'keep steady' END AS winner FROM e")
def extract_dominant_winner(spark, sf_dir):
    text = _said("- increase: 3\nComparison of durations: ", F.when(F.col("even"), "Increase").otherwise("keep steady"), " > decrease\nanswer: decrease")
    return _events(spark, sf_dir).select("event_id", dominant(text).alias("winner"))


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE WHEN even THEN v END AS number, CASE WHEN even THEN v::VARCHAR END IS NULL AS missing FROM e")
def safe_float(spark, sf_dir):
    text = F.when(F.col("even"), _said(" ", _two(F.col("v")), " ")).otherwise("inf")
    return _events(spark, sf_dir).select("event_id", finite(text).alias("number"), finite(text).isNull().alias("missing"))


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE WHEN even THEN 2 ELSE 0 END AS n, CASE WHEN even THEN v END AS first, true AS mixed FROM e")
def number_list(spark, sf_dir):
    a = bracketed(F.when(F.col("even"), _said("so [", _two(F.col("v")), ", about 7] or [1]")).otherwise("none: []"))
    return _events(spark, sf_dir).select("event_id", F.size(a).alias("n"), F.try_element_at(a, F.lit(1)).alias("first"), bracketed(F.lit("[1, x]")).isNull().alias("mixed"))


@query(EVENT_TEXT_SQL + "SELECT event_id, event_type AS type, v AS value, even AS ok, CASE WHEN user_id % 4 = 2 THEN user_id % 40 ELSE 1 END::BIGINT AS deep FROM e WHERE user_id % 4 < 3 UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM e WHERE user_id % 4 = 3")
def clean_json_text(spark, sf_dir):
    """Objects after others, in fences, up to forty levels deep with braces in strings, and one that isn't closed."""
    c = F.col
    body = _said('{"type": "', c("event_type"), '", "value": ', _two(c("v")), ', "ok": ', F.when(c("even"), "True").otherwise("False"), ', "in": {"deep": 1,}, "no": None,}')
    n = (c("user_id") % 40).cast("int")
    nested = _said('{"type": "', c("event_type"), '", "value": ', _two(c("v")), ', "say": "}{ \\" {", "ok": ', F.when(c("even"), "True").otherwise("False"), ', "in": {"deep": ', n, ', "more": ', F.repeat(F.lit('{"k": '), n), "0", F.repeat(F.lit("}"), n), "}}")
    texts = [_said('first {"type": 0} then ', body, " end"), _said("Here:\n```json\n", body, "\n```\nand {more}"), _said('{"a": {}} and ', nested, " end"), _said("{ open ", body)]
    text = F.element_at(F.array(*texts), (c("user_id") % 4 + 1).cast("int"))
    j = F.from_json(json_object(text), "type string, value double, ok boolean, `in` struct<deep: bigint>")
    return _events(spark, sf_dir).select("event_id", j.alias("j")).select("event_id", "j.type", "j.value", "j.ok", F.col("j.in.deep").alias("deep"))


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE WHEN even THEN 'time series ' || user_id ELSE 'A, ' || event_type END AS subject, CASE WHEN even THEN 'clustering' ELSE 'correlation' END AS task, CASE WHEN even THEN 'local' ELSE 'trend,seasonal' END AS asked FROM e")
def question_parts(spark, sf_dir):
    """The subject, the kind and the asked perspectives of questions."""
    c = F.col
    text = F.when(c("even"), _said("Find what is related to time series ", c("user_id"), " by local changes?")).otherwise(_said("What correlation in trend and periodicity is between A and ", c("event_type"), "?"))
    return _events(spark, sf_dir).withColumn("q", text).select("event_id", subject(c("q")).alias("subject"), task_type(F.lit(None).cast("string"), c("q")).alias("task"), F.array_join(perspectives(c("q")), ",").alias("asked"))


@query(EVENT_TEXT_SQL + "SELECT event_id, CASE WHEN even THEN 'yes' ELSE 'no' END AS verdict, event_type = 'click' AS same FROM e")
def verdict_normalize(spark, sf_dir):
    c = F.col
    return _events(spark, sf_dir).select("event_id", normal_verdict(F.when(c("even"), " Opposite ").otherwise("different")).alias("verdict"), same_name(c("event_type"), F.lit("The Click_s")).alias("same"))


@query(EVENT_TEXT_SQL + "SELECT event_id, event_type = 'click' AS exact, true AS inside, event_type AS answer FROM e")
def em_check(spark, sf_dir):
    """Answers in tags against some golds: equal to one, or holding one."""
    from .text import normal_answer

    c = F.col
    said = last_tagged(_said("<answer>sample</answer> so <answer>The ", c("event_type"), "!</answer>"))
    golds = F.array(F.lit("click"), c("event_type"))
    e = _events(spark, sf_dir).withColumn("a", normal_answer(said))
    return e.select("event_id", F.exists(F.array(F.lit("a Click.")), lambda g: normal_answer(g) == c("a")).alias("exact"), F.exists(golds, lambda g: c("a").contains(normal_answer(g))).alias("inside"), c("a").alias("answer"))


@query(EVENT_TEXT_SQL + "SELECT event_id, (user_id * 1000)::VARCHAR AS strict, printf('%.2f', v) AS flexible FROM e")
def gsm8k_extract(spark, sf_dir):
    c = F.col
    text = _said("it is 5 #### 12\n#### ", F.format_number(c("user_id") * 1000, 0))
    return _events(spark, sf_dir).select("event_id", hash_answer(text).alias("strict"), last_number(_said("so 3 or ", _two(c("v")), " .")).alias("flexible"))


@query(EVENT_TEXT_SQL + """SELECT event_id, CASE user_id % 3 WHEN 0 THEN '\\frac{' || user_id || '}{2}' WHEN 1 THEN repeat('{', (user_id % 50)::INT) || event_type || repeat('}', (user_id % 50)::INT) END AS box,
CASE user_id % 3 WHEN 0 THEN user_id::VARCHAR || '000' WHEN 1 THEN user_id::VARCHAR ELSE '3' END AS plain, '\\frac{1}{3}' AS fraction, '\\sqrt{7}' AS root FROM e""")
def boxed_extract(spark, sf_dir):
    r"""Results in \boxed, some very deep and one not closed, and answers in one form."""
    c = F.col
    pick = lambda *x: F.element_at(F.array(*x), (c("user_id") % 3 + 1).cast("int"))
    n = (c("user_id") % 50).cast("int")
    box = boxed(pick(_said("thus \\boxed{1} and \\boxed{\\frac{", c("user_id"), "}{2}}."), _said("so \\boxed{", F.repeat(F.lit("{"), n), c("event_type"), F.repeat(F.lit("}"), n), "} or {x}"), F.lit("\\boxed{1} then \\boxed{open {x}")))
    plain = final_answer(pick(_said("x = $", c("user_id"), ",000$ dollars"), _said("angle = ", c("user_id"), "^\\circ"), F.lit("3 multiples")))
    return _events(spark, sf_dir).select("event_id", box.alias("box"), plain.alias("plain"), final_answer(F.lit("\\frac13")).alias("fraction"), final_answer(F.lit("\\boxed{\\sqrt7}")).alias("root"))


def position_share(p: Column, g: Column, length: Column) -> Column:
    """1 less the distance as a share of the length, 0 at least."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(p - g) / length))


def number_share(p: Column, g: Column, length: Column | None = None) -> Column:
    """The same by the truth's size, 1 at least, or by a length; a missing number is 0."""
    scale = F.greatest(F.abs(g), F.lit(1.0))
    scale = scale if length is None else F.when(length > 0, length).otherwise(scale)
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(p - g) / scale), F.lit(0.0))


def list_share(p: Column, g: Column) -> Column:
    """The mean over the longer of two lists; missing and surplus members count 0."""
    both = F.zip_with(F.coalesce(p, F.array().cast("array<double>")), g, lambda a, b: number_share(a, b))
    n = F.size(both)
    return F.when(g.isNull(), 0.0).when(n == 0, 1.0).otherwise(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / n)


@query(EVENT_TEXT_SQL + "SELECT event_id, round(greatest(0, 1 - abs(v - 20) / 500), 6) AS place, round(greatest(0, 1 - abs(v - 20) / 20), 6) AS number, round(greatest(0, 1 - abs(v - 20) / 20) / 3 + 1 / 3.0, 6) AS list, round(least(0, -(v - 80) / 20 * 0.5), 6) AS penalty FROM e")
def accuracy_shares(spark, sf_dir):
    """position_accuracy, numeric_relative_accuracy, list_relative_accuracy and the penalty of overlong answers."""
    v, g = F.col("v"), F.lit(20.0)
    lists = list_share(F.array(v, F.lit(5.0)), F.array(g, F.lit(5.0), F.lit(6.0)))
    return _events(spark, sf_dir).select("event_id", rnd(position_share(v, g, F.lit(500.0)), 6).alias("place"), rnd(number_share(v, g), 6).alias("number"), rnd(lists, 6).alias("list"), rnd(overlong(v, 100, 20, 0.5), 6).alias("penalty"))


@query("SELECT n_regionkey AS k, CASE count(*) WHEN 1 THEN min(n_name) ELSE array_to_string((list(n_name ORDER BY n_name))[:-2], ', ') || ', and ' || max(n_name) END AS names, min(n_name) AS one, min(n_name) || ' and ' || max(n_name) AS two, '{\"n\":' || count(*) || ',\"names\":[\"' || min(n_name) || '\"]}' AS json FROM nation GROUP BY n_regionkey")
def format_lists(spark, sf_dir):
    """Lists in words, and a structure as JSON."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("a"))
    a = F.col("a")
    return n.select("k", listed_text(a).alias("names"), listed_text(F.slice(a, 1, 1)).alias("one"), listed_text(F.array(a[0], F.element_at(a, -1))).alias("two"), F.to_json(F.struct(F.size(a).alias("n"), F.slice(a, 1, 1).alias("names"))).alias("json"))
