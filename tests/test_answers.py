"""Rules of reading and rating answers: tables of cases, and texts of any length and depth."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrove.functions import judging as J
from tidegrove.functions import parsing as P
from tidegrove.functions import text as T
from tidegrove.functions.brackets import last_object, until_closed


def apply(spark, f, *columns):
    rows = list(zip(range(len(columns[0])), *columns, strict=True))
    names = [f"c{k}" for k in range(len(columns))]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    return [r["x"] for r in sorted(df.select("i", f(*(F.col(n) for n in names)).alias("x")).collect())]


def near(p, g):
    return math.exp(-abs(p - g) / (0.1 * max(abs(g), 1)))


BINARY = [("yes", "yes", 1.0), ("Yes, it is", "yes", 1.0), ("I think yes", "yes", 0.0), ("maybe, no", "no", 0.0), ("not sure", "no", 1.0), ("No.", "no", 1.0), ("no", "yes", 0.05), ("YES", "No", 0.05), ("perhaps", "yes", 0.0), ("yes", "unknown", 1.0), (None, "yes", 0.0), ("no", None, 1.0)]
SETS = [("(A, B)", "(a, b)", 1.0), ("(A) and (B)", "(A)", 1.0), ("(a)", "(a, b)", 2 / 3), ("()", "()", 1.0), ("()", "(a)", 0.0), ("( )", "(x)", 0.0), ("a, b", "(a)", 0.0), ("(a)", "nothing", 1.0), ("(a, a, b)", "(b, a)", 1.0), ("(c)", "(a, b)", 0.0), ("(a, b, c)", "(a)", 0.5)]
LISTS = [("[1, 2]", "[1, 2]", 1.0), ("so [1, 2] it is", "[1, 2]", 1.0), ("[1]", "[1, 2]", 0.25), ("[1, 2, 3]", "[1, 2]", 2 / 3), ("[]", "[1]", 0.0), ("[1]", "[]", 0.0), ("[nan]", "[1]", 0.0), ("[1, x]", "[1]", 0.0), ("[1,]", "[1]", 1.0), ("3", "[3]", 0.0), ("5", "5.0", 1.0), ("5", "6", near(5, 6)), ("x", "6", 0.0), ("nan", "word", 0.05), ("Word", "word", 1.0), ("-1e1", "-10", 1.0), ("[1.5e0, .5]", "[1.5, 0.5]", 1.0)]


def test_binary_verdicts(spark):
    p, g, want = zip(*BINARY, strict=True)
    assert apply(spark, J.binary, p, g) == list(want) == apply(spark, T.verdict_binary, p, g)


def test_polymorphic_verdicts(spark):
    p, g, want = zip(*LISTS, strict=True)
    assert apply(spark, J.polymorphic, p, g) == pytest.approx(list(want))


def test_scores_of_whole_answers(spark):
    """Sets are read from the first answer of the reasoning, other verdicts from the last answer line of the block."""
    p = [f"<think>answer: (z)\n===\nanswer: {a}\nanswer: (last)</think>" for a, _, _ in SETS]
    g = [f"<think>x\n===\nanswer: {b}</think>" for _, b, _ in SETS]
    assert apply(spark, lambda a, b: J.score(a, b, F.lit("clustering")), p, g) == pytest.approx([w for *_, w in SETS])
    cases = [x for x in BINARY if None not in x[:2]]
    p = [f"<think>answer: no\nverdict: {a}\n</think> yes" for a, _, _ in cases]
    g = [f"<think>Answer: {b}</think>" for _, b, _ in cases]
    assert apply(spark, lambda a, b: J.score(a, b, F.lit("yes_no")), p, g) == [w for *_, w in cases]


def test_scalar_answers(spark):
    cases = {"answer: 3.5": "3.5", "answer: -2 or so": "-2", "the final answer: no\nanswer: yes": "yes", "answer: above\n===\nx": None, "answer: above\n===\nANSWER:\n  Below": "below", "": None, "answer:": None, "a\u2028answer: x": None, "a\nanswer: é!": "é!"}
    assert apply(spark, P.scalar_answer, [*cases, None]) == [*cases.values(), None]


def test_checks_below_the_line(spark):
    cases = {
        "x\n===\nThreshold: PASS.\npoint: PASS.": ("yes", {}), "x\n===\ncomparison FAIL.\nvs B: FAIL.\nit: fail.": ("no", {"B": False}), "PASS.": (None, {}), "x\n===\n vs B (b): far, pass.\nvs C: PASS. FAIL.": (None, {"B (b)": True, "C": False}),
        "x\n===\nvs B: PASS.\nvs B: FAIL.": (None, {"B": False}), "x\n===\nVS B: PASS.\nbypass": (None, {}), "x\n===\nvs : PASS.\nvs D: none": (None, {}), "x\n===\nok: PASS. FAIL.": ("no", {}),
    }
    assert apply(spark, P.pass_or_fail, [*cases, None]) == [*(v for v, _ in cases.values()), None]
    assert apply(spark, P.verifications, [*cases, None]) == [*(m for _, m in cases.values()), {}]


def test_repeated_statistics_keep_the_last(spark):
    blocks = apply(spark, P.measure_blocks, ["metric: A\nstats: mean=1, mean=2, std=3, std=x", "metric: A", None])
    assert blocks[0][0]["stats"] == {"mean": 2.0, "std": 3.0} and blocks[1][0]["stats"] is None and blocks[2] is None


def brute_object(text):
    """The last top {...}, character by character."""
    depth, quoted, skip, start, out = 0, False, False, None, None
    for k, c in enumerate(text):
        if quoted:
            quoted, skip = not (c == '"' and not skip), c == "\\" and not skip
        elif c == '"':
            quoted = True
        elif c == "{":
            start = k if depth == 0 else start
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and start is not None:
                out, start = text[start : k + 1], None
    return out


def test_objects_equal_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choice('{}{}{}"\\ab\n:é\U0001f600') for _ in range(r.randint(0, 40))) for _ in range(3000)] + ['{"a": "}"} x', "}{}", '\\"{\\"}', '{"a\\"}": {}}']
    assert apply(spark, last_object, [*texts, None]) == [*map(brute_object, texts), None]


def test_boxes_equal_brute_force(spark):
    def brute(text):
        at, depth = text.rfind("\\boxed{"), 1
        if at < 0:
            return None
        for k in range(at + 7, len(text)):
            depth += {"{": 1, "}": -1}.get(text[k], 0)
            if depth == 0:
                return text[at + 7 : k]
        return None

    r = random.Random(6)
    texts = ["".join(r.choice(["{", "}", "}", "a", "\\boxed{", "\n", "é", "\\"]) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    assert apply(spark, P.boxed, [*texts, None]) == [*map(brute, texts), None]
    assert apply(spark, until_closed, ["", "}", "a}b"]) == [None, "", "a"]


def test_texts_of_any_length_and_depth(spark):
    """A million characters, and depth 50 and 5000, in columns and in constants, which the driver folds."""
    long = '{"a": "' + "x" * 10**6 + '"}'
    words = '{"a": [' + ", ".join(['"w \\" {"'] * 100_000) + "]}"
    deep = '{"k": ' * 50 + "1" + "}" * 50
    deeper = "{" * 5000 + "}" * 5000
    texts = [f"say {long} now", f"say {words} now", f"say {deep} now", deeper, "{" * 10**6, "no object " * 10**5]
    assert apply(spark, last_object, texts) == [long, words, deep, deeper, None, None]
    assert json.loads(apply(spark, P.json_object, [texts[2]])[0])["k"] and len(apply(spark, P.json_object, [texts[0]])[0]) == len(long)
    boxes = ["x" * 10**6, "{" * 50 + "a" + "}" * 50, "{x}" * 300_000]
    assert apply(spark, P.boxed, [f"so \\boxed{{{b}}} it is" for b in boxes]) == boxes
    for f, text, want in ((P.json_object, texts[0], long), (P.boxed, f"\\boxed{{{boxes[2]}}}", boxes[2])):
        assert spark.range(1).select(f(F.lit(text)).alias("x")).first()["x"] == want


def test_mended_json(spark):
    cases = {'{"a": True, "b": None, "c": [1,],}': {"a": True, "b": None, "c": [1]}, '{"a": "say-"no"-to"}': {"a": 'say-"no"-to'}, 'x ```JSON\n{"a": {"b": 1}}\n``` {"c": 2}': {"a": {"b": 1}}}
    got = apply(spark, P.json_object, [*cases, "nothing", '{"a":"b","c":["d","e"]}'])
    assert json.loads(got[4]) == {"a": "b", "c": ["d", "e"]}
    assert json.loads(got[0]) == {"a": True, "b": None, "c": [1]} and json.loads(got[2]) == {"a": {"b": 1}} and got[3] is None
    assert json.loads(got[1]) == {"a": 'say-"no"-to'}


def test_answers_of_mathematics_in_one_form(spark):
    cases = {"45^\\circ": "45", "3 multiples": "3", "x = 5 \\text{m}": "5", "1,000,000 dollars": "1000000", "\\frac12": "\\frac{1}{2}", "\\sqrt3": "\\sqrt{3}", "$x$": "x", "10\\text{ cm}^2": "10", "7^{\\circ}": "7", "5\\;km": "5", '"4"': "4", "\\mathrm{th}6": "6", "an apple": "apple", "2,\\!000": "2000"}
    got = apply(spark, P.final_answer, list(cases))
    assert dict(zip(cases, got, strict=True)) == cases
    assert len(P.REMOVED) == 41 and len(set(P.REMOVED)) == 41


def test_tables_of_many_tasks_are_read_without_a_shuffle(spark, tmp_path):
    """A table with a scan task for each core or more isn't dealt out; one small file is."""
    from tidegrove import catalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "events.parquet"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
        for name in ("compute_score", "reasoning_coherency", "extract_metric_blocks"):
            plan = lambda folder: catalog.queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()  # noqa: B023, E731
            assert "Exchange" not in plan(tmp_path) and "Exchange" in plan("/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_row_groups_that_few_tasks_hold_are_dealt_out(spark, tmp_path, monkeypatch):
    """A file of many scan tasks whose rows lie in one row group, and tasks of too many rows: no task gets more than its share."""
    from tidegrove.operators import generators

    spark.read.parquet("/root/testdata/sf0.01/events.parquet").coalesce(1).write.parquet(str(tmp_path / "one"))
    sizes = lambda df: [len(x) for x in df.rdd.glom().collect()]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "8k")
        e = spark.read.parquet(str(tmp_path / "one"))
        assert e.rdd.getNumPartitions() >= 16 and max(sizes(e)) == 10000
        got = sizes(generators.dealt(e))
        assert sum(got) == 10000 and max(got) <= 10000 / 32 + 32
        many = e.repartition(16).localCheckpoint()
        assert generators.dealt(many).rdd.getNumPartitions() == 16
        monkeypatch.setattr(generators, "TASK_ROWS", 100)
        got = sizes(generators.dealt(many))
        assert sum(got) == 10000 and len(got) == 100 and max(got) <= 120
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_tags_that_are_not_closed_are_read_once(spark):
    """Of an answer that only opens blocks, each tag was searched from to the end of the text."""
    import time

    from tidegrove.functions import text

    began = time.time()
    assert apply(spark, text.think, ["<think>" * 60000, "<think>" * 60000 + " a </think>b</think>", "a</think><think> b", "<think></think>", None]) == [None, "<think>" * 59999 + " a", None, "", None]
    assert time.time() - began < 20


def test_reasoning_is_what_the_first_mark_leaves(spark):
    from tidegrove.functions import reasoning

    assert apply(spark, reasoning.reasoning, ["é😀\n===\nb === c", "====", "===", "==", "", None]) == ["\nb === c", "=", "", None, None, None]


def test_values_of_a_block_are_the_last_of_their_first_line(spark):
    """Also where a name stands in a value, is the end of another, or has no value."""
    lines = "metric: A\nrestart=9 start=x\noverall trend=overall trend=up, start=1, start=2, start=\nend=start=5, end=3 end=\nstart=7\noverall trend=,"
    got = apply(spark, lambda t: F.to_json(P.measure_blocks(t)), [lines, "metric: A\nstats: mean=1, mean=2"])
    assert [json.loads(x) for x in got] == [[{"metric": "A", "trend": "up", "first": 2.0, "last": 3.0}], [{"metric": "A", "stats": {"mean": 2.0}}]]


def test_many_names_in_a_text_are_looked_up_once(spark):
    """Statistics and comparisons whose names all differ: each name was searched for among all others."""
    import time

    n = 100_000
    texts = ["metric: A\nstats: " + ", ".join(f"k{i}={i}" for i in range(n)), "x\n===\n" + "\n".join(f"vs c{i}: PASS." for i in range(n))]
    began = time.time()
    assert apply(spark, lambda t: F.array(F.coalesce(F.size(F.try_element_at(P.measure_blocks(t), F.lit(1))["stats"]), F.lit(0)), F.size(P.verifications(t))), texts) == [[n, 0], [0, n]]
    assert time.time() - began < 20


def test_many_conditions_are_looked_up_once(spark):
    """Conditions whose numbers all differ: all others were searched for each."""
    import time

    n = 20_000
    began = time.time()
    assert apply(spark, lambda t: F.size(J.labelled(t, "condition")), ["\n".join(f"condition {i}: met" for i in range(n))]) == [n]
    assert time.time() - began < 20


def test_passages_of_a_label(spark):
    """The first of a number counts; a colon in a passage, other labels and texts without one."""
    cases = ["Condition 1: a: b\ncondition 2: c condition 1: d\nall conditions: e", "event 3:x summary: condition 07:y", "preconditions 1: x", "", None]
    got = apply(spark, lambda t: J.labelled(t, "condition"), cases)
    assert got == [{"1": " a: b\n", "2": " c "}, {"07": "y"}, {}, {}, None]


def test_parts_of_two_scores_are_worked_out_once(spark):
    """The verdict's and the judgment's score weigh the same coherency, comparisons and evidence."""
    from tidegrove import catalog

    plan = catalog.queries()["score_yes_no"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THRESHOLD") == 1
