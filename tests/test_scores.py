"""Scores that SQL can't express, against brute force, and texts with missing or odd parts."""

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrove import catalog
from tidegrove.functions import evidence as E
from tidegrove.functions import reasoning as R
from tidegrove.operators.cross import channels
from tidegrove.operators.segments import segments
from tidegrove.operators.series import series
from tidegrove.plans.inference import infer
from tidegrove.plans.split import split

DIR = "/root/testdata/sf0.001"


def best_sum(gain):
    """Over all choices of distinct columns for the rows, by the set of columns taken."""
    if gain.shape[0] > gain.shape[1]:
        return best_sum(gain.T)
    best = {0: 0.0}
    for row in gain.tolist():
        more = {}
        for taken, total in best.items():
            for c, x in enumerate(row):
                if not taken >> c & 1:
                    more[taken | 1 << c] = max(more.get(taken | 1 << c, -1.0), total + x)
        best = more
    return max(best.values())


@pytest.mark.parametrize("shape", [(1, 1), (2, 2), (3, 5), (5, 3), (1, 6), (6, 6)])
def test_assignment_is_the_best(shape):
    rng = np.random.default_rng(7)
    for k in range(20):
        gain = rng.random(shape) if k % 2 else rng.integers(0, 3, shape).astype(float)  # many ties
        got = E.assign(gain)
        assert len(got) == min(shape) == len({r for r, _ in got}) == len({c for _, c in got})
        assert sum(gain[r, c] for r, c in got) == pytest.approx(best_sum(gain))


def test_events_score_equals_brute_force(spark):
    got = {r["g"]: r for r in catalog.queries()["score_local_events"](spark, DIR).collect()}
    orders = {}
    for r in spark.read.parquet(f"{DIR}/lineitem.parquet").collect():
        orders.setdefault(r["l_orderkey"], []).append(r)
    assert set(got) == set(orders)
    for g, rows in orders.items():
        event = lambda r, at: {"type": r["l_returnflag"], "pos": at, "amplitude": r["l_quantity"]}
        truth = [event(r, float(r["l_linenumber"])) for r in rows]
        told = [event(r, r["l_linenumber"] + 10 * r["l_discount"]) for r in rows if r["l_partkey"] % 2]
        if told:
            gain = np.array([[E.pair_score(p, t, 20) for p in told] for t in truth])
            want = max(best_sum(gain) / len(truth), 0.08 + 0.05 * (len(told) == len(truth)))
        else:
            want = 0.0
        assert got[g]["score"] == pytest.approx(want, abs=2e-6)


def test_events_score_of_nothing():
    one = [{"type": "shake", "pos": 1.0, "amplitude": 2.0}]
    assert E.events_score(None, None, 9) == E.events_score([], [], 9) == E.events_score(one, one, 9) == 1.0
    assert E.events_score([], one, 9) == 0.0 and E.events_score(one * 2, [], 9) == 0.6 and E.events_score(one * 9, None, 9) == 0.0
    bare = [{"type": None, "pos": None, "amplitude": None}]
    assert E.events_score(bare, one, 9) == pytest.approx(0.13)


def test_lists_of_equal_lengths_are_scored_together(monkeypatch):
    """A batch gives what its lists give one by one, looks each pair of types up once a shape, and assigns each shape once."""
    rng = np.random.default_rng(11)
    words = ["spike", "upward spike", "shake", None]
    event = lambda: {"type": words[rng.integers(4)], "pos": None if rng.random() < 0.2 else float(rng.integers(20)), "amplitude": None if rng.random() < 0.2 else float(rng.integers(-5, 5))}
    lists = [[[event() for _ in range(rng.integers(4))] for _ in range(600)] for _ in "pg"]
    lists[0][0] = lists[1][1] = None
    seen, shapes, plain, assign_all = [], [], E.similarity, E.assign_all
    monkeypatch.setattr(E, "similarity", lambda a, b: seen.append((a, b)) or plain(a, b))
    monkeypatch.setattr(E, "assign_all", lambda gain: shapes.append(gain.shape) or assign_all(gain))
    got = E.events_scores(*(pa.array(x, pa.list_(E.EVENT)) for x in lists), np.full(600, 9.0))
    assert len(shapes) == 9 and len(seen) <= 9 * 16
    for p, g, x in zip(*lists, got, strict=True):
        if p and g:
            gain = np.array([[E.pair_score(a, b, 9.0) for a in p] for b in g])
            assert x == pytest.approx(max(best_sum(gain) / max(len(p), len(g)), 0.08 + 0.05 * (len(p) == len(g))))
        else:
            assert x == (0.0 if g else max(0.0, 1 - 0.2 * len(p or [])))


def test_similarity_is_the_same_as_a_column(spark):
    words = [None, "", "steady", "Keep_Steady", "keep steady", "upward spike", "downward spike", "wide upward spike", "sudden increase", "flat", "odd spike", "spike", "increase"]
    pairs = list(itertools.product(words, words))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", E.type_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in got] == [E.similarity(r["a"], r["b"]) for r in got]


CASES = [
    (R.yes_or_no, "d\n===\nevent: near. PASS.\nanswer: no", 0.0), (R.yes_or_no, "no rule", 0.5), (R.yes_or_no, None, 0.5), (R.yes_or_no, "===\nVS b: FAIL.\nanswer: yes", 0.5),
    (R.pair_verdict, "===\nB: no events. FAIL.\nanswer: not_opposite", 1.0), (R.pair_verdict, "===\nvs B: PASS.\nanswer: unsure", 0.5), (R.pair_verdict, None, 0.5),
    (R.cluster_members, "===\nvs B: PASS.\nvs C: FAIL.\nanswer: ()", 0.0), (R.cluster_members, "===\nvs C: FAIL.\nanswer: ()", 1.0), (R.cluster_members, "===\nC: none. FAIL.\nanswer: (A)", 1.0), (R.cluster_members, "===\nanswer: (A)", 0.5), (R.cluster_members, None, 0.5),
    (R.longest_duration, "===\naggregate durations:\n- increase: 5\n* keep steady: 2 + 3 = 5\nanswer: equal", 1.0), (R.longest_duration, "===\naggregate durations:\n- increase: 5\n- decrease: 9\nanswer: <b>decrease</b>", 1.0), (R.longest_duration, "===\nanswer: increase", 0.5), (R.longest_duration, None, 0.5),
    (R.half_comparison, "first_half [0, 9]: mean=3 second_half [9, 18]: mean=4\n===\nanswer: first half", 0.0), (R.half_comparison, "x\n===\nanswer: equal", 0.5), (R.half_comparison, None, 0.5),
    (R.conditions, "===\ncondition 1: met\nanswer: yes", 1.0), (R.conditions, "===\ncondition 1: event 1: pass summary: 0 of 1 pass\nanswer: yes", 0.0), (R.conditions, "===\nevent 1: pass\nevent 2: fail\nsummary: 1 of 2 pass", 1.0), (R.conditions, "===\nx -> not met\nanswer: no", 1.0), (R.conditions, "nothing", 0.5), (R.conditions, None, 0.5),
]


@pytest.mark.parametrize("check", sorted({c[0] for c in CASES}, key=lambda f: f.__name__))
def test_reasoning_checks(spark, check):
    rows = [(t, w) for f, t, w in CASES if f is check]
    got = spark.createDataFrame(rows, "t string, w double").select(check(F.col("t")).alias("s"), "w", "t").collect()
    assert [(r["t"], r["s"]) for r in got] == [(r["t"], r["w"]) for r in got]


def test_inference_tries_again_and_keeps_nulls(spark):
    def client():
        calls = []

        def reply(texts):
            calls.append(1)
            if len(calls) == 1:
                raise OSError("once")
            return [t.upper() for t in texts]

        return reply

    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "id int, t string").coalesce(1)
    assert [tuple(r) for r in infer(rows, "t", "said", client, batch=1).collect()] == [(1, "a", "A"), (2, None, None), (None, "c", "C")]
    assert infer(rows.where("false"), "t", "said", client).count() == 0
    with pytest.raises(ValueError):
        infer(rows, "t", "id", client)


def test_chunks_at_the_mean_are_not_above_it(spark):
    """A chunk that equals the mean of all is not above it, in whatever order the chunks are summed."""
    from tidegrove.operators.series import above_mean_share

    order = list(itertools.permutations([73.13, 58.5, 22.1, 2.35, 39.02]))  # 39.02 is the mean; the sums of doubles fall short
    rows = [(sid, k, m) for sid, ms in enumerate(order) for k, m in enumerate(ms)]
    got = above_mean_share(spark.createDataFrame(rows, "sid int, k int, m double")).collect()
    assert len(got) == len(order) and {r["share"] for r in got} == {0.4}


def _tied_events(tmp_path):
    """Series of small values with two digits in a random order of rows, in several files: many hold a value that equals their mean."""
    import duckdb

    (tmp_path / "events.parquet").mkdir()
    made = f"SELECT event_id, ts, event_id * 7919 % 1000 AS user_id, event_type, round(value / 200, 2) AS value, props FROM '/root/testdata/sf0.01/events.parquet'"
    for k in range(8):
        duckdb.sql(f"COPY (SELECT * FROM ({made}) WHERE hash(event_id) % 8 = {k} ORDER BY hash(event_id + 1)) TO '{tmp_path}/events.parquet/{k}.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["series_statistics", "stat_numerical"])
def test_values_at_the_mean_follow_the_order_of_time(spark, tmp_path, name):
    import duckdb

    d = _tied_events(tmp_path)
    got = catalog.queries()[name](spark, d)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    want = c.sql(catalog.oracle_sql()[name])
    cols = want.columns
    digits = lambda v: round(v, 6) if isinstance(v, float) else v
    assert {tuple(digits(r[x]) for x in cols) for r in got.collect()} == {tuple(map(digits, r)) for r in want.fetchall()}


def test_one_answer_outweighs_many(spark, tmp_path):
    """Of 100000 answers one has a third of all weight, the others too little each for eight digits."""
    import duckdb

    made = "SELECT k AS l_orderkey, k AS l_partkey, 1::BIGINT AS l_suppkey, 1 AS l_linenumber, CASE WHEN k = 7 THEN 50 ELSE 25.1 END::DOUBLE AS l_quantity, 0.05::DOUBLE AS l_discount, 0.04::DOUBLE AS l_tax FROM range(100000) r(k)"
    duckdb.sql(f"COPY ({made}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = catalog.queries()["pf_resample"](spark, str(tmp_path)).first()
    assert got["rows"] == got["drawn"] == 100000 and got["fair"]


def test_resampled_draws_as_many_as_rows(spark):
    """Weights that are no short binary fractions, one heavy row, zeros, one row alone."""
    from tidegrove.operators.rollouts import resampled

    for weights in ([0.1] * 30000, [1 / 3, 0.0] * 5000 + [1e4 / 7], [0.3]):
        d = spark.createDataFrame([(k, w) for k, w in enumerate(weights)], "k int, w double")
        got = {r["k"]: r["drawn"] for r in resampled(d, "k", "w").collect()}
        n, total = len(weights), sum(weights)
        assert len(got) == n == sum(got.values())
        assert all(abs(got[k] - n * w / total) < 1 + 1e-6 for k, w in enumerate(weights))


@pytest.mark.parametrize("most", [7, 50, 1200])
def test_a_split_ranks_its_questions_once(spark, most):
    """Shares of kinds of very different size, then what comes next of all; up to Spark's bound the questions are worked out once."""
    kind = F.when(F.col("id") % 500 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("many")
    asked = spark.range(3000).select(kind.alias("kind"), F.col("id").alias("key"), F.lit("").alias("sub"), F.lit("x").alias("part"), F.lit("yes").alias("answer"))
    got = split(asked, most, 3)
    place = lambda r: hashlib.md5(f"42|{r['kind']}|{r['key']}||x".encode()).hexdigest()
    rows, first = sorted(asked.collect(), key=place), []
    for k in ("rare", "some", "many"):
        first += [r for r in rows if r["kind"] == k][: most // 3]
    rest = [r for r in rows if r not in set(first)]
    assert sorted(got.collect()) == sorted(first + rest[: most - len(first)])
    if most <= 1000:
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 3000") == 1


def test_a_drawn_split_keeps_nothing(spark):
    drawn = catalog.queries()["generate_ood_for_split"](spark, DIR)
    assert drawn.count() == 210 and not any(f(spark, DIR).storageLevel.useDisk for f in (series, segments, channels))


def test_a_split_plans_no_two_kinds_at_once(spark):
    """The driver keeps the plan of each job, so the largest must not grow with the number of kinds."""
    from tidegrove.plans.split import KINDS, generate_ood_for_split, questions

    store = spark._jsparkSession.sharedState().statusStore()

    def plans(run):
        last = max((e.executionId() for e in listed()), default=-1)
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return [len(e.physicalPlanDescription()) for e in listed() if e.executionId() > last]

    def listed():
        jobs = store.executionsList()
        return [jobs.apply(k) for k in range(jobs.size())]

    alone = plans(lambda: questions(spark, DIR, {"ood_trend_reversal": KINDS["ood_trend_reversal"]}).collect())
    assert max(plans(lambda: generate_ood_for_split(spark, DIR).collect())) < 4 * max(alone)


@pytest.mark.parametrize("most", [2, 50, 1200])
def test_a_split_of_the_leading_questions_is_that_of_all(spark, most):
    """Kinds of one row, of fewer rows than their share, and of most rows; a kind without rows."""
    from tidegrove.plans.split import leading

    kind = F.when(F.col("id") == 7, "one").when(F.col("id") % 100 == 0, "few").otherwise("many")
    asked = spark.range(4000).select(kind.alias("kind"), F.col("id").alias("key"), F.lit("").alias("sub"), F.lit("x").alias("part"), F.lit("yes").alias("answer"))
    led = [leading(asked.where(F.col("kind") == k), most) for k in ("none", "one", "few", "many")]
    assert led[3].count() == most
    some = led[0].unionByName(led[1]).unionByName(led[2]).unionByName(led[3])
    assert sorted(split(some, most, 4).collect()) == sorted(split(asked, most, 4).collect())
