"""Every query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tidegrove import catalog
from tidegrove.functions import text
from tidegrove.registry import _nudged

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert a == b


def test_every_query_has_sql_or_a_test():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"karmarkar_karp", "score_local_events"}  # tested below and in test_scores.py


def test_rounding_nudge_goes_before_the_digits():
    assert _nudged("round(avg(x), 2)") == "(round((avg(x)) + 1e-9, 2) + 0.0)"


def test_parsers(spark):
    from pyspark.sql import functions as F

    rows = [("<think>answer: 1\nVerdict: no</think>yes 3.5",), ("nothing",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(text.answer_line(text.think(F.col("t"))).alias("a"), text.first_number(text.without_think(F.col("t"))).alias("n")).collect()
    assert [tuple(r) for r in got] == [("no", 3.5), (None, None), (None, None)]


def test_score_parts(spark):
    from pyspark.sql import functions as F

    from tidegrove.functions import scoring as S

    rows = [("a, b", "b,a", ["x"], ["x"]), ("3", "3.001", ["x", "y", "z"], ["x"]), (None, "1", None, ["x"]), ("q", None, ["x"], []), ("u", "v", [], []), ("1e", "2", ["y"], ["x"])]
    d = spark.createDataFrame(rows, "p string, g string, a array<string>, b array<string>")
    got = d.select(S.enumeration_verdict(F.col("p"), F.col("g")).alias("e"), F.round(S.set_verdict(F.col("a"), F.col("b")), 4).alias("s")).collect()
    assert [r["e"] for r in got] == [1.0, 1.0, 0.05, 1.0, 0.0, 0.0]
    assert [r["s"] for r in got] == [1.0, 0.4, 0.05, 0.0, 1.0, 0.0]


def test_ids_of_any_size_have_an_order(spark):
    from tidegrove.operators.sampling import order_key, ranked

    rows = [(k, g) for k, g in [(4_000_000_000, "a"), (10**12, "a"), (-(2**63), "a"), (2**63 - 1, None), (5, None), (None, "a")]] + [(k, "hot") for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, g string").withColumn("h", order_key())
    got = ranked(d.where("doc_id is not null"), "g").collect()
    assert len(got) == len(rows) - 1
    for g in ("a", None, "hot"):
        own = sorted((r["h"], r["doc_id"], r["r"]) for r in got if r["g"] == g)
        assert [r for _, _, r in own] == list(range(1, len(own) + 1))


def test_channels_stay_few(spark):
    """Pairs grow in proportion to the series: a sample has five channels whatever the input."""
    p = catalog.queries()["cross_stat_ratio"](spark, DIR).groupBy("sample").count().agg({"count": "max"}).first()[0]
    assert p <= 10


def test_assertions_fail_the_job(spark):
    from pyspark.sql import functions as F

    from tidegrove.operators.preparation import must_hold, with_series

    d = spark.createDataFrame([(1,), (2,)], "k int")
    assert must_hold(d, small=F.col("k") < 3).count() == 2
    for bad in (must_hold(d, small=F.col("k") < 2), d.select(with_series(F.lit("<ts>"), F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0)))))):
        with pytest.raises(Exception):  # noqa: B017
            bad.collect()


def test_registries():
    from tidegrove.plans.extension import Registry

    r = Registry("thing")
    f = r("a")(lambda: 1)
    assert r["a"] is f
    with pytest.raises(ValueError):
        r("a")(lambda: 2)
    with pytest.raises(KeyError):
        r["b"]


def test_user_code_by_path(tmp_path):
    from tidegrove.plans.extension import load

    (tmp_path / "x.py").write_text("def f(a):\n    return a + 1\n")
    assert load(str(tmp_path / "x.py"), "f")(1) == 2
    with pytest.raises(AttributeError):
        load(str(tmp_path / "x.py"), "g")


def test_sampling_on_any_rows(spark):
    """Null kinds and verdicts, ties, repeated rows, clashing columns, empty tables; a kind that holds a third of all rows."""
    import collections

    from tidegrove.operators import sampling as S

    rows = [(k, "hot", k % 3, 1) for k in range(300)] + [(1000 + k, None, 0 if k < 5 else 1, 1) for k in range(40)] + [(2000 + k, "small", None, 1) for k in range(3)] + [(3000, "one", 2, 1)] * 4
    d = S.keyed(spark.createDataFrame(rows, "doc_id bigint, kind string, verdict int, size int").repartition(7))
    count = lambda df, *by: collections.Counter(tuple(r[c] for c in by) for r in df.collect())
    got = count(S.capped(d, "kind", least=5), "kind")
    assert got[(None,)] == 40 and got[("small",)] == 3 and got[("one",)] == 4 and got[("hot",)] == 105
    got = count(S.balanced(d, "kind", "verdict"), "kind", "verdict")
    assert got == {("hot", 0): 100, ("hot", 1): 100, ("hot", 2): 100, (None, 0): 5, (None, 1): 5, ("small", None): 3, ("one", 2): 4}
    got = count(S.capped_verdicts(d, "kind", "verdict"), "kind")
    assert got[("hot",)] == 300 and got[(None,)] == 40
    assert sum(count(S.spread_over(d, "kind", 50), "kind").values()) == 50
    got = count(S.in_proportion(d, "kind", 40), "kind")
    assert sum(got.values()) == 40 and min(got.values()) >= 1 and len(got) == 4
    for f in (S.capped, lambda x, k: S.balanced(x, k, "verdict"), lambda x, k: S.capped_verdicts(x, k, "verdict"), lambda x, k: S.spread_over(x, k, 9), lambda x, k: S.in_proportion(x, k, 9)):
        assert f(d.limit(0), "kind").count() == 0
        assert f(d, "kind").columns == d.columns
    again = S.capped(d.repartition(3), "kind", least=5)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, S.capped(d, "kind", least=5).collect()), key=str)


def test_estimators_on_any_rows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidegrove.operators import groupstats as G

    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), (None, 2.0), (None, 2.0)], "g string, s double")
    w = Window.partitionBy("g")
    s = F.col("s")
    cols = [G.normalised(s, w), G.normalised_floored(s, w), G.leave_one_out(s, w), G.leave_one_out_from_sum(s, w), G.less_weighted_mean(s, w, F.lit(1.0))]
    got = {(r[0], r[1]): [None if x is None else round(x, 3) for x in r[2:]] for r in d.select("g", "s", *cols).collect()}
    assert got["a", 1.0] == [-0.707, -0.707, -2.0, -2.0, -1.0] and got["a", None] == [None] * 5
    assert got["b", 5.0] == [5.0, 0.0, 5.0, 0.0, 0.0] and got[None, 2.0] == [0.0, 0.0, 0.0, 0.0, 0.0]
