"""Parts of equal work over whole tables: bounds, levels and odd rows."""

import itertools
import random

import numpy as np
import pytest

from tidegrove import catalog
from tidegrove.operators import dealing as D

DIR = "/root/testdata/sf0.001"
SIZES = {"none": [], "one": [5], "equal": [9] * 40, "large": [1000] + [1] * 60, "nulls": [None, 0, None, 7, 3], "mixed": [random.Random(3).choice([None, 1, 2, 50, 700]) for _ in range(500)], "wide": [int(random.Random(k).paretovariate(0.7)) for k in range(700)]}


def frame(spark, sizes):
    rows = [(k * 10**15 - 4 * 10**18, n, "x", 1) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "id bigint, n bigint, place string, part int").repartition(3)


@pytest.mark.parametrize("name", SIZES)
def test_places_equal_a_sort(spark, name):
    got = sorted((r["place"], r["id"], r["n"]) for r in D.by_size(frame(spark, SIZES[name]), "id", "n").collect())
    want = sorted(((k * 10**15 - 4 * 10**18, n or 0) for k, n in enumerate(SIZES[name])), key=lambda x: (-x[1], x[0]))
    assert got == [(i, k, n) for i, (k, n) in enumerate(want)]


@pytest.mark.parametrize("name", SIZES)
@pytest.mark.parametrize(("parts", "together"), [(3, 512), (4, 3), (8, 2)])
def test_parts_are_even(spark, monkeypatch, name, parts, together):
    """Over several levels, too: counts differ by one, loads by what one run spans."""
    monkeypatch.setattr(D, "TOGETHER", together)
    sizes = [n or 0 for n in SIZES[name]]
    got = D.differenced(frame(spark, SIZES[name]), "id", "n", parts).collect()
    assert sorted((r["id"], r["n"]) for r in got) == sorted((k * 10**15 - 4 * 10**18, n) for k, n in enumerate(sizes))
    loads, counts = [0] * parts, [0] * parts
    for r in got:
        loads[r["part"]] += r["n"]
        counts[r["part"]] += 1
    order = sorted(sizes, reverse=True)
    order += [0] * (-len(order) % parts)
    spans = [max(x) - min(x) for x in itertools.batched(order, parts)]
    assert max(loads) - min(loads) <= max(spans, default=0)
    if together == 512:
        snake = [0] * parts
        for i, n in enumerate(order):
            snake[i % parts if i // parts % 2 == 0 else parts - 1 - i % parts] += n
        assert max(loads) - min(loads) <= max(snake) - min(snake) and max(snake) - min(snake) <= max(sizes, default=0)
        assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("k", [2, 3])
def test_differencing_is_near_the_best(k):
    r = np.random.default_rng(4)
    for _ in range(20):
        tuples = np.sort(r.integers(0, 100, (4, k)), axis=1)
        got = D.difference(tuples)
        assert (np.sort(got, axis=1) == np.arange(k)).all()
        apart = lambda moves: np.ptp([sum(t[j] for t, m in zip(tuples.tolist(), moves, strict=True) for j in range(k) if m[j] == p) for p in range(k)])  # noqa: B023, E731
        best = min(apart(x) for x in itertools.product(itertools.permutations(range(k)), repeat=4))
        assert best <= apart(got.tolist()) <= max(np.ptp(tuples, axis=1))
    assert D.difference(np.zeros((0, 3), np.int64)).shape == (0, 3)


def test_documents_are_dealt(spark):
    q = catalog.queries()
    docs = {r["doc_id"]: r["n_chars"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r["part"] for r in q["karmarkar_karp"](spark, DIR).collect()}
    loads = [sum(docs[d] for d, p in got.items() if p == k) for k in range(8)]
    before, after = (q[n](spark, DIR).first() for n in ("seqlen_unbalance", "seqlen_balanced"))
    assert got.keys() == docs.keys() and max(loads) - min(loads) <= after["hi"] - after["lo"] <= before["apart"]
    batches = q["micro_batches"](spark, DIR).collect()
    assert sorted(r["batch"] for r in batches) == list(range(len(batches))) and sum(r["chars"] for r in batches) == sum(docs.values())


def test_splits_share_kinds_and_fill_up(spark):
    from tidegrove.plans.split import split

    rows = [(kind, k, "", "p", "x") for kind, n in (("a", 3), ("b", 40), ("c", 40)) for k in range(n)]
    asked = spark.createDataFrame(rows, "kind string, key bigint, sub string, part string, answer string").repartition(4)
    for most, least in ((30, {"a": 3, "b": 10, "c": 10}), (83, {"a": 3, "b": 27, "c": 27}), (500, {"a": 3, "b": 40, "c": 40}), (2, {})):
        got = split(asked, most, 3).collect()
        n = {k: sum(r["kind"] == k for r in got) for k in "abc"}
        assert len(got) == len(set(got)) == min(most, 83) and all(n[k] >= v for k, v in least.items())
        assert sorted(got) == sorted(split(asked, most, 3).collect())
    assert split(asked.limit(0), 30, 3).count() == 0


def test_all_kinds_are_asked(spark):
    """Every question of every kind, by its SQL."""
    import duckdb

    from tidegrove.plans.split import _ALL, KINDS, questions

    c = duckdb.connect()
    for t in ("events", "supplier", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = {tuple(r[:3]): r[3] for r in c.sql(f"SELECT kind, part, sub, count(*) FROM ({_ALL}) GROUP BY ALL").fetchall()}
    got = {(r["kind"], r["part"], r["sub"]): r["count"] for r in questions(spark, DIR).groupBy("kind", "part", "sub").count().collect()}
    assert got == want and len(KINDS) == 35 and {k for k, _, _ in got} == set(KINDS)


def test_a_changed_source_is_staged_anew(spark, tmp_path):
    from tidegrove.sources.files import staged

    source = str(tmp_path / "t.parquet")
    spark.range(3).coalesce(1).write.parquet(source)
    first = staged(spark, source)
    assert first == staged(spark, source) and spark.read.parquet(first).count() == 3
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(source)
    again = staged(spark, source)
    assert again != first and spark.read.parquet(again).count() == 5
