"""Source divergence, the Merkle manifest and line dedup against brute force and their SQL."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidegrove.llm import divergence, linededup, merkle, ordinals, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h0 string, `idx` int, tree string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ("x", 1, "y")


def rows_of(seed, n=120):
    """Odd rows: nulls in every column, ties, repeated rows, long and empty texts, a hot source."""
    r = random.Random(seed)
    words = ["".join(r.choice("abCDé\U0001f600") for _ in range(r.randint(1, 3))) for _ in range(25)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(30)] + ["", " \t", "short", "\x0b Exactly Ten \r", "exactly ten", "ÀÉ long enough line", "ÀÉ LONG enough line "]
    out = [(r.choice([None, *range(40)]), r.choice([None, "", "\n", *(["\n".join(r.choice(lines) for _ in range(r.randint(1, 9)))] * 6)]), r.choice([None, "", "en", "de"]), r.choice([None, "", "a", "é", "\U0001f600", "hot", "hot", "hot"]), r.choice([None, 0, -7, 10**12]), *CLASH) for _ in range(n)]
    return out + [out[0]] * 40 + [(3, "one very long line " * 9000 + "\n" + "\n" * 5000, "en", "hot", 1, *CLASH)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = rows_of(1)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(rows, sql):
    import duckdb

    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    return c.sql(sql)


def brute_audit(rows, min_docs=3):
    count, docs, sources = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(UPPER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        whole = sum((count[lang, s] for s in own), collections.Counter())
        p = {}
        for s in [None, *own]:
            c = whole if s is None else count[lang, s]
            n = sum(c[t] for t in kept)
            p[s] = [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]
        for s in own:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in own - {s}]
            terms = [(-((a - b) ** 2 // b), t.encode(), t) for t, a, b in zip(kept, p[s], p[None], strict=True) if count[lang, s][t] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk", "block"), [(1 << 15, 128), (7, 2), (1, 1)])
def test_audit_equals_brute_force(spark, odd, monkeypatch, chunk, block):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows, docs = odd
    assert plain(divergence.audit(docs)) == brute_audit(rows)


def test_audit_equals_sql(odd):
    rows, docs = odd
    got, want = divergence.audit(docs), duck(rows, queries.divergence_sql())
    assert got.columns == want.columns and plain(got) == sorted(want.fetchall(), key=repr)


def test_audit_without_kept_terms(spark, empty):
    assert divergence.audit(empty).count() == 0
    rows = [(1, "word", "en", "a", 1, *CLASH), (2, None, "en", None, 1, *CLASH), (3, "!?", None, "c", 1, *CLASH)]
    assert plain(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)] == brute_audit(rows)


def test_audit_of_many_terms_in_a_task(spark, monkeypatch):
    """Rows leave a task before its end; frequent terms come in large numbers."""
    r = random.Random(3)
    rows = [(k, " ".join("T" + "".join(r.choice("abcdefghij") for _ in range(2)) for _ in range(400)), "en", f"s{k % 3}", 1, *CLASH) for k in range(40)]
    counts = divergence.Counts()
    monkeypatch.setattr(divergence, "GATHERED", 50)
    monkeypatch.setattr(divergence, "SLICE", 3000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows]) for c in (2, 3, 1)], ["lang", "source", "text"])
    parts = list(divergence._count(iter([batch, batch.slice(0, 0), batch])))
    total, docs = collections.Counter(), collections.Counter()
    for part in parts:
        for x in part.to_pylist():
            total[x["source"], x["term"]] += x["n"]
            docs[x["source"], x["term"]] += x["docs"]
    want, seen = collections.Counter(), collections.Counter()
    for x in rows:
        want.update((x[3], w.lower()) for w in x[1].split())
        seen.update((x[3], w.lower()) for w in set(x[1].split()))
    assert len(parts) > 10 and total == {k: 2 * v for k, v in want.items()} and docs == {k: 2 * v for k, v in seen.items()} and not counts.rows
    assert plain(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == brute_audit(rows)


def test_smoothing_is_exact_for_large_counts():
    r = random.Random(2)
    for _ in range(300):
        n, v = r.randint(1, 8 * 10**15), r.randint(1, 10**9)
        c = np.array([r.randint(0, n) for _ in range(20)] + [0, n])
        assert divergence.smoothed(c, n, v).tolist() == [1 + 10**9 * (x + 1) // (n + v) for x in c.tolist()]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, text):
    doc_id, _, lang, source, n_chars, *_ = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(nodes, fanout):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            g = at[i] // fanout * fanout
            path.append((nodes[g : at[i]], nodes[at[i] + 1 : g + fanout]))
            at[i] //= fanout
        nodes = [digest(*nodes[g : g + fanout]) for g in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute_manifest(rows, fanout):
    own = collections.defaultdict(list)
    for row in rows:
        own[row[3]].append(row)
    order = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, brute_leaf(x, x[1])))
        trees[s] = brute_tree([brute_leaf(x, x[1]) for x in own[s]], fanout)
    root, tops = brute_tree([trees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops, strict=True):
        for x, path in zip(own[s], trees[s][1], strict=True):
            h = leaf = brute_leaf(x, x[1])
            if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5 == 0:
                h = brute_leaf(x, x[1] and x[1].translate(UPPER))
            for a, b in path + top:
                h = digest(*a, h, *b)
            out.append((x[0], leaf, trees[s][0], root, digest(*(d for a, b in path + top for d in a + b)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout", [16, 2, 3])
def test_manifest_equals_brute_force(odd, fanout):
    rows, docs = odd
    got = plain(merkle.manifest(docs, fanout))
    assert got == brute_manifest(rows, fanout)
    assert {True, False} == {r[-1] for r in got}


def test_manifest_equals_sql(odd):
    rows, docs = odd
    got, want = merkle.manifest(docs), duck(rows, queries.merkle_sql())
    assert got.columns == want.columns and plain(got) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(k, f"Text {k}", None, None, k, *CLASH) for k in range(n)]
    got = plain(merkle.manifest(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_manifest(rows, 16) and all(r[2] == r[3] for r in got)


def test_manifest_of_lone_leaves_and_nothing(spark, empty):
    rows = [(k, None, None, f"s{k}", None, *CLASH) for k in range(18)]
    assert plain(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == brute_manifest(rows, 16)
    assert merkle.manifest(empty).count() == 0


def test_numbers_are_gapless_over_many_tasks(spark):
    rows = [(g, k % 7 if k % 5 else None) for g in ("", "hot", "x") for k in range(2000 if g == "hot" else 9)]
    got = ordinals.numbered(spark.createDataFrame(rows, "g string, o int").repartition(6), ["g"], ["o"], "t").collect()
    for g in ("", "hot", "x"):
        own = sorted((r["idx"], r["o"]) for r in got if r["g"] == g)
        assert [i for i, _ in own] == list(range(len(own)))
        values = [(o is not None, o or 0) for _, o in own]
        assert values == sorted(values)


def brute_lines(rows, min_chars=10, min_docs=2):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    order = lambda d: (1 << 63) - 1 if d is None else d
    held = collections.defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(held.get(key(line), ())) < min_docs or min(held[key(line)]) == order(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_chars", "min_docs"), [(10, 2), (0, 2), (5, 3)])
def test_lines_equal_brute_force(odd, min_chars, min_docs):
    rows, docs = odd
    got = plain(linededup.without_repeated_lines(docs, min_chars, min_docs))
    assert got == brute_lines(rows, min_chars, min_docs) and sum(r[2] for r in got) > 20


def test_lines_equal_sql(odd):
    rows, docs = odd
    want = sorted(duck(rows, queries.lines_sql()).fetchall(), key=repr)
    assert want == sorted(((a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in plain(linededup.without_repeated_lines(docs))), key=repr)


def test_lines_of_nothing_and_of_clashing_names(spark, empty):
    assert linededup.without_repeated_lines(empty).count() == 0
    rows = [(1, None), (2, ""), (None, "a common line\nx"), (None, "A COMMON LINE  "), (7, "a common line"), (7, "a common line\na common line")]
    docs = spark.createDataFrame([(a, b, "d", "t0", 3) for a, b in rows], "doc_id bigint, text string, d string, t0 string, dropped int")
    assert plain(linededup.without_repeated_lines(docs)) == brute_lines(rows)


def test_lines_of_a_very_long_text(spark):
    """Positions are looked up as a set: 200,000 lines, half of them dropped."""
    rows = [(1, "\n".join(f"line number {k}" for k in range(0, 200_000, 2))), (2, "\n".join(f"line number {k}" for k in range(200_000)))]
    got = plain(linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [r[:3] for r in got] == [(1, 100_000, 0), (2, 200_000, 100_000)] and got[1][3] == "\n".join(f"line number {k}" for k in range(1, 200_000, 2))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_merkle_manifest", "op13_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    got, want = queries.queries()[name](spark, folder), c.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns and plain(got) == sorted(want.fetchall(), key=repr)


def test_line_dedup_runs_no_python(spark):
    df = queries.queries()["op13_line_dedup"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)
