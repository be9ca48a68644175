"""Odd rows, hot groups and stated borders of the operators for training text."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from tidegrove.llm import bpe, decontaminate, kneser_ney, licenses, near_copies, quality, quotes, sharding, store, tokencount, warc
from tidegrove.llm import words as W
from tidegrove.llm.queries import RANKS

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def thue_morse(k, a="a", b="b"):
    x, y = a, b
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("k", [3, 5, 8, 10, 12])
def test_structured_words_differ(spark, k):
    x, y = thue_morse(k)
    (found,) = (W.words(t, False) for t in W.slices(pa.array([f"{x} {y} {x}", x, y[:-1]])))
    h = found.hashes.tolist()
    assert h[0] == h[2] == h[3] and len(set(h)) == 3
    (r,) = quality.repetition_rules(spark.createDataFrame([(1, f"{x}\n{y}\n{x}")], "doc_id bigint, text string")).collect()
    assert r["n_dup_lines"] == 1


def test_token_counts_of_given_spans(spark):
    r = random.Random(4)
    text = "".join(r.choice("abcdef ghi, j") for _ in range(60)) + " naïve 😀 end"
    own = bpe.codec(RANKS, PATTERN)
    first, end = tokencount.token_spans(text.encode(), own.sizes[own.encode(text)])
    rows = [(k, text, [(a, a + r.randint(-3, 25)) for a in (r.randint(-5, 70) for _ in range(r.randint(0, 8)))]) for k in range(60)]
    rows += [(100, text, None), (101, None, [(0, 4)]), (102, "", [(None, 3)]), (100, text, [(20, 31), (25, 27), (26, 26), (27, 29)])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, spans array<struct<start:int,end:int>>")
    got = collections.Counter()
    for x in tokencount.attribute_tokens(d, RANKS, PATTERN, spans_col="spans").collect():
        got[x["doc_id"], x["char_start"], x["char_end"], x["n_tokens"], x["n_crossing"]] += 1
    want = collections.Counter()
    for key, t, spans in rows:
        t = t or ""
        reach, parts = 0, []
        for lo, hi in sorted((min(max(a or 0, 0), len(t)), min(max(b or 0, 0), len(t))) for a, b in spans or []):
            lo = max(lo, reach)
            hi = max(lo, hi)
            reach = max(reach, hi)
            parts.append((lo, hi))
        n, over = [0] * len(parts), [0] * len(parts)
        for a, b in zip(first.tolist(), end.tolist(), strict=True) if t else ():
            share = [min(hi, b) - max(lo, a) for lo, hi in parts]
            if share and max(share) > 0:
                k = share.index(max(share))
                n[k] += 1
                over[k] += not (parts[k][0] <= a and b <= parts[k][1])
        for k, (lo, hi) in enumerate(parts):
            want[key, lo, hi, n[k], over[k]] += 1
    assert got == want


def test_token_counts_odd_rows(spark):
    d = spark.createDataFrame([(1, "a b\n\nc", "x"), (1, "a b\n\nc", "x"), (None, "z", "x"), (2, None, "x")], "doc_id bigint, text string, part string")
    rows = tokencount.attribute_tokens(d, RANKS, PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["part"], r["char_start"], r["char_end"]) for r in rows) == [("1", 0, 0, 4)] * 2 + [("1", 1, 4, 5)] * 2 + [("1", 2, 5, 6)] * 2 + [("None", 0, 0, 1)]
    assert tokencount.attribute_tokens(d.limit(0), RANKS, PATTERN).count() == 0


def brute_shards(rows, shards, slots, place):
    """The assignment in plain Python: version 0 deals slots round, one rebalancing moves what is over an even share."""
    size = collections.Counter()
    for (_, n, _, _), s in zip(rows, place, strict=True):
        size[s] += n
    total = sum(size.values())
    loads, pool, shard = [0] * shards, [], {}
    order = sorted(range(slots), key=lambda s: (-size[s], s, s % shards))
    for s in order:
        if loads[s % shards] + size[s] <= -(-total // shards):
            loads[s % shards] += size[s]
            shard[s] = s % shards
        else:
            pool.append(s)
    for s in pool:
        k = loads.index(min(loads))
        loads[k] += size[s]
        shard[s] = k
    out, at = [], [0] * shards
    for (doc, n, crc, copy), s in sorted(zip(rows, place, strict=True), key=lambda x: (shard[x[1]], x[1], x[0][0] is not None, x[0][0] or 0, x[0][2], x[0][1], x[0][3])):
        out.append((doc, n, crc, shard[s], at[shard[s]], s))
        at[shard[s]] += 1
    return out


def test_sharding_equals_brute_force(spark):
    texts = [(k, "x" * (k * 37 % 211)) for k in range(400)] + [(None, None)] * 50 + [(7, "same")] * 30 + [(None, "é")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = [(r["doc_id"], r["size"], r["text_crc32"], r["copy"], r["vslot"]) for r in sharding.records(d, 64).collect()]
    assert sorted((str(a), n, c) for a, n, c, _, _ in rows) == sorted((str(a), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for a, t in texts)
    want = brute_shards([r[:4] for r in rows], 5, 64, [r[4] for r in rows])
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["virtual_slot"]) for r in sharding.shard_documents(d, 5, 64).collect()]
    key = lambda r: (r[3], r[4])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_sharding_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL", 1000)
    d = spark.range(12000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = sharding.shard_documents(d, 16).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert sum(r["n"] for r in rows) == 12000 and all(r["top"] == r["n"] - 1 for r in rows)
    assert max(r["b"] for r in rows) - min(r["b"] for r in rows) <= 8


def test_bpe_goes_through_the_tree(monkeypatch):
    own = bpe.codec(RANKS, PATTERN)
    joined, plain = [0], [0]
    join = own.join
    monkeypatch.setattr(own, "join", lambda text, lo, mid, hi, a, b: joined.__setitem__(0, joined[0] + (hi - lo == len(text))) or join(text, lo, mid, hi, a, b))
    for k in range(50):
        text = prose(rng.randint(5, 400), k)
        ids = own.encode(text)
        plain[0] += len(text) > bpe.LEAF
        assert ids.tolist() == own.table.encode_ordinary(text)
    assert joined[0] == plain[0] > 30


def brute_quotes(rows):
    """The links in plain Python: (conv, turn): (own, how, parent, passages, linked, thread)."""
    big, low = 2**63 - 1, -(2**63)
    norm = lambda t: " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t)) if w)
    first = {}
    for c, t, role, text in rows:
        k = (big if c is None else c, low if t is None else t)
        m = ((role is not None, role or ""), (text is not None, text or ""))
        first[k] = min(first.get(k, m), m)
    parsed = {}
    for k, (_, (_, text)) in first.items():
        own, runs, last = [], [], 0
        for line in re.sub("\r\n?", "\n", text).split("\n"):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            level = m[1].count(">") if m else 0
            if not level:
                own.append(line)
            elif level == last:
                runs[-1][1].append(line[m.end() :])
            else:
                runs.append((level, [line[m.end() :]]))
            last = level
        parsed[k] = ("\n".join(own), [(lv, p) for lv, ls in runs if (p := norm("\n".join(ls)))])
    pieces = collections.defaultdict(set)
    for k, (own, _) in parsed.items():
        lines = [x for x in map(norm, own.split("\n")) if x]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                pieces[" ".join(lines[i:j])].add(k)
    out, edges = {}, []
    for (c, t), (own, runs) in parsed.items():
        best, linked = None, 0
        for level, p in runs:
            if len(p.split()) < quotes.LEAST:
                continue
            before = [k for k in pieces[p] if k[0] == c and k[1] < t]
            target = max(before) if before else min((k for k in pieces[p]), default=None)
            if target and (before or target[0] < c):
                linked += 1
                best = max(best or (-10**9,), (-level, bool(before), target))
        turns = [k for k in parsed if k[0] == c and k[1] < t]
        parent = best[2] if best else max(turns, default=None)
        out[c, t] = [own, "quote" if best else "turn" if turns else "root", parent, len(runs), linked]
        if best and parent[0] != c:
            edges.append((c, parent[0]))
    thread = {c: c for c, _ in parsed}
    for _ in thread:
        for a, b in edges:
            thread[a] = thread[b] = min(thread[a], thread[b])
    return {k: (*v, thread[k[0]]) for k, v in out.items()}


def quote_rows():
    r = random.Random(8)
    rows = [(1, 0, "user", "one two three four\nfive six seven eight\nnine ten eleven twelve\n\nlast para of four words"), (1, 1, "a", "> five six seven eight\n> nine ten eleven twelve\nreply")]
    rows += [(1, 2, "a", "> nine ten eleven twelve\n>\n> last para of four words\r\nyes"), (2, 0, "a", ">" * 12 + " One two THREE four\nx"), (3, 0, "u", "> one two\f three four\n> five six seven eight\r\n> nine ten eleven twelve")]
    rows += [(None, 0, "u", "only in the null conversation"), (None, 1, "u", "> only in the null conversation\nok"), (None, None, "u", "before all the other turns"), (None, 2, "u", "> before all the other turns\n>> one two three four"), (4, 0, "u", "only in the null conversation"), (5, 0, None, "> only in the null conversation")]
    rows += [(10, 0, "u", "> the opening of the fifth\n> and more of it\n\n>> the third said so\n"), (13, 0, "u", "the third said so"), (6, 0, "u", "the opening of the fifth\nand more of it"), (14, 0, "u", "> the third said so\n"), (14, 1, "u", None), (14, 1, "u", "")]
    said = [prose(r.randint(4, 6), k) for k in range(6)]
    for c in range(20, 26):
        for t in range(12):
            text = "\n".join(r.choice(["", "> ", ">> ", "> > "]) + r.choice([*said, "", "ok"]) for _ in range(r.randint(0, 6)))
            rows.append((c, t * 700, r.choice("ua"), text))
    return rows


def test_quotes_equal_brute_force(spark):
    rows = quote_rows()
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("c", F.lit(1)).withColumn("own", F.lit("clash"))
    big, low = 2**63 - 1, -(2**63)
    key = lambda a, b: (big if a is None else a, low if b is None else b)
    got, order = {}, []
    for r in quotes.link_conversations(d).collect():
        k = key(r["conv_id"], r["turn"])
        parent = None if r["how"] == "root" else key(r["parent_conv"], r["parent_turn"])
        assert k not in got
        got[k] = (r["own"], r["how"], parent, r["n_quotes"], r["n_linked"], big if r["thread_conv"] is None else r["thread_conv"])
        order.append(((got[k][-1], k[0], r["position"]), k, parent))
    assert got == brute_quotes(rows)
    order.sort()
    at = {k: i for i, (_, k, _) in enumerate(order)}
    assert all(p is None or at[p] < at[k] for _, k, p in order)
    assert quotes.link_conversations(d.limit(0)).count() == 0
    assert got[1, 1][1:3] == got[1, 2][1:3] == ("quote", (1, 0)) and got[2, 0][1] == got[3, 0][1] == "quote" and got[big, 1][2] == (big, 0)


def test_quotes_of_one_passage_make_no_pairs(spark):
    """One conversation whose every turn quotes and says the same."""
    rows = [(1, t, "u", "> the same four words\nthe same four words") for t in range(3000)]
    out = quotes.link_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert out.where("parent_turn = turn - 1 and n_linked = 1").count() == 2999


def test_licences_whole_and_in_lines(spark):
    bsd = licenses.KNOWN["BSD-3-Clause"][0]
    rows = [(1, "BSD 3-Clause License\n\nCopyright (c) 2024, Someone\nAll rights reserved.\n\n" + bsd.replace(" ", "\n   ")), (2, "Licensed under CC BY-NC 4.0."), (3, "text\rlicensed under CC-BY-NC 4.0\nx"), (4, "y\x85copyright 2020 z"), (5, "a copyright 2020 z\nMIT\nSPDX-License-Identifier: MIT"), (6, "x " * 50000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1)).withColumn("license", F.lit(2))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    assert (got[1]["license"], got[2]["license"], got[2]["notices"], got[5]["notices"]) == ("BSD-3-Clause", "CC-BY-NC-4.0", "CC-BY-NC-4.0", "MIT")
    import hashlib

    for k, t in rows:
        assert got[k]["digest"] == hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest()
    own = {"Do-It": ["Do what you like with it"]}
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, "hm\ndo what YOU like with it!")], "doc_id bigint, text string"), known=own).collect()
    assert (r["notices"], r["n_notice_lines"]) == ("Do-It", 1)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files on this machine")
def test_published_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0-only", "MPL-2.0": "MPL-2.0"}
    rows = [(n, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read().upper()) for f, n in files.items()]
    got = licenses.scan_licenses(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == [n for n, _ in rows]


def test_archives_end_and_small_records_have_names(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
    d = spark.createDataFrame([(k % 4, "u", "") for k in range(20)] + [(9, "u", "long enough")] * 2, "page_id bigint, url string, html string").withColumn("payload_bytes", F.lit(1)).coalesce(1)
    folder = warc.new_dir(spark, "arc")
    files = warc.write_arc(d, folder)
    assert files.agg(F.max("records")).first()[0] <= 3 and files.agg(F.sum("records")).first()[0] == 22
    rows = warc.read_warc(warc.convert(files, warc.new_dir(spark, "warc"), min_bytes=5)).collect()
    assert sum(r["record_type"] == "response" for r in rows) == 21 and len(rows) == 22
    assert warc.archive_pages(d.limit(0)).count() == 0
    import io

    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(b"filedesc://f 0 0 t 60\n" + (f"1 0 x\n{warc.ARC_FIELDS[1]}\n".encode()).ljust(60) + b"u 1 2 t 99\nshort")))


def test_near_copies_equal_brute_force(spark):
    """Groups are those that chains of pairs of similarity 0.8 or more connect, whatever else is there."""
    r, rows, texts = random.Random(2), [], []
    for g in range(25):
        base = prose(300, 40 + g).split()
        texts.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            for j in r.sample(range(300), 4):
                w[j] = "changed"
            texts.append(" ".join(w))
    texts += ["", None, "one", "ONE", "two words", "two words", "x " * 4000]
    d = spark.createDataFrame([(k, t, "a", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, node string, c0 int").repartition(5)
    kept = {x["doc_id"] for x in near_copies.one_of_each(d).collect()}
    assert kept == {6 * g for g in range(25)} | {150, 152, 154, 156}


def shingle_sets(texts):
    (part,) = W.slices(pa.array(texts), 1 << 30)
    owner, value = near_copies.shingles(part)
    return part, [value[a:b] for a, b in zip(*(np.searchsorted(owner, np.arange(len(texts)) + k) for k in (0, 1)), strict=True)]


def jaccard(a, b):
    return len(np.intersect1d(a, b, True)) / max(1, len(np.union1d(a, b)))


def like_pairs(sets):
    """Pairs of similarity 0.8 or more: such texts share one of their twelve least shingles."""
    least = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for v in s[:12].tolist():
            least[v].append(k)
    maybe = {(j, i) for same in least.values() if len(same) < 100 for i in same for j in same if j < i}
    return [(i, j) for i, j in maybe if jaccard(sets[i], sets[j]) >= near_copies.SIMILARITY]


@pytest.mark.parametrize("exact", [4, 12])
def test_near_copies_recall_on_the_table(exact):
    """Pairs of different texts of similarity 0.8 or more in sf0.1 against the drawings."""
    import pyarrow.parquet as pq

    texts = sorted(set(pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text").to_pylist()))
    part, sets = shingle_sets(texts)
    bits = np.unpackbits(np.ascontiguousarray(near_copies.signatures(part)).view(np.uint8), axis=1)
    places = near_copies.drawn_bits(exact)

    def found(i, j):
        apart = bits[i][places] != bits[j][places]
        return (~apart[:, :exact].any(axis=1) & (apart[:, exact:].sum(axis=1) <= near_copies.WITHIN)).any() and (bits[i] != bits[j]).sum() <= near_copies.BUDGET

    pairs = like_pairs(sets)
    assert len(pairs) > 40 and sum(found(i, j) for i, j in pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_near_copies_keep_a_cover_of_the_table(spark, sf):
    """Each text that goes is at 0.8 or more to one that stays; of pairs at 0.8 or more at most a tenth stay whole."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in near_copies.one_of_each(docs).collect()}
    _, sets = shingle_sets([t for _, t in rows])
    by_shingle = collections.defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        if doc_id in kept:
            for v in sets[k].tolist():
                by_shingle[v].append(k)
    gone = [k for k, (doc_id, _) in enumerate(rows) if doc_id not in kept]
    for k in gone:
        near = collections.Counter(x for v in sets[k].tolist() for x in by_shingle[v])
        assert any(jaccard(sets[k], sets[x]) >= near_copies.SIMILARITY for x, _ in near.most_common(5)) or not len(sets[k]), rows[k][0]
    pairs = [(i, j) for i, j in like_pairs(sets)]
    assert len(gone) > 50 and sum(rows[i][0] in kept and rows[j][0] in kept for i, j in pairs) <= 0.1 * len(pairs)


def test_drawings_grow_slowly():
    """Copies of a fingerprint: 28 at most to a million texts, then as the 0.24th power of their number."""
    copies = {n: near_copies.drawings(near_copies.exact_bits(n)) for n in (10**4, 10**5, 10**6, 10**8, 3 * 10**10)}
    assert copies[10**4] == copies[10**5] == 20 and copies[10**6] == 28 and all(copies[n] < 1.25 * 28 * (n / 2**20) ** 0.24 for n in (10**8, 3 * 10**10))


def test_copies_do_not_grow_with_the_number_of_texts(spark, monkeypatch):
    """Rows that reach the tasks, for made fingerprints; with a small block as a stand-in for a large table."""
    monkeypatch.setattr(near_copies, "LEAST_EXACT", 1)
    monkeypatch.setattr(near_copies, "_walk_group", lambda most: lambda group: pd.DataFrame({"a": group["id"], "b": group["id"], "open": True}, index=group.index))
    monkeypatch.setattr(near_copies.DataFrame, "distinct", lambda self: self)
    for n in (2000, 16000):
        nodes = spark.range(n).select("id", *(F.xxhash64(F.lit(k), "id").alias(f"s{k}") for k in range(4)))
        found, _ = near_copies.find(nodes, n, 4, 1024, True)
        assert found.count() <= 1.2 * n * near_copies.drawings(near_copies.exact_bits(n, 1024))


@pytest.mark.parametrize("values", [64, 1 << 20])
@pytest.mark.parametrize("most", [2, 1000])
def test_candidates_equal_brute_force(values, most):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**64, (12, 4), dtype=np.uint64)
    sig = np.repeat(base, 30, axis=0)
    for row in sig:
        for b in r.integers(0, 256, 24):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    value, ids = r.integers(0, values, len(sig)), r.permutation(10 * len(sig))[: len(sig)]
    order = np.lexsort((ids, value))
    value, ids = value[order], ids[order]
    found = near_copies.candidates(value, ids, sig, most, within=3)
    want = collections.defaultdict(list)
    for i in range(len(sig)):
        for j in range(len(sig)):
            if ids[i] < ids[j] and int(value[i] ^ value[j]).bit_count() <= 3 and np.bitwise_count(sig[i] ^ sig[j]).sum() <= near_copies.BUDGET:
                want[int(ids[j])].append(int(ids[i]))
    got = collections.defaultdict(list)
    for i, j in zip(ids[found.first].tolist(), ids[found.then].tolist(), strict=True):
        got[j].append(i)
    assert got == {j: sorted(x)[:most] for j, x in want.items()}
    open_ids = set(ids[found.open].tolist())
    assert all({j, i} <= open_ids for j, x in want.items() for i in sorted(x)[most:]) and (most < 1000 or not open_ids)


@pytest.mark.parametrize("block", [8, 1 << 15])
def test_near_copies_of_a_large_group(spark, monkeypatch, block):
    """One text in 150 near copies, among others; with small blocks the group is dealt into many."""
    monkeypatch.setattr(near_copies, "LEAST_EXACT", 1)
    monkeypatch.setattr(near_copies, "TOGETHER", 16)
    base, rows = prose(400, 9).split(), [(k, prose(80, 1000 + k)) for k in range(40)]
    rows.append((40, " ".join(base)))
    for k in range(150):
        w = list(base)
        w[random.Random(k).randrange(400)] = "changed"
        rows.append((41 + k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {x["doc_id"] for x in near_copies.one_of_each(d, block).collect()} == set(range(41))


def test_covers_of_chains_and_stars(spark):
    for seed in range(2):
        r = random.Random(seed)
        links = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(70)} | {(k, k + 1) for k in range(100, 109)} | {(200, k) for k in range(201, 240)})
        gone = set()
        for a, b in sorted(links, key=lambda x: x[1]):  # by number: b goes if an earlier neighbour stays
            if a not in gone:
                gone.add(b)
        found = near_copies.covered(spark.createDataFrame(links, "a bigint, b bigint")).collect()
        assert {x["id"] for x in found} == gone and len(found) == len(gone)


@pytest.fixture
def many_buckets(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "DOCS_A_BUCKET", 1)
    texts = [prose(40, k) for k in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spec = kneser_ney.train(d)
    assert spec["bits"] == 9
    (part,) = W.slices(pa.array(texts), 1 << 30)
    return d, spec, kneser_ney.tokens(part)


def n_maps(folder):
    with open("/proc/self/maps") as f:
        return sum(folder.rsplit("/", 1)[-1] in line for line in f)


def test_models_files_stay_closed(many_buckets, monkeypatch):
    """Few files are mapped at a time, none is open, and the scores are those of workers."""
    d, spec, tok = many_buckets
    before = len(os.listdir("/proc/self/fd"))
    want = kneser_ney.Model(spec).score(*tok)[0]
    monkeypatch.setattr(store, "MAPS", 7)
    model = kneser_ney.Model(spec)
    logs, counts = model.score(*tok)
    assert n_maps(spec["folder"]) <= 7 + 2 * 128 and len(model.store.files) <= 7 and len(os.listdir("/proc/self/fd")) - before < 16
    total = kneser_ney.score(d, spec).agg(F.sum("score")).first()[0]
    assert (logs == want).all() and abs(logs.sum() - total) < 1e-6 and (counts > 0).all()


def test_a_remote_model_is_read_in_parts(many_buckets, monkeypatch):
    """From a store that can't be mapped, buckets are read as ranges and only some are kept."""
    from tidegrove.llm import shared

    _, spec, tok = many_buckets
    want = kneser_ney.Model(spec).score(*tok)[0]
    read = []

    class Remote:
        def open_input_file(self, path):
            read.append(path)
            return open(path, "rb")

    monkeypatch.setattr(shared, "_filesystem", lambda uri: (Remote(), uri.removeprefix("file:")))
    monkeypatch.setattr(store, "HELD", 20_000)
    model = kneser_ney.Model(spec)
    assert (model.score(*tok)[0] == want).all() and len(read) > 200 and not n_maps(spec["folder"] + "/none")
    assert model.store.held <= 20_000 + 10_000 and model.store.held == sum(f.held for f in model.store.files.values())


def test_a_store_of_very_many_buckets(tmp_path):
    """2**16 buckets of each of two kinds under a thousand maps."""
    n = 1 << 16
    for kind in ("a", "b"):
        for first in range(0, n, 1 << store.PACK):
            store.write_pack(str(tmp_path), kind, {b: np.array([b, ord(kind)], np.int64).tobytes() for b in range(first, first + (1 << store.PACK)) if b % 7})
    s = store.Store(str(tmp_path), lambda raw: raw.view(np.int64).tolist())
    most = 0
    for k, b in enumerate(random.Random(1).sample(range(n), n)):
        for kind in ("a", "b"):
            assert s.get(kind, b) == ([b, ord(kind)] if b % 7 else None)
        if k % 4096 == 0:
            most = max(most, n_maps(str(tmp_path)))
    assert 100 < most < 1000


def test_large_counts_stop():
    with pytest.raises(OverflowError):
        kneser_ney._u32(np.array([1 << 32]))


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    items = [(k, prose(30, 600 + k)) for k in range(9)] + [(None, prose(30, 700)), (3, prose(30, 603))]
    docs = [(k, f"{prose(50, k)} {items[k % 10][1]} {prose(20, k + 5)}" if k < 10 else prose(90, 800 + k)) for k in range(30)] + [(40, prose(30000, 9))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("word", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("block", F.lit(1))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect()}
    assert got == {(k, items[k][0]) for k in range(10)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(d, bench).collect()} == {*range(10, 30), 40}
    assert decontaminate.find_leaks(d, bench.limit(0)).count() == 0


def test_pipeline_keeps_and_drops(spark, tmp_path):
    """Clean texts stay; planted copies, near copies, leaks and repetitive texts go."""
    import corpus_pipeline

    item = prose(40, 5000)
    clean = [(k, prose(250, 3000 + k)) for k in range(30)]
    copy = [(100 + k, clean[k][1]) for k in range(3)] + [(110 + k, clean[k][1].replace(clean[k][1].split()[50], "zz", 1)) for k in range(3, 6)]
    leak = [(200, f"{prose(90, 1)} {item} {prose(40, 2)}")]
    bad = [(300, "the same line is here again\n" * 30), (301, "short"), (302, None)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in clean + copy + leak + bad]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(30))


def test_finished_tables_go(spark):
    """What is written on the way is removed, but for what the result reads."""
    from tidegrove.llm import shared

    base = shared.base_dir(spark)
    d = spark.createDataFrame([(k, prose(60, k % 9)) for k in range(30)], "doc_id bigint, text string")
    before = set(os.listdir(base))
    assert near_copies.one_of_each(d).count() == 9
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before} <= {"copies-keep", "cc-links"}


@pytest.mark.parametrize("name", ["op8_quality_rules", "op9_license_scan", "op10_warc"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from tidegrove.llm import queries

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns) and set(queries.oracle_sql()) == {f"op{k}_{n}" for k, n in ((8, "quality_rules"), (9, "license_scan"), (10, "warc"), (11, "source_divergence"), (12, "merkle_manifest"), (13, "line_dedup"))}
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    cols = sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    assert a == sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
