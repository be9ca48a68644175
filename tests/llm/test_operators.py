"""The operators for training text against brute force on small tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from public_tokenizers import PATTERN

from tidegrove.llm import bpe, decontaminate, kneser_ney, licenses, near_copies, quality, quotes, sharding, simhash, tokencount, warc
from tidegrove.llm.queries import RANKS
from tidegrove.llm.words import slices, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, `c0` int"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", ",", ".\n"]) for _ in range(n))


TEXTS = [None, "", "  \n\t", "one", "two words", prose(40, 1), prose(40, 1), prose(300, 2), prose(300, 2) + " tail", ("same line here ok\n" * 9), "x" * 30000, "é" * 9000 + " " * 5000 + "z", prose(6000, 3), "a b\x1cc \U0001f600 'll I'll\r\n\r\n  y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], None, None, None, None, None), (6, TEXTS[6], "en", "s", 0, "clash", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table():
    import base64

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(t):
    return (t or "").encode().split()


def test_words_equal_split():
    import pyarrow as pa

    for part in slices(pa.array([t or "" for t in TEXTS]), 5000):
        found = words(part, False)
        own = TEXTS[part.rows]
        assert np.diff(found.first).tolist() == [len(split(t)) for t in own]
        names = [w for t in own for w in split(t)]
        assert len(set(names)) == len(set(found.hashes.tolist()))
        assert len({(a, b) for a, b in zip(names, found.hashes.tolist(), strict=True)}) == len(set(names))


def test_bpe_equals_library(docs, empty, table):
    got = {(r["doc_id"]): r for r in bpe.round_trip(docs, RANKS, PATTERN).collect() if r["doc_id"] is not None}
    for i, t in enumerate(TEXTS):
        ids = np.array(table.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(empty, RANKS, PATTERN).count() == 0


def test_bpe_tree_with_tiny_leaves(table):
    small = bpe.Codec(RANKS, PATTERN, 7)
    for t in [x or "" for x in TEXTS if len(x or "") < 4000] + ["".join(rng.choice("ab '1.\n ") for _ in range(500)) for _ in range(20)]:
        ids = small.encode(t)
        assert ids.tolist() == table.encode_ordinary(t)
        assert small.decode(ids) == t.encode()


def test_token_counts_add_up(docs, table):
    rows = tokencount.attribute_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), RANKS, PATTERN).collect()
    total = collections.Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    for i, t in enumerate(TEXTS):
        assert total[i] == len(table.encode_ordinary(t or ""))


def test_tokens_over_a_border():
    first, end = np.array([0, 2, 5]), np.array([2, 5, 9])
    assert [x.tolist() for x in tokencount.allocate(first, end, np.array([0, 3, 7]), np.array([3, 7, 9]))] == [[1, 2, 0], [0, 2, 0]]


def test_sharding_law(docs, empty):
    rows = sharding.shard_documents(docs, 4, 64).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    for r in rows:
        if r["doc_id"] is not None:
            t = (TEXTS[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
    assert sharding.shard_documents(empty, 4, 64).count() == 0


def test_sharding_balances(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    loads = [r["b"] for r in sharding.shard_documents(d, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) < 100


def test_growth_moves_rows_to_the_new_shard_only(spark):
    sizes = spark.range(64).select(F.col("id").cast("int").alias("vslot"), (F.col("id") * 7 % 50 + 1).alias("bytes"), F.lit(1).cast("bigint").alias("n"))
    first = sharding.first_map(spark, 4, 64)
    moved = sharding.rebalance(first, sizes, 0, 5).collect()
    assert moved and {r["shard"] for r in moved} == {4}


def brute_fingerprint(t):
    w = split((t or "").translate(str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})))
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(values, near):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    prints = [brute_fingerprint(t) for t in TEXTS]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    for r in rows:
        i = r["doc_id"] if r["doc_id"] is not None else 5
        assert r["fp"] & (2**64 - 1) == prints[i]
        assert r["component_id"] == min(j for j in range(len(TEXTS)) if roots[j] == roots[i])
    assert simhash.near_duplicates(empty).count() == 0
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and near_copies.one_of_each(empty).count() == 0
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 3, 4, 5, 7, 9, 10, 11, 12, 13]


def test_dedup_tells_rows_of_one_id_apart(spark):
    """One doc_id, or none, on many unrelated texts; exact copies under shared, other and missing ids."""
    texts = [prose(120, 700 + k) for k in range(12)]
    rows = [(7, t, "a") for t in texts[:5]] + [(None, t, "a") for t in texts[5:9]] + [(k, texts[k], "a") for k in (9, 10, 11)]
    rows += [(7, texts[0], "a"), (3, texts[1], "a"), (7, texts[10], "a"), (None, texts[5], "a"), (None, texts[2], "a"), (None, "", "a"), (None, None, "a"), (7, texts[6], "a")]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(3))
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    want = [(7, texts[0]), (3, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[5]), (7, texts[6]), (None, texts[7]), (None, texts[8]), (9, texts[9]), (7, texts[10]), (11, texts[11]), (None, "")]
    assert kept.columns == ["doc_id", "text", "fp"] and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [8, 1 << 15])
def test_links_with_blocks(spark, block):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 20, dtype=np.uint64)
    near = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in r.integers(0, 64, (6, 2))]
    values = sorted({int(b) for b in base} | set(near))
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint")
    edges = [(e["a"] & (2**64 - 1), e["b"] & (2**64 - 1)) for e in simhash.near_links(spark, df, block).collect()]
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    got = brute_components(values, lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
    assert len(set(want)) == len(set(got)) and len({*zip(want, got, strict=True)}) == len(set(want))


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "DOCS_A_BUCKET", 4)  # several buckets, so that few words are hot
    d = spark.createDataFrame([(i, prose(30 + i % 9, i // 2)) for i in range(120)], "doc_id bigint, text string")
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 1}
    rows = {r["doc_id"]: r for r in kneser_ney.score_held_out(d, order).collect()}
    toks = {i: [*(w.lower() for w in split(prose(30 + i % 9, i // 2))), b"</s>"] for i in range(120)}
    levels = {k: collections.Counter() for k in range(1, order + 1)}
    uni = collections.Counter()
    for i in set(range(120)) - held:
        uni.update(toks[i])
        padded = [b"<s>"] * (order - 1) + toks[i]
        levels[order].update(tuple(padded[j : j + order]) for j in range(len(toks[i])))
    for k in range(order - 1, 0, -1):
        levels[k].update(g[1:] for g in levels[k + 1])
    n, v = sum(uni.values()), len(uni)
    cut_off = {k: (0, *kneser_ney.discounts(*(sum(c == j for c in levels[k].values()) for j in (1, 2, 3, 4)))) for k in levels}
    total, spare = collections.Counter(), collections.Counter()
    for k, grams in levels.items():
        for g, c in grams.items():
            total[k, g[:-1]] += c
            spare[k, g[:-1]] += cut_off[k][min(c, 3)]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (v + 1)
        size = total[k, g[:-1]]
        return (max(levels[k][g] - cut_off[k][min(levels[k][g], 3)], 0) + spare[k, g[:-1]] * lower) / size if size else lower

    assert abs(sum(p((b"<s>",) * (order - 1) + (w,)) for w in [*uni, b"unknown"]) - 1) < 1e-9
    for i, r in rows.items():
        padded = [b"<s>"] * (order - 1) + toks[i]
        assert r["held_out"] == (i in held) and r["train_tokens"] == n and r["n_tokens"] == len(toks[i])
        assert math.isclose(r["score"], sum(math.log10(p(tuple(padded[j : j + order]))) for j in range(len(toks[i]))), rel_tol=1e-9)
        assert math.isclose(r["base_score"], sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[i]), rel_tol=1e-9)


def test_kneser_ney_without_training_text(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    d = spark.createDataFrame([(i, "one two two" if i % 2 else None) for i in held], "doc_id bigint, text string")
    rows = kneser_ney.score_held_out(d).collect()
    assert len(rows) == len(held) and all(r["held_out"] and r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    with pytest.raises(ValueError):
        kneser_ney.train(d, order=4)


def test_kneser_ney_one_word_in_a_very_long_text(spark):
    """A word that is its own context, in a third of all rows and in one text of 300,000 words."""
    rows = [(i, "same " * (300_000 if i == 0 else 5)) for i in range(20)] + [(20 + i, prose(40, i)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    spec = kneser_ney.train(d)
    assert spec["total"] == sum(len(t.split()) + 1 for _, t in rows)
    got = {r["doc_id"]: r for r in kneser_ney.score(d, spec).collect()}
    assert got[0]["n_tokens"] == 300_001 and got[0]["perplexity"] < 1.01 < got[20]["perplexity"]


def test_sorted_hash_arrays():
    rng = np.random.default_rng(5)
    for size in (0, 1, 9, 5000):
        for width in (kneser_ney.LOW, 8):
            key = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
            n = rng.integers(1, 600, len(key))
            table = kneser_ney.Table(np.frombuffer(kneser_ney.pack_table(key, [n], width), np.uint8))
            at, hit = table.find(key)
            assert hit.all() and (table.counts(0, at) == n).all()
            assert not table.find(rng.integers(0, 1 << 64, 300, np.uint64))[1].any()


def test_kneser_ney_odd_rows(docs, empty):
    rows = kneser_ney.score_held_out(docs).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r["score"]) for r in rows)
    assert kneser_ney.score_held_out(empty).count() == 0


def test_leaks_found_and_clean_kept(spark):
    items = [(i, " ".join(random.Random(100 + i).choice(VOCABULARY) for _ in range(38))) for i in range(8)]
    rows = [(i, prose(200, 50 + i)) for i in range(60)]
    for k in range(6):
        w = items[k][1].split()
        for j in range(0, len(w) - 10, 6 if k % 2 else 10**6):
            w[j] = "other"
        rows[k] = (k, f"{prose(33 + k, k)} {' '.join(w)} {prose(50, k + 9)}")
    rows += [(None, None), (99, "")]
    bench = spark.createDataFrame(items + [(50, None), (51, " ")], "item_id bigint, text string")
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect()}
    assert got == {(k, k) for k in range(6)}
    assert decontaminate.without_leaks(d, bench).count() == len(rows) - 6
    assert decontaminate.find_leaks(d.limit(0), bench).count() == 0


def test_leaks_equal_brute_force():
    """Every word-for-word copy, planted paraphrases, and whatever else matches on the grid of windows, with a basis that
    is of no use, so that no leak may depend on its cosine being high."""
    import pyarrow as pa

    d, r = decontaminate, random.Random(3)
    item_texts = [" ".join(r.choice(VOCABULARY) for _ in range(n)) for n in (1, 3, 15, 17, 30, 38, 59, 70)]
    texts = ["", *(prose(400, 300 + k) for k in range(20))]
    for t in item_texts:
        for k in (0, 5, 8, 13):
            w = t.split()
            for j in range(6, len(w) if k else 0, 6):
                w[j] = "other"
            texts.append(f"{prose(64 + k, k)} {' '.join(w)} {prose(90, k + 1)}")
    (found,) = (words(x, True) for x in slices(pa.array(texts), 1 << 30))
    (asked,) = (words(x, True) for x in slices(pa.array(item_texts), 1 << 30))
    latent = np.random.default_rng(2).standard_normal((d.FEATURES, 8)).astype(np.float32)
    items = d.Items([(i, asked.hashes[asked.first[i] : asked.first[i + 1]]) for i in range(len(item_texts))], latent)

    def leaks(item, window):
        lcs, answer = items.check(item, window.tolist())
        return lcs >= d.LCS or lcs >= d.LCS_LOOSE and answer >= d.ANSWER

    want, bound = set(), []
    for i in range(len(item_texts)):
        n = len(items.items[i][1])
        for t in range(len(texts)):
            for at in range(found.first[t], found.first[t + 1], d.STEP):
                lo, hi = max(found.first[t], at - d.STEP), min(found.first[t + 1], at + n + 2 * d.STEP)
                a, b = collections.Counter(items.items[i][1].tolist()), collections.Counter(found.hashes[lo:hi].tolist())
                bound.append((i, lo, hi, (a & b).total()))
                if leaks(i, found.hashes[lo:hi]):
                    want.add((i, t))
    i, lo, hi, shared = map(np.array, zip(*bound, strict=True))
    assert items.shared_words(items.numbers(found.hashes), i, lo, hi).tolist() == shared.tolist()
    got = {(i, t) for i, t, _, lo, hi, _ in items.candidates(found, 1.1) if leaks(i, found.hashes[lo:hi])}
    planted = {(k, 21 + 4 * k + j) for k in range(len(item_texts)) for j in range(4)}
    assert planted <= got <= want
    assert {(i, t) for i, t, _, lo, hi, _ in items.candidates(found, -1.1) if leaks(i, found.hashes[lo:hi])} == want


def test_leaks_of_the_table(spark):
    """Every place of sf0.1 where a document holds a whole item word for word, found by comparing texts."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: f" {b' '.join((t or '').encode().lower().split()).decode()} "
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.select("doc_id", "text").collect()}
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect() if (r["text"] or "").split()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert len(want) > 200 and want <= got


def test_leaks_drop_rows_not_ids(spark):
    item = " ".join(random.Random(900).choice(VOCABULARY) for _ in range(38))
    rows = [(k, prose(60, 910 + j) + (f" {item} " if j == 2 else " ") + prose(20, 920 + j), j) for k in (None, 4) for j in range(5)]
    d = spark.createDataFrame([*rows, (None, None, 9)], "doc_id bigint, text string, c0 int")
    kept = decontaminate.without_leaks(d, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert kept.columns == d.columns
    assert sorted((str(r["doc_id"]), r["c0"]) for r in kept.collect()) == [(k, j) for k in ("4", "None") for j in (0, 1, 3, 4, *([9] if k == "None" else []))]


def test_common_subsequence():
    for _ in range(50):
        a, b = [rng.randint(0, 5) for _ in range(rng.randint(1, 12))], [rng.randint(0, 5) for _ in range(rng.randint(0, 15))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate.Items._masks(a), len(a), b) == t[-1][-1]


def test_quality_equals_brute_force(docs, empty):
    rows = quality.repetition_rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        t = TEXTS[r["doc_id"]] or ""
        w = split(t)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(len(x.decode()) for x in w), len(hit), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.keep_good(docs).count() == sum(r["kept"] for r in rows)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(empty).count() == 0


def test_licenses(spark, empty):
    mit = licenses.KNOWN["MIT"][0]
    d = spark.createDataFrame([(1, "Copyright (c) 2020 Me\n\n" + mit.upper().replace("LICENSE", "Licence")), (2, prose(30, 1) + "\nreleased under the MIT licence!"), (3, None), (4, prose(9, 1)), (4, "")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["license"], r["notices"]) for r in licenses.scan_licenses(d).collect() if r["doc_id"] < 4)
    assert got == [(1, "MIT", None), (2, None, "MIT"), (3, None, None)]
    assert licenses.scan_licenses(empty).count() == 0


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "the first message has words\n\nanother paragraph of it here"), (1, 1, "assistant", "an answer of no quotation"), (1, 2, "user", "> another Paragraph of it here\nmine now"), (1, 2, "user", "zzz repeated turn"),
        (2, 0, "user", ">> the first message has words\n> an answer of no quotation\nnew thread"), (2, 1, "user", None), (3, 0, "user", ""), (None, 0, None, "x"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert len(got) == 7
    assert (got[1, 2]["own"], got[1, 2]["how"], got[1, 2]["parent_turn"]) == ("mine now", "quote", 0)
    assert (got[2, 0]["how"], got[2, 0]["parent_conv"], got[2, 0]["parent_turn"], got[2, 0]["thread_conv"], got[2, 0]["own"]) == ("quote", 1, 1, 1, "new thread")
    assert (got[2, 1]["how"], got[2, 1]["position"], got[3, 0]["how"]) == ("turn", 1, "root")


def test_archives(spark):
    rows = [(3, "http://a b", "same"), (1, "http://x", "same"), (2, None, None), (5, "u", ""), (None, "u", "same"), (7, "u", "é" * 5000), (1, "http://x", "same")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    assert len(got) == 7
    assert sorted(r["record_type"] for r in by[1]) == ["response", "revisit"]
    assert (by[3][0]["refers_to"], by[5][0]["refers_to"], by[None][0]["refers_to"], by[2][0]["record_type"]) == (1, 2, 1, "response")
    assert by[7][0]["payload_bytes"] == 10000 and by[5][0]["payload_digest"] == warc.base32_sha1(b"")


def test_arc_versions():
    import io

    for version in (1, 2):
        about = f"{version} 0 x\n{warc.ARC_FIELDS[version]}\n".encode()
        raw = warc._arc_line(version, "filedesc://f", "0.0.0.0", "2000", "text/plain", about, 0, "f") + warc._arc_line(version, "http://a b c", "1.2.3.4", "2001", "text/html", b"body\n\n", 9, "f")
        (fields, body), = warc.arc_records(io.BytesIO(raw))
        assert (fields["URL"], fields["IP-address"], body) == ("http://a b c", "1.2.3.4", b"body\n\n")


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= 200
