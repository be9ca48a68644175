"""SimHash near-duplicates: fingerprints, and a self-join of them along a binary trie.

A sorted array of distinct fingerprints is a binary trie: a node is a stretch of it that agrees in its leading bits.
The join walks pairs of nodes from the top. Going down one bit turns a pair into up to four, adds one to the bits that
differ where the branches part, and drops what exceeds the budget; small pairs of nodes are compared outright.

How it is spread: the top ``depth`` levels are walked by key. A fingerprint goes to every pair of prefixes that holds
its own and lies within the budget, and each pair is walked by one task. Prefixes with many fingerprints are dealt into
blocks, and pairs of blocks are walked instead, so that a task's arrays stay bounded by ``BLOCK`` whatever the size of
a group of copies. A task returns a spanning forest of the links that it found, never all pairs.

Equal texts have equal fingerprints and enter the join once. Defined cases: null and empty texts and texts of blanks
have fingerprint zero, which links like any other; texts of one or two words have one shingle, the whole; rows that
repeat a doc_id get a row each; a null doc_id keeps its row and never is a component's id unless no other row is
in it (component_id is null then). An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .components import components
from .shared import cut, free

BUDGET, SHINGLE, SEED = 3, 3, 42
#: Fingerprints of one prefix that one task holds of each side.
BLOCK = 1 << 17
#: Pairs of nodes with so many pairs of fingerprints or fewer are compared outright; pairs of nodes held at a time.
OUTRIGHT, CHUNK = 64, 1 << 17


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of one text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    digests = b"".join([xxh64_digest(x, SEED) for x in pieces])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    n = len(rows)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 255 * 256):  # sums of 255 bits fit a byte
        bits = np.unpackbits(rows[lo : lo + 255 * 256], axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a long."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the fingerprints with the bit set begin, in each node [lo, hi)."""
    one = np.uint64(1) << bit
    return np.clip(np.searchsorted(values, (values[lo] & ~((one << np.uint64(1)) - np.uint64(1))) | one), lo, hi)


def walk(a: np.ndarray, b: np.ndarray, same: bool, top: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with a[i] and b[j] within ``budget`` differing bits, in chunks. a and b are sorted and distinct;
    each agrees in its bits above ``top``. same: a is b; each pair of two of its members then comes once."""
    if not len(a) or not len(b):
        return
    apart = 0 if same or top > 63 else int(a[0] >> np.uint64(top) ^ b[0] >> np.uint64(top)).bit_count()
    if apart > budget:
        return
    z = lambda v: np.array([v], np.int64)
    heap = [(z(0), z(len(a)), z(0), z(len(b)), z(apart), top)]
    while heap:
        alo, ahi, blo, bhi, d, level = heap.pop()
        na, nb = ahi - alo, bhi - blo
        own = (alo == blo) & same  # two different nodes of one array never start alike
        leaf = (na * nb <= OUTRIGHT) | (level == 0)
        if leaf.any():
            yield from _compare(a, b, alo[leaf], na[leaf], blo[leaf], nb[leaf], own[leaf], budget)
        go = ~leaf
        if not go.any():
            continue
        alo, ahi, blo, bhi, d, own = (x[go] for x in (alo, ahi, blo, bhi, d, own))
        bit = np.full(len(alo), level - 1, np.uint64)
        am, bm = _split(a, alo, ahi, bit), _split(b, blo, bhi, bit)
        parts = [(alo, am, blo, bm, d, None), (am, ahi, bm, bhi, d, None), (alo, am, bm, bhi, d + 1, None), (am, ahi, blo, bm, d + 1, ~own)]
        kept = []
        for p, q, r, s, e, mask in parts:
            ok = (q > p) & (s > r) & (e <= budget)
            ok = ok if mask is None else ok & mask
            kept.append([x[ok] for x in (p, q, r, s, e)])
        p, q, r, s, e = (np.concatenate(x) for x in zip(*kept, strict=True))
        for i in range(0, len(p), CHUNK):
            heap.append((p[i : i + CHUNK], q[i : i + CHUNK], r[i : i + CHUNK], s[i : i + CHUNK], e[i : i + CHUNK], level - 1))


def _compare(a, b, alo, na, blo, nb, own, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = na * nb
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(1 << 20, int(sizes.sum()) + (1 << 20), 1 << 20), "right")
    lo = 0
    for hi in np.unique(np.append(np.maximum(cuts, 1), len(sizes))):
        if hi <= lo:
            continue
        n = sizes[lo:hi]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(nb[lo:hi], n)
        i, j = np.repeat(alo[lo:hi], n) + k // w, np.repeat(blo[lo:hi], n) + k % w
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        near &= ~np.repeat(own[lo:hi], n) | (i < j)
        yield i[near], j[near]
        lo = hi


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the least item that the pairs connect it to."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            differ = x != y
            if not differ.any():
                break
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def _walk_group(top: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy(np.int64).view(np.uint64)
        left = group["side"].to_numpy() != 1
        a = np.unique(values[left])
        same = bool((group["side"] == 2).any())
        b = a if same else np.unique(values[~left])
        if same:
            root = forest(len(a), walk(a, a, True, top))
            every = a
        else:
            root = forest(len(a) + len(b), ((i, j + len(a)) for i, j in walk(a, b, False, top)))
            every = np.concatenate([a, b])
        child = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": every[root[child]].view(np.int64), "b": every[child].view(np.int64)})

    return run


def near_links(spark: SparkSession, values: DataFrame, block: int = BLOCK) -> DataFrame:
    """``values`` has distinct longs in ``fp``. Returns edges (a, b) that connect exactly the fingerprints that chains
    of pairs within the budget connect."""
    n = values.count()
    # so deep that a prefix has about a block; from 2**33 fingerprints on a prefix has several
    depth = min(16, max(4, math.ceil(math.log2(max(1, n / block)))))
    top = 64 - depth
    prefix = F.shiftrightunsigned("fp", top).cast("int")
    # one row for each prefix: at most 2**16, whatever the input
    blocks = values.groupBy(prefix.alias("p")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    other = blocks.select(F.col("p").alias("q"), F.col("blocks").alias("others"))
    near = [m for m in range(1 << depth) if m.bit_count() <= BUDGET]
    rows = values.select("fp", prefix.alias("p")).join(F.broadcast(blocks), "p").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.select("fp", "p", "own", F.explode(F.array(*map(F.lit, near))).alias("flip")).withColumn("q", F.col("p").bitwiseXOR(F.col("flip")))
    rows = rows.join(F.broadcast(other), "q").select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("theirs"))
    mine, theirs = F.struct("p", F.col("own").alias("k")), F.struct(F.col("q").alias("p"), F.col("theirs").alias("k"))
    first = mine <= theirs
    rows = rows.select("fp", F.when(first, mine).otherwise(theirs).alias("x"), F.when(first, theirs).otherwise(mine).alias("y"), F.when(mine == theirs, F.lit(2)).when(first, F.lit(0)).otherwise(F.lit(1)).alias("side"))
    keyed = rows.select("fp", "side", F.col("x.p").alias("xp"), F.col("x.k").alias("xk"), F.col("y.p").alias("yp"), F.col("y.k").alias("yk"))
    return keyed.groupBy("xp", "xk", "yp", "yk").applyInPandas(_walk_group(top), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``."""
    marks = cut(fingerprints(docs, id_col, text_col), "simhash-fp")
    least = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(near_links(marks.sparkSession, least.select("fp")))
    known = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = cut(known, "simhash-root")
    free(least, roots)
    heads = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(heads, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")
