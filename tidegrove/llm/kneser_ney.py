"""An interpolated modified Kneser-Ney model of order 3 (or 2): counted in Spark, kept as sorted hash arrays, memory-mapped.

Tokens are words (``words.py``, A-Z lowered) and one end for each text; starts stand before the first as context.

* A gram is (u, v, w), w the token. Tasks sort the grams of their texts and sum equal ones; what they send on is packed
  arrays, a row for each bucket, in which u stands as a 40-bit tag of (u, v).
* A bucket holds the grams of the last context word v by the leading bits of its hash, so that all counts of grams, of
  pairs (v, w) and of contexts (u, v) and (v) are found in it. Words v that a bounded sample shows to fill over half
  a bucket are dealt over all buckets by the hash of (v, w); only their contexts (u, v) then come in parts, which are
  summed in a second shuffle. The sample decides about places only, never about counts.
* A bucket is merged by one task into sorted hash arrays; a few neighbouring ones share a file (``store.py``). Its statistics
  of words, and of contexts that came in parts, are merged by hash the same way.
* Word files have, for each word, its count, the number of different words before it, the sum of the counts of pairs it
  begins, and how many of these counts are one, two, or more. Discounts come from counts of counts.
* Scoring maps the files, a bounded number at a time, and looks grams up bucket by bucket, by a directory of leading bits and
  binary search. A context (u, v) without
  an entry whose pair is known was seen once.

p(w|uv) = max(c(uvw)-D3(c), 0)/c(uv) + g(uv) p(w|v), p(w|v) = max(n(vw)-D2(n), 0)/n(v) + g(v) p(w), p(w) = max(n(w)-D1(n), 0)/n
+ g/(V+1), where n(vw) counts the different u before vw and n(w) the different v before w, and each g is the discount
taken. Order 2 has c(vw) for n(vw). Over the V words and one unknown they sum to 1.

Words are told apart by all 64 bits of their hashes. Grams, pairs and contexts are kept by 24 bits beyond the directory's,
with at most eight entries to a place on average: one lookup in two million of what is absent finds another's count.

Defined cases: a null or empty text is an end alone; a null doc_id has no check sum, and such rows are for training;
rows that repeat a doc_id count and are scored each; with no training text at all every probability is 1/(V+1) = 1; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import cut, free, new_dir
from .store import PACK, Store, write_pack

END, START = np.uint64(0xE5D0000000000001), np.uint64(0x57A2000000000001)
#: Grams that a task holds before it sorts and sends them; documents a bucket.
HOLD, DOCS_A_BUCKET = 2_000_000, 2000
#: Tasks that merge buckets, as a power of two; a task takes its buckets one after the other.
TASK_BITS = 14
SAMPLE_DOCS, HOT = 512, 256
_PAIR = np.uint64(0x9FB21C651E98DF25)
#: Bytes of a tag, and of a gram's hash beyond the directory's bits.
TAG, LOW = 5, 3


def tokens(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of some texts in order, and where each text begins."""
    found = W.words(texts, lower=True)
    n = len(found.first) - 1
    first = found.first + np.arange(n + 1)
    out = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = found.hashes
    out[ends] = END
    return out, first


def contexts(tok: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(tok)
    out[1:] = tok[:-1]
    out[first[:-1]] = START
    return out


def tags(v: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """The word before each context word, as a tag that is told apart for equal ``v`` only; all alike for order 2."""
    return W.mix(contexts(v, first) * _PAIR + v) >> np.uint64(64 - 8 * TAG) if order == 3 else np.zeros_like(v)


class Layout:
    """Where grams and words are: 2**bits buckets."""

    def __init__(self, bits: int, hot: np.ndarray):
        self.bits, self.hot = bits, np.sort(hot)

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (W.mix(hashes) >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, key) of pairs."""
        key = W.mix(ctx * _PAIR + word)
        where = np.where(self.is_hot(ctx), key, W.mix(ctx))
        return (where >> np.uint64(64 - self.bits)).astype(np.int64), key

    def is_hot(self, ctx: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(ctx), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, ctx), len(self.hot) - 1)] == ctx


def gram_key(pair: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return W.mix(pair ^ (tag * _PAIR))


def context_key(v: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(v) + tag)


def merge(parts: list[tuple], keys: int) -> tuple:
    """Sums of rows with equal keys. Each part is a tuple of arrays, the first ``keys`` of which are the key."""
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort(cols[keys - 1 :: -1]) if keys > 1 else np.argsort(cols[0], kind="stable")
    cols = [c[order] for c in cols]
    new = np.zeros(len(order), bool)
    for c in cols[:keys]:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    at = np.flatnonzero(new)
    return (*(c[at] for c in cols[:keys]), *(np.add.reduceat(c, at) if len(at) else c for c in cols[keys:]))


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lengths(at: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(at, n))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8) if len(x) == 0 or x.max() < 256 else _u32(x)


def _u32(x: np.ndarray) -> np.ndarray:
    """Counts as they are stored; one that doesn't fit stops the job instead of wrapping round."""
    if len(x) and x.max() >= 1 << 32:
        raise OverflowError("a count is over 32 bits")
    return x.astype(np.uint32)


def _sent(x: np.ndarray) -> bytes:
    """Counts with their width before them."""
    x = _small(x)
    return bytes([x.itemsize]) + x.tobytes()


def _got(raw) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if raw[0:1].to_pybytes() == b"\x01" else np.uint32, offset=1)


def _cut_bytes(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def _whole(raw, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1).astype(np.uint64)


_GRAM_ROWS = "bucket int, v binary, n_w binary, w binary, n_u binary, u binary, n binary"


def _count(layout: Layout, order: int):
    """Grams of a task's texts, summed, as rows of packed arrays: each v with its number of w, each w with its number of
    tags, tags and counts."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        v, w, tag, n = merge(held, 3)
        bucket = layout.keys(v, w)[0]
        by = np.argsort(bucket, kind="stable")
        v, w, tag, n, bucket = v[by], w[by], tag[by], n[by], bucket[by]
        at = _starts(bucket)
        rows = [[] for _ in range(7)]
        for lo, hi in zip(at, np.append(at[1:], len(bucket)), strict=True):
            pairs = _starts(v[lo:hi], w[lo:hi])
            heads = v[lo:hi][pairs]
            vs = _starts(heads)
            packed = (heads[vs].tobytes(), _sent(_lengths(vs, len(pairs))), w[lo:hi][pairs].tobytes(), _sent(_lengths(pairs, hi - lo)), _cut_bytes(tag[lo:hi], TAG if order == 3 else 0).tobytes(), _sent(n[lo:hi]))
            for out, value in zip(rows, (int(bucket[lo]), *packed), strict=True):
                out.append(value)
        kinds = [pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["bucket", "v", "n_w", "w", "n_u", "u", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for texts in W.slices(batch.column(0)):
                tok, first = tokens(texts)
                v = contexts(tok, first)
                held.append((v, tok, tags(v, first, order), np.ones(len(tok), np.int64)))
                size += len(tok)
                if size >= HOLD:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _buf(column) -> list:
    return [x.as_buffer() for x in column]


def pack_table(key: np.ndarray, cols: list[np.ndarray], width: int) -> bytes:
    """A sorted hash array: a directory of leading bits, ``width`` bytes of each hash, and a byte for each count, with those
    of 255 and more listed beside."""
    by = np.argsort(key)
    key, cols = key[by], [c[by] for c in cols]
    bits = max(1, (len(key) // 8).bit_length())
    slots = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    far = [np.flatnonzero(c >= 255) for c in cols]
    low = key if width == 8 else (key << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    parts = [np.array([len(key), bits, width, len(cols), *map(len, far)], np.uint64), slots]
    for c, f in zip(cols, far, strict=True):
        parts += [_u32(f), _u32(c[f])]
    parts += [_cut_bytes(low, width), *(np.minimum(c, 255).astype(np.uint8) for c in cols)]
    raw = b"".join(x.tobytes() for x in parts)
    return raw + bytes(8 + -len(raw) % 8)


class Table:
    """A table that ``pack_table`` made, on the mapped bytes."""

    def __init__(self, raw: np.ndarray):
        self.n, self.bits, self.width, n_cols = (int(x) for x in raw[:32].view(np.uint64))
        far = raw[32 : 32 + 8 * n_cols].view(np.uint64).astype(np.int64).tolist()
        at = 32 + 8 * n_cols

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return raw[at - n * np.dtype(kind).itemsize : at].view(kind)

        self.slots = take((1 << self.bits) + 1, np.uint32)
        self.far = [(take(f, np.uint32), take(f, np.uint32)) for f in far]
        self.low = np.ndarray((self.n,), "<u8" if self.width == 8 else "<u4", raw, at, (self.width,))
        at += self.n * self.width
        self.cols = [take(self.n, np.uint8) for _ in far]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key would stand, and whether it does."""
        if not self.n:
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        want = key if self.width == 8 else ((key << np.uint64(self.bits)) >> np.uint64(64 - 8 * self.width)).astype(np.uint32)
        mask = self.low.dtype.type((1 << 8 * self.width) - 1)
        lo, end = self.slots[slot].astype(np.int64), self.slots[slot + 1].astype(np.int64)
        hi = end
        while (lo < hi).any():
            half = (lo + hi) >> 1
            less = (self.low[np.minimum(half, self.n - 1)] & mask) < want
            lo, hi = np.where((lo < hi) & less, half + 1, lo), np.where((lo < hi) & ~less, half, hi)
        at = np.minimum(lo, self.n - 1)
        return at, (lo < end) & ((self.low[at] & mask) == want)

    def counts(self, col: int, at: np.ndarray) -> np.ndarray:
        out = self.cols[col][at].astype(np.int64)
        place, value = self.far[col]
        big = np.flatnonzero(out == 255)
        out[big] = value[np.searchsorted(place, at[big])]
        return out


def _joined(tables: list[bytes]) -> bytes:
    """Tables as one blob."""
    return b"".join([np.array([len(tables), *map(len, tables)], np.uint64).tobytes(), *tables])


def _parted(raw: np.ndarray) -> list[Table]:
    n = int(raw[:8].view(np.uint64)[0])
    ends = np.append(0, raw[8 : 8 * (n + 1)].view(np.uint64)).astype(np.int64).cumsum() + 8 * (n + 1)
    return [Table(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _by_count(key: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Two tables: what was counted once, without counts, and the rest."""
    return [pack_table(key[n == 1], [], LOW), pack_table(key[n > 1], [n[n > 1]], LOW)]


_WORD_ROWS = "wbucket int, kind string, word binary, a binary, b binary, c binary, d binary, stats array<bigint>"


def _packs(folder: str, kind: str, key: str, merge_one):
    """Merges the buckets of a file, one after the other, and writes it."""

    def run(table: pa.Table) -> pa.Table:
        where = table.column(key).to_numpy()
        blobs, out = {}, []
        for bucket in np.unique(where).tolist():
            blobs[bucket], rows = merge_one(table.take(np.flatnonzero(where == bucket)))
            out.append(rows)
        write_pack(folder, kind, blobs)
        return pa.concat_tables(out)

    return run


def _merge_grams(layout: Layout, order: int):
    """Merges a bucket: its tables, and its part of the statistics of words and of contexts in parts."""

    def run(table: pa.Table) -> tuple[bytes, pa.Table]:
        parts = []
        for v, n_w, w, n_u, u, n in zip(*(_buf(table.column(k)) for k in ("v", "n_w", "w", "n_u", "u", "n")), strict=True):
            n, n_u = _got(n).astype(np.int64), _got(n_u)
            v = np.repeat(np.repeat(np.frombuffer(v, np.uint64), _got(n_w)), n_u)
            parts.append((v, np.repeat(np.frombuffer(w, np.uint64), n_u), _whole(u, TAG) if order == 3 else np.zeros(len(n), np.uint64), n))
        bucket = table.column("bucket")[0].as_py()
        v, w, tag, n = merge(parts, 3)
        del parts
        at = _starts(v, w)
        pv, pw, pc = v[at], w[at], _sums(n, at)
        pn = _lengths(at, len(v)) if order == 3 else pc
        pair = layout.keys(pv, pw)[1]
        tables, out = _by_count(pair, pn), []

        def send(kind: str, key: np.ndarray, *cols: np.ndarray) -> None:
            where = layout.bucket(key)
            by = np.argsort(where, kind="stable")
            at = _starts(where[by])
            for rows in np.split(by, at[1:]) if len(by) else []:
                packed = [_sent(c[rows]) for c in cols]
                out.append((int(where[rows[0]]), kind, key[rows].tobytes(), *packed, *[b""] * (4 - len(packed)), None))

        if order == 3:
            tables += _by_count(gram_key(np.repeat(pair, pn), tag), n)
            by = np.lexsort((tag, v))
            cv, ct, cn = v[by], tag[by], n[by]
            cat = _starts(cv, ct)
            key, hot = context_key(cv[cat], ct[cat]), layout.is_hot(cv[cat])
            cols = [_sums(cn, cat), *(_sums(cn == k if k < 3 else cn > 2, cat) for k in (1, 2, 3))]
            more = cols[0] > 1
            tables.append(pack_table(key[more & ~hot], [c[more & ~hot] for c in cols], LOW))
            send("once", key[hot & ~more])
            send("more", key[hot & more], *(c[hot & more] for c in cols))
        vat = _starts(pv)
        send("context", pv[vat], _sums(pn, vat), *(_sums(pn == k if k < 3 else pn > 2, vat) for k in (1, 2, 3)))
        by = np.argsort(pw, kind="stable")
        wat = _starts(pw[by])
        send("word", pw[by][wat], _sums(pc[by], wat), _lengths(wat, len(pw)))
        out.append((bucket, "stats", *[b""] * 5, [int((x == k).sum()) for x in (n, pn) for k in (1, 2, 3, 4)]))
        kinds = [pa.int32(), pa.string(), *[pa.binary()] * 5, pa.list_(pa.int64())]
        names = ["wbucket", "kind", "word", "a", "b", "c", "d", "stats"]
        return _joined(tables), pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _merge_words():
    """Merges the parts that fell to a bucket into tables: words with count, words before, and the sum and the ones, twos
    and more of the counts of their pairs; then contexts that came in parts. Hands the statistics on."""

    def run(table: pa.Table) -> tuple[bytes, pa.Table]:
        words, ctx, stats = [], [], np.zeros(8, np.int64)
        for kind, part, *raw in zip(table.column("kind").to_pylist(), table.column("stats").to_pylist(), *(_buf(table.column(k)) for k in ("word", "a", "b", "c", "d")), strict=True):
            if kind == "stats":
                stats += np.array(part, np.int64)
                continue
            key = np.frombuffer(raw[0], np.uint64)
            none, one = np.zeros(len(key), np.int64), np.ones(len(key), np.int64)
            cols = [_got(x).astype(np.int64) for x in raw[1:] if len(x)]
            if kind in ("once", "more"):
                ctx.append((key, *(cols or [one, one, none, none])))
            else:
                words.append((key, *([*cols, *[none] * 4] if kind == "word" else [none, none, *cols])))
        empty = np.zeros(0, np.int64)
        word, *cols = merge(words, 1) if words else (np.zeros(0, np.uint64), *[empty] * 6)
        key, *sums = merge(ctx, 1) if ctx else (np.zeros(0, np.uint64), *[empty] * 4)
        more = sums[0] > 1
        blob = _joined([pack_table(word, cols, 8), pack_table(key[more], [c[more] for c in sums], LOW)])
        c, before = cols[:2]
        totals = [*stats.tolist(), int((c > 0).sum()), int(c.sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4))]
        return blob, pa.table([pa.array([totals], pa.list_(pa.int64()))], ["stats"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from counts of counts; where one can't be told, a half, one and one and a half."""
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def _sum_stats(df: DataFrame, n: int) -> list[int]:
    got = df.select(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(n))).first()
    return [int(x or 0) for x in got]


def train(docs: DataFrame, text_col: str = "text", order: int = 3) -> dict:
    """Counts ``docs`` and writes the model's files below the shared folder. Returns where, and the model's totals."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    folder = new_dir(spark, "kneser-ney")
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    n_docs = rows.count()
    bits = min(20, max(4, int(np.ceil(np.log2(max(1, n_docs / DOCS_A_BUCKET))))))
    layout = Layout(bits, _frequent(rows, n_docs, 0.5 / (1 << bits)))
    tasks = 1 << min(bits, TASK_BITS)
    packed = rows.mapInArrow(_count(layout, order), _GRAM_ROWS)
    file = lambda c: F.shiftright(c, PACK).alias("file")
    merged = packed.withColumn("file", file("bucket")).repartition(tasks, "file").groupBy("file").applyInArrow(_packs(folder, "gram", "bucket", _merge_grams(layout, order)), _WORD_ROWS)
    words = merged.withColumn("file", file("wbucket")).repartition(tasks, "file").groupBy("file").applyInArrow(_packs(folder, "word", "wbucket", _merge_words()), "stats array<bigint>")
    done = cut(words, "kneser-ney-words")
    stats = _sum_stats(done, 15)
    free(done)
    vocab, words, types, u1, u2, u3, u4 = stats[8:]
    return {"folder": folder, "order": order, "n_starts": n_docs, "bits": bits, "hot": layout.hot, "vocab": vocab, "total": words, "types": types, "d3": discounts(*stats[:4]), "d2": discounts(*stats[4:8]), "d1": discounts(u1, u2, u3, u4), "counts1": (u1, u2, vocab - u1 - u2)}


def _frequent(rows: DataFrame, n_docs: int, share: float) -> np.ndarray:
    """Context words that are over ``share`` of those of about ``SAMPLE_DOCS`` texts chosen by their hash; at most ``HOT``."""
    some = min(1.0, SAMPLE_DOCS / max(1, n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column(0)):
                tok, first = tokens(texts)
                word, n = np.unique(contexts(tok, first), return_counts=True)
                top = np.argsort(-n)[: 4 * HOT]
                yield pa.RecordBatch.from_arrays([pa.array([*word[top].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[top].tolist(), len(tok)], pa.int64())], ["word", "n"])

    drawn = rows.where(F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(1 << 20)) < some * (1 << 20)).mapInArrow(run, "word bigint, n bigint")
    top = drawn.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.col("word").asc_nulls_first()).limit(HOT + 1).collect()
    total = sum(r["n"] for r in top if r["word"] is None)
    return np.array([r["word"] for r in top if r["word"] is not None and r["n"] > share * total], np.int64).view(np.uint64)


class Model:
    """A model's tables, mapped when needed."""

    def __init__(self, spec: dict):
        self.spec, self.layout = spec, Layout(spec["bits"], spec["hot"])
        self.store = Store(spec["folder"], _parted)

    def _look(self, kind: str, bucket: np.ndarray, keys: np.ndarray, first: int, most: int, n: int, once: tuple = ()) -> list[np.ndarray]:
        """The ``n`` counts behind each key, 0 where there are none: from the tables ``first`` to ``most`` of its bucket, of
        which one without counts stands for ``once``."""
        order = np.argsort(bucket, kind="stable")
        b, k = bucket[order], keys[order]
        out = [np.zeros(len(keys), np.int64) for _ in range(n)]
        at = _starts(b)
        for lo, hi in zip(at, np.append(at[1:], len(b)) if len(b) else [], strict=True):
            for table in (self.store.get(kind, int(b[lo])) or [])[first : most + 1]:
                i, hit = table.find(k[lo:hi])
                i, rows = i[hit], order[lo:hi][hit]
                for col, o in enumerate(out):
                    o[rows] = table.counts(col, i) if table.cols else once[col]
        return out

    def words(self, hashes: np.ndarray) -> list[np.ndarray]:
        unique, back = np.unique(hashes, return_inverse=True)
        return [x[back] for x in self._look("word", self.layout.bucket(unique), unique, 0, 0, 6)]

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self._look("gram", *self.layout.keys(v, w), 0, 1, 1, (1,))[0]

    def grams(self, v: np.ndarray, w: np.ndarray, tag: np.ndarray) -> np.ndarray:
        bucket, pair = self.layout.keys(v, w)
        return self._look("gram", bucket, gram_key(pair, tag), 2, 3, 1, (1,))[0]

    def contexts(self, v: np.ndarray, tag: np.ndarray) -> list[np.ndarray]:
        """Of contexts that were seen, how often, and their followers seen once, twice, more often."""
        key, hot = context_key(v, tag), self.layout.is_hot(v)
        out = [np.zeros(len(v), np.int64) for _ in range(4)]
        for rows, kind, bucket, table in ((np.flatnonzero(~hot), "gram", self.layout.bucket(v), 4), (np.flatnonzero(hot), "word", self.layout.bucket(key), 1)):
            for o, x in zip(out, self._look(kind, bucket[rows], key[rows], table, table, 4), strict=True):
                o[rows] = x
        once = out[0] == 0
        out[0][once] = out[1][once] = 1
        return out

    def score(self, tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its log10 probability, and its count in training."""
        s = self.spec
        v = contexts(tok, first)
        c, before, *follow = self.words(np.append(tok, START))
        c, before = c[:-1], before[:-1]
        p = _discounted(before, s["d1"]) / max(1, s["types"])
        spare = sum(d * n for d, n in zip(s["d1"], s["counts1"], strict=True)) / s["types"] if s["types"] else 1.0
        p = p + spare / (s["vocab"] + 1)
        size, *follow = (_moved(x[:-1], first, x[-1]) for x in follow)
        seen = size > 0
        both = seen & (c > 0)
        n = np.zeros(len(tok), np.int64)
        n[both] = self.pairs(v[both], tok[both])
        p = _mixed(n, s["d2"], size, follow, p)
        if s["order"] == 3:
            tag, known = tags(v, first, 3), n > 0
            seen = _moved(known, first, s["n_starts"] > 0)
            stats = [np.zeros(len(tok), np.int64) for _ in range(4)]
            for o, x in zip(stats, self.contexts(v[seen], tag[seen]), strict=True):
                o[seen] = x
            both = seen & known
            n = np.zeros(len(tok), np.int64)
            n[both] = self.grams(v[both], tok[both], tag[both])
            p = _mixed(n, s["d3"], stats[0], stats[1:], p)
        return np.log10(p), c


def _moved(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """What belongs to the token before each, and ``start`` at the beginning of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = start
    return out


def _mixed(n: np.ndarray, d: tuple, size: np.ndarray, follow: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
    """Discounted counts and what the discounts leave for the lower order; that alone where the context is unknown."""
    spare = np.where(size > 0, sum(x * y for x, y in zip(d, follow, strict=True)) / np.maximum(size, 1), 1.0)
    return _discounted(n, d) / np.maximum(size, 1) + spare * lower


def _discounted(n: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0)


_models: dict[str, Model] = {}


def load(spec: dict) -> Model:
    if spec["folder"] not in _models:
        _models.clear()
        _models[spec["folder"]] = Model(spec)
    return _models[spec["folder"]]


def score(docs: DataFrame, spec: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(spec)
        low = 0.5 * (spec["vocab"] + 1)
        for batch in batches:
            for texts in W.slices(batch.column(1), 1 << 22):
                tok, first = tokens(texts)
                logs, c = model.score(tok, first)
                base = np.log10((c + 0.5) / (spec["total"] + low))
                n, total = np.diff(first), np.add.reduceat(logs, first[:-1])
                cols = [n, np.add.reduceat((c > 0).astype(np.int64), first[:-1]), np.add.reduceat(base, first[:-1]), total, 10 ** (-total / n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[texts.rows], *map(pa.array, cols)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")


def is_held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_held_out(docs: DataFrame, order: int = 3) -> DataFrame:
    """Trains on four fifths of the documents, by the check sum of the id, and scores all of them."""
    learn = docs.where(~is_held_out(F.col("doc_id")))
    spec = train(learn, order=order)
    done = score(docs, spec)
    return done.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(spec["total"]).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")
