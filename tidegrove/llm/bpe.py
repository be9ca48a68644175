"""Byte-level BPE encoding and decoding of whole texts as a tree reduction.

A text is encoded by halves: leaves of at most ``LEAF`` characters by the rank tables, and two neighbours are joined by
encoding a window around their border anew. The window grows on both sides until each end is a place where the
pattern must break whatever stands around it: between a character that is not white space and a blank or line feed.
No match of the pattern holds such a pair (white space stands only at a match's front, or fills it), a match that ends
there looks at nothing behind it, and matches from there on depend only on what follows. So the ids outside the window
are proven final, and joining is associative: any split gives the ids of the whole text. Where no such place exists
the window reaches the outer end, and the pair is encoded as one. Decoding joins the bytes of the halves.

Defined cases: a null or empty text has no ids and decodes to no bytes. Bytes that aren't UTF-8 count as U+FFFD.
Every row gives a row, so repeated rows, ties, null ids and empty tables need nothing more; other columns aren't read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf: an ordinary document is a tree of several.
LEAF = 256
#: Rows whose ids are held at a time.
ROWS = 256
_BREAK = re.compile(r"[^\s\x85\xa0](?=[ \n])")


class Codec:
    """The merges of a rank file, with the tree over them."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf = leaf
        self.table = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, 0, len(text))

    def _plain(self, text: str) -> np.ndarray:
        return self.table.encode_to_numpy(text) if text else np.zeros(0, np.uint32)

    def _tree(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        reach = 16
        while True:  # to the last safe break at or before mid
            begin = max(lo, mid - reach)
            at = [m.end() for m in _BREAK.finditer(text, begin, mid + 1)]
            if at or begin == lo:
                begin = at[-1] if at else lo
                break
            reach *= 2
        reach = 16
        while True:  # to the first at or after mid
            end = min(hi, mid + reach)
            found = _BREAK.search(text, max(lo, mid - 1), min(hi, end + 1))
            if found or end == hi:
                end = found.end() if found else hi
                break
            reach *= 2
        keep = len(left) - self._count(left[::-1], len(text[begin:mid].encode("utf-8", "replace")))
        skip = self._count(right, len(text[mid:end].encode("utf-8", "replace")))
        return np.concatenate([left[:keep], self._plain(text[begin:end]), right[skip:]])

    def _count(self, ids: np.ndarray, size: int) -> int:
        """How many ids from the front make ``size`` bytes."""
        n = 0
        while size:
            sums = np.cumsum(self.sizes[ids[n : 2 * n + 64]])
            k = int(np.searchsorted(sums, size, "right"))
            n += k
            size -= int(sums[k - 1]) if k else 0
            if k < len(sums) and size:
                raise AssertionError("a window's end isn't the border of a token")
        return n

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= max(self.leaf, 4096):  # decoding has no borders to mend
            return self.table.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                ids = [own.encode(x.as_py().decode("utf-8", "replace") if x.is_valid else "") for x in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])
            del batch
            pa.default_memory_pool().release_unused()

    return run


def _decode(path: str, pattern: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                texts = [own.decode(np.frombuffer(x.as_py(), "<u4")) if x.is_valid else b"" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    return run


_ENCODED = "doc_id bigint, n_tokens bigint, ids binary"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for every row; ids are unsigned 32-bit little-endian integers in one binary value."""
    return _rows(docs, id_col, text_col).mapInArrow(_encode(path, pattern), _ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes that its ids stand for."""
    return encoded.mapInArrow(_decode(path, pattern, encoded.columns), ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the ids of every text, and of the bytes they decode to. Both ways run in one Python worker a
    task, a few hundred rows at a time."""
    there, back = _encode(path, pattern), _decode(path, pattern, ["doc_id", "n_tokens", "ids"])
    both = _rows(docs, id_col, text_col).mapInArrow(lambda batches: back(there(batches)), _ENCODED + ", decoded binary")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
