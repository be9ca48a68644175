"""Token counts of the parts of a document, by offsets into one encoding of the whole.

Each text is encoded once. The ids' byte lengths give every token's span of characters, and the sorted token spans are
joined with the sorted part spans by position. A token inside one part counts there. A token over a border goes whole
to the part that holds most of its characters, the earlier of equals; a character whose bytes are split over
tokens belongs to each of them. So the counts of parts that tile a text add up to its tokens.

Parts are the lines of the text, each with its line feed, or spans given by a column.

Defined cases: a null or empty text has no lines and no rows; given spans are cut to the text and sorted, of overlapping
ones the earlier keeps the characters that it shares with later ones, empty ones count 0, and tokens in no span count nowhere; rows that repeat a doc_id get rows each; a null doc_id is kept as null; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec

SCHEMA = "doc_id bigint, part bigint, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"


def token_spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token, from the tokens' byte lengths."""
    head = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(head)])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first = chars[begins] - ~head[begins] if len(begins) else chars[begins]
    return first, chars[ends]


def allocate(first: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each part, and how many of them lie over its border. Parts are sorted and apart; empty ones get none."""
    full = hi > lo
    if not full.all():
        out = np.zeros((2, len(lo)), np.int64)
        out[:, full] = allocate(first, end, lo[full], hi[full])
        return out[0], out[1]
    n = len(lo)
    counts, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not len(first):
        return counts, crossing
    a = np.searchsorted(hi, first, "right")  # the first part that ends behind the token's start
    b = np.searchsorted(lo, end, "left")  # the parts before this one start before the token's end
    one = (b - a == 1) & (first >= lo[np.minimum(a, n - 1)]) & (end <= hi[np.minimum(a, n - 1)])
    counts += np.bincount(a[one], minlength=n)
    for k in np.flatnonzero((b > a) & ~one).tolist():
        share = np.minimum(hi[a[k] : b[k]], end[k]) - np.maximum(lo[a[k] : b[k]], first[k])
        best = a[k] + int(np.argmax(share))
        counts[best] += 1
        crossing[best] += 1
    return counts, crossing


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) for x in text.split("\n")], dtype=np.int64) + np.arange(1, text.count("\n") + 2)
    ends[-1] -= 1
    begins = np.concatenate([[0], ends[:-1]])
    full = ends > begins
    return begins[full], ends[full]


def _given(spans: list[dict] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((min(max(s["start"] or 0, 0), size), min(max(s["end"] or 0, 0), size)) for s in spans or [] if s)
    lo, hi = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    lo[1:] = np.maximum(lo[1:], np.maximum.accumulate(hi)[:-1])  # overlapping spans: the earlier keeps its characters
    return lo, np.maximum(lo, hi)


def attribute_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """A row for each part of each text. spans_col: a column of array<struct<start,end>> in characters, else lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                parts, n_parts, doc_tokens = [], np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                given = part.column(2).to_pylist() if spans_col else [None] * len(part)
                for k, (raw, spans) in enumerate(zip(part.column(1).cast(pa.binary()), given, strict=True)):
                    text = raw.as_py().decode("utf-8", "replace") if raw.is_valid else ""
                    sizes = own.sizes[own.encode(text)]
                    lo, hi = _given(spans, len(text)) if spans_col else line_spans(text)
                    if not len(lo):
                        continue
                    parts.append((lo, hi, *allocate(*token_spans(text.encode("utf-8", "replace"), sizes), lo, hi)))
                    n_parts[k], doc_tokens[k] = len(lo), len(sizes)
                if parts:
                    own_row = np.repeat(np.arange(len(part)), n_parts)
                    number = np.arange(len(own_row)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                    lo, hi, counts, crossing = (np.concatenate(x) for x in zip(*parts, strict=True))
                    cols = [part.column(0).take(pa.array(own_row)), *map(pa.array, (number, lo, hi, counts, crossing, doc_tokens[own_row]))]
                    yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(spans_col).alias("spans")] if spans_col else []))
    return rows.mapInArrow(run, SCHEMA)
