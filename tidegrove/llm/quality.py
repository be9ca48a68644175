"""Quality rules from repetition: how much of a text lies in n-grams or lines that it has more than once.

Word n-grams of several lengths get rolling hashes in numpy; a word is covered if some n-gram over it occurs twice or
more in the same text. Coverage counts code points of covered words against those of all words.

Defined cases: a null or empty text has no words, all measures are 0 and it fails (fewer words than ``MIN_WORDS``).
A text with fewer words than n has no n-gram. Rows are judged one by one, so repeated rows, ties and a null doc_id
change nothing, and an empty table gives an empty one. Columns other than the id and the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: n-gram length: the share of word characters that may lie in repeated n-grams of it.
NGRAM_LIMITS = {5: 0.20, 8: 0.18, 10: 0.16, 13: 0.15}
#: Lines equal to an earlier line: as a share of the lines with a word, and of word characters.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.30
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20

_STEP = 0xD1342543DE82EF95
_UNSTEP = pow(_STEP, -1, 1 << 64)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTED = ~W._SPACE
_COUNTED[0x80:0xC0] = False
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_chars bigint, " + ", ".join(f"cover_{n} double" for n in NGRAM_LIMITS)
)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which have an equal one before them."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def covered(sums: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its text has twice or more. sums: rolling sums of word hashes."""
    m = len(text)
    out = np.zeros(m + 1, np.int64)
    if m >= n:
        at = np.flatnonzero(text[: m - n + 1] == text[n - 1 :])
        keys = W.mix((sums[at + n] - sums[at]) * W.powers(m + 1, _UNSTEP)[at]) ^ W.mix(text[at].astype(np.uint64) + np.uint64(1))
        hit = at[repeated(keys)[0]]
        out += np.bincount(hit, minlength=m + 1) - np.bincount(np.minimum(hit + n, m), minlength=m + 1)
    return np.cumsum(out)[:m] > 0


def measure(texts: W.Texts) -> dict[str, np.ndarray]:
    """All measures of some texts, one value for each text."""
    data, bounds = texts.data, texts.offsets
    starts, ends = W.spans(data, bounds)
    first = np.searchsorted(starts, bounds)
    text = W.owner(first)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_COUNTED[data], out=chars[1:])
    size = chars[ends] - chars[starts]
    out = {
        "n_words": np.diff(first),
        "word_chars": chars[bounds[1:]] - chars[bounds[:-1]],
        "n_symbols": W.per_text(_SYMBOL[data], bounds),
    }
    sums = np.zeros(len(starts) + 1, np.uint64)
    np.cumsum(W.span_hash(data, starts, ends) * W.powers(len(starts), _STEP), out=sums[1:])
    for n in NGRAM_LIMITS:
        hit = covered(sums, text, n)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = W.per_text(hit, first)
        out[f"cover_{n}"] = W.per_text(np.where(hit, size, 0), first) / np.maximum(out["word_chars"], 1)

    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(bounds[:-1], breaks + 1)
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    stop = stop - ((stop > begin) & (data[stop - 1] == 10)) if len(begin) else stop
    full = chars[stop] > chars[begin]  # a line without a word counts nowhere
    begin, stop = begin[full], stop[full]
    line_text = np.searchsorted(bounds, begin, "right") - 1
    keys = W.span_hash(data, begin, stop) ^ W.mix(line_text.astype(np.uint64) + np.uint64(1))
    later = repeated(keys)[1]
    of = lambda v: np.bincount(line_text, v, len(bounds) - 1).astype(np.int64)
    out |= {"n_lines": of(np.ones(len(begin))), "n_dup_lines": of(later), "dup_line_chars": of(np.where(later, chars[stop] - chars[begin], 0))}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    bad = (out["n_dup_lines"] > LINE_LIMIT * out["n_lines"]) | (out["dup_line_chars"] > LINE_CHAR_LIMIT * out["word_chars"])
    for n, limit in NGRAM_LIMITS.items():
        bad |= out[f"cover_{n}"] > limit
    out["kept"] = ~(bad | out["base_failed"])
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        ids = batch.column(0)
        for texts in W.slices(batch.column(1)):
            found = measure(texts)
            yield pa.RecordBatch.from_arrays([ids[texts.rows], *(pa.array(found[n]) for n in names[1:])], names)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and the verdict ``kept`` for every row of ``docs``; no shuffle."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_batches, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; the rows' own batches are filtered in place."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            kept = [measure(texts)["kept"] for texts in W.slices(column.cast(pa.string()))]
            if kept:
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays(batch.columns, [f"c{k}" for k in range(len(names))]).filter(pa.array(np.concatenate(kept)))

    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names may clash
    return plain.mapInArrow(run, plain.schema).toDF(*names)
