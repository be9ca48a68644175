"""Words of many texts at once, as numpy arrays over Arrow's own buffers.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D. Its hash chains its bytes, eight at a time, through a
mixing function that isn't linear, so that no Python string is made per word and no structure of the text (repeats,
complements) makes hashes equal. Two given words get the same hash with a probability of about 2**-64, unless someone
makes them for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest



def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Spans of more bytes are hashed one by one.
LONG = 128
#: Masks of the first 0 to 8 bytes of eight.
_FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 18), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Texts(NamedTuple):
    """Some neighbouring texts: their bytes without gaps, and where each begins and ends."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[Texts]:
    """The texts of a string column, about ``most`` bytes at a time; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield Texts(slice(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Words(NamedTuple):
    """Of all words of some texts: first byte, end, hash; ``first[i]`` is the number of the first word of text i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes. Spans of up to ``LONG`` bytes are read eight bytes at a time, all of them at once,
    and each eight go through ``mix`` with what came before; longer ones are hashed one by one with XXH64."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(1))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    lane, todo = 0, np.flatnonzero((size > 0) & (size <= LONG))
    while len(todo):
        at = starts[todo] + lane
        out[todo] = mix(out[todo] ^ mix(eights[at] & _FRONT[np.minimum(ends[todo] - at, 8)]))
        lane += 8
        todo = todo[size[todo] > lane]
    far = np.flatnonzero(size > LONG)
    if len(far):
        raw = data.tobytes()
        out[far] = [xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return out


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end. No word reaches over the border of two texts. ``between`` tells for each byte whether it is
    outside of words."""
    blank = np.ones(len(data) + 1, bool)
    blank[:-1] = between[data]
    word = ~blank[:-1]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= blank[:-2]
    stops[:] &= blank[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= word[inner]
    stops[inner - 1] |= word[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(texts: Texts, lower: bool) -> Words:
    data = _LOWER[texts.data] if lower else texts.data
    starts, ends = spans(data, texts.offsets)
    return Words(starts, ends, span_hash(data, starts, ends), np.searchsorted(starts, texts.offsets))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the bounds in ``first``; empty texts get 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def owner(first: np.ndarray) -> np.ndarray:
    """The number of the text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
