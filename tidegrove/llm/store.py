"""Blobs by bucket in packed files, read by workers through a bounded number of memory maps.

A file holds the blobs of ``1 << PACK`` neighbouring buckets of a kind behind a table of (bucket, begin, end). A worker keeps at
most ``MAPS`` files mapped and lets go of the one not used for longest, so that a store of any number of buckets stays far
under the kernel's limit of maps (65,530 as a rule). From a store that can't be mapped only the bucket that is asked for is
read, and of what was read at most ``HELD`` bytes are kept, so a worker never holds the whole; such a store answers slowly, and
a folder that is mounted on the workers is to be preferred.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np

from .shared import map_file, open_file, write_file

PACK = 2
MAPS, HELD = 512, 1 << 28


def write_pack(folder: str, kind: str, blobs: dict[int, bytes]) -> None:
    """``blobs`` of the buckets of one file, each of a length that 8 divides."""
    order = sorted(blobs)
    ends = np.cumsum([len(blobs[b]) for b in order]) + 8 + 24 * len(order)
    index = np.stack([np.array(order), ends - [len(blobs[b]) for b in order], ends], axis=1)
    write_file(f"{folder}/{kind}-{order[0] >> PACK}", [np.array([len(order)], np.int64).tobytes(), index.astype(np.int64).tobytes(), *(blobs[b] for b in order)])


class _File:
    """One packed file: mapped, or with a reader of ranges."""

    def __init__(self, uri: str):
        self.raw, self.source, self.held, self.read = None, None, 0, OrderedDict()
        try:
            self.raw = map_file(uri)
            self.source = None if self.raw is not None else open_file(uri)
        except FileNotFoundError:  # buckets without entries have no file
            self.index = {}
            return
        n = int(self._range(0, 8).view(np.int64)[0])
        rows = self._range(8, 8 + 24 * n).view(np.int64).reshape(-1, 3).tolist()
        self.index = {b: (lo, hi) for b, lo, hi in rows}

    def _range(self, lo: int, hi: int) -> np.ndarray:
        if self.raw is not None:
            return self.raw[lo:hi]
        self.source.seek(lo)
        return np.frombuffer(self.source.read(hi - lo), np.uint8)


class Store:
    """What ``parse`` makes of each bucket's blob, by (kind, bucket); None where there is none."""

    def __init__(self, folder: str, parse: Callable[[np.ndarray], object]):
        self.folder, self.parse = folder, parse
        self.files: OrderedDict[str, _File] = OrderedDict()
        self.held = 0

    def get(self, kind: str, bucket: int):
        name = f"{kind}-{bucket >> PACK}"
        file = self.files.pop(name, None) or _File(f"{self.folder}/{name}")
        self.files[name] = file  # last in order
        while len(self.files) > MAPS:
            self._forget()
        if bucket not in file.index:
            return None
        if bucket not in file.read:
            lo, hi = file.index[bucket]
            file.read[bucket] = self.parse(file._range(lo, hi))
            if file.raw is None:
                file.held += hi - lo
                self.held += hi - lo
                while self.held > HELD and len(self.files) > 1:
                    self._forget()
        return file.read[bucket]

    def _forget(self) -> None:
        _, file = self.files.popitem(last=False)
        self.held -= file.held
        if file.source is not None:
            file.source.close()
