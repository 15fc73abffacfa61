"""A table of distinct pre-split pieces with their token ids, filled as new pieces are met."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .buffers import byte_codes, prefix_hash, ragged, span_hash
from .presplit import presplit

#: Pieces up to this many bytes are looked up by a 64-bit hash, longer ones by their bytes.
SHORT = 64
#: A worker's table starts anew beyond so many ids or pieces.
MOST_IDS, MOST_PIECES = 4_000_000, 500_000


class PieceTable:
    """resolve(bytes, starts, lengths) gives the ids of pieces, back to back, and how many each has; special is the special string and the id of its piece, or None; times: how many times the usual size the table may take, for a resolve that is slow."""

    def __init__(self, resolve: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], special: tuple[bytes, int] | None = None, times: int = 1):
        self.resolve, self.special, self.times = resolve, special, times
        self.clear()

    def clear(self) -> None:
        self.known: dict[int | bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.first, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def add(self, keys: list, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ids, sizes = self.resolve(data, starts, lengths)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) > len(self.first):
            self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
        at = np.arange(self.n, self.n + len(sizes))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[at] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.n_ids += len(ids)
        self.n += len(sizes)
        self.known.update(zip(keys, at.tolist(), strict=True))
        return at

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, special: np.ndarray) -> np.ndarray:
        """The place in the table of every piece."""
        if self.n_ids > self.times * MOST_IDS or self.n > self.times * MOST_PIECES:
            self.clear()
        place = np.empty(len(starts), np.int64)
        short = lengths <= SHORT
        if special.any():
            short &= ~special
            if -1 not in self.known:
                kept, self.resolve = self.resolve, lambda *_: (np.array([self.special[1]], np.int32), np.ones(1, np.int64))
                self.add([-1], data, starts[:1], lengths[:1])
                self.resolve = kept
            place[special] = self.known[-1]
        some = np.flatnonzero(short)
        hashes, first, back = np.unique(span_hash(prefix_hash(byte_codes(data)), starts[some], starts[some] + lengths[some]), return_index=True, return_inverse=True)
        keys, get = hashes.tolist(), self.known.get
        at = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        if len(new := np.flatnonzero(at < 0)):
            of = some[first[new]]
            at[new] = self.add([keys[i] for i in new.tolist()], data, starts[of], lengths[of])
        place[some] = at[back]
        for i in np.flatnonzero(~short & ~special).tolist():
            key = data[starts[i] : starts[i] + lengths[i]].tobytes()
            if (found := get(key)) is None:
                found = int(self.add([key], data, starts[i : i + 1], lengths[i : i + 1])[0])
            place[i] = found
        return place

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a buffer of texts: the place of every piece, and the number of pieces before each row edge."""
        starts, special = presplit(data, offsets, self.special[0] if self.special else b"")
        lengths = np.diff(np.append(starts, len(data)))
        return self.find(data, starts, lengths, special), np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a buffer of texts: all ids, and the number of ids before each row edge."""
        place, edges = self.places(data, offsets)
        sizes = self.size[place].astype(np.int64)
        before = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        return ragged(self.ids, self.first[place], sizes), before[edges]
