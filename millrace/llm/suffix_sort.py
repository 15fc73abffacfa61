"""Deep-shallow sorting of many short strings in groups: a multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

_STEP = 7  # bytes that a key of the shallow phase holds
SHALLOW = 42


def _keys(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to seven bytes as a number, and in its low byte how many there are: the order of the strings."""
    out = np.zeros(len(at), np.uint64)
    for k in range(_STEP):
        out = (out << np.uint64(8)) | np.where(left > k, padded[at + k], 0).astype(np.uint64)
    return (out << np.uint64(8)) | np.clip(left, 0, _STEP).astype(np.uint64)


def common_prefix(padded: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes, at most `most`, of the strings that start at a and b."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    step = np.arange(16)
    while len(live):
        same = padded[(a[live] + out[live])[:, None] + step] == padded[(b[live] + out[live])[:, None] + step]
        run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
        out[live] = np.minimum(out[live] + run, most[live])
        live = live[(run == 16) & (out[live] < most[live])]
    return out


class BlindTrie:
    """Branch depths and branching bytes only: a string is compared with one leaf, not along its path."""

    def __init__(self, first: int, text: bytes):
        self.texts, self.root = {first: text}, first  # a leaf is its string's number, a branch [depth, {byte: child}]

    def insert(self, number: int, text: bytes) -> None:
        self.texts[number] = text
        node = self.root
        while isinstance(node, list):
            depth, children = node
            byte = text[depth] if depth < len(text) else -1
            node = children.get(byte)
            if node is None:
                node = next(iter(children.values()))
        other = self.texts[node if not isinstance(node, tuple) else node[0]]
        n = min(len(text), len(other))
        unequal = np.flatnonzero(np.frombuffer(text, np.uint8, n) != np.frombuffer(other, np.uint8, n))
        shared = int(unequal[0]) if len(unequal) else n
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < shared:
            parent, byte = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][byte]
        mine = text[shared] if shared < len(text) else -1
        if isinstance(node, list) and node[0] == shared:
            node[1][mine] = (*_leaves(node[1][mine]), number) if mine in node[1] else number
            return
        if shared == len(text) == len(other) and not isinstance(node, list):  # an equal string
            new: int | tuple | list = (*_leaves(node), number)
        else:
            theirs = self._any(node)
            new = [shared, {mine: number, theirs[shared] if shared < len(theirs) else -1: node}]
        if parent is None:
            self.root = new
        else:
            parent[1][text[parent[0]] if parent[0] < len(text) else -1] = new

    def _any(self, node) -> bytes:
        while isinstance(node, list):
            node = next(iter(node[1].values()))
        return self.texts[_leaves(node)[0]]

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(_leaves(node))
        return out


def _leaves(node: int | tuple) -> tuple:
    return node if isinstance(node, tuple) else (node,)


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings data[start:start + length] within each group (groups ascending), and of each string in that order the length of the prefix it shares with the next of its group (0 for a group's last)."""
    n = len(starts)
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    order = np.lexsort((np.arange(n), group))
    rank = multikey_quicksort(padded, len(data), starts, lengths, order, group, shallow)
    tied = _tied(rank)
    place = 0
    while place < len(tied):  # deep phase: a blind trie for each tie
        stop = place + 1
        while stop < len(tied) and rank[tied[stop]] == rank[tied[place]]:
            stop += 1
        at = tied[place:stop]
        texts = [data[starts[i] + min(shallow, lengths[i]) : starts[i] + lengths[i]].tobytes() for i in order[at]]
        if any(x != texts[0] for x in texts):
            trie = BlindTrie(0, texts[0])
            for k in range(1, len(texts)):
                trie.insert(k, texts[k])
            order[at] = order[at][trie.order()]
        place = stop
    shared = np.zeros(n, np.int64)
    pair = np.flatnonzero(group[order[:-1]] == group[order[1:]]) if n else np.zeros(0, np.int64)
    a, b = order[pair], order[pair + 1] if n else pair
    shared[pair] = common_prefix(padded, starts[a], starts[b], np.minimum(lengths[a], lengths[b]))
    return order, shared


def multikey_quicksort(padded: np.ndarray, size: int, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray, group: np.ndarray, shallow: int) -> np.ndarray:
    """Sorts the strings of each group, in place of order, by their first shallow bytes or somewhat more; returns ranks that are equal where strings are tied.

    Every run of strings that are tied so far takes a pivot, the middle one of three of its keys at the run's depth, and parts in
    three: less, equal, greater. What equals the pivot goes on one key deeper. All runs take a step at once.
    """
    n = len(order)
    own = group[order]
    first = np.append(True, own[1:] != own[:-1])[:n]
    depth = np.zeros(n, np.int64)  # of each place
    while True:
        begin = np.flatnonzero(first)
        long = np.diff(np.append(begin, n))
        open_run = (long > 1) & (depth[begin] < shallow) if n else np.zeros(0, bool)
        if not open_run.any():
            return np.cumsum(first) - 1 if n else np.zeros(0, np.int64)
        begin, long = begin[open_run], long[open_run]
        run = np.repeat(np.arange(len(begin)), long)
        at = np.arange(len(run)) - np.repeat(np.cumsum(long) - long, long) + begin[run]
        who = order[at]
        key = _keys(padded, np.minimum(starts[who] + depth[at], size), lengths[who] - depth[at])
        offset = np.cumsum(long) - long
        pivot = np.sort(np.stack([key[offset], key[offset + long // 2], key[offset + long - 1]]), axis=0)[1][run]
        side = run * 3 + (key > pivot) + (key >= pivot)  # less, equal, greater
        by = np.argsort(side, kind="stable")
        order[at], side = who[by], side[by]
        depth[at] += _STEP * (side % 3 == 1)
        done = (side % 3 == 1) & ((key[by] & np.uint64(0xFF)) < _STEP)  # the strings end within this key: they are equal
        depth[at[done]] = shallow
        first[at[1:][side[1:] != side[:-1]]] = True


def _tied(rank: np.ndarray) -> np.ndarray:
    same = rank[1:] == rank[:-1]
    out = np.zeros(len(rank), bool)
    out[1:] = same
    out[:-1] |= same
    return np.flatnonzero(out)
