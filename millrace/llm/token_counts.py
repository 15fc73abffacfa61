"""Operator 9: token counts by compiled finite-state transducers, without making ids.

Two deterministic transducers read the bytes. The splitter has a dozen states and marks where pieces start; a text is cut
into chunks, the map from entering to leaving state of every chunk is worked out for all chunks at once, and the maps
compose by a parallel prefix scan, which gives each chunk its entering state. The counter's states are determinised as they
are first met, and each of its transitions carries the number of tokens by which the count of the best segmentation so far
changes. A state holds the pending arcs of the BPE automaton of operator 1: (place in the byte trie, state they leave, count
relative to the last token end). A piece enters it in state 0, so a piece's start ends every chunk; longer pieces are cut into
chunks too. The maps of chunks hold the tokens beside the leaving state and compose by a prefix scan that starts anew with every
piece; what a whole piece's map gives is kept and looked up when the piece comes again, and counts of pieces add up by running totals.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; a very long text is a slice of its own; repeated rows count alike; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Automaton, broadcast_tables
from .buffers import kept, ragged, running, ship, slices, text_buffer
from .pieces import PieceTable
from .presplit import BLANK, LETTER, MARK, NUMBER, byte_classes, special_spans

#: Bytes of text in a chunk of the scan.
CHUNK = 128
#: Chunks whose maps the counter composes at once.
AT_ONCE = 1 << 14
#: A worker's counter starts anew beyond so many states.
MOST_STATES = 120_000
#: Below a place with more tokens than this, states are told apart without comparing what they allow.
MOST_BELOW = 512

# The splitter's input symbols, and its states: D at the start of a text, L N O within such a run, Q after a lone apostrophe that starts a piece,
# QR QV QL after 'r 'v 'l, C after a whole contraction, S1 B1 after one blank (a space or another), S2 B2 after several, M within the special string.
_LETTER, _STMD, _R, _V, _LL, _E, _NUMBER, _OTHER, _QUOTE, _SPACE, _BLANK, _INNER, _MARK = range(13)
D, L, N, O, Q, QR, QV, QL, C, S1, B1, S2, B2, M = range(14)
_STATES, _SYMBOLS = 14, 32
_EDGE = 16  # added to the symbol of a text's first byte


def _splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """next state, whether a piece starts here, whether one starts at the character before; by state * 32 + symbol."""
    to = np.zeros((_STATES, _SYMBOLS), np.uint8)
    here, back = np.zeros((_STATES, _SYMBOLS), bool), np.zeros((_STATES, _SYMBOLS), bool)
    letters = {_LETTER, _STMD, _R, _V, _LL, _E}
    finish = {_STMD: (Q, C), _R: (Q, QR), _V: (Q, QV), _LL: (Q, QL)}
    for s in range(_STATES):
        for x in range(13):
            if x == _INNER:
                to[s, x] = s
                continue
            pending = s in (QR, QV, QL)
            if x in finish and s == finish[x][0]:
                to[s, x] = finish[x][1]  # no piece starts: the contraction may take it
            elif (s in (QR, QV) and x == _E) or (s == QL and x == _LL):
                to[s, x] = C
            else:
                run = N if x == _NUMBER else L if x in letters else O
                if x == _MARK:
                    to[s, x], here[s, x] = M, s != M
                elif x in (_SPACE, _BLANK):
                    long = s in (S1, B1, S2, B2)
                    to[s, x], here[s, x] = ({_SPACE: S2, _BLANK: B2} if long else {_SPACE: S1, _BLANK: B1})[x], not long
                else:
                    same = {L: letters, N: {_NUMBER}, O: {_OTHER, _QUOTE}}
                    goes_on = x in same.get(s, ()) or s == Q and x in (_OTHER, _QUOTE) or pending and x in letters
                    joins = s in (S1, S2)
                    here[s, x] = not goes_on and not joins
                    back[s, x] = s in (S2, B2)
                    to[s, x] = Q if x == _QUOTE and here[s, x] else run
                back[s, x] |= pending
    for x in range(13):  # whatever came before, a text starts anew; only what is pending is settled
        to[:, _EDGE + x], here[:, _EDGE + x] = to[D, x], True
        back[[QR, QV, QL], _EDGE + x] = True
    return to.ravel(), here.ravel(), back.ravel()


_TO, _HERE, _BACK = _splitter()
_ASCII = np.full(256, _LETTER, np.uint8)
_ASCII[list(b"stmd")], _ASCII[ord("r")], _ASCII[ord("v")], _ASCII[ord("l")], _ASCII[ord("e")], _ASCII[ord("'")], _ASCII[0x20] = _STMD, _R, _V, _LL, _E, _QUOTE, _SPACE


def symbols(data: np.ndarray, offsets: np.ndarray, special: bytes) -> np.ndarray:
    kind = byte_classes(data)
    out = np.where(data < 0x80, _ASCII[data], _LETTER)
    out[kind == NUMBER] = _NUMBER
    other = (kind != LETTER) & (kind != NUMBER) & (data != 0x27) & (data != 0x20)
    out[other] = np.where(kind[other] == BLANK, _BLANK, _OTHER)
    out[(data & 0xC0) == 0x80] = _INNER
    first = offsets[:-1][np.diff(offsets) > 0]
    edges = np.zeros(len(data) + 1, bool)
    edges[first] = True
    if special and len(marks := special_spans(data, offsets, special)):
        for k in range(len(special)):
            out[marks + k] = _MARK
        edges[marks] = True
        edges[marks + len(special)] = True
    return out + (_EDGE * edges[:-1]).astype(np.uint8)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps, one a row: row i holds maps[i] after ... after maps[0]. Takes log2(rows) rounds."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def split_by_scan(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces, and whether each is the special string: the splitter over all chunks at once."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    own = symbols(data, offsets, special)
    count = -(-n // CHUNK)
    grid = np.full(count * CHUNK, _INNER, np.uint8)
    grid[:n] = own
    grid = np.ascontiguousarray(grid.reshape(count, CHUNK).T)  # row k: the k-th byte of every chunk
    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (count, 1))
    lane, single = np.arange(count), np.zeros(count, np.uint8)
    settled_at = np.full(count, CHUNK)
    for k in range(CHUNK):  # all entering states, until they meet
        if not len(lane):
            break
        now = _TO[maps[lane].astype(np.int16) * _SYMBOLS + grid[k, lane][:, None]]
        maps[lane] = now
        met = (now == now[:, :1]).all(axis=1)
        settled_at[lane[met]] = k + 1
        lane = lane[~met]
    single = maps[:, 0].astype(np.int16)
    for k in range(1, CHUNK):
        nxt = _TO[single * _SYMBOLS + grid[k]]
        single = np.where(settled_at <= k, nxt, single).astype(np.int16)
    settled = settled_at < CHUNK
    maps[settled] = single[settled, None].astype(np.uint8)
    state = np.empty(count, np.int16)
    state[0] = D
    state[1:] = scan(maps)[:-1, D]
    here, back = np.empty((CHUNK, count), bool), np.empty((CHUNK, count), bool)
    for k in range(CHUNK):
        at = state * _SYMBOLS + grid[k]
        here[k], back[k] = _HERE[at], _BACK[at]
        state = _TO[at].astype(np.int16)
    start = np.zeros(count * CHUNK + 1, bool)
    start[:-1] = here.T.ravel()
    before = np.flatnonzero(back.T.ravel()[:n]) - 1
    for _ in range(3):
        before = np.where((data[before] & 0xC0) == 0x80, before - 1, before)
    start[before] = True
    if state_pending(own, start, data):
        start[n - 1] = True
    starts = np.flatnonzero(start[:n])
    return starts, (own[starts] & (_EDGE - 1)) == _MARK


def state_pending(own: np.ndarray, start: np.ndarray, data: np.ndarray) -> bool:
    """Whether the buffer ends within a contraction that didn't come about: 'r, 'v or 'l, whose letter is then a piece."""
    return len(data) >= 2 and (own[-1] & (_EDGE - 1)) in (_R, _V, _LL) and own[-1] < _EDGE and (own[-2] & (_EDGE - 1)) == _QUOTE and bool(start[len(data) - 2])


class Counter:
    """The counting transducer of a vocabulary; its states are made when first reached."""

    def __init__(self, machine: Automaton):
        t = machine.t
        special = int(t["special_id"][0])
        self.child = dict(zip(t["edge"].tolist(), t["to"].tolist(), strict=True))
        self.terminal, self.order = t["terminal"].tolist(), t["order"].tolist()
        self.inner = np.zeros(len(self.terminal), bool)
        self.inner[t["edge"] >> 8] = True
        self.inner = self.inner.tolist()
        self.machine, self.exists, self.same = machine, {}, {}
        # Tokens in the order of their bytes: those below a place in the trie are one run.
        sizes, firsts = t["label_size"], machine.label_first
        labels = [t["label"][a : a + n].tobytes() for a, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]
        tokens = sorted((x for x in range(len(labels)) if x != special), key=labels.__getitem__)
        self.tokens = np.array(tokens, np.int64)
        self.low, self.high = [-1] * len(self.terminal), [0] * len(self.terminal)
        for i, x in enumerate(tokens):
            node = 0
            for b in labels[x]:
                node = self.child[(node << 8) | b]
                if self.low[node] < 0:
                    self.low[node] = i
                self.high[node] = i + 1
        self.pieces = PieceTable(self.run, (t["special"].tobytes(), 1) if special >= 0 else None)
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {((0, -1, 0),): 0}
        self.items: list[tuple] = [((0, -1, 0),)]
        self.column, self.columns = np.full(256, -1, np.int64), 0
        self.to, self.emits = np.full((1024, 64), -1, np.int32), np.zeros((1024, 64), np.int8)

    def leaves(self, state: int, token: int) -> bool:
        if state < 0:
            return True
        if (known := self.exists.get((state, token))) is None:
            if len(self.exists) > 1_000_000:
                self.exists.clear()
            known = self.exists[state, token] = bool(self.machine.leaves(np.array([state]), np.array([token]))[0])
        return known

    def standing(self, node: int, left: int) -> int:
        """The state that stands for all that allow the same tokens below a place: -1 if all are allowed, -2 if none."""
        if left < 0:
            return left
        key = (node << 20) | left
        if (known := self.same.get(key)) is None:
            if len(self.same) > 1_000_000:
                self.same.clear()
            below = self.tokens[self.low[node] + (self.terminal[node] >= 0) : self.high[node]]
            if len(below) > MOST_BELOW:
                known = left
            else:
                allowed = self.machine.leaves(np.full(len(below), left), below)
                known = -1 if allowed.all() else self.same.setdefault((node, allowed.tobytes()), left) if allowed.any() else -2
            self.same[key] = known
        return known

    def compile(self, state: int, byte: int) -> None:
        """The transition of a state by a byte."""
        kept, token_end = [], None
        for node, left, count in self.items[state]:
            if (node := self.child.get((node << 8) | byte, -1)) < 0:
                continue
            token = self.terminal[node]
            if token >= 0 and self.leaves(left, token):
                token_end = (token, count + 1)
            if self.inner[node] and (left := self.standing(node, left)) > -2:
                kept.append((node, left, count))
        token, emitted = token_end
        items = (*((node, left, count - emitted) for node, left, count in kept), (0, token, 0))
        if (to := self.number.get(items)) is None:
            to = self.number[items] = len(self.items)
            self.items.append(items)
            if to >= len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        if not -128 <= emitted < 128 and self.emits.dtype == np.int8:  # tokens of such lengths are rare
            self.emits = self.emits.astype(np.int32)
        self.to[state, self.column[byte]], self.emits[state, self.column[byte]] = to, emitted

    def walk(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of chunks and the states they are entered in: the states they are left in, and the tokens of their transitions."""
        by = np.argsort(-lengths, kind="stable")
        begin, size = starts[by], lengths[by]
        longest = int(size[0]) if len(size) else 0
        longer = np.searchsorted(-size, -np.arange(longest + 1), "left")
        state, total = states[by].astype(np.int64), np.zeros(len(by), np.int64)
        for i in range(longest):
            n = longer[i]
            byte = data[begin[:n] + i]
            column = self.column[byte]
            if (column < 0).any():
                for b in np.unique(byte[column < 0]).tolist():
                    self.column[b], self.columns = self.columns, self.columns + 1
                while self.columns > self.to.shape[1]:
                    self.to = np.concatenate([self.to, np.full_like(self.to, -1)], axis=1)
                    self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)], axis=1)
                column = self.column[byte]
            to = self.to[state[:n], column]
            if len(missing := np.flatnonzero(to < 0)):
                for key in np.unique(state[missing] << 8 | byte[missing]).tolist():
                    self.compile(key >> 8, key & 0xFF)
                to = self.to[state[:n], column]
            total[:n] += self.emits[state[:n], column]
            state[:n] = to
        left, tokens = np.empty_like(state), np.empty_like(total)
        left[by], tokens[by] = state, total
        return left, tokens

    def compose(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, entered: int) -> tuple[np.ndarray, int]:
        """Tokens of each chunk on its way, and the state after the last; first tells the chunks that begin a piece, which are entered in state 0, and entered the state before them all.

        A chunk's map is worked out for the states that it can be entered in: 0, and those that the chunk before is left in. The maps,
        with their counts, then compose by a prefix scan that starts anew with every piece, and that gives each chunk its own way.
        """
        n = len(starts)
        keys = np.arange(n, dtype=np.int64) << 32
        keys[0] |= entered
        goes_on = np.append(~first[1:], False)
        known, left, tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(keys):
            chunk = keys >> 32
            to, counts = self.walk(data, starts[chunk], lengths[chunk], keys & 0xFFFFFFFF)
            known, left, tokens = np.concatenate([known, keys]), np.concatenate([left, to]), np.concatenate([tokens, counts])
            onward = goes_on[chunk]
            keys = np.setdiff1d((chunk[onward] + 1 << 32) | to[onward], known)
        by = np.argsort(known)
        known, left, tokens = known[by], left[by], tokens[by]
        chunk = known >> 32
        way = np.searchsorted(known, np.arange(n) << 32)
        way[0] = np.searchsorted(known, entered)
        step = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        after = np.where(goes_on[chunk], np.searchsorted(known, (chunk + 1 << 32) | left), np.arange(len(known)))
        far = 1
        while far <= (step.max() if n else 0):
            of = np.flatnonzero((step >= far) & (step < 2 * far))
            way[of] = after[way[of - far]]
            after, far = after[after], 2 * far
        return tokens[way], int(left[way[-1]])

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each piece, as its only id."""
        if len(self.items) > MOST_STATES:
            self.clear()
        chunks = np.maximum(-(-lengths // CHUNK), 1)
        piece = np.repeat(np.arange(len(starts)), chunks)
        place = ragged(np.arange(chunks.max(initial=0)), np.zeros_like(chunks), chunks)
        begin, size = starts[piece] + place * CHUNK, np.minimum(lengths[piece] - place * CHUNK, CHUNK)
        out, state = np.zeros(len(starts), np.int64), 0
        for a in range(0, len(piece), AT_ONCE):
            b = min(a + AT_ONCE, len(piece))
            counts, state = self.compose(data, begin[a:b], size[a:b], place[a:b] == 0, 0 if place[a] == 0 else state)
            np.add.at(out, piece[a:b], counts)
        return out.astype(np.int32), np.ones(len(starts), np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        starts, special = split_by_scan(data, offsets, self.pieces.special[0] if self.pieces.special else b"")
        place = self.pieces.find(data, starts, np.diff(np.append(starts, len(data))), special)
        totals = running(self.pieces.ids[self.pieces.first[place]])
        return np.diff(totals[np.searchsorted(starts, offsets)])


_COUNTERS: dict[str, Counter] = kept()


def counter(shared) -> Counter:
    key, tables = shared.value
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(Automaton(tables))
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, by the byte-level vocabulary file at path."""
    spark = docs.sparkSession
    ship(spark)
    shared = broadcast_tables(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(shared)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, edges in slices(data, offsets):
                n = machine.count(part, edges)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(edges), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
