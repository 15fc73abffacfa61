"""Operator 1: byte-level BPE encoding and decoding by a compiled automaton.

Compilation. The automaton starts as one state with an arc for every byte token. Each merge (u, v), in rank order,
applies one merge gadget: whatever arc u entered now enters a copy of that state without its arc v, and wherever an
arc u leaves, an arc uv leaves too and enters what v entered. All arcs with one label keep entering one state, so a
state is named by its last token and the automaton stays deterministic; its paths are exactly the token sequences that
BPE yields. A copy is stored as its difference, a cut (token, rank): the copy has no arc for that token, nor for tokens
that later gadgets grow from that arc. Tokens are numbered in preorder of a forest in which uv is a child of u, younger
children first, so that a cut is one interval and a state a sorted list of intervals.

Encoding. Every prefix of a piece has one accepted path. From each position the byte trie of the vocabulary offers the
arcs that spell what follows, and the state's table says which of them exist; pieces advance in lock step as arrays.
Decoding emits the byte label of every arc.

Defined results: a null text counts as empty and gives no ids; repeated rows are encoded alike; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import kept, ragged, ship, slices, text_buffer
from .pieces import SHORT, PieceTable

_WIDTH = 20  # bits of a token's number within a key


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """What a byte-level BPE file says: the bytes of each id, merges as (left, right, result), and the special token."""

    labels: list[bytes]
    merges: list[tuple[int, int, int]]
    special: tuple[bytes, int] | None

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        d = json.loads(text)
        if (d["pre_tokenizer"] or {}).get("type") != "ByteLevel" or d["pre_tokenizer"]["add_prefix_space"] or d["normalizer"] or len(d["added_tokens"]) > 1:
            raise ValueError("a byte-level BPE without normalizer, prefix space or several added tokens is asked for")
        vocab, merges, to_byte = d["model"]["vocab"], d["model"]["merges"], byte_alphabet()
        added = d["added_tokens"][0] if d["added_tokens"] else None
        labels = [b""] * (1 + max([*vocab.values(), *([added["id"]] if added else [])]))
        for token, i in vocab.items():
            labels[i] = bytes(to_byte[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        special = (added["content"].encode(), added["id"]) if added else None
        if added:
            labels[added["id"]] = special[0]
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)


def compile_automaton(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The tables of the automaton as arrays; their size is bounded by the vocabulary."""
    n = len(vocabulary.labels)
    cuts: list[list[int]] = [[] for _ in range(n)]  # of the state that arcs with this label enter: ranks of the gadgets that copied it
    children: list[list[int]] = [[] for _ in range(n)]
    born = np.full(n, -1, np.int64)
    for rank, (u, v, uv) in enumerate(vocabulary.merges):
        cuts[uv] = cuts[v].copy()
        cuts[u].append(rank)
        children[u].append(uv)
        born[uv] = rank
    special = vocabulary.special[1] if vocabulary.special else -1
    single = [t for t, label in enumerate(vocabulary.labels) if len(label) == 1 and t != special]
    order, size, at = np.zeros(n, np.int64), np.ones(n, np.int64), 0
    for _, _, uv in reversed(vocabulary.merges):
        size[uv] += sum(int(size[c]) for c in children[uv])
    for t in single:
        size[t] += sum(int(size[c]) for c in children[t])
    stack = single[::-1]
    while stack:  # preorder; the youngest child, pushed last, comes first
        t = stack.pop()
        order[t], at = at, at + 1
        stack.extend(children[t])
    start, stop = np.zeros(len(vocabulary.merges), np.int64), np.zeros(len(vocabulary.merges), np.int64)
    for rank, (u, v, _) in enumerate(vocabulary.merges):
        start[rank] = order[v]
        least = rank if u == v else rank + 1  # a state without arc u = v gets no arc uv either
        older = [c for c in children[v] if born[c] < least]
        stop[rank] = order[older[-1]] if older else order[v] + size[v]
    state = np.repeat(np.arange(n), [len(c) for c in cuts])
    ranks = np.fromiter((r for c in cuts for r in c), np.int64, len(state))
    keys, ends = (state << _WIDTH) | start[ranks], (state << _WIDTH) | stop[ranks]
    by = np.argsort(keys, kind="stable")
    nodes, terminal = {}, [-1]
    for t, label in enumerate(vocabulary.labels):
        if t == special:
            continue
        node = 0
        for b in label:
            key = (node << 8) | b
            node = nodes.setdefault(key, len(terminal))
            if node == len(terminal):
                terminal.append(-1)
        terminal[node] = t
    edge = np.fromiter(nodes, np.int64, len(nodes))
    to = np.fromiter(nodes.values(), np.int64, len(nodes))
    by_edge = np.argsort(edge)
    return {
        "cut": keys[by], "reach": np.maximum.accumulate(ends[by]) if len(by) else ends, "order": order, "edge": edge[by_edge], "to": to[by_edge], "terminal": np.array(terminal, np.int64),
        "label": np.frombuffer(b"".join(vocabulary.labels), np.uint8), "label_size": np.array([len(x) for x in vocabulary.labels], np.int64),
        "special": np.frombuffer(vocabulary.special[0] if vocabulary.special else b"", np.uint8), "special_id": np.array([special]),
    }


class Automaton:
    """Table-driven encoding and decoding."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.t = tables
        self.label_first = np.cumsum(tables["label_size"]) - tables["label_size"]
        decimals = [b"%d," % i for i in range(len(tables["label_size"]))]
        self.decimal = np.frombuffer(b"".join(decimals), np.uint8)
        self.decimal_size = np.array([len(x) for x in decimals], np.int64)
        self.decimal_first = np.cumsum(self.decimal_size) - self.decimal_size
        self.root = np.zeros(256, np.int64)  # children of the root, 0 for none
        self.root[tables["edge"][tables["edge"] < 256]] = tables["to"][tables["edge"] < 256]
        special = int(tables["special_id"][0])
        self.pieces = PieceTable(self.run, (tables["special"].tobytes(), special) if special >= 0 else None)
        self._scalar: tuple | None = None

    def leaves(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state that arcs labelled state enter has an arc labelled token."""
        cut, reach = self.t["cut"], self.t["reach"]
        if not len(cut):
            return np.ones(len(state), bool)
        key = (state << _WIDTH) | self.t["order"][token]
        i = np.searchsorted(cut, key, "right") - 1
        return (i < 0) | (reach[i] <= key)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces back to back, and how many each has."""
        if len(lengths) == 1 and lengths[0] > SHORT:
            ids = self.run_one(data[starts[0] : starts[0] + lengths[0]].tobytes())
            return ids, np.array([len(ids)])
        edge, to, terminal = self.t["edge"], self.t["to"], self.t["terminal"]
        by = np.argsort(-lengths, kind="stable")
        size = lengths[by]
        n, longest = len(by), int(size[0]) if len(by) else 0
        padded = np.concatenate([data, np.zeros(longest, np.uint8)])
        last, step = np.zeros((longest + 1, n), np.int64), np.zeros((longest + 1, n), np.int64)
        begin = starts[by]
        longer = np.searchsorted(-size, -np.arange(longest + 1), "left")  # pieces longer than i
        for i in range(longest):
            at = np.arange(longer[i])
            node = self.root[padded[begin[at] + i]]
            for d in range(1, longest - i + 1):
                token = terminal[node]
                hit = np.flatnonzero(token >= 0)
                if i and len(hit):
                    hit = hit[self.leaves(last[i, at[hit]], token[hit])]
                last[i + d, at[hit]] = token[hit]
                step[i + d, at[hit]] = d
                more = np.flatnonzero(size[at] > i + d)
                if not len(more):
                    break
                at = at[more]
                key = (node[more] << 8) | padded[begin[at] + i + d]
                j = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
                found = np.flatnonzero(edge[j] == key)
                if not len(found):
                    break
                at, node = at[found], to[j[found]]
        position, who, seen, count = size.copy(), np.arange(n), [], np.zeros(n, np.int64)
        while len(who):
            seen.append((who, last[position[who], who]))
            count[who] += 1
            position[who] -= step[position[who], who]
            who = who[position[who] > 0]
        sizes = np.zeros(n, np.int64)
        sizes[by] = count
        end = np.cumsum(sizes)[by]
        out = np.zeros(int(count.sum()), np.int32)
        for k, (who, token) in enumerate(seen):
            out[end[who] - 1 - k] = token
        return out, sizes

    def run_one(self, piece: bytes) -> np.ndarray:
        """The same run over one long piece."""
        if self._scalar is None:
            self._scalar = tuple(self.t[k].tolist() for k in ("cut", "reach", "order", "terminal")) + (dict(zip(self.t["edge"].tolist(), self.t["to"].tolist(), strict=True)),)
        cut, reach, order, terminal, child = self._scalar
        n = len(piece)
        last, step = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            node, state = 0, last[i]
            for j in range(i, n):
                if (node := child.get((node << 8) | piece[j], -1)) < 0:
                    break
                if (token := terminal[node]) >= 0:
                    if i:
                        key = (state << _WIDTH) | order[token]
                        k = bisect_right(cut, key) - 1
                        if k >= 0 and reach[k] > key:
                            continue
                    last[j + 1], step[j + 1] = token, j + 1 - i
        out, i = [], n
        while i:
            out.append(last[i])
            i -= step[i]
        return np.array(out[::-1], np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.encode(data, offsets)

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the arcs emit, and the number of bytes before each row edge."""
        sizes = self.t["label_size"][ids]
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        return ragged(self.t["label"], self.label_first[ids], sizes), before[edges]

    def decimals(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, a comma after each, and the number of bytes before each row edge."""
        sizes = self.decimal_size[ids]
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        return ragged(self.decimal, self.decimal_first[ids], sizes), before[edges]


_AUTOMATA: dict[str, Automaton] = kept()


def automaton(shared) -> Automaton:
    """This worker's automaton of a broadcast (key, tables)."""
    key, tables = shared.value
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(tables)
    return _AUTOMATA[key]


def broadcast_tables(spark: SparkSession, path: str):
    """Compiles the vocabulary file at path on the driver and broadcasts the tables, whose size the vocabulary bounds."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), compile_automaton(Vocabulary.from_json(text))))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row, by the automaton of the vocabulary file."""
    spark = docs.sparkSession
    ship(spark)
    shared = broadcast_tables(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, edges in slices(data, offsets):
                ids, before = machine.encode(part, edges)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def encode_and_verify(docs: DataFrame, path: str, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The kept columns, and n_tokens, ids array<int> and decoded, the text that the arcs of these ids emit."""
    spark = docs.sparkSession
    ship(spark)
    shared = broadcast_tables(spark, path)
    names = [*(f"c{i}" for i in range(len(keep))), "n_tokens", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b, part, edges in slices(data, offsets):
                ids, before = machine.encode(part, edges)
                raw, at = machine.decode(ids, before)
                raw = raw.tobytes()
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                own = [pa.array(np.diff(before), pa.int64()), pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), *own], names=names)

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    inner = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    return inner.mapInArrow(run, f"{kinds}, n_tokens bigint, ids array<int>, decoded string").toDF(*keep, "n_tokens", "ids", "decoded")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids, by emitting arc labels; bytes that are no UTF-8 become U+FFFD; a null list is empty."""
    spark = encoded.sparkSession
    ship(spark)
    shared = broadcast_tables(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                ids = np.array(ids or [], np.int64)
                texts.append(machine.decode(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes and digests in one pass, so that ids never leave the worker."""
    spark = docs.sparkSession
    ship(spark)
    shared = broadcast_tables(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, edges in slices(data, offsets):
                ids, before = machine.encode(part, edges)
                text, text_edges = machine.decode(ids, before)
                text = text.tobytes()
                try:
                    text.decode()
                    whole = True
                except UnicodeDecodeError:
                    whole = False
                decimals, decimal_edges = machine.decimals(ids, before)
                decimals = decimals.tobytes()
                joined, decoded = [], []
                for i in range(b - a):
                    joined.append(hashlib.sha256(decimals[decimal_edges[i] : max(decimal_edges[i], decimal_edges[i + 1] - 1)]).hexdigest())
                    own = text[text_edges[i] : text_edges[i + 1]]
                    decoded.append(hashlib.sha256(own if whole else own.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(before), pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
