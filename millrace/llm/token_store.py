"""Operator 5: token ids in files of fixed-width packed bits.

Every id takes the fewest bits that hold the vocabulary. A file holds blocks of BLOCK ids, each packed by itself into 64-bit
words, then the tables: byte offsets of blocks, document ids (and which are null) and the place of each document's first id.
Any range of ids is read by seeking to its blocks and unpacking them with a few numpy shifts.

    magic | blocks ... | block offsets u64 | doc ids i64 | null flags u8 | doc starts u64 | footer: 8 x u64 | magic

Documents lie in ascending order of their ids across the files of a store (null ids first), those of equal ids in the order of a hash
of their texts, so that a store is the same however often it is written, and an id that many rows share fills several files.
Each task writes one file under a name of its own, and the manifest, a Parquet table that Spark commits, names the files of
the attempts that count; what a lost attempt left behind is never read.

Defined results: a null text counts as empty, its only id is the end id; a very long text is a slice of its own; rows that repeat another
follow each other; other columns are not read; an empty table gives a store without files.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import kept, scratch, ship, slices, text_buffer
from .pieces import PieceTable

MAGIC = b"MRTOKEN1"
BLOCK = 1 << 16
#: Ids that a reader unpacks at once.
READ_IDS = 1 << 21


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words that hold the ids one after another, lowest bits first."""
    group = 64 // math.gcd(bits, 64)
    rows = -(-len(ids) // group)
    own = np.zeros(rows * group, np.uint64)
    own[: len(ids)] = ids
    own = own.reshape(rows, group)
    out = np.zeros((rows, bits * group // 64), "<u8")
    for j in range(group):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= own[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= own[:, j] >> np.uint64(64 - shift)
    return out.ravel()


def unpack(words: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed words."""
    group = 64 // math.gcd(bits, 64)
    words = words.reshape(-1, bits * group // 64)
    out = np.empty((len(words), group), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(group):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.ravel()[:n]


class Writer:
    """Writes one file, block by block; only the tables and one block stay in memory."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.rest = np.zeros(0, np.uint32)
        self.offsets, self.starts, self.docs, self.nulls = [], [], [], []
        self.at, self.n = sink.write(MAGIC), 0

    def add(self, doc_ids: list, ids: np.ndarray, edges: np.ndarray) -> None:
        self.docs += [x or 0 for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.starts.append(self.n + edges[:-1])
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            self._put(ids[k : k + self.block])
        self.rest = ids[whole:]

    def _put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.sink.write(pack(ids, self.bits).tobytes())

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        tables = self.at
        starts = np.concatenate([*self.starts, [self.n]])
        for table in (np.array(self.offsets, "<u8"), np.array(self.docs, "<i8"), np.array(self.nulls, "u1"), starts.astype("<u8")):
            self.sink.write(table.tobytes())
        self.sink.write(np.array([self.bits, self.block, self.n, len(self.docs), len(self.offsets), tables, 0, 0], "<u8").tobytes() + MAGIC)


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source, end = source, source.size()
        foot = self._read(end - 72, 72)
        if foot[64:] != MAGIC:
            raise ValueError("not a token file, or one that was cut short")
        self.bits, self.block, self.n, self.n_docs, blocks, at, _, _ = np.frombuffer(foot[:64], "<u8").tolist()
        self.end = at
        self.offsets = np.frombuffer(self._read(at, blocks * 8), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self._read(at := at + blocks * 8, self.n_docs * 8), "<i8")
        self.nulls = np.frombuffer(self._read(at := at + self.n_docs * 8, self.n_docs), "u1").astype(bool)
        self.starts = np.frombuffer(self._read(at + self.n_docs, self.n_docs * 8 + 8), "<u8").astype(np.int64)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids at [first, end), from their blocks alone."""
        if first >= end:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, -(-end // self.block)
        stop = int(self.offsets[high]) if high < len(self.offsets) else self.end
        raw, base = self._read(int(self.offsets[low]), stop - int(self.offsets[low])), int(self.offsets[low])
        out = []
        for k in range(low, high):
            a, b = int(self.offsets[k]) - base, (int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.end) - base
            out.append(unpack(np.frombuffer(raw[a:b], "<u8"), min(self.block, self.n - k * self.block), self.bits))
        return np.concatenate(out)[first - low * self.block : end - low * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def runs(self, most: int = READ_IDS) -> Iterator[tuple[int, int, np.ndarray]]:
        """All documents in order, in runs of about most ids: first, end, ids."""
        first = 0
        while first < self.n_docs:
            end = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + most, "right")) - 1)
            yield first, min(end, self.n_docs), self.ids(int(self.starts[first]), int(self.starts[min(end, self.n_docs)]))
            first = end


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class LibraryEncoder:
    """The tokenizers library over distinct pieces: it gives the same ids for a piece alone as within its text."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        d = json.loads(text)
        if (d["pre_tokenizer"] or {}).get("type") != "ByteLevel" or d["pre_tokenizer"]["add_prefix_space"] or d["normalizer"] or len(d["added_tokens"]) > 1:
            raise ValueError("a byte-level BPE without normalizer, prefix space or several added tokens is asked for")
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = PieceTable(self.run, next(((x["content"].encode(), x["id"]) for x in d["added_tokens"]), None), times=3)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = [x.ids for x in self.tokenizer.encode_batch_fast([raw[a : a + n].decode() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum())), sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.encode(data, offsets)


_ENCODERS: dict[str, LibraryEncoder] = kept()


def library_encoder(text: str) -> LibraryEncoder:
    if text not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[text] = LibraryEncoder(text)
    return _ENCODERS[text]


def with_end(ids: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after every row's."""
    n = len(edges) - 1
    return np.insert(ids, edges[1:], end_id), edges + np.arange(n + 1)


def write_store(docs: DataFrame, path: str, uri: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encodes every text with the tokenizer file at path and writes the store under uri; returns its manifest (part, file, n_docs, n_ids, base)."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))
    own = own.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "tie").sortWithinPartitions("id", "tie", "text")
    open_uri(uri)[0].create_dir(open_uri(uri)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = library_encoder(shared.value)
        bits = max(1, (max(encoder.size - 1, end_id or 0)).bit_length())
        writer, name, sink = None, f"{uuid.uuid4().hex}.tok", None
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, edges in slices(data, offsets):
                ids, before = encoder.encode(part, edges)
                if end_id is not None:
                    ids, before = with_end(ids, before, end_id)
                if writer is None:
                    system, root = open_uri(uri)
                    sink = system.open_output_stream(f"{root}/{name}")
                    writer = Writer(sink, bits)
                writer.add(batch.column(0)[a:b].to_pylist(), ids, before)
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.n], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    manifest = f"{uri}/manifest"
    own.mapInArrow(run, "part int, file string, n_docs bigint, n_ids bigint").write.mode("overwrite").parquet(manifest)
    rows = sorted(map(tuple, spark.read.parquet(manifest).collect()))  # one row a file
    base, out = 0, []
    for part, file, n_docs, n_ids in rows:
        out.append((part, f"{uri}/{file}", n_docs, n_ids, base))
        base += n_ids
    return spark.createDataFrame(out, "part int, file string, n_docs bigint, n_ids bigint, base bigint")


def read_store(manifest: DataFrame, digest: Callable[[int, Reader], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Reads every file of a manifest in a task: digest(base, reader) yields what is wanted of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = open_uri(uri)
                with system.open_input_file(path) as source:
                    yield from digest(base, Reader(source))

    spark = manifest.sparkSession
    ship(spark)
    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "part").select("file", "base").mapInArrow(run, schema)


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of a store."""

    def digest(base: int, reader: Reader) -> Iterator[pa.RecordBatch]:
        for a, b, ids in reader.runs():
            edges = reader.starts[a : b + 1] - reader.starts[a]
            yield pa.RecordBatch.from_arrays([pa.array(reader.docs[a:b], mask=reader.nulls[a:b]), pa.array(base + reader.starts[a:b]), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "start", "ids"])

    return read_store(manifest, digest, "doc_id bigint, start bigint, ids array<int>")


def store_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from a store written for it."""
    manifest = write_store(docs, path, scratch(docs.sparkSession, "tokens"))

    def digest(base: int, reader: Reader) -> Iterator[pa.RecordBatch]:
        for a, b, ids in reader.runs():
            raw = ids.astype("<u4").tobytes()
            edges = (reader.starts[a : b + 1] - reader.starts[a]).tolist()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(reader.docs[a:b], mask=reader.nulls[a:b]), pa.array(base + reader.starts[a:b]), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_store(manifest, digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


