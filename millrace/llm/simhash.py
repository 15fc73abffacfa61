"""Operator 6: SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where more than half of the shingles' XXH64 hashes have it. Two of them that differ in at most four
bits differ in at most two bits of one half; then some value lies within one bit of both halves. So every distinct
fingerprint is put into the tables of both halves under its half and the 32 values one bit away, all that meet under a key
are fetched and their complete distances verified, and the links found join into components.

A bucket of a key gives a star for each of its parts, not its pairs. The members of a bucket beyond MOST_BUCKET meet in tables of one
segment instead, the whole fingerprint: each goes under all 2081 values at most two bits away. Any two within four bits meet under
one of them, and all that meet are within four bits, so that a star for each value is exact too; no task holds a whole bucket.

Defined results: a null text has no words, and like an empty one has fingerprint zero, which links like any other; texts with
fewer words than a shingle are one shingle; a very long text is a slice of its own; copies share their fingerprint, and so their component; an empty table gives no
rows; a null doc_id takes part but is the smallest id of a component only if all are null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import materialise, ragged, ship, slices, text_buffer, word_spans
from .components import components, join_one, with_least

BITS_APART = 4
#: Members of a bucket, at most, that one task compares among themselves.
MOST_BUCKET = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The primes of XXH64: fixed values.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of a buffer at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    two = padded[:-1].astype(np.uint16) | (padded[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    seed = np.uint64(seed)
    h = np.full(len(starts), seed + _P5, np.uint64)
    at, left = starts.copy(), lengths.copy()
    with np.errstate(over="ignore"):
        if len(long := np.flatnonzero(lengths >= 32)):
            v = [np.full(len(long), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            live = np.arange(len(long))
            while len(live):
                of = long[live]
                for k in range(4):
                    v[k][live] = _round(v[k][live], eight[at[of] + 8 * k])
                at[of] += 32
                left[of] -= 32
                live = live[left[of] >= 32]
            x = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for k in range(4):
                x = (x ^ _round(np.zeros_like(x), v[k])) * _P1 + _P4
            h[long] = x
        h += lengths.astype(np.uint64)
        for _ in range(3):
            if not len(of := np.flatnonzero(left >= 8)):
                break
            h[of] = _turn(h[of] ^ _round(np.zeros(len(of), np.uint64), eight[at[of]]), 27) * _P1 + _P4
            at[of] += 8
            left[of] -= 8
        of = np.flatnonzero(left >= 4)
        h[of] = _turn(h[of] ^ (four[at[of]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[of] += 4
        left[of] -= 4
        for _ in range(3):
            if not len(of := np.flatnonzero(left >= 1)):
                break
            h[of] = _turn(h[of] ^ (padded[at[of]].astype(np.uint64) * _P5), 11) * _P1
            at[of] += 1
            left[of] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of every row, and the number of them before each row edge."""
    data = _LOWER[data]
    starts, ends, edges = word_spans(data, offsets)
    lengths = ends - starts + 1
    joined = np.full(int(lengths.sum()), 0x20, np.uint8)  # every word with one space behind it
    begin = np.cumsum(lengths) - lengths
    body = np.repeat(begin - starts, ends - starts) + ragged(np.arange(len(data)), starts, ends - starts)
    joined[body] = ragged(data, starts, ends - starts)
    words = np.diff(edges)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    before = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=before[1:])
    first = np.repeat(edges[:-1] - before[:-1], count) + np.arange(before[-1])
    last = first + np.repeat(np.minimum(words, size), count) - 1
    return xxh64(joined, begin[first], begin[last] + lengths[last] - 1 - begin[first]), before


def fingerprints_of(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The fingerprint of every row of hashes."""
    n = np.diff(edges)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    step = 1 << 18
    if len(some):
        totals = np.zeros((len(some), 64), np.int64)
        own = np.repeat(np.arange(len(some)), n[some])
        for a in range(0, len(hashes), step):
            part = hashes[a : a + step]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row = own[a : a + step]
            cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            totals[row[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        over = 2 * totals > n[some][:, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, edges in slices(data, offsets):
                fp = fingerprints_of(*shingle_hashes(part, edges, size))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


#: Values XORed to a 32-bit half: none, and each single bit.
_BALL_1 = np.array([0, *(1 << i for i in range(32))], np.uint64)
#: Values XORed to a fingerprint: all with at most two bits.
_BALL_2 = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))], np.uint64)


def stars(members: np.ndarray, most: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket, the (least, member) links of each part that is connected within it."""
    n = len(members)
    if n == 2:
        near = int(np.bitwise_count(members[0] ^ members[1])) <= most
        return (members[:1], members[1:]) if near else (members[:0], members[:0])
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= most
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i], front = i, np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            root[front] = i
    other = np.flatnonzero(root != np.arange(n))
    return members[root[other]], members[other]


def links(distinct: DataFrame, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) whose components are those of all links of at most four bits."""
    spark = distinct.sparkSession
    ship(spark)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                fp = batch.column(0)[a : a + 4096].to_numpy(zero_copy_only=False).view(np.uint64)
                halves = [fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)]
                keys = [((h[:, None] ^ _BALL_1) << np.uint64(1)) | np.uint64(k) for k, h in enumerate(halves)]
                keys = np.concatenate(keys, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. Links within buckets; for members of a bucket that is too large, the member and null."""
        held_key, held, hot = None, np.zeros(0, np.uint64), False

        def close() -> list[tuple[np.ndarray, np.ndarray | None]]:
            if hot:
                return [(held, None)] if len(held) else []
            return [stars(held)] if len(held) > 1 else []

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            out = []
            single = np.diff(cut) == 1
            single[[0, -1]] = False  # a bucket at the edge of the batch may go on
            for i in np.flatnonzero(~single).tolist():
                own = fp[cut[i] : cut[i + 1]]
                if key[cut[i]] == held_key:
                    held = np.concatenate([held, own])
                else:
                    out += close()
                    held_key, held, hot = key[cut[i]], own, False
                if len(held) > most_bucket:
                    out.append((held, None))
                    held, hot = held[:0], True
            if found := [x for x in out if len(x[0])]:
                u = np.concatenate([a for a, _ in found]).view(np.int64)
                v = np.concatenate([a if b is None else b for a, b in found]).view(np.int64)
                none = np.concatenate([np.full(len(a), b is None) for a, b in found])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=none)], names=["u", "v"])
        for u, v in close():
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array((u if v is None else v).view(np.int64), mask=np.full(len(u), v is None))], names=["u", "v"])

    keyed = distinct.select("fp").mapInArrow(expand, "key bigint, fp bigint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialise(spark, keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(meet, "u bigint, v bigint"), "links")
    hot = met.filter("v is null").select("u").distinct()

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                fp = batch.column(0)[a : a + 256].to_numpy(zero_copy_only=False).view(np.uint64)
                centre = (fp[:, None] ^ _BALL_2).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(centre.view(np.int64)), pa.array(np.repeat(fp, len(_BALL_2)).view(np.int64))], names=["centre", "fp"])

    around = hot.mapInArrow(surround, "centre bigint, fp bigint")
    least = around.groupBy("centre").agg(F.min("fp").alias("u"), F.max("fp").alias("other")).filter("u <> other").select("centre", "u")
    wide = around.join(least, "centre").filter("u <> fp").select("u", F.col("fp").alias("v")).distinct()
    return met.filter("v is not null").distinct().unionByName(wide)


def near_duplicates(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text", most_bucket: int = MOST_BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 hex digits, and the smallest id reachable over links of at most four bits."""
    spark = docs.sparkSession
    own = materialise(spark, fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = materialise(spark, own.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("_times")), "distinct")
    node = components(links(distinct, most_bucket))
    rooted = distinct.join(node.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "_times", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(spark, rooted, "rooted")
    named = with_least(rooted, "root", "first", rooted.count()).select("fp", F.col("least").alias("component_id"), "_times")
    return join_one(own, named, "fp", own.count()).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
