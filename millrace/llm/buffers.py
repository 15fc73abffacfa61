"""Vectorised helpers over Arrow text buffers that the text operators share.

All of them work on one byte buffer holding many documents back to back, with an offsets array,
so that cost per document is a few numpy calls and not a Python loop over words.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by the numpy kernels; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_KEPT: list[dict] = []
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: The six ASCII white-space bytes that end a word in the word rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ship(spark) -> None:
    """Let Python workers of a local session import this package; a cluster gets it by --py-files or an install. Bounds Arrow batches for the rest of the session: records and bytes a batch are set, whatever they were."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:  # bounds a batch of very long texts
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    except Exception as error:  # pragma: no cover - an older Spark that refuses unknown settings
        if "CONFIG" not in str(error).upper():
            raise


def scratch_root(spark) -> str:
    """The folder of this application's tables in the shared folder that the cluster names; a temporary one only on a local master where none is set."""
    import tempfile

    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/millrace-{context.applicationId}"


def scratch(spark, name: str) -> str:
    """A new folder for a table of one run."""
    import uuid

    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark, path: str) -> None:
    """Deletes a folder, by the file system that its path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark) -> None:
    """Deletes all intermediate tables of this application; frames that still read one are of no use after it."""
    remove(spark, scratch_root(spark))


def materialise(spark, df, name: str):
    """Writes df to the shared folder and reads it back: a cut of lineage that survives lost executors."""
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    return out


def discard(*frames) -> None:
    """Deletes tables that materialise wrote, once nothing reads them any more."""
    for df in frames:
        remove(df.sparkSession, df.millrace_path)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and int64 offsets of its rows in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes: first row, end row, their bytes, their offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    release()


def release() -> None:
    """Gives freed memory back to the system: a worker lives through many tasks, and its heap would stay at its largest."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def kept() -> dict:
    """A new table for what a worker keeps from task to task; forget() empties it."""
    _KEPT.append({})
    return _KEPT[-1]


def forget() -> None:
    """Empties all that tasks have left in this worker."""
    global _POWERS, _INVERSES
    for table in _KEPT:
        table.clear()
    _POWERS, _INVERSES = np.ones(1, np.uint64), np.ones(1, np.uint64)
    release()


def fresh(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, begun without what other operators' tasks have left in its worker, and giving back its own memory at the end: an executor has more workers than tasks, and idle ones keep theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from kernel(batches)
        release()

    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n + 1:
        out = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        if n > 4 * SLICE_BYTES:  # a rare huge text: not kept
            return out[0], out[1]
        _POWERS, _INVERSES = out
    return _POWERS, _INVERSES


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start + length] of each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    before = np.cumsum(lengths) - lengths
    kind = np.int32 if max(len(values), total) < 2**31 - 1 else np.int64
    index = np.repeat((starts - before).astype(kind), lengths)
    index += np.arange(total, dtype=kind)
    return values[index]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each row edge the number of words before it."""
    inside = ~SPACE[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edges[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edges[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(counts_before: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums within rows, of running totals with a leading zero."""
    at = counts_before[offsets]
    return at[1:] - at[:-1]


def running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out
