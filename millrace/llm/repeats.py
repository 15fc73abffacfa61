"""Operator 8: removal of passages that occur elsewhere, by suffix sorting.

Every byte covered by a SPAN-byte string that also starts anywhere else, in the same text or another, is removed. Not all
suffixes are sorted: each SPAN-byte window names as its anchor the KGRAM-byte string within it with the least hash, so that
equal windows name anchors at equal places, and the windows that share an anchor make one strip of text. Strips whose anchors
occur once hold no repeated window and drop out with one exchange of hashes. Equal strips are repeated as a whole. The
others that share an anchor are fetched, and deep-shallow sorting orders what follows the anchor and, backwards, what precedes
it; common prefixes of neighbours in the two orders give the longest repeat around each anchor.

Tables: texts, one row for each different text under a 128-bit key, in buckets by key, so that fetching strips and cutting
passages move requests and spans but not texts again. Copies beyond the first of a text never enter the sort: a text that
occurs twice, if it has a window at all, is removed whole.

Equal strips of one anchor are one string to the sort: they are told by 128 bits, of anchor and strip, and their repeat is settled by
that. The shallow phase is a three-way multikey quicksort on keys of seven bytes, all runs in step.

Defined results: a null text counts as empty; a very long text is a slice of its own; repeated rows get equal results; matches never cross documents; an empty table gives
no rows; other columns are not read. kept text is cut bytewise, so that a cut may split a character.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import byte_codes, discard, fresh, materialise, mix, powers, prefix_hash, ragged, scratch, ship, slices, span_hash, text_buffer
from .suffix_sort import deep_shallow_sort

SPAN, KGRAM = 200, 32
#: Members of a group, at most, that are compared in pairs; larger ones go offset by offset.
PAIRS = 48
#: Strips of an anchor, at most, that one task sorts; an anchor with more is settled window by window, by an aggregation that starts on every task.
MOST_GROUP = 20_000
PLAIN, REPEATED, PASSING = 0, 1, 2  # of a strip: nothing known, an equal one is elsewhere, the same and not to be compared


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, kgram: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Strips of all rows: row, first window start in the buffer, number of starts, place of the anchor."""
    n, width = len(data), span - kgram + 1
    if n < span:
        return (np.zeros(0, np.int64),) * 4
    prefix = prefix_hash(byte_codes(data))
    hashes = mix((prefix[kgram:] - prefix[:-kgram]) * powers(n)[1][: n - kgram + 1])
    low = max(24, int(n).bit_length())
    key = (hashes >> np.uint64(low) << np.uint64(low)) | np.arange(len(hashes), dtype=np.uint64)
    m = len(key)
    blocks = -(-m // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:m] = key
    ahead = np.minimum.accumulate(grid.reshape(blocks, width), axis=1).ravel()
    behind = np.minimum.accumulate(grid.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - width + 1  # windows
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    place = (least & np.uint64((1 << low) - 1)).astype(np.int64)
    valid = np.zeros(count + 1, np.int64)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= span)
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - span + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = np.empty(count, bool)
    new[:1] = True
    new[1:] = place[1:] != place[:-1]
    new[1:] |= valid[1:] & ~valid[:-1]
    new[offsets[:-1][long]] = True
    starts = np.flatnonzero(valid & new)
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return row, starts, ends - starts, place[starts]


def _pack(start: np.ndarray, count: np.ndarray, before: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return (start << 22) | (count << 12) | (before << 2) | kind


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start of the first window, number of windows, bytes before the anchor, kind."""
    return p >> 22, (p >> 12) & 0x3FF, (p >> 2) & 0x3FF, p & 3


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u1, u2, text) to (h, strip, u1, u2, p): hashes of anchor and strip. Of equal strips in a slice all but one are only passing."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        u1, u2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for a, b, part, edges in slices(data, offsets):
            row, start, count, place = anchors(part, edges)
            if not len(row):
                continue
            prefix = prefix_hash(byte_codes(part))
            h = span_hash(prefix, place, place + KGRAM).view(np.int64)
            strip = span_hash(prefix, start, start + count + SPAN - 1) + mix((place - start).astype(np.uint64))
            strip = strip.view(np.int64)
            order = np.lexsort((strip, h))
            same = (strip[order[1:]] == strip[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
            kind = np.zeros(len(h), np.int64)
            kind[order[:-1][same]] = REPEATED
            kind[order[1:][same]] = PASSING
            p = _pack(start - edges[row], count, place - start, kind)
            k1, k2 = u1[a:b][row], u2[a:b][row]
            h = np.where(kind == PASSING, mix((k1 ^ p).view(np.uint64)).view(np.int64), h)  # these needn't meet
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, strip, k1, k2, p)], names=["h", "strip", "u1", "u2", "p"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, strip): drops what occurs once, tells repeated strips, and asks for one of each strip of an anchor that has several."""
    held, before = None, None  # rows of the last run of (h, strip), and the h before it

    def settle(rows: list[np.ndarray], previous: int | None, last: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray] | None, int | None]:
        h, strip, u1, u2, p = rows
        n = len(h)
        passing = (p & 3) == PASSING
        first = np.append(True, (h[1:] != h[:-1]) | (strip[1:] != strip[:-1]) | passing[1:] | passing[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, n))
        run = np.cumsum(first) - 1
        repeated = (size[run] > 1) | ((p & 3) != PLAIN)
        hot = np.maximum.reduceat(((p & 3) == REPEATED).astype(np.int8), begin).astype(bool)
        repeated |= hot[run]
        head = h[begin]
        other = np.append(previous is not None and head[0] == previous, head[1:] == head[:-1])
        other[:-1] |= head[1:] == head[:-1]
        ask = first & other[run] & ~passing
        upto = n if last else int(begin[-1])
        emit = np.flatnonzero((repeated | ask)[:upto])
        kind = repeated[emit] + 2 * ask[emit]
        out = pa.RecordBatch.from_arrays([*(pa.array(x[emit]) for x in (h, u1, u2, p)), pa.array(kind.astype(np.int32))], names=["h", "u1", "u2", "p", "kind"]) if len(emit) else None
        if last:
            return out, None, None
        rest = [x[upto:] for x in rows]
        if len(rest[0]) > 2:  # the third and later rows of a run are repeated whatever follows
            extra = pa.RecordBatch.from_arrays([*(pa.array(x[2:]) for x in (rest[0], rest[2], rest[3], rest[4])), pa.array(np.ones(len(rest[0]) - 2, np.int32))], names=["h", "u1", "u2", "p", "kind"])
            rest = [x[:2] for x in rest]
            out = extra if out is None else pa.concat_batches([out, extra])
        return out, rest, (int(h[upto - 1]) if upto else previous)

    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if len(rows[0]):
            out, held, before = settle(rows, before, False)
            if out is not None:
                yield out
    if held is not None and len(held[0]):
        out, _, _ = settle(held, before, True)
        if out is not None:
            yield out


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u1, u2, text, asked: list of (h, p, wide)) to strips (h, u1, u2, p, wide, strip text)."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        asked = batch.column(3)
        flat = asked.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths().fill_null(0)))
        h, p, wide = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        start, count, _, _ = _unpack(p)
        length = count + SPAN - 1
        u1, u2 = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
        for a in range(0, len(h), 8192):
            of = slice(a, a + 8192)
            body = ragged(data, offsets[row[of]] + start[of], length[of])
            edges = np.zeros(len(length[of]) + 1, np.int32)
            np.cumsum(length[of], out=edges[1:])
            texts = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(body))])
            yield pa.RecordBatch.from_arrays([pa.array(h[of]), pa.array(u1[of]), pa.array(u2[of]), pa.array(p[of]), pa.array(wide[of].astype(bool)), texts], names=["h", "u1", "u2", "p", "wide", "strip"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, u1, u2, p, strip) to its windows (h, before, w1, w2, u1, u2, place): bytes before the anchor and 128 bits of the window."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            rows = batch.slice(a, 2048)
            h, u1, u2, p = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            data, offsets = text_buffer(rows.column(4))
            start, count, before, _ = _unpack(p)
            row = np.repeat(np.arange(len(p)), count)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[row] + shift
            hashes = [span_hash(prefix_hash(byte_codes(x)), at, at + SPAN).view(np.int64) for x in (data, data ^ np.uint8(0x5A))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[row], before[row] - shift, *hashes, u1[row], u2[row], (start + before)[row])], names=["h", "before", "w1", "w2", "u1", "u2", "place"])


def repeats_around_anchors(data: np.ndarray, offsets: np.ndarray, before: np.ndarray, group: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Of strips, in ascending groups that share their anchors: bytes before and after the anchor's start that repeated windows cover; (0, 0) if there are none."""
    n = len(before)
    follow, shared_after = deep_shallow_sort(data, offsets[:-1] + before, np.diff(offsets) - before, group)
    mirror = data[::-1]
    precede, shared_before = deep_shallow_sort(mirror, len(data) - offsets[:-1] - before, before, group)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    two = begin[size == 2]  # one pair: its common prefixes are the neighbours'
    good = shared_after[two] + shared_before[two] >= span
    for k in (0, 1):
        left[two[good] + k], right[two[good] + k] = shared_before[two[good]], shared_after[two[good]]
    for at, g in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        if g <= PAIRS:
            pair = []
            for order, shared in ((precede, shared_before), (follow, shared_after)):
                near = np.zeros((g, g), np.int64)
                own = order[at : at + g] - at
                for i in range(g - 1):
                    near[own[i], own[i + 1 :]] = near[own[i + 1 :], own[i]] = np.minimum.accumulate(shared[at + i : at + g - 1])
                pair.append(near)
            enough = pair[0] + pair[1] >= span
            left[at : at + g], right[at : at + g] = np.where(enough, pair[0], 0).max(axis=1), np.where(enough, pair[1], 0).max(axis=1)
        else:
            back, ahead = precede[at : at + g] - at, follow[at : at + g] - at
            for o in range(int(before[at : at + g].max()) + 1):
                one, other = np.empty(g, np.int64), np.empty(g, np.int64)
                one[back] = np.cumsum(np.append(0, shared_before[at : at + g - 1] < o))
                other[ahead] = np.cumsum(np.append(0, shared_after[at : at + g - 1] < span - o))
                _, back_to, times = np.unique(one * g + other, return_inverse=True, return_counts=True)
                hit = at + np.flatnonzero(times[back_to] > 1)
                hit = hit[(before[hit] >= o) & (offsets[hit + 1] - offsets[hit] - before[hit] >= span - o)]
                left[hit] = o  # offsets ascend: the last is the largest
                right[hit] = np.maximum(right[hit], span - o)
    return left, right


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strips sorted by h to repeated spans (u1, u2, first, end)."""
    held: pa.RecordBatch | None = None

    def work(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        h, u1, u2, p = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        data, offsets = text_buffer(rows.column(4))
        start, _, before, _ = _unpack(p)
        group = np.cumsum(np.append(0, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        left, right = repeats_around_anchors(data, offsets, before, group)
        of = np.flatnonzero(left + right)
        place = start[of] + before[of]
        return pa.RecordBatch.from_arrays([pa.array(u1[of]), pa.array(u2[of]), pa.array(place - left[of]), pa.array(place + right[of])], names=["u1", "u2", "first", "end"]) if len(of) else None

    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        h = rows.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(h, h[-1], "left")) if len(h) else 0
        held = rows.slice(cut)
        if cut and (out := work(rows.slice(0, cut))) is not None:
            yield out
    if held is not None and held.num_rows and (out := work(held)) is not None:
        yield out


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the spans [first, end) cover; spans that touch make one."""
    by = np.argsort(first, kind="stable")
    first, end = first[by], np.maximum.accumulate(end[by])
    new = np.append(True, first[1:] > end[:-1]) if len(first) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return first[at], end[np.append(at[1:], len(first)) - 1] if len(first) else end


def texts_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(u1, u2, text, copies): a row for each different text, in buckets by its key, in the shared folder."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(*text_key("text"), "text")
    distinct = own.groupBy("u1", "u2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"millrace_texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "texts")
    distinct.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, "u1", "u2").saveAsTable(name)
    out = spark.table(name)
    out.millrace_table, out.millrace_path = name, path
    return out


def drop(texts: DataFrame) -> None:
    """Takes a texts table out of the catalog and deletes it, once nothing reads it any more."""
    texts.sparkSession.sql(f"DROP TABLE IF EXISTS {texts.millrace_table}")
    discard(texts)


def text_key(text: str) -> tuple:
    """128 bits in two columns."""
    return F.xxhash64(F.lit(1), text).alias("u1"), F.xxhash64(F.lit(2), text).alias("u2")


def spans(docs: DataFrame, text_col: str = "text", most_group: int = MOST_GROUP) -> tuple[DataFrame, DataFrame]:
    """The texts table, and the repeated spans (u1, u2, first, end) of texts that occur once; spans may overlap."""
    spark = docs.sparkSession
    ship(spark)
    texts = texts_table(docs, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strips = texts.select("u1", "u2", "text").mapInArrow(fresh(_strips), "h bigint, strip bigint, u1 bigint, u2 bigint, p bigint")
    met = strips.repartition(n, "h").sortWithinPartitions("h", "strip").mapInArrow(fresh(_meet), "h bigint, u1 bigint, u2 bigint, p bigint, kind int")
    met = materialise(spark, met, "strips")
    whole = met.filter("(kind & 1) = 1").select("u1", "u2", F.expr("p >> 22").alias("first"), F.expr(f"(p >> 22) + ((p >> 12) & 1023) + {SPAN - 1}").alias("end"))
    wanted = met.filter("kind >= 2").select("u1", "u2", "h", "p")
    large = materialise(spark, wanted.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > most_group).select("h", F.lit(True).alias("wide")), "large")
    some = not large.isEmpty()
    marked = wanted.join(large, "h", "left").fillna(False, ["wide"]) if some else wanted.withColumn("wide", F.lit(False))
    asked = marked.groupBy("u1", "u2").agg(F.collect_list(F.struct("h", "p", "wide")).alias("asked"))
    fetched = texts.select("u1", "u2", "text").join(asked, ["u1", "u2"]).select("u1", "u2", "text", "asked").mapInArrow(fresh(_fetch), "h bigint, u1 bigint, u2 bigint, p bigint, wide boolean, strip binary")
    fetched = materialise(spark, fetched, "fetched") if some else fetched
    narrow = fetched.filter("not wide") if some else fetched
    found = narrow.select("h", "u1", "u2", "p", "strip").repartition(n, "h").sortWithinPartitions("h").mapInArrow(fresh(_sort), "u1 bigint, u2 bigint, first bigint, end bigint")
    if some:
        windows = fetched.filter("wide").select("h", "u1", "u2", "p", "strip").mapInArrow(fresh(_windows), "h bigint, before bigint, w1 bigint, w2 bigint, u1 bigint, u2 bigint, place bigint")
        same = ["h", "before", "w1", "w2"]
        twice = windows.groupBy(*same).agg(F.count("*").alias("times")).filter("times > 1").drop("times")
        around = windows.join(twice, same).groupBy("u1", "u2", "place").agg(F.max("before").alias("left"), F.min("before").alias("right"))
        found = found.unionByName(around.select("u1", "u2", (F.col("place") - F.col("left")).alias("first"), (F.col("place") - F.col("right") + SPAN).alias("end")))
    return texts, materialise(spark, whole.unionByName(found), "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u1, u2, text, copies, cuts: list of (first, end)) to what is kept of each text, and digests."""
    for batch in batches:
        out = []
        for u1, u2, text, copies, cuts in zip(*(c.to_pylist() if i != 4 else c for i, c in enumerate(batch.columns)), strict=True):
            raw = text.encode()
            if copies > 1 and len(raw) >= SPAN:
                first, end = [0], [len(raw)]
            elif cuts.is_valid:
                pairs = cuts.values
                first, end = (x.tolist() for x in merged(*(pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))))
            else:
                first, end = [], []
            kept = b"".join(raw[a:b] for a, b in zip([0, *end], [*first, len(raw)], strict=True))
            out.append((u1, u2, len(raw), len(raw) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept))
        names = ["u1", "u2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(7)], names=names)


def cut_texts(docs: DataFrame, text_col: str = "text", most_group: int = MOST_GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of every different text (u1, u2, n_bytes, n_removed, n_spans, kept_sha256, kept binary); and the tables that it is read from: texts, spans."""
    texts, found = spans(docs, text_col, most_group)
    cuts = found.groupBy("u1", "u2").agg(F.collect_set(F.struct("first", "end")).alias("cuts"))
    done = texts.join(cuts, ["u1", "u2"], "left").select("u1", "u2", "text", "copies", "cuts").mapInArrow(fresh(_cut), "u1 bigint, u2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return done, texts, found


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of docs, their texts without repeated passages; a character that a cut splits goes as a whole, and a null text becomes empty."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["_u1", "_u2", "_text"])

    cut, texts, found = cut_texts(docs, text_col)
    done = materialise(docs.sparkSession, cut.filter("n_removed > 0").select("u1", "u2", "kept").mapInArrow(fresh(whole), "_u1 bigint, _u2 bigint, _text string"), "changed")
    drop(texts)
    discard(found)
    u1, u2 = text_key("_own")
    rows = docs.withColumn("_own", F.coalesce(F.col(text_col), F.lit(""))).withColumns({"_k1": u1, "_k2": u2})
    out = rows.join(done, (F.col("_k1") == F.col("_u1")) & (F.col("_k2") == F.col("_u2")), "left")
    return out.select(*(F.coalesce("_text", "_own").alias(c) if c == text_col else F.col(c) for c in docs.columns))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_group: int = MOST_GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    cut, texts, found = cut_texts(docs, text_col, most_group)
    done = materialise(docs.sparkSession, cut.drop("kept"), "cut")
    drop(texts)
    discard(found)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("own")).select(id_col, *text_key("own"))
    return rows.join(done, ["u1", "u2"]).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")
