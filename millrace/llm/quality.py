"""Operator 3: quality rules, with a linear-chain CRF that labels lines.

Base rules count words, symbols, repeated lines and repeated 8-word windows of every text. Beside them, every line that has a
word gets binned features; a linear-chain conditional random field with the labels content and boilerplate, trained here on
a bounded sample of labelled documents, labels each text's lines by Viterbi decoding, and the share of words in content lines
decides whether the text is kept.

Training: MOST_TRAINING documents of the labels table, the first by a hash of their id (of rows that share an id, the first by a hash of
their text), and their first MOST_LINES lines; each line takes its document's label. Without labelled documents all weights are
zero and every line counts as content.

Equal lines are told byte by byte. Equal words are told by 64 bits: of a polynomial up to SHORT bytes, of BLAKE2b beyond.

Defined results: a null text has no words, so the base rules reject it; a very long text is handled whole, in a slice of its own;
between labels that score alike content wins; repeated rows get equal results; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import byte_codes, fresh, mix, per_row, prefix_hash, running, ship, slices, span_hash, text_buffer, word_spans

#: Documents, at most, on which the CRF is trained, and lines of each.
MOST_TRAINING, MOST_LINES = 4000, 2000
#: Bytes of words that the span hash tells apart.
SHORT = 64
#: Least share of a text's words in content lines.
LEAST_CONTENT = 0.5
MIN_WORDS, WINDOW, MOST_REPEAT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1

#: Upper edges of the bins of each line feature: fixed values.
BINS = {
    "symbols": [0.0, 0.02, 0.05, 0.1, 0.2],
    "capitals": [0.0, 0.05, 0.15, 0.4, 0.7],
    "same as word before": [0.0, 0.03, 0.1, 0.3, 0.6],
    "copy of a line": [0.5],
    "words": [2, 5, 10, 20, 40],
    "in repeated windows": [0.0, 0.2, 0.5, 0.9],
    "other marks": [0.0, 0.02, 0.05, 0.1, 0.2],
    "digits": [0.0, 0.05, 0.2],
    "ends a sentence": [0.5],
    "letters a word": [2.5, 3.5, 5, 7, 10],
    "distinct words": [0.2, 0.4, 0.6, 0.8],
}
FIRST_BIN = np.cumsum([0, *(len(x) + 1 for x in BINS.values())])

_TABLES = {
    "symbol": np.isin(np.arange(256), list(SYMBOLS)),
    "capital": np.isin(np.arange(256), range(65, 91)),
    "letter": np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]) | (np.arange(256) >= 0xC0),
    "digit": np.isin(np.arange(256), range(48, 58)),
    "mark": np.isin(np.arange(256), list(b"!?;:=_~^\\/@{}[]\"")),
}
_FULL_STOP = np.isin(np.arange(256), list(b".!?\":;)"))


@dataclass
class Measures:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_row: np.ndarray
    line_words: np.ndarray
    line_bins: np.ndarray  # a column for each feature

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MOST_REPEAT * self.n_words)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, whether another equals it, and whether an earlier one does."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] = same
    later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def measure(data: np.ndarray, offsets: np.ndarray) -> Measures:
    """Counts of every row, and features of every line with a word."""
    starts, ends, word_edges = word_spans(data, offsets)
    n_words = np.diff(word_edges)
    row = np.repeat(np.arange(len(n_words)), n_words)
    prefix = prefix_hash(byte_codes(data))
    words = span_hash(prefix, starts, ends)
    raw = data.tobytes()
    for i in np.flatnonzero(ends - starts > SHORT).tolist():  # the span hash is linear in its bytes: long words are told apart by another
        words[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")

    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    lead = (data & 0xC0) != 0x80
    chars = running(inside & lead)

    room = word_edges[1:][row] - np.arange(len(starts)) >= WINDOW if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(room)
    salt = np.arange(1, len(n_words) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    windows = span_hash(prefix_hash(words), at, at + WINDOW) + salt[row[at]]
    twice, _ = repeats(mix(windows))
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    n_repeat = per_row(running(repeated), word_edges)

    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_edges = np.searchsorted(starts, np.append(line_start, len(data)))
    some = np.diff(line_edges) > 0
    line_start, line_end, first_word, end_word = line_start[some], line_end[some], line_edges[:-1][some], line_edges[1:][some]
    line_end = line_end - (data[line_end - 1] == 0x0A)
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    alike, _ = repeats(mix(span_hash(prefix, line_start, line_end) + salt[line_row]))
    copy, seen = np.zeros(len(line_row), bool), set()
    for i in np.flatnonzero(alike).tolist():  # lines of one hash are compared byte by byte
        line = (int(line_row[i]), raw[line_start[i] : line_end[i]])
        copy[i] = line in seen
        seen.add(line)
    n_dup = np.bincount(line_row[copy], minlength=len(n_words))

    line_words = end_word - first_word
    of = {k: running(t[data]) for k, t in _TABLES.items()}
    size = np.maximum(chars[line_end] - chars[line_start], 1)
    share = {k: (v[line_end] - v[line_start]) for k, v in of.items()}
    line_of_word = np.repeat(np.arange(len(line_words)), line_words)
    again = np.zeros(len(starts), bool)
    again[1:] = (words[1:] == words[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    again = running(again)
    repeated = running(repeated)
    _, met = repeats(mix(words + line_of_word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    met = running(~met)
    values = [
        share["symbol"] / size,
        share["capital"] / np.maximum(share["letter"], 1),
        (again[end_word] - again[first_word]) / line_words,
        copy,
        line_words,
        (repeated[end_word] - repeated[first_word]) / line_words,
        share["mark"] / size,
        share["digit"] / size,
        _FULL_STOP[data[ends[end_word - 1] - 1]],
        size / line_words,
        (met[end_word] - met[first_word]) / line_words,
    ]
    bins = np.stack([np.searchsorted(edges, v, "left") for edges, v in zip(BINS.values(), values, strict=True)], axis=1).astype(np.uint8) if len(line_words) else np.zeros((0, len(BINS)), np.uint8)
    return Measures(n_words, per_row(chars, offsets), per_row(of["symbol"], offsets), n_dup, n_repeat, line_row, line_words, bins)


class LineCrf:
    """A linear-chain CRF over binned features, with two labels."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros((FIRST_BIN[-1], 2)) if emission is None else emission
        self.transition = np.zeros((2, 2)) if transition is None else transition

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.emission[bins.astype(np.int64) + FIRST_BIN[:-1]].sum(axis=1) if len(bins) else np.zeros((0, 2))

    @staticmethod
    def steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Sequences, longest first; where each begins; how many are longer than 0, 1, 2, ..."""
        by = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[by]
        longest = int(lengths.max()) if len(lengths) else 0
        return by, first, np.searchsorted(-lengths[by], -np.arange(longest), "left").tolist()

    def viterbi(self, bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of all sequences, which advance in lock step; content wins ties."""
        score = self.scores(bins)
        _, first, longer = self.steps(lengths)
        out, back = np.zeros(len(bins), np.int8), np.zeros((len(bins), 2), np.int8)
        best = np.zeros((len(lengths), 2))
        for t, n in enumerate(longer):
            at = first[:n] + t
            if t == 0:
                best[:n] = score[at]
                continue
            paths = best[:n, :, None] + self.transition
            back[at] = paths.argmax(axis=1)
            best[:n] = paths.max(axis=1) + score[at]
        label = best.argmax(axis=1).astype(np.int8)
        for t in range(len(longer) - 1, -1, -1):
            n = longer[t]
            at = first[:n] + t
            out[at] = label[:n]
            label[:n] = back[at, label[:n]]
        return out

    def fit(self, bins: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.3, ridge: float = 1e-3) -> LineCrf:
        """Maximum likelihood with an L2 penalty, by Adam on the exact gradient from forward and backward sums."""
        if not len(bins):
            return self
        _, first, longer = self.steps(lengths)
        index = bins.astype(np.int64) + FIRST_BIN[:-1]
        flat = index.ravel()
        starts = np.zeros(len(bins), bool)
        starts[np.cumsum(lengths) - lengths] = True
        seen_pairs = np.zeros((2, 2))
        np.add.at(seen_pairs, (labels[:-1][~starts[1:]], labels[1:][~starts[1:]]), 1)
        truth = np.eye(2)[labels]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.emission, self.transition)]
        total = len(bins)
        for step in range(1, rounds + 1):
            score = self.scores(bins)
            forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
            for t, n in enumerate(longer):
                at = first[:n] + t
                forward[at] = score[at] if t == 0 else score[at] + np.logaddexp.reduce(forward[at - 1][:, :, None] + self.transition, axis=1)
            for t in range(len(longer) - 2, -1, -1):
                n = longer[t + 1]
                at = first[:n] + t
                backward[at] = np.logaddexp.reduce(self.transition + (score[at + 1] + backward[at + 1])[:, None, :], axis=2)
            joint = forward + backward
            norm = np.logaddexp(joint[:, 0], joint[:, 1])
            marginal = np.exp(joint - norm[:, None])
            at = np.flatnonzero(~starts)
            pairs = np.exp(forward[at - 1][:, :, None] + self.transition + (score[at] + backward[at])[:, None, :] - norm[at][:, None, None]).sum(axis=0)
            rest = np.repeat(truth - marginal, index.shape[1], axis=0)
            gradient = [np.stack([np.bincount(flat, rest[:, k], len(self.emission)) for k in range(2)], axis=1) / total - ridge * self.emission, (seen_pairs - pairs) / total - ridge * self.transition]
            for p, g, m in zip((self.emission, self.transition), gradient, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> LineCrf:
    """The CRF of a bounded sample of labelled documents."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b, part, edges in slices(data, offsets):
                m = measure(part, edges)
                at = np.searchsorted(m.line_row, np.arange(b - a + 1))
                lines = [m.line_bins[x : min(y, x + MOST_LINES)].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(lines, pa.binary())], names=["doc_id", "quality", "lines"])

    rows = sorted((r.doc_id, r.quality, bytes(r.lines)) for r in sample.mapInArrow(fresh(features), "doc_id bigint, quality int, lines binary").collect() if r.lines)
    if not rows:
        return LineCrf()
    bins = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, len(BINS))
    lengths = np.array([len(r[2]) // len(BINS) for r in rows])
    return LineCrf().fit(bins, np.repeat([CONTENT if r[1] else BOILERPLATE for r in rows], lengths), lengths)


def apply_rules(docs: DataFrame, crf: LineCrf, least_content: float = LEAST_CONTENT, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and, of every row, its counts, base_failed, content_share and kept; text_col may be among them."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((crf.emission, crf.transition))
    out = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("content_share", "double"), ("kept", "boolean")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LineCrf(*shared.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b, part, edges in slices(data, offsets):
                m = measure(part, edges)
                lines = np.bincount(m.line_row, minlength=b - a)
                label = model.viterbi(m.line_bins, lengths=lines)
                content = np.bincount(m.line_row, m.line_words * (label == CONTENT), b - a) / np.maximum(m.n_words, 1)
                failed = m.base_failed
                columns = [*(c[a:b] for c in batch.columns[1:]), *(pa.array(x, pa.int64()) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)), pa.array(failed), pa.array(content), pa.array(~failed & (content >= least_content))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{i}" for i in range(len(keep))), *(n for n, _ in out)])

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    inner = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    return inner.mapInArrow(fresh(run), ", ".join([kinds, *(f"{n} {t}" for n, t in out)])).toDF(*keep, *(n for n, _ in out))
