"""Operator 2: language identification by string kernels.

The kernel is the blended spectrum of presence: the number of distinct character n-grams, n from 1 to 3, that two texts share,
over the n-grams of the landmarks, divided by the geometric mean of the two texts' own numbers. A few landmark texts of each
language give a Nyström map, one-versus-rest kernel ridge regression is solved on it, and texts are scored in batches: a
presence matrix times one matrix that holds landmarks, map and regression.

Learned from a bounded sample of all languages: of each, the first PER_LANGUAGE labelled texts by a hash of their id that are not held
out, the first LANDMARKS of them as landmarks; of very many languages fewer of each, so that about SAMPLE texts and MARKS landmarks
are read in all, and MOST_CHARS characters of each. Texts that are predicted are read whole. Letters are compared in lower case, all
that is no letter is one mark, and letters that no landmark has are another. n-grams are numbered by a hash of SLOTS values.

Defined results: `und` with score 0 for a null text or one without letters; ties go to the first language by name; without
labelled texts all is `und`; a very long text is a slice of its own; of rows that share a sampled id and language one is learned, the
first by a hash of its text; repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import materialise, running, ship, slices, text_buffer
from .presplit import LETTER, classes

PER_LANGUAGE, LANDMARKS, SAMPLE, MARKS, MOST_CHARS = 400, 40, 6400, 640, 20_000
#: The fewest texts and landmarks of a language, however many languages there are.
LEAST = (8, 2)
#: Values, at most, of a presence matrix that is held at once.
DENSE = 1 << 24
#: Parts of a language among which its first documents are sought.
PARTS = 32
FOLDS = 5
ALPHABET = 0xFFFF - 2  # symbols from 2 on; 0 any other letter, 1 no letter
SLOTS = 1 << 21
RIDGE = 1e-3
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document takes no part in learning: crc32 of its id as text is divisible by FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


@dataclass
class Spectrum:
    """The alphabet, and the number of each n-gram that is a feature."""

    symbol: np.ndarray  # of each code point
    feature: list[np.ndarray]  # by n - 1: of each n-gram, -1 for none
    size: int

    @classmethod
    def of(cls, texts: list[str]) -> Spectrum:
        letters = Counter()
        table = classes()
        for text in texts:
            letters.update(text.lower())
        known = sorted((c for c in letters if table[ord(c)] == LETTER), key=lambda c: (-letters[c], c))[:ALPHABET]
        symbol = np.where(table == LETTER, 0, 1).astype(np.uint16)
        for i, c in enumerate(known):
            symbol[ord(c)] = i + 2
            if len(c.upper()) == 1:
                symbol[ord(c.upper())] = i + 2
        out = cls(symbol, [np.full(SLOTS, -1, np.int32) for _ in (1, 2, 3)], 0)
        for n in (1, 2, 3):
            found = set()
            for text in texts:
                found.update(np.unique(grams(symbol[code_points(np.frombuffer(text.encode(), np.uint8))], n)).tolist())
            found = sorted(found - (set(grams(np.ones(1, np.uint16), 1).tolist()) if n == 1 else set()))
            out.feature[n - 1][found] = out.size + np.arange(len(found))
            out.size += len(found)
        return out

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of 0 and 1 for each text, and whether it has a letter."""
        points = code_points(data)
        lead = running((data & 0xC0) != 0x80)
        edges = lead[offsets]
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(edges))
        left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(points))
        own = self.symbol[points]
        out = np.zeros((n, self.size + 1), np.float32)
        for k in (1, 2, 3):
            found = self.feature[k - 1][grams(own, k)]
            at = left[: len(found)] >= k
            out[row[: len(found)][at], found[at]] = 1  # -1 falls into the last column
        letters = running(classes()[points] == LETTER)
        return out[:, :-1], (letters[edges[1:]] - letters[edges[:-1]]) > 0


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """The slot of every n-gram."""
    out = symbols[: max(0, len(symbols) - n + 1)].astype(np.uint32)
    for k in range(1, n):
        out = out * np.uint32(0x9E3779B1) + symbols[k : len(symbols) - n + 1 + k]
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (out ^ (out >> np.uint32(13))) & np.uint32(SLOTS - 1)


def parts(space: Spectrum, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows whose presence matrices stay within DENSE values: first row, end row, presence, whether there is a letter."""
    step = max(1, DENSE // max(1, space.size))
    for a in range(0, len(offsets) - 1, step):
        edges = offsets[a : a + step + 1]
        yield a, a + len(edges) - 1, *space.presence(data[edges[0] : edges[-1]], edges - edges[0])


@dataclass
class Model:
    languages: list[str]
    spectrum: Spectrum | None = None
    weights: np.ndarray | None = None  # features x languages: landmarks, Nyström map and regression in one
    bias: np.ndarray | None = None

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        langs, score = [], np.zeros(n)
        for a, b, x, letters in parts(self.spectrum, data, offsets):
            scores = (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] + self.bias
            best = scores.argmax(axis=1)
            langs += [self.languages[i] if y else UNKNOWN for i, y in zip(best.tolist(), letters.tolist(), strict=True)]
            score[a:b] = np.where(letters, np.clip(scores[np.arange(b - a), best].astype(np.float64), 0, 1), 0.0)
        return langs, score


def fit(docs: DataFrame) -> Model:
    """The model of the documents that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", F.xxhash64("doc_id").alias("by"))
    languages = max(1, usable.agg(F.countDistinct("lang").alias("n")).first().n)
    each, landmarks = max(LEAST[0], min(PER_LANGUAGE, SAMPLE // languages)), max(LEAST[1], min(LANDMARKS, MARKS // languages))
    # First within parts of a language, so that a task gets no more than parts x each rows of one, however many tasks there are.
    part = F.pmod("by", F.lit(PARTS))
    first = usable.distinct().withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy("by", "doc_id"))).filter(F.col("place") <= each)
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("by", "doc_id"))).filter(F.col("place") <= each)
    keys = F.broadcast(first.filter("doc_id is not null").select("doc_id", "lang", (F.col("place") <= landmarks).alias("landmark")))  # each x languages at most
    sample = docs.filter("text is not null").select("doc_id", "lang", "text").join(keys, ["doc_id", "lang"])
    sample = sample.groupBy("doc_id", "lang", "landmark").agg(F.min_by(F.substring("text", 1, MOST_CHARS), F.xxhash64("text")).alias("text")).select("doc_id", "lang", "text", "landmark")
    sample = materialise(spark, sample, "sample")
    marks = sorted((r.lang, r.doc_id, r.text) for r in sample.filter("landmark").collect())
    if not marks:
        return Model([])
    spectrum = Spectrum.of([t for _, _, t in marks])
    lead = np.concatenate([spectrum.presence(*_one(t))[0] for _, _, t in marks])  # landmarks x features
    lead /= np.sqrt(np.maximum(lead.sum(axis=1), 1))[:, None]
    shared = spark.sparkContext.broadcast((spectrum, lead))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, landmarks = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for first, _, part, edges in slices(data, offsets):
                for a, b, x, _ in parts(space, part, edges):
                    k = (x @ landmarks.T) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first + a : first + b], batch.column(1)[first + a : first + b], pa.array([r.tobytes() for r in k.astype(np.float64)], pa.binary())], names=["doc_id", "lang", "k"])

    rows = sorted((r.doc_id, r.lang, bytes(r.k)) for r in sample.drop("landmark").mapInArrow(kernel, "doc_id bigint, lang string, k binary").collect())
    k = np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), -1)
    langs = sorted({r[1] for r in rows})
    y = np.array([[r[1] == x for x in langs] for r in rows], float)
    values, vectors = np.linalg.eigh((lead @ lead.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    of = (1 / np.maximum(y.sum(axis=0), 1))[y.argmax(axis=1)][:, None] / len(langs)  # every language weighs alike
    phi = np.concatenate([k @ nystrom, np.ones((len(k), 1))], axis=1)
    penalty = RIDGE * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(phi.T @ (phi * of) + penalty, phi.T @ (y * of))
    return Model(langs, spectrum, (lead.T.astype(np.float64) @ (nystrom @ solved[:-1])).astype(np.float32), solved[-1].astype(np.float32))


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b, part, edges in slices(data, offsets):
                langs, score = own.predict(part, edges)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
