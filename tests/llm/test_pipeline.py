import collections
import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import mixing, quality
from millrace.llm.buffers import text_buffer

from .test_operators import WORD, brute_measures, roots

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "word " * 30_000, None, "src1", 1)], docs.schema)
    docs = docs.unionByName(odd).withColumn("kept", F.lit(1)).withColumn("node", F.lit(2))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(spark, stage(spark, docs, SF), name)
        sizes.append(out.count())
        if name != "bpe":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        docs_before, docs = docs, out
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[4] > 0 and sizes[5] == sizes[4]
    ends = {r.doc_id: r.text for r in docs_before.collect()}
    assert all(r.decoded == ends[r.doc_id] and r.n_tokens == len(r.ids) for r in docs.collect())


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def plain_quality(rows, crf):
    out = []
    for r in rows:
        n, _, _, _, repeated = brute_measures(r[1])
        m = quality.measure(*text_buffer(pa.array([r[1] or ""])))
        label = crf.viterbi(m.line_bins, np.array([len(m.line_bins)]))
        if n >= 20 and 100 * repeated <= 30 * n and m.line_words[label == quality.CONTENT].sum() >= 0.5 * n:
            out.append(r)
    return out


def plain_near_dedup(rows):
    def shingles(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(zip(*(words[k:] for k in range(5)), strict=False)) or frozenset([tuple(words)])

    sets = [shingles(r[1]) for r in rows]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(x := sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(x))]
    best = {}
    for root, r in zip(roots(len(rows), near), rows, strict=True):
        best[root] = min(best.get(root, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return list(best.values())


def plain_suffix_dedup(rows):
    raw = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[k : k + 200] for t in raw for k in range(len(t) - 199))
    out = []
    for r, t in zip(rows, raw, strict=True):
        covered = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                covered[k] += 1
                covered[k + 200] -= 1
        text = np.frombuffer(t, np.uint8)[np.cumsum(covered)[:-1] == 0].tobytes().decode("utf-8", "ignore")
        out.append((r[0], text, *r[2:4], len(text)))
    return out


def plain_mixing(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[i] for r in rows], pa.int64() if c in ("doc_id", "n_chars") else pa.string()) for i, c in enumerate(corpus_pipeline.COLUMNS)}))
    copies = {r[0]: r[5] for r in con.execute(mixing.ORACLE_SQL).fetchall()}
    return [r for r in rows for _ in range(copies.get(r[0], 0))]


def test_pipeline_against_plain_stages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    crf = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = plain_mixing(plain_suffix_dedup(plain_near_dedup(plain_quality(rows, crf))))
    encode = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)).encode
    expected = collections.Counter((r[0], r[2], r[3], hashlib.sha256(str(encode(r[1], add_special_tokens=False).ids).encode()).hexdigest(), r[1]) for r in rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.lang, r.source, hashlib.sha256(str(list(r.ids)).encode()).hexdigest(), r.decoded) for r in got) == expected
