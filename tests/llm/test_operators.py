"""Every operator against a brute-force version, on driver documents and on rows with nulls, blanks, long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, buffers, langid, mixing, near_copies, quality, repeats, sharding, simhash, suffix_sort, token_counts, token_store, topk

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# A passage that several texts share, and columns whose names operators use themselves.
PASSAGE = " ".join(f"word{i * 7919 % 1000}" for i in range(60))
CLASHING = ["n_tokens", "fp", "u1", "h", "kept", "quality", "domain", "id", "c0", "ids", "shard", "size", "node", "root", "held_out", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    near = [f"copy{i}" for i in range(300)]
    odd = [(None, None, None, None, None), (1, None, "en", "src1", 0), (2, "", None, "src2", 0), (3, " \n\t ", "en", None, 3), (4, "one", "en", "src1", 3), (4, "one", "en", "src1", 3), (None, "<|endoftext|> it's 漢字 😀!", "fr", "src0", 1)]
    odd += [(10 + i, f"{'intro ' * i}{PASSAGE} {'end ' * (7 * i)}", "en", "src0", 1) for i in range(4)]
    odd += [(20, "a" * 30_000, "de", "src0", 1), (21, "x y " * 20_000, "de", "src0", 1), (22, " ".join(rng.choice(near) for _ in range(25_000)), "es", "src3", 1)]
    odd += [(30 + i, " ".join(near[:i] + [f"new{i}"] + near[i + 1 :]), "en", "src0", 1) for i in range(0, 40, 4)] + [(90, " ".join(near), "en", "src0", 1), (91, " ".join(near), "en", "src0", 1)]
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000)
    frame = given.unionByName(spark.createDataFrame(odd, given.schema)).withColumns({c: F.lit(1) for c in CLASHING})
    return frame.cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


def table(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], t


def test_bpe(docs, rows, library):
    encode, t = library
    expected = collections.Counter()
    for (i, *_), ids in zip(rows, encode([r[1] for r in rows]), strict=True):
        expected[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert table(bpe.round_trip(docs, PATH)) == expected


def test_bpe_lists_and_decoding(spark, docs, rows, library):
    own = {(r.doc_id, tuple(r.ids)) for r in bpe.encode_documents(docs, PATH).collect()}
    assert own == {(r[0], tuple(ids)) for r, ids in zip(rows, library[0]([r[1] for r in rows]), strict=True)}
    some = spark.createDataFrame([(1, [50256, 0, 255]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode_ids(some, PATH).orderBy("doc_id").collect()] == [library[1].decode([50256, 0, 255], skip_special_tokens=False), "", ""]


def test_automaton_is_deterministic_and_exact_on_small_merges():
    vocabulary = bpe.Vocabulary([b"a", b"b", b"aa", b"ab", b"aab"], [(0, 0, 2), (0, 1, 3), (2, 1, 4)], None)
    machine = bpe.Automaton(bpe.compile_automaton(vocabulary))

    def brute(text):
        ids = [{"a": 0, "b": 1}[c] for c in text]
        for u, v, uv in vocabulary.merges:
            out, i = [], 0
            while i < len(ids):
                hit = ids[i : i + 2] == [u, v]
                out.append(uv if hit else ids[i])
                i += 2 if hit else 1
            ids = out
        return ids

    for n in range(1, 11):
        for bits in range(2**n):
            text = "".join("ab"[bits >> k & 1] for k in range(n))
            ids, _ = machine.run(np.frombuffer(text.encode(), np.uint8), np.array([0]), np.array([n]))
            assert ids.tolist() == brute(text) == machine.run_one(text.encode()).tolist()


def test_token_counts(docs, rows, library):
    expected = collections.Counter((r[0], len((r[1] or "").encode()), len(ids), len(ids) > 1024) for r, ids in zip(rows, library[0]([r[1] for r in rows]), strict=True))
    assert table(token_counts.count_tokens(docs, PATH)) == expected


def test_scan_splits_like_the_array_rules():
    from millrace.llm.buffers import text_buffer
    from millrace.llm.presplit import presplit

    import pyarrow as pa

    rng = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", "é", "1", "<|endoftext|>", "!", "'s", "'", "'re", "'r", "'ll", "'v", "漢", "😀", "　", "x" * 200]
    data, offsets = text_buffer(pa.array(["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]))
    for a, b in zip(presplit(data, offsets, b"<|endoftext|>"), token_counts.split_by_scan(data, offsets, b"<|endoftext|>"), strict=True):
        assert np.array_equal(a, b)


@pytest.mark.parametrize(("chunk", "at_once"), [(128, 1 << 14), (5, 7), (1, 3)])
def test_counts_of_long_pieces_compose(library, monkeypatch, chunk, at_once):
    """Pieces of many chunks, whose maps compose over chunks and over blocks of them, count as by the library."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "AT_ONCE", at_once)
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 3000, "ab" * 1500, letters * 80, "-=" * 900, " " * 700, "\n" * 300 + "x", "".join(rng.choice(letters) for _ in range(3000)), "".join(rng.choice(["the", "ing", "ization", "q", "AB"]) for _ in range(900))]
    texts += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(600)), " ".join("z" * n for n in range(120, 140)), "", "one", "\u00e9" * 400]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    machine = token_counts.Counter(bpe.Automaton(bpe.compile_automaton(bpe.Vocabulary.from_json(open(PATH, encoding="utf-8").read()))))
    assert machine.count(data, offsets).tolist() == [len(x) for x in library[0](texts)]


def test_token_store(docs, rows, library):
    got = [tuple(r) for r in token_store.store_digest(docs, PATH).collect()]
    ids = dict()
    for r, x in zip(rows, library[0]([r[1] for r in rows]), strict=True):
        ids.setdefault(r[0], collections.Counter())[(len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))] += 1
    start, seen = 0, {}
    for i, at, n, crc in sorted(got, key=lambda r: r[1]):
        assert at == start
        start += n
        seen.setdefault(i, collections.Counter())[(n, crc)] += 1
    assert seen == ids
    order = [i for i, at, *_ in sorted(got, key=lambda r: r[1]) if i is not None]
    assert order == sorted(order)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_packing(tmp_path, bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    assert np.array_equal(token_store.unpack(token_store.pack(ids, bits), len(ids), bits), ids)
    system, path = token_store.open_uri(f"file://{tmp_path}/x.tok")
    with system.open_output_stream(path) as sink:
        writer = token_store.Writer(sink, bits, block=64)
        writer.add([5, None, 9], ids, np.array([0, 100, 100, 1003]))
        writer.close()
    with system.open_input_file(path) as source:
        reader = token_store.Reader(source)
        assert np.array_equal(reader.ids(63, 200), ids[63:200]) and np.array_equal(reader.document(2), ids[100:]) and reader.nulls.tolist() == [False, True, False]


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), copies, len(covered)


def test_quality(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (4, None, 0), (1005, 1, 0)], labels.schema))
    crf = quality.train(docs, labels)
    got = quality.apply_rules(docs, crf).collect()
    want = collections.Counter((r[0], *(m := brute_measures(r[1])), m[0] < 20 or 100 * m[4] > 30 * m[0]) for r in rows)
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, marks[r.doc_id]) for r in got if marks.get(r.doc_id) is not None and not r.base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.9
    assert not quality.train(docs.limit(0), labels).emission.any()


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    crf = quality.LineCrf(rng.normal(size=(int(quality.FIRST_BIN[-1]), 2)), rng.normal(size=(2, 2)))
    lengths = np.array([1, 5, 0, 3])
    bins = np.stack([rng.integers(0, len(b) + 1, lengths.sum()) for b in quality.BINS.values()], axis=1).astype(np.uint8)
    got, score, at = crf.viterbi(bins, lengths), crf.scores(bins), 0
    for n in lengths:
        paths = [[p >> k & 1 for k in range(n)] for p in range(2**n)]
        value = lambda p, at=at: sum(score[at + k, y] for k, y in enumerate(p)) + sum(crf.transition[a, b] for a, b in zip(p, p[1:], strict=False))
        assert n == 0 or value(got[at : at + n].tolist()) == pytest.approx(max(map(value, paths)))
        at += n


def test_language(docs, rows):
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    langs = {r[0]: r[2] for r in rows}
    real = [r for r in got if r.doc_id and r.doc_id >= 1000 and r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in real]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.Model([])).collect()} == {("und", 0.0)}


def test_language_scores_equal_a_plain_kernel(docs):
    """The same landmarks and regression with sets of n-grams instead of matrices and hashes."""
    model, rows = langid.fit(docs), [r for r in docs.filter("doc_id >= 1000").limit(40).collect()]
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    usable = [r for r in docs.filter("lang is not null and text is not null and doc_id is not null").collect() if not held(r)]
    texts = {}
    for r in usable:
        texts.setdefault((r.lang, r.doc_id), r.text)
    by = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    picked = {lang: sorted((d for x, d in texts if x == lang), key=lambda d: (by[d], d))[:400] for lang in {x for x, _ in texts}}
    marks = sorted((lang, d) for lang, own in picked.items() for d in own[:40])
    symbols = {ord(c): c for lang, d in marks for c in texts[lang, d].lower() if c.isalpha()}
    letter = lambda c: (c.lower() if len(c.lower()) == 1 and ord(c.lower()) in symbols else "?") if c.isalpha() else "_"

    def spectrum(text):
        own = "".join(map(letter, text))
        return {own[i : i + n] for n in (1, 2, 3) for i in range(len(own) - n + 1)} - {"_"}

    spectra = [spectrum(texts[m]) for m in marks]
    features = set().union(*spectra)
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    lead = np.array([[kernel(a, b) for b in spectra] for a in spectra])
    values, vectors = np.linalg.eigh(lead)
    keep = values > 1e-6 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    known = [(lang, spectrum(texts[lang, d]) & features) for lang, own in picked.items() for d in own]
    phi = np.concatenate([np.array([[kernel(x, m) for m in spectra] for _, x in known]) @ nystrom, np.ones((len(known), 1))], axis=1)
    langs = sorted(picked)
    y = np.array([[lang == x for x in langs] for lang, _ in known], float)
    of = (1 / y.sum(axis=0))[y.argmax(axis=1)][:, None] / len(langs)
    penalty = langid.RIDGE * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(phi.T @ (phi * of) + penalty, phi.T @ (y * of))
    assert model.languages == langs
    for r in rows:
        own = spectrum(r.text) & features
        score = np.array([kernel(own, m) for m in spectra]) @ nystrom @ solved[:-1] + solved[-1]
        (lang,), got = model.predict(*langid._one(r.text))
        if any(c.isalpha() for c in r.text):
            assert lang == langs[int(score.argmax())] and got[0] == pytest.approx(min(max(score.max(), 0), 1), abs=0.02)


def test_every_language_is_learned(spark):
    """More languages than a round number, each with letters of its own."""
    rows = [(100 * i + k, "".join(chr(0x4E00 + 40 * i + (7 * j + k) % 40) for j in range(60)), f"l{i:03d}", None, 1) for i in range(90) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.predict(frame, langid.fit(frame)).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id // 100:03d}" for r in got]) > 0.99


def test_lines_and_words_of_one_polynomial_hash_are_told_apart():
    """Two different words of two letters whose polynomial hashes modulo 2^64 agree: they are neither equal lines nor equal words."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one}\n{other}\n", f"{one}\n{one}\n", " ".join([one, *"cdefghi", other, *"cdefghi"])]
    from millrace.llm.buffers import text_buffer

    import pyarrow as pa

    m = quality.measure(*text_buffer(pa.array(texts)))
    assert [(int(a), int(b)) for a, b in zip(m.n_dup_lines, m.n_repeat_words, strict=True)] == [brute_measures(t)[3:] for t in texts] == [(0, 0), (1, 0), (0, 0)]


def test_top_k_of_large_and_long_vectors_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5] * 3000), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [4e7] * 4), (50, [4e7] * 4)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    big = int(256 * 4e7)
    assert got[:5] == [(0, 1, 3, 256 * big), (0, 2, 50, 256 * big), (0, 3, 2, 512 * 256), (0, 4, 2, 512 * 256), (0, 5, 1, 256 * 128)]
    assert got[5] == (50, 1, 3, 2**63 - 1) and [r[2] for r in got[5:]] == [3, 2, 2, 1, 0]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).round(2).tolist() for _ in range(300)] + [[0.5] * 8] * 60 + [[1.0, 2.0], []]
    bad = [(1000, None, 0), (1050, [None, 1.0], 0), (1100, [float("nan")], 0), (None, [1.0], 0), (1150, [float("inf")], 0), (50, vectors[50], 0)]
    frame = spark.createDataFrame([*((i, v, 0) for i, v in enumerate(vectors)), *bad], "vec_id long, embedding array<float>, score int")
    m = np.zeros((len(vectors), 8), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = np.floor(256 * np.array(v, np.float32).astype(float))
    expected = collections.Counter()
    for q in range(0, len(vectors), 50):
        score = m @ m[q]
        best = [j for j in np.lexsort((np.arange(len(m)), -score)) if j != q][:5]
        expected.update((q, k + 1, int(j), int(score[j])) for k, j in enumerate(best))
    assert table(topk.top_k(frame)) == expected
    assert topk.top_k(frame.limit(0)).count() == 0 and topk.top_k(frame.filter("vec_id = 0")).count() == 0


def test_top_k_stops_only_on_proof():
    rng = np.random.default_rng(8)
    vectors = np.floor(rng.normal(size=(5000, 16)) * 256).astype(np.int64)
    touched = []
    who, vec, score = topk.best(np.arange(40), vectors[:40], np.arange(5000), vectors, 5, touched)
    assert sum(a for a, _ in touched) < 0.8 * sum(b for _, b in touched)
    for q in range(40):
        s = vectors @ vectors[q]
        s[q] = -(10**9)
        assert vec[who == q].tolist() == np.lexsort((np.arange(5000), -s))[:5].tolist() and score[who == q].tolist() == np.sort(s)[::-1][:5].tolist()


def brute_fingerprint(text, size=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = ([" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)]) if words else []
    h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles], np.uint64)
    return sum(1 << k for k in range(64) if len(h) and 2 * int(((h >> np.uint64(k)) & np.uint64(1)).sum()) > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("most_bucket", [2048, 3])
def test_simhash(docs, rows, most_bucket):
    fp = np.array([brute_fingerprint(r[1]) for r in rows], np.uint64)
    near = [(a, int(b)) for a in range(len(fp)) for b in np.flatnonzero(np.bitwise_count(fp[a] ^ fp) <= 4)]
    root = roots(len(fp), near)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    expected = collections.Counter((r[0], f"{int(fp[i]):016x}", least.get(root[i])) for i, r in enumerate(rows))
    assert table(simhash.near_duplicates(docs, most_bucket=most_bucket)) == expected


def test_large_buckets_lose_no_link(spark):
    """A chain and a ball of fingerprints, with buckets of three members at most, against all pairs."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    values = {centre}
    for _ in range(200):
        x = centre
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values |= {int(x) for x in rng.integers(0, 2**63, 200)}
    own = sorted(values)
    fp = np.array(own, np.uint64)
    root = roots(len(own), [(a, int(b)) for a in range(len(own)) for b in np.flatnonzero(np.bitwise_count(fp[a] ^ fp) <= 4)])
    signed = fp.view(np.int64).tolist()
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most_bucket=3))
    mine = {r.node: r.root for r in found.collect()}
    groups = lambda of: sorted(sorted(g) for g in of.values() if len(g) > 1)
    a, b = collections.defaultdict(list), collections.defaultdict(list)
    for i, x in enumerate(signed):
        a[root[i]].append(x)
        b[mine.get(x, x)].append(x)
    assert groups(a) == groups(b)


def test_near_copies(docs, rows):
    kept = collections.Counter(r.doc_id for r in near_copies.one_of_each(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect())

    def shingles(text):
        words = WORD.findall((text or "").lower())
        return frozenset(zip(*(words[k:] for k in range(5)), strict=False)) or frozenset([tuple(words)])

    sets = [shingles(r[1]) for r in rows]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(x := sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(x))]
    root = roots(len(rows), near)
    best = {}
    for i, r in enumerate(rows):
        best[root[i]] = min(best.get(root[i], (True, 0)), (r[0] is None, r[0] or 0))
    assert kept == collections.Counter(None if none else i for none, i in best.values())


def kept_ids(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in near_copies.one_of_each(rows).collect())


def test_appended_and_cut_copies_are_near_copies(spark):
    """Texts with a passage of other words behind them, and texts cut off, down to a Jaccard index just above 0.8; each at its edge, one word beyond, too."""
    rng = random.Random(11)
    texts, expected = [], []
    for i in range(120):
        n = rng.choice([40, 150, 600])
        own = [f"w{i}x{rng.randrange(10**6)}" for _ in range(n)]
        shingles = n - 4
        most = shingles // 4 if i % 2 else shingles // 5  # words that may be appended, or cut off
        change = rng.randint(most // 2, most) if i % 3 else most + (i % 4 > 1)
        other = own + [f"v{i}y{rng.randrange(10**6)}" for _ in range(change)] if i % 2 else own[: n - change]
        expected += [len(texts)] if change <= most else [len(texts), len(texts) + 1]
        texts += [" ".join(own), " ".join(other)]
    assert kept_ids(spark, texts) == expected


def test_large_groups_of_near_copies_lose_no_link(spark, monkeypatch):
    """Copies that are near their original only, and a chain of texts each near its neighbours only, with buckets and blocks of three."""
    monkeypatch.setattr(near_copies, "FEW", 3, raising=False)
    monkeypatch.setattr(near_copies, "BLOCK", 3, raising=False)
    rng = random.Random(12)
    own = [f"o{i}" for i in range(150)]
    texts = [" ".join(own)]
    for i in range(300):
        words, at = list(own), rng.randrange(5, 30)
        for k in range(3):
            words[at + 40 * k] = f"new{i}x{k}"
        texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[k : k + 150]) for k in range(0, 240, 6)]
    assert kept_ids(spark, texts) == [0, 301]


def test_texts_of_the_same_words_meet_each_other(spark):
    """Of three texts of the same words only two are near copies, and a fourth one with a further word is near these two."""
    rng = random.Random(13)
    texts, expected = [], []
    for i in range(20):
        own = [f"s{i}x{k}" for k in range(100)]
        other = rng.sample(own, 100)
        swapped = own[:-2] + own[:-3:-1]
        expected += [len(texts), len(texts) + 1]
        texts += [" ".join(other), " ".join(own), " ".join(swapped), " ".join([*swapped, f"t{i}"])]
    assert kept_ids(spark, texts) == expected


def test_near_copies_come_through_fingerprints(spark, monkeypatch):
    """Without the index of prefixes, copies within operator 6's four bits are still found, and only copies; its links are those of all pairs."""
    rng = random.Random(14)
    texts, expected = [], []
    for i in range(40):
        own = [f"f{i}x{rng.randrange(10**6)}" for _ in range(3000)]
        expected.append(len(texts))
        texts += [" ".join(own), " ".join([*own[:-1], "other"])]
    prints = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()
    fp = {r.doc_id: r.fp & (1 << 64) - 1 for r in prints}
    assert all((fp[k] ^ fp[k + 1]).bit_count() <= 4 for k in expected)
    monkeypatch.setattr(near_copies, "FEW", 100)
    monkeypatch.setattr(near_copies, "_pairs", lambda similarity: lambda batches: (b.slice(0, 0).select(["u", "v"]) for b in [] if b))
    assert kept_ids(spark, texts) == expected

    base = [rng.getrandbits(63) for _ in range(6)]
    values = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(4))) for b in base for _ in range(12)] + base[:2]
    found = near_copies.within_bits(spark.createDataFrame(list(enumerate(values)), "own long, fp long")).collect()
    wanted = roots(len(values), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4])
    assert roots(len(values), [(r.v, r.u) for r in found]) == wanted and all(r.u < r.v for r in found)


def test_a_kernel_begins_without_the_tables_of_other_operators():
    """Idle workers once kept them for the rest of the session, so that an executor went beyond its memory stages later."""
    left = []

    def leave(batches):
        bpe._AUTOMATA["left"] = None
        yield from batches

    def look(batches):
        for batch in batches:
            left.append(dict(bpe._AUTOMATA))
            yield batch

    rows = [pa.RecordBatch.from_pydict({"x": [1]})]
    assert list(look(leave(rows))) == rows and left == [{"left": None}]
    assert list(buffers.fresh(look)(rows)) == rows and left[1:] == [{}]


def brute_repeats(rows):
    raw, count = [(r[0], (r[1] or "").encode()) for r in rows], collections.Counter()
    for _, t in raw:
        count.update(t[k : k + 200] for k in range(len(t) - 199))
    out = collections.Counter()
    for i, t in raw:
        covered = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                covered[k] += 1
                covered[k + 200] -= 1
        hit = np.cumsum(covered)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~hit].tobytes()
        out[(i, len(t), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("most_group", [20_000, 2])
def test_suffix_dedup(docs, rows, most_group):
    assert table(repeats.remove_repeats(docs, most_group=most_group)) == brute_repeats(rows)


def test_suffix_dedup_keeps_columns(docs, rows):
    out = repeats.without_repeats(docs.select("doc_id", "text", "lang"))
    assert out.columns == ["doc_id", "text", "lang"] and out.count() == len(rows)
    assert PASSAGE not in "".join(r.text for r in out.collect())


def test_deep_shallow_sorting():
    rng = random.Random(4)
    for trial in range(150):
        base = bytes(rng.choice(b"ab") for _ in range(120))
        strings = []
        for _ in range(rng.randint(1, 40)):
            x = bytearray(base[: rng.randint(0, 120)])
            for _ in range(rng.randint(0, 2)):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(b"abc\0")
            strings.append(bytes(x))
        group, sizes = np.array([rng.randint(0, 3) for _ in strings]), np.array([len(x) for x in strings])
        order, _ = suffix_sort.deep_shallow_sort(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes, group, shallow=rng.choice([0, 7, 42]))
        own = [(group[i], strings[i]) for i in order]
        assert own == sorted(own), trial


def test_mixing(spark, docs):
    import duckdb

    own = docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow()
    con = duckdb.connect()
    con.register("documents", own)
    expected = collections.Counter(con.execute(mixing.ORACLE_SQL).fetchall())
    assert table(mixing.mix(docs)) == expected


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "1", 500), ("b", "x", "1", 1000)], "domain string, lang string, source string, available long")
    even = {n: F.lit(1).cast("long") for n in mixing.LEVELS}
    given = {(r.domain, r.lang, r.source): r.given for r in mixing.budgets(leaves, F.lit(400), 1, even).collect()}
    assert given == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}
    given = {(r.domain, r.lang, r.source): r.given for r in mixing.budgets(leaves, F.lit(1400), 1, even).collect()}
    assert given[("a", "y", "1")] == 500 and given[("b", "x", "1")] == 790


def test_sharding(docs, rows):
    got = sharding.shard(docs).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, weight, homes = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        weight[r.shard] += r.size
        homes[(r.size, r.text_crc32)].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in homes.values())
    # One text is larger than an eighth of all; the other shards share the rest evenly.
    others = sorted(weight.values())[:-1]
    assert set(slots) == set(range(8)) and others[-1] < 1.02 * others[0]


def plain_tree(cells, target):
    """Leaves, from left to right, of a k-d tree over [(bins, weight)], by sorting."""
    widths = list(sharding.BINS.values())
    spread = [(max(c[d] for c, _ in cells) - min(c[d] for c, _ in cells)) / (widths[d] - 1) for d in range(4)]
    total = sum(w for _, w in cells)
    if total <= target or not any(spread):
        return [cells]
    d = spread.index(max(spread))
    cuts = sorted({c[d] for c, _ in cells})[:-1]
    below = {x: sum(w for c, w in cells if c[d] <= x) for x in cuts}
    cut = min(cuts, key=lambda x: (abs(below[x] - total / 2), x))
    return plain_tree([c for c in cells if c[0][d] <= cut], target) + plain_tree([c for c in cells if c[0][d] > cut], target)


def test_tree_against_a_plain_one():
    rng = random.Random(6)
    for _ in range(60):
        cells = {tuple(rng.randrange(w) if rng.random() < 0.8 else 0 for w in sharding.BINS.values()): float(rng.choice([1, 2, 5, 40])) for _ in range(rng.randint(1, 80))}
        target = sum(cells.values()) / rng.choice([1, 3, 20])
        leaf = sharding.grow(np.array(list(cells)), np.array(list(cells.values())), target)
        got = [sorted(c for c, x in zip(cells, leaf, strict=True) if x == i) for i in range(max(leaf) + 1)]
        assert got == [sorted(c for c, _ in own) for own in plain_tree(list(cells.items()), target)]


def test_shards_follow_the_tree(spark, docs, rows):
    """Placement, from the sums of cells on, worked out again without Spark."""
    got = {(r.size, r.text_crc32): r.shard for r in sharding.shard(docs).collect()}
    plain = sharding.shard(docs.drop("lang", "source"))
    assert plain.count() == len(rows)
    groups = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).groupBy("text").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("n"))
    groups = groups.select("text", "n", F.pmod(F.xxhash64("lang"), F.lit(8)).alias("a"), F.pmod(F.xxhash64("source"), F.lit(8)).alias("b")).collect()
    sizes = sorted(len(g.text.encode()) + 1 for g in groups)
    edges = sorted({sizes[max(0, -(-i * len(sizes) // 64) - 1)] for i in range(1, 64)})
    cell = lambda g: (sum(len(g.text.encode()) + 1 > e for e in edges), g.a, g.b, zlib.crc32(g.text.encode()) % 16)
    weight = collections.Counter()
    for g in groups:
        weight[cell(g)] += g.n * (len(g.text.encode()) + 1)
    leaves = plain_tree(sorted(weight.items()), sum(weight.values()) / (8 * sharding.LEAVES))
    load, home = [0] * 8, {}
    for i in sorted(range(len(leaves)), key=lambda i: (-sum(w for _, w in leaves[i]), i)):
        s = min(range(8), key=lambda s: (load[s], s))
        load[s] += sum(w for _, w in leaves[i])
        home |= {c: s for c, _ in leaves[i]}
    assert all(got[len(g.text.encode()) + 1, zlib.crc32(g.text.encode())] == home[cell(g)] for g in groups)


def test_very_long_texts(spark, library):
    """Texts beyond a slice, beside short ones."""
    rng = random.Random(21)
    words = [f"{rng.choice(['it', 'Näh', 'x1', '漢字', 'don'])}{rng.choice(['', chr(39) + 's', ',', '-7', '!'])}{rng.randrange(3000)}" for _ in range(9000)]
    long = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(160_000))
    assert len(long.encode()) > 1_300_000
    texts = ["short", long, long[: len(long) * 9 // 10], None, "tail of it"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    ids = library[0](texts)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(frame, PATH).collect()} == {(i, len(x)) for i, x in enumerate(ids)}
    assert {r.doc_id: r.ids_sha256 for r in bpe.round_trip(frame, PATH).collect()} == {i: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for i, x in enumerate(ids)}
    assert {r.doc_id: r.ids_crc32 for r in token_store.store_digest(frame, PATH).collect()} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in enumerate(ids)}
    assert {tuple(r)[:6] for r in quality.apply_rules(frame, quality.LineCrf()).collect()} == {(i, *brute_measures(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(frame).collect()} == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts)}
    assert kept_ids(spark, [t or "" for t in texts]) == [0, 1, 3, 4]


def test_every_code_point_is_split_as_by_the_library(library):
    """All code points: alone between blanks, between letters, after an apostrophe, before a number and behind several blanks."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c} a{c}b '{c}s{c}1  {c}\n" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    with open(PATH, encoding="utf-8") as f:
        own = token_store.LibraryEncoder(f.read())
    from millrace.llm.buffers import text_buffer

    import pyarrow as pa

    for i in range(0, len(texts), 200):
        ids, edges = own.encode(*text_buffer(pa.array(texts[i : i + 200])))
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == library[0](texts[i : i + 200])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    for out in (
        bpe.round_trip(none, PATH), token_counts.count_tokens(none, PATH), token_store.store_digest(none, PATH), langid.predict(none, langid.fit(none)), quality.apply_rules(none, quality.train(none, labels)),
        simhash.near_duplicates(none), near_copies.one_of_each(none.select("doc_id", "text")), repeats.remove_repeats(none), mixing.mix(none), sharding.shard(none),
    ):
        assert out.count() == 0
