"""BPE, quality rules, language and toxicity: brute force, round trips and held-out accuracy."""
import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm import bpe, langid, quality, toxicity
from tidewater.llm.jobs import queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def key(x):
    return tuple((v is not None, v) for v in x)


def test_bpe_equals_the_library(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + n, f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}  x") for n, c in enumerate([*range(0, 0x3100), *range(0x1F5F0, 0x1F700)]) if not 0xD800 <= c < 0xE000]
    lib = Tokenizer.from_file(PATH)
    vocabulary = bpe.Vocabulary(PATH)
    encode = vocabulary.encoder()
    for at in range(0, len(rows), 500):
        part = rows[at:at + 500]
        flat, counts = encode([t or "" for _, t in part])
        ends = np.cumsum(counts)
        want = [lib.encode(t or "", add_special_tokens=False).ids for _, t in part]
        for (i, t), w, e, n in zip(part, want, ends, counts):
            assert flat[e - n:e].tolist() == w, (i, t[:60])
    got = bpe.digests(docs, vocabulary).collect()
    want = []
    for i, t in rows[:docs.count()]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert bpe.digests(no_docs, vocabulary).collect() == []


def test_bpe_decodes_broken_utf8(spark):
    vocabulary = bpe.Vocabulary(PATH)
    lib = Tokenizer.from_file(PATH)
    lists = [[i] for i in range(300)] + [[200, 201, 202], [50256, 5], []]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lists)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, vocabulary).collect()}
    assert got == {n: lib.decode(x, skip_special_tokens=False) for n, x in enumerate(lists)}


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w in set(windows) if sum(v == w for v in windows) > 1}
    hit = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_quality_base_counts(spark, docs, no_docs):
    small = docs.where("doc_id is null or doc_id not in (10, 11)")
    got = quality.judge(small, None).collect()
    want = [(r.doc_id, *brute_base(r.text)) for r in small.collect()]
    assert sorted([(r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == sorted(want, key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert quality.judge(no_docs, None).collect() == []
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.row.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(more, None).collect()}
    for r in more.limit(60).collect():
        if len(r.text) < 9000:
            assert got[r.doc_id] == brute_base(r.text)


def test_viterbi_equals_enumeration():
    rng = np.random.RandomState(3)
    model = quality.Crf(rng.randn(quality.N_FEATURES, 2), rng.randn(2, 2), rng.randn(2))
    lengths = np.array([1, 6, 3, 7, 2])
    x = rng.randint(0, 2, (lengths.sum(), quality.N_FEATURES)).astype(np.int8)
    got = model.viterbi(x, lengths)
    at = 0
    for n in lengths:
        s = x[at:at + n] @ model.weights
        best = max(itertools.product((0, 1), repeat=int(n)), key=lambda y: model.start[y[0]] + sum(s[t, y[t]] for t in range(n)) + sum(model.steps[a, b] for a, b in zip(y, y[1:])))
        assert got[at:at + n].tolist() == list(best)
        at += n


def test_quality_follows_the_labels(spark):
    out = queries()["op7_quality"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in out if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in out if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_without_labels_keeps_by_rules(spark, docs):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries()["op8_langid"](spark, SF).collect()
    held = [r for r in out if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_awkward_rows(docs, no_docs):
    model = langid.train(docs)
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert {(4, "und", 0.0), (5, "und", 0.0), (6, "und", 0.0)} <= got
    assert all(p in ("en", "und") for _, p, _ in got)
    assert langid.train(no_docs) is None and langid.predict(no_docs, None, ["doc_id"]).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, None, ["doc_id"]).collect()} == {"und"}


def test_ftrl_is_sparse():
    rows = [(np.array([0, 2 + i % 7]), np.array([3, 1])) for i in range(200)] + [(np.array([1, 2 + i % 7]), np.array([3, 1])) for i in range(200)]
    w, _ = langid.ftrl(rows, [0] * 200 + [1] * 200, 2, np.ones(10), l1=1.0)
    assert (w[0] != 0).any() and (w[1] != 0).any() and (w[9:] == 0).all()


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = [r for r in queries()["op4_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted for r in out if truth[r.doc_id] == 1)
    assert hit / sum(truth[r.doc_id] for r in out) > 0.9
    assert hit / max(1, sum(r.predicted for r in out)) > 0.9


def test_nearest_examples_are_exact():
    rng = np.random.RandomState(5)
    n, m = 500, 60
    dense = rng.rand(n, m) * (rng.rand(n, m) < 0.1)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    rows, feats = np.nonzero(dense)
    index = toxicity.Index(np.arange(m, dtype=np.uint64), np.ones(m), np.arange(n), rng.randint(0, 2, n), rows, feats, dense[rows, feats])
    for _ in range(50):
        q = rng.rand(m) * (rng.rand(m) < 0.15)
        k = np.flatnonzero(q)
        if not len(k):
            continue
        w = q[k] / np.linalg.norm(q)
        top, sims = index.nearest(k, w)
        want = np.sort(dense[:, k] @ w)[::-1][:toxicity.K]
        assert np.allclose(sims, want[want > 1e-12])


def test_toxicity_of_awkward_rows(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.build(docs, none) is None
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 18)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    index = toxicity.build(docs, labels)
    got = toxicity.score(docs, index, ["doc_id"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, index, ["doc_id"]).collect() == []
