"""License scan, prefix trie and spelling variants against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidewater.llm import license_scan as L
from tidewater.llm import prefix_trie as P
from tidewater.llm import spelling_groups as S
from tidewater.llm.shared import Scratch

LOW = str.maketrans(L.UPPER, L.LOWER)


def key(x):
    return tuple((v is not None, str(v)) for v in x)


# ---------------------------------------------------------------- license scan

def brute_scan(text):
    words = [w for w in re.split(L.GAPS, (text or "").translate(LOW)) if w]
    places = []
    for t in L.PHRASES:
        w = L.template_words(t.text)
        places += [(i, t.label) for i in range(len(words) - len(w) + 1) if words[i:i + len(w)] == w]
    labels, score = {x for _, x in places}, 1.0 if places else 0.0
    for t in L.NOTICES:
        w = L.template_words(t.text)
        k = min(L.GRAM, len(w))
        votes = [(p - j, j) for p in range(len(words) - k + 1) for j in range(len(w) - k + 1) if words[p:p + k] == w[j:j + k]]
        bands = defaultdict(set)
        for d, j in votes:
            for b in (d // L.BAND, d // L.BAND - 1):
                bands[b] |= set(range(j, j + k))
        best = max((len(x) / len(w) for x in bands.values()), default=0.0)
        score = max(score, best)
        if best * 100 >= L.SHARE:
            labels.add(t.label)
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9))


def test_license_scan_equals_brute_force(spark, docs, no_docs):
    mit = L.NOTICES[7].text
    cut = mit.replace("free of charge, ", "").replace("any person", "any one person")
    more = [(100, "THE MIT  License. mit-license! apache\nlicense"), (101, mit), (102, "x " * 50 + cut + " y" * 30), (103, "mit " * 40 + "license"),
            (104, "gnu general public licens"), (105, "Affero GNU General Public License, version 3 licensed under the gnu general public license"),
            (106, "ccby cc by cc by"), (106, "ccby cc by cc by"), (107, "cc by " * 3000), (108, "CC BYİ mİt license K")]
    both = docs.unionByName(spark.createDataFrame([(i, t) for i, t in more], "doc_id long, text string"), allowMissingColumns=True)
    got = [(r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in L.scan_licenses(both).collect()]
    want = [(r.doc_id, *brute_scan(r.text)) for r in both.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    by_id = {r[0]: r for r in got}
    assert by_id[101][6] == "mit" and by_id[102][6] == "mit" and by_id[102][2] == 0 and by_id[107][2] == 3000
    assert L.scan_licenses(no_docs).count() == 0


def test_license_scan_shuffles_no_text(spark, docs):
    plan = L.diagonals(docs, L.PHRASES + L.NOTICES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan and "MapIn" not in plan and "Python" not in plan
    below = plan[plan.index("Exchange hashpartitioning"):].splitlines()[1]
    assert "words#" not in below.replace("n_words#", "") and "found" not in below


# ---------------------------------------------------------------- prefix trie

def brute_trie(rows):
    lists = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            lists[c].append((turn is not None, turn or 0, hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in lists.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(P.WORD, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))).encode()).hexdigest())
                  for p, m in members.items())


def conversations():
    rnd = random.Random(5)
    rows = []
    for c in range(400):
        n = rnd.choice([0, 1, 1, 2, 3, 3, 5, 8])
        rows += [(c, i if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "a b", "b\tc d", "", None, "ü ß"])) for i in range(n)]
    rows += [(c, i, "user", f"same turn {i}") for c in range(1000, 1300) for i in range(4)]      # a large group of copies
    rows += [(2000, i, "user", f"long {i}") for i in range(700)] + [(2003, i, "user", f"long {i}") for i in range(650)]
    rows += [(None, 1, "user", "of no conversation"), (5000, 0, "user", "only"), (5000, 0, "user", "only"), (-7, 1, "user", "negative")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as words", "'k' as key", "2 as depth").repartition(5)
    got = sorted(map(tuple, P.conversation_trie(df).collect()), key=key)
    assert got == sorted(brute_trie(rows), key=key)
    assert P.conversation_trie(df.where("false")).count() == 0
    assert P.conversation_trie(df.where("conv_id is null")).count() == 0


def test_trie_of_small_blocks(spark):
    """One block's nodes and the merge of many small blocks agree: the border rules hold anywhere."""
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        got = sorted(map(tuple, P.conversation_trie(df).collect()), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(brute_trie(rows), key=key)


def test_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(21, 10_000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(c, 0, "user", "gone"), (7_000_000, 0, "user", "x")]
    got = P.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("depth = 0").collect()
    assert len(got) == 1 and got[0].n_convs == 2 and got[0].conv_id == c


def test_reach_and_range_min():
    rnd = np.random.default_rng(3)
    lcp = rnd.integers(0, 5, 60)
    table = P.sparse_table(lcp)
    for at in range(61):
        for depth in range(6):
            l, r = P.reach(table, np.array([at]), np.array([depth]), 61)
            a = b = at
            while a > 0 and lcp[a - 1] >= depth:
                a -= 1
            while b < 60 and lcp[b] >= depth:
                b += 1
            assert (l[0], r[0]) == (a, b)
    for a in range(60):
        for b in range(a, 60):
            assert P.range_min(table, np.array([a]), np.array([b]))[0] == lcp[a:b + 1].min()


# ---------------------------------------------------------------- spelling variants

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(S.RUN, text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    form, count = {}, Counter()
    for w in n:
        others = [v for v in n if abs(len(v) - len(w)) <= 1 and near(v, w)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], count[w], form[w], n[form[w]] if form[w] else None, root))
    return out


def test_spelling_variants_equal_brute_force(spark, docs, no_docs):
    rnd = random.Random(11)
    base = ["wonderful", "spelling", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "éclairage", "ÉCLAIRAGE", "Straßenbahn", "abcdefgh", "hgfedcba", "ab×cdefg"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = rnd.choice(base[:1] * 30 + base)
            if rnd.random() < 0.1:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "x", "é", w[at] * 2]) + w[at + 1:]
            words.append(w)
        rows.append((i, rnd.choice([" ", "1", ", "]).join(words)))
    rows += [(None, "wonderful wonderfull"), (1, None), (2, ""), (3, rows[0][1]), (3, rows[0][1])]
    both = docs.select("doc_id", "text", "norm", "label").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    want = brute_spelling([(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()])
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in S.spelling_variants(both.selectExpr("*", "'w' as word", "1 as n")).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[5] != r[3] and r[3] for r in got) or any(r[3] for r in got)
    assert S.spelling_variants(no_docs).count() == 0


def test_each_near_pair_is_found_once(spark):
    words = ["abcdefg", "abcdefgh", "abcdefh", "bacdefg", "aabcdefg", "ábcdefg", "abcdeffg", "zzzzzzz", "zzzzzzzz"]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = [tuple(r) for r in S.near_pairs(df, Scratch(spark, "test")).collect()]
    want = [(a, b) for a in words for b in words if a < b and near(a, b)]
    assert sorted(got) == sorted(want)


def test_roots_follow_chains(spark):
    rows = [(i, " ".join(["abcdefghij"] * 10)) for i in range(40)] + [(100 + i, "abcdefghijk " * 3) for i in range(10)] + [(200, "abcdefghijkl abcdefghijkl")]
    got = {r.word: (r.form, r.root) for r in S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {w: (f, root) for w, _, _, f, _, root in brute_spelling(rows)}
    assert got == want and got["abcdefghijkl"] == ("abcdefghijk", "abcdefghij")
