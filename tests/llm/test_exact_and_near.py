"""Exact and near-dedup, and repeated substrings, against brute force."""
import hashlib
import math
import random
import re

import pytest

from tidewater.llm import exact_dedup, near_dup, suffix_dedup
from tidewater.llm.components import connected_components
from tidewater.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def with_copies(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = list(rows)
    for n, (i, t) in enumerate(rows[:60]):
        w = t.split(" ")
        for k in range(1, 4):
            v = list(w)
            for j in range(0, len(v), max(2, 7 * k)):
                v[j] = v[j] + "q" * (j % 3)
            out.append((100_000 + 10 * n + k, " ".join(v)))
    return out


def shingle_set(text, k):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (r not in low or d < low[r]):
            low[r] = d
    return [(d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def key(x):
    return tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rows = with_copies(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=words).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows, words, 80), key=key)


def test_near_duplicates_of_awkward_rows(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dup.near_duplicates(docs, words=2).collect()
    assert sorted([(r.id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute_components(rows, 2, 80), key=key)
    assert near_dup.near_duplicates(no_docs).collect() == []
    stays = {(r.component_id, r.id) for r in got if r.stays}
    assert len([r for r in got if r.stays and r.component_id == 1]) == 1 and (1, 1) in stays


def test_near_dup_stage_keeps_one_row_of_each_group(spark, docs):
    out = near_dup.stage_near_dup(spark, docs, SF)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert sum((t or "").startswith("word0 word1") for t in texts) == 1
    assert sum(not (t or "").strip() for t in texts) == 3


def test_large_group_of_near_copies_is_one_component(spark):
    base = [f"token{i}" for i in range(200)]
    rows = []
    for n in range(400):
        w = list(base)
        w[n % 200] = f"edit{n}"
        rows.append((n + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dup.near_duplicates(df, words=5).collect()} == {1}


def test_copies_of_one_text_that_link_only_beside_it(spark):
    """Families share changes of a common text: members of one family are linked, families mostly are not."""
    base = [f"token{i}" for i in range(100)]
    rows = [(1, " ".join(base))]
    for family in range(12):
        w = list(base)
        for j in range(family % 3, 100, 12):
            w[j] = f"family{family}x{j}"
        for n in range(6):
            v = list(w)
            for j in range(n, 4 * (n % 3), 3):
                v[j] = f"own{family}x{n}x{j}"
            rows.append((10 * family + n + 2, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=2).collect()]
    want = brute_components(rows, 2, 80)
    assert sorted(got) == sorted(want) and len({c for *_, c in want}) > 2


def test_texts_that_share_few_shingles_make_no_pairs(spark, monkeypatch):
    """Orders of the same words share about one two-word shingle a pair, by chance."""
    draw = random.Random(7)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = [(n + 1, " ".join(draw.sample(vocabulary, 400))) for n in range(100)]
    rows.append((200, rows[0][1] + " tail"))
    pairs, write = [], Scratch.write

    def counted(self, df, tag):
        out = write(self, df, tag)
        if tag.startswith("pairs"):
            pairs.append(out.count())
        return out
    monkeypatch.setattr(near_dup.Scratch, "write", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=2).collect()]
    assert sorted(got) == sorted(brute_components(rows, 2, 80))
    assert sum(pairs) <= 5


def test_shingles_shared_by_chance_make_no_lists(spark, monkeypatch):
    """Each text shares about 88 of its two-word shingles with some other one, but no two texts share neighbouring ones."""
    draw = random.Random(5)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = [(n + 1, " ".join(draw.sample(vocabulary, 400))) for n in range(100)]
    rows.append((200, rows[0][1] + " tail"))
    entries, write = {}, Scratch.write

    def counted(self, df, tag):
        out = write(self, df, tag)
        entries[tag] = out.count()
        return out
    monkeypatch.setattr(near_dup.Scratch, "write", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=2).collect()]
    assert sorted(got) == sorted(brute_components(rows, 2, 80))
    assert entries["lists"] <= 2 * near_dup.SKETCH + 50


@pytest.mark.parametrize("percent", [60, 75, 80, 95])
def test_short_near_duplicates_equal_brute_force(spark, percent):
    """Sets of 1 to 40 shingles, which the sketches hold whole: the bound on shared neighbours holds for every order of their values."""
    draw = random.Random(percent)
    rows = []
    for n in range(120):
        w = [f"w{n}x{j}" for j in range(draw.randrange(1, 20 if n % 2 else 41))]
        rows.append((10 * n, " ".join(w)))
        for k in range(1, 4):
            v = list(w)
            for _ in range(draw.randrange(1, 3)):
                at = draw.randrange(len(v))
                v[at:at + 1] = draw.choice([[], [f"new{n}x{k}"], [v[at], f"more{n}x{k}"]]) or [v[at]]
            rows.append((10 * n + k, " ".join(v if k < 3 else w[:-1] or w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=1, percent=percent).collect()]
    assert sorted(got) == sorted(brute_components(rows, 1, percent))


def test_far_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    """Copies so changed that the sketch rules out a link to the text they share, and mostly to each other; some families are linked by their changes."""
    draw = random.Random(11)
    base = [f"token{i}" for i in range(150)]

    def changed(words, places, name):
        return [f"{name}x{j}" if j in places else w for j, w in enumerate(words)]
    rows = [(1, " ".join(base))]
    for n in range(12):
        rows.append((2 + n, " ".join(changed(base, {draw.randrange(150)}, f"near{n}"))))
    for n in range(150):
        rows.append((100 + n, " ".join(changed(base, set(draw.sample(range(2, 148), 8 + n % 3)), f"far{n}"))))
    for family in range(8):
        common = changed(base, set(draw.sample(range(2, 148), 10)), f"family{family}")
        for n in range(3):
            rows.append((400 + 10 * family + n, " ".join(changed(common, {draw.randrange(150)}, f"own{family}x{n}"))))
    pairs, write = [], Scratch.write

    def counted(self, df, tag):
        out = write(self, df, tag)
        if tag.startswith("pairs"):
            pairs.append(out.count())
        return out
    monkeypatch.setattr(near_dup.Scratch, "write", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=5).collect()]
    want = brute_components(rows, 5, 80)
    assert sorted(got) == sorted(want) and len({c for *_, c in want}) > 100
    assert sum(pairs) <= 10 * len(rows)


@pytest.mark.parametrize("size", [1, 16, 64])
def test_sketch_drops_a_linked_pair_with_the_stated_probability_at_most(size):
    least = near_dup.least_shared(size, 80)
    tail = [sum(math.comb(size, i) * .8 ** i * .2 ** (size - i) for i in range(cut)) for cut in (least, least + 1)]
    assert tail[0] <= near_dup.MISS < tail[1]


def with_neighbour(bits):
    return (bits & (bits >> 1 | bits << 1)).bit_count()


def test_values_with_a_neighbour_shared_by_linked_pairs(monkeypatch):
    size, t = 14, .8
    tail = [0.0] * (size + 2)
    for bits in range(1 << size):
        for cut in range(with_neighbour(bits) + 1, size + 2):
            tail[cut] += t ** bits.bit_count() * (1 - t) ** (size - bits.bit_count())
    for miss in (1e-2, 1e-4, 1e-6):
        monkeypatch.setattr(near_dup, "MISS", miss)
        least = near_dup.least_beside(size, 80)
        assert tail[least] <= miss < tail[least + 1]
    # sets held whole: any order of a union whose shared part is percent or more
    for percent in (75, 80, 95):
        for union in range(2, 15):
            for bits in range((1 << union) - 1):
                if 100 * bits.bit_count() >= percent * union:
                    assert with_neighbour(bits) >= max(1, -(-(2 * percent - 100) * union // 100))


def test_exact_groups(docs, no_docs, spark):
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if u == t]
        low = min([j for j in ids if j is not None], default=None)
        want.append((i, low, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.content_groups(docs).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len({t for _, t in rows})
    assert exact_dedup.content_groups(no_docs).collect() == []
    stage = exact_dedup.stage_exact_dedup(spark, docs, SF)
    assert stage.columns == docs.columns and stage.count() == len({t for _, t in rows})


def test_exact_groups_split_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPLITS", 20)
    rows = [(i, "hot  text" if i % 3 else f"text {i % 50}") for i in range(1, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.content_groups(df).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t] if i < 60 else None
        if same:
            assert got[i] == (min(same), len(same), i == min(same))
    assert sum(k for _, _, k in got.values()) == 51


def brute_removed(rows, length):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for p in range(len(d) - length + 1):
            w = d[p:p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(d), sum(gone), runs, bytes(c for c, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [20, 200])
def test_repeats_equal_brute_force(spark, length):
    rows = with_copies(spark)[:330]
    shared = rows[0][1][:333]
    rows += [(900_000 + k, f"{'x' * k} lead {k} " + shared[k:] + f" tail {k}") for k in range(40)] + [(910_000, "ab" * 400), (910_001, "z" * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length).collect()]
    assert sorted(got) == sorted(brute_removed(rows, length))


def test_repeats_of_awkward_rows(docs, no_docs):
    small = docs.where("doc_id is null or doc_id not in (10, 11)")
    rows = [(r.doc_id, r.text) for r in small.collect()]
    got = [(r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(small, 30).collect()]
    assert sorted(got, key=key) == sorted(brute_removed(rows, 30), key=key)
    assert suffix_dedup.remove_repeats(no_docs).collect() == []
    assert suffix_dedup.remove_repeats(docs).where("id in (10, 11)").selectExpr("n_bytes > 300000", "size(spans) >= 1").distinct().count() == 1


def test_components(spark):
    edges = [(5, 3), (3, 9), (10, 11), (11, 12), (12, 10), (7, 7), (None, 1), (20, 21)] + [(100, 200 + i) for i in range(50)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert got[9] == got[5] == got[3] == 3 and got[12] == 10 and 7 not in got and got[21] == 20
    assert {got[200 + i] for i in range(50)} == {100} and {got[1000 + i] for i in range(41)} == {1000}
    assert connected_components(df.where("false"), Scratch(spark, "test")).collect() == []
