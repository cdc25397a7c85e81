"""WARC round trip, url filter, mixing and the pipeline."""
import hashlib


import duckdb
import pytest

import corpus_pipeline
from tidewater.llm import mixing, quality, url_filter, warc
from tidewater.llm.jobs import oracle_sql, queries
from tidewater.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, host string, digest string, file string, n int"


def key(x):
    return tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=key)
    cur = con.execute(oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == sorted([tuple(r[have.index(c)] for c in cols) for r in cur.fetchall()], key=key)


def test_warc_round_trip(spark):
    big = "<p>größe</p>" * 200
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (None, "http://a/x", big), (4, "http://a/4", "small"), (5, "u\r\nv%", "small"),
            (6, "http://a/6", None), (8, "http://a/8", ""), (9, "http://a/9", "WARC/1.1\r\n\r\n" * 300), (9, "http://a/9", "WARC/1.1\r\n\r\n" * 300)]
    pages = spark.createDataFrame([(*r, "h", "d", "f", 1) for r in rows], PAGES)
    scratch = Scratch(spark, "test")
    folder = scratch.folder("archive")
    index = warc.write_archive(pages, folder, scratch)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    want = []
    for i, u, h in rows:
        again = h == big and i != 7
        want.append((i, u, "revisit" if again else "response", 7 if again else None, hashlib.sha1((h or "").encode()).hexdigest(), None if again else (h or "").encode()))
    assert sorted([(r.page_id, r.url, r.record_type, r.refers_to, r.digest, bytes(r.payload) if r.payload is not None else None) for r in got], key=key) == sorted(want, key=key)
    some = index.where("page_id = 4")
    assert [bytes(r.payload) for r in warc.read_records(some, folder).collect()] == [b"small"]
    assert warc.write_archive(pages.where("false"), scratch.folder("none"), scratch).collect() == []


def test_url_filter_follows_links(spark):
    rows = [(1, "https://a.example.net/es/1", ""), (2, "http://b.example.org/x", '<link rel="canonical" href="https://a.example.net/es/1">'),
            (3, "http://c.example.org/y", '<meta http-equiv="Refresh" content="0; url=http://b.example.org/x">'),
            (4, "http://d.example.com/z", '<link rel=canonical href=https://a.example.net/es/1>'), (5, "http://clean.example.org/", "<p>"), (6, None, None),
            (7, "no address", "x"), (8, "http://B.example.org/x#frag", ""), (9, "https://www.EXAMPLE.com/en/p", ""), (10, "https://m.example.com/en/p?q=://", ""),
            (None, "http://c.example.org/y", None), (11, "http://e.example.org/f/g", '<link rel="canonical" href="../x">'), (12, "http://evilexample.com/en/", "")]
    pages = spark.createDataFrame([(*r, "h", "d", "f", 1) for r in rows], PAGES)
    got = {(r.id, r.url): r for r in url_filter.judge_urls(pages).collect()}
    verdict = {k[0]: (r.verdict, r.decided_by, r.rule) for k, r in got.items()}
    assert verdict[1] == ("block", "rule", "net/es/") and verdict[2] == ("block", "alias", None) and verdict[3] == ("block", "alias", None)
    assert verdict[4] == ("allow", "rule", "com/") and verdict[5] == ("allow", "default", None) and verdict[6] == ("allow", "default", None)
    assert verdict[7] == ("allow", "default", None) and verdict[8] == ("allow", "default", None) and verdict[None] == ("block", "alias", None)
    assert verdict[9] == ("allow", "rule", "www.example.com/en/") and verdict[10] == ("block", "rule", "example.com/en/") and verdict[12][2] == "com/"
    assert got[(7, "no address")].host == "" and got[(6, None)].path == ""
    assert len(got) == len(rows) and url_filter.judge_urls(pages.where("false")).collect() == []
    # other forms of one url are aliases only where the caller, or the crawl's log, says so
    forms = {r.id: r.verdict for r in url_filter.judge_urls(pages, same_form=True).collect()}
    assert forms[8] == "block" and forms[5] == "allow"
    log = spark.createDataFrame([("http://B.example.org/x#frag", "http://hop.example.org/"), ("http://hop.example.org/", "https://a.example.net/es/9")], "source string, target string")
    logged = {r.id: (r.verdict, r.decided_by) for r in url_filter.judge_urls(pages, edges=log).collect()}
    assert logged[8] == ("block", "alias") and logged[5] == ("allow", "default")


def test_url_filter_sql_over_links(spark, tmp_path):
    """The query equals its SQL on pages that do hold links: chains, relative targets, cycles, capitals."""
    rows = []
    for i in range(200):
        tail = ["https://s%d.example.net/es/%d" % (i % 4, i), "http://s%d.example.org/a/%d" % (i % 5, i), "https://m.example.com/en/%d" % i][i % 3]
        to = ["../%d" % (i + 2), "/a/%d" % (i - 1), "https://s0.example.net/es/%d" % (i % 12 * 3), "http://s%d.example.org/a/%d" % ((i + 3) % 5, i + 3)][i % 4]
        html = [f'<LINK REL="CANONICAL" HREF="{to}">', f'<meta http-equiv="refresh" content="0; url={to}">', "<p>none</p>", None][i % 7 % 4]
        rows.append((i, tail, html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict, decided_by FROM ({url_filter.OP6_SQL})").fetchall()
    got = [tuple(r) for r in url_filter.op6_url_filter(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(r[5] == "alias" for r in got) >= 5


def test_mixing_budgets(spark, docs, no_docs):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 5), ("d1", "de", "d", 400), ("d0", "de", "z", 0)],
                                   "domain string, lang string, source string, supply long")
    from pyspark.sql import functions as F
    got = {(r.domain, r.source): r.budget for r in mixing.leaf_budgets(leaves, F.lit(1000).cast("long"), 2).collect()}
    assert got[("d0", "a")] == 20 and got[("d0", "b")] == 380 and got[("d1", "c")] == 10 and got[("d1", "d")] == 590 and got[("d0", "z")] == 0
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.copies <= 2 for r in out)
    assert mixing.mix(no_docs).collect() == []
    mixed = mixing.stage_mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_pipeline_equals_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = sorted(r.row.doc_id for r in quality.judge(docs, model).collect() if r.kept)
    import re
    seen, exact = set(), []
    for i in good:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text)
        if t not in seen:
            seen.add(t)
            exact.append(i)
    from .test_exact_and_near import brute_components
    near = [d for d, _, c in brute_components([(i, rows[i].text) for i in exact], 5, 80) if d == c]
    left = docs.where(docs.doc_id.isin(near))
    con = duckdb.connect()
    con.register("documents", left.toPandas())
    cur = con.execute(mixing.OP5_SQL)
    names = [d[0] for d in cur.description]
    copies = {r[names.index("doc_id")]: r[names.index("copies")] for r in cur.fetchall()}
    want = sorted(i for i, n in copies.items() for _ in range(n))
    got = queries()["pipeline"](spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_stages_take_awkward_rows(spark, docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, no_docs, SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SF).collect() == []

