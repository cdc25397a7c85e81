"""Plan-shape checks: no Cartesian product, no nested loop, no Python on corpus paths, few exchanges."""
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidewater.jobs.search_fixture import searches
from tidewater.jobs.search_jobs import index_of
from tidewater.operators import search as S
from tidewater.plans.lexicon import DOCS_LEXICON
from tidewater.plans.query_plan import plan_searches
from tidewater.registry import queries
from tidewater.sources import tables as T

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_has_no_cartesian(spark):
    assert "CartesianProduct" not in plan_text(queries()["m6_top_matches"](spark, SF))


def test_normalization_stays_in_jvm(spark):
    txt = plan_text(queries()["n14_classify_feed"](spark, SF))
    assert "BatchEvalPython" not in txt and "ArrowEvalPython" not in txt


def test_scan_is_pruned(spark):
    txt = plan_text(queries()["a2_portal_breakdown"](spark, SF))
    assert "html" not in txt.split("ReadSchema")[1].split("\n")[0]


def test_search_meets_terms_by_equi_join(spark):
    terms = spark.createDataFrame([("license",), ("ai",)], "lterm string")
    txt = plan_text(S.term_hits(T.notices(spark, SF), terms))
    assert "NestedLoop" not in txt and "CartesianProduct" not in txt and "Python" not in txt.replace("PythonRDD", "")


def test_search_shuffles_no_text_without_broadcast(spark):
    """With every broadcast off, the exchanges of the term search carry ids, pieces and terms only."""
    terms = spark.createDataFrame([("license",), ("ai",)], "lterm string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        hits = S.term_hits(T.notices(spark, SF), terms)
        plan = hits._jdf.queryExecution().executedPlan()
        txt = plan.toString()
        assert hits.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in txt and "Exchange" in txt and "search_blob" in txt
    lines = txt.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "Exchange" in line:
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                assert "search_blob" not in below and "l_body" not in below, below


def test_index_is_built_once_for_all_searches(spark):
    a, b = index_of(spark, SF), index_of(spark, SF)
    assert a is b and a.postings.columns == ["program_id", "piece"]


def test_pages_are_selected_before_they_are_sorted(spark):
    rnd = random.Random(3)
    rows = []
    for q in range(6):
        for i in range(900):
            rows.append((q, i, rnd.choice(["same name", "same nbme", "", f"n{rnd.randrange(9)}", None]), rnd.random() < 0.5,
                         rnd.choice([None, dt.date(2026, 1, rnd.randrange(1, 4))]), rnd.choice([1, 1, 4]), rnd.choice([None, 1.5, 2.25]) if q else None))
    df = spark.createDataFrame(rows, "query_id int, program_id int, name string, is_open boolean, period_end date, tier_num int, score_dec double")
    df = df.withColumn("score_dec", F.col("score_dec").cast("decimal(20,6)")).repartition(5)
    pages = [(0, 0, 20), (1, 20, 40), (2, 700, 750), (3, 880, 920), (4, 2000, 2020), (5, 0, 1)]
    got = S.page_rows(S.with_bar(df), spark.createDataFrame(pages, "query_id int, lo long, hi long")).select("query_id", "program_id", "rank").collect()
    want = []
    for q, lo, hi in pages:
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[5], r[6] is None, -(r[6] or 0), not r[3], r[4] is None, r[4] or dt.date.max, r[2] is not None, r[2] or "", r[1]))
        want += [(q, r[1], i + 1) for i, r in enumerate(mine) if lo < i + 1 <= hi]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_deep_page_sorts_its_own_rows_only(spark):
    df = spark.range(20000).selectExpr("1 as query_id", "id as program_id", "concat('n', id % 500) as name", "true as is_open", "date_add(date'2026-01-01', cast(id % 300 as int)) as period_end",
                                       "1 as tier_num", "cast(null as decimal(20,6)) as score_dec")
    pages = spark.createDataFrame([(1, 15000, 15020)], "query_id int, lo long, hi long")
    rows = S.with_bar(df)
    bars = rows.groupBy("query_id", *S.BAR).agg(F.count(F.lit(1)).alias("n")).join(pages, "query_id").withColumn("base", F.lit(0).cast("long"))
    kept = S.overlapping(bars, ["query_id"], S.BAR).agg(F.sum("n")).first()[0]
    assert kept <= 2 * 67 and S.page_rows(rows, pages).count() == 20


def test_search_result_plan_is_small(spark):
    frames = DOCS_LEXICON.frames(spark)
    res = S.search(T.notices(spark, SF), plan_searches(searches(spark), DOCS_LEXICON, frames), frames, T.AS_OF)
    txt = plan_text(res.rows)
    assert len(re.findall(r"\bExchange\b", txt)) < 20
    assert "NestedLoop" not in txt and "CartesianProduct" not in txt
    res.scratch.close()


def test_short_terms_and_text_ends_are_found(spark):
    n = spark.createDataFrame([(1, "ab"), (2, "xyab"), (3, "a b"), (4, ""), (5, "서울")], "program_id long, name string")
    n = n.select("*", *[F.lit("").alias(c) for c in ("field", "tags_text", "summary", "agency", "body_text")]).withColumn("search_blob", F.lower("name"))
    terms = spark.createDataFrame([("b",), ("ab",), ("xyab",), ("울",), ("a b",)], "lterm string")
    got = {(r.program_id, r.lterm) for r in S.term_hits(n, terms).collect()}
    # b and ab are acronyms: no letter or digit beside them
    assert got == {(3, "b"), (1, "ab"), (2, "xyab"), (5, "울"), (3, "a b")}


def test_index_keeps_a_text_once_and_search_sorts_none(spark):
    from tidewater.operators.search_index import build_index
    index = build_index(T.notices(spark, SF))
    stored = spark.read.parquet(f"{index.scratch.base}/001-documents")
    assert stored.where("search_blob is not null").count() == 0  # it is the fields in a row
    blobs = {r.program_id: r.search_blob for r in T.notices(spark, SF).select("program_id", "search_blob").collect()}
    assert {r.program_id: r.search_blob for r in index.documents.select("program_id", "search_blob").collect()} == blobs
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        txt = plan_text(S.term_hits(index, spark.createDataFrame([("license",), ("ai",)], "lterm string")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = txt.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    for i, line in enumerate(lines):
        if " Sort [" in line:
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                assert "l_body" not in below, below


def test_acronyms_beside_signs_and_patterns(spark):
    texts = ["c++x", "a c++ b", "c+++", "xc++", "a.b", "axb", "r&d", "r&dx", "ab\n", "été", "été2", "ai,", "ai2"]
    n = spark.createDataFrame(list(enumerate(texts)), "program_id long, name string")
    n = n.select("*", *[F.lit("").alias(c) for c in ("field", "tags_text", "summary", "agency", "body_text")]).withColumn("search_blob", F.lower("name"))
    terms = ["c++", "a.b", "r&d", "ab", "t", "ai", "\\e(", "+"]
    got = {(r.program_id, r.lterm) for r in S.term_hits(n, spark.createDataFrame([(t,) for t in terms], "lterm string")).collect()}
    alone = lambda t, x: re.search("(^|[^a-z0-9])" + re.escape(t) + "([^a-z0-9]|$)", x)
    assert got == {(i, t) for i, x in enumerate(texts) for t in terms if alone(t, x)} and len(got) > 6


def test_piece_codes_equal_plain_pieces(spark):
    from tidewater.operators.search_index import piece_codes
    rnd = random.Random(5)
    for _ in range(50):
        texts = ["".join(rnd.choice("ab c서😀") for _ in range(rnd.choice([0, 1, 2, 3, 30]))) for _ in range(6)]
        code = lambda p: sum(ord(c) << 42 - 21 * k for k, c in enumerate(p))
        want = sorted({(i, code(t[at:at + n])) for i, t in enumerate(texts) for n in (1, 2, 3) for at in range(len(t))})
        row, got = piece_codes(texts, True)
        assert list(zip(row.tolist(), got.tolist())) == want
