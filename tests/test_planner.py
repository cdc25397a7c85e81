"""Planner output against the hand-checked plan of the search table, and Korean cases of their own."""
import random
import time
from decimal import Decimal

from tidewater.jobs.search_fixture import FIELDS, searches
from tidewater.jobs.search_jobs import EXPECTED_PHRASES, EXPECTED_PLAN
from tidewater.plans.lexicon import DOCS_LEXICON, Lexicon
from tidewater.plans.limits import CATALOGUE_LIMITS, SearchLimits
from tidewater.plans.query_plan import bound_searches, fix_spelling, plan_searches
from tidewater.scratch import Scratch
from tidewater.sources.local import literal_frame

KOREAN = Lexicon(generic=["지원", "사업"], intent=["찾기"], synonym_groups=[["가게", "점포"], ["꽃집"]],
                 spelling=[("가개", "가게")], compounds=[("꽃가게", ["꽃집", "가게"])])


def plan_of(spark, texts, lex, limits=SearchLimits()):
    rows = [(i, t, "", False, 1, 20) for i, t in enumerate(texts)]
    return plan_searches(literal_frame(spark, rows, FIELDS), lex, lex.frames(spark), limits)


def test_plan_terms(spark):
    plan = plan_searches(searches(spark), DOCS_LEXICON, DOCS_LEXICON.frames(spark))
    got = sorted(tuple(r) for r in plan.terms.collect())
    want = sorted((q, g, a, p, t, k, Decimal(w), n, prim) for (q, g, a, p, t, k, w, n, prim) in EXPECTED_PLAN)
    assert got == want
    assert sorted(tuple(r) for r in plan.phrases.collect()) == sorted(EXPECTED_PHRASES)


def test_routes(spark):
    plan = plan_searches(searches(spark), DOCS_LEXICON, DOCS_LEXICON.frames(spark))
    routes = {r.query_id: r.route for r in plan.meta.collect()}
    assert routes[8] == "browse" and routes[21] == "browse"
    assert routes[9] == "weak" and routes[22] == "weak"
    assert routes[1] == "ranked"


def test_particles_and_endings_are_stripped(spark):
    plan = plan_of(spark, ["가게에서 수리하는 꽃집을", "가개를 찾기", "수리된 수리", "나를"], KOREAN)
    terms = {}
    for r in plan.terms.collect():
        terms.setdefault((r.query_id, r.group_no), set()).add((r.term, r.kind))
    assert terms[(0, 0)] == {("가게", "exact"), ("가게에서", "exact"), ("점포", "synonym")}
    assert terms[(0, 1)] == {("수리", "exact"), ("수리하는", "exact")}
    assert terms[(0, 2)] == {("꽃집", "exact"), ("꽃집을", "exact")}
    assert ("가게", "exact") in terms[(1, 0)]
    assert (2, 1) not in terms                       # one stem, once
    assert terms[(3, 0)] == {("나를", "exact")}       # two characters must remain


def test_plan_metadata(spark):
    meta = {r.query_id: r for r in plan_of(spark, ["가개 지원 사업 찾기", "지원 사업", "꽃가게"], KOREAN).meta.collect()}
    assert [(c.src, c.dst) for c in meta[0].corrections] == [("가개", "가게")]
    assert meta[0].generic == ["지원", "사업"] and meta[0].intent == ["찾기"] and meta[0].warning is None
    assert meta[1].route == "weak" and meta[1].warning == "generic-only"
    assert meta[2].n_groups == 1


def test_bounds_are_open_unless_asked_for(spark):
    rows = literal_frame(spark, [(1, "x" * 300, "r" * 80, False, 9999, 500), (2, None, None, None, 0, None)], FIELDS)
    free = {r.query_id: r for r in bound_searches(rows).collect()}
    assert (len(free[1].q), len(free[1].region), free[1].page, free[1].page_size) == (300, 80, 9999, 500)
    assert (free[2].q, free[2].page, free[2].page_size) == ("", 1, 20)
    cut = bound_searches(rows, CATALOGUE_LIMITS).where("query_id = 1").first()
    assert (len(cut.q), len(cut.region), cut.page, cut.page_size) == (120, 50, 500, 50)


def in_turn(text, fixes):
    """The definition: every fix of the list in its order."""
    kept = []
    for src, dst in sorted(fixes, key=lambda f: -len(f[0])):
        if src in text:
            text, kept = text.replace(src, dst), kept + [(src, dst)]
    return text, kept


def spelled(spark, texts, fixes):
    t = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    f = spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(fixes)], "src string, dst string, no long")
    return {r.query_id: (r.text, [(c.src, c.dst) for c in r.corrections]) for r in fix_spelling(t, f, Scratch(spark, "test")).collect()}


def test_spelling_table_equals_the_list_in_turn(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    for size in (0, 12, 60):
        fixes = [(word(rng.randint(1, 4)), word(rng.randint(0, 3))) for _ in range(size)]
        texts = [word(rng.randint(0, 12)) for _ in range(40)] + ["", "zz"]
        assert spelled(spark, texts, fixes) == {i: in_turn(t, fixes) for i, t in enumerate(texts)}
    # a chain: each fix makes the place of the next, shorter one
    chain = [("abcd", "efg"), ("efg", "hi"), ("hi", "j"), ("j", "abcd")]
    assert spelled(spark, ["x abcd y abcd"], chain) == {0: in_turn("x abcd y abcd", chain)}


def test_large_lexicon(spark):
    """100,000 fixes and words each, as tables: the plan holds none of them, and planning takes seconds."""
    n = spark.range(100_000)
    spelling = n.selectExpr("concat('wrnog', id, 'x') AS src", "concat('right', id) AS dst", "id AS no")
    classes = n.selectExpr("concat('plain', id) AS word", "if(id % 2 = 0, 'generic', 'intent') AS cls").unionAll(
        n.where("id = 4").selectExpr("'plain4' AS word", "'intent' AS cls"))
    lex = Lexicon(suffixes=[])
    rows = literal_frame(spark, [(i, f"wrnog{i * 997}x plain{i} plain{i + 1} word", "", False, 1, 20) for i in range(100)], FIELDS)
    start = time.time()
    meta = {r.query_id: r for r in plan_searches(rows, lex, lex.frames(spark, spelling, classes)).meta.collect()}
    assert time.time() - start < 60
    for i in range(100):
        even, odd = (f"plain{i}", f"plain{i + 1}") if i % 2 == 0 else (f"plain{i + 1}", f"plain{i}")
        intent = {odd} | ({even} if even == "plain4" else set())
        assert meta[i].normalized == f"right{i * 997} plain{i} plain{i + 1} word" and meta[i].corrections[0].src == f"wrnog{i * 997}x"
        assert set(meta[i].intent) == intent and set(meta[i].generic) == {even, odd} - intent
        assert [p.primary for p in meta[i].primaries] == [f"right{i * 997}", "word"]
