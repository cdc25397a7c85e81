"""Search jobs over the documents corpus (R1-R28, planner Q1-Q12 feeding them)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.jobs.search_fixture import SEARCHES, searches
from tidewater.operators import search as S
from tidewater.operators.search_index import shared_index
from tidewater.plans.lexicon import DOCS_LEXICON
from tidewater.plans.limits import CATALOGUE_LIMITS
from tidewater.plans.query_plan import plan_searches
from tidewater.registry import job
from tidewater.sources import tables as T
from tidewater.sources.local import literal_frame
from tidewater.sources.oracle_bindings import NOTICES_CTE, with_ctes


def index_of(spark, sf):
    """The session's index of the documents: built by the first job that searches them."""
    return shared_index(T.notices(spark, sf), f"{sf.rstrip('/')}/documents.parquet")


def run_search(spark, sf):
    frames = DOCS_LEXICON.frames(spark)
    plan = plan_searches(searches(spark), DOCS_LEXICON, frames, CATALOGUE_LIMITS)
    return S.search(index_of(spark, sf), plan, frames, T.AS_OF), plan


# ---------------------------------------------------------------------------
# Oracle: the expected plan of SEARCHES under DOCS_LEXICON (checked rule by rule
# in tests/test_planner.py) plus an independent SQL execution of R1-R28.
# ---------------------------------------------------------------------------

# (query_id, group_no, alt_no, part_no, term, kind, weight, alt_size, primary)
def _g(q, g, prim, alts):
    return [(q, g, a, p, t, k, w, n, prim) for (a, p, t, k, w, n) in alts]


LIC = [(0, 0, "license", "exact", "0.90", 1), (11, 0, "licensed", "synonym", "0.75", 1),
       (12, 0, "licence", "synonym", "0.75", 1)]
APA = [(0, 0, "apache", "exact", "0.90", 1), (11, 0, "mit", "synonym", "0.75", 1),
       (12, 0, "gnu", "synonym", "0.75", 1)]
JOINED = [(200, 0, "apachelicense", "compound-joined", "1.00", 1)]
EXPECTED_PLAN = (
    _g(1, 0, "license", LIC)
    + _g(2, 0, "apache", APA + JOINED) + _g(2, 1, "license", LIC)
    + _g(3, 0, "der", [(0, 0, "der", "exact", "0.90", 1)])
    + _g(4, 0, "version", [(0, 0, "version", "exact", "0.90", 1), (11, 0, "release", "synonym", "0.75", 1)])
    + _g(5, 0, "tion", [(0, 0, "tion", "exact", "0.90", 1)])
    + _g(5, 1, "schpf", [(0, 0, "schpf", "exact", "0.90", 1)])
    + _g(6, 0, "password", [(0, 0, "password", "exact", "0.90", 1)])
    + _g(7, 0, "cookie", [(0, 0, "cookie", "exact", "0.90", 1)])
    + _g(7, 1, "jar", [(0, 0, "jar", "exact", "0.90", 1)])
    + _g(10, 0, "license", LIC)
    + _g(11, 0, "mit", [(0, 0, "mit", "exact", "0.90", 1), (10, 0, "apache", "synonym", "0.75", 1),
                        (12, 0, "gnu", "synonym", "0.75", 1)])
    + _g(12, 0, "license", LIC)
    + _g(13, 0, "tion", [(0, 0, "tion", "exact", "0.90", 1)])
    + _g(14, 0, "apachelicense", [(0, 0, "apachelicense", "exact", "0.90", 1),
                                  (100, 0, "apache", "compound", "0.45", 2),
                                  (100, 1, "license", "compound", "0.45", 2)])
    + _g(15, 0, "licence", [(0, 0, "licence", "exact", "0.90", 1), (10, 0, "license", "synonym", "0.75", 1),
                            (11, 0, "licensed", "synonym", "0.75", 1)])
    + _g(16, 0, "ai", [(0, 0, "ai", "exact", "0.90", 1)])
    + _g(17, 0, "zzqx", [(0, 0, "zzqx", "exact", "0.90", 1)])
    + _g(18, 0, "der", [(0, 0, "der", "exact", "0.90", 1)])
    + _g(19, 0, "token", [(0, 0, "token", "exact", "0.90", 1), (11, 0, "secret", "synonym", "0.75", 1)])
    + _g(19, 1, "gratis", [(0, 0, "gratis", "exact", "0.90", 1), (10, 0, "free", "synonym", "0.75", 1)])
    + _g(20, 0, "apache", APA + JOINED) + _g(20, 1, "license", LIC)
    + _g(23, 0, "schpf", [(0, 0, "schpf", "exact", "0.90", 1)])
    + _g(23, 1, "und", [(0, 0, "und", "exact", "0.90", 1)])
    + _g(23, 2, "les", [(0, 0, "les", "exact", "0.90", 1)])
    + _g(23, 3, "que", [(0, 0, "que", "exact", "0.90", 1)])
    + _g(24, 0, "mitlicense", [(0, 0, "mitlicense", "exact", "0.90", 1), (100, 0, "mit", "compound", "0.45", 2),
                               (100, 1, "license", "compound", "0.45", 2)])
)
EXPECTED_PHRASES = [(4, 0, "apache license"), (18, 0, "zzqx qq")]
# (query_id, route, n_groups, n_phrases, weak words in order)
EXPECTED_META = {1: ("ranked", 1, 0), 2: ("ranked", 2, 0), 3: ("ranked", 1, 0), 4: ("ranked", 1, 1),
                 5: ("ranked", 2, 0), 6: ("ranked", 1, 0), 7: ("ranked", 2, 0), 8: ("browse", 0, 0),
                 9: ("weak", 0, 0), 10: ("ranked", 1, 0), 11: ("ranked", 1, 0), 12: ("ranked", 1, 0),
                 13: ("ranked", 1, 0), 14: ("ranked", 1, 0), 15: ("ranked", 1, 0), 16: ("ranked", 1, 0),
                 17: ("ranked", 1, 0), 18: ("ranked", 1, 1), 19: ("ranked", 2, 0), 20: ("ranked", 2, 0),
                 21: ("browse", 0, 0), 22: ("weak", 0, 0), 23: ("ranked", 4, 0), 24: ("ranked", 1, 0)}
EXPECTED_WEAK = [(9, 0, "the"), (9, 1, "and"), (22, 0, "under"), (22, 1, "find")]

# (query_id, normalized text, corrections, ignored words, warning)
EXPECTED_TEXT = [(i, {10: "license", 20: "apache license"}.get(i, q), {10: "licnese>license"}.get(i, ""),
                  {3: "the", 4: "", 9: "the and", 22: "under find"}.get(i, ""), "generic-only" if i in (9, 22) else "")
                 for i, q, *_ in SEARCHES]


def _q(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _values(rows) -> str:
    return ",\n  ".join("(" + ", ".join(_q(x) for x in r) + ")" for r in rows)


def _lexicon_values():
    seeds, dterms = [], []
    for order, (seed, keys) in enumerate(DOCS_LEXICON.seeds.items()):
        for k_no, k in enumerate(keys):
            seeds.append((seed, order, k_no, k))
    for key, (label, agencies, terms) in DOCS_LEXICON.domains.items():
        for pos, t in enumerate(list(agencies) + list(terms)):
            dterms.append((key, label, pos, t))
    return seeds, dterms


def _search_sql() -> str:
    seeds, dterms = _lexicon_values()
    meta_rows = [(qid, r, n, p) for qid, (r, n, p) in EXPECTED_META.items()]
    return with_ctes(NOTICES_CTE) + f""",
searches(query_id, q, region, open_only, page, page_size) AS (VALUES
  {_values(SEARCHES)}),
meta0(query_id, route, n_groups, n_phrases) AS (VALUES
  {_values(meta_rows)}),
meta AS (SELECT m.*, s.region AS q_region, s.open_only, s.page, s.page_size
         FROM meta0 m JOIN searches s USING (query_id)),
plan(query_id, group_no, alt_no, part_no, term, kind, weight, alt_size, prim) AS (VALUES
  {_values([(a, b, c, d, e, f, g, h, i) for (a, b, c, d, e, f, g, h, i) in EXPECTED_PLAN])}),
phr(query_id, phrase_no, phrase) AS (VALUES
  {_values(EXPECTED_PHRASES)}),
weak(query_id, wpos, term) AS (VALUES
  {_values(EXPECTED_WEAK)}),
seeds(seed, seed_order, key_no, domain_key) AS (VALUES
  {_values(seeds)}),
dterms(domain_key, label, qpos, term) AS (VALUES
  {_values(dterms)}),
-- R16/R17 expansion vocabulary
words AS (
  SELECT query_id, trim(w) AS word, min(o) AS o FROM (
    SELECT query_id, prim AS w, [0, group_no, 0, 0] AS o FROM plan
    UNION ALL SELECT query_id, term, [1, group_no, alt_no, part_no] FROM plan) x
  WHERE trim(w) <> '' GROUP BY 1, 2),
seed_keys AS (SELECT DISTINCT seed, seed_order FROM seeds),
cand AS (
  SELECT w.query_id, w.word, w.o, s.seed, 0 AS how, 0 AS neg_len, s.seed_order
  FROM words w JOIN seed_keys s ON w.word = s.seed
  UNION ALL
  SELECT w.query_id, w.word, w.o, s.seed, 1, -length(s.seed), s.seed_order
  FROM words w JOIN seed_keys s ON length(s.seed) >= 2 AND contains(w.word, s.seed)
                                AND length(w.word) > length(s.seed)),
best_word AS (SELECT query_id, word, o, arg_min(seed, [how, neg_len, seed_order]) AS seed
              FROM cand GROUP BY 1, 2, 3),
chosen AS (SELECT query_id, arg_min(seed, o) AS seed FROM best_word GROUP BY 1),
doms AS (SELECT c.query_id, s.key_no, s.domain_key FROM chosen c JOIN seeds s USING (seed) WHERE s.key_no < 2),
picked0 AS (SELECT d.query_id, t.term, min([t.qpos, d.key_no]) AS r
            FROM doms d JOIN dterms t USING (domain_key) GROUP BY 1, 2),
picked AS (SELECT query_id, term, rk FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rk FROM picked0) WHERE rk <= 12),
labels AS (SELECT query_id, string_agg(label, ' · ' ORDER BY key_no) AS dlabel
           FROM (SELECT DISTINCT d.query_id, d.key_no, t.label FROM doms d JOIN dterms t USING (domain_key)) GROUP BY 1),
-- R1-R3 term hits
all_terms AS (
  SELECT DISTINCT lower(term) AS lt FROM plan WHERE query_id IN (SELECT query_id FROM meta WHERE route = 'ranked')
  UNION SELECT lower(phrase) FROM phr
  UNION SELECT lower(term) FROM weak
  UNION SELECT lower(term) FROM picked),
terms AS (SELECT lt, regexp_matches(lt, '^[A-Za-z0-9&.+#-]{{1,3}}$') AS acro,
                 '(^|[^a-z0-9])' || regexp_replace(lt, '([^a-z0-9])', '\\\\\\1', 'g') || '([^a-z0-9]|$)' AS pat
          FROM all_terms WHERE lt <> ''),
hits AS (
  SELECT n.program_id, n.name, n.region, n.is_open, n.period_end, t.lt,
    (CASE WHEN (CASE WHEN t.acro THEN regexp_matches(lower(coalesce(n.name,'')), t.pat) ELSE contains(lower(coalesce(n.name,'')), t.lt) END) THEN 50 ELSE 0 END
   + CASE WHEN (CASE WHEN t.acro THEN regexp_matches(lower(coalesce(n.field,'')), t.pat) ELSE contains(lower(coalesce(n.field,'')), t.lt) END) THEN 40 ELSE 0 END
   + CASE WHEN (CASE WHEN t.acro THEN regexp_matches(lower(coalesce(n.tags_text,'')), t.pat) ELSE contains(lower(coalesce(n.tags_text,'')), t.lt) END) THEN 30 ELSE 0 END
   + CASE WHEN (CASE WHEN t.acro THEN regexp_matches(lower(coalesce(n.summary,'')), t.pat) ELSE contains(lower(coalesce(n.summary,'')), t.lt) END) THEN 20 ELSE 0 END
   + CASE WHEN (CASE WHEN t.acro THEN regexp_matches(lower(coalesce(n.body_text,'')), t.pat) ELSE contains(lower(coalesce(n.body_text,'')), t.lt) END) THEN 10 ELSE 0 END
   + CASE WHEN (CASE WHEN t.acro THEN regexp_matches(lower(coalesce(n.agency,'')), t.pat) ELSE contains(lower(coalesce(n.agency,'')), t.lt) END) THEN 2 ELSE 0 END) AS sc,
    (contains(lower(coalesce(n.name,'')), t.lt) OR contains(lower(coalesce(n.summary,'')), t.lt)
     OR contains(lower(coalesce(n.field,'')), t.lt)) AS psf
  FROM notices n JOIN terms t
    ON CASE WHEN t.acro THEN regexp_matches(n.search_blob, t.pat) ELSE contains(n.search_blob, t.lt) END),
ndocs AS (SELECT count(*) AS n FROM notices),
-- R5-R10 ranked route
rplan AS (SELECT * FROM plan WHERE query_id IN (SELECT query_id FROM meta WHERE route = 'ranked')),
alt AS (
  SELECT p.query_id, p.group_no, p.alt_no, h.program_id, h.name, h.region, h.is_open, h.period_end,
         any_value(p.kind) AS kind, any_value(p.weight) AS weight, any_value(p.alt_size) AS alt_size,
         count(DISTINCT CASE WHEN h.sc > 0 THEN p.part_no END) AS n_pos,
         count(DISTINCT p.part_no) AS n_blob, min(h.sc) AS min_sc
  FROM hits h JOIN rplan p ON h.lt = lower(p.term)
  GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
gdf AS (
  SELECT g.query_id, g.group_no, g.prim,
         (SELECT count(DISTINCT a.program_id) FROM alt a WHERE a.query_id = g.query_id
            AND a.group_no = g.group_no AND a.n_blob = a.alt_size) AS df
  FROM (SELECT DISTINCT query_id, group_no, prim FROM rplan) g),
gidf AS (
  SELECT query_id, group_no, df,
         CAST(round(CASE WHEN n <= 1 THEN 1.0 ELSE 1 + ln(n / (1 + df)) / ln(n) END, 4) AS DECIMAL(5,4)) AS idf
  FROM gdf, ndocs),
grp AS (
  SELECT a.query_id, a.group_no, a.program_id, a.name, a.region, a.is_open, a.period_end,
         max(CASE WHEN a.n_pos = a.alt_size THEN CAST(a.min_sc AS DECIMAL(10,0)) * CAST(a.weight AS DECIMAL(3,2))
                  ELSE 0 END) * any_value(i.idf) AS gs,
         bool_or(a.kind IN ('exact', 'compound-joined') AND a.n_pos = a.alt_size) AS gx
  FROM alt a JOIN gidf i USING (query_id, group_no)
  GROUP BY 1, 2, 3, 4, 5, 6, 7),
dg AS (
  SELECT query_id, program_id, name, region, is_open, period_end, sum(gs) AS gsum,
         count(*) FILTER (WHERE gs > 0) AS n_hit, count(*) FILTER (WHERE gx) AS n_exact,
         list_sort(list(group_no) FILTER (WHERE gs > 0)) AS matched_nos
  FROM grp GROUP BY 1, 2, 3, 4, 5, 6),
dp AS (
  SELECT p.query_id, h.program_id, h.name, h.region, h.is_open, h.period_end, sum(h.sc) AS psum,
         count(DISTINCT CASE WHEN h.psf AND h.sc > 0 THEN p.phrase_no END) AS p_ok
  FROM hits h JOIN phr p ON h.lt = lower(p.phrase)
  GROUP BY 1, 2, 3, 4, 5, 6),
scored AS (
  SELECT coalesce(dg.query_id, dp.query_id) AS query_id,
         coalesce(dg.program_id, dp.program_id) AS program_id,
         coalesce(dg.name, dp.name) AS name, coalesce(dg.region, dp.region) AS region,
         coalesce(dg.is_open, dp.is_open) AS is_open, coalesce(dg.period_end, dp.period_end) AS period_end,
         coalesce(dg.gsum, 0) + coalesce(dp.psum, 0) AS score_dec,
         coalesce(dg.n_hit, 0) AS n_hit, coalesce(dg.n_exact, 0) AS n_exact,
         coalesce(dg.matched_nos, []) AS matched_nos, coalesce(dp.p_ok, 0) AS p_ok
  FROM dg FULL OUTER JOIN dp ON dg.query_id = dp.query_id AND dg.program_id = dp.program_id),
sf AS (
  SELECT s.*, m.n_groups, m.n_phrases FROM scored s JOIN meta m USING (query_id)
  WHERE (m.n_phrases = 0 OR s.p_ok = m.n_phrases)
    AND (m.q_region = '' OR s.region = m.q_region OR s.region = '전국')
    AND (NOT m.open_only OR (s.is_open AND (s.period_end IS NULL OR s.period_end >= DATE '2026-06-01')))),
modes AS (
  SELECT m.query_id, m.n_groups,
         coalesce((SELECT count(*) FROM sf WHERE sf.query_id = m.query_id AND sf.n_hit = m.n_groups), 0) AS strict_count,
         coalesce((SELECT max(n_hit) FROM sf WHERE sf.query_id = m.query_id), 0) AS max_hit
  FROM meta m WHERE m.route = 'ranked'),
modes2 AS (
  SELECT query_id, strict_count,
         CASE WHEN strict_count >= 5 OR n_groups <= 1 THEN n_groups
              WHEN max_hit >= greatest(1, CAST(ceil(n_groups / 2) AS INTEGER)) THEN greatest(1, CAST(ceil(n_groups / 2) AS INTEGER))
              ELSE 1 END AS threshold,
         NOT (strict_count >= 5 OR n_groups <= 1) AS relaxed
  FROM modes),
ranked AS (
  SELECT sf.*, CASE WHEN sf.n_exact = sf.n_groups AND sf.n_hit = sf.n_groups THEN 4
                    WHEN sf.n_hit = sf.n_groups THEN 3 WHEN sf.n_hit >= 1 THEN 2 ELSE 1 END AS tier_num
  FROM sf JOIN modes2 USING (query_id) WHERE sf.n_hit >= modes2.threshold),
rtot AS (SELECT query_id, count(*) AS total FROM ranked GROUP BY 1),
-- R15/R18 expansion
gate AS (
  SELECT m.query_id FROM meta m LEFT JOIN rtot r USING (query_id)
  WHERE m.route = 'ranked' AND coalesce(r.total, 0) = 0 AND m.n_phrases = 0 AND m.n_groups > 0
    AND coalesce((SELECT max(df) FROM gdf WHERE gdf.query_id = m.query_id), 0) = 0),
edocs AS (
  SELECT p.query_id, h.program_id, h.name, h.region, h.is_open, h.period_end,
         max(CAST(h.sc AS DECIMAL(10,0)) * CAST(0.75 AS DECIMAL(3,2))) * CAST(1 AS DECIMAL(5,4)) AS score_dec
  FROM hits h JOIN picked p ON h.lt = lower(p.term) JOIN gate g ON g.query_id = p.query_id
  GROUP BY 1, 2, 3, 4, 5, 6),
edf AS (
  SELECT e.* FROM edocs e JOIN meta m USING (query_id)
  WHERE e.score_dec > 0
    AND (m.q_region = '' OR e.region = m.q_region OR e.region = '전국')
    AND (NOT m.open_only OR (e.is_open AND (e.period_end IS NULL OR e.period_end >= DATE '2026-06-01')))),
use_exp AS (SELECT DISTINCT query_id FROM edf),
-- R21 weak, R22 browse
nweak AS (SELECT query_id, count(DISTINCT lower(term)) AS nw FROM weak GROUP BY 1),
wdocs AS (
  SELECT w.query_id, h.program_id, h.name, h.region, h.is_open, h.period_end
  FROM hits h JOIN weak w ON h.lt = lower(w.term)
  GROUP BY 1, 2, 3, 4, 5, 6
  HAVING count(DISTINCT h.lt) = (SELECT nw FROM nweak WHERE nweak.query_id = w.query_id)),
wf AS (
  SELECT d.* FROM wdocs d JOIN meta m USING (query_id)
  WHERE (m.q_region = '' OR d.region = m.q_region OR d.region = '전국')
    AND (NOT m.open_only OR (d.is_open AND (d.period_end IS NULL OR d.period_end >= DATE '2026-06-01')))),
bf AS (
  SELECT m.query_id, n.program_id, n.name, n.region, n.is_open, n.period_end
  FROM meta m JOIN notices n
    ON (m.q_region = '' OR n.region = m.q_region OR n.region = '전국')
   AND (NOT m.open_only OR (n.is_open AND (n.period_end IS NULL OR n.period_end >= DATE '2026-06-01')))
  WHERE m.route = 'browse'),
results AS (
  SELECT query_id, program_id, name, is_open, period_end, score_dec, tier_num, matched_nos,
         ['weak', 'partial', 'synonym', 'exact'][tier_num] AS tier, 'ranked' AS src
  FROM ranked WHERE query_id NOT IN (SELECT query_id FROM use_exp)
  UNION ALL
  SELECT query_id, program_id, name, is_open, period_end, score_dec, 3, [0], 'domain', 'domain' FROM edf
  UNION ALL
  SELECT query_id, program_id, name, is_open, period_end, NULL, 1, [], 'weak', 'weak' FROM wf
  UNION ALL
  SELECT query_id, program_id, name, is_open, period_end, NULL, 0, [], NULL, 'browse' FROM bf),
totals AS (SELECT query_id, count(*) AS total FROM results GROUP BY 1),
summary AS (
  SELECT m.query_id,
         CASE WHEN m.query_id IN (SELECT query_id FROM use_exp) THEN 'domain' ELSE m.route END AS route,
         CAST(coalesce(t.total, 0) AS BIGINT) AS total,
         CAST(greatest(1, ceil(coalesce(t.total, 0) / m.page_size)) AS BIGINT) AS total_pages,
         CASE WHEN m.query_id IN (SELECT query_id FROM use_exp) THEN true WHEN m.route = 'weak' THEN true
              ELSE coalesce(md.relaxed, false) END AS relaxed,
         CAST(coalesce(md.strict_count, 0) AS BIGINT) AS strict_count,
         m.page, m.page_size, m.n_groups, m.n_phrases
  FROM meta m LEFT JOIN totals t USING (query_id) LEFT JOIN modes2 md USING (query_id)),
ranked_all AS (
  SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY tier_num DESC, score_dec DESC NULLS LAST,
                                 is_open DESC, period_end ASC NULLS LAST, name ASC, program_id ASC) AS rnk
  FROM results r),
prims AS (SELECT query_id, list(prim ORDER BY group_no) AS prims, list(group_no ORDER BY group_no) AS gnos
          FROM (SELECT DISTINCT query_id, group_no, prim FROM plan) GROUP BY 1)
"""


SEARCH_ROWS_SQL = _search_sql() + """
SELECT r.query_id, CAST(r.rnk AS BIGINT) AS rank, r.program_id, r.tier,
       CASE WHEN r.tier_num = 0 THEN NULL
            ELSE CAST(round(coalesce(r.score_dec, 0) * 0.1, 2) AS DOUBLE) END AS score,
       CASE WHEN s.route = 'domain' THEN (SELECT dlabel FROM labels l WHERE l.query_id = r.query_id)
            ELSE coalesce(array_to_string(list_filter(p.prims, lambda x, i: list_contains(r.matched_nos, p.gnos[i])), '|'), '') END AS matched,
       CASE WHEN s.route = 'domain' THEN ''
            ELSE coalesce(array_to_string(list_filter(p.prims, lambda x, i: NOT list_contains(r.matched_nos, p.gnos[i])), '|'), '') END AS missing,
       s.total, s.total_pages, s.relaxed, s.route
FROM ranked_all r JOIN summary s USING (query_id) LEFT JOIN prims p USING (query_id)
WHERE r.rnk > (s.page - 1) * s.page_size AND r.rnk <= s.page * s.page_size
"""

SEARCH_SUMMARY_SQL = _search_sql() + f""",
more(query_id, normalized, corrections, ignored, warning) AS (VALUES
  {_values(EXPECTED_TEXT)}),
syn AS (SELECT query_id, group_no, string_agg(term, ',' ORDER BY alt_no, term) AS synonyms FROM plan WHERE kind = 'synonym' GROUP BY 1, 2),
con AS (SELECT d.query_id, string_agg(d.prim || ':' || coalesce(s.synonyms, '') || ':' || d.df::VARCHAR, '|' ORDER BY d.group_no) AS concepts
        FROM gdf d LEFT JOIN syn s USING (query_id, group_no) GROUP BY 1)
SELECT s.query_id, s.route, s.total, s.total_pages, s.relaxed, s.strict_count, m.normalized, m.corrections, m.ignored,
       m.warning, coalesce(c.concepts, '') AS concepts
FROM summary s JOIN more m USING (query_id) LEFT JOIN con c USING (query_id)
"""


@job("r28_search", sql=SEARCH_ROWS_SQL)
def r28_search(spark, sf):
    """Flagship: every search of the table, one page each, over the whole documents corpus."""
    res, _ = run_search(spark, sf)
    return res.rows


@job("r24_search_totals", sql=SEARCH_SUMMARY_SQL)
def r24_search_totals(spark, sf):
    res, _ = run_search(spark, sf)
    concepts = F.array_join(F.transform("concepts", lambda c: F.concat_ws(":", c["term"], c["synonyms"], c["df"].cast("string"))), "|")
    return res.summary.select(
        "query_id", "route", "total", "total_pages", "relaxed", "strict_count", "normalized",
        F.array_join("corrections", ",").alias("corrections"), F.array_join("ignored", " ").alias("ignored"),
        F.coalesce("warning", F.lit("")).alias("warning"), F.coalesce(concepts, F.lit("")).alias("concepts"))


@job("r8_group_frequencies", sql=with_ctes(NOTICES_CTE) + f""",
plan(query_id, group_no, alt_no, part_no, term, kind, weight, alt_size, prim) AS (VALUES
  {_values(EXPECTED_PLAN)}),
terms AS (SELECT DISTINCT lower(term) AS lt, regexp_matches(lower(term), '^[A-Za-z0-9&.+#-]{{1,3}}$') AS acro,
                 '(^|[^a-z0-9])' || regexp_replace(lower(term), '([^a-z0-9])', '\\\\\\1', 'g') || '([^a-z0-9]|$)' AS pat
          FROM plan),
hits AS (SELECT n.program_id, t.lt FROM notices n JOIN terms t
           ON CASE WHEN t.acro THEN regexp_matches(n.search_blob, t.pat) ELSE contains(n.search_blob, t.lt) END),
alt AS (SELECT p.query_id, p.group_no, p.alt_no, h.program_id, any_value(p.alt_size) AS alt_size,
               count(DISTINCT p.part_no) AS n_blob
        FROM hits h JOIN plan p ON h.lt = lower(p.term) GROUP BY 1, 2, 3, 4),
g AS (SELECT DISTINCT query_id, group_no, prim FROM plan),
d AS (SELECT query_id, group_no, count(DISTINCT program_id) AS df FROM alt WHERE n_blob = alt_size GROUP BY 1, 2),
n AS (SELECT count(*) AS corpus_size FROM notices)
SELECT g.query_id, g.group_no, g.prim AS "primary", coalesce(d.df, 0) AS df, n.corpus_size,
       CAST(CAST(round(CASE WHEN n.corpus_size <= 1 THEN 1.0
                       ELSE 1 + ln(n.corpus_size / (1 + coalesce(d.df, 0))) / ln(n.corpus_size) END, 4)
                 AS DECIMAL(5,4)) AS DOUBLE) AS idf
FROM g LEFT JOIN d USING (query_id, group_no) CROSS JOIN n""")
def r8_group_frequencies(spark, sf):
    frames = DOCS_LEXICON.frames(spark)
    plan = plan_searches(searches(spark), DOCS_LEXICON, frames, CATALOGUE_LIMITS)
    return S.group_frequencies(index_of(spark, sf), plan).select(
        "query_id", "group_no", "primary", F.col("df").cast("long").alias("df"), "corpus_size", "idf")


def _vocab_rows():
    lex = DOCS_LEXICON
    words = set(lex.generic) | set(lex.intent) | {t for g in lex.synonym_groups for t in g}
    words |= {t for _, (_, ag, ts) in lex.domains.items() for t in list(ag) + list(ts)}
    words |= set(lex.seeds)
    return sorted(words)


@job("r27_audit_vocabulary", sql=with_ctes(NOTICES_CTE) + f""",
vocab(term) AS (VALUES {", ".join("(" + _q(w) + ")" for w in _vocab_rows())}),
v AS (SELECT term, lower(term) AS lt, regexp_matches(lower(term), '^[A-Za-z0-9&.+#-]{{1,3}}$') AS acro,
             '(^|[^a-z0-9])' || regexp_replace(lower(term), '([^a-z0-9])', '\\\\\\1', 'g') || '([^a-z0-9]|$)' AS pat
      FROM vocab),
c AS (SELECT v.term,
             count(*) FILTER (WHERE CASE WHEN v.acro THEN regexp_matches(n.search_blob, v.pat)
                                         ELSE contains(n.search_blob, v.lt) END) AS df,
             count(*) FILTER (WHERE contains(n.search_blob, v.lt)) AS sub_df
      FROM v, notices n GROUP BY 1)
SELECT v.term, CAST(c.df AS BIGINT) AS df, c.df = 0 AS dead, c.df > 400 AS too_common, v.acro AS acronym,
       CAST(CASE WHEN v.acro THEN c.sub_df ELSE 0 END AS BIGINT) AS substring_df
FROM v JOIN c USING (term)""")
def r27_audit_vocabulary(spark, sf):
    vocab = literal_frame(spark, [(w,) for w in _vocab_rows()], [("term", "string")])
    return S.audit_vocabulary(index_of(spark, sf), vocab)


@job("r26_prefilter", sql=with_ctes(NOTICES_CTE) + f""",
plan(query_id, group_no, alt_no, part_no, term, kind, weight, alt_size, prim) AS (VALUES
  {_values(EXPECTED_PLAN)}),
phr(query_id, phrase_no, phrase) AS (VALUES {_values(EXPECTED_PHRASES)}),
t AS (SELECT DISTINCT query_id, lower(term) AS lt FROM plan),
tt AS (SELECT *, regexp_matches(lt, '^[A-Za-z0-9&.+#-]{{1,3}}$') AS acro,
              '(^|[^a-z0-9])' || regexp_replace(lt, '([^a-z0-9])', '\\\\\\1', 'g') || '([^a-z0-9]|$)' AS pat FROM t)
SELECT tt.query_id, n.program_id FROM tt JOIN notices n
  ON CASE WHEN tt.acro THEN regexp_matches(n.search_blob, tt.pat) ELSE contains(n.search_blob, tt.lt) END
UNION
SELECT phr.query_id, n.program_id FROM phr JOIN notices n
  ON contains(lower(coalesce(n.name, '')), lower(phrase)) OR contains(lower(coalesce(n.summary, '')), lower(phrase))
  OR contains(lower(coalesce(n.field, '')), lower(phrase))""")
def r26_prefilter(spark, sf):
    frames = DOCS_LEXICON.frames(spark)
    plan = plan_searches(searches(spark), DOCS_LEXICON, frames, CATALOGUE_LIMITS)
    return S.prefilter(index_of(spark, sf), plan)
