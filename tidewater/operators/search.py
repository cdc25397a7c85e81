"""Search execution over a table of searches.

One run answers every search of the input table in one pass over the corpus:

1. The terms of all searches (plan terms, phrases, weak words, expansion words) form one
   distinct term table.  The rarest pieces of each term meet the postings of the written index in an
   equi-join of numbers, a count keeps the documents that hold them all, and these candidates
   are verified with ``contains`` (an ASCII boundary test for acronyms) in the documents' own
   buckets: no document is compared with every term, and no shuffle holds a text.
2. Hits -> alternatives -> concept groups are roll-ups under one partitioning by (search,
   document); the group table is written once.
3. Document frequencies come from the group table; one score per (search, document) is
   written once, with the attributes that filters and order need.
4. Everything per search (strict count, threshold, gates, totals) comes from one small
   histogram of the scores; ranking reads only scores and that summary.
5. A page is selected before anything is sorted: a histogram of the order's columns gives, per search, the bars
   that reach into its own page; only their rows are numbered.  Page 400 sorts no more than page 1.

Scores are exact decimals: field weights x10 are integers, weights are
DECIMAL(3,2) and IDF DECIMAL(5,4), so sums do not depend on summation order.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.constants import FIELD_WEIGHTS_X10, MIN_STRICT_RESULTS, NATIONAL, TIERS, WEIGHT_SYNONYM
from tidewater.operators.common import attach_scalar
from tidewater.operators.search_index import FIELDS, SearchIndex, build_index, candidates, fetched
from tidewater.plans.lexicon import LexiconFrames
from tidewater.plans.query_plan import Plan
from tidewater.scratch import Scratch

ACRONYM_RE = r"^[A-Za-z0-9&.+#-]{1,3}$"
#: Characters of a name that tell rows of one bar apart before they are sorted.
LEAD = 6
PHRASE_FIELDS = ["name", "summary", "field"]


# ---------------------------------------------------------------------------
# Term hits
# ---------------------------------------------------------------------------

def _bounded(c: Column) -> Column:
    """Does the acronym ``lterm`` stand in ``c`` without touching [a-z0-9] on either side?

    The scan ends at the first such place and writes no text.
    """
    return c.contains(F.col("lterm")) & F.rlike(c, F.col("bterm"))


def indexed(corpus: DataFrame | SearchIndex) -> SearchIndex:
    return corpus if isinstance(corpus, SearchIndex) else build_index(corpus)


def verified(corpus: SearchIndex, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents beside the terms that their blob contains."""
    found = fetched(corpus, candidates(corpus, terms, scratch)).where(F.col("search_blob").contains(F.col("lterm")))
    acro = F.col("lterm").rlike(ACRONYM_RE)
    return found.withColumns({"acro": acro, "bterm": F.when(acro, F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("lterm"), F.lit(r"\E(?![a-z0-9])")))})


def term_hits(corpus: DataFrame | SearchIndex, terms: DataFrame) -> DataFrame:
    """Every (document, term) whose lower-cased blob contains the term.

    ``terms`` has a column ``lterm`` (lower-cased).  Output: program_id, lterm, score_x10
    (field-weighted score x10, 0 when the hit spans two fields), psf_hit (plain substring of
    name, summary or field: the phrase rule).
    """
    c = verified(indexed(corpus), terms, Scratch(terms.sparkSession, "terms"))
    inside = {f: F.when(F.col("acro"), _bounded(F.col(f"l_{f}"))).otherwise(F.col(f"l_{f}").contains(F.col("lterm"))) for f in FIELDS}
    score = sum((F.when(inside[f], F.lit(w)).otherwise(F.lit(0)) for f, w in FIELD_WEIGHTS_X10), F.lit(0))
    psf = F.lit(False)
    for f in PHRASE_FIELDS:
        psf = psf | F.col(f"l_{f}").contains(F.col("lterm"))
    # an acronym has no space, so it stands in the blob where it stands in a field
    scored = c.select("program_id", "lterm", "acro", score.alias("score_x10"), psf.alias("psf_hit"))
    return scored.where(~F.col("acro") | (F.col("score_x10") > 0)).drop("acro")


# ---------------------------------------------------------------------------
# Alternatives, groups, documents
# ---------------------------------------------------------------------------

def plan_roles(terms: DataFrame, role: str) -> DataFrame:
    return terms.select(
        "query_id", F.lit(role).alias("role"), "group_no", "alt_no", "part_no", F.lower("term").alias("lterm"),
        F.col("kind").isin("exact", "compound-joined").alias("literal"), F.col("weight").cast("decimal(3,2)").alias("weight"), "alt_size")


def word_roles(words: DataFrame, role: str, term: str, number: str) -> DataFrame:
    return words.select(
        "query_id", F.lit(role).alias("role"), F.lit(0).alias("group_no"), F.col(number).alias("alt_no"), F.lit(0).alias("part_no"),
        F.lower(term).alias("lterm"), F.lit(False).alias("literal"), F.lit(1).cast("decimal(3,2)").alias("weight"), F.lit(1).alias("alt_size"))


def group_hits(hits: DataFrame, roles: DataFrame) -> DataFrame:
    """R5-R7 per (search, document, role, group): best alternative (without idf), exact flag, whether some
    alternative is hit in full, and the sums that phrases and weak words need.

    A part of an alternative is one term and a (document, term) hit is one row, so counting rows
    counts parts.  One shuffle on (search, document): the roll-ups are keyed by supersets of it.
    """
    j = hits.join(roles, "lterm").repartition("query_id", "program_id")
    alt = j.groupBy("query_id", "program_id", "role", "group_no", "alt_no").agg(
        F.first("literal").alias("literal"), F.first("weight").alias("weight"), F.first("alt_size").alias("alt_size"),
        F.count(F.lit(1)).alias("n_blob"), F.count_if(F.col("score_x10") > 0).alias("n_pos"),
        F.min("score_x10").alias("low"), F.bool_and(F.col("psf_hit") & (F.col("score_x10") > 0)).alias("phrase"))
    whole = F.col("n_pos") == F.col("alt_size")
    return alt.groupBy("query_id", "program_id", "role", "group_no").agg(
        F.max(F.when(whole, F.col("low").cast("decimal(10,0)") * F.col("weight")).otherwise(F.lit(0).cast("decimal(14,2)"))).alias("best"),
        F.bool_or(F.col("literal") & whole).alias("exact"), F.bool_or(F.col("n_blob") == F.col("alt_size")).alias("full"),
        F.count(F.lit(1)).alias("alts"), F.sum("low").alias("low_sum"), F.count_if("phrase").alias("phrases"))


def idf(df: Column, n: Column) -> Column:
    """Damped IDF 1 + ln(N/(1+df))/ln N, rounded to 4 places; N <= 1 -> 1."""
    raw = F.lit(1.0) + F.log(n / (F.lit(1) + df)) / F.log(n)
    safe = F.when((n <= 1) | raw.isNull() | F.isnan(raw), F.lit(1.0)).otherwise(raw)
    return F.round(safe, 4).cast("decimal(5,4)")


def frequencies(groups: DataFrame, plan_terms: DataFrame, notices: DataFrame) -> DataFrame:
    """Df of each concept over the unfiltered corpus (all parts of some alternative), corpus size, idf."""
    df = groups.where((F.col("role") == "t") & F.col("full")).groupBy("query_id", "group_no").agg(F.count(F.lit(1)).alias("df"))
    out = plan_terms.select("query_id", "group_no", "primary").distinct().join(df, ["query_id", "group_no"], "left").fillna(0, ["df"])
    out = attach_scalar(out, notices.agg(F.count(F.lit(1)).alias("corpus_size")))
    return out.withColumn("idf", idf(F.col("df"), F.col("corpus_size")))


def filters_ok(region: Column, open_only: Column, as_of) -> Column:
    """R19 + R20 on a document's region, is_open and period_end."""
    reg = (region == "") | (F.col("region") == region) | (F.col("region") == NATIONAL)
    return reg & (~open_only | open_now(as_of))


def open_now(as_of) -> Column:
    return F.col("is_open") & (F.col("period_end").isNull() | (F.col("period_end") >= F.lit(as_of)))


# ---------------------------------------------------------------------------
# Domain expansion vocabulary
# ---------------------------------------------------------------------------

def expansion_terms(plan: Plan, frames: LexiconFrames) -> DataFrame:
    """R16 + R17: (query_id, term, rank, domain_label) of the expansion vocabulary.

    Lookup words: group primaries in group order, then every alternative term;
    the first word with a seed wins (exact seed, else the longest seed of >= 2
    chars contained in a longer word); agencies before terms, round-robin over the
    domains, distinct.  ``plan.limits`` may bound domains and terms.
    """
    t = plan.terms
    prim = t.select("query_id", F.col("primary").alias("word"),
                    F.struct(F.lit(0).alias("k"), F.col("group_no").alias("g"), F.lit(0).alias("a"), F.lit(0).alias("p")).alias("ord"))
    alts = t.select("query_id", F.col("term").alias("word"),
                    F.struct(F.lit(1).alias("k"), F.col("group_no").alias("g"), F.col("alt_no").alias("a"), F.col("part_no").alias("p")).alias("ord"))
    words = prim.unionByName(alts).withColumn("word", F.trim("word")).where(F.col("word") != "") \
        .groupBy("query_id", "word").agg(F.min("ord").alias("ord"))
    # a seed inside a word is one of the word's pieces of the seed's length: an equi-join again
    seeds = frames.seeds.select("seed", "seed_order").distinct()
    inner = words.select("query_id", "word", "ord", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: F.transform(F.sequence(F.lit(1), F.length("word") - i + 1), lambda n: F.col("word").substr(i, n)))))).alias("seed"))
    found = inner.join(seeds, "seed").withColumn("how", (F.col("seed") != F.col("word")).cast("int")) \
        .where((F.col("how") == 0) | (F.length("seed") >= 2))
    best = found.groupBy("query_id", "word", "ord").agg(
        F.min(F.struct("how", (-F.length("seed")).alias("neg_len"), "seed_order", "seed")).alias("b"))
    chosen = best.groupBy("query_id").agg(F.min(F.struct("ord", F.col("b.seed").alias("seed"))).alias("c")) \
        .select("query_id", F.col("c.seed").alias("seed"))
    doms = chosen.join(frames.seeds, "seed")
    if plan.limits.domains is not None:
        doms = doms.where(F.col("key_no") < plan.limits.domains)
    doms = doms.select("query_id", "key_no", "domain_key")
    picked = doms.join(frames.domain_terms.select("domain_key", "qpos", "term"), "domain_key") \
        .groupBy("query_id", "term").agg(F.min(F.struct("qpos", "key_no")).alias("r"))
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("r.qpos"), F.col("r.key_no"))))
    if plan.limits.expansion_terms is not None:
        picked = picked.where(F.col("rank") <= plan.limits.expansion_terms)
    labels = doms.join(frames.domain_terms.select("domain_key", "label").distinct(), "domain_key") \
        .groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key_no", "label"))),
                                                          lambda x: x["label"]), " · ").alias("domain_label"))
    return picked.select("query_id", "term", "rank").join(labels, "query_id")


# ---------------------------------------------------------------------------
# Whole flow
# ---------------------------------------------------------------------------

@dataclass
class SearchResult:
    rows: DataFrame      # one row per search and result on the requested page
    summary: DataFrame   # one row per search: route, totals, mode, frequencies, plan metadata
    scratch: Scratch     # written tables both read; close() it when they are no longer needed


# the result order, as values that are never null: (tier, score, open) fall, (end, name, id) rise
BAR = ["b_tier", "b_score", "b_shut", "b_end"]


def with_bar(rows: DataFrame) -> DataFrame:
    """Add the bar of a row: its place in the order but for name and id; every part rises."""
    return rows.withColumns({
        "b_tier": -F.col("tier_num"), "b_score": -F.coalesce(F.col("score_dec"), F.lit(-1).cast("decimal(20,6)")), "b_shut": (~F.col("is_open")).cast("int"),
        "b_end": F.coalesce(F.unix_date("period_end"), F.lit(2147483647))})


def overlapping(bars: DataFrame, within: list[str], order: list[str], n: str = "n") -> DataFrame:
    """Bars that hold a rank of the wanted page (lo, hi]; ``before`` counts the rows of the search before each."""
    upto = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bars = bars.withColumn("before", F.col("base") + F.sum(n).over(upto) - F.col(n))
    return bars.where((F.col("before") < F.col("hi")) & (F.col("before") + F.col(n) > F.col("lo")))


def page_rows(rows: DataFrame, pages: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """The rows of each search's page, with ``rank``; ``pages`` (query_id, lo, hi).

    ``rows`` have the order's columns (``with_bar``).  Two histograms, by bar and by the beginning of the name
    inside a bar, leave the rows around the page; these alone are sorted.  ``bars``: a histogram made elsewhere.
    """
    if bars is None:
        bars = rows.groupBy("query_id", *BAR).agg(F.count(F.lit(1)).alias("n")).join(pages, "query_id")
        bars = overlapping(bars.withColumn("base", F.lit(0).cast("long")), ["query_id"], BAR)
        rows = rows.join(bars.select("query_id", *BAR, "lo", "hi", F.col("before").alias("base")), ["query_id", *BAR])
    rows = rows.withColumn("lead", F.coalesce(F.substring("name", 1, LEAD), F.lit("")))
    keys = ["query_id", *BAR, "lead"]
    leads = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    leads = overlapping(leads, ["query_id", *BAR], ["lead"])
    rows = rows.drop("base", "lo", "hi").join(leads.select(*keys, "lo", "hi", "before"), keys)
    ranks = F.row_number().over(Window.partitionBy(*keys).orderBy("name", "program_id"))
    return rows.withColumn("rank", F.col("before") + ranks).where((F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")))


def _browse(attributes: DataFrame, asked: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(rows, totals) of the searches without any term.

    A filter admits regions: its own and the national one, or all ('*').  The histogram of the documents by
    (region, open now, bar) is counted once; the searches add up its bars, and only documents
    of bars that reach into a page meet the searches.
    """
    tokens = F.explode(F.array_distinct(F.array_compact(F.array("region", F.lit("*")))))
    admits = asked.select("query_id", "open_only", "lo", "hi", F.explode(F.when(F.col("q_region") == "", F.array(F.lit("*")))
                                                                         .otherwise(F.array_distinct(F.array("q_region", F.lit(NATIONAL))))).alias("token"))
    d = with_bar(attributes.select("program_id", "name", "region", "is_open", "period_end", F.coalesce(open_now(as_of), F.lit(False)).alias("now"),
                                   F.lit(0).alias("tier_num"), F.lit(None).cast("decimal(20,6)").alias("score_dec")))
    bars = d.groupBy("region", "now", *BAR).agg(F.count(F.lit(1)).alias("n")).withColumn("token", tokens)
    mine = bars.join(admits, "token").where("now or not open_only").groupBy("query_id", "open_only", "lo", "hi", *BAR).agg(F.sum("n").alias("n"))
    totals = mine.groupBy("query_id").agg(F.sum("n").alias("total"))
    kept = overlapping(mine.withColumn("base", F.lit(0).cast("long")), ["query_id"], BAR)
    kept = kept.select("query_id", "lo", "hi", *BAR, F.col("before").alias("base")).join(admits.select("query_id", "open_only", "token"), "query_id")
    rows = d.withColumn("token", tokens).join(kept, ["token", *BAR]).where("now or not open_only")
    return page_rows(rows, asked, kept).select("query_id", "program_id", "rank"), totals


def search(corpus: DataFrame | SearchIndex, plan: Plan, frames: LexiconFrames, as_of) -> SearchResult:
    """All searches of ``plan`` over notices, or over their index."""
    index = indexed(corpus)
    scratch = Scratch(index.postings.sparkSession, "search")
    meta = plan.meta
    ranked_ids = meta.where(F.col("route") == "ranked").select("query_id")
    terms = plan.terms.join(ranked_ids, "query_id", "left_semi")
    phrases = plan.phrases.join(ranked_ids, "query_id", "left_semi")
    words = F.concat("generic", "intent")
    if plan.limits.weak_words is not None:
        words = F.slice(words, 1, plan.limits.weak_words)
    weak = meta.where(F.col("route") == "weak").select("query_id", F.posexplode(F.array_distinct(F.transform(words, F.lower))).alias("wpos", "term"))
    weak = scratch.write(weak, "weak")
    exp = scratch.write(expansion_terms(plan, frames), "expansion")
    exp_roles = plan_roles(exp.select("query_id", F.lit(0).alias("group_no"), F.col("rank").alias("alt_no"), F.lit(0).alias("part_no"), "term",
                                      F.lit("domain").alias("kind"), F.lit(WEIGHT_SYNONYM).alias("weight"), F.lit(1).alias("alt_size")), "e")
    roles = scratch.write(plan_roles(terms, "t").unionByName(word_roles(phrases, "p", "phrase", "phrase_no"))
                          .unionByName(word_roles(weak, "w", "term", "wpos")).unionByName(exp_roles), "roles")
    hits = scratch.write(term_hits(index, roles), "hits")
    groups = scratch.write(group_hits(hits, roles), "groups")
    dfs = scratch.write(frequencies(groups, terms, index.attributes), "frequencies")

    # ---- one score per (search, document) ----
    role = lambda r: F.col("role") == r
    g = groups.join(dfs.select("query_id", "group_no", F.lit("t").alias("role"), "idf"), ["query_id", "group_no", "role"], "left")
    g = g.withColumn("g_score", F.when(role("t"), F.col("best") * F.col("idf")))
    docs = g.groupBy("query_id", "program_id").agg(
        F.sum("g_score").alias("g_sum"), F.count_if(F.col("g_score") > 0).alias("n_hit"), F.count_if(role("t") & F.col("exact")).alias("n_exact"),
        F.array_sort(F.collect_list(F.when(F.col("g_score") > 0, F.col("group_no")))).alias("matched_nos"),
        F.sum(F.when(role("p"), F.col("low_sum"))).alias("p_sum"), F.sum(F.when(role("p"), F.col("phrases"))).alias("p_ok"),
        F.sum(F.when(role("w"), F.col("alts"))).alias("n_weak"), F.max(F.when(role("e"), F.col("best"))).alias("e_score"),
        F.bool_or(role("t") | role("p")).alias("asked"))
    n_weak = weak.groupBy("query_id").agg(F.count(F.lit(1)).alias("all_weak"))
    asked = meta.select("query_id", "route", "n_groups", "n_phrases", F.col("region").alias("q_region"), "open_only").join(n_weak, "query_id", "left")
    scored = docs.join(asked, "query_id").join(index.attributes, "program_id").where(filters_ok(F.col("q_region"), F.col("open_only"), as_of))
    zero = F.lit(0).cast("decimal(20,6)")
    phrases_ok = (F.col("n_phrases") == 0) | (F.coalesce("p_ok", F.lit(0)) == F.col("n_phrases"))
    scored = scored.select(
        "query_id", "program_id", "name", "is_open", "period_end", "n_hit", "n_exact", "n_groups", "matched_nos",
        (F.coalesce("g_sum", zero) + F.coalesce("p_sum", F.lit(0)).cast("decimal(20,6)")).cast("decimal(20,6)").alias("score_dec"),
        ((F.col("route") == "ranked") & F.col("asked") & phrases_ok).alias("main"),
        F.coalesce(F.col("n_weak") == F.col("all_weak"), F.lit(False)).alias("weak"),
        F.when(F.col("e_score") > 0, F.col("e_score").cast("decimal(20,6)")).alias("e_score"))
    scored = scratch.write(scored.where("main or weak or e_score is not null"), "scored")

    # ---- R14, R15, R24 per search, from a small histogram ----
    bars = scored.groupBy("query_id", "n_hit").agg(F.count_if("main").alias("main"), F.count_if("weak").alias("weak"), F.count("e_score").alias("expanded"))
    of = meta.select("query_id", "n_groups", "n_phrases", "route", "page", "page_size", "normalized", "primaries", "corrections", "generic", "intent", "warning")
    bars = of.join(bars, "query_id", "left").fillna(0, ["n_hit", "main", "weak", "expanded"])
    per = Window.partitionBy("query_id")
    bars = bars.withColumns({
        "strict_count": F.sum(F.when(F.col("n_hit") == F.col("n_groups"), F.col("main")).otherwise(F.lit(0))).over(per),
        "max_hit": F.max(F.when(F.col("main") > 0, F.col("n_hit")).otherwise(F.lit(0))).over(per)})
    half = F.greatest(F.lit(1), F.ceil(F.col("n_groups") / 2)).cast("int")
    strict = (F.col("strict_count") >= MIN_STRICT_RESULTS) | (F.col("n_groups") <= 1)
    bars = bars.withColumns({"threshold": F.when(strict, F.col("n_groups")).when(F.col("max_hit") >= half, half).otherwise(F.lit(1)), "strict": strict})
    counts = bars.groupBy("query_id", "threshold", "strict", "strict_count").agg(
        F.sum(F.when(F.col("n_hit") >= F.col("threshold"), F.col("main")).otherwise(F.lit(0))).alias("main_total"),
        F.sum("weak").alias("weak_total"), F.sum("expanded").alias("exp_total"))
    known = dfs.groupBy("query_id").agg(F.max("df").alias("max_df"))
    to = F.col("page").cast("long") * F.col("page_size")
    pages = meta.select("query_id", "route", F.col("region").alias("q_region"), "open_only", (to - F.col("page_size")).alias("lo"), to.alias("hi"))
    browse_rows, browse_totals = _browse(index.attributes, pages.where("route = 'browse'"), as_of)
    # Synonyms and document frequency of each concept
    concepts = terms.where("kind = 'synonym'").groupBy("query_id", "group_no").agg(F.sort_array(F.collect_list(F.struct("alt_no", "term"))).alias("s"))
    concepts = dfs.join(concepts, ["query_id", "group_no"], "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        "group_no", F.col("primary").alias("term"), F.coalesce(F.array_join(F.transform("s", lambda x: x["term"]), ","), F.lit("")).alias("synonyms"), "df"))).alias("concepts"))
    summary = of.join(counts, "query_id").join(known, "query_id", "left").join(browse_totals.withColumnRenamed("total", "browse_total"), "query_id", "left") \
        .join(exp.select("query_id", "domain_label").distinct(), "query_id", "left").join(concepts, "query_id", "left")
    ranked = F.col("route") == "ranked"
    expanded = (ranked & (F.col("main_total") == 0) & (F.col("n_phrases") == 0) & (F.col("n_groups") > 0)
                & (F.coalesce("max_df", F.lit(0)) == 0) & (F.col("exp_total") > 0))
    total = F.when(expanded, F.col("exp_total")).when(ranked, F.col("main_total")).when(F.col("route") == "weak", F.col("weak_total")).otherwise(F.coalesce("browse_total", F.lit(0)))
    summary = summary.withColumns({"expanded": expanded, "total": total.cast("long")})
    summary = summary.select(
        "query_id", F.when(F.col("expanded"), F.lit("domain")).otherwise(F.col("route")).alias("route"), "total",
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("page_size"))).cast("long").alias("total_pages"),
        F.when(F.col("expanded") | (F.col("route") == "weak"), F.lit(True)).otherwise(ranked & ~F.col("strict")).alias("relaxed"),
        F.when(ranked, F.col("strict_count")).otherwise(F.lit(0)).cast("long").alias("strict_count"),
        "page", "page_size", "n_groups", "n_phrases", "normalized", "primaries", "threshold", "domain_label", "concepts",
        F.transform("corrections", lambda c: F.concat(c["src"], F.lit(">"), c["dst"])).alias("corrections"),
        F.concat("generic", "intent").alias("ignored"), "warning")
    summary = scratch.write(summary, "summary")

    # ---- R11, R23, R24: rank and page ----
    s = scored.join(summary.select("query_id", F.col("route").alias("way"), "threshold", "page", "page_size"), "query_id")
    taken = (((F.col("way") == "ranked") & F.col("main") & (F.col("n_hit") >= F.col("threshold")))
             | ((F.col("way") == "weak") & F.col("weak")) | ((F.col("way") == "domain") & F.col("e_score").isNotNull()))
    tier = (F.when((F.col("n_exact") == F.col("n_groups")) & (F.col("n_hit") == F.col("n_groups")), F.lit(4))
             .when(F.col("n_hit") == F.col("n_groups"), F.lit(3)).when(F.col("n_hit") >= 1, F.lit(2)).otherwise(F.lit(1)))
    s = s.where(taken).select(
        "query_id", "program_id", "name", "is_open", "period_end",
        F.when(F.col("way") == "domain", F.lit(3)).when(F.col("way") == "weak", F.lit(1)).otherwise(tier).alias("tier_num"),
        F.when(F.col("way") == "domain", F.col("e_score")).when(F.col("way") == "ranked", F.col("score_dec")).alias("score_dec"), "matched_nos")
    best = page_rows(with_bar(s), pages.select("query_id", "lo", "hi")).select("query_id", "program_id", "rank", "tier_num", "score_dec", "matched_nos")
    rows = best.unionByName(browse_rows.select("query_id", "program_id", "rank", F.lit(0).alias("tier_num"), F.lit(None).cast("decimal(20,6)").alias("score_dec"),
                                               F.array().cast("array<int>").alias("matched_nos")))
    rows = rows.join(summary.select("query_id", "route", "total", "total_pages", "relaxed", "page", "page_size", "primaries", "domain_label"), "query_id")
    named = lambda keep: F.array_join(F.transform(F.filter("primaries", keep), lambda g: g["primary"]), "|")
    domain = F.col("route") == "domain"
    rows = rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "program_id",
        F.when(domain, F.lit("domain")).otherwise(F.get(F.array(*[F.lit(t) for t in TIERS]), F.when(F.col("tier_num") > 0, F.col("tier_num") - 1))).alias("tier"),
        F.when(F.col("tier_num") > 0, F.round(F.coalesce("score_dec", zero) * F.lit(0.1).cast("decimal(2,1)"), 2).cast("double")).alias("score"),
        F.when(domain, F.col("domain_label")).otherwise(named(lambda g: F.array_contains(F.col("matched_nos"), g["group_no"]))).alias("matched"),
        F.when(domain, F.lit("")).otherwise(named(lambda g: ~F.array_contains(F.col("matched_nos"), g["group_no"]))).alias("missing"),
        "total", "total_pages", "relaxed", "route")
    return SearchResult(rows=rows, summary=summary, scratch=scratch)


def group_frequencies(corpus: DataFrame | SearchIndex, plan: Plan) -> DataFrame:
    """R8 + R9 as their own report: df, corpus size and idf per (search, concept)."""
    index = indexed(corpus)
    roles = plan_roles(plan.terms, "t")
    out = frequencies(group_hits(term_hits(index, roles), roles), plan.terms, index.attributes)
    return out.withColumn("idf", F.col("idf").cast("double"))


def prefilter(corpus: DataFrame | SearchIndex, plan: Plan) -> DataFrame:
    """Candidate documents per search: any term in the blob, or any phrase in name, summary or field."""
    asked = plan.terms.select("query_id", F.lower("term").alias("lterm"), F.lit(False).alias("phrase")) \
        .unionByName(plan.phrases.select("query_id", F.lower("phrase").alias("lterm"), F.lit(True).alias("phrase"))).distinct()
    c = verified(indexed(corpus), asked, Scratch(asked.sparkSession, "prefilter"))
    term, phrase = F.lit(False), F.lit(False)
    for f in FIELDS:
        term = term | _bounded(F.col(f"l_{f}"))
    for f in PHRASE_FIELDS:
        phrase = phrase | F.col(f"l_{f}").contains(F.col("lterm"))
    c = c.select("program_id", "lterm", (~F.col("acro") | term).alias("as_term"), phrase.alias("as_phrase"))
    return c.join(asked, "lterm").where(F.when(F.col("phrase"), F.col("as_phrase")).otherwise(F.col("as_term"))).select("query_id", "program_id").distinct()


def audit_vocabulary(corpus: DataFrame | SearchIndex, vocab: DataFrame, too_common: int = 400) -> DataFrame:
    """Df per lexicon word; dead (0) and too common; substring vs boundary counts for acronyms."""
    v = vocab.select(F.col("term"), F.lower("term").alias("lterm")).distinct()
    c = verified(indexed(corpus), v, Scratch(v.sparkSession, "vocabulary"))
    bounded = F.lit(False)
    for f in FIELDS:
        bounded = bounded | _bounded(F.col(f"l_{f}"))
    counts = c.select("lterm", (~F.col("acro") | bounded).alias("hit")).groupBy("lterm").agg(F.count_if("hit").alias("df"), F.count(F.lit(1)).alias("sub"))
    acronym = F.col("lterm").rlike(ACRONYM_RE)
    out = v.join(counts, "lterm", "left").fillna(0, ["df", "sub"])
    return out.select(
        "term", F.col("df").cast("long").alias("df"), (F.col("df") == 0).alias("dead"), (F.col("df") > too_common).alias("too_common"),
        acronym.alias("acronym"), F.when(acronym, F.col("sub")).otherwise(F.lit(0)).cast("long").alias("substring_df"))
