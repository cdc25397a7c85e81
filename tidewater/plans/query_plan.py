"""Query planning over a table of searches (Q1-Q12).

Input ``searches(query_id, q, region, open_only, page, page_size)``; output three
small DataFrames:

* ``terms``   (query_id, group_no, alt_no, part_no, term, kind, weight, alt_size, primary)
* ``phrases`` (query_id, phrase_no, phrase)
* ``meta``    one row per search: bounds, normalized text, corrections, generic /
  intent words, route (browse / weak / ranked), group count, phrase count.

All steps are column expressions, explode/posexplode and equi-joins against the
lexicon frames; whether a side is broadcast is left to the optimizer.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.constants import WEIGHT_COMPOUND, WEIGHT_EXACT, WEIGHT_PHRASE, WEIGHT_SYNONYM
from tidewater.functions.text import normalize_query
from tidewater.plans.lexicon import Lexicon, LexiconFrames
from tidewater.plans.limits import SearchLimits
from tidewater.scratch import Scratch

CORR_TYPE = "array<struct<src:string,dst:string>>"


@dataclass
class Plan:
    terms: DataFrame
    phrases: DataFrame
    meta: DataFrame
    limits: SearchLimits


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def bound_searches(searches: DataFrame, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """Q1: trimmed text and region, page and size of at least 1 (0 / missing -> 1 and the default
    size), within ``limits``."""
    def int_or(c: str, dflt: int, most: int | None) -> Column:
        v = F.col(c).cast("int")
        v = F.greatest(F.when(v.isNull() | (v == 0), F.lit(dflt)).otherwise(v), F.lit(1))
        return v if most is None else F.least(v, F.lit(most))

    return searches.select(
        "query_id",
        _cut(F.trim(F.coalesce(F.col("q"), F.lit(""))), limits.query_chars).alias("q"),
        _cut(F.trim(F.coalesce(F.col("region"), F.lit(""))), limits.region_chars).alias("region"),
        F.coalesce(F.col("open_only").cast("boolean"), F.lit(False)).alias("open_only"),
        int_or("page", 1, limits.max_page).alias("page"),
        int_or("page_size", limits.default_page_size, limits.max_page_size).alias("page_size"),
    )


def _pieces(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(query_id, piece): the distinct substrings of each text that have one of the lengths."""
    def cuts(n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda at: F.substr(F.col("text"), at, n))

    sizes = F.array(*[F.lit(n) for n in lengths])
    return texts.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(sizes, cuts)))).alias("piece"))


def _fold_fixes(text: Column, fixes: Column) -> Column:
    """The fixes in their order, each on all its places in the text that the ones before it left; with the texts in between."""
    init = F.struct(text.alias("text"), F.array().cast(CORR_TYPE).alias("corr"), F.array().cast("array<string>").alias("steps"))

    def step(acc, f):
        new = F.replace(acc["text"], f["src"], f["dst"])
        hit = F.struct(new.alias("text"), F.concat(acc["corr"], F.array(F.struct(f["src"].alias("src"), f["dst"].alias("dst")))).cast(CORR_TYPE).alias("corr"),
                       F.concat(acc["steps"], F.array(new)).alias("steps"))
        return F.when(acc["text"].contains(f["src"]), hit).otherwise(acc)

    return F.aggregate(fixes, init, step)


def fix_spelling(texts: DataFrame, fixes: DataFrame, scratch: Scratch) -> DataFrame:
    """Q3: (query_id, text, corrections) of texts (query_id, text) under a table of fixes (src, dst, no).

    Longest fix first (by ``no`` on ties); every occurrence replaced; corrections kept.  The table may be large: a text meets it by
    an equi-join of its substrings (of the lengths that occur among the fixes, one number each), and folds only the
    fixes that it holds.  A fix can make a place for a later one, so the texts between the steps are joined as well, until they name
    no fix that the fold has not seen; then the fold equals one over the whole table.  Blank fixes are ignored.
    """
    none = F.array().cast(CORR_TYPE)
    fixes = fixes.where(F.length("src") > 0)
    lengths = sorted(r[0] for r in fixes.select(F.length("src")).distinct().collect())
    if not lengths:
        return texts.select("query_id", "text", none.alias("corrections"))
    key = ["query_id", "no"]

    def held(t: DataFrame) -> DataFrame:
        return _pieces(t, lengths).join(fixes, F.col("piece") == F.col("src")).select("query_id", "no", "src", "dst").distinct()

    seen = scratch.write(held(texts), "fixes")
    while True:
        per = seen.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.length("src")).alias("rank"), "no", "src", "dst"))).alias("_f"))
        done = scratch.write(texts.join(per, "query_id").select("query_id", _fold_fixes(F.col("text"), F.col("_f")).alias("_s")).select("query_id", "_s.*"), "fixed")
        more = held(done.select("query_id", F.explode("steps").alias("text"))).join(seen.select(*key), key, "left_anti")
        more = scratch.write(more, "more-fixes")
        if more.isEmpty():
            break
        seen = scratch.write(seen.unionByName(more), "fixes")
    return texts.join(done.select("query_id", F.col("text").alias("_t"), "corr"), "query_id", "left").select(
        "query_id", F.coalesce("_t", "text").alias("text"), F.coalesce("corr", none).alias("corrections"))


def phrase_re(limits: SearchLimits) -> str:
    return '"([^"]{2,' + str(limits.phrase_chars or "") + '})"'


def strip_suffix(tok: Column, suffixes: list[str]) -> Column:
    """Q5: strip the first listed suffix when the token has >= 3 chars and >= 2 remain."""
    if not suffixes:
        return tok
    arr = F.array(*[F.lit(s) for s in suffixes])
    cands = F.filter(arr, lambda s: F.endswith(tok, s) & (F.length(tok) - F.length(s) >= 2))
    first = F.element_at(cands, 1)
    return F.when((F.length(tok) >= 3) & (F.size(cands) > 0),
                  tok.substr(F.lit(1), F.length(tok) - F.length(first))).otherwise(tok)


def plan_searches(searches: DataFrame, lex: Lexicon, frames: LexiconFrames,
                  limits: SearchLimits = SearchLimits()) -> Plan:
    scratch = Scratch(searches.sparkSession, "plan")
    quoted = phrase_re(limits)
    b = bound_searches(searches, limits)
    # the Arrow NFKC step runs once
    b = scratch.write(b.withColumn("text", normalize_query(F.col("q"))), "normalized")
    spelled = fix_spelling(b.select("query_id", "text"), frames.spelling, scratch)
    s = b.drop("text").join(spelled.withColumnRenamed("text", "normalized"), "query_id")
    # Q4: quoted phrases out, rest kept
    s = s.withColumn("phrases", F.filter(F.transform(F.regexp_extract_all("normalized", F.lit(quoted), 1),
                                                     lambda p: F.trim(p)), lambda p: p != ""))
    s = s.withColumn("rest", F.regexp_replace("normalized", quoted, " "))
    tokens = F.filter(F.split("rest", r"(?U)\s+"), lambda t: t != "")
    s = s.withColumn("raw_tokens", tokens if limits.max_tokens is None else F.slice(tokens, 1, limits.max_tokens))
    # normalized searches feed every branch below: written once
    s = scratch.write(s, "searches")

    # Q5: tokens with position, stem, original; first occurrence of a stem wins
    tok = s.select("query_id", F.posexplode("raw_tokens").alias("pos", "raw"))
    tok = tok.withColumn("stem", strip_suffix(F.col("raw"), lex.suffixes))
    first = Window.partitionBy("query_id", "stem").orderBy("pos")
    tok = tok.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    tok = tok.withColumn("original", F.when(F.col("raw") != F.col("stem"), F.col("raw")))

    # Q6: intent -> generic -> 1-char non-alphanumeric -> core
    classes = frames.classes.groupBy("word").agg(F.bool_or(F.col("cls") == "intent").alias("_intent"))
    tok = tok.join(classes.withColumnRenamed("word", "_w"), F.col("stem") == F.col("_w"), "left").drop("_w")
    tok = tok.withColumn(
        "cls",
        F.when(F.col("_intent"), F.lit("intent"))
         .when(F.col("_intent").isNotNull(), F.lit("generic"))
         .when((F.length("stem") < 2) & ~F.col("stem").rlike("^[A-Za-z0-9]+$"), F.lit("generic"))
         .otherwise(F.lit("core"))).drop("_intent")

    # Q7: synonym group of the stem (case-insensitive); every branch below starts from these words, so they are written
    syn = frames.synonyms
    tok = tok.join(syn.select(F.col("syn_lower").alias("_l"), "syn_group"), (F.col("cls") == "core") & (F.lower("stem") == F.col("_l")), "left").drop("_l")
    tok = scratch.write(tok.select("query_id", "pos", "stem", "original", "cls", "syn_group"), "words")
    core = tok.where(F.col("cls") == "core").drop("cls")

    # alternatives of every core token (before concept dedup)
    exact = core.select("query_id", "pos", F.lit(0).alias("alt_no"), F.lit(0).alias("part_no"),
                        F.col("stem").alias("term"), F.lit("exact").alias("kind"),
                        F.lit(WEIGHT_EXACT).alias("weight"), F.lit(1).alias("alt_size"))
    orig = core.where(F.col("original").isNotNull() & (F.lower("original") != F.lower("stem"))) \
        .select("query_id", "pos", F.lit(1).alias("alt_no"), F.lit(0).alias("part_no"),
                F.col("original").alias("term"), F.lit("exact").alias("kind"),
                F.lit(WEIGHT_EXACT).alias("weight"), F.lit(1).alias("alt_size"))
    syns = core.where(F.col("syn_group").isNotNull()).join(syn, "syn_group") \
        .where(F.col("syn_lower") != F.lower("stem")) \
        .select("query_id", "pos", (F.col("syn_pos") + 10).alias("alt_no"), F.lit(0).alias("part_no"),
                F.col("syn_term").alias("term"), F.lit("synonym").alias("kind"),
                F.lit(WEIGHT_SYNONYM).alias("weight"), F.lit(1).alias("alt_size"))
    comp = _decompose(core, lex, frames)

    # Q8: a token whose synonym set meets the single-term alternatives of an earlier token is dropped
    single_alts = exact.unionByName(orig).unionByName(syns) \
        .select("query_id", F.col("pos").alias("pos_i"), F.lower("term").alias("key"))
    own_set = core.select("query_id", F.col("pos").alias("pos_j"),
                          F.col("syn_group"), F.lower("stem").alias("lstem"))
    own_keys = own_set.join(syn.select("syn_group", "syn_lower"), "syn_group", "left") \
        .select("query_id", "pos_j", F.coalesce("syn_lower", "lstem").alias("key"))
    dropped = own_keys.join(single_alts, ["query_id", "key"]) \
        .where(F.col("pos_i") < F.col("pos_j")).select("query_id", F.col("pos_j").alias("pos")).distinct()
    kept = core.join(dropped, ["query_id", "pos"], "left_anti")
    kept = scratch.write(kept.withColumn("group_no", F.row_number().over(
        Window.partitionBy("query_id").orderBy("pos")) - 1), "concepts")

    alts = exact.unionByName(orig).unionByName(syns).unionByName(comp)
    alts = alts.join(kept.select("query_id", "pos", "group_no", F.col("stem").alias("primary")),
                     ["query_id", "pos"])

    # Q10: neighbours whose concatenation is a known compound or a multi-member synonym
    nxt = kept.withColumn("next_stem", F.lead("stem").over(Window.partitionBy("query_id").orderBy("group_no")))
    nxt = nxt.where(F.col("next_stem").isNotNull()) \
        .withColumn("joined", F.concat("stem", "next_stem"))
    known_compounds = frames.compounds.select("compound").distinct()
    multi_syn = (frames.synonyms.groupBy("syn_group").agg(F.count("*").alias("n"))
                 .where("n > 1").join(frames.synonyms, "syn_group").select("syn_lower").distinct())
    j1 = nxt.join(known_compounds, nxt.joined == F.col("compound"), "left_semi")
    j2 = nxt.join(multi_syn, F.lower(nxt.joined) == F.col("syn_lower"), "left_semi")
    joined = j1.unionByName(j2).dropDuplicates(["query_id", "group_no"]).select(
        "query_id", "pos", F.lit(200).alias("alt_no"), F.lit(0).alias("part_no"),
        F.col("joined").alias("term"), F.lit("compound-joined").alias("kind"),
        F.lit(WEIGHT_PHRASE).alias("weight"), F.lit(1).alias("alt_size"),
        "group_no", F.col("stem").alias("primary"))

    terms = alts.unionByName(joined).select(
        "query_id", "group_no", "alt_no", "part_no", "term", "kind",
        F.col("weight").cast("decimal(3,2)").alias("weight"), "alt_size", "primary")

    phrases = s.select("query_id", F.posexplode("phrases").alias("phrase_no", "phrase"))

    # Q11 / Q12: plan metadata and route
    words = tok.select("query_id", "pos", "stem", "cls").distinct().groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("cls") == "generic", F.struct("pos", "stem")))).alias("_g"),
        F.sort_array(F.collect_list(F.when(F.col("cls") == "intent", F.struct("pos", "stem")))).alias("_i"))
    words = words.select("query_id", F.transform("_g", lambda x: x["stem"]).alias("generic"),
                         F.transform("_i", lambda x: x["stem"]).alias("intent"))
    groups = kept.groupBy("query_id").agg(
        F.count("*").alias("n_groups"),
        F.sort_array(F.collect_list(F.struct("group_no", F.col("stem").alias("primary")))).alias("primaries"))
    empty = F.array().cast("array<string>")
    meta = s.select("query_id", "q", "region", "open_only", "page", "page_size", "normalized",
                    "corrections", "phrases") \
        .join(words, "query_id", "left").join(groups, "query_id", "left")
    meta = meta.select(
        "query_id", "q", "region", "open_only", "page", "page_size", "normalized", "corrections",
        F.size("phrases").alias("n_phrases"),
        F.coalesce("n_groups", F.lit(0)).cast("int").alias("n_groups"),
        F.coalesce("generic", empty).alias("generic"),
        F.coalesce("intent", empty).alias("intent"),
        F.coalesce("primaries", F.array().cast("array<struct<group_no:int,primary:string>>")).alias("primaries"),
    )
    any_term = (F.col("n_groups") + F.col("n_phrases") + F.size("generic") + F.size("intent")) > 0
    meta = meta.withColumn(
        "route",
        F.when((F.col("q") == "") | ~any_term, F.lit("browse"))
         .when((F.col("n_groups") == 0) & (F.col("n_phrases") == 0), F.lit("weak"))
         .otherwise(F.lit("ranked")))
    meta = meta.withColumn(
        "warning",
        F.when((F.col("n_groups") == 0) & (F.col("n_phrases") == 0)
               & ((F.size("generic") + F.size("intent")) > 0), F.lit("generic-only")))
    # read by every later branch: written once instead of derived anew per branch
    return Plan(terms=scratch.write(terms, "terms"), phrases=scratch.write(phrases, "phrases"),
                meta=scratch.write(meta, "meta"), limits=limits)


def _decompose(core: DataFrame, lex: Lexicon, frames: LexiconFrames) -> DataFrame:
    """Q9: dictionary compound parts, else the first split into two known words (length >= 4)."""
    cols = ["query_id", "pos", "alt_no", "part_no", "term", "kind", "weight", "alt_size"]
    dict_parts = core.join(frames.compounds, core.stem == F.col("compound")).select(
        "query_id", "pos", F.lit(100).alias("alt_no"), "part_no", F.col("part").alias("term"),
        F.lit("compound").alias("kind"), F.lit(WEIGHT_COMPOUND).alias("weight"),
        F.col("n_parts").alias("alt_size"))
    in_dict = core.join(frames.compounds.select("compound").distinct(),
                        core.stem == F.col("compound"), "left_semi")
    rest = core.join(in_dict.select("query_id", "pos"), ["query_id", "pos"], "left_anti") \
        .where(F.length("stem") >= 4)
    known = frames.synonyms.select(F.col("syn_lower").alias("k")).distinct()
    splits = rest.select("query_id", "pos", "stem",
                         F.explode(F.sequence(F.lit(2), F.length("stem") - 2)).alias("cut"))
    splits = splits.withColumn("a", F.col("stem").substr(F.lit(1), F.col("cut"))) \
                   .withColumn("b", F.col("stem").substr(F.col("cut") + 1, F.length("stem")))
    ok = splits.join(known.withColumnRenamed("k", "ka"), F.lower("a") == F.col("ka"), "left_semi") \
               .join(known.withColumnRenamed("k", "kb"), F.lower("b") == F.col("kb"), "left_semi")
    best = ok.groupBy("query_id", "pos").agg(F.min(F.struct("cut", "a", "b")).alias("m"))
    fallback = best.select("query_id", "pos", F.explode(F.array(
        F.struct(F.lit(0).alias("part_no"), F.col("m.a").alias("term")),
        F.struct(F.lit(1).alias("part_no"), F.col("m.b").alias("term")))).alias("p")).select(
        "query_id", "pos", F.lit(100).alias("alt_no"), F.col("p.part_no").alias("part_no"),
        F.col("p.term").alias("term"), F.lit("compound").alias("kind"),
        F.lit(WEIGHT_COMPOUND).alias("weight"), F.lit(2).alias("alt_size"))
    return dict_parts.select(*cols).unionByName(fallback.select(*cols))
