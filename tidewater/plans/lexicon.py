"""Search lexicons: user-supplied vocabularies the planner and expansion join against.

A ``Lexicon`` holds plain Python lists (small, bounded by the vocabulary, not by
the corpus).  ``frames()`` turns them into DataFrames that the planner joins; spelling fixes
and word classes of any number are passed to it as tables instead.
The default lexicon below is our own small English vocabulary for the driver
corpus; callers pass their own (for example a Korean notice vocabulary).
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewater.functions.constants import ENDINGS, PARTICLES
from tidewater.sources.local import literal_frame


@dataclass
class Lexicon:
    generic: list[str] = field(default_factory=list)
    intent: list[str] = field(default_factory=list)
    synonym_groups: list[list[str]] = field(default_factory=list)   # [0] is the head word
    spelling: list[tuple[str, str]] = field(default_factory=list)   # (from, to), list order kept on ties
    compounds: list[tuple[str, list[str]]] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=lambda: ENDINGS + PARTICLES)
    # domain key -> (label, agencies, terms); dict order is the domain order
    domains: dict[str, tuple[str, list[str], list[str]]] = field(default_factory=dict)
    seeds: dict[str, list[str]] = field(default_factory=dict)      # item word -> domain keys

    def frames(self, spark: SparkSession, spelling: DataFrame | None = None, classes: DataFrame | None = None) -> "LexiconFrames":
        """``spelling`` (src, dst, no) and ``classes`` (word, cls: generic or intent) take the place of the lists."""
        return LexiconFrames(self, spark, spelling, classes)


class LexiconFrames:
    def __init__(self, lex: Lexicon, spark: SparkSession, spelling: DataFrame | None = None, classes: DataFrame | None = None):
        self.lex = lex
        self.spelling: DataFrame = spelling if spelling is not None else literal_frame(
            spark, [(a, b, n) for n, (a, b) in enumerate(lex.spelling)], [("src", "string"), ("dst", "string"), ("no", "bigint")])
        self.classes: DataFrame = classes if classes is not None else literal_frame(
            spark, [(w, "generic") for w in lex.generic] + [(w, "intent") for w in lex.intent], [("word", "string"), ("cls", "string")])
        self.synonyms: DataFrame = literal_frame(
            spark, [(g, p, t, t.lower()) for g, grp in enumerate(lex.synonym_groups) for p, t in enumerate(grp)],
            [("syn_group", "int"), ("syn_pos", "int"), ("syn_term", "string"), ("syn_lower", "string")])
        self.compounds: DataFrame = literal_frame(
            spark, [(c, p, part, len(parts)) for c, parts in lex.compounds for p, part in enumerate(parts)],
            [("compound", "string"), ("part_no", "int"), ("part", "string"), ("n_parts", "int")])
        dom_rows = []
        for d_no, (key, (label, agencies, terms)) in enumerate(lex.domains.items()):
            for pos, t in enumerate(list(agencies) + list(terms)):
                dom_rows.append((key, d_no, label, pos, t))
        self.domain_terms: DataFrame = literal_frame(
            spark, dom_rows, [("domain_key", "string"), ("domain_no", "int"), ("label", "string"),
                              ("qpos", "int"), ("term", "string")])
        seed_rows = []
        for order, (seed, keys) in enumerate(lex.seeds.items()):
            for k_no, k in enumerate(keys):
                seed_rows.append((seed, order, k_no, k))
        self.seeds: DataFrame = literal_frame(
            spark, seed_rows, [("seed", "string"), ("seed_order", "int"), ("key_no", "int"),
                               ("domain_key", "string")])


# ---------------------------------------------------------------------------
# Our own vocabulary for the driver corpus (documents), not a notice dictionary.
# ---------------------------------------------------------------------------

DOCS_LEXICON = Lexicon(
    generic=["the", "and", "under", "of", "is", "a"],
    intent=["find", "notice", "notices"],
    synonym_groups=[
        ["license", "licensed", "licence"],
        ["apache", "mit", "gnu"],
        ["token", "secret"],
        ["free", "gratis"],
        ["version", "release"],
    ],
    spelling=[("licnese", "license"), ("apahce", "apache"), ("open source", "opensource")],
    compounds=[("apachelicense", ["apache", "license"]), ("opensource", ["open", "source"])],
    domains={
        "security": ("Security", ["src3"], ["token", "secret", "key"]),
        "legal": ("Legal", ["src1", "src2"], ["license", "copyright", "warranty"]),
        "web": ("Web", [], ["http", "html", "cookie"]),
    },
    seeds={"password": ["security", "legal"], "cookie": ["web", "security"]},
)
