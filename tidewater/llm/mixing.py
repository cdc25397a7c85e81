"""Mixing sources to target weights by hierarchical budgeting (native).

The token supply is summed over a domain > language > source tree (partial
aggregation; the tree is small, the rows are not).  A token budget enters at the root and
is divided by the children's integer weights; a child never gets more than its subtree can
supply in ``max_epochs`` passes, and what it cannot use goes to its siblings before any
other branch sees it, because a branch's own share was cut to its subtree's supply one
level above.  Each leaf then takes whole epochs and a token-prefix of one more epoch in
seeded order.

The prefix needs no sort of a whole leaf: documents fall into ORDER_BUCKETS slices of
the seeded order, slices are summed first, and only the slice that holds the end
of a leaf's prefix is ordered row by row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch, text_or_empty

ORDER_BUCKETS = 4096
SEED = "mix-1"
MAX_EPOCHS = 2
#: Targets: weights of domains, of languages within a domain, of sources within a language; others weigh DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"d0": 2, "d1": 3, "d2": 3, "d3": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
DEFAULT_WEIGHT = 1


def n_tokens(text):
    """Words: maximal runs without ASCII white space."""
    t = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def domain_of(source):
    """The tree's top level: the source's number modulo four, 'other' without a number."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(n == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(n.cast("int"), F.lit(4)).cast("string")))


def _weight(col: str, table: dict[str, int]):
    w = F.lit(DEFAULT_WEIGHT)
    for name, value in table.items():
        w = F.when(F.col(col) == name, F.lit(value)).otherwise(w)
    return w.cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add ``got``: each child's part of its parent's ``budget`` (columns: weight, cap, budget).

    Children in the order of cap per weight; a child is full if the remaining budget's
    share reaches its cap.  All in exact whole numbers; equal ratios are ordered by name.
    """
    order = [(F.col("cap").cast("double") / F.col("weight")).asc(), F.col(child).asc()]
    up = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    c = children.withColumns({"before": F.coalesce(F.sum("cap").over(up), F.lit(0)), "rest_w": F.sum("weight").over(down)})
    c = c.withColumn("full", ((F.col("budget") - F.col("before")).cast("decimal(19,0)") * F.col("weight").cast("decimal(18,0)")
                              >= F.col("cap").cast("decimal(19,0)") * F.col("rest_w").cast("decimal(18,0)")))
    c = c.withColumns({"full_cap": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)),
                       "open_w": F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)})
    part = F.expr("(cast(budget - full_cap as decimal(19,0)) * cast(weight as decimal(18,0))) div open_w")
    return c.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long")).drop("before", "rest_w", "full", "full_cap", "open_w")


def leaf_budgets(leaves: DataFrame, total, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Budgets of the leaves (domain, lang, source, supply) for ``total`` tokens at the root.

    ``total``: a Column over the root's supply, as F.col("supply"); nothing is asked
    beyond ``max_epochs`` passes over everything.
    """
    cap = leaves.withColumn("cap", F.col("supply") * max_epochs)
    lang = cap.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    root = leaves.agg(F.sum("supply").alias("supply")).select(F.least(total, F.col("supply") * max_epochs).cast("long").alias("budget"), F.lit(0).alias("one"))
    d = domain.withColumn("one", F.lit(0)).join(F.broadcast(root), "one").withColumn("weight", _weight("domain", DOMAIN_WEIGHTS))
    d = share_out(d, ["one"], "domain").select("domain", F.col("got").alias("budget"))
    l = lang.join(d, "domain").withColumn("weight", _weight("lang", LANG_WEIGHTS))
    l = share_out(l, ["domain"], "lang").select("domain", "lang", F.col("got").alias("budget"))
    s = cap.join(l, ["domain", "lang"]).withColumn("weight", _weight("source", SOURCE_WEIGHTS))
    return share_out(s, ["domain", "lang"], "source").select("domain", "lang", "source", "supply", F.col("got").alias("budget"))


def mix(docs: DataFrame, total=None, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, domain, lang, source, n_tokens, budget, copies).

    ``copies``: how often the mixture takes the row, 0 to ``max_epochs``.  Null lang or
    source: a leaf named ''.  A text without words (also null) has 0 tokens and is
    taken where the prefix covers its place.  The document at the prefix's end is taken whole if the
    budget is not yet met before it; the mixture passes a leaf's budget by less than that one
    document.  Rows with one id and one token count share their place and are taken
    together.  A leaf without tokens gets no budget; an empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    total = F.col("supply") if total is None else total
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), n_tokens(text_or_empty(text_col)).alias("n_tokens"))
    rows = scratch.write(rows.withColumn("domain", domain_of(F.col("source"))), "tokens")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("supply"))
    plan = leaf_budgets(leaves, total, max_epochs).withColumns({
        "epochs": F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0)).cast("int")})
    plan = scratch.write(plan.withColumn("more", F.col("budget") - F.col("epochs") * F.col("supply")), "plan")
    # place in the seeded order of the epoch that is taken in part; (plan: one row per leaf, joined on its key)
    r = rows.join(plan, leaf).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    r = r.withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    r = scratch.write(r, "keys")
    slices = r.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("t"), F.first("more").alias("more"))
    before = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("low", F.coalesce(F.sum("t").over(before), F.lit(0)))
    # the slices left open: at most one of each leaf ends inside, all others are taken whole or not at all
    slices = slices.select(*leaf, "slice", "low", ((F.col("low") < F.col("more")) & (F.col("low") + F.col("t") >= F.col("more"))).alias("edge"))
    r = r.join(slices, [*leaf, "slice"])
    spot = Window.partitionBy(*leaf, "slice").orderBy("key", "n_tokens")
    edge = r.where("edge").withColumn("upto", F.sum("n_tokens").over(spot.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.withColumn("upto", F.col("upto") - F.sum("n_tokens").over(Window.partitionBy(*leaf, "slice", "key", "n_tokens")))
    whole = r.where("not edge").withColumn("upto", F.lit(0).cast("long"))
    out = edge.unionByName(whole)
    taken = (F.col("low") + F.col("upto") < F.col("more")).cast("int")
    return out.select("id", *leaf, "n_tokens", "budget", (F.col("epochs") + taken).alias("copies"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).withColumnRenamed("id", "doc_id")


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mixture takes it (0 to MAX_EPOCHS times).

    Rows that repeat an id get the copies of each of its rows once per row.
    """
    plan = mix(docs).where("copies > 0").groupBy(F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("z"), "n_tokens", "lang", "source").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"], F.lit(0)).alias("k"), docs["doc_id"].isNull().alias("z"),
                       n_tokens(text_or_empty("text")).alias("n_tokens"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"))
    return (rows.join(plan, ["k", "z", "n_tokens", "lang", "source"])
                .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))


def _case(col: str, table: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {DEFAULT_WEIGHT} END" if table else str(DEFAULT_WEIGHT)


def _share_sql(name: str, children: str, parent: str, child: str) -> str:
    p = f"PARTITION BY {parent} " if parent else ""
    return f"""
{name}1 AS (SELECT *, coalesce(sum(cap) OVER ({p}ORDER BY cap::DOUBLE / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
  sum(weight) OVER ({p}ORDER BY cap::DOUBLE / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest_w FROM {children}),
{name}2 AS (SELECT *, (budget - before) * weight >= cap::HUGEINT * rest_w AS is_full FROM {name}1),
{name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE
  ((budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({p}), 0)::HUGEINT) * weight)
  // sum(CASE WHEN NOT is_full THEN weight END) OVER ({p})::HUGEINT END AS got FROM {name}2)"""


OP5_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::HUGEINT AS n_tokens FROM documents),
r AS (SELECT *, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 'other'
    ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4)::VARCHAR END AS domain FROM t),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply, (sum(n_tokens) * {MAX_EPOCHS})::HUGEINT AS cap FROM r GROUP BY ALL),
dl AS (SELECT domain, lang, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL),
d AS (SELECT domain, sum(cap)::HUGEINT AS cap, ({_case('domain', DOMAIN_WEIGHTS)})::HUGEINT AS weight,
    (SELECT sum(supply) FROM leaf)::HUGEINT AS budget FROM dl GROUP BY ALL),
{_share_sql('ds', 'd', '', 'domain')},
l AS (SELECT dl.*, got::HUGEINT AS budget, ({_case('lang', LANG_WEIGHTS)})::HUGEINT AS weight FROM dl JOIN (SELECT domain, got FROM ds) USING (domain)),
{_share_sql('ls', 'l', 'domain', 'lang')},
s AS (SELECT leaf.*, got::HUGEINT AS budget, ({_case('source', SOURCE_WEIGHTS)})::HUGEINT AS weight FROM leaf JOIN (SELECT domain, lang, got FROM ls) USING (domain, lang)),
{_share_sql('ss', 's', 'domain, lang', 'source')},
p AS (SELECT domain, lang, source, got AS budget, CASE WHEN supply > 0 THEN got // supply ELSE 0 END AS epochs, supply FROM ss),
k AS (SELECT r.*, budget, epochs, budget - epochs * supply AS more, md5('{SEED}:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM r JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key, n_tokens) AS ahead FROM k)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, budget::BIGINT AS budget,
    (epochs + CASE WHEN ahead < more THEN 1 ELSE 0 END)::INTEGER AS copies FROM c
"""
