"""Jobs that the catalogue specifies for later: five-factor score, benefit exclusion, incremental re-match,
reminders, banned tokens, funnel rates, state-transition audit (D1-D4, D6-D8)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: weights of the five factors, reminder days, allowed state transitions ---
FACTORS = [("similarity", 30), ("segment_fit", 20), ("stage_fit", 20), ("amount_fit", 15), ("bonus_fit", 15)]
REMINDER_DAYS = (7, 3, 1)
TRANSITIONS = [("DIAGNOSED", "PLAN_DRAFTING"), ("PLAN_DRAFTING", "PLAN_REVIEW"), ("PLAN_REVIEW", "PLAN_DONE"), ("PLAN_DONE", "DECK_DRAFTING"),
               ("DECK_DRAFTING", "DECK_DONE"), ("DECK_DONE", "CONSULTING_REQUESTED"), ("DECK_DRAFTING", "SUBMITTED"), ("CONSULTING_REQUESTED", "SUBMITTED"),
               ("SUBMITTED", "SELECTED"), ("SUBMITTED", "REJECTED"), ("SELECTED", "AFTERCARE"), ("REJECTED", "AFTERCARE")]


def five_factor_score(pairs: DataFrame) -> DataFrame:
    """Factors between 0 and 1 (NULL counts as 0, others are clamped) as whole points of their weight; the total is their sum."""
    part = {n: F.round(F.least(F.greatest(F.coalesce(F.col(n), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * w, 0).cast("int") for n, w in FACTORS}
    out = pairs.withColumn("breakdown", F.struct(*[part[n].alias(n) for n, _ in FACTORS])).drop(*part)
    return out.withColumn("score", sum((F.col("breakdown")[n] for n, _ in FACTORS), F.lit(0)))


def program_key(name):
    """A program's name without year, numbers, punctuation, spaces and case."""
    return F.lower(F.regexp_replace(name, r"[\p{N}\p{P}\p{S}\s]+", ""))


def exclude_benefits(candidates: DataFrame, benefits: DataFrame) -> DataFrame:
    """Candidates (user_id, name, ...) without those whose program the user has benefited from, by normalized name."""
    past = benefits.select("user_id", program_key(F.col("name")).alias("_key")).distinct()
    return candidates.withColumn("_key", program_key(F.col("name"))).join(past, ["user_id", "_key"], "left_anti").drop("_key")


def rematch(old: DataFrame, fresh: DataFrame, changed_profiles: DataFrame, changed_notices: DataFrame) -> DataFrame:
    """D3: matches (profile_id, program_id, score): pairs with a changed profile or notice are replaced by ``fresh`` ones (or vanish), all others kept."""
    p = changed_profiles.select("profile_id").distinct()
    n = changed_notices.select("program_id").distinct()
    kept = old.join(p, "profile_id", "left_anti").join(n, "program_id", "left_anti")
    mine = fresh.join(p, "profile_id", "left_semi")
    others = fresh.join(p, "profile_id", "left_anti").join(n, "program_id", "left_semi")
    return kept.unionByName(mine).unionByName(others)


def reminders(saved: DataFrame, sent: DataFrame, as_of, days=REMINDER_DAYS) -> DataFrame:
    """(user_id, program_id, days_left) due on ``as_of``, each at most once over the log ``sent``."""
    due = saved.withColumn("days_left", F.date_diff("period_end", F.lit(as_of))).where(F.col("days_left").isin(*days))
    keys = ["user_id", "program_id", "days_left"]
    return due.select(*keys).distinct().join(sent.select(*keys), keys, "left_anti")


def banned_tokens(texts: DataFrame, tokens: list[str], text: str = "text") -> DataFrame:
    """Texts that hold a banned token (in any case), with the tokens found in list order."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in tokens]))
    return texts.withColumn("found", found).where(F.size("found") > 0)


def funnel_rates(members: DataFrame, steps: list[str]) -> DataFrame:
    """Per step the members that reached it and the share of those at the step before (of all for the first)."""
    sums = members.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(s)).alias(s) for s in steps])
    before = ["_all", *steps[:-1]]
    both = {s: F.count_if(F.col(s) & (F.lit(True) if b == "_all" else F.col(b))) for s, b in zip(steps, before)}
    hits = members.agg(*[c.alias(f"_{s}") for s, c in both.items()])
    j = sums.withColumn("one", F.lit(0)).join(hits.withColumn("one", F.lit(0)), "one")
    rows = [F.struct(F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"), F.col(s).alias("members"),
                     F.when(F.col(b) > 0, F.round(F.col(f"_{s}") / F.col(b), 4)).alias("rate")) for i, (s, b) in enumerate(zip(steps, before))]
    return j.select(F.inline(F.array(*rows)))


def transitions(history: DataFrame, entity: str, status: str, order: list[str]) -> DataFrame:
    """Consecutive (entity, before, after, at) of each entity's history.

    Rows follow each other within (entity, day); the days' ends meet in a second step, so
    an entity that holds a third of the history is not one task's work.
    """
    h = history.withColumn("_day", F.to_date(order[0]))
    day = Window.partitionBy(entity, "_day").orderBy(*order)
    inner = h.withColumn("before", F.lag(status).over(day)).where(F.col("before").isNotNull()).select(entity, "before", F.col(status).alias("after"), F.col(order[0]).alias("at"))
    ends = h.groupBy(entity, "_day").agg(F.min_by(status, F.struct(*order)).alias("after"), F.min(order[0]).alias("at"), F.max_by(status, F.struct(*order)).alias("_last"))
    outer = ends.withColumn("before", F.lag("_last").over(Window.partitionBy(entity).orderBy("_day"))).where(F.col("before").isNotNull())
    return inner.unionByName(outer.select(entity, "before", "after", "at"))


def illegal_transitions(history: DataFrame, allowed: DataFrame, entity: str, status: str, order: list[str]) -> DataFrame:
    """Changes of state that ``allowed`` (before, after) does not list; staying is no change."""
    steps = transitions(history, entity, status, order).where("before <> after")
    return steps.join(allowed.select("before", "after").distinct(), ["before", "after"], "left_anti")
