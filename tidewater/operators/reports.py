"""Aggregations and reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus_meta(notices: DataFrame) -> DataFrame:
    """A1: total, open count and last sync time, one row."""
    return notices.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_open")).alias("open_count"),
        F.max("synced_at").alias("last_synced"),
    )


def portal_label(url_rules, source_rules, url="detail_url", source="source_portal", other="other"):
    """A2 CASE: URL substring rules first, then source-code rules, else ``other``."""
    expr = None
    for pattern, label in url_rules:
        cond = F.coalesce(F.col(url).contains(pattern), F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    for code, label in source_rules:
        cond = F.coalesce(F.col(source) == F.lit(code), F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(other) if expr is None else expr.otherwise(F.lit(other))


def portal_breakdown(df: DataFrame, url_rules, source_rules, url="detail_url",
                     source="source_portal") -> DataFrame:
    """A2: count per portal (partial aggregation before the shuffle; one row per portal)."""
    return (df.select(portal_label(url_rules, source_rules, url, source).alias("portal"))
              .groupBy("portal").agg(F.count(F.lit(1)).alias("count")))


def regions(notices: DataFrame) -> DataFrame:
    """A3: distinct non-empty regions, sorted."""
    return (notices.select("region").where(F.col("region").isNotNull() & (F.col("region") != ""))
                   .distinct().orderBy("region"))


def submission_stats(subs: DataFrame, startup="예비창업자", small="소상공인") -> DataFrame:
    """A4: six conditional counts in one pass."""
    return subs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("type") == startup).alias("startup"),
        F.count_if(F.col("type") == small).alias("small"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "contacted").alias("contacted"),
        F.count_if(F.col("status") == "completed").alias("completed"),
    )


def _ilike_any(cols, q):
    """Any column contains ``q`` in any case; % and _ in ``q`` are wildcards, as in the intake's own search."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    return cond


def filter_submissions(subs: DataFrame, type_=None, status=None, q=None) -> DataFrame:
    out = subs
    if type_:
        out = out.where(F.col("type") == type_)
    if status:
        out = out.where(F.col("status") == status)
    if q:
        out = out.where(_ilike_any(["name", "phone", "business_name", "company_name"], q))
    return out


def search_submissions(subs: DataFrame, type_=None, status=None, q=None, page=1,
                       page_size=20) -> tuple[DataFrame, DataFrame]:
    """A5: one page of matching leads, newest first, plus the total.

    Ordered limit with offset: per-partition top rows, then a merge; ``rn`` is numbered on the page's
    own rows.
    """
    before = (max(1, int(page)) - 1) * page_size
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    hits = filter_submissions(subs, type_, status, q)
    rows = hits.orderBy(*newest).offset(before).limit(page_size)
    rows = rows.withColumn("rn", F.row_number().over(Window.orderBy(*newest)) + before)
    return rows, hits.agg(F.count(F.lit(1)).alias("total"))


def consulting_report(consulting: DataFrame, users: DataFrame, status=None,
                      allowed=("pending", "contacted", "completed")) -> DataFrame:
    """Requests with requester columns (left join), optional whitelisted status; newest first."""
    c = consulting
    if status and status in allowed:
        c = c.where(F.col("status") == status)
    u = users.select(F.col("id").alias("u_id"), F.col("name").alias("user_name"),
                     F.col("email").alias("user_email"), F.col("phone").alias("user_phone"))
    return c.join(u, c.user_id == u.u_id, "left").drop("u_id").orderBy(F.col("created_at").desc(), F.col("id").desc())


def member_funnel(users: DataFrame, profiles: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Members with one progress flag per child table.

    ``children`` maps flag name -> DataFrame of user ids (column ``user_id``) that
    hold such a row.  Each child is reduced to its distinct keys first (partial
    aggregation, no row multiplication), then left-joined: same answer as a
    correlated EXISTS, with no per-user fan-out.
    """
    members = users.where(F.col("role").isNull() | (F.col("role") == "member"))
    p = profiles.select(F.col("user_id").alias("p_user"), "profile_id", "biz_name", "segments",
                        "industry_code")
    out = members.join(p, members.id == p.p_user, "left") \
        .withColumn("s_profile", F.col("p_user").isNotNull()).drop("p_user")
    for flag, child in children.items():
        keys = child.select(F.col("user_id").alias(f"_{flag}")).distinct()
        out = out.join(keys, out.id == keys[f"_{flag}"], "left") \
                 .withColumn(flag, F.col(f"_{flag}").isNotNull()).drop(f"_{flag}")
    return out


def active_codes(codes: DataFrame) -> DataFrame:
    """Active code table in sort order."""
    return codes.where(F.col("active")).orderBy("sort_order", "code")
