"""Profile x notice matching (M1-M6) without enumerating profile x notice pairs.

Hard filter and score depend only on a profile's (segments, stages, industry)
and a notice's (target segments, target stages, target industries).  So both
sides are first reduced to their distinct signatures ("classes", a partial
aggregation), candidate class pairs are found by an equi-join on shared
segment/stage tokens (never a cross join), scored once per class pair, and
expanded back:

* total per profile = sum of notice counts of the passing classes;
* a page per profile = per passing class its page * page_size lowest program ids (bounded
  WindowGroupLimit), merged by (score desc, program_id asc) and cut to the page.

Work and shuffle volume grow with the number of signatures, not with
profiles x notices; a segment held by a third of all profiles is one class row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.constants import NOT_FOUNDED

SMB_STAGE = "소상공인"
STAGE_PRE, STAGE_Y1, STAGE_Y13, STAGE_Y37 = "예비", "1년미만", "1-3년", "3-7년"
# fixed values: evidence texts
EV_SEGMENT, EV_STAGE, EV_ALL_INDUSTRY, EV_INDUSTRY = "세그먼트 일치", "사업 단계 적합", "전 업종 대상", "업종 적합"


def derive_stages(founded_year: Column, segments: Column, as_of_year: int = 2026) -> Column:
    """M1: founding-year text -> stage; SMB segment adds the small-business stage; default pre-founding."""
    y = as_of_year
    stage = (F.when(founded_year == NOT_FOUNDED, F.lit(STAGE_PRE))
              .when(founded_year.isin(str(y), str(y - 1)), F.lit(STAGE_Y1))
              .when(founded_year.isin(str(y - 2), str(y - 3)), F.lit(STAGE_Y13))
              .when(founded_year.isNotNull() & (founded_year != ""), F.lit(STAGE_Y37)))
    smb = F.when(F.array_contains(F.coalesce(segments, F.array().cast("array<string>")), "SMB"), F.lit(SMB_STAGE))
    st = F.array_compact(F.array(stage, smb))
    return F.when(F.size(st) == 0, F.array(F.lit(STAGE_PRE))).otherwise(st)


def _empty() -> Column:
    return F.array().cast("array<string>")


def profile_classes(profiles: DataFrame, as_of_year: int) -> DataFrame:
    p = profiles.select(
        "profile_id",
        F.array_sort(F.array_distinct(F.coalesce("segments", _empty()))).alias("p_segs"),
        F.array_sort(F.array_distinct(derive_stages(F.col("founded_year"), F.col("segments"), as_of_year)))
         .alias("p_stages"),
        F.col("industry_code").alias("p_ind"))
    return p


def notice_classes(notices: DataFrame) -> DataFrame:
    return notices.select(
        "program_id",
        F.coalesce("target_segments", _empty()).alias("t_segs"),
        F.array_sort(F.array_distinct(F.coalesce("target_stages", _empty()))).alias("t_stages"),
        F.array_sort(F.array_distinct(F.coalesce("target_industries", _empty()))).alias("t_inds"))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """M3-M5 on rows carrying p_segs, p_stages, p_ind, t_segs, t_stages, t_inds."""
    ov = F.filter("t_segs", lambda s: F.array_contains(F.col("p_segs"), s))
    stage_match = F.exists("t_stages", lambda s: F.array_contains(F.col("p_stages"), s))
    n_ind = F.size("t_inds")
    ind_match = (n_ind == 0) | (F.col("p_ind").isNotNull() & F.array_contains("t_inds", F.col("p_ind")))
    out = pairs.withColumn("_ov", ov).withColumn("_sm", stage_match).withColumn("_im", F.coalesce(ind_match, F.lit(False)))
    out = out.where(((n_ind == 0) | F.col("_im")) & ((F.size("_ov") > 0) | F.col("_sm")))
    nt = F.size("t_segs")
    # round-half-up of 50 * overlap / targets in integers
    seg = F.when(nt == 0, F.lit(25)).otherwise(F.floor((F.size("_ov") * 100 + nt) / (2 * nt)).cast("int"))
    stage = F.when(F.col("_sm"), F.lit(25)).otherwise(F.lit(8))
    ind = F.when(F.col("_im"), F.lit(15)).otherwise(F.lit(8))
    total = F.least(F.lit(100), F.greatest(F.lit(0), seg + stage + ind + F.lit(6)))
    evidence = F.array_compact(F.array(
        F.when(F.size("_ov") > 0, F.concat(F.lit(EV_SEGMENT + " ("), F.array_join("_ov", ", "), F.lit(")"))),
        F.when(F.col("_sm"), F.lit(EV_STAGE)),
        F.when(n_ind == 0, F.lit(EV_ALL_INDUSTRY)).when(F.col("_im"), F.lit(EV_INDUSTRY))))
    return out.select(
        "*", total.cast("int").alias("match_score"),
        F.struct(seg.cast("int").alias("segment"), stage.alias("stage"), ind.alias("industry"),
                 F.lit(6).alias("base")).alias("breakdown"),
        evidence.alias("evidence")).drop("_ov", "_sm", "_im")


def _class_pairs(pc: DataFrame, nc: DataFrame) -> DataFrame:
    """M2: class pairs sharing a segment or a stage (equi-join on tokens, distinct)."""
    pt = pc.select("pkey", F.explode(F.concat(
        F.transform("p_segs", lambda s: F.concat(F.lit("seg:"), s)),
        F.transform("p_stages", lambda s: F.concat(F.lit("stage:"), s)))).alias("tok"))
    nt = nc.select("nkey", F.explode(F.concat(
        F.transform("t_segs", lambda s: F.concat(F.lit("seg:"), s)),
        F.transform("t_stages", lambda s: F.concat(F.lit("stage:"), s)))).alias("tok"))
    return pt.join(nt, "tok").select("pkey", "nkey").distinct()


def match(profiles: DataFrame, notices: DataFrame, page: int = 1, page_size: int = 10, as_of_year: int = 2026):
    """M2-M6: (one page of ranked matches per profile, total matches per profile).

    Any page can be asked for; work grows with ``page * page_size``, not with all profile x notice pairs.
    """
    k = page * page_size
    p = profile_classes(profiles, as_of_year)
    p = p.withColumn("pkey", F.sha2(F.to_json(F.struct("p_segs", "p_stages", "p_ind")), 256))
    n = notice_classes(notices)
    n = n.withColumn("nkey", F.sha2(F.to_json(F.struct("t_segs", "t_stages", "t_inds")), 256))
    pc = p.groupBy("pkey").agg(F.first("p_segs").alias("p_segs"), F.first("p_stages").alias("p_stages"),
                               F.first("p_ind").alias("p_ind"))
    nc = n.groupBy("nkey").agg(F.first("t_segs").alias("t_segs"), F.first("t_stages").alias("t_stages"),
                               F.first("t_inds").alias("t_inds"), F.count(F.lit(1)).alias("n_count"))
    pairs = _class_pairs(pc, nc).join(pc, "pkey").join(nc, "nkey")
    scored = score_pairs(pairs).select("pkey", "nkey", "n_count", "match_score", "breakdown", "evidence")

    totals = scored.groupBy("pkey").agg(F.sum("n_count").alias("total"))
    # k lowest program ids of every notice class (partial limit before the shuffle)
    nk = n.withColumn("_r", F.row_number().over(Window.partitionBy("nkey").orderBy("program_id"))) \
          .where(F.col("_r") <= k).select("nkey", "program_id")
    cand = scored.join(nk, "nkey")
    w = Window.partitionBy("pkey").orderBy(F.col("match_score").desc(), F.col("program_id").asc())
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    pid = p.select("profile_id", "pkey")
    ranked = pid.join(top.where(F.col("rank") > k - page_size), "pkey").select("profile_id", "rank", "program_id", "match_score",
                                          "breakdown", "evidence")
    tot = pid.join(totals, "pkey", "left").select(
        "profile_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    return ranked, tot

