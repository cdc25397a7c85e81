"""Profile, item and document-workflow operators (P1-P16), as batches over keyed tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.korean import cut, strip
from tidewater.functions.text import leading_int

# --- fixed values: texts and codes of the catalogue's workflow ---
SLIDES = [("표지", "사업 아이템명 · 대표자명"), ("문제인식", "시장 현황 및 문제점"), ("솔루션", "제품·서비스 개요"), ("차별성", "차별화 전략 3가지"),
          ("실현가능성", "마일스톤 타임라인"), ("시장성", "시장 규모·확장 계획"), ("팀", "대표자 경력·역량"), ("자금운용", "지원금 사용 계획"), ("클로징", "한 줄 요약")]
SLIDE_BODY, SLIDE_VISUAL = "%s 슬라이드 본문 (목업)", "표/그래프/이미지 제안 (목업)"
AREAS = [("문제-해결 적합성", "problem_fit"), ("시장 크기·성장성", "market"), ("실행 역량", "founder_fit"), ("차별성·진입장벽", "differentiation"), ("확장 가능성", "scalability")]
STRENGTH, GAP = ("강점", "%s — 입력 내용 기준 강점으로 평가됩니다."), ("보완", "%s — 구체적 근거·정량 목표 보강을 권장합니다.")
NAME_TYPES = ["기본형", "차별성 강조형", "시장 기회형"]
SECTIONS = [("problem", "1. 문제 인식"), ("feasibility", "2. 실현 가능성"), ("growth", "3. 성장 전략"), ("team", "4. 팀 구성")]
REGENERATED = "[재생성됨] 이 섹션은 새로 생성된 샘플 내용입니다. 실제 재생성은 순차 오픈됩니다."
DRAFTING = "PLAN_DRAFTING"
STATUSES = ("pending", "contacted", "completed")
LEAD_TYPES = ("예비창업자", "소상공인")
PHONE_RE = r"^[0-9\-+\s()]{7,20}\z"
DEFAULT_NAME = "카카오 사용자"
MEMO_CHARS, INTERESTS, PROFILE_SEGMENTS = 5000, 10, 9


def blank_to_null(c) -> Column:
    c = c if isinstance(c, Column) else F.col(c)
    return F.when(c != "", c)


def _last(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key (partial aggregation)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_l")).select(key, "_l.*")


#: Columns of a profile that a change replaces, and of its business satellite.
PROFILE_FIELDS = ["biz_name", "founded_year", "industry_code", "region_sido", "region_sigungu", "employee_cnt", "revenue_band", "segments"]
BUSINESS_FIELDS = ["biz_summary", "product_desc", "core_tech", "competitive_edge"]


def merge_profiles(state: DataFrame, changes: DataFrame, now, segments: int | None = None) -> DataFrame:
    """Full-row upsert by user_id; the last change of a user wins; blanks become NULL, the employee
    count is the text's leading whole number (0 counts as none), all segments stay, or the first ``segments``.
    ``updated_at`` moves to ``now`` for changed and new profiles only.

    state: user_id, PROFILE_FIELDS, updated_at; changes: the same with employees (text) for employee_cnt, and seq
    """
    segs = F.coalesce("segments", F.array().cast("array<string>"))
    made = {"biz_name": F.col("biz_name"), "employee_cnt": F.nullif(leading_int(F.col("employees")), F.lit(0)),
            "segments": segs if segments is None else F.slice(segs, 1, segments)}
    c = _last(changes, "user_id", "seq").select("user_id", F.struct(*[made.get(f, blank_to_null(f)).alias(f) for f in PROFILE_FIELDS]).alias("_new"))
    j = state.join(c, "user_id", "full_outer")
    touched = F.col("_new").isNotNull()
    return j.select("user_id", *[F.when(touched, F.col("_new")[f]).otherwise(F.col(f)).alias(f) for f in PROFILE_FIELDS],
                    F.when(touched, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"), touched.alias("touched"))


def merge_satellite(state: DataFrame, profiles: DataFrame, changes: DataFrame, fields: list[str] = BUSINESS_FIELDS) -> DataFrame:
    """The satellite row that is saved along with a profile, one per profile_id: the last change of a user replaces
    the whole row, blanks become NULL.  ``profiles`` (user_id, profile_id) are those after the merge; a change of a user without a profile is not kept.
    """
    c = _last(changes.select("user_id", "seq", *fields), "user_id", "seq").join(profiles.select("user_id", "profile_id"), "user_id")
    c = c.select("profile_id", F.struct(*[blank_to_null(f).alias(f) for f in fields]).alias("_new"))
    j = state.join(c, "profile_id", "full_outer")
    return j.select("profile_id", *[F.when(F.col("_new").isNotNull(), F.col("_new")[f]).otherwise(F.col(f)).alias(f) for f in fields])


def profile_wide(profiles: DataFrame, overview: DataFrame, problem: DataFrame, differentiation: DataFrame, names: DataFrame) -> DataFrame:
    """Profile beside its satellites (each keyed by profile_id) and its selected name; missing parts are NULL."""
    chosen = names.where("selected").select("profile_id", F.col("suggestion_text").alias("item_name"))
    return profiles.join(overview, "profile_id", "left").join(problem, "profile_id", "left") \
        .join(differentiation, "profile_id", "left").join(chosen, "profile_id", "left")


def name_candidates(wide: DataFrame) -> DataFrame:
    """Three templated names per profile that has any item text."""
    has = F.coalesce("core_function", "customer_benefit", "problem_point").isNotNull()
    kw = F.coalesce(blank_to_null("core_function"), blank_to_null("industry_code"), F.lit("혁신 기술"))
    benefit = F.coalesce(blank_to_null("customer_benefit"), F.lit("맞춤형"))
    target = F.when(F.coalesce(F.array_contains("segments", "SMB"), F.lit(False)), F.lit("소상공인")).otherwise(F.lit("창업기업"))
    texts = [F.format_string("%s 기반 %s 플랫폼", kw, benefit), F.format_string("기존 방식 대체 %s 솔루션", kw), F.format_string("%s 맞춤 %s 서비스", target, benefit)]
    rows = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(n).alias("type"), t.alias("suggestion_text")) for i, (n, t) in enumerate(zip(NAME_TYPES, texts))])
    return wide.where(has).select("profile_id", F.inline(rows))


def select_one(candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """Exactly the chosen candidate (profile_id, no) of a profile is selected; profiles without a choice stay as they are."""
    c = _last(choices, "profile_id", "seq").select("profile_id", F.col("no").alias("_no"))
    return candidates.join(c, "profile_id", "left").withColumn(
        "selected", F.when(F.col("_no").isNull(), F.col("selected")).otherwise(F.col("no") == F.col("_no"))).drop("_no")


def rubric(text: Column) -> Column:
    """P5: clamp(2 + floor(len/30), 2, 5)."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.least(F.lit(5), F.greatest(F.lit(2), F.lit(2) + F.floor(n / 30))).cast("int")


def rubric_scores(wide: DataFrame) -> DataFrame:
    """P5: four text scores and 3, 4 or 5 by the number of strategies."""
    count = sum((F.coalesce(F.col(f"strategy_{i}") != "", F.lit(False)).cast("int") for i in (1, 2, 3)), F.lit(0))
    return wide.select(
        "profile_id", rubric(F.col("problem_point")).alias("problem_fit"), rubric(F.col("market_status")).alias("market"),
        rubric(F.col("core_tech")).alias("founder_fit"), F.when(count >= 3, 5).when(count == 2, 4).otherwise(3).alias("differentiation"),
        rubric(F.col("customer_benefit")).alias("scalability"))


def strengths_gaps(scores: DataFrame) -> DataFrame:
    """The best three areas as strengths, the worst three (worst first) as gaps; ties keep the areas' order
    (reversed among gaps).  Five areas a profile: sorted as an array, without a shuffle."""
    areas = F.array(*[F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("pos"), F.lit(n).alias("area")) for i, (n, c) in enumerate(AREAS)])
    ranked = F.array_sort(areas)
    note = lambda kind, text, a, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("int").alias("rank"), a["area"].alias("area"), F.format_string(text, a["area"]).alias("text"))
    rows = F.concat(F.transform(F.slice(ranked, 1, 3), lambda a, i: note(*STRENGTH, a, i)), F.transform(F.reverse(F.slice(ranked, -3, 3)), lambda a, i: note(*GAP, a, i)))
    return scores.select("profile_id", F.inline(rows))


def draft_sections(applications: DataFrame, wide: DataFrame, notices: DataFrame, old: DataFrame) -> DataFrame:
    """Four sections per application (plan_id, profile_id, program_id); they replace the plan's earlier ones.

    Applications of unknown notices or profiles are left out.
    """
    a = applications.join(notices.select("program_id", F.col("name").alias("prog_name")), "program_id").join(wide, "profile_id")
    name = F.coalesce(blank_to_null("item_name"), blank_to_null("biz_name"), F.lit("본 사업"))
    or_ = lambda c, text: F.coalesce(blank_to_null(c), F.lit(text))
    bodies = {
        "problem": F.format_string("「%s」 지원을 위한 문제 인식\n\n%s 본 사업 「%s」은 이 문제를 정조준합니다.\n\n(목업 — AI 연동 시 공고 평가항목·시장데이터 기반 자동 작성)",
                                   "prog_name", or_("problem_point", "대상 시장에는 해결되지 않은 문제가 존재합니다."), name),
        "feasibility": F.format_string("실현 가능성\n\n%s을 통해 %s를 제공합니다. 사업기간 내 MVP 개발·검증을 완료할 계획입니다.\n\n(목업)", or_("core_function", "핵심 기능"), or_("customer_benefit", "고객 가치")),
        "growth": F.lit("성장 전략\n\n초기 목표 시장을 확보한 뒤 인접 시장으로 확장합니다. 정부지원사업 선정으로 성장을 가속합니다.\n\n(목업)"),
        "team": F.format_string("팀 구성\n\n대표자의 %s을 중심으로 핵심 인력을 구성합니다.\n\n(목업)", or_("core_tech", "전문성")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("section_key"), F.lit(t).alias("section_title"), bodies[k].alias("content"), F.lit(1).alias("version")) for k, t in SECTIONS])
    new = a.select("plan_id", F.inline(rows))
    kept = old.join(a.select("plan_id").distinct(), "plan_id", "left_anti")
    return new.unionByName(kept.select(*new.columns))


def regenerate(sections: DataFrame, requests: DataFrame, content: str = REGENERATED) -> tuple[DataFrame, DataFrame]:
    """Each request adds 1 to the version of its (plan, section) and renews the content; others
    unchanged; requests of unknown keys are the second result."""
    keys = ["plan_id", "section_key"]
    hit = requests.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    out = sections.join(hit, keys, "left").withColumns({
        "version": F.col("version") + F.coalesce("_n", F.lit(0)),
        "content": F.when(F.col("_n").isNotNull(), F.lit(content)).otherwise(F.col("content"))}).drop("_n")
    return out, requests.join(sections.select(*keys), keys, "left_anti")


def draft_slides(plans: DataFrame) -> DataFrame:
    """Nine ordered slides per plan (a literal outline, no join)."""
    outline = F.array(*[F.struct(F.lit(i + 1).alias("order_no"), F.lit(t).alias("slide_type"), F.lit(h).alias("headline"), F.lit(SLIDE_BODY % t).alias("body_content"),
                                 F.lit(SLIDE_VISUAL).alias("visual_suggestion")) for i, (t, h) in enumerate(SLIDES)])
    return plans.select("plan_id", F.inline(outline))


def owned(rows: DataFrame, plans: DataFrame, applications: DataFrame, asked: DataFrame) -> DataFrame:
    """P10: rows (plan_id, ...) for each (plan_id, user_id) asked whose application belongs to that user."""
    owners = plans.join(applications.select("application_id", "user_id"), "application_id").select("plan_id", "user_id")
    ok = asked.distinct().join(owners, ["plan_id", "user_id"], "left_semi")
    return rows.join(ok, "plan_id")


def upsert_applications(state: DataFrame, requests: DataFrame, notices: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """One application per (user_id, program_id), new or set back to drafting; requests of
    unknown notices are the second result."""
    keys = ["user_id", "program_id"]
    known = notices.select("program_id").distinct()
    ok = requests.join(known, "program_id", "left_semi").select(*keys).distinct().withColumn("_req", F.lit(True))
    out = state.join(ok, keys, "full_outer")
    asked = F.col("_req").isNotNull()
    out = out.select(*keys, F.when(asked, F.lit(DRAFTING)).otherwise(F.col("status")).alias("status"),
                     F.when(asked, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"))
    return out, requests.join(known, "program_id", "left_anti")


def snapshot_context(requests: DataFrame, profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Request with a JSON snapshot of its user's profile and contact data as of now (null where missing)."""
    p = profiles.select("user_id", F.struct("biz_name", "segments", "industry_code", "region_sido").alias("profile"))
    u = users.select(F.col("id").alias("user_id"), F.struct("name", "email", "phone").alias("user"))
    j = requests.join(p, "user_id", "left").join(u, "user_id", "left")
    return j.withColumn("context", F.to_json(F.struct("profile", "user"), {"ignoreNullFields": "false"})).drop("profile", "user")


def apply_patches(state: DataFrame, patches: DataFrame, now=None, seq: str = "seq", allowed=STATUSES, memo_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Partial updates of status and memo; a patch with an unknown status is rejected whole (second result).

    Several patches of one id act in order: each field takes its last value.  ``updated_at`` moves to ``now`` where a
    patch holds a field, also if its value is the old one; a patch without fields changes nothing.
    Without ``now`` times are left alone.
    """
    good = F.col("status").isNull() | F.col("status").isin(*allowed)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))
    p = patches.where(good).groupBy("id").agg(last("status").alias("_st"), cut(last("memo"), memo_chars).alias("_memo"))
    moved = F.col("_st").isNotNull() | F.col("_memo").isNotNull()
    time = {} if now is None else {"updated_at": F.when(moved, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}
    out = state.join(p, "id", "left").withColumns({**time, "status": F.coalesce("_st", "status"), "memo": F.coalesce("_memo", "memo")}).drop("_st", "_memo")
    return out, patches.where(~good)


def validate_submissions(leads: DataFrame, interests: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid leads, rejects with ``reasons``); trimmed name and phone, all interests or the first ``interests``."""
    size = lambda c, lo, hi: F.coalesce(F.length(c), F.lit(0)).between(lo, hi)
    name, phone = strip(F.coalesce("name", F.lit(""))), strip(F.coalesce("phone", F.lit("")))
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin(*LEAD_TYPES), F.lit(False)), F.lit("type")), F.when(~size(name, 1, 50), F.lit("name")),
        F.when(~phone.rlike(PHONE_RE), F.lit("phone")), F.when(~size(F.col("message"), 0, 2000), F.lit("message")),
        F.when(~size(strip(F.coalesce("company_name", F.lit(""))), 0, 100), F.lit("company_name")),
        F.when(~size(strip(F.coalesce("consult_type", F.lit(""))), 0, 100), F.lit("consult_type"))))
    first = F.coalesce("interests", F.array().cast("array<string>"))
    j = leads.withColumns({"name": name, "phone": phone, "interests": first if interests is None else F.slice(first, 1, interests), "reasons": reasons})
    return j.where(F.size("reasons") == 0).drop("reasons"), j.where(F.size("reasons") > 0)


def validate_items(strategies: Column) -> Column:
    """Exactly three non-blank strategies."""
    return F.size(F.filter(F.transform(strategies, lambda s: strip(F.coalesce(s, F.lit("")))), lambda s: s != "")) == 3


def fill_defaults(users: DataFrame, fresh: DataFrame) -> DataFrame:
    """Only the placeholder name and a missing phone are replaced by fresher data (id, name, phone)."""
    f = fresh.select("id", F.col("name").alias("_name"), F.col("phone").alias("_phone"))
    j = users.join(f, "id", "left")
    name = F.when((F.col("name") == DEFAULT_NAME) & F.col("_name").isNotNull(), F.col("_name")).otherwise(F.col("name"))
    phone = F.when(F.coalesce(F.col("phone"), F.lit("")) == "", F.coalesce(blank_to_null("_phone"), F.col("phone"))).otherwise(F.col("phone"))
    return j.withColumns({"name": name, "phone": phone}).drop("_name", "_phone")

