"""Notice-text normalization as native column expressions.

Every function takes and returns Columns (JVM regex, no Python UDF).  White space means
SPACE_CHARS everywhere (no-break and ideographic spaces included), which neither ``\\s`` nor
``trim`` of the JVM covers.  Nothing is cut by default; ``CATALOGUE_TEXT`` holds the
lengths that the notice catalogue keeps.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.constants import (NATIONAL, ORG_SUFFIXES, OTHER_FUNDING, REGION_LONG, REGIONS,
                                           SIDO_FULL)

# --- fixed values: characters that count as white space ---
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SP = f"[{SPACE_CHARS}]"
NUM = r"(\d+(?:\.\d+)?)"


def _p(pattern: str) -> str:
    """A pattern with ``\\s`` read as SPACE_CHARS (patterns below have no ``\\s`` inside brackets)."""
    return pattern.replace(r"\s", SP)


@dataclass(frozen=True)
class TextLimits:
    """Lengths to keep; None keeps all."""

    name: int | None = None
    agency: int | None = None
    field: int | None = None
    summary: int | None = None
    body: int | None = None
    amount_text: int | None = None
    labeled: int | None = None
    period_reach: int | None = None  # characters after a period's label that are searched for dates
    doc_id: int | None = None


# --- fixed values: lengths that the catalogue keeps ---
CATALOGUE_TEXT = TextLimits(name=200, agency=100, field=100, summary=500, body=2000, amount_text=120, labeled=200,
                            period_reach=60, doc_id=44)


def cut(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.substring(c, 1, chars)


def strip(c: Column) -> Column:
    """Without white space (SPACE_CHARS) at both ends."""
    return F.regexp_replace(c, f"^{SP}+|{SP}+\\z", "")


# --- fixed values: stage, segment, funding-type and tag rules (order matters) ---
STAGE_PRE_RE = r"예비\s*창업|창업\s*예정|사업자등록\s*전|아이디어\s*단계"
STAGE_SMB_RE = r"소상공인|자영업|점포|상인"
STAGE_WITHIN_RE = r"창업\s*(?:후\s*)?(\d)\s*년\s*(?:이내|미만)"
STAGE_EARLY_RE = r"초기\s*창업"
STAGE_GROWTH_RE = r"도약|스케일업|성장\s*단계"
STAGE_SEVEN_RE = r"7\s*년\s*(?:이내|미만)"
BUSINESS_RE = r"기업|사업자|소상공인|중소기업|자영업"

SEGMENT_RULES = [
    ("PRE", r"예비\s*창업|창업\s*예정|아이디어\s*단계"),
    ("EARLY", r"초기\s*창업|창업\s*[1-3]\s*년|기창업"),
    ("SMB", r"소상공인|자영업|점포|전통시장"),
    ("YOUTH", r"청년|만\s*39\s*세|39세\s*이하|20~39"),
    ("SENIOR", r"중장년|시니어|만\s*40\s*세\s*이상|4060|퇴직"),
    ("WORKER", r"재직자|직장인|부업|퇴사\s*예정"),
    ("WOMAN", r"여성"),
    ("LOAN", r"융자|대출|보증|정책자금|운전자금|시설자금"),
    ("RND", r"(?i)R\s*&\s*D|연구개발|기술개발|과제\s*수행"),
]

FUNDING_RULES = [
    ("보증", r"보증"),
    ("융자", r"융자|대출|정책자금|운전자금|시설자금"),
    ("공제", r"공제"),
    ("R&D", r"(?i)R\s*&\s*D|연구개발|기술개발|신규과제"),
    ("디지털전환", r"(?i)디지털\s*전환|스마트|키오스크|POS"),
    ("사업화", r"사업화|시제품|창업\s*패키지|입교|보육|창업\s*(?:을|를)?\s*지원"),
    ("컨설팅", r"컨설팅|멘토링|교육|바우처"),
]

TAG_RULES = [
    (r"예비\s*창업", "예비창업"), (r"청년", "청년"), (r"여성", "여성"),
    (r"중장년|시니어|퇴직", "중장년"), (r"소상공인|자영업", "소상공인"),
    (r"사업화|시제품|창업\s*패키지|보육", "사업화"), (r"멘토링|컨설팅", "멘토링"),
    (r"융자|대출|정책자금", "융자"), (r"보증", "보증"), (r"(?i)R\s*&\s*D|기술개발|연구개발", "R&D"),
    (r"디지털|스마트|키오스크", "디지털전환"), (r"수출|해외", "수출"), (r"제조", "제조"),
    (r"입주|공간|센터", "공간"),
]

HINT_LABELS = ["지원대상", "지원분야", "신청자격", "지원내용"]

# --- fixed values: period, date and amount patterns ---
PERIOD_LABEL_RE = r"(?:접수|신청|모집)\s*기간\s*[:：]?\s*([^\n]{0,%s})"
# a trailing 일 is accepted so Korean-style ranges reach the 년/월/일 date rule
PERIOD_DATE_RE = r"\d{4}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2}일?|\d{8}"
AMOUNT_CORE_RE = r"(?:최대|최고|이내)?\s*\d[\d,.]*\s*(?:억|천만|백만|만)\s*원[^.]*"
AMOUNT_CORE_NL_RE = r"(?:최대|최고|이내)?\s*\d[\d,.]*\s*(?:억|천만|백만|만)\s*원[^.\n]*"
DATE_RES = [r"^(\d{4})(\d{2})(\d{2})(\D|\z)", r"^(\d{4})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{1,2})(\D|\z)",
            r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"]

# --- fixed values: agency patterns ---
LOCAL_AGENCY_RE = r"^\[[^\]]+\]\s*([가-힣]{2,10}(?:시|군|구))\s"
ORG_AGENCY_RE = r"^((?:\((?:사|재|주|복)\))?\s*[가-힣A-Za-z0-9]{2,25}(?:" + "|".join(ORG_SUFFIXES) + r"))(?:의|에서|은|는)\s"
SIDO_AGENCY_RE = r"^\[([가-힣]{2})\]"
AGENCY_PLACEHOLDER = "정부 공통(집계)"


def _s(c) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def _num(s: Column) -> Column:
    return F.when(s == "", F.lit(None)).otherwise(s).try_cast("decimal(20,4)")


def _money(t: Column, unit: str) -> Column:
    """First number before ``unit``; texts without the unit are not searched for it."""
    return F.when(t.contains(unit), F.regexp_extract(t, NUM + unit, 1)).otherwise(F.lit(""))


def parse_amount(c) -> Column:
    """Amount in won (BIGINT) or NULL."""
    t = F.regexp_replace(_s(c), f"[{SPACE_CHARS},]", "")
    eok, cm, bm, man = (_money(t, u) for u in ("억", "천만", "백만", "만"))
    won = F.when(t.contains("원"), F.regexp_extract(t, r"(\d{5,})원", 1)).otherwise(F.lit(""))
    use_man = (cm == "") & (bm == "")
    total = (F.coalesce(_num(eok) * 100000000, F.lit(0))
             + F.coalesce(_num(cm) * 10000000, F.lit(0))
             + F.coalesce(_num(bm) * 1000000, F.lit(0))
             + F.when(use_man, F.coalesce(_num(man) * 10000, F.lit(0))).otherwise(F.lit(0)))
    unit_hit = (eok != "") | (cm != "") | (bm != "") | (use_man & (man != ""))
    return (F.when(unit_hit, F.round(total, 0).cast("bigint"))
             .when(won != "", won.try_cast("bigint")))


def first_amount(*cols) -> Column:
    """The first amount of several texts that is neither NULL nor 0, else the last one's."""
    return F.coalesce(*[F.nullif(parse_amount(c), F.lit(0).cast("bigint")) for c in cols[:-1]], parse_amount(cols[-1]))


def amount_text(c, break_nl: bool = False, chars: int | None = None) -> Column:
    """The sentence around the first money mention, without white space at its ends.

    The leftmost mention with the text after the last sentence break before it (a lazy
    sentence prefix in one pattern would need quadratic time on texts without a period).
    """
    t = _s(c)
    core = _p(AMOUNT_CORE_NL_RE if break_nl else AMOUNT_CORE_RE)
    pos = F.when(t.contains("원"), F.regexp_instr(t, F.lit(core))).otherwise(F.lit(0))
    prefix = t.substr(F.lit(1), pos - 1)
    tail = F.substring_index(prefix, ".", -1)
    if break_nl:
        tail = F.substring_index(tail, "\n", -1)
    m = F.concat(tail, F.regexp_extract(t, core, 0))
    return F.when(pos == 0, F.lit(None)).otherwise(cut(strip(m), chars))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    s = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return F.when(y == "", F.lit(None).cast("date")).otherwise(F.try_to_date(s, "yyyy-MM-dd"))


def parse_date(c) -> Column:
    """Yyyymmdd / y-m-d (. / -) at the start, or y년 m월 d일 anywhere; impossible dates -> NULL."""
    s = strip(_s(c))
    out = F.lit(None).cast("date")
    for r in reversed([_p(r) for r in DATE_RES]):
        out = F.when(s.rlike(r), _ymd(F.regexp_extract(s, r, 1), F.regexp_extract(s, r, 2), F.regexp_extract(s, r, 3))).otherwise(out)
    return out


def parse_period(c, reach: int | None = None) -> Column:
    """struct(start, end); with a labelled period only the rest of its line (``reach`` characters of it)."""
    s = _s(c)
    label = _p(PERIOD_LABEL_RE % ("" if reach is None else reach))
    target = F.when(s.contains("기간") & s.rlike(label), F.regexp_extract(s, label, 1)).otherwise(s)
    dates = F.regexp_extract_all(target, F.lit(_p(PERIOD_DATE_RE)), 0)
    return F.struct(parse_date(F.get(dates, F.lit(0))).alias("start"), parse_date(F.get(dates, F.lit(1))).alias("end"))


def split_period(c) -> Column:
    """N5: 'a ~ b', 'a - 2026...', 'a부터 b까지' -> struct(start, end)."""
    s = F.regexp_replace(_s(c), _p(r"-(\s*\d{4})"), "~$1")
    parts = F.filter(F.transform(F.split(s, "~|부터|까지"), strip), lambda p: p != "")
    return F.struct(parse_date(F.get(parts, F.lit(0))).alias("start"), parse_date(F.get(parts, F.lit(1))).alias("end"))


def _ordered_set(items: list[Column]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*items)))


def infer_stages(c) -> Column:
    """Business stages from keyword rules; 'n년 이내' fills the covered buckets."""
    t = _s(c)
    y = F.regexp_extract(t, _p(STAGE_WITHIN_RE), 1).try_cast("int")  # '' (no match) is NULL
    has_y = y.isNotNull()
    early, growth, seven = (t.rlike(_p(r)) for r in (STAGE_EARLY_RE, STAGE_GROWTH_RE, STAGE_SEVEN_RE))
    return _ordered_set([
        F.when(t.rlike(_p(STAGE_PRE_RE)), F.lit("예비")),
        F.when(t.rlike(_p(STAGE_SMB_RE)), F.lit("소상공인")),
        F.when(has_y & (y >= 1), F.lit("1년미만")),
        F.when(has_y & (y >= 2), F.lit("1-3년")),
        F.when(has_y & (y >= 4), F.lit("3-7년")),
        F.when(has_y & (y <= 3) & t.rlike("예비"), F.lit("예비")),
        F.when(early, F.lit("1년미만")), F.when(early, F.lit("1-3년")),
        F.when(growth, F.lit("3-7년")), F.when(growth, F.lit("1-3년")),
        F.when(seven, F.lit("1년미만")), F.when(seven, F.lit("1-3년")), F.when(seven, F.lit("3-7년")),
    ])


def infer_segments(c) -> Column:
    """Segment codes by rule, fixed order."""
    t = _s(c)
    return _ordered_set([F.when(t.rlike(_p(r)), F.lit(code)) for code, r in SEGMENT_RULES])


def infer_region(c) -> Column:
    """National words first, then the first region (short or long form) in list order; default national."""
    t = _s(c)
    expr = F.when(t.rlike(_p(r"전국|전\s*지역")), F.lit(NATIONAL))
    for r in REGIONS:
        cond = t.contains(r)
        for long_form in REGION_LONG.get(r, []):
            cond = cond | t.contains(long_form)
        expr = expr.when(cond, F.lit(r))
    return expr.otherwise(F.lit(NATIONAL))


def infer_funding_type(blob, title) -> Column:
    """First rule over the title, else first rule over the whole text, else other."""
    b, ti = _s(blob), _s(title)
    expr = None
    for name, r in FUNDING_RULES:
        cond = (ti != "") & ti.rlike(_p(r))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    for name, r in FUNDING_RULES:
        expr = expr.when(b.rlike(_p(r)), F.lit(name))
    return expr.otherwise(F.lit(OTHER_FUNDING))


def extract_tags(c) -> Column:
    """Independent tag rules, rule order kept."""
    t = _s(c)
    return F.array_compact(F.array(*[F.when(t.rlike(_p(r)), F.lit(tag)) for r, tag in TAG_RULES]))


def labeled_field(c, label: str, chars: int | None = None) -> Column:
    """Value of a 'label: value' line without white space at its ends; '' when absent."""
    t = _s(c)
    rest = r"\s*[:：]\s*([^\n]{0,%s})" % ("" if chars is None else chars)
    return F.when(t.contains(label), strip(F.regexp_extract(t, _p(label + rest), 1))).otherwise(F.lit(""))


def structured_hints(c, chars: int | None = None) -> Column:
    """The four labelled lines joined by one space (blank ones skipped)."""
    return F.concat_ws(" ", *[F.nullif(labeled_field(c, lab, chars), F.lit("")) for lab in HINT_LABELS])


def infer_agency(title, summary, fallback) -> Column:
    """N13: '[..] XX시/군/구' title -> organisation at the start of the summary -> '[XX]' province -> fallback."""
    ti, su = _s(title), _s(summary)
    local, org = _p(LOCAL_AGENCY_RE), _p(ORG_AGENCY_RE)
    sido = F.create_map(*[x for k, v in SIDO_FULL.items() for x in (F.lit(k), F.lit(v))])[F.regexp_extract(ti, SIDO_AGENCY_RE, 1)]
    return (F.when(ti.rlike(local), F.regexp_extract(ti, local, 1))
             .when(su.rlike(org), strip(F.regexp_extract(su, org, 1)))
             .when(sido.isNotNull(), sido)
             .otherwise(fallback if isinstance(fallback, Column) else F.lit(fallback)))


def recover_agency(agency, title, summary, fallback="") -> Column:
    """N13's gate: a named agency stays; a blank one or the aggregate's placeholder is recovered."""
    a = strip(_s(agency))
    return F.when((a != "") & (a != AGENCY_PLACEHOLDER), a).otherwise(infer_agency(title, summary, fallback))


def classify_frame(df, title: str, summary: str, extra: str, prefix: str = "") -> "DataFrame":  # noqa: F821
    """Stages, segments, region, funding type and tags of title, summary and extra text (labelled lines,
    not a whole body, where one word in passing would flip the class).

    The text is staged as its own column, so it is put together once per row.
    """
    ti, su, ex = _s(title), _s(summary), _s(extra)
    out = df.withColumn("_blob", F.concat_ws(" ", F.when(ti != "", ti), F.when(su != "", su),
                                             F.when(ex != "", ex)))
    b = F.col("_blob")
    out = out.withColumn("_st", infer_stages(b)).withColumn("_sg", infer_segments(b))
    default = F.array(*[F.lit(s) for s in ["1년미만", "1-3년", "3-7년", "소상공인"]])
    return out.select(
        *df.columns,
        F.when((F.size("_st") == 0) & (F.size("_sg") == 0) & b.rlike(BUSINESS_RE), default)
         .otherwise(F.col("_st")).alias(prefix + "target_stages"),
        F.col("_sg").alias(prefix + "target_segments"),
        infer_region(b).alias(prefix + "region"),
        infer_funding_type(b, F.col(title)).alias(prefix + "funding_type"),
        extract_tags(b).alias(prefix + "normalized_tags"))


def program_id(prefix: str, doc, strip_re: str | None = None, chars: int | None = None) -> Column:
    """Prefixed id.  ``chars`` bounds the document's part; two long ids may then share one."""
    d = _s(doc)
    if strip_re:
        d = F.regexp_replace(d, strip_re, "")
    return F.concat(F.lit(prefix), cut(d, chars))


def tags_text(c) -> Column:
    """Tag array as text."""
    return F.array_join(F.coalesce(c if isinstance(c, Column) else F.col(c), F.array().cast("array<string>")), " ")


def normalize_phone(c) -> Column:
    """+82 / 11-digit numbers -> 0xx-xxxx-xxxx; anything else unchanged."""
    raw = c if isinstance(c, Column) else F.col(c)
    digits = F.regexp_replace(raw, r"\D", "")
    local = F.when(digits.startswith("82") & (F.length(digits) >= 11), F.concat(F.lit("0"), F.substring(digits, 3, 100)))
    fmt = lambda d: F.regexp_replace(d, r"^(0\d{2})(\d{4})(\d{4})$", "$1-$2-$3")
    return (F.when(raw.isNull(), F.lit(None))
             .when(local.isNotNull(), fmt(local))
             .when((F.length(digits) == 11) & digits.startswith("0"), fmt(digits))
             .otherwise(raw))


def pick(*cols) -> Column:
    """First non-blank of several aliases, without white space at its ends; default ''."""
    return F.coalesce(*[F.nullif(strip((c if isinstance(c, Column) else F.col(c)).cast("string")), F.lit("")) for c in cols], F.lit(""))
