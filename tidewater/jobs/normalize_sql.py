"""The normalization rules once more, written by hand in SQL for the oracle.

Nothing here is built from the patterns of the code under test.  ``W`` is one white-space
character (no-break and ideographic spaces included).
"""
from __future__ import annotations

W = "[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern.replace('_', W + '*'))})"


def got(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern.replace('_', W + '*'))}, {group})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + W + '+|' + W + '+$')}, '', 'g')"


def amount(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), {q('[,' + W[1:] + '+')}, '', 'g')"

    def n(unit):
        return f"TRY_CAST(nullif(regexp_extract({t}, '([0-9]+([.][0-9]+)?){unit}', 1), '') AS DECIMAL(20,4))"

    small = f"CASE WHEN {n('천만')} IS NULL AND {n('백만')} IS NULL THEN {n('만')} END"
    total = f"coalesce({n('억')} * 100000000, 0) + coalesce({n('천만')} * 10000000, 0) + coalesce({n('백만')} * 1000000, 0) + coalesce({small} * 10000, 0)"
    return (f"CASE WHEN coalesce({n('억')}, {n('천만')}, {n('백만')}, {small}) IS NOT NULL THEN CAST(round({total}, 0) AS BIGINT) "
            f"ELSE TRY_CAST(nullif(regexp_extract({t}, '([0-9]{{5,}})원', 1), '') AS BIGINT) END")


def amounts(*xs: str) -> str:
    return "coalesce(" + ", ".join([f"nullif({amount(x)}, 0)" for x in xs[:-1]] + [amount(xs[-1])]) + ")"


def amount_text(x: str, lines: bool, chars: int) -> str:
    stop = "[^.\\n]" if lines else "[^.]"
    m = got(f"coalesce({x}, '')", stop + "*?(?:최대|최고|이내)?_[0-9][0-9,.]*_(?:억|천만|백만|만)_원" + stop + "*")
    return f"CASE WHEN {m} <> '' THEN substr({strip(m)}, 1, {chars}) END"


def date(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    cases = []
    for r in ("^([0-9]{4})([0-9]{2})([0-9]{2})([^0-9]|$)", "^([0-9]{4})_[-./]_([0-9]{1,2})_[-./]_([0-9]{1,2})([^0-9]|$)",
              "([0-9]{4})년_([0-9]{1,2})월_([0-9]{1,2})일"):
        text = f"{got(s, r, 1)} || '-' || lpad({got(s, r, 2)}, 2, '0') || '-' || lpad({got(s, r, 3)}, 2, '0')"
        cases.append(f"WHEN {has(s, r)} THEN CAST(try_strptime({text}, '%Y-%m-%d') AS DATE)")
    return "(CASE " + " ".join(cases) + " END)"


def period_dates(x: str, reach: int) -> str:
    label = "(?:접수|신청|모집)_기간_[:：]?_([^\\n]{0,%d})" % reach
    target = f"CASE WHEN {has(x, label)} THEN {got(x, label, 1)} ELSE {x} END"
    dates = "[0-9]{4}_[-./년]_[0-9]{1,2}_[-./월]_[0-9]{1,2}일?|[0-9]{8}"
    return f"regexp_extract_all({target}, {q(dates.replace('_', W + '*'))}, 0)"


def period_parts(x: str) -> str:
    s = f"regexp_replace(coalesce({x}, ''), {q('-(' + W + '*[0-9]{4})')}, '~\\1', 'g')"
    return f"list_filter(list_transform(string_split_regex({s}, '~|부터|까지'), lambda p: {strip('p')}), lambda p: p <> '')"


def label(x: str, name: str, chars: int) -> str:
    return strip(got(f"coalesce({x}, '')", name + "_[:：]_([^\\n]{0,%d})" % chars, 1))


def hints(x: str, chars: int) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({label(x, n, chars)}, '')" for n in ("지원대상", "지원분야", "신청자격", "지원내용")) + ")"


def _set(items: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in items) + "], lambda x: x IS NOT NULL)"


def stages(b: str) -> str:
    y = f"TRY_CAST(nullif({got(b, '창업_(?:후_)?([0-9])_년_(?:이내|미만)', 1)}, '') AS INTEGER)"
    early, growth, seven = has(b, "초기_창업"), has(b, "도약|스케일업|성장_단계"), has(b, "7_년_(?:이내|미만)")
    full = _set([
        (has(b, "예비_창업|창업_예정|사업자등록_전|아이디어_단계"), "예비"), (has(b, "소상공인|자영업|점포|상인"), "소상공인"),
        (f"{y} >= 1", "1년미만"), (f"{y} >= 2", "1-3년"), (f"{y} >= 4", "3-7년"), (f"{y} <= 3 AND contains({b}, '예비')", "예비"),
        (early, "1년미만"), (early, "1-3년"), (growth, "3-7년"), (growth, "1-3년"), (seven, "1년미만"), (seven, "1-3년"), (seven, "3-7년")])
    return f"list_filter({full}, lambda x, i: list_position({full}, x) = i)"


def segments(b: str) -> str:
    return _set([
        (has(b, "예비_창업|창업_예정|아이디어_단계"), "PRE"), (has(b, "초기_창업|창업_[1-3]_년|기창업"), "EARLY"),
        (has(b, "소상공인|자영업|점포|전통시장"), "SMB"), (has(b, "청년|만_39_세|39세_이하|20~39"), "YOUTH"),
        (has(b, "중장년|시니어|만_40_세_이상|4060|퇴직"), "SENIOR"), (has(b, "재직자|직장인|부업|퇴사_예정"), "WORKER"),
        (has(b, "여성"), "WOMAN"), (has(b, "융자|대출|보증|정책자금|운전자금|시설자금"), "LOAN"),
        (has(b, "(?i)R_&_D|연구개발|기술개발|과제_수행"), "RND")])


def tags(b: str) -> str:
    return _set([
        (has(b, "예비_창업"), "예비창업"), (has(b, "청년"), "청년"), (has(b, "여성"), "여성"), (has(b, "중장년|시니어|퇴직"), "중장년"),
        (has(b, "소상공인|자영업"), "소상공인"), (has(b, "사업화|시제품|창업_패키지|보육"), "사업화"), (has(b, "멘토링|컨설팅"), "멘토링"),
        (has(b, "융자|대출|정책자금"), "융자"), (has(b, "보증"), "보증"), (has(b, "(?i)R_&_D|기술개발|연구개발"), "R&D"),
        (has(b, "디지털|스마트|키오스크"), "디지털전환"), (has(b, "수출|해외"), "수출"), (has(b, "제조"), "제조"), (has(b, "입주|공간|센터"), "공간")])


def region(b: str) -> str:
    names = [("서울", "서울특별시"), ("부산", "부산광역시"), ("대구", "대구광역시"), ("인천", "인천광역시"), ("광주", "광주광역시"), ("대전", "대전광역시"),
             ("울산", "울산광역시"), ("세종", "세종특별자치시"), ("경기", "경기도"), ("강원", "강원도"), ("충북", "충청북도"), ("충남", "충청남도"),
             ("전북", "전라북도"), ("전남", "전라남도"), ("경북", "경상북도"), ("경남", "경상남도"), ("제주", "제주도")]
    cases = " ".join(f"WHEN contains({b}, '{a}') OR contains({b}, '{c}') THEN '{a}'" for a, c in names)
    return f"CASE WHEN {has(b, '전국|전_지역')} THEN '전국' {cases} ELSE '전국' END"


def funding(b: str, title: str) -> str:
    rules = [("보증", "보증"), ("융자", "융자|대출|정책자금|운전자금|시설자금"), ("공제", "공제"), ("R&D", "(?i)R_&_D|연구개발|기술개발|신규과제"),
             ("디지털전환", "(?i)디지털_전환|스마트|키오스크|POS"), ("사업화", "사업화|시제품|창업_패키지|입교|보육|창업_(?:을|를)?_지원"),
             ("컨설팅", "컨설팅|멘토링|교육|바우처")]
    return "CASE " + " ".join(f"WHEN {has(x, r)} THEN '{n}'" for x in (title, b) for n, r in rules) + " ELSE '기타' END"


def agency(title: str, summary: str) -> str:
    local = "^\\[[^\\]]+\\]_([가-힣]{2,10}(?:시|군|구))" + W
    org = ("^((?:[(](?:사|재|주|복)[)])?_[가-힣A-Za-z0-9]{2,25}(?:협회|진흥원|공단|재단|센터|조합|기술원|연구원|대학교|진흥회|공사|산업원|청))"
           "(?:의|에서|은|는)" + W)
    full = {"서울": "서울특별시", "부산": "부산광역시", "대구": "대구광역시", "인천": "인천광역시", "광주": "광주광역시", "대전": "대전광역시",
            "울산": "울산광역시", "세종": "세종특별자치시", "경기": "경기도", "강원": "강원특별자치도", "충북": "충청북도", "충남": "충청남도",
            "전북": "전북특별자치도", "전남": "전라남도", "경북": "경상북도", "경남": "경상남도", "제주": "제주특별자치도"}
    sido = "CASE " + got(title, "^\\[([가-힣]{2})\\]", 1) + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in full.items()) + " END"
    return (f"CASE WHEN {has(title, local)} THEN {got(title, local, 1)} WHEN {has(summary, org)} THEN {strip(got(summary, org, 1))} "
            f"ELSE coalesce({sido}, '') END")


def classified(source: str, title: str, summary: str, extra: str) -> str:
    """Subquery over ``source`` that adds stages_, segs, region_, funding_ and tags_."""
    b = f"concat_ws(' ', nullif({title}, ''), nullif({summary}, ''), nullif({extra}, ''))"
    return f"""(SELECT * EXCLUDE (st, blob), {region('blob')} AS region_, {funding('blob', title)} AS funding_, {tags('blob')} AS tags_,
      CASE WHEN len(st) = 0 AND len(segs) = 0 AND {has('blob', '기업|사업자|소상공인|중소기업|자영업')} THEN ['1년미만', '1-3년', '3-7년', '소상공인'] ELSE st END AS stages_
    FROM (SELECT *, {stages('blob')} AS st, {segments('blob')} AS segs FROM (SELECT *, {b} AS blob FROM {source})))"""
