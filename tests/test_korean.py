"""Unit checks of the normalization expressions on our own Korean fixtures."""
import datetime as dt

from pyspark.sql import functions as F

from tidewater.functions import korean as K
from tidewater.functions.korean import CATALOGUE_TEXT
from tidewater.sources.local import literal_frame


def one(spark, value, expr):
    df = literal_frame(spark, [(value,)], [("v", "string")])
    return df.select(expr(F.col("v")).alias("o")).collect()[0]["o"]


def test_parse_date_formats(spark):
    for s in ["2031.3.07", "2031 - 3 - 7", "2031/03/07", "20310307", "마감은 2031년 3월 7일", "　2031-03-07 "]:
        assert one(spark, s, K.parse_date) == dt.date(2031, 3, 7), s


def test_parse_date_impossible(spark):
    for s in ["2031-04-31", "2031-00-10", "203103071", "상시", "", "   "]:
        assert one(spark, s, K.parse_date) is None, s


def test_period_labelled_and_korean_range(spark):
    p = one(spark, "공고 2030.1.1\n신청 기간:　2031/2/3 ~ 2031/4/5", K.parse_period)
    assert (p["start"], p["end"]) == (dt.date(2031, 2, 3), dt.date(2031, 4, 5))
    p = one(spark, "모집기간 2031년 11월 9일 ~ 2031년 12월 1일", K.parse_period)
    assert (p["start"], p["end"]) == (dt.date(2031, 11, 9), dt.date(2031, 12, 1))


def test_period_reach_is_a_parameter(spark):
    text = "접수기간: " + "가" * 70 + " 20310401"
    assert one(spark, text, K.parse_period)["start"] == dt.date(2031, 4, 1)
    assert one(spark, text, lambda c: K.parse_period(c, CATALOGUE_TEXT.period_reach))["start"] is None


def test_split_period(spark):
    for s in ["20310401 ~ 20310930", "2031.4.1 - 2031.9.30", "2031-04-01부터 2031-09-30까지"]:
        p = one(spark, s, K.split_period)
        assert (p["start"], p["end"]) == (dt.date(2031, 4, 1), dt.date(2031, 9, 30)), s
    p = one(spark, "2031.4.1 ~ 상시", K.split_period)
    assert (p["start"], p["end"]) == (dt.date(2031, 4, 1), None)


def test_parse_amount(spark):
    assert one(spark, "최고 7억 원", K.parse_amount) == 700_000_000
    assert one(spark, "8,250 만원", K.parse_amount) == 82_500_000
    assert one(spark, "2억 3천만원", K.parse_amount) == 230_000_000
    assert one(spark, "1.5백만원", K.parse_amount) == 1_500_000
    assert one(spark, "64000000원", K.parse_amount) == 64_000_000
    assert one(spark, "추후 안내", K.parse_amount) is None


def test_amount_text(spark):
    text = "먼저 읽어 주세요.\n　가게마다 최고 8,250만원 이내 .끝"
    assert one(spark, text, K.amount_text) == "가게마다 최고 8,250만원 이내"
    assert one(spark, "첫째 줄\n최대 3억원 지원\n셋째 줄", lambda c: K.amount_text(c, True)) == "최대 3억원 지원"
    assert one(spark, "돈 이야기 없음", K.amount_text) is None


def test_labelled_lines(spark):
    text = "지원대상 :　작은 가게 \n신청자격： 누구나\n지원내용:"
    assert one(spark, text, lambda c: K.labeled_field(c, "지원대상")) == "작은 가게"
    assert one(spark, text, K.structured_hints) == "작은 가게 누구나"


def test_region_and_stages(spark):
    assert one(spark, "충청북도 지원", K.infer_region) == "충북"
    assert one(spark, "전　지역 대상", K.infer_region) == "전국"
    assert one(spark, "예비 창업과 창업 후 4년 미만", K.infer_stages) == ["예비", "1년미만", "1-3년", "3-7년"]


def test_agency_gate(spark):
    title = F.lit("[충남] 공주시 밤나무 지원")
    assert one(spark, "한빛재단", lambda c: K.recover_agency(c, title, F.lit(""))) == "한빛재단"
    for blank in ["", "　", K.AGENCY_PLACEHOLDER]:
        assert one(spark, blank, lambda c: K.recover_agency(c, title, F.lit(""))) == "공주시"


def test_program_id(spark):
    long = "PBLN_000" + "7" * 60
    assert one(spark, long, lambda c: K.program_id("BZ-", c, "^PBLN_0*")) == "BZ-" + "7" * 60
    assert one(spark, long, lambda c: K.program_id("BZ-", c, "^PBLN_0*", CATALOGUE_TEXT.doc_id)) == "BZ-" + "7" * 44


def test_phone(spark):
    assert one(spark, "+82 10-2468-1357", K.normalize_phone) == "010-2468-1357"
    assert one(spark, "031-7", K.normalize_phone) == "031-7"
