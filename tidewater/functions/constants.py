"""Fixed values.

Everything in this module must equal the values of the notice catalogue we
reproduce, otherwise results differ.  They are stated plainly, in their natural
order, and are used by the column expressions in ``korean.py`` and by the
matching / search operators.
"""

# --- fixed values: region names (17 provinces, list order decides ties) ---
REGIONS = [
    "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종",
    "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주",
]
NATIONAL = "전국"

# --- fixed values: long province forms (the short form above is what is stored) ---
REGION_LONG = {
    "서울": ["서울특별시"], "부산": ["부산광역시"], "대구": ["대구광역시"],
    "인천": ["인천광역시"], "광주": ["광주광역시"], "대전": ["대전광역시"],
    "울산": ["울산광역시"], "세종": ["세종특별자치시"], "경기": ["경기도"],
    "강원": ["강원도", "강원특별자치도"], "충북": ["충청북도"], "충남": ["충청남도"],
    "전북": ["전라북도", "전북특별자치도"], "전남": ["전라남도"],
    "경북": ["경상북도"], "경남": ["경상남도"], "제주": ["제주도", "제주특별자치도"],
}

# --- fixed values: province short name -> full agency name (agency recovery) ---
SIDO_FULL = {
    "서울": "서울특별시", "부산": "부산광역시", "대구": "대구광역시", "인천": "인천광역시",
    "광주": "광주광역시", "대전": "대전광역시", "울산": "울산광역시", "세종": "세종특별자치시",
    "경기": "경기도", "강원": "강원특별자치도", "충북": "충청북도", "충남": "충청남도",
    "전북": "전북특별자치도", "전남": "전라남도", "경북": "경상북도", "경남": "경상남도",
    "제주": "제주특별자치도",
}

# --- fixed values: organisation suffixes for agency recovery ---
ORG_SUFFIXES = ["협회", "진흥원", "공단", "재단", "센터", "조합", "기술원", "연구원",
                "대학교", "진흥회", "공사", "산업원", "청"]

# --- fixed values: business stages and segment codes ---
STAGES = ["예비", "1년미만", "1-3년", "3-7년", "소상공인"]
SEGMENTS = ["PRE", "EARLY", "SMB", "YOUTH", "SENIOR", "WORKER", "WOMAN", "LOAN", "RND"]
NOT_FOUNDED = "설립 전"
OTHER_FUNDING = "기타"

# --- fixed values: search weights ---
WEIGHT_PHRASE = 1.00
WEIGHT_EXACT = 0.90
WEIGHT_SYNONYM = 0.75
WEIGHT_COMPOUND = 0.45

# Field weights x10 (name 5, field 4, tags 3, summary 2, body 1, agency 0.2),
# kept integral so sums are exact in every engine.
FIELD_WEIGHTS_X10 = [("name", 50), ("field", 40), ("tags_text", 30),
                     ("summary", 20), ("body_text", 10), ("agency", 2)]

MIN_STRICT_RESULTS = 5

# --- fixed values: particles and endings stripped from query tokens (endings first, longest first) ---
ENDINGS = ["하는", "되는", "시키는", "하기", "되기", "한", "된", "할", "될", "해", "돼"]
PARTICLES = [
    "으로서", "으로써", "에서는", "에게서", "이라는", "라는",
    "에서", "에게", "으로", "까지", "부터", "보다", "처럼", "만큼", "조차", "마저",
    "이나", "이란", "라도", "이든", "한테",
    "을", "를", "이", "가", "은", "는", "의", "에", "와", "과", "도", "만", "로", "랑",
]

# --- fixed values: tier labels, weakest first ---
TIERS = ["weak", "partial", "synonym", "exact"]

# --- fixed values: middle dots and ornament brackets removed from queries ---
MIDDLE_DOTS = "ㆍ·・･•‧∙ᆞᆢ"
ORNAMENT_BRACKETS = "「」『』【】〔〕"
