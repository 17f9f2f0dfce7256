"""Lookup tables, word lists, patterns and thresholds.

Everything in this file is a constant that must hold exactly for results to be
right. All tables are small and of fixed size, so they travel inside the plan
as literals; none of them grows with the data.
"""

from __future__ import annotations

# --- fixed values: area code -> area name -----------------------------------
AREA_NAMES = {
    "02": "서울", "031": "경기", "032": "인천", "033": "강원",
    "041": "충남", "042": "대전", "043": "충북", "044": "세종",
    "051": "부산", "052": "울산", "053": "대구", "054": "경북", "055": "경남",
    "061": "전남", "062": "광주", "063": "전북", "064": "제주",
    "070": "인터넷전화", "010": "핸드폰", "017": "핸드폰",
}
UNKNOWN_AREA = "알 수 없음"

# --- fixed values: digit count allowed per area code (080 is only here) ------
AREA_LENGTHS = {
    "02": (9, 10), "031": (10, 11), "032": (10, 11), "033": (10, 11), "041": (10, 11),
    "042": (10, 11), "043": (10, 11), "044": (10, 11), "051": (10, 11), "052": (10, 11),
    "053": (10, 11), "054": (10, 11), "055": (10, 11), "061": (10, 11), "062": (10, 11),
    "063": (10, 11), "064": (10, 11), "070": (11, 11), "080": (11, 11), "010": (11, 11),
    "017": (11, 11),
}

# --- fixed values: region or city name -> area code, first hit wins ----------
REGION_NAMES = [
    ("서울", "02"), ("서울시", "02"), ("서울특별시", "02"),
    ("경기", "031"), ("경기도", "031"), ("수원", "031"), ("성남", "031"), ("안양", "031"),
    ("안산", "031"), ("고양", "031"), ("용인", "031"), ("부천", "031"), ("의정부", "031"),
    ("인천", "032"), ("인천시", "032"), ("인천광역시", "032"),
    ("강원", "033"), ("강원도", "033"), ("춘천", "033"), ("원주", "033"), ("강릉", "033"),
    ("충남", "041"), ("충청남도", "041"), ("천안", "041"), ("아산", "041"), ("서산", "041"),
    ("대전", "042"), ("대전시", "042"), ("대전광역시", "042"),
    ("충북", "043"), ("충청북도", "043"), ("청주", "043"), ("충주", "043"),
    ("세종", "044"), ("세종시", "044"), ("세종특별자치시", "044"),
    ("부산", "051"), ("부산시", "051"), ("부산광역시", "051"),
    ("울산", "052"), ("울산시", "052"), ("울산광역시", "052"),
    ("대구", "053"), ("대구시", "053"), ("대구광역시", "053"),
    ("경북", "054"), ("경상북도", "054"), ("포항", "054"), ("경주", "054"), ("안동", "054"),
    ("경남", "055"), ("경상남도", "055"), ("창원", "055"), ("진주", "055"), ("통영", "055"),
    ("전남", "061"), ("전라남도", "061"), ("목포", "061"), ("여수", "061"), ("순천", "061"),
    ("광주", "062"), ("광주시", "062"), ("광주광역시", "062"),
    ("전북", "063"), ("전라북도", "063"), ("전주", "063"), ("익산", "063"), ("군산", "063"),
    ("제주", "064"), ("제주도", "064"), ("제주특별자치도", "064"),
]

# --- fixed values: the 17 regions in search order and their single code ------
REGION_CODES = [
    ("서울", "02"), ("부산", "051"), ("대구", "053"), ("인천", "032"), ("광주", "062"),
    ("대전", "042"), ("울산", "052"), ("세종", "044"), ("경기", "031"), ("강원", "033"),
    ("충북", "043"), ("충남", "041"), ("전북", "063"), ("전남", "061"), ("경북", "054"),
    ("경남", "055"), ("제주", "064"),
]

# --- fixed values: area code -> region names accepted in an address ----------
AREA_REGIONS = {
    "02": ["서울", "서울특별시", "서울시"],
    "031": ["경기", "경기도", "인천", "인천광역시"],
    "032": ["인천", "인천광역시", "경기"],
    "033": ["강원", "강원도", "강원특별자치도"],
    "041": ["충남", "충청남도", "세종", "세종특별자치시"],
    "042": ["대전", "대전광역시", "충남", "충청남도"],
    "043": ["충북", "충청북도"],
    "044": ["세종", "세종특별자치시", "충남"],
    "051": ["부산", "부산광역시"],
    "052": ["울산", "울산광역시"],
    "053": ["대구", "대구광역시"],
    "054": ["경북", "경상북도", "대구"],
    "055": ["경남", "경상남도", "부산"],
    "061": ["전남", "전라남도", "광주"],
    "062": ["광주", "광주광역시", "전남"],
    "063": ["전북", "전라북도"],
    "064": ["제주", "제주도", "제주특별자치도"],
}

# --- fixed values: the wider list used by the relaxed fax check --------------
AREA_REGIONS_WIDE = {
    "02": ["서울", "서울특별시", "서울시"],
    "031": ["경기", "경기도", "인천", "인천광역시"],
    "032": ["인천", "인천광역시", "경기", "경기도"],
    "033": ["강원", "강원도", "강원특별자치도"],
    "041": ["충남", "충청남도", "세종", "세종특별자치시"],
    "042": ["대전", "대전광역시", "충남", "충청남도"],
    "043": ["충북", "충청북도", "충북도", "청주", "제천", "충주", "음성", "진천",
            "괴산", "증평", "영동", "옥천", "보은", "단양"],
    "044": ["세종", "세종특별자치시", "충남", "충청남도"],
    "051": ["부산", "부산광역시"],
    "052": ["울산", "울산광역시"],
    "053": ["대구", "대구광역시"],
    "054": ["경북", "경상북도", "대구", "대구광역시"],
    "055": ["경남", "경상남도", "부산", "부산광역시"],
    "061": ["전남", "전라남도", "광주", "광주광역시"],
    "062": ["광주", "광주광역시", "전남", "전라남도"],
    "063": ["전북", "전라북도", "전북도"],
    "064": ["제주", "제주도", "제주특별자치도"],
}

# --- fixed values: province names and the kind of district that follows ------
REGION_CITY_RULES = [
    ("강원특별자치도|강원도", "시군"), ("서울특별시|서울시|서울", "구"), ("경기도|경기", "시군"),
    ("인천광역시|인천시|인천", "구"), ("충청남도|충남", "시군"), ("충청북도|충북", "시군"),
    ("전라남도|전남", "시군"), ("전라북도|전북", "시군"), ("경상남도|경남", "시군"),
    ("경상북도|경북", "시군"), ("부산광역시|부산시|부산", "구"), ("대구광역시|대구시|대구", "구"),
    ("광주광역시|광주시|광주", "구"), ("대전광역시|대전시|대전", "구"),
    ("울산광역시|울산시|울산", "구"), ("제주특별자치도|제주도|제주", "시"),
    ("세종특별자치시|세종시|세종", ""),
]

# --- fixed values: e-mail domain classes ------------------------------------
PORTAL_DOMAINS = ["naver.com", "gmail.com", "daum.net", "hanmail.net", "yahoo.com", "hotmail.com"]
GOVERNMENT_SUFFIXES = [".go.kr", ".gov.kr"]
EDUCATION_SUFFIXES = [".ac.kr", ".edu"]
BUSINESS_SUFFIXES = [".co.kr", ".com"]
RELIGIOUS_WORDS = ["church", "temple", "cathedral"]
EMAIL_CLASSES = ["포털", "정부/공공", "교육기관", "기업/조직", "종교기관", "기타"]
COMMON_DOMAINS = ["gmail.com", "naver.com", "daum.net", "hanmail.net", "yahoo.com"]

# --- fixed values: web domains ----------------------------------------------
EXCLUDED_DOMAINS = [
    "google.com", "yahoo.com", "bing.com",
    "11st.co.kr", "gmarket.co.kr", "auction.co.kr", "coupang.com", "bunjang.co.kr", "joongna.com",
    "chosun.com", "donga.com", "joins.com", "hani.co.kr", "khan.co.kr", "pressian.com", "ytn.co.kr",
    "namu.wiki", "wiki.namu.wiki", "wikipedia.org", "en.wikipedia.org", "ko.wikipedia.org",
    "114.co.kr", "findall.co.kr", "cyworld.com", "me2day.net",
]
SEARCH_EXCLUDED_DOMAINS = [
    "google.com", "naver.com", "daum.net", "youtube.com",
    "facebook.com", "instagram.com", "blog.naver.com",
]
SOCIAL_DOMAINS = [
    ("blog.naver.com", "네이버블로그"), ("cafe.naver.com", "네이버카페"),
    ("post.naver.com", "네이버포스트"), ("facebook.com", "페이스북"),
    ("instagram.com", "인스타그램"), ("youtube.com", "유튜브"), ("tistory.com", "티스토리"),
    ("blog.daum.net", "다음블로그"), ("blogspot.com", "블로그스팟"), ("modoo.at", "모두닷컴"),
]

# --- fixed values: words that mark organizations ----------------------------
SMALL_ORG_WORDS = [
    "교회", "성당", "절", "사찰", "교회당", "예배당", "학원", "교습소", "과외", "학습지", "공부방",
    "의원", "치과", "한의원", "약국", "요양원", "미용실", "헤어샵", "네일샵", "마사지",
    "카페", "음식점", "식당", "베이커리", "제과점", "부동산", "공인중개사", "세무사", "회계사",
    "마을", "동네", "지역", "소규모", "개인",
]
SMALL_ORG_WORDS_SEARCH = [
    "교회", "성당", "절", "사찰", "채플", "예배당", "의원", "한의원", "치과", "약국",
    "미용실", "카페", "식당", "상점", "학원", "교습소", "연구소",
]
ORG_TYPE_WORDS = [
    ("의료", ["병원", "의원", "클리닉", "보건소", "약국", "한의원"]),
    ("교육", ["학교", "대학교", "대학원", "유치원", "어린이집", "학원", "교육청"]),
    ("공공", ["청", "구청", "시청", "군청", "동사무소", "주민센터", "관공서"]),
    ("문화", ["박물관", "미술관", "도서관", "문화센터", "체육관", "공연장"]),
    ("종교", ["교회", "성당", "절", "사찰", "성전", "교당"]),
    ("기업", ["회사", "기업", "법인", "상사", "그룹", "코퍼레이션"]),
    ("금융", ["은행", "신용금고", "보험", "증권", "카드", "캐피탈"]),
    ("음식", ["식당", "카페", "레스토랑", "베이커리", "주점", "술집"]),
    ("쇼핑", ["마트", "백화점", "쇼핑몰", "상점", "매장", "편의점"]),
    ("서비스", ["미용실", "세탁소", "수리점", "정비소", "부동산", "여행사"]),
]
TEXT_CATEGORY_WORDS = [
    ("교회", ["교회", "church", "예배", "목회", "신앙", "성당"]),
    ("병원", ["병원", "hospital", "의료", "진료", "치료", "클리닉"]),
    ("교육기관", ["학교", "school", "교육", "학생", "대학", "학원"]),
    ("정부기관", ["정부", "시청", "구청", "관청", ".go.kr", "공공"]),
    ("기업", ["회사", "기업", "사업", ".co.kr", "주식회사"]),
    ("비영리단체", ["단체", "협회", "재단", "센터", ".or.kr"]),
]
OTHER = "기타"
ADDRESS_WORDS = [
    "시", "군", "구", "동", "읍", "면", "리", "로", "길", "번지", "번", "호",
    "아파트", "빌딩", "타워", "센터", "오피스텔", "상가", "층",
]
CONTACT_LINK_WORDS = [
    "연락처", "contact", "contact us", "문의", "오시는길", "찾아오시는길", "위치",
    "주소", "전화", "tel", "전화번호", "연락망",
]
BLANK_WORDS = ["nan", "NaN", "null", "NULL", "-", "N/A", "없음", "X"]

# --- fixed values: roles, what each may do and its level ---------------------
ROLES = {
    "개발자": dict(view=["개발자", "대표", "팀장", "일반사원"], manage=["개발자", "대표", "팀장", "일반사원"],
                create=["개발자", "대표", "팀장", "일반사원"], delete=["대표", "팀장", "일반사원"], level=5),
    "대표": dict(view=["대표", "팀장", "일반사원"], manage=["대표", "팀장", "일반사원"],
               create=["팀장", "일반사원"], delete=["팀장", "일반사원"], level=4),
    "팀장": dict(view=["팀장", "일반사원"], manage=["일반사원"], create=["일반사원"],
               delete=["일반사원"], level=3),
    "일반사원": dict(view=[], manage=[], create=[], delete=[], level=1),
}
LOWEST_ROLE = "일반사원"
TOP_ROLE = "개발자"

# --- fixed values: phone patterns -------------------------------------------
LOOSE_PHONE = r"^\d{2,3}-\d{3,4}-\d{4}$"
PREFIX_PHONES = [r"^02\d{7,8}$", r"^0[3-6]\d{7,8}$", r"^070\d{7,8}$", r"^1[5-9]\d{6,7}$", r"^080\d{7,8}$"]
AGENT_PHONES = [r"^0[2-9]{1,2}-[0-9]{3,4}-[0-9]{4}$", r"^01[0-9]-[0-9]{3,4}-[0-9]{4}$", r"^070-[0-9]{3,4}-[0-9]{4}$"]
CHECKER_PHONES = [r"^0[2-9]{1,2}-[0-9]{3,4}-[0-9]{4}$", r"^01[0-9]-[0-9]{3,4}-[0-9]{4}$"]
MAP_PHONES = [r"^0\d{1,2}-\d{3,4}-\d{4}$", r"^01\d-\d{3,4}-\d{4}$"]
ANCHORED_PHONE = r"^(?:\+?82[-\s]?)?(0\d{1,2})[-\.\)\s]?(\d{3,4})[-\.\s]?(\d{4})"
SAVE_PREFIXES = [
    "02", "031", "032", "033", "041", "042", "043", "044", "051", "052", "053", "054", "055",
    "061", "062", "063", "064", "070", "010", "011", "016", "017", "018", "019",
]
# placeholder numbers; the back-reference counts from the pattern's own first group
DUMMY_PHONES = [
    "033-333-3333", "02-222-2222", "031-111-1111",
    r"(\d)\1{2}-\1{3}-\1{4}",
    r"0\d{1,2}-000-0000", r"0\d{1,2}-123-4567", r"0\d{1,2}-1234-5678",
    "000-000-0000", "999-999-9999",
]
EMAIL_ANCHORED = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# --- fixed values: patterns of the first-contact job --------------------------
FIRST_PHONES = [r"\d{2,3}-\d{3,4}-\d{4}", r"(?:전화|TEL|Tel|tel)[:\s]*(\d{2,3}[-\s]\d{3,4}[-\s]\d{4})"]
FIRST_FAXES = [r"(?:팩스|FAX|Fax|fax)[:\s]*(\d{2,3}[-\s]\d{3,4}[-\s]\d{4})", r"(?:F|f)[:\s]*(\d{2,3}[-\s]\d{3,4}[-\s]\d{4})"]
FIRST_ADDRESSES = [
    r"[가-힣]+[시도]\s[가-힣]+[시군구]\s[가-힣0-9\s\-]+", r"\d{5}\s*[가-힣]+[시도]\s[가-힣]+[시군구][가-힣0-9\s\-]+",
    r"(?:주소|위치|소재지)[:\s]*([가-힣0-9\s\-,]+[시도구군][가-힣0-9\s\-,]*)",
]

# --- fixed values: extraction patterns, in the order they are tried ----------
PHONE_PATTERNS = [
    r"(?:전화|TEL|Tel|tel|T\.|전화번호|연락처|대표번호)[\s*:?]*([0-9\-\.\(\)\s]{8,20})",
    r"(?:☎|=번호)[\s]*([0-9\-\.\(\)\s]{8,20})",
    r"(\d{2,3}[-\.\s]?\d{3,4}[-\.\s]?\d{4})",
    r"전화[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"Tel[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"TEL[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"T[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"대표번호[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4}).*전화",
    r"(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4}).*[Tt]el",
    r"(?:Phone|phone|PHONE)[\s:]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
]
FAX_PATTERNS = [
    r"(?:팩스|FAX|Fax|fax|F\.|팩스번호)[\s*:?]*([0-9\-\.\(\)\s]{8,20})",
    r"(?:=팩스)[\s]*([0-9\-\.\(\)\s]{8,20})",
    r"팩스[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"Fax[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"FAX[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"F[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"팩[\s]*(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4}).*팩스",
    r"(\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4}).*[Ff]ax",
]
EMAIL_PATTERNS = [
    r"(?:이메일|EMAIL|Email|email|E-mail|e-mail|메일|mail)[\s*:?]*([a-zA-Z0-9._%-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
    r"([a-zA-Z0-9._%-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
]
ADDRESS_PATTERNS = [
    r"(?:주소|ADDRESS|Address|address|소재지|위치)[\s*:?]*([가-힣\s\d\-\(\)]+(?:시|군|구|동|로|길)[가-힣\s\d\-\(\)]*)",
    r"([가-힣]+(?:특별시|광역시|시|군|도)\s+[가-힣\s\d\-\(\)]+(?:시|군|구|동|로|길)[가-힣\s\d\-\(\)]*)",
    r"(?:주소|Address|address|ADDRESS)[\s:]*([^\n]+(?:시|군|구|동|로|길)[^\n]*)",
    r"(\d{5}\s*[^\n]+(?:시|군|구|동|로|길)[^\n]*)",
]
WEBSITE_PATTERNS = [
    r"(?:홈페이지|웹사이트|Website|website|Homepage|homepage)[\s:]*([^\s\n]+)",
    r"(https?://[^\s\n]+)",
    r"(www\.[^\s\n]+)",
]
ADDITIONAL_PHONE_PATTERNS = [
    r"(?:담당자|책임자|관리자|상담원)[\s]*:?[\s]*(\d{2,3}[-\.\s]?\d{3,4}[-\.\s]?\d{4})",
    r"(?:직통|내선|분관)[\s]*:?[\s]*(\d{2,3}[-\.\s]?\d{3,4}[-\.\s]?\d{4})",
    r"(?:사무실|사무소|본점|지점)[\s]*:?[\s]*(\d{2,3}[-\.\s]?\d{3,4}[-\.\s]?\d{4})",
    r"(?:예약|접수|상담)[\s]*:?[\s]*(\d{2,3}[-\.\s]?\d{3,4}[-\.\s]?\d{4})",
    r"(?:핸드폰|휴대폰|모바일|Mobile|mobile|HP|hp)[\s]*:?[\s]*(\d{3}[-\.\s]?\d{3,4}[-\.\s]?\d{4})",
]
AGENT_PHONE_PATTERNS = [
    r"(?:전화|TEL|Phone|T\.?)\s*:?\s*([0-9]{2,3}-[0-9]{3,4}-[0-9]{4})",
    r"(?:전화|TEL|Phone|T\.?)\s*:?\s*([0-9]{2,3}\.[0-9]{3,4}\.[0-9]{4})",
    r"(?:전화|TEL|Phone|T\.?)\s*:?\s*([0-9]{2,3}\s[0-9]{3,4}\s[0-9]{4})",
    r"([0-9]{2,3}-[0-9]{3,4}-[0-9]{4})",
    r"([0-9]{2,3}\.[0-9]{3,4}\.[0-9]{4})",
]
AGENT_FAX_PATTERNS = [
    r"(?:팩스|FAX|Fax|F\.?)\s*:?\s*([0-9]{2,3}-[0-9]{3,4}-[0-9]{4})",
    r"(?:팩스|FAX|Fax|F\.?)\s*:?\s*([0-9]{2,3}\.[0-9]{3,4}\.[0-9]{4})",
    r"(?:팩스|FAX|Fax|F\.?)\s*:?\s*([0-9]{2,3}\s[0-9]{3,4}\s[0-9]{4})",
]
AGENT_EMAIL_PATTERNS = [
    r"(?:이메일|Email|E-mail|메일)\s*:?\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
    r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
]
AGENT_WEBSITE_PATTERNS = [
    r"(?:홈페이지|웹사이트|Website|Homepage|URL)\s*:?\s*(https?://[^\s]+)",
    r"(?:홈페이지|웹사이트|Website|Homepage|URL)\s*:?\s*(www\.[^\s]+)",
    r"(https?://[^\s]+)",
    r"(www\.[^\s]+)",
]
HELPER_PHONE_PATTERNS = [
    r"\d{2,3}-\d{3,4}-\d{4}", r"\d{3}-\d{4}-\d{4}", r"\d{2,3}\.\d{3,4}\.\d{4}",
    r"\d{2,3}\s\d{3,4}\s\d{4}", r"\d{9,11}", r"\+82-\d{1,2}-\d{3,4}-\d{4}",
]
HELPER_FAX_PATTERNS = [
    r"(?:팩스|fax|FAX)[\s:]*(\d{2,3}[-.\s]?\d{3,4}[-.\s]?\d{4})",
    r"(?:F|f)[\s:]*(\d{2,3}[-.\s]?\d{3,4}[-.\s]?\d{4})",
]
HELPER_EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
HELPER_URL_PATTERN = r"https?://[-\w.]+(?:[:\d]+)?(?:/[\w/_.]*(?:\?[\w&=%.]*)?(?:#[\w.]*)?)?"
ENHANCED_PHONE_PATTERNS = [
    r"\d{2,3}-\d{3,4}-\d{4}", r"\d{2,3}\.\d{3,4}\.\d{4}",
    r"tel[:\s]*(\d{2,3}-\d{3,4}-\d{4})", r"전화[:\s]*(\d{2,3}-\d{3,4}-\d{4})",
]
ENHANCED_FAX_PATTERNS = [
    r"팩스[:\s]*(\d{2,3}-\d{3,4}-\d{4})", r"fax[:\s]*(\d{2,3}-\d{3,4}-\d{4})",
    r"F[:\s]*(\d{2,3}-\d{3,4}-\d{4})",
]
SEARCH_PHONE_PATTERNS = [
    r"\b0\d{1,2}-\d{3,4}-\d{4}\b", r"\b\d{3}-\d{3,4}-\d{4}\b",
    r"\b0\d{1,2}\s+\d{3,4}\s+\d{4}\b", r"\b\d{3}\s+\d{3,4}\s+\d{4}\b",
    r"\b0\d{1,2}\.\d{3,4}\.\d{4}\b", r"\b\d{3}\.\d{3,4}\.\d{4}\b",
    r"\b\(0\d{1,2}\)\s*\d{3,4}[-\s]\d{4}\b", r"\b0\d{1,2}\)\s*\d{3,4}[-\s]\d{4}\b",
    r"\b0\d{9,10}\b",
    r"(?:Tel|TEL|전화|연락처|대표번호)[\s:]*(\d{2,3}[-\.\s]*\d{3,4}[-\.\s]*\d{4})",
    r"(?:Tel|TEL|전화|연락처|대표번호)[\s:]*(\(\d{2,3}\)[\s]*\d{3,4}[-\.\s]*\d{4})",
]
CRAWL_FAX_PATTERNS = [
    r"팩스[\s:：]*(\d{2,4}[-\s]?\d{3,4}[-\s]?\d{4})", r"fax[\s:：]*(\d{2,4}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"F[\s:：]*(\d{2,4}[-\s]?\d{3,4}[-\s]?\d{4})", r"전송[\s:：]*(\d{2,4}[-\s]?\d{3,4}[-\s]?\d{4})",
    r"(\d{2,4}[-\s]?\d{3,4}[-\s]?\d{4}).*팩스", r"(\d{2,4}[-\s]?\d{3,4}[-\s]?\d{4}).*fax",
]
SHORT_ADDRESS_PATTERN = r"[가-힣]+(?:시|군|구)\s+[가-힣\s\d\-]+(?:로|길|동)"

# --- fixed values: health thresholds and alert rules -------------------------
# name, SQL predicate on a health sample, severity, cooldown in minutes
ALERT_RULES = [
    ("high_cpu_usage", "cpu_usage > 80", "warning", 5),
    ("high_memory_usage", "memory_usage > 85", "warning", 5),
    ("critical_cpu_usage", "cpu_usage > 95", "critical", 2),
    ("critical_memory_usage", "memory_usage > 95", "critical", 2),
    ("high_error_rate", "error_count > 10", "warning", 10),
    ("slow_response_time", "response_time > 5", "warning", 5),
    ("no_active_agents", "active_agents = 0", "critical", 1),
]

# --- fixed values: ingest headers -------------------------------------------
EXACT_HEADERS = {
    "Name": "name", "기관명": "name", "name": "name",
    "Category": "category", "분류": "category", "category": "category",
    "homepage": "homepage", "홈페이지": "homepage", "url": "homepage",
    "전화번호": "phone", "phone": "phone", "전화": "phone",
    "팩스1": "fax", "팩스번호": "fax", "fax": "fax", "팩스": "fax",
    "이메일": "email", "email": "email",
    "핸드폰1": "mobile", "핸드폰": "mobile", "mobile": "mobile",
    "우편번호": "postal_code", "postal_code": "postal_code",
    "주소2": "address", "주소": "address", "address": "address",
}
KEYWORD_HEADERS = [
    ("name", ["학원명", "기관명", "상호명", "name", "교회명"], []),
    ("address", ["도로명주소", "주소", "address", "소재지"], []),
    ("phone", ["전화번호", "phone", "연락처"], ["팩스"]),
    ("fax", ["팩스", "fax"], []),
    ("email", ["이메일", "email", "e-mail"], []),
    ("homepage", ["홈페이지", "homepage", "website", "url"], []),
    ("category", ["분야명", "교습과정", "category", "업종"], []),
    ("subcategory", ["교습과정명", "계열", "교단"], []),
]
CANDIDATE_HEADERS = {
    "name": ["name", "이름", "업체명", "회사명", "기관명"],
    "category": ["category", "카테고리", "업종", "분류"],
    "homepage": ["homepage", "홈페이지", "웹사이트", "website"],
    "phone": ["phone", "전화번호", "전화", "tel"],
    "fax": ["fax", "팩스", "facsimile"],
    "email": ["email", "이메일", "mail"],
    "mobile": ["mobile", "휴대폰", "핸드폰", "모바일"],
    "postal_code": ["postal_code", "우편번호", "zipcode"],
    "address": ["address", "주소", "addr", "소재지"],
}
CENTER_HEADERS = {"기관명": "name", "주소": "address", "전화번호": "phone", "팩스번호": "fax", "홈페이지": "homepage"}
EXCLUDED_FIELDS = [
    "processing_error", "validation_errors", "extraction_timestamp", "source_url",
    "extraction_method", "merge_status", "phone_validation_error", "email_validation_error",
    "ai_analysis", "search_results", "homepage", "extraction_summary",
]
FIRST_FIELDS = ["name", "category", "homepage", "phone", "fax", "email", "mobile", "postal_code", "address"]
CRAWL_FIELDS = ["homepage_parsed", "page_title", "ai_summary", "parsing_timestamp"]
CRAWL_FIELDS_LONG = [
    "homepage_parsed", "page_title", "page_content_length", "contact_info_extracted",
    "meta_info", "ai_summary", "parsing_timestamp", "parsing_status",
]
CONTACT_FIELDS = ["phone", "fax", "email", "homepage", "address"]
