"""Word lists and patterns of the text operators, in their natural order. Operators take them as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

# Administrative names.
PROVINCES = "서울 부산 대구 인천 광주 대전 울산 세종 경기 강원 충북 충남 전북 전남 경북 경남 제주".split()

# Place names that say nothing but a kind (after white space is taken out).
GENERIC_NAMES = [r"^제?\d+주차장$", r"^지하주차장$", r"^주차장$", r"^옥상주차장$", r"^야외주차장$", r"^주차타워$", r"^기계식주차장$", r"^자주식주차장$", r"^공영주차장$", r"^\S{1,2}주차장$"]
GENERIC_WORDS = "공영 민영 노상 노외 무료 유료 부설 임시 주변 인근 마을공동 마을".split()
NAME_SUFFIX = r"(?:공영|민영|노외|노상|부설|유료|무료|임시|기계식)?주차장\d*$"
FACILITIES = "시장 역 대학 병원 공원 센터 회관 마을 아파트".split()
COMMON_FACILITIES = "행정복지센터 어린이공원 종합시장 전통시장 버스터미널 시외버스터미널 체육관 문화센터 보건소 주민센터 파출소 우체국".split()

# What marks a text as an offer, an advertisement or off the topic.
NOISE = [
    "모델하우스", "분양가", "분양정보", "분양조건", "잔여세대", "견본주택", "입주자모집", "입주예정", "공급조건", "시행사", "시공사", "투자수익", "프리미엄분양", r"빌라\s*매매", r"아파트\s*매매", "매물",
    r"전세\s*모", r"월세\s*모", r"원룸\s*\d", "투룸", "쓰리룸", r"상가\s*임대", r"사무실\s*임대", r"오피스텔\s*임대", "신축빌라", "신축원룸", "경매물건", r"경매\s*정보", "사건번호", "법원경매", "감정평가",
    "최저가", "낙찰", "유찰", r"임장\s*(기록|후기|보고)", r"지구\s*임장", "청약", "재개발", "재건축", r"체험단.*모집", r"업체\s*추천\s*(깔끔|꼼꼼)", "메디컬빌딩",
]
FULL_TEXT_NOISE = [r"이\s*포스팅은\s*쿠팡\s*파트너스", r"일정액의\s*수수료를\s*제공받습니다", r"본\s*포스팅은.*?원고료", r"상기\s*업체로부터.*?제공받아", r"(?i)Top\s*\d+\s*저렴한.*?주차장", r"주차장\s*위치.*?영업시간.*?주차비\s*총정리"]

# Rule classes of full texts.
ADVERTS = [
    "#협찬", r"협찬\s*(?:을\s*)?받[았아]", r"협찬\s*받은", r"협찬\s*(?:제품|품)", r"제품\s*협찬", "#광고", "#유료광고", r"유료\s*광고", r"홍보\s*포스팅입니다", r"광고\s*포스팅입니다", r"이\s*포스팅은\s*광고",
    r"이\s*(?:게시물|글)은?\s*광고", r"본\s*(?:포스팅|게시물|글)은?\s*(?:유료\s*)?광고", r"광고비\s*를?\s*받[아았]", r"서포터즈\s*(?:활동|후기|선정)", r"체험단\s*(?:선정|후기|글|이벤트)", r"원고료\s*를?\s*받[아았고]",
]
BOILERPLATE = [
    r"주차정보\s*(?:휴무일|층별|안내)", r"운영시간\s*및\s*(?:요금|주차)", r"층별\s*안내", r"(?:기본\s*)?(?:시간/요금|시간당\s*요금)", "주차구획수:", "운영요일:", "관리기관명:", r"Top\s*\d+\s*(?:주차|저렴)",
    r"주변\s*주차장\s*(?:순위|Top|추천|목록)", r"구획수\s*\d+", r"1일권\s*(?:적용|요금)", "월정기결제", r"🕒\s*운영\s*정보", r"총\s*주차면수\s*\d+\s*대", r"주차장\s*종류\s*공영",
]
OFFICIAL = [
    r"민원\s*증가", "조성.*추진", "운영하기로", "추진한다", r"지자체\s*(?:는|은|가|이)\s*(?:발표|결정|추진)", "보도자료", "구청장", "시의회", "예산",
]
PRESS = [r"기자\s*=", r"[가-힣]+기자\n", "연합뉴스", "뉴시스", "뉴스1", "[가-힣]{2,4}특파원"]
CIVIC = ["시민홍보단", r"SNS\s*홍보단", r"시민\s*기자입니다"]
NEWS = OFFICIAL + PRESS + CIVIC
REAL_ESTATE = ["매매", "전세", "분양", "임대아파트", "택지개발", "아파트 분양"]
EVENTS = ["결혼식", "돌잔치", "장례식", "웨딩홀", "예식장"]
APP_PARTS = ["사업자번호:", "전국 편의시설"]
NARRATIVE = "했어요 했습니다 이었어요 더라고요 더라구요 가봤 이용했 주차했 방문했 다녀왔 다녀와서 들어갔 나왔 기다렸 찾았 돌았 빙빙 힘들었 어려웠 불편했 편했 좋았 나빴".split()
DESCRIBED = [
    r"주차하기\s*(?:어렵|힘들|불편|쉽|편리|좋)", r"주차가\s*(?:어렵|힘들|불편|쉽|편리|좋|안됨)", "주차난", "만차", r"자리가\s*(?:없|부족|꽉)", r"빈\s*자리", "빈자리", r"진입(?:로)?(?:이|가)?\s*(?:좁|어렵|힘들|복잡|막|불편)",
    r"주차\s*(?:비|요금|료)\s*(?:\d|유료|무료|비싸|저렴|싸|부담)", r"(?:\d+분|\d+시간)\s*(?:주차|대기|기다)", r"주차\s*(?:꿀팁|팁|후기|리뷰)", r"출차\s*(?:했|어렵|힘들|오래)", "주차면",
    r"주차공간이?\s*(?:좁|협소|넓|충분|부족)",
]
TRAFFIC = ["입차", "출차", "회전반경", "일방통행", "혼잡"]
CONCRETE = DESCRIBED + TRAFFIC


@dataclass(frozen=True)
class Rules:
    """Vocabulary of the rule classes; the patterns are joined by |."""

    topic: str = "주차"
    min_length: int = 500
    adverts: list[str] = field(default_factory=lambda: ADVERTS)
    low_words: list[str] = field(default_factory=lambda: REAL_ESTATE + EVENTS + APP_PARTS)
    boilerplate: list[str] = field(default_factory=lambda: BOILERPLATE)
    news: list[str] = field(default_factory=lambda: NEWS)
    narrative: list[str] = field(default_factory=lambda: NARRATIVE)
    concrete: list[str] = field(default_factory=lambda: CONCRETE)


# Sentiment words and their exceptions.
POSITIVE = ["넓", "널널", "편하", "편해", "편한", "편리", "여유", "쉽", "쉬운", "쉬워", "쉬웠", "초보", "평면", "자주식", "잘되어", "넉넉", "깔끔", "쾌적", "공간이 넓", "자리가 많", "주차면이 넓", "좋았", "좋아요", "만족", "수월"]
NEGATIVE = [
    "좁", "힘들", "힘든", "무서", "무섭", "긁", "어려", "어렵", "어려웠", "공포", "골뱅이", "나선", "기둥", "사이드미러", "복잡", "급경사", "만차", "헬", "hell", "지옥", "빡빡", "빡시", "빡세", "위험", "찌그러", "찍힌",
    "경사", "돌아가", "불편", "안좋", "후회",
]
NOT_AFTER = {"쉽": ["아"], "쉬운": ["아"], "쉬워": ["아"], "쉬웠": ["아"], "무서": ["세", "법", "재"], "무섭": ["세", "법", "재"]}
NOT_BEFORE = {"헬": ["기", "스", "리", "멧", "로", "메"], "경사": ["로움", "롭", "스러"]}
EMOTICONS_BAD = ["ㅠㅠ", "ㅜㅜ", "ㅠ", "ㅜ", "ㅎㄷㄷ", "후덜덜", "ㄷㄷ"]
EMOTICONS_GOOD = ["👍", "꿀팁", "강추", "ㄱㅊ", "괜찮"]
INTENSIFIERS = ["ㄹㅇ", "ㅈㄴ", "진심", "진짜", "개", "존나", "너무", "엄청", "매우", "완전", "정말"]
NEGATIONS = ["아닌", "별로", "안되", "안된", "안돼", "못하", "못해", "못한"]
EXPERIENCE = [
    "좁", "힘들", "무서", "긁", "어려", "공포", "골뱅이", "나선", "기계식", "기둥", "사이드미러", "복잡", "급경사", "만차", "대기", "헬", "hell", "지옥", "빡빡", "빡시", "빡세", "회전", "경사", "넓", "널널", "편하", "편리", "여유",
    "쉽", "초보", "평면", "자주식", "넉넉", "한산", "주차면", "주차장 입구", "진입", "출차", "주차 공간", "주차하기", "차폭", "주차타워", "발렛", "좋았", "불편", "만족", "수월", "안좋", "후회", "어려웠", "쉬웠",
]


@dataclass(frozen=True)
class Feelings:
    """Vocabulary of the sentiment model."""

    topic: str = "주차"
    positive: list[str] = field(default_factory=lambda: POSITIVE)
    negative: list[str] = field(default_factory=lambda: NEGATIVE)
    not_after: dict = field(default_factory=lambda: NOT_AFTER)
    not_before: dict = field(default_factory=lambda: NOT_BEFORE)
    emoticons_bad: list[str] = field(default_factory=lambda: EMOTICONS_BAD)
    emoticons_good: list[str] = field(default_factory=lambda: EMOTICONS_GOOD)
    intensifiers: list[str] = field(default_factory=lambda: INTENSIFIERS)
    negations: list[str] = field(default_factory=lambda: NEGATIONS)
    experience: list[str] = field(default_factory=lambda: EXPERIENCE)


#: Regions of summaries and of slugs.
SUMMARY_REGIONS = "서울 부산 대구 인천 광주 대전 울산 세종 경기 강원 충북 충남 전북 경북 경남 제주".split()

# What names of places not yet in the catalogue are told by.
MISSED_GENERIC = "지하 주차 주차장 노상 노외 부설 민영 공영 지하주차장 공영주차장 노상공영 노외주차장 민영주차장 공영주차".split()
MISSED_FRAGMENTS = (
    "넓은 좁은 유료 무료 직영 민간위탁 위탁 공공 전국 상세 가까운 임시 임시공영 시민행복 행복 개방 무료개방 연휴 추석연휴 설연휴 명절 할인 예매 실시간 상영시간표 자투리 활용 생활 본사 아파트 종합 무인 만차 빈자리 추천 "
    "근처 주변 인근 일대 입구 출구 정문 후문 바로 전용 간이 임시개방"
).split()
MISSED_PAGES = r"(?i)(플레이스뷰|포털|포탈|홈페이지|블로그|카페|채용공고|구인구직|공공근로|게시판|바로가기|예매|상영시간표|실시간|CGV|롯데시네마|메가박스|Instagram|인스타그램|영화)"
MISSED_ORGANIZATIONS = r"(도시개발공사|도시관리공사|시설관리공단|도시공사|공사|공단|통합관리|운영사|관리사무소)"
PARKING_NAME = r"(?i)(주차장|파킹|parking)"
PARKING_NAME_STRONG = r"(?i)(공영주차장|민영주차장|지하주차장|부설주차장|제\s*\d+\s*주차장|파킹|parking)"
PARKING_KIND = r"(?i)(공영|민영|지하|노상|노외|부설|공공)?\s*(주차장|파킹|parking)"
ADMIN_TAIL = r"(시|군|구|읍|면|리|동|가|역)$"
FULL_PROVINCES = "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 경기도 강원특별자치도 강원도 충청북도 충청남도 전라북도 전북특별자치도 전라남도 경상북도 경상남도 제주특별자치도 경기 강원 충북 충남 전북 전남 경북 경남 제주 세종".split()
MISSED_CONFIDENCE = {"parking_lot_name": 0.7, "facility_name": 0.5, "organization_name": 0.3, "region_name": 0.2, "generic_term": 0.1, "page_or_service": 0.05, "unknown": 0.2}

# Words that a crawled title's match with a name leaves out or counts as common; what names are compared without.
CRAWL_SUFFIXES = r"주차장|공영|노외|노상|부설|제\d+"
CRAWL_COMMON = "시장 공원 아파트 역사 학교 병원 마을 센터 회관".split()
NAME_STRIP = "주차장|공영|민영|노외|노상|부설|유료|무료|임시|기계식"

# What shows that a summary was copied from a page's frame, by name, the first that fits.
CHROME = {
    "naver_blog_menu": r"MY메뉴 열기|_My Menu|클립만들기|블로그 앱|내 상품 관리 NEW",
    "naver_blog_chrome": r"이 블로그의 체크인|이 장소의 다른 글",
    "naver_blog_font_ctrl": r"본문 폰트 크기 (조정|작게|크게)|본문 기타 기능",
    "naver_cafe_chrome": r"홈 로그인하기|로그인이 필요합니다|useCafeId=false",
    "markdown_residue": r"(?i)\]\(https?://m\. com/",
    "markdown_image": r"!\[[^\]]*\]\(https?:",
    "markdown_header": r"(?:^|\n)#{1,6} [^\n]+\n",
    "markdown_link_dump": r"(?:\]\(https?:[^)]+\)[^.]{0,30}){3,}",
    "llm_injection": r"OpenAI GPT|이 텍스트를 자동으로 처리|저작권 보호를 받습니다",
    "network_error": r"로딩중입니다|네트워크 문제",
    "coupang_partners": r"쿠팡 파트너스",
    "meta_only": r"(정보를?\s*제공합니다|정보를?\s*확인할 수 있습니다|상세\s*정보를?\s*포함합니다|정책 변경 여부를?\s*확인)",
    "ai_disclosure": r"(AI[가]? 분석|데이터에 따르면|본 페이지는 자동|AI 생성 콘텐츠)",
    "qa_template": r"(Q\.\s*[^A]+A\.\s*)",
}

# Expressions that generated texts must not use, and sentences that show a template.
BANNED = ["무조건", "반드시 비어 있", "100%", "완전 무료", "항상 여유", "절대", "최고의", "가장 저렴", "가장 가까운", "확실히", "걱정 없이", "주말에도 넉넉", "피크타임에도 문제없"]
TEMPLATES = ["방문 목적에 맞게 이용하면 좋습니다", "미리 확인하시는 것을 권장합니다", "사용자 리뷰를 참고하시기 바랍니다", "실제 이용 전 확인해 보시기 바랍니다", "다양한 이용객들의 후기가 있습니다"]

# Words that name no place in a title, and words of names that tell no place from another.
KEYWORD_STOP = (
    "주차장 주차 후기 정보 공유 추천 이용 이용후기 요금 무료 저렴 가격 시간 위치 근처 주변 최신 리스트 포함 안내 방법 꿀팁 총정리 비교 네이버 블로그 카페 유튜브 플레이스 리뷰 "
    "축구장 야구장 수영장 운동장 경기장 공연장 박물관 미술관 도서관 터미널 입장 관람 가볼만한곳 "
    "여행 가기 좋은 함께 나의 다녀와서 다녀온 다녀왔어요 아이랑 아이들과 가족여행 나들이 당일치기 둘러보기 방문기 방문 코스 명소 인근 예약 갈만한 갈만한곳 가볼만한 주말 "
    "공영 민영 노상 노외 부설 임시 기계식"
).split()
NAME_GENERIC = "주차장 주차 공영 민영 노상 노외 무료 유료 부설 임시 기계식".split()
CORE_SUFFIX = r"\s*(?:공영|민영|노외|노상|부설|임시|제\d+)?\s*주차장\s*$"

# Templates that the tiers of relevance exclude.
TIER_TEMPLATES = [
    r"주차정보\s*(?:휴무일|층별|안내)", r"운영시간\s*및\s*(?:요금|주차)", r"층별\s*안내", r"(?:기본\s*)?(?:시간/요금|시간당 요금)", "주차구획수:", "운영요일:", "관리기관명:", r"Top\s*\d+\s*(?:주차|저렴)",
    r"주변\s*주차장\s*(?:순위|Top|추천|목록)",
]
DIRECTORY = [r"운영\s*요일\s*평일", r"관리번호\s*\d"]

# The strict filter. What passes at once, then reasons of removal with what excuses them.
STRICT_PLACE = r"주소|[가-힣]{2,4}구|[가-힣]{2,4}동|번지|도로명|[도로명|\d+번지]|지번|주|강남|강북|마포|용산|성동|광진|동대문|중랑|성북|강북|도봉|노원|은평|서대문|마포|종로|중구|성내|영등포|동작|관악|서초|강남|송파|강동"
STRICT_HOURS = r"[0-9]{1,2}:[0-9]{2}|시간|오픈|닫음|운영|OPEN|CLOSE"
STRICT_PRICE = r"[0-9]+원|시간당|시간|요금|비용|가격|할인|무료|유료|1시간|30분|1일|월정기|결제"
STRICT_SPACES = r"[0-9]+대|[0-9]+면|주차면수|구획수"
STRICT_USE = r"진입|출차|입차|혼잡|복잡|좁|넓|좁은|넓은|빨리|느리|오래|빨리진출|빨리입장"
STRICT_OPINION = r"어렵|쉽|힘들|불편|편리|편하|좋|나쁜|아쉬운"
STRICT_TIP = r"할인|가성비|팁|꿀팁|주의|피해|추천|한가|피크|시간대|시간|야간|낮|아침|저녁|피하"
STRICT_DETAIL = r"[0-9]시|[0-9]시간|[0-9]분|한가한|버시는|몰|정체|혼|밀려|빨라|느려"
STRICT_BRIEF = r"주차\s*(?:가능|했|할수|가능했)"
STRICT_LIST = r"TOP\s*\d+|구\s*주차장|동\s*주차장|주변\s*주차장|근처\s*주차장|추천\s*주차장|주차장\s*목록|가이드|안내"
STRICT_FACTS = r"주소|[0-9]{1,2}:[0-9]{2}|[0-9]+원|[0-9]+대|[0-9]+면|운영"
STRICT_ADVERT = r"협찬|광고|체험단|원고료|제공|쿠팡\s*파트너|후기단|선정|제품협찬|홍보\s*포스팅"
STRICT_ESTATE = r"분양|택지|개발|건설|건축|아파트분양|주택분양|부동산|아파트|주택"
STRICT_EXPERIENCE = r"사용|이용|경험|후기|주차했|방문|다녀|이용했|어렵|쉽|불편|편리"
STRICT_NEWS = r"기자\s*=|뉴스|보도자료|보도|발표|지자체|구청|시의회|시장|민원|추진|조성|사업"
STRICT_READERS = r"이용|주차|후기|경험|리뷰|방문|다녀"
STRICT_TOPIC = r"주차|주차장|차량|정차|자리|면|대|시간|요금|원|비용|할인|예약|예약금"

# The evaluator by experience.
TOPIC_WORDS = r"주차|주차장|입차|출차|파킹|주차비|주차료|주차 가능|주차하기"
PERSONAL = (
    r"(?i)주차했|주차했어요|주차해봤|다녀왔|다녀왔어요|이용해봤|이용해봤는데|주차하러|주차하면서|주차하다가|주차했더니|주차했는데|주차해서|주차한 후|주차한다면|주차해야|입차했|출차했|나는|저는|우리|내가|제가|뭔가 어려웠|어려웠어요|괜찮았|좋았어|"
    r"이용하면|방문했|갔었|탔는데|탔어요|차를 세웠|차를 세워|차를 댔|차를 대고"
)
DETAILS = [
    r"(?i)진입로|진입|회전하|진입이 (좁|어렵|쉬)|진입이 복잡|좁|넓|넓은|좁은|오르막|내리막|가파른|지하|계단|엘리베이터|턴테이블|진입로가|진입이|진입할 때",
    r"(?i)주차면|주차 칸|주차 공간|주차칸|주차 자리|주차공간|아주 좁|정말 좁|매우 좁|불편했|넓었|여유|공간|좌우|길이|깊이|차폭|공간이 넓|공간이 좁",
    r"(?i)요금|가격|비용|비싼|싸|원|시간당|30분|1시간|2시간|3시간|4시간|5시간|월정액|정기권|할인|카드|현금|결제|시간 초과|무료|요금이|가격이",
    r"(?i)혼잡|차량이 많|찬 상태|비는|만차|만석|우회|기다|대기|예약|선예약|선점|밤시간|낮시간|피크|타임|이른|저녁|점심|아침|혼잡도|차 많|차 적",
]
GUIDE = r"(?i)주차장 안내|공영주차장|주차 정보|주차 요금|주차 시간|운영 시간|운영시간|주차 시설|주차장 정보|주차장 위치|위치 요금|위치정보"
SPONSORED = r"(?i)사용자 리뷰|방문자의 의견|체험단|협찬|광고|광고성|원고료|쿠팡파트너|아마존|이 글은|제휴|제공받았|지원받았"
GUIDE_FACTS = [
    r"위치|주소|지점|호선|역|근처|도로|번지|번길|지역|곳|곳곳",
    r"요금|가격|비용|시간당|시간|원|₩|￥",
    r"운영|시간|개시|폐장|오픈|오후|오전|월|화|수|목|금|토|일|시간대",
]
PAID = r"체험단|협찬|광고|쿠팡|아마존|제휴|원고료|지원받았|제공받았|광고료|광고 콘텐츠"
ESTATE = r"분양|택지|아파트|주택|부동산|매매|임대|계약금|평수|건평|전용면적"
BULLETIN = r"기자|보도자료|발표|뉴스|뉴스레터|보도|시청|공식 발표|시장|지자체|뉴스통신|보도"
TOPIC_LINES = r"주차|주차장|입차|출차|파킹|주차비|주차료"
LISTING = r"주차장 목록|주차장 모음|주소 조회|전화번호|관리기관|구획수|주차료|운영시간|주차시설 유형|시설별|차이가 있습니다"
LISTING_EXCUSE = r"주차했|이용해봤|다녀왔|좋았|어려웠|힘들었|방문|갔었|탔는데|차를 세웠"
PLEASED = r"쉬운|넓은|깨끗|좋았|편했|만족|괜찮|좋아|추천|최고|훌륭|완벽|쉬워|편해|좋은|편리|우수|효율|만족스럽|괜찮습니다|좋습니다|추천합니다"
ANNOYED = r"좁은|어려운|불편|힘들었|어려웠|주차하기 힘|주차 어려|혼잡|복잡|막힘|나쁜|최악|끔찍|좁아|힘들어|불편합니다|최악입니다|어렵습니다|어려워요"

# Comments on videos, and names compared with search results.
COMMENT_TOPIC = ["주차", "parking", "차", "운전"]
COMMENT_HARD = ["좁", "무서", "힘들", "긁", "어려", "공포", "골뱅이", "나선", "경사", "회전", "기둥"]
COMMENT_GOOD = ["넓", "쉬", "편", "여유", "추천"]
RESULT_KINDS = "주차장|주차|지하|지상|빌딩|타워|프라자|호텔|병원|백화점"
UNKNOWN_PLACES = ["", "미상", "미확인"]
