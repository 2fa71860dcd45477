"""The prompts of the eleven features, as messages in columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import CATEGORIES
from .prompts import MESSAGE, message, rendered

# ---------------------------------------------------------------- fixed values: wording that models were trained and tuned on

SUMMARY = (
    "다음 원문의 핵심 내용을 한국어로 간결하게 요약하세요. "
    "원문에 없는 사실은 추가하지 마세요.\n\n"
    "### 원문 텍스트:\n{passage}"
)

QA = (
    "주어진 뉴스 본문을 읽고 질문에 답하세요. "
    "정답만 간결하게 답하세요. /no_think\n\n"
    "뉴스 본문:\n{context}\n\n"
    "질문:\n{question}"
)

SYSTEM = (
    "당신은 언론사 기자의 기사 작성을 돕는 편집 보조 도구입니다.\n"
    "- 주어진 기사에 있는 내용만 사용하세요. 기사에 없는 사실, 숫자, 평가하는 말을 더하지 마세요.\n"
    "- 기사 속 인물이나 단체의 의견은 누구의 의견인지 밝히고, 사실처럼 바꾸지 마세요.\n"
    "- 지시한 형식으로만 한국어로 답하고, 다른 말은 덧붙이지 마세요."
)

FORMATTED_ARTICLE = (
    "기사:\n{article}\n\n"
    "템플릿:\n{template}\n\n"
    "위 기사를 템플릿의 항목 순서대로 다시 작성하세요.\n"
    "- 템플릿의 모든 항목을 빠짐없이 쓰세요. 각 항목에는 그 항목에 맞는 내용만 쓰세요.\n"
    "- 항목에 맞는 내용이 기사에 없으면 그 항목에는 (기사에 없음)이라고만 쓰세요.\n"
    "- 같은 문장을 여러 항목에 반복하지 마세요.\n"
    "- 다시 작성한 기사만 출력하세요."
)

EVALUATION_ITEM = (
    "기사:\n{article}\n\n"
    "작성 기준: {title}\n"
    "기준 설명: {description}\n\n"
    "위 기사가 작성 기준을 지켰는지 기사 본문만 보고 판단하세요.\n"
    "판정은 아래 셋 중 하나입니다.\n"
    "- 충족: 기준을 지켰다\n"
    "- 미흡: 기준을 지키지 못했다\n"
    "- 해당 없음: 기사 본문만으로는 판단할 수 없다\n"
    "반드시 아래 형식으로만 답하세요.\n"
    "판정: 충족, 미흡, 해당 없음 중 하나\n"
    "이유: 판단 근거가 된 기사 내용을 담은 짧은 한 문장"
)

KEYWORD_TAGS = (
    "기사:\n{article}\n\n"
    "위 기사의 핵심 키워드를 5개 뽑으세요.\n"
    "반드시 아래 형식처럼 쉼표로 구분한 한 줄로만 답하세요.\n"
    "키워드1, 키워드2, 키워드3, 키워드4, 키워드5"
)

TITLES = (
    "기사:\n{article}\n\n"
    "위 기사에 어울리는 제목과 부제목을 3개 추천하세요.\n"
    "- 제목은 짧고 핵심이 드러나게 작성하세요.\n"
    "- 부제목은 제목 내용을 이어서 보충하는 한 문장으로 작성하세요.\n"
    "- 기사에 있는 단어들로 만드세요.\n"
    "- 세 제목은 서로 다른 관점으로 작성하세요.\n"
    "반드시 아래 형식으로만 답하세요.\n"
    "1. 제목: (제목) / 부제목: (부제목)\n"
    "2. 제목: (제목) / 부제목: (부제목)\n"
    "3. 제목: (제목) / 부제목: (부제목)"
)

ARTICLE_IDEAS = (
    "기사:\n{article}\n\n"
    "위 기사에 이어 기자가 직접 취재할 후속 기사 주제를 3개 제안하세요.\n"
    "- 각 주제는 취재할 대상과 내용이 드러나는 한 문장으로 작성하세요.\n"
    "- 문장은 \"~을 취재한다\"로 끝내세요.\n"
    "- 기사에 없는 새로운 사실을 확인하는 주제로 작성하세요.\n"
    "반드시 아래 형식으로만 답하세요.\n"
    "1. (취재 주제)\n"
    "2. (취재 주제)\n"
    "3. (취재 주제)"
)

CATEGORY = (
    "기사:\n{article}\n\n"
    "위 기사의 분야를 아래 목록에서 하나만 고르세요.\n"
    "목록: {categories}\n"
    "- IT: 인터넷, 소프트웨어, 통신, 게임, AI 서비스처럼 정보기술 제품과 서비스\n"
    "- 과학: 연구, 실험, 학술 성과, 우주, 기초과학\n"
    "- 연구 성과가 중심이면 과학, 제품이나 서비스가 중심이면 IT를 고르세요.\n"
    "- 기업의 실적, 매출, 주가, 투자가 중심이면 IT 기업이라도 경제를 고르세요.\n"
    "반드시 목록에 있는 이름 하나만 답하세요."
)

ARTICLE_METADATA = (
    "기사:\n{article}\n\n"
    "위 기사를 쓴 언론사, 기자, 기사 입력 일시를 찾아 기사에 적힌 그대로 옮기세요.\n"
    "- 언론사와 기자는 이 기사를 쓴 곳과 사람만 쓰세요. 보통 기사 맨 앞이나 맨 끝에 있습니다.\n"
    "- 언론사는 기사를 낸 신문사, 방송사, 통신사 이름입니다.\n"
    "- 작성일은 본문 속 날짜가 아닌 기사 입력 일시를 쓰세요. 입력일과 수정일이 함께 있으면 입력일을 쓰세요.\n"
    "- 찾을 수 없는 항목에는 (기사에 없음)이라고만 쓰세요.\n"
    "반드시 아래 형식으로만 답하세요.\n"
    "언론사: (언론사 이름)\n"
    "기자: (기자 이름)\n"
    "작성일: (기사에 적힌 입력 일시)"
)

DUPLICATE_CHECK = (
    "기사:\n{article}\n\n"
    "회사의 다른 기사에서 찾은 비슷한 내용:\n{similar}\n\n"
    "위 기사가 회사의 다른 기사와 같은 사건을 같은 내용으로 다룬 중복 기사인지 판단하세요.\n"
    "판정은 아래 둘 중 하나입니다.\n"
    "- 중복 의심: 지역·기관 이름과 숫자·날짜가 같은, 같은 사건을 다뤘다\n"
    "- 중복 아님: 지역이나 기관이 다르거나, 같은 기관이라도 다른 시점의 새 소식(후속 보도)이다\n"
    "- 이유에는 두 글에 모두 있는 단어만 쓰세요.\n"
    "반드시 아래 형식으로만 답하세요.\n"
    "판정: 중복 의심, 중복 아님 중 하나\n"
    "이유: 겹치는 내용이나 다른 점을 담은 짧은 한 문장"
)

EXAMPLE_ARTICLE = (
    "새봄구립도서관은 다음 달 1일부터 평일 운영 시간을 오후 10시까지 2시간 늘린다고 20일 밝혔다. "
    "이용자 설문에서 응답자의 68%가 저녁 시간 연장을 원했다는 결과를 반영한 조치다. "
    "주말 운영 시간은 지금과 같다. "
    "김바다 관장은 \"퇴근 후에도 도서관을 편하게 이용할 수 있게 하겠다\"고 말했다."
)

FORMATTED_ARTICLE_SHOT = (
    "[제목]\n[리드]\n[본문]\n[인용]\n[향후 계획]",
    "[제목] 새봄구립도서관, 평일 운영 오후 10시까지 연장\n\n"
    "[리드] 새봄구립도서관은 다음 달 1일부터 평일 운영 시간을 오후 10시까지 2시간 늘린다고 20일 밝혔다.\n\n"
    "[본문] 이용자 설문에서 응답자의 68%가 저녁 시간 연장을 원했다는 결과를 반영한 조치다. "
    "주말 운영 시간은 지금과 같다.\n\n"
    "[인용] 김바다 관장은 \"퇴근 후에도 도서관을 편하게 이용할 수 있게 하겠다\"고 말했다.\n\n"
    "[향후 계획] (기사에 없음)",
)

EVALUATION_SHOTS = (
    ("날짜는 구체적으로", "일정은 요일이나 '최근' 대신 구체적인 날짜로 씁니다.", "판정: 충족\n이유: \"다음 달 1일부터\", \"20일 밝혔다\"처럼 날짜를 구체적으로 썼다."),
    ("수치의 출처 명시", "조사 결과를 쓸 때는 조사 기관과 조사 시기를 함께 밝힙니다.", "판정: 미흡\n이유: 설문 결과 68%를 쓰면서 조사 기관과 시기를 밝히지 않았다."),
    ("그래픽 자료 제공", "수치가 많은 기사는 표나 그래프를 함께 제공합니다.", "판정: 해당 없음\n이유: 표나 그래프를 함께 제공했는지는 기사 본문만으로 알 수 없다."),
)

DUPLICATE_CHECK_ARTICLE = (
    "다온구는 이달 20일부터 공공자전거 대여소 30곳을 새로 연다고 5일 밝혔다. "
    "사업비 12억 원은 모두 구비로 충당한다."
)

DUPLICATE_CHECK_SHOTS = (
    ("다온구가 20일부터 공공자전거 대여소 30곳을 추가로 운영한다. 12억 원은 모두 구 예산이다.", "판정: 중복 의심\n이유: 다온구, 대여소 30곳, 20일, 12억 원이 두 글에 모두 있다."),
    ("누리시는 다음 달부터 공공자전거 대여소 15곳을 연다. 사업비는 6억 원이다.", "판정: 중복 아님\n이유: 다온구와 누리시로 기관이 다르고, 대여소 수와 사업비도 다르다."),
    ("다온구 공공자전거 새 대여소가 문을 연 지 한 달 만에 이용 건수가 2만 건을 넘었다.", "판정: 중복 아님\n이유: 같은 다온구 소식이지만 대여소를 연 뒤의 이용 실적을 다룬 새 소식이다."),
)

ARTICLE_METADATA_SHOT = (
    "새봄신문\n입력 2026.09.20. 오전 10:05  수정 2026.09.20. 오후 3:40\n" + EXAMPLE_ARTICLE,
    "언론사: 새봄신문\n기자: (기사에 없음)\n작성일: 2026.09.20. 오전 10:05",
)

COMPANY_DATA_TOOL = (
    "당신은 언론사 기사 작성 도구에서 사용자의 질문을 처리합니다.\n"
    "- 질문이 우리 회사(조직)의 데이터(회사 기사 수, 최근 회사 기사 목록, 분야별·기자별·언론사별 기사 수, 기사 템플릿, 작성 지침, 구성원 수)를 묻는 것이면 맞는 도구 하나를 골라 호출하세요.\n"
    "- 질문이 기사 내용이나 일반 지식을 묻는 것이면 도구를 호출하지 말고 \"없음\"이라고만 쓰세요.\n"
    "- 인자는 도구 설명에 있는 값 중에서만 고르세요.\n"
    "- 질문에 기간이 없으면 period는 \"all\"로 두고, 분야가 없으면 category를 넣지 마세요.\n"
    "- '정치부'처럼 부서 이름은 같은 분야(정치)로 보세요. 기자 이름과 언론사 이름은 질문에 적힌 그대로 옮기세요."
)

CATEGORY_LABELS = {"문화": "문화(생활 포함)"}

# ---------------------------------------------------------------- features


@dataclass(frozen=True)
class Feature:
    """What a feature says to the model: a system message or none, worked examples (values of the template, answer), a template."""

    template: str
    system: str | None = SYSTEM
    shots: tuple[tuple[dict[str, str], str], ...] = ()


FEATURES = {
    "summary": Feature(SUMMARY, None),
    "qa": Feature(QA, None),
    "formatted_article": Feature(FORMATTED_ARTICLE, shots=(({"article": EXAMPLE_ARTICLE, "template": FORMATTED_ARTICLE_SHOT[0]}, FORMATTED_ARTICLE_SHOT[1]),)),
    "evaluation_item": Feature(EVALUATION_ITEM, shots=tuple(({"article": EXAMPLE_ARTICLE, "title": t, "description": d}, a) for t, d, a in EVALUATION_SHOTS)),
    "keyword_tags": Feature(KEYWORD_TAGS),
    "titles": Feature(TITLES),
    "article_ideas": Feature(ARTICLE_IDEAS),
    "category": Feature(CATEGORY.replace("{categories}", ", ".join(CATEGORY_LABELS.get(c, c) for c in CATEGORIES))),
    "article_metadata": Feature(ARTICLE_METADATA, shots=(({"article": ARTICLE_METADATA_SHOT[0]}, ARTICLE_METADATA_SHOT[1]),)),
    "duplicate_check": Feature(DUPLICATE_CHECK, shots=tuple(({"article": DUPLICATE_CHECK_ARTICLE, "similar": s}, a) for s, a in DUPLICATE_CHECK_SHOTS)),
    "company_data_tool": Feature("{question}", COMPANY_DATA_TOOL),
}


def messages(feature: str, /, **values: Column) -> Column:
    """The messages of a feature as an array of (role, content): system, worked examples, then the user's. Null values are the empty text."""
    f = FEATURES[feature]
    held = [] if f.system is None else [message("system", F.lit(f.system))]
    for given, answer in f.shots:
        held += [message("user", rendered(f.template, **{k: F.lit(v) for k, v in given.items()})), message("assistant", F.lit(answer))]
    return F.array(*held, message("user", rendered(f.template, **values))).cast(MESSAGE)


def transcript(held: Column) -> Column:
    """Messages as one text, for digests and look-ups."""
    return F.array_join(F.transform(held, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")
