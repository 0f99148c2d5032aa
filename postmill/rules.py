"""Word lists, patterns and labels the results depend on."""

# Relevance keywords per source.
HACKERNEWS_KEYWORDS = [
    "GPT", "Claude", "Gemini", "LLM", "AI", "openai", "anthropic",
    "deepmind", "llama", "mistral", "transformer", "diffusion",
    "huggingface", "ollama", "stable diffusion", "sora",
]
ATOM_KEYWORDS = ["ai", "llm", "gpt", "claude", "gemini", "모델", "인공지능", "ml", "agent"]
LESSWRONG_KEYWORDS = ["ai", "llm", "gpt", "claude", "alignment", "agi", "rlhf", "model"]

# Leftovers of the chat exporter.
CHAT_MARKERS = ["{Attachments}", "{Reactions}", "{Embed}", "{Stickers}", "{Forwarded Message}"]
CDN_PREFIXES = {
    "cdn_attachments": "https://cdn.discordapp.com/attachments/",
    "images_ext_external": "https://images-ext-1.discordapp.net/external/",
    "cdn_stickers": "https://cdn.discordapp.com/stickers/",
    "media_attachments": "https://media.discordapp.net/attachments/",
}
EXPORT_SEPARATOR = "=" * 62
CHAT_HEADER = r"^\[\d{4}\. \d{1,2}\. \d{1,2}\. (?:오전|오후) \d{1,2}:\d{2}\]"

# Unsourced model launch claims.
MODEL_NAME = (
    r"(?:\b(?:GPT|ChatGPT|Claude|Opus|Sonnet|Haiku|Gemini|Gemma|DeepSeek|Qwen|Kimi|Grok|Llama|Mistral|Mixtral|Sora|Veo|Imagen)\b|"
    r"제미니|클로드|딥시크|그록|라마)"
)
LAUNCH_VERB = (
    r"(?:출시|공개|발표|런칭|배포|릴리스|등장|나왔다|"
    r"released|launched|announced|unveiled|introduced|rolled\s*out|available)"
)
OFFICIAL_SOURCE = (
    r"(?:blog\.google|ai\.google\.dev|developers\.googleblog\.com|openai\.com/(?:blog|index)|"
    r"anthropic\.com/(?:news|research)|deepmind\.google|model\s*card|release\s*notes|changelog|"
    r"공식\s*(?:블로그|문서|API|모델\s*카드|릴리스\s*노트|발표문)|"
    r"(?:모델\s*카드|릴리스\s*노트|API\s*문서|개발자\s*문서))"
)
SOFTEN_HEADLINE = [
    (r"(공식\s*)?(출시|공개|발표)\s*소식", "$2 주장"),
    (r"(공식\s*)?(출시|공개|발표)(?=$|\s|,)", "$2 주장"),
]
SOFTEN_BODY = [
    ("출시했다는 소식", "출시했다는 주장이"),
    ("공개했다는 소식", "공개했다는 주장이"),
    ("발표했다는 소식", "발표했다는 주장이"),
    ("출시했습니다", "출시했다는 주장이 나왔습니다"),
    ("공개했습니다", "공개했다는 주장이 나왔습니다"),
    ("발표했습니다", "발표했다는 주장이 나왔습니다"),
    ("출시했다", "출시했다는 주장이 나왔다"),
    ("공개했다", "공개했다는 주장이 나왔다"),
    ("발표했다", "발표했다는 주장이 나왔다"),
]
UNCONFIRMED_PREFIX = "미확인: "
UNCONFIRMED_MARKS = ["미확인:", "루머:"]
UNCONFIRMED_BODY_PREFIX = "공식 출처가 확인되지 않은 채팅 기반 주장으로, 농담이나 루머일 가능성이 있어 미확인 소식으로 분류합니다. "

# Products whose release is reported once.
PRODUCT_STORIES = {
    "gpt-image-2": (
        r"(?:\bGPT[-\s]?Image[-\s]?2\b|ChatGPT\s+Images\s+2(?:\.0)?|"
        r"\bImages\s+2\.0\b|\bImage\s+2\b)"
    ),
}
PRODUCT_FOLLOWUP = (
    r"(?:리더보드|벤치마크|성능|점수|기반\s*모델|메타데이터|C2PA|시스템\s*카드|"
    r"안전|검열|거부|가격|토큰|스냅샷|레이트\s*리밋|Heavy\s*Thinking|Thinking\s*모드|"
    r"leaderboard|benchmark|system\s*card|metadata|snapshot|rate\s*limit|pricing|safety)"
)
FOLLOWUP_PREFIX = "후속: "

# Keyword extraction.
KEYWORD_PATTERN = r"[A-Za-z가-힣]+(?:[.-]\p{Nd}+(?:\.\p{Nd}+)?)?|\p{Nd}+\.\p{Nd}+(?:\.\p{Nd}+)?"
KEYWORD_STOP = ["the", "and", "or", "a", "an", "is", "을", "를", "의", "이", "가", "에", "으로", "그", "는", "은", "도"]
TRUNCATION_MARK = "\n... (truncated)"

# Texts of the fallback summary.
SUMMARY_TITLE_DEFAULT = "오늘의 AI 업데이트"
SUMMARY_TITLE_EMPTY = "새 업데이트 없이 이어지는 하루"
SUMMARY_BODY_EMPTY = "오늘 새로 확인된 업데이트는 없습니다. 기존 기사와 아카이브는 그대로 유지됩니다."
SUMMARY_BODY_HEAD = "오늘 업데이트는 "
SUMMARY_BODY_TAIL = "을 중심으로 정리됩니다."
LABEL_RUMOR, LABEL_NEWS = "찌라시", "뉴스"
LABEL_LOW, LABEL_HIGH = "낮은 신뢰", "확인된 흐름"
SUMMARY_REST_HEAD, SUMMARY_REST_TAIL = "그 외 ", "건"

# Line cleaning of model output.
HANGUL = r"\uac00-\ud7af"
HANGUL_JAMO = r"\uac00-\ud7af\u3130-\u318f"
META_PHRASES = ["constraint", "check:", "user name", "draft", "headline:", "korean?", "length?"]
META_PHRASES_SHORT = ["constraint", "check:", "draft"]
META_PREFIXES = ["*", "-", "#", "```"]
PLACEHOLDER_BODIES = ["(Body)", "(본문", "(Title)", "(제목"]
