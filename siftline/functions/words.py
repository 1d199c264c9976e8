"""Word lists and patterns. All are fixed values."""

# fixed values: stop words
STOP_WORDS_RU = ["в", "и", "на", "с", "по", "для", "не", "что", "это", "как", "из", "за", "к", "до", "от", "при", "или", "но", "а", "то", "все", "так", "может", "быть", "год", "года", "уже", "более"]
STOP_WORDS_EN = ["the", "is", "at", "which", "on", "a", "an", "as", "are", "was", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "can"]
TOKEN = "[a-zA-Zа-яА-ЯёЁ0-9]+"
#: The tokens of more than two characters in a lower-cased text.
LONG_TOKEN = "[a-zа-яё0-9]{3,}"

# fixed values: how broad an answer a query asks for
BRIEF = ["курс", "цена", "стоимость", "сколько", "когда", "где", "price", "cost", "rate", "when", "where", "what is", "who is", "date", "время", "адрес", "контакт"]
BROAD = ["обзор", "новости", "история", "сравнение", "анализ", "все о", "overview", "news", "history", "comparison", "analysis", "review", "все", "полный", "подробно", "complete", "comprehensive", "detailed"]
NEWS = ["новост", "news", "сегодня", "today", "вчера", "yesterday", "сейчас", "now", "актуальн", "current", "latest", "recent", "событи", "events", "происходит", "happening"]

# fixed values: weights of the lexical and the semantic score
WEIGH_LEXICAL = ["курс", "цена", "price", "cost", "когда", "where", "сколько"]
WEIGH_EVEN = ["что такое", "what is", "explain", "why", "how does", "как работает"]
WEIGH_NEWS = ["новости", "news", "события", "latest"]

# fixed values: the profile of a query
PROFILE_BRIEF = ["курс", "цена", "стоимость", "сколько", "когда", "где", "price", "cost", "rate", "when", "where", "what is", "who is"]
PROFILE_BROAD = ["обзор", "новости", "история", "сравнение", "анализ", "overview", "news", "history", "comparison", "analysis", "review"]
TYPES = [
    ("Factual/Brief", "1-2 paragraphs"),
    ("Comprehensive", "3-5 paragraphs with detailed analysis"),
    ("Medium complexity", "2-3 paragraphs"),
]
INTENTS = [
    (["курс", "цена", "price", "cost", "rate", "стоимость"], "Get current price/rate with market data", ["freshness (< 24h preferred)", "numerical accuracy", "source credibility"]),
    (["новости", "news", "события", "events"], "Get latest news and developments", ["freshness (today/yesterday)", "factual accuracy", "multiple perspectives"]),
    (["что такое", "what is", "кто", "who is"], "Get definition and background information", ["comprehensiveness", "accuracy", "authoritative sources"]),
    (["как", "how to", "каким образом"], "Get step-by-step instructions or explanation", ["clarity", "completeness", "practical examples"]),
]
OTHER_INTENT = ("General information retrieval", ["relevance", "accuracy", "comprehensive coverage"])

# fixed values: signs of facts, the last of them on lower-cased text
FACTS = [r"\d+[.,]\d+", r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}", r"\d+\s*%", r"\d{4,}", r"\d{1,2}:\d{2}"]
FACTS_LOWER = [r"[\$€₽£¥]\s*\d+|руб|usd|eur|btc"]
FACTOID = [r"(курс|цена|price|cost)\s+\S+", r"(когда|when)\s+", r"(сколько|how much|how many)", r"(где|where)", r"(кто|who)"]

# fixed values: lines that are no content if short
GARBAGE = ["подписаться", "подпис", "subscribe", "sign up", "telegram", "whatsapp", "вконтакте", "в max", "следите за нами", "follow us", "поделиться", "share on", "tweet", "facebook", "twitter", "комментар", "comment", "оставьте отзыв", "читайте также", "read also", "related articles", "рекомендуем", "recommended", "похожие статьи", "новости края", "новости региона"]

# fixed values: phrases two of which make a chunk boilerplate
BOILERPLATE = ["cookie policy", "privacy policy", "terms of service", "all rights reserved", "© 20", "copyright ©", "subscribe to our newsletter", "sign up for", "follow us on", "share this article", "advertisement", "sponsored content", "click here to", "read more »", "loading...", "please wait", "javascript is disabled", "enable javascript", "accept cookies", "we use cookies", "get latest news", "in your inbox", "sign up for our", "newsletter", "get the latest", "subscribe now", "join our newsletter", "email updates", "daily digest"]
NUMERIC_LINE = r"^\s*[\d.,₽$€£¥₸\s\-—]+\s*$"

# fixed values: what holds no content, where the main part is, what is read from it
NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "iframe", "noscript", "form", "button"]
NOISE_ROLES = ["navigation", "banner", "complementary"]
NOISE_CLASSES = ["sidebar", "menu", "nav", "ad", "ads", "cookie", "popup", "modal"]
CONTENT_TAGS = ["p", "h1", "h2", "h3", "h4", "li", "td", "blockquote", "pre"]
#: Where a publish date stands: tag, attribute, value (any if None), in this order.
DATES = [
    ("meta", "property", "article:published_time"),
    ("meta", "name", "publication_date"),
    ("meta", "name", "publishdate"),
    ("meta", "property", "og:published_time"),
    ("meta", "name", "date"),
    ("meta", "itemprop", "datePublished"),
    ("time", "datetime", None),
]
DELIMITERS = [". ", "! ", "? ", ".\n", ";\n", "\n"]


def any_of(words: list[str]) -> str:
    """A pattern, the same to Java and RE2, that finds any of the words."""
    return "|".join("".join(f"\\{c}" if c in ".?*+()[]{}|^$\\" else c for c in w) for w in words)
