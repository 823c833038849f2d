"""Dimension tables: small constant lists the pipeline needs.

Each list is tiny (at most a few dozen entries); operators turn them into
array literals or small DataFrames, so they never cause a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the behaviour being reproduced; they are
# stated as plain text in their natural order.
# ---------------------------------------------------------------------------

# Basic categories, in order, with their descriptions.
BASIC_CATEGORIES = [
    ("politics", "Government, elections, politicians, policy, congress, parliament"),
    ("business", "Companies, markets, finance, stocks, trade, economy"),
    ("technology", "Computers, software, AI, startups, tech companies"),
    ("sports", "Games, teams, athletes, championships, football, basketball"),
    ("entertainment", "Movies, music, celebrities, TV shows, films, arts"),
    ("health", "Medical news, diseases, treatments, hospitals, vaccines"),
    ("science", "Research, discoveries, climate, environment, space"),
    ("world", "International news, countries, conflicts, global events"),
    ("crime", "Police, arrests, courts, investigations, criminal activity"),
]

# Keywords per basic category, in order.
CATEGORY_KEYWORDS = [
    ("politics", ["government", "election", "president", "congress", "senate", "parliament", "minister",
                  "politician", "vote", "law", "policy", "democratic", "republican", "campaign",
                  "administration"]),
    ("business", ["company", "business", "market", "stock", "finance", "economy", "bank", "trade", "revenue",
                  "profit", "investment", "earnings", "corporate", "startup", "ipo"]),
    ("technology", ["technology", "tech", "ai", "computer", "software", "startup", "apple", "google",
                    "microsoft", "innovation", "digital", "cybersecurity", "blockchain", "cryptocurrency"]),
    ("sports", ["sports", "football", "basketball", "soccer", "team", "player", "game", "match",
                "championship", "olympics", "baseball", "tennis", "golf", "hockey", "tournament"]),
    ("entertainment", ["movie", "film", "music", "celebrity", "actor", "singer", "show", "tv", "entertainment",
                       "arts", "hollywood", "concert", "album", "streaming", "netflix"]),
    ("health", ["health", "medical", "doctor", "hospital", "treatment", "vaccine", "disease", "patient",
                "medicine", "covid", "pandemic", "virus", "drug", "clinical", "healthcare"]),
    ("science", ["science", "research", "study", "discovery", "scientist", "climate", "environment", "space",
                 "nature", "nasa", "experiment", "biology", "physics", "chemistry"]),
    ("world", ["international", "global", "country", "nation", "world", "foreign", "diplomatic", "war",
               "conflict", "ukraine", "china", "russia", "europe", "asia", "africa"]),
    ("crime", ["crime", "police", "arrest", "court", "investigation", "murder", "fraud", "trial", "criminal",
               "law enforcement", "robbery", "theft", "violence", "shooting"]),
]

# Extended categories, in order, with their descriptions.
ENHANCED_CATEGORIES = [
    ("politics_domestic", "Внутренняя политика, местные политики, правительственные решения"),
    ("politics_international", "Международная политика, дипломатия, отношения между странами"),
    ("politics_elections", "Выборы, избирательные кампании, результаты голосования"),
    ("business_markets", "Фондовые рынки, инвестиции, торговля, финансы"),
    ("business_tech", "Технологические компании, стартапы, венчурные инвестиции"),
    ("business_economy", "Экономические показатели, инфляция, безработица, ВВП"),
    ("technology_ai", "Искусственный интеллект, машинное обучение, нейронные сети"),
    ("technology_software", "Программное обеспечение, приложения, операционные системы"),
    ("technology_hardware", "Компьютеры, смартфоны, процессоры, электроника"),
    ("sports_football", "Футбол, чемпионаты, матчи, футболисты"),
    ("sports_other", "Другие виды спорта, соревнования, спортсмены"),
    ("sports_olympics", "Олимпийские игры, международные спортивные соревнования"),
    ("entertainment_movies", "Фильмы, кинематограф, актеры, режиссеры"),
    ("entertainment_music", "Музыка, концерты, музыканты, альбомы"),
    ("entertainment_tv", "Телевидение, сериалы, шоу, телеведущие"),
    ("health_medical", "Медицинские исследования, лечение, больницы, врачи"),
    ("health_pandemic", "Пандемии, эпидемии, вирусы, вакцины"),
    ("health_mental", "Психическое здоровье, стресс, депрессия"),
    ("science_research", "Научные исследования, открытия, технологии"),
    ("science_climate", "Изменение климата, экология, глобальное потепление"),
    ("science_space", "Космос, астрономия, космические миссии"),
    ("world_conflicts", "Военные конфликты, войны, терроризм"),
    ("world_diplomacy", "Дипломатические отношения, переговоры, соглашения"),
    ("world_disasters", "Природные катастрофы, аварии, чрезвычайные ситуации"),
    ("crime_investigations", "Расследования преступлений, полиция, детективы"),
    ("crime_courts", "Судебные процессы, приговоры, правосудие"),
    ("crime_terrorism", "Терроризм, экстремизм, безопасность"),
    ("education", "Образование, университеты, школы, студенты"),
    ("transportation", "Транспорт, автомобили, авиация, железные дороги"),
    ("environment", "Окружающая среда, загрязнение, природа"),
    ("social_issues", "Социальные проблемы, права человека, неравенство"),
]

# Relevance gate dictionaries.
IRRELEVANT_KEYWORDS = [
    "advertisement", "sponsored", "promotion", "casino", "gambling",
    "adult content", "explicit", "nsfw", "clickbait", "fake news",
    "horoscope", "astrology", "fortune telling", "lottery",
    "weight loss miracle", "get rich quick", "earn money fast",
    "celebrity gossip", "tabloid", "scandal", "rumor",
    "spam", "scam", "fraud", "phishing", "malware",
]
RELEVANT_KEYWORDS = [
    "breaking news", "developing story", "latest update", "official statement",
    "government", "president", "minister", "congress", "parliament",
    "company", "market", "stock", "economy", "financial",
    "research", "study", "scientist", "discovery", "innovation",
    "health", "medical", "treatment", "vaccine", "disease",
    "technology", "artificial intelligence", "software", "hardware",
    "sports", "championship", "tournament", "athlete", "team",
    "climate", "environment", "disaster", "emergency",
]

# Main category -> sub-categories, in order.
CATEGORY_HIERARCHY = [
    ("politics", ["politics_domestic", "politics_international", "politics_elections"]),
    ("business", ["business_markets", "business_tech", "business_economy"]),
    ("technology", ["technology_ai", "technology_software", "technology_hardware"]),
    ("sports", ["sports_football", "sports_other", "sports_olympics"]),
    ("entertainment", ["entertainment_movies", "entertainment_music", "entertainment_tv"]),
    ("health", ["health_medical", "health_pandemic", "health_mental"]),
    ("science", ["science_research", "science_climate", "science_space"]),
    ("world", ["world_conflicts", "world_diplomacy", "world_disasters"]),
    ("crime", ["crime_investigations", "crime_courts", "crime_terrorism"]),
    ("society", ["education", "transportation", "environment", "social_issues"]),
]

# Feed sources, in collection order.
FEED_SOURCES = [
    ("cnn", "http://rss.cnn.com/rss/edition.rss"),
    ("techcrunch", "https://techcrunch.com/feed/"),
    ("guardian", "https://www.theguardian.com/world/rss"),
    ("npr", "https://feeds.npr.org/1001/rss.xml"),
    ("bbc_world", "https://feeds.bbci.co.uk/news/world/rss.xml"),
    ("ap_news", "https://feeds.aponline.com/rss/news"),
]

# Words ignored by the cluster keyword extractor.
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "is", "are", "was", "were", "be", "been", "have", "has", "had",
]

# Category -> emoji for the messenger text; anything else gets DEFAULT_EMOJI.
CATEGORY_EMOJI = [
    ("politics", "🏛️"), ("business", "💼"), ("technology", "💻"),
    ("sports", "⚽"), ("entertainment", "🎬"), ("health", "🏥"),
    ("science", "🔬"), ("world", "🌍"), ("crime", "🚨"),
]
DEFAULT_EMOJI = "📰"

# Summary prompts (system text, user text around the cluster text).
SYSTEM_PROMPT = {
    "english": (
        "You are a professional news editor. Create a brief digest from the provided news articles.\n\n"
        "Requirements:\n"
        "- Write a brief summary of the main event in 2-3 sentences\n"
        "- Use only facts from the articles, don't add external information\n"
        "- Avoid repetitions\n"
        "- Make it engaging and clear"
    ),
    "russian": (
        "You are a professional news editor. Create a brief digest from the provided news articles.\n\n"
        "Requirements:\n"
        "- Write a brief summary of the main event in 2-3 sentences in Russian\n"
        "- Use only facts from the articles, don't add external information\n"
        "- Avoid repetitions\n"
        "- Make it engaging and clear"
    ),
}
USER_PROMPT_HEAD = "Create a brief digest from these news articles:\n\n"
USER_PROMPT_TAIL = {
    "english": "\n\nBrief digest (2-3 sentences):",
    "russian": "\n\nBrief digest (2-3 sentences in Russian):",
}

# Fallback summary templates: (single source, several sources, no keywords
# for single, no keywords for several, empty cluster).
FALLBACK_TEMPLATES = {
    "english": ("News: {title}. Key topics: {kw}.",
                "Event covered by {n} sources: {title}. Main topics: {kw}.",
                "general news", "various",
                "No news available for summarization."),
    "russian": ("Новость: {title}. Ключевые темы: {kw}.",
                "Событие освещают {n} источников: {title}. Основные темы: {kw}.",
                "общие новости", "разное",
                "Нет новостей для суммаризации."),
}

# Digest header templates.
DIGEST_TITLE = {"english": "📰 News Digest for {date}", "russian": "📰 Новостной дайджест за {date}"}
DIGEST_FOOTER = {"english": "Total: {articles} articles from {events} events",
                 "russian": "Всего: {articles} статей из {events} событий"}

DEFAULT_CATEGORY = "world"
IRRELEVANT_CATEGORY = "irrelevant"
OTHER_MAIN_CATEGORY = "other"
KEYWORD_DEFAULT = "news"
E5_QUERY_PREFIX = "query: "
E5_PASSAGE_PREFIX = "passage: "
INSTRUCTOR_PREFIX = "Represent the news article for classification: "
STORE_PIPELINE_VERSION = "2.0_enhanced"
DEFAULT_RECORD_VERSION = "1.0"

# ---------------------------------------------------------------------------
# Fixture dictionaries for the driver tables (the prose there is invented, so
# the real dictionaries above barely match it). These hit every rule branch.
# ---------------------------------------------------------------------------
FIXTURE_IRRELEVANT = ["worthless", "free", "ther", "thon", "ation"]
FIXTURE_RELEVANT = ["with", "that", "from", "this"]
FIXTURE_CATEGORY_KEYWORDS = [
    ("alpha", ["with", "that", "from", "this"]),
    ("beta", ["avec", "dans", "pour", "elle"]),
    ("gamma", ["und", "nicht", "auch", "sich"]),
    ("delta", ["para", "los", "como", "pero"]),
    ("omega", ["worthless", "free"]),
]


def keyword_table(spark: SparkSession, cat_keywords=CATEGORY_KEYWORDS) -> DataFrame:
    """(category, cat_ord, keyword) rows, one per keyword."""
    rows = [(c, i, k) for i, (c, kws) in enumerate(cat_keywords) for k in kws]
    return spark.createDataFrame(rows, "category string, cat_ord int, keyword string")


def category_table(spark: SparkSession, cats=BASIC_CATEGORIES) -> DataFrame:
    rows = [(i, c, d) for i, (c, d) in enumerate(cats)]
    return spark.createDataFrame(rows, "ord int, category string, description string")


def hierarchy_table(spark: SparkSession, hierarchy=CATEGORY_HIERARCHY) -> DataFrame:
    rows = [(m, s) for m, subs in hierarchy for s in subs]
    return spark.createDataFrame(rows, "main string, sub string")

UNKNOWN_CATEGORY = "unknown"

# The English stop words of Spark ML's StopWordsRemover, in their own order.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
