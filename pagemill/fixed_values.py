"""Word lists, patterns, thresholds and texts that decide results.

These are data, not logic. They have to equal the values users rely on today, so
they are stated plainly and in their natural order.
"""

# --- fixed values: sentiment words -----------------------------------------
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "awesome", "love",
    "like", "enjoy", "happy", "joy", "success", "win", "best", "perfect",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "worst", "hate", "dislike", "sad",
    "angry", "frustrated", "fail", "lose", "problem", "issue", "error", "broken",
]

# --- fixed values: topics and their keywords, in tie order -------------------
TOPIC_KEYWORDS = {
    "technology": ["ai", "machine learning", "python", "javascript", "react", "database", "cloud", "api"],
    "business": ["startup", "investment", "market", "revenue", "profit", "strategy", "management"],
    "health": ["medical", "healthcare", "treatment", "medicine", "doctor", "patient", "symptoms"],
    "education": ["learning", "course", "student", "teacher", "school", "university", "education"],
    "sports": ["football", "basketball", "tennis", "game", "player", "team", "championship"],
    "entertainment": ["movie", "music", "celebrity", "film", "actor", "director", "album"],
    "politics": ["government", "election", "policy", "president", "congress", "vote", "law"],
    "science": ["research", "study", "experiment", "discovery", "scientific", "laboratory"],
}

# --- fixed values: content types and their indicators, in tie order ----------
TYPE_INDICATORS = {
    "news": ["news", "reports", "announced", "published", "released"],
    "tutorial": ["how to", "guide", "tutorial", "step by step", "learn"],
    "review": ["review", "rating", "stars", "recommend", "opinion"],
    "technical": ["code", "function", "class", "method", "algorithm", "api"],
    "marketing": ["buy", "sale", "discount", "offer", "promotion", "subscribe"],
    "academic": ["research", "study", "analysis", "data", "results", "conclusion"],
}

# --- fixed values: language indicators --------------------------------------
ENGLISH_WORDS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of"]
SPANISH_WORDS = ["el", "la", "de", "que", "y", "en", "un", "es", "se", "no"]

# --- fixed values: readability bands (lowest score of the band, name) --------
READABILITY_BANDS = [
    (90, "Very Easy"), (80, "Easy"), (70, "Fairly Easy"), (60, "Standard"),
    (50, "Fairly Difficult"), (30, "Difficult"),
]
READABILITY_LOWEST = "Very Difficult"

# --- fixed values: entity patterns ------------------------------------------
# URLs are a run of one character class: an alternation of classes and escapes inside a repeat recurses once per
# character in Java's matcher and overflows its stack on long URLs. The class is the union of those alternatives.
ENTITY_PATTERNS = {
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "urls": r"https?://[!$-_a-z]+",
    "phone_numbers": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "dates": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
}

# --- fixed values: URL exclusion --------------------------------------------
# Listed one by one; ``functions.urls.excluded_pattern`` joins them to a single alternation, so a URL is searched once.
EXCLUDED_SUFFIXES = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar.gz", "exe", "dmg",
    "mp3", "mp4", "avi", "mov", "wmv", "flv", "jpg", "jpeg", "png", "gif", "bmp", "svg",
]
EXCLUDED_SCHEMES = ["mailto:", "tel:", "ftp:", "javascript:"]

# --- fixed values: page texts that carry no content (matched at the start) ---
# Each is tried at the start only; ``operators.pages.clean_web_text`` joins them to one anchored alternation.
BOILERPLATE_STARTS = [
    r"(skip to|jump to|go to)\s+\w+",
    r"(home|about|contact|privacy|terms)\s*$",
    r"\s*(©|copyright)\s*\d{4}",
    r"(follow us|connect with us)",
]

# --- fixed values: selectors of the main content, by priority ----------------
MAIN_SELECTORS = ["main", "article", ".content", ".main-content", "#content", "#main"]

# --- fixed values: link scoring ----------------------------------------------
LINK_TYPE_TERMS = {
    "tutorial": ["tutorial", "guide", "how-to", "learn", "course", "lesson"],
    "technical": ["documentation", "docs", "api", "reference", "spec", "manual"],
    "news": ["news", "article", "blog", "update", "latest", "recent"],
    "academic": ["research", "paper", "study", "analysis", "journal", "academic"],
    "review": ["review", "comparison", "vs", "evaluation", "rating", "opinion"],
}
EDUCATIONAL_TERMS = ["learn", "tutorial", "guide", "course", "education", "training"]
LOW_QUALITY_TERMS = ["download", "free", "click", "here", "more", "read more"]

# --- fixed values: learning path, one row per (topic, step) ------------------
LEARNING_STEPS = {
    "technology": [
        ("Fundamentals", "Learn basic concepts and terminology", ["basics", "introduction", "fundamentals"]),
        ("Practical Examples", "Find tutorials and hands-on guides", ["tutorial", "example", "hands-on"]),
        ("Advanced Topics", "Explore advanced concepts and best practices", ["advanced", "best practices", "expert"]),
        ("Real-world Applications", "See how it's used in production", ["case study", "production", "real-world"]),
    ],
    "business": [
        ("Market Research", "Understand the market landscape", ["market research", "industry analysis"]),
        ("Strategy Development", "Learn strategic approaches", ["strategy", "planning", "framework"]),
        ("Implementation", "Find practical implementation guides", ["implementation", "execution", "process"]),
        ("Case Studies", "Study successful examples", ["case study", "success story", "example"]),
    ],
    "health": [
        ("Basic Information", "Understand fundamental health concepts", ["basics", "overview", "introduction"]),
        ("Research & Studies", "Find scientific research and studies", ["research", "study", "clinical"]),
        ("Expert Opinions", "Read expert analysis and opinions", ["expert", "doctor", "professional"]),
        ("Practical Guidance", "Find actionable health guidance", ["guide", "advice", "recommendations"]),
    ],
}
LEARNING_STEPS_GENERIC = [
    ("Foundation", "Build foundational knowledge", ["basics", "introduction"]),
    ("Deep Dive", "Explore topic in detail", ["detailed", "comprehensive"]),
    ("Advanced Concepts", "Study advanced aspects", ["advanced", "expert level"]),
    ("Practical Application", "Apply knowledge practically", ["practical", "application", "examples"]),
]

# --- fixed values: search suggestion templates -------------------------------
SEARCH_KEYWORD_TEMPLATES = [
    "{topic} {keyword} tutorial", "{topic} {keyword} guide", "best {topic} {keyword} resources",
    "{topic} {keyword} examples", "learn {topic} {keyword}",
]
SEARCH_TYPE_TEMPLATES = {
    "technical": ["{topic} documentation", "{topic} API reference", "{topic} best practices"],
    "tutorial": ["{topic} beginner guide", "{topic} step by step", "{topic} course"],
    "news": ["{topic} latest news", "{topic} updates", "{topic} trends"],
}

# --- fixed values: recommendation strategy -----------------------------------
STRATEGY_APPROACH = "content-based filtering"
STRATEGY_FACTORS = ["topic relevance", "keyword matching", "content type alignment"]

# --- fixed values: HTTP failures ----------------------------------------------
STATUS_MESSAGES = {404: "Page not found", 403: "Access forbidden", 500: "Server error"}

# --- fixed values: health thresholds and issue texts --------------------------
CPU_LIMIT, MEMORY_LIMIT, DISK_LIMIT, ERROR_RATE_LIMIT = 80, 85, 90, 10
CACHE_HIT_FLOOR, CACHE_HIT_LOG_FLOOR, CACHE_MEMORY_LIMIT = 70, 80, 100_000_000

# --- fixed values: store advice -------------------------------------------------
STORE_SIZE_LIMIT, SLOW_QUERY_MILLIS, SLOW_QUERY_COUNT, INDEX_SHARE = 1_000_000_000, 100, 5, 0.5
ADVICE_ARCHIVE = "Consider implementing data archiving for large collections"
ADVICE_SLOW = "Multiple slow queries detected. Review and optimize query patterns"
ADVICE_INDEX = "Index size is large relative to data size. Consider index optimization"

# --- fixed values: outcome of recommendations without links or analysis -----
NO_RECOMMENDATIONS = "Insufficient data for recommendations"
