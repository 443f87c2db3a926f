"""Fixed values that results depend on: lists, tables and patterns, in their natural order."""

# Hosts never kept, and hosts that are trusted.
BLACKLISTED = (
    "youtube.com", "www.youtube.com", "youtu.be", "instagram.com", "www.instagram.com", "tiktok.com", "www.tiktok.com", "vimeo.com", "facebook.com",
    "www.facebook.com",
)
TRUSTED = (
    "wikipedia.org", "reuters.com", "apnews.com", "bloomberg.com", "nytimes.com", "wsj.com", "theguardian.com", "bbc.co.uk", "nature.com",
    "science.org", "arxiv.org", "scholar.google.com", "microsoft.com", "apple.com", "google.com", "github.com", "stackexchange.com",
    "stackoverflow.com", "nasa.gov", "nih.gov", "cdc.gov", "who.int", "un.org", "mit.edu", "stanford.edu", "harvard.edu", "ox.ac.uk", "cam.ac.uk",
    "docs.python.org", "docs.djangoproject.com", "fastapi.tiangolo.com", "flask.palletsprojects.com", "docs.sqlalchemy.org", "docs.pydantic.dev",
    "developer.mozilla.org", "reactjs.dev", "react.dev", "nextjs.org", "vuejs.org", "angular.io", "docs.npmjs.com", "nodejs.org",
    "typescriptlang.org", "www.typescriptlang.org", "bun.sh", "deno.land", "docs.docker.com", "kubernetes.io", "docs.aws.amazon.com",
    "cloud.google.com", "learn.microsoft.com", "docs.github.com", "platform.openai.com", "docs.anthropic.com", "ai.google.dev", "huggingface.co",
    "pytorch.org", "tensorflow.org", "rust-lang.org", "doc.rust-lang.org", "go.dev", "kotlinlang.org", "developer.apple.com", "docs.oracle.com",
    "pkg.go.dev", "docs.rs", "pypi.org", "rubygems.org", "packagist.org",
)

# Authority tiers by exact host.
TIER_1 = (
    "nasa.gov", "nih.gov", "cdc.gov", "fda.gov", "epa.gov", "sec.gov", "whitehouse.gov", "congress.gov", "ec.europa.eu", "who.int", "un.org",
    "worldbank.org", "imf.org", "oecd.org", "europa.eu", "bbc.co.uk", "iaea.org", "docs.python.org", "docs.djangoproject.com", "fastapi.tiangolo.com",
    "flask.palletsprojects.com", "docs.sqlalchemy.org", "docs.pydantic.dev", "developer.mozilla.org", "reactjs.dev", "react.dev", "nextjs.org",
    "vuejs.org", "angular.io", "docs.npmjs.com", "nodejs.org", "typescriptlang.org", "www.typescriptlang.org", "bun.sh", "deno.land",
    "docs.docker.com", "kubernetes.io", "docs.aws.amazon.com", "cloud.google.com", "learn.microsoft.com", "docs.github.com", "platform.openai.com",
    "docs.anthropic.com", "ai.google.dev", "huggingface.co", "pytorch.org", "tensorflow.org", "rust-lang.org", "doc.rust-lang.org", "go.dev",
    "kotlinlang.org", "developer.apple.com", "docs.oracle.com", "pkg.go.dev", "docs.rs", "pypi.org",
)
TIER_2 = (
    "arxiv.org", "scholar.google.com", "nature.com", "science.org", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "jstor.org", "ssrn.com",
    "biorxiv.org", "medrxiv.org", "mit.edu", "stanford.edu", "harvard.edu", "ox.ac.uk", "cam.ac.uk",
)
TIER_3 = (
    "reuters.com", "apnews.com", "bloomberg.com", "nytimes.com", "wsj.com", "theguardian.com", "bbc.com", "ft.com", "economist.com",
    "washingtonpost.com", "time.com", "theatlantic.com", "nbcnews.com", "cbsnews.com", "cnn.com", "edition.cnn.com", "abcnews.go.com",
    "aljazeera.com", "pbs.org", "npr.org", "independent.co.uk", "newsweek.com", "foxnews.com", "politico.com", "axios.com", "cnbc.com", "thehill.com",
)
TIER_4 = (
    "wikipedia.org", "rand.org", "brookings.edu", "pewresearch.org", "ourworldindata.org", "statista.com", "github.com", "stackoverflow.com",
    "stackexchange.com", "microsoft.com", "google.com", "apple.com", "understandingwar.org", "timesofisrael.com", "haaretz.com", "foreignpolicy.com",
    "cfr.org", "chathamhouse.org", "sipri.org",
)
TIERS = {1: TIER_1, 2: TIER_2, 3: TIER_3, 4: TIER_4}

# Signs of documentation sites.
DOC_SUBDOMAINS = (
    "docs.", "developer.", "developers.", "documentation.", "dev.", "api.", "reference.", "learn.", "guide.",
)
DOC_PATHS = (
    "/docs/", "/doc/", "/reference/", "/api/", "/tutorial/", "/manual/", "/en/stable/", "/en/latest/", "/changelog/",
)
TECH_DOMAINS = (
    "python.org", "djangoproject.com", "fastapi.tiangolo.com", "palletsprojects.com", "sqlalchemy.org", "pydantic.dev", "mozilla.org", "reactjs.dev",
    "react.dev", "nextjs.org", "vuejs.org", "angular.io", "npmjs.com", "nodejs.org", "typescriptlang.org", "docker.com", "kubernetes.io",
    "amazon.com", "amazonaws.com", "google.com", "microsoft.com", "github.com", "openai.com", "anthropic.com", "huggingface.co", "pytorch.org",
    "tensorflow.org", "rust-lang.org", "go.dev", "kotlinlang.org", "apple.com", "oracle.com", "hashicorp.com", "postgresql.org", "mongodb.com",
    "redis.io",
)

# Documentation of each technology, by keyword.
TECH_DOCS = {
    "python": ("https://docs.python.org/3/", "https://pypi.org/"),
    "django": ("https://docs.djangoproject.com/en/stable/",),
    "fastapi": ("https://fastapi.tiangolo.com/",),
    "flask": ("https://flask.palletsprojects.com/",),
    "sqlalchemy": ("https://docs.sqlalchemy.org/en/latest/",),
    "pydantic": ("https://docs.pydantic.dev/latest/",),
    "javascript": ("https://developer.mozilla.org/en-US/docs/Web/JavaScript",),
    "typescript": ("https://www.typescriptlang.org/docs/",),
    "react": ("https://react.dev/reference/react",),
    "nextjs": ("https://nextjs.org/docs",),
    "next.js": ("https://nextjs.org/docs",),
    "vue": ("https://vuejs.org/guide/",),
    "angular": ("https://angular.io/docs",),
    "nodejs": ("https://nodejs.org/en/docs/",),
    "node.js": ("https://nodejs.org/en/docs/",),
    "docker": ("https://docs.docker.com/",),
    "kubernetes": ("https://kubernetes.io/docs/",),
    "openai": ("https://platform.openai.com/docs/",),
    "anthropic": ("https://docs.anthropic.com/",),
    "claude": ("https://docs.anthropic.com/",),
    "rust": ("https://doc.rust-lang.org/book/",),
    "golang": ("https://go.dev/doc/",),
    "go": ("https://go.dev/doc/",),
    "kotlin": ("https://kotlinlang.org/docs/",),
    "swift": ("https://developer.apple.com/documentation/swift",),
    "pytorch": ("https://pytorch.org/docs/stable/",),
    "tensorflow": ("https://www.tensorflow.org/api_docs",),
    "huggingface": ("https://huggingface.co/docs",),
    "aws": ("https://docs.aws.amazon.com/",),
    "azure": ("https://learn.microsoft.com/en-us/azure/",),
    "gcp": ("https://cloud.google.com/docs",),
    "terraform": ("https://developer.hashicorp.com/terraform/docs",),
    "ansible": ("https://docs.ansible.com/",),
    "html": ("https://developer.mozilla.org/en-US/docs/Web/HTML",),
    "css": ("https://developer.mozilla.org/en-US/docs/Web/CSS",),
    "sql": ("https://www.w3schools.com/sql/", "https://dev.mysql.com/doc/"),
    "postgresql": ("https://www.postgresql.org/docs/current/",),
    "mysql": ("https://dev.mysql.com/doc/",),
    "mongodb": ("https://www.mongodb.com/docs/",),
    "redis": ("https://redis.io/docs/",),
}

# Words that tell a query's language and profile.
TURKISH_WORDS = (
    "ve", "bir", "bu", "ile", "için", "da", "de", "ne", "nedir", "nasıl", "neden", "kaç", "hangi", "bana", "benim", "olan", "var", "yok", "ama",
    "veya", "gibi", "daha", "çok", "hakkında", "haber", "haberleri", "neler", "oldu", "yapay", "zeka", "araştır", "anlat", "açıkla", "karşılaştır",
    "listele", "özetle", "tablo", "son", "güncel", "bugün", "yarın", "dün", "geçen", "gelecek", "mı", "mi", "mu", "mü", "ki", "dan", "den", "dir",
)
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"
ACADEMIC_WORDS = (
    "paper", "study", "research", "journal", "arxiv", "pubmed", "doi", "citation", "abstract", "hypothesis", "experiment", "peer review",
    "peer-review", "literature review", "methodology", "meta-analysis", "clinical trial", "dissertation", "thesis", "makale", "araştırma", "çalışma",
    "tez", "yayın", "akademik", "bilimsel", "dergi", "atıf", "deneysel",
)
NEWS_WORDS = (
    "news", "breaking", "latest", "today", "yesterday", "this week", "this month", "current", "update", "announcement", "headline", "report",
    "journalist", "press", "coverage", "incident", "haber", "son dakika", "güncel", "bugün", "dün", "bu hafta", "bu ay", "gelişme", "açıklama",
    "basın",
)

# Words without weight in relevance and in citation checks.
RELEVANCE_STOPWORDS = (
    "nedir", "nasil", "nicin", "kimdir", "hangi", "hakkinda", "olarak", "olan", "icin", "gibi", "kadar", "tarafindan", "neden", "veya", "yahut",
    "veyahut", "what", "when", "where", "which", "who", "whom", "whose", "why", "how", "that", "this", "these", "those", "then", "than", "here",
    "there", "about", "above", "across", "after", "against", "along", "among", "around", "with", "within", "without", "would", "should", "could",
    "have", "been", "from", "into", "onto", "upon", "they", "their", "them", "your", "yours",
)
CITATION_STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these",
    "those", "i", "you", "he", "she", "it", "we", "they", "what", "which", "who", "whom", "when", "where", "why", "how", "not", "no", "nor", "so",
    "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other", "some", "such", "than", "then", "there",
    "here",
)

# Upper bounds of the latency histogram in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, float("inf"))

# Names of sources by a part of the host, in order of precedence.
SOURCE_NAMES = {
    "reddit.com": "reddit", "github.com": "github", "stackoverflow.com": "stackoverflow", "medium.com": "medium", "dev.to": "devto",
    "news.ycombinator.com": "hackernews", "arxiv.org": "arxiv", "wikipedia.org": "wikipedia", "youtube.com": "youtube", "twitter.com": "twitter",
    "x.com": "twitter", "openai.com": "openai", "anthropic.com": "anthropic", "gemini.google.com": "google-gemini", "ai.google": "google-ai",
}

# What a crawl leaves out.
SKIPPED_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".pdf", ".zip", ".tar",
    ".gz", ".rar", ".exe", ".dmg", ".mp4", ".mp3", ".avi", ".mov", ".wmv", ".flv", ".xml", ".json", ".txt", ".csv",
)
DEAD_ENDS = (
    "login", "logout", "register", "signup", "sign-up", "cart", "basket", "checkout", "payment", "order", "print", "share", "embed", "feed", "rss",
    "giris", "cikis", "uye-ol", "kayit", "sepet", "odeme", "search", "ara", "tag", "etiket",
)

# Sources for queries without candidates, in order.
TEMPLATES = {
    "wikipedia": "https://en.wikipedia.org/wiki/{query}",
    "google_search": "https://www.google.com/search?q={query}",
    "google_news": "https://news.google.com/search?q={query}",
    "reddit": "https://www.reddit.com/search/?q={query}",
    "stackoverflow": "https://stackoverflow.com/search?q={query}",
    "github": "https://github.com/search?q={query}",
    "arxiv": "https://arxiv.org/search/?query={query}",
    "medium": "https://medium.com/search?q={query}",
    "devto": "https://dev.to/search?q={query}",
    "hackernews": "https://hn.algolia.com/?q={query}",
}

# Words of a query that ask for subpages, code, sources of code, tables and benchmarks.
SUBPAGE_WORDS = (
    "alt sayfa", "alt sayfalar", "alt sayfaları", "alt sayfalarını", "alt sayfalarini", "alt sayfalarında", "alt sayfalarinda", "alt sayfaları da",
    "alt sayfalarını da", "alt sayfalarini da", "tüm sayfaları", "tüm sayfalarını", "bağlantıları", "linkleri", "sitedeki sayfalar", "sitemap", "tara",
    "hepsini tara", "tüm", "subpages", "sub-pages", "all pages", "crawl", "sublinks", "internal links", "all links", "every page", "entire site",
    "whole site", "follow links",
)
CODE_WORDS = (
    "code", "code example", "code snippet", "function", "class", "method", "algorithm", "syntax", "how to implement", "how to write", "how to create",
    "how to use", "how to call", "programming", "coding", "developer", "software", "api", "endpoint", "library", "framework", "module", "import",
    "variable", "loop", "array", "dictionary", "tuple", "struct", "interface", "decorator", "annotation", "async", "await", "promise", "callback",
    "closure", "inheritance", "polymorphism", "encapsulation", "compile", "runtime", "debug", "exception", "error handling", "type hint", "generic",
    "template", "kod", "kod örneği", "fonksiyon", "sınıf", "metod", "algoritma", "söz dizimi", "nasıl yazılır", "nasıl kullanılır", "nasıl yapılır",
    "nasıl çağrılır", "nasil yazilir", "nasil kullanilir", "nasil yapilir", "programlama", "yazılım", "geliştirici", "kütüphane", "değişken", "döngü",
    "dizi", "sözlük", "hata yakalama", "kod ver", "kod göster", "örnek kod", "kod örnegi", "kod yaz", "kodla", "kodlama", "python", "javascript",
    "typescript", "java", "c++", "c#", "golang", "rust", "ruby", "php", "swift", "kotlin", "scala", "react", "vue", "angular", "node.js", "nodejs",
    "django", "flask", "fastapi", "express", "spring", "nextjs", "next.js", "html", "css", "sql", "bash", "shell", "powershell", "docker",
    "kubernetes", "terraform", "ansible",
)
CODE_SOURCE_WORDS = (
    "code", "example", "how to", "api", "library", "framework", "implement", "tutorial", "usage", "syntax", "function", "class", "method", "kod",
    "örnek", "nasıl", "kütüphane", "kullanım",
)
TABLE_WORDS = (
    "table", "tablo", "tables", "tablolar", "list", "liste", "listing", "tabulate", "tabular", "grid", "in a table", "as a table", "tablo olarak",
    "liste olarak", "tablo şeklinde", "liste şeklinde",
)
BENCHMARK_WORDS = (
    "benchmark", "benchmarks", "benchmark results", "benchmark scores", "comparison", "compare", "vs", "versus", "score", "scores", "ranking",
    "rankings", "leaderboard", "performance results", "test results", "evaluation", "evals", "accuracy", "metrics", "specs", "specifications",
    "pricing", "price comparison", "speed comparison", "model comparison", "benchmark sonuçları", "sonuçları", "sonuclari", "karşılaştırma",
    "karsilastirma", "kıyaslama", "kiyaslama", "skor", "skorlar", "puan", "puanlar", "sıralama", "siralama", "performans sonuçları",
    "özellik karşılaştırması", "fiyat karşılaştırması",
)

# Signs of official documentation in a URL, and words that don't tell a topic.
DOC_URL_SIGNS = (
    "docs.", "developer.", "developers.", "documentation.", "dev.", "api.", "reference.", "learn.", "guide.", "/docs/", "/doc/", "/reference/",
    "/api/", "/guide/", "/tutorial/", "/manual/", "/en/stable/", "/en/latest/",
)
TOPIC_STOPWORDS = ("a", "an", "the", "is", "are", "of", "in", "on", "for", "and", "or", "to", "vs", "ne", "mi", "ve", "ile", "da", "de")

# Class names that tell the language of a code block.
CODE_CLASS_PREFIXES = ("language-", "lang-", "highlight-source-", "brush:")
CODE_LANGUAGES = (
    "python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "ruby", "php", "swift", "kotlin", "scala", "sql", "bash",
    "shell", "html", "css", "json", "yaml", "xml", "r", "perl", "lua", "dart", "haskell", "elixir", "clojure", "jsx", "tsx",
)

# Elements dropped from a page's text, and signs of a bot challenge.
DROPPED_ELEMENTS = (
    "script", "style", "nav", "header", "footer", "aside", "form", "iframe", "noscript",
    "svg", "canvas", "dialog", "video", "audio", "button", "input", "select", "textarea",
)
CHALLENGE_SIGNS = (
    "just a moment", "cf-browser-verification", "cloudflare-challenge", "challenge-error-text",
    "enable javascript and cookies to continue", "cf-chl-bypass", "cf-challenge-body",
)

# Patterns of dates in snippets and contents, with [0-9] for digits so that all engines read them alike.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SNIPPET_ISO_DATE = r"\b(202[0-9]-[01][0-9]-[0123][0-9])\b"
SNIPPET_WRITTEN_DATE = rf"(?i)\b({_MONTHS}|{_SHORT_MONTHS})\s+[0-9]{{1,2}},?\s+(202[0-9])\b"
SNIPPET_YEAR = r"\b(202[0-9]|2019)\b"
CONTENT_METADATA_DATE = r'"(?:datePublished|date|publishedAt|pubDate)"\s*:\s*"([0-9]{4}-[0-9]{2}-[0-9]{2})'
CONTENT_ISO_DATE = r"\b(202[0-9]-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))\b"
CONTENT_WRITTEN_DATE = rf"\b(?:{_MONTHS})\s+[0-9]{{1,2}},?\s+(202[0-9])\b"

# What sanitizing takes out, and the notes of texts that are cut.
SCRIPT_URI = r"(?:javascript|vbscript|data:(?:text/html|application/[a-z+\-]+)):[^\s]*"
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
FENCE_OPENING, FENCE_CLOSING = r"```[\w]*\n", "\n```"
SAFETY_NOTE = "\n\n[Content truncated for safety.]"
CONTENT_NOTE = "\n\n[Content truncated...]"

# How long a citation's claim is at most, and where sentences end.
CLAIM_SIZE = 300
SENTENCE_ENDS = (". ", ".\n", "! ", "? ")

# Words of sites that suit a query's profile.
NEWS_SITES = ("reuters", "apnews", "bbc", "cnn", "news", "bloomberg")
ACADEMIC_SITES = ("arxiv", "pubmed", "doi", "acm", "ieee", "springer")
DOC_SITES = ("docs", "documentation", "api", "developer")

# Fixed values, for each provider of result pages: class of a hit's container, then (tag, classes) of title, link and snippet; None stands for any class.
RESULT_SHAPES = {
    "duckduckgo": ("result", ("a", ("result__a",)), ("a", ("result__a",)), ("a", ("result__snippet",))),
    "google": ("g", ("h3", None), ("a", None), ("div", ("VwiC3b", "s3v94d", "Lyiue"))),
}

# Names of the authority tiers.
TIER_LABELS = {1: "Official/Institutional", 2: "Academic", 3: "Established Media", 4: "Research Orgs/Reference", 5: "Unknown/Other"}

# Ranges of addresses that aren't public (first, last), as hexadecimal numbers, by the registries of special IPv4 and IPv6 addresses.
SPECIAL_V4 = (
    ("00000000", "00ffffff"),
    ("0a000000", "0affffff"),
    ("64400000", "647fffff"),
    ("7f000000", "7fffffff"),
    ("a9fe0000", "a9feffff"),
    ("ac100000", "ac1fffff"),
    ("c0000000", "c0000008"),
    ("c000000b", "c00000ff"),
    ("c0000200", "c00002ff"),
    ("c0a80000", "c0a8ffff"),
    ("c6120000", "c613ffff"),
    ("c6336400", "c63364ff"),
    ("cb007100", "cb0071ff"),
    ("f0000000", "ffffffff"),
)
SPECIAL_V6 = (
    ("00000000000000000000000000000000", "00000000000000000000000000000001"),
    ("00000000000000000000ffff00000000", "00000000000000000000ffffffffffff"),
    ("0064ff9b000100000000000000000000", "0064ff9b0001ffffffffffffffffffff"),
    ("01000000000000000000000000000000", "0100000000000000ffffffffffffffff"),
    ("20010000000000000000000000000000", "20010001000000000000000000000000"),
    ("20010001000000000000000000000003", "20010002ffffffffffffffffffffffff"),
    ("20010004000000000000000000000000", "200100040111ffffffffffffffffffff"),
    ("20010004011300000000000000000000", "2001001fffffffffffffffffffffffff"),
    ("20010040000000000000000000000000", "200101ffffffffffffffffffffffffff"),
    ("20010db8000000000000000000000000", "20010db8ffffffffffffffffffffffff"),
    ("20020000000000000000000000000000", "2002ffffffffffffffffffffffffffff"),
    ("fc000000000000000000000000000000", "fdffffffffffffffffffffffffffffff"),
    ("fe800000000000000000000000000000", "febfffffffffffffffffffffffffffff"),
)
