"""Rule tables. All values here are fixed: results depend on them as they stand, in this order."""

from __future__ import annotations

# -- fixed values: content types of search results by URL; the first rule with a substring of the lower-cased URL wins.
URL_TYPES = (
    ("documentation", ("docs.", "/docs/", "/documentation/", "readthedocs", "javadoc", "/api/")),
    ("documentation", ("github.com", "gitlab.com", "stackoverflow.com", "stackexchange.com", "bitbucket.org")),
    ("social", ("twitter.com", "x.com", "facebook.com", "linkedin.com", "instagram.com", "tiktok.com")),
    ("forum", ("reddit.com", "forum", "discourse", "community.")),
    ("video", ("youtube.com", "youtu.be", "vimeo.com", "twitch.tv")),
    ("shopping", ("amazon.", "ebay.", "shop.", "/shop/", "store.")),
    ("article", ("news.", "/news/", "bbc.", "cnn.", "nytimes.", "reuters.")),
)
DEFAULT_TYPE = "article"

# -- fixed values: topics as (name, parts of the URL, parts of the title, content type). A rule without a type holds for any.
TOPICS = (
    ("technology", ("github.com", "stackoverflow.com", "gitlab.com"), ("programming", "code"), None),
    ("documentation", ("docs.", "/docs/", "/documentation/"), ("documentation", "api reference"), None),
    ("news", ("news.", "/news/"), (), "article"),
    ("academic", (".edu", "arxiv.org", "scholar.google"), ("research", "study"), None),
)

# -- fixed values: languages by script, the first range that occurs anywhere wins; else en.
LANGUAGES = (("zh", "一-鿿"), ("ja", "぀-ヿ"), ("ko", "가-힯"), ("ru", "Ѐ-ӿ"), ("ar", "؀-ۿ"))

# -- fixed values: signs of bot protection, in titles (lower-cased) and as selectors.
SUSPICIOUS_TITLES = ("security check", "ddos protection", "please wait", "just a moment", "attention required", "access denied", "blocked", "captcha", "verify you are human")
CHALLENGE_SELECTORS = ("#challenge-running", "#cf-challenge-running", "#px-captcha", "#ddos-protection", "#waf-challenge-html", ".cf-browser-verification")

# -- fixed values: where a page's content is, in this order.
CONTENT_SELECTORS = ("main", "article", "[role='main']", "#content", ".content", ".main", ".post", ".article", ".entry-content", ".post-content")
READABLE_WORDS, LINKED_WORDS, PREVIEW_WORDS = 50, 50, 10

# -- fixed values: parts of error messages (lower-cased).
NON_RETRYABLE_PARTS = ("403", "captcha", "bot protection", "bot detected")
TRANSIENT_PARTS = ("429", "timed out")

# -- fixed values: error kinds and how each is shown; {} is its message.
ERRORS = {
    "http": "HTTP request failed: {}",
    "url": "Invalid URL: {}",
    "json": "JSON error: {}",
    "search": "Search failed: {}",
    "fetch": "Failed to fetch page: {}",
    "arguments": "Invalid arguments: {}",
    "server": "Server error: {}",
    "io": "IO error: {}",
    "extraction": "Content extraction failed: {}",
    "unsupported": "Unsupported content type: {}",
    "rate_limit": "Rate limit exceeded, please try again later",
    "bot": "Bot protection detected on target page",
    "timeout": "Operation timed out",
}

# -- fixed values: safe search levels and the code a request carries.
SAFE_SEARCH = {"OFF": -2, "MODERATE": -1, "STRICT": 1}

# -- fixed values: content types of bodies that are not text.
BINARY_PREFIXES = ("image/", "video/", "audio/", "application/vnd.openxmlformats-")
BINARY_EXACT = ("application/zip", "application/gzip", "application/x-tar", "application/octet-stream", "application/vnd.ms-excel")
MAX_BODY = 10 * 1024 * 1024
MAX_LINKS = 50

# -- fixed values: content types and the bytes that tell them, as (offset, hexadecimal); all of a row's have to be there, the
# first row counts.
SIGNATURES = (
    ("application/pdf", ((0, "25504446"),)),
    ("image/jpeg", ((0, "FFD8FF"),)),
    ("image/png", ((0, "89504E470D0A1A0A"),)),
    ("image/gif", ((0, "47494638"),)),
    ("image/webp", ((0, "52494646"), (8, "57454250"))),
    ("image/tiff", ((0, "49492A00"),)),
    ("image/bmp", ((0, "424D"),)),
    ("image/vnd.microsoft.icon", ((0, "00000100"),)),
    ("image/avif", ((4, "6674797061766966"),)),
    ("image/heif", ((4, "6674797068656963"),)),
    ("audio/m4a", ((4, "667479704D3441"),)),
    ("video/quicktime", ((4, "6674797071742020"),)),
    ("video/mp4", ((4, "66747970"),)),
    ("audio/x-wav", ((0, "52494646"), (8, "57415645"))),
    ("video/x-msvideo", ((0, "52494646"), (8, "415649"))),
    ("audio/mpeg", ((0, "494433"),)),
    ("audio/ogg", ((0, "4F676753"),)),
    ("audio/x-flac", ((0, "664C6143"),)),
    ("audio/midi", ((0, "4D546864"),)),
    ("video/webm", ((0, "1A45DFA3"), (24, "7765626D"))),
    ("video/x-matroska", ((0, "1A45DFA3"),)),
    ("video/x-flv", ((0, "464C5601"),)),
    ("application/epub+zip", ((0, "504B0304"), (30, "6D696D65747970656170706C69636174696F6E2F657075622B7A6970"))),
    ("application/vnd.oasis.opendocument.text", ((0, "504B0304"), (30, "6D696D65747970656170706C69636174696F6E2F766E642E6F617369732E6F70656E646F63756D656E742E74657874"))),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ((0, "504B0304"), (30, "776F72642F"))),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ((0, "504B0304"), (30, "786C2F"))),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", ((0, "504B0304"), (30, "7070742F"))),
    ("application/zip", ((0, "504B0304"),)),
    ("application/gzip", ((0, "1F8B08"),)),
    ("application/x-bzip2", ((0, "425A68"),)),
    ("application/x-xz", ((0, "FD377A585A00"),)),
    ("application/zstd", ((0, "28B52FFD"),)),
    ("application/x-7z-compressed", ((0, "377ABCAF271C"),)),
    ("application/vnd.rar", ((0, "526172211A07"),)),
    ("application/x-tar", ((257, "7573746172"),)),
    ("application/vnd.sqlite3", ((0, "53514C69746520666F726D6174203300"),)),
    ("application/wasm", ((0, "0061736D"),)),
    ("font/woff2", ((0, "774F4632"),)),
    ("font/woff", ((0, "774F4646"),)),
    ("application/msword", ((0, "D0CF11E0A1B11AE1"),)),
)
#: Frames of MPEG audio begin with eleven ones, the layer and a bit for a checksum.
MPEG_FRAMES = ("FFFB", "FFF3", "FFF2", "FFFA")

# -- fixed values: where a site's map may be, in this order.
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml")
MAX_PAGES, MAX_CONCURRENCY, DEFAULT_PAGES = 500, 16, 25

# -- fixed values: sources in their order: name, whether a key is needed, limiter class.
SOURCES = (
    ("serper", True, "api"),
    ("tavily", True, "api"),
    ("bing", False, "scraper"),
    ("wikipedia", False, "knowledge"),
    ("stackoverflow", False, "knowledge"),
    ("github", False, "knowledge"),
    ("wiby", False, "knowledge"),
    ("ddg-instant", False, "knowledge"),
    ("duckduckgo", False, "scraper"),
)

# -- fixed values: limits of state. Times in microseconds.
BREAKER_FAILURES, BREAKER_COOLDOWN = 3, 30_000_000
LIMITERS = {"scraper": (2_000_000, 3), "api": (500_000, 2), "knowledge": (500_000, 2), "global": (167_000, 6)}
CACHE_TTL, CACHE_ENTRIES = 300_000_000, 1000
SPARSE_ROWS, SPARSE_BYTES, SNIPPET = 3, 100, 300
BATCH = 5

# -- fixed values: request codes.
PARSE_ERROR, NO_METHOD, BAD_PARAMS = -32700, -32601, -32602
PROTOCOL = "2024-11-05"
