"""Word lists, lookup tables, patterns, thresholds and message texts.

These have to be exactly these values for results to be right, so they are stated
plainly here and nowhere else.
"""

# --- fixed values: source ids -------------------------------------------------
SHOPPING = "serper_shopping"
MARKETPLACE = "ebay_search"
TASKS = "amazon_dataforseo"
UNIVERSAL = "universal_ai_search"
STOREFRONT = "nemixram_storefront"
PAGE_SELLERS = {"memstore_ebay": "mem-store", "cloudstoragecorp_ebay": "cloudstoragecorp"}

MARKETPLACE_LABELS = {"ebay_search": "ebay", "amazon_dataforseo": "amazon"}
UNKNOWN_VENDOR = "(unknown vendor)"

# --- fixed values: display limits of a profile that states none ------------------
MAX_LISTINGS = 20
PER_VENDOR_CAP = 3

# --- fixed values: allow-lists ------------------------------------------------
KNOWN_SOURCES = [
    "ebay_search", "nemixram_storefront", "cloudstoragecorp_ebay", "memstore_ebay",
    "newegg_search", "serversupply_search", "memorynet_search", "theserverstore_storefront",
]
KNOWN_FILTER_RULES = [
    "form_factor_in", "speed_mts_min", "ecc_required", "voltage_eq", "min_quantity_for_target",
    "in_stock", "single_sku_url", "title_excludes", "condition_in",
]
KNOWN_FLAG_RULES = [
    "ship_from_country_in", "brand_in", "low_seller_feedback", "kingston_e_suffix",
    "title_mentions_other_server", "title_mentions",
]
REPORT_COLUMNS = [
    "rank", "source", "title", "pack_size", "price", "price_pack", "price_unit", "total_for_target",
    "qty", "condition", "brand", "mpn", "seller", "seller_rating", "ship_from", "qvl_status",
    "flags", "flavor",
]
DEFAULT_REPORT_COLUMNS = ["rank", "source", "title", "price", "total_for_target", "qty", "seller", "flags"]
REPORT_HEADERS = {
    "rank": "Rank", "source": "Source", "title": "Title", "pack_size": "Pack size", "price": "Price",
    "price_pack": "Price (pack)", "price_unit": "Price (unit)", "total_for_target": "Total for target",
    "qty": "Qty", "condition": "Condition", "brand": "Brand", "mpn": "MPN", "seller": "Seller",
    "seller_rating": "Seller rating", "ship_from": "Ships from", "qvl_status": "QVL", "flags": "Flags",
    "flavor": "Flavor",
}
CONDITIONS = ["new", "used", "refurbished"]
ALERT_MODES = ["drops_below", "is_below", "while_below"]
PRICE_BASES = ["unit", "total"]
AMAZON_PRIORITIES = ["standard", "live"]

# --- fixed values: display column defaults per product type --------------------
GENERIC_COLUMNS = ["price", "condition", "seller", "seller_rating"]
TYPE_COLUMNS = {
    "drone": ["price", "condition", "seller", "seller_rating", "rating"],
    "electronics": ["price", "condition", "seller", "seller_rating", "rating"],
    "subscription": ["price", "term", "seller"],
    "book": ["price", "condition", "seller", "rating"],
    "grocery": ["price", "seller", "quantity"],
}

# --- fixed values: thresholds ---------------------------------------------------
MAD_K = 3.5
LOW_RATIO = 0.5
HIGH_RATIO = 3.0
MIN_PRICED = 4
FLAG_LOW = "price_anomaly_low"
FLAG_HIGH = "price_anomaly_high"
PRICE_CHANGE = 0.05
REPORT_CAP = 30
RESERVED_PER_SOURCE = 3
JUDGE_BATCH = 50
CONTEXT_WORDS = 200
TICK_MINUTES = 15
SAME_RUN_SECONDS = 600
MAX_RUN_SECONDS = 1800
BODY_FULL = 50_000
BODY_THIN = 15_000
TRIAL_COVERAGE = 0.8
VENDOR_GATE = 3
KEEP_HEAD_TURNS = 1
KEEP_TAIL_TURNS = 4
TASK_OK = 20000
TASK_ITEM_TYPES = ["amazon_serp", "amazon_paid"]

# --- fixed values: text patterns ------------------------------------------------
PRICE_RE = r"[-+]?\d[\d,]*\.?\d*"
KIT_RE = (
    r"(?i)\b(\d+)\s*x\s*(\d+)\s*gb\b"
    r"|\b(\d+)(?:\s*[-–]|\s+)(?:pack|count)\b"
    r"|\bkit\s+of\s+(\d+)\b"
    r"|\b(\d+)\s*pcs?\b"
)
CAPACITY_RE = r"(?i)\b(\d+)\s*GB\b"
SPEED_PC5_RE = r"(?i)PC5-(\d{4,5})R?\b"
SPEED_DDR5_RE = r"(?i)DDR5[-\s](\d{4,5})\b"
SPEED_BARE_UNIT_RE = r"(?i)\b(4800|5200|5600|6000|6400)(?:MHz|\s*MT)?\b"
SPEED_BARE_RE = r"\b(4800|5200|5600|6000|6400)\b"
SEARCH_URL_RE = r"search\?|sch\?|/sch/"
NUMBER_RE = r"\d+(?:\.\d+)?|\.\d+"
CONDITION_PHRASE_RE = (
    r"(?i)\b(new[\s-]*only|only\s+new|brand[\s-]*new|must\s+be\s+new|new\s+condition|no\s+used|not?\s+used"
    r"|no\s+refurb|no\s+open[\s-]*box|no\s+renewed|no\s+pre[\s-]*owned|condition\s*[:=]\s*new)\b"
)
COVERING_EXCLUDE_RE = r"(?i)\b(used|refurb|open[\s-]*box|renewed|pre[\s-]*owned)\b"
FOR_PARTS_RE = r"(?i)\bfor parts\b"
REPLACEMENT_RE = r"(?i)replacement for|compatible"
ASIN_URL_RE = r"/(?:dp|gp/product|gp/aw/d)/([A-Za-z0-9]{10})(?:[/?#]|$)"
REG_URL_RE = r"(?i)/(\d{6,})-(?:REG|USED|GRY|BB)\b"
SLUG_RE = r"^[a-z0-9][a-z0-9-]{0,63}$"
HOST_RE = r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$"
CRON_FIELD_RE = r"^[0-9*/,\-]+$"
RUN_FILE_RE = r"^(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z)\.csv$"
NAME_STOP_WORDS = [
    "the", "and", "for", "with", "new", "set", "kit", "pack", "pair",
    "lot", "box", "qty", "pcs", "item", "items", "product", "products",
]

# --- fixed values: merchant fragment -> host -------------------------------------
MERCHANT_HOSTS = [
    ("ebay", "ebay.com"), ("amazon", "amazon.com"), ("walmart", "walmart.com"),
    ("newegg", "newegg.com"), ("bhphoto", "bhphotovideo.com"),
]
SEARCH_URL_TEMPLATES = {
    "abebooks.com": "https://www.abebooks.com/servlet/SearchResults?kn={q}&sortby=17",
    "alibris.com": "https://www.alibris.com/booksearch?keyword={q}",
    "amazon.com": "https://www.amazon.com/s?k={q}",
    "backmarket.com": "https://www.backmarket.com/en-us/search?q={q}",
    "betterworldbooks.com": "https://www.betterworldbooks.com/search/results?query={q}",
    "biblio.com": "https://www.biblio.com/search.php?title={q}&author=&stage=1",
    "microcenter.com": "https://www.microcenter.com/search/search_results.aspx?Ntt={q}",
    "newegg.com": "https://www.newegg.com/p/pl?d={q}",
    "target.com": "https://www.target.com/s?searchTerm={q}",
    "thriftbooks.com": "https://www.thriftbooks.com/browse/?b.search={q}#b.s=price-asc&b.p=1&b.pp=50&b.oos",
    "walmart.com": "https://www.walmart.com/search?q={q}",
}
HOST_ALIASES = {
    "amazon.com": ["amazon"],
    "backmarket.com": ["backmarket", "back market"],
    "bestbuy.com": ["bestbuy", "best buy"],
    "bhphotovideo.com": ["bhphotovideo", "b&h", "b & h", "b and h"],
    "newegg.com": ["newegg"],
    "target.com": ["target"],
    "walmart.com": ["walmart"],
    "williams-sonoma.com": ["williams-sonoma", "williams sonoma"],
}
STABLE_PRODUCT_URL = "https://shopping.google.com/product/"

# --- fixed values: flag labels and descriptions ----------------------------------
FLAG_LABELS = {
    "low_feedback": ("Limited reviews", "info"),
    "low_seller_feedback": ("Limited reviews", "info"),
    "unknown_quantity": ("Quantity unknown", "info"),
    "digital_only": ("Digital only", "info"),
    "china_shipping": ("Ships from China/HK", "warning"),
    "smart_memory": ("OEM SmartMemory", "warning"),
    "kingston_e_suffix": ("Kingston E-suffix (likely UDIMM)", "warning"),
    "compatible_with_other_server": ("For a different server", "warning"),
    "generic_brand": ("Generic brand", "warning"),
    "similar_bose_model": ("Different Bose model", "warning"),
    "suspicious_listing": ("Suspicious listing", "danger"),
}
SEVERITIES = ["info", "warning", "danger"]
FLAG_DESCRIPTIONS = {
    "unknown_quantity": "The listing did not declare a quantity-available count.",
    "low_seller_feedback": "Seller's feedback rating or count is below the profile threshold.",
    "china_shipping": "Listing ships from China or Hong Kong.",
    "smart_memory": "OEM-branded SmartMemory; may not POST on third-party boards.",
    "kingston_e_suffix": "Kingston part number ends in 'E' (likely UDIMM, not RDIMM).",
    "compatible_with_other_server": "Title mentions a different server platform than the profile target.",
    "generic_brand": "Generic or aftermarket brand.",
    "suspicious_listing": "Title language suggests an as-is, untested, or for-parts listing.",
    "similar_bose_model": "Title mentions a similar but different Bose model than the target.",
}

# --- fixed values: model prices, USD per million tokens (input, output) ------------
MODEL_PRICES = {
    ("anthropic", "claude-opus-4-7"): (15.0, 75.0),
    ("anthropic", "claude-sonnet-4-6"): (3.0, 15.0),
    ("anthropic", "claude-haiku-4-5"): (1.0, 5.0),
    ("anthropic", "claude-haiku-4-5-20251001"): (1.0, 5.0),
    ("glm", "glm-4.5-flash"): (0.05, 0.05),
    ("glm", "glm-4.6"): (0.6, 2.2),
    ("glm", "glm-5.1"): (2.0, 8.0),
    ("openai", "gpt-4o-mini"): (0.15, 0.60),
    ("gemini", "gemini-2.0-flash"): (0.10, 0.40),
}
CACHE_WRITE_RATE = 1.25
CACHE_READ_RATE = 0.10

# --- fixed values: fixed schedules -------------------------------------------------
FIXED_CRONS = {
    "*/15 * * * *": "Every 15 minutes",
    "*/30 * * * *": "Every 30 minutes",
    "0 * * * *": "Every hour",
    "0 */6 * * *": "Every 6 hours",
    "0 */12 * * *": "Every 12 hours",
}
WEEKDAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]

# --- fixed values: run outcome texts -------------------------------------------------
OUTCOME_MESSAGES = {
    "ok": "",
    "index_unavailable":
        "Couldn't reach the shopping index this run; the next scheduled run retries automatically.",
    "no_recall":
        "No offers found — the query may be too specific, or this item isn't sold online. Edit the search query.",
    "filter_unavailable":
        "Found offers but the relevance filter couldn't run, so none could be judged. This is a backend problem, "
        "not your profile — the next scheduled run retries automatically. See the filter diagnostics.",
    "all_filtered":
        "Found offers but none matched your spec — your match/filters may be too strict, or the query is "
        "mis-scoped. See the filter diagnostics.",
}
NOTE_MESSAGES = {
    "ebay_unavailable": "eBay was unavailable this run; other sources still ran.",
    "amazon_unavailable": "Amazon was unavailable this run; other sources still ran.",
    "degraded_attr":
        "Stock count isn't available from the shopping index; showing offers without quantity verification.",
}

# --- fixed values: source outcome labels and texts (format strings) --------------------
SOURCE_LABELS = {
    "ok": "ok", "no_match": "no match", "empty_page": "no results", "parser_gap": "needs work",
    "transient": "transient", "permanent": "blocked", "watched": "watched",
}
LABEL_MIS_SCOPED = "NO_MATCH (Mis-scoped URL; %s listings rejected by filter)"
LABEL_NOT_CARRIED = "NO_MATCH (Vendor doesn't carry)"
WATCH_PREFIX = "watch-gate:"
SOURCE_TEXTS = {
    "mis_scoped":
        "Found %s %s but none matched what you're tracking — this source's search URL may be mis-scoped "
        "(returning unrelated products). **What to do:** open **Edit Profile** and check or replace the search "
        "URL for this vendor. The AI filter diagnostic below lists the specific rejections.",
    "no_match":
        "Found %s %s but none met your search criteria (price, condition, or keyword filters). **What to do:** "
        "nothing, unless you expected matches here — if so, open **Edit Profile** and loosen the relevant filter "
        "(price cap, condition, keywords). The AI filter diagnostic below lists the specific rejections.",
    "watched":
        "We checked this vendor and your product isn't listed there yet, so we skipped the paid extraction step "
        "— this source cost about $0 this run. **What to do:** nothing — every scheduled run re-checks this "
        "vendor and will pull listings automatically the moment it stocks the product.",
    "blocked":
        "This vendor is blocked — an anti-bot wall we have no working path through right now — so re-running "
        "won't help. **What to do:** nothing in the app recovers this; getting it working needs deeper scraper "
        "changes and isn't guaranteed.",
    "quota":
        "The scraping API returned a quota or authentication error, so no vendor could be fetched until the "
        "account is fixed. **What to do:** check your AlterLab / eBay dashboard limits, then run again.",
    "skipped":
        "Skipped this run because AlterLab was failing on earlier sources (%s). **What to do:** run this product "
        "again once AlterLab recovers — the next scheduled run also retries automatically.",
    "pool":
        "AlterLab's browser pool was briefly exhausted — a temporary capacity issue at the scraping provider. "
        "**What to do:** run this product again in a few minutes; it usually clears on its own and the next "
        "scheduled run retries automatically.",
    "degraded":
        "AlterLab couldn't render this vendor's page this time, so nothing could be extracted. **What to do:** "
        "run this product again — this is usually temporary and the next scheduled run retries automatically.",
    "fetch_error":
        "Fetch error — usually temporary. **What to do:** run this product again. Details: %s",
    "parser_gap":
        "Fetched a full page (%,d chars) but couldn't read any product listings off it — the page rendered, but "
        "our reader didn't recognise this vendor's layout (not a true empty result). **What to do:** open **Edit "
        "Profile** and add the vendor's product-page (detail) URL — that path extracts more reliably. If that "
        "also returns nothing, it needs a scraper fix (re-running won't help).",
    "thin":
        "The vendor's page returned an unusually small body (%,d chars) with no products — most likely a 404 "
        "stub, bot-block, or wrong URL, not proof the product isn't sold there. **What to do:** open **Edit "
        "Profile** and check the search URL; re-running may also help if this was a transient block.",
    "not_carried":
        "The vendor's page loaded but the extractor found no products — most likely it genuinely has nothing "
        "right now, so re-running won't change anything. **What to do:** if you expected results, open **Edit "
        "Profile** and check the search URL / keywords.",
    "empty":
        "The vendor's page loaded but had no matching products — most likely it genuinely has nothing right now, "
        "so re-running won't change anything. **What to do:** if you expected results, open **Edit Profile** and "
        "check the search URL / keywords, or ask the onboarder to re-probe it if you think it timed out during "
        "onboarding; otherwise nothing — scheduled runs will catch it when the vendor lists a match.",
}
