"""Fixed values.

Everything in this file is a constant whose value decides a result: word lists,
lookup tables, thresholds and patterns.  They are defaults; every operator takes
its pack or configuration as an argument.  Patterns use ``\\b`` in the ASCII
sense, see :func:`signalloom.functions.regex.ascii_regex`.
"""

# --- fixed values: urls and markup -------------------------------------------
TRACKING_PREFIXES = ["utm_", "fbclid", "gclid", "ref_src", "mc_", "igshid"]
TRACKING_KEYS = ["ref", "oc"]
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "rsquo": "'",
    "lsquo": "'", "rdquo": '"', "ldquo": '"', "ndash": "-", "mdash": "-", "hellip": "...",
}
NUMERIC_ENTITIES = {
    "8217": "'", "8216": "'", "8220": '"', "8221": '"', "8211": "-", "8212": "-",
}

# --- fixed values: names and tokens ------------------------------------------
NAME_TLDS = ["com", "in", "ai", "io", "co", "app", "tech"]
NAME_SUFFIXES = [
    "private limited", r"pvt\.? ltd\.?", "pvt", r"ltd\.?", "limited", "llp", r"inc\.?",
    r"corp\.?", "corporation", r"co\.", "company", "technologies", "technology", "tech",
    "labs?", "solutions", "software", "systems", "ventures", "india", "global", "group",
    "holdings", "the",
]
ITEM_STOPWORDS = (
    "a an the and or of to in on for with by from at as is are was were be its it this that "
    "new india indian startup startups raises raised funding"
).split()
STORY_STOPWORDS = (
    "the a an of to in on for and or with by from at as is are be its it this that rbi india "
    "indian says said new over into after amid via payment payments cross border global export "
    "exports dgft extends launches launch bank banks system systems more how why what"
).split()

# --- fixed values: money -----------------------------------------------------
INR_PER_USD = 85.0
MONEY_WITH_SYMBOL = (
    r"(US\$|USD|\$|₹|INR|Rs\.?)\s?(\d+(?:\.\d+)?)\s?"
    r"(mn|million|m\b|cr\b|crore|crores|bn|billion|b\b|lakh|lakhs|k\b|thousand)?"
)
MONEY_BY_UNIT = (
    r"(\d+(?:\.\d+)?)\s?(mn|million|cr|crore|crores|bn|billion|lakh|lakhs)\s?"
    r"(dollars|usd|rupees|inr)?"
)
MONEY_MENTION = (
    r"(?:US\$|USD|\$|₹|INR|Rs\.?)\s?[\d.,]+\s?(?:mn|million|m\b|cr\b|crore|bn|billion|b\b|lakh|k\b)?"
)
MONEY_NOT_AFTER = [r"\bat", "valuation of", "valued at", "revenue of", "turnover of", "revenue to", "worth"]
MONEY_NOT_BEFORE = ["valuation", "valued"]
MONEY_WINDOW_AFTER = 18
MONEY_MIN_USD_M = 0.005
MONEY_MAX_USD_M = 20000.0

# --- fixed values: funding stages --------------------------------------------
STAGE_PATTERN = (
    r"\b(pre-seed|pre seed|angel|seed|pre-series [a-e]|series [a-f]|bridge|debt|pre-ipo|grant)\b"
)
STAGE_LABELS = {
    "pre-seed": "Pre-Seed", "pre seed": "Pre-Seed", "angel": "Angel", "seed": "Seed",
    "bridge": "Bridge", "debt": "Debt", "pre-ipo": "Pre-IPO", "grant": "Grant",
}
LATE_STAGE_PATTERN = r"series [d-z]|pre-ipo|ipo"
STAGE_TEAM = {
    "Pre-Seed": (2, 15), "Angel": (2, 15), "Seed": (5, 40), "Pre-Series A": (10, 50),
    "Series A": (20, 120), "Pre-Series B": (40, 200), "Series B": (60, 300),
    "Series C": (150, 800), "Series D": (300, 2000),
}

# --- fixed values: score model -----------------------------------------------
WEIGHTS = {
    "funding": 24, "international": 26, "sector": 12, "paymentStack": 10, "pain": 10,
    "momentum": 8, "corroboration": 5, "novelty": 5,
}
PENALTIES = {"enterprise": -18, "notInRegion": -40, "negativeKeyword": -10, "lateStage": -4}
PREFERRED_STAGES = ["Pre-Seed", "Angel", "Seed", "Pre-Series A", "Series A", "Pre-Series B", "Series B"]
OK_STAGES = ["Series C", "Bridge", "Debt", "Grant"]
TICKET_RANGE_USD_M = (0.2, 40.0)
HALF_LIFE_DAYS = 30.0
THRESHOLD = 55
SECTOR_WEIGHTS = {
    "SaaS": 1.0, "AI": 0.95, "IT Services": 0.9, "D2C": 1.0, "Exporter": 1.0, "Manufacturing": 0.85,
    "Edtech": 0.85, "Travel": 0.85, "Agency": 0.8, "Freelancer": 0.75, "Marketplace": 0.75,
    "Gaming": 0.75, "Media": 0.6, "Healthtech": 0.6, "Logistics": 0.6, "Fintech": 0.3, "Other": 0.4,
}
SECTOR_FALLBACK = 0.4
SELLS_ABROAD_BASE = {"yes": 0.7, "likely": 0.45, "unknown": 0.1, "no": 0.0}
SELLS_ABROAD_RANK = {"no": 0, "unknown": 1, "likely": 2, "yes": 3}
MOMENTUM_TYPES = ["expansion", "launch", "export", "hiring", "partnership", "acquisition"]
POSITIVE_KEYWORDS = [
    "global", "international", "export", "exports", "overseas", "cross-border", "multi-currency",
    "US market", "UK market", "UAE", "Middle East", "GCC", "Europe", "Southeast Asia", "Australia",
    "Africa", "Amazon Global", "Etsy", "Shopify", "international customers", "global customers",
    "worldwide", "diaspora", "NRI", "USD revenue", "foreign clients", "expand abroad", "D2C exports",
]
NEGATIVE_KEYWORDS = [
    "layoffs", "shuts down", "shutdown", "insolvency", "bankruptcy", "fraud", "raid", "winds up",
]
CROSS_BORDER_PROVIDERS = [
    "skydo", "xflow", "payoneer", "paypal", "stripe", "wise", "airwallex", "briskpe", "paddle",
    "lemonsqueezy",
]
DOMESTIC_PROVIDERS = [
    "razorpay", "cashfree", "payu", "ccavenue", "instamojo", "easebuzz", "phonepe",
]
COMPETITORS = [
    "Skydo", "Xflow", "Razorpay", "Cashfree", "PayPal", "Stripe", "Payoneer", "Wise", "PayU",
    "CCAvenue", "Briskpe", "Airwallex",
]
ENTERPRISE_NAMES = [
    "Reliance", "Tata", "Infosys", "Wipro", "HCL", "TCS", "Adani", "Mahindra", "Flipkart", "Paytm",
    "Zomato", "Swiggy", "Ola", "Byju", "Bharti", "Airtel", "Jio", "HDFC", "ICICI", "SBI", "Axis",
    "Kotak", "Bajaj", "Birla", "Vedanta", "ITC", "Hindustan Unilever", "Larsen", "L&T", "Nykaa",
    "PhonePe", "Meesho", "Zepto", "Eternal",
]
NAME_BLOCKLIST = [
    "Inc42", "YourStory", "Entrackr", "TechCrunch", "Economic Times", "Moneycontrol", "Mint",
    "Reuters", "Bloomberg", "Peak XV", "Sequoia", "Accel", "Blume", "Blume Ventures", "Nexus",
    "Elevation", "Lightspeed", "Matrix Partners", "Kalaari", "Chiratae", "Stellaris", "3one4",
    "Info Edge", "Tiger Global", "SoftBank", "Y Combinator", "RBI", "SEBI", "DGFT", "Government",
    "Centre", "India", "Startup", "Startups", "Google", "Microsoft", "Amazon", "Meta", "Apple",
    "OpenAI",
]

# --- fixed values: people and teams ------------------------------------------
TEAM_SOURCE_RANK = {
    "manual": 6, "apollo": 5, "sprouts": 5, "yc": 5, "website": 4, "article": 3, "news": 3, "stage": 1,
}
TEAM_BANDS = [(10, "1-10"), (50, "11-50"), (200, "51-200"), (1000, "201-1000")]
TEAM_BAND_TOP = "1000+"
ROLE_BUCKETS = {
    "founder": r"founder|owner|promoter",
    "ceo": r"\bceo\b|chief executive|managing director|\bmd\b",
    "md": r"managing director|\bmd\b|whole-?time director|chairman",
    "cto": r"\bcto\b|chief technology|vp,? engineering|head of (engineering|technology|tech)\b",
    "cfo": r"\bcfo\b|chief financial",
    "finance": r"financ|controller|treasur|accounts",
    "payments": r"payments?\b",
    "coo": r"\bcoo\b|chief operating|operations",
    "ecommerce": r"e-?commerce|growth|digital|marketing|\bcmo\b",
    "director": r"director",
}
ROLE_BUCKET_LABELS = {
    "founder": "Founder", "ceo": "CEO", "md": "Managing Director", "cto": "CTO", "cfo": "CFO",
    "finance": "Head of Finance", "payments": "Head of Payments", "coo": "COO",
    "ecommerce": "Head of E-commerce/Growth", "director": "Director",
}
# Domains tried for a company: what stands before, which form of the name, what stands behind.
DOMAIN_SHAPES = [
    ("", "slug", ".com"), ("", "slug", ".in"), ("", "slug", ".ai"), ("", "slug", ".io"),
    ("", "core", ".com"), ("get", "slug", ".com"), ("", "slug", ".co"), ("", "slug", ".co.in"),
]
SMALL_TEAM_MAX = 50
MID_TEAM_MAX = 200
TECH_SECTORS = ["SaaS", "AI", "IT Services", "Gaming"]
OWNER_LED_SECTORS = ["Exporter", "Manufacturing"]
COMMERCE_SECTORS = ["D2C", "Marketplace"]
NAMED_LEADER_PATTERN = r"\b(cfo|chief financial|vice president|\bvp\b|head of finance)\b"
NAMED_LEADER_MIN = 5

# --- fixed values: posts -----------------------------------------------------
VOICE_POINTS = {
    "seeking": 25, "business": 20, "problem": 20, "abroad": 15, "unhappy": 10, "urgent": 10,
}
VOICE_STALE_DAYS = 21
VOICE_STALE_POINTS = -10
VOICE_BANDS = [(80, "high"), (50, "research"), (0, "monitor")]

# --- fixed values: windows and limits ----------------------------------------
MAX_ITEM_AGE_DAYS = 45
MIN_CONFIDENCE = 0.3
TITLE_JACCARD = 0.75
TITLE_MIN_TOKENS = 4
TWIN_JACCARD = 0.45
TWIN_DAYS = 30
TWIN_DIRECTORY_DAYS = 3650
TWIN_MEMORY = 10
TWIN_AMOUNT_TOLERANCE = 0.2
STORY_DAYS = 7
STORY_OVERLAP = 0.6
STORY_SHARED = 4
STORY_SHARED_SAME_TOPIC = 2
FUZZY_NAME_SCORE = 0.94
FUZZY_NAME_MIN_LENGTH = 5
BRIEF_SIZE = 25
BRIEF_EXPLORATION = 0.2
BRIEF_CANDIDATES = 400
BRIEF_MIN_SCORE = 20
LEARN_STEP = 0.04
LEARN_BOUND = 0.25
QUERY_TTL_DAYS = 4
ENRICH_MIN_SCORE = 40
ENRICH_PER_CYCLE = 4
