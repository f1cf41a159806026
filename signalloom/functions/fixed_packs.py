"""Default rule packs.

Vocabulary tables whose wording decides results.  Every operator takes its pack
as an argument; these are the defaults.  Patterns are case-insensitive and use
``\\b`` in the ASCII sense.
"""

# --- fixed values: item gate -------------------------------------------------
GATE_RULES = {
    "region": r"\b(india|indian|bharat|bengaluru|bangalore|mumbai|delhi|ncr|gurugram|gurgaon|noida|pune|hyderabad|chennai|kolkata|ahmedabad|jaipur|surat|kochi|chandigarh|indore|coimbatore|lucknow|tiruppur|ludhiana|moradabad|kanpur|vadodara|nagpur|bhubaneswar|visakhapatnam|mysuru|mangaluru|thiruvananthapuram)\b|₹|\b(crore|lakh)s?\b|\brs\.?\s?\d|\binr\b",
    "funding": r"\b(raises?|raised|raising|secures?|secured|bags?|bagged|lands?|nets?|mops? up|closes?|funding|funded|seed|pre-seed|angel round|series [a-f]|pre-series|investment|invests?|backed|led by|valuation|debt round|bridge round)\b",
    "expansion": r"\b(expands?|expanding|expansion|enters?|entry into|forays?|launch(es|ed)? in|global|globally|international|overseas|abroad|export(s|er|ers|ing)?|us market|uk market|united states|america|uae|dubai|saudi|middle east|gcc|europe|germany|singapore|southeast asia|australia|africa|cross-border|worldwide|diaspora|nri)\b",
    "launch": r"\b(launch(es|ed)?|unveils?|introduces?|rolls out|partners? with|partnership|acquires?|acquisition|opens? (office|store)|hiring|hires)\b",
    "pain": r"\b(stripe|paypal|payoneer|wise\.com|skydo|xflow|razorpay|cashfree|international payments?|receive payments?|foreign clients?|clients abroad|usd payments?|firc|fira|ebrc|e-brc|lut|export of services|swift|forex|wire transfer|chargebacks?|payment gateway|merchant account|international cards?|gst on exports?|invoic(e|ing) (us|foreign|international))\b",
    "regulatory": r"\b(rbi|reserve bank|payment aggregator|pa-cb|cross[- ]border|fema|dgft|foreign trade policy|export|import|forex|lrs|remittance|kyc|aml|psp|payments? system|upi|rupee|data localisation|dpdp|tariff|trade deal|fta|edpms)\b",
    "competitor": r"\b(skydo|xflow|briskpe|razorpay|cashfree|paypal|stripe|payoneer|wise|airwallex|payu|ccavenue|juspay|easebuzz|infibeam)\b",
    "noise": r"\b(sensex|nifty|share price|stock(s)? (to buy|rally|fall)|q[1-4] (results|earnings)|quarterly results|ipo (gmp|subscription|allotment)|horoscope|cricket|bollywood|box office|recipe|weather|election|monsoon)\b",
}
REGION_ASSUMED_SOURCES = r"^(inc42|entrackr|yourstory|et-startups)"

# --- fixed values: sectors and markets ---------------------------------------
SECTORS = {
    "Edtech": r"\b(edtech|education|learning|upskill|test prep|students?|tutor|school|university|coaching)\b",
    "Travel": r"\b(travel|tourism|hotels?|hospitality|trips?|visa|flights?|holiday|traveltech)\b",
    "Healthtech": r"\b(health|healthtech|medtech|clinic|pharma|diagnostic|hospital|medical|wellness)\b",
    "Fintech": r"\b(fintech|lending|nbfc|insurtech|wealth|neobank|credit|loans?|payments? (app|startup|platform)|stock broking|trading app)\b",
    "Gaming": r"\b(gaming|game studio|games?|esports)\b",
    "D2C": r"\b(d2c|direct-to-consumer|consumer brand|apparel|fashion|beauty|skincare|personal care|jewell?ery|footwear|snacks?|beverages?|home decor|furniture|ethnic wear|ayurved|nutrition|pet food|coffee|tea brand)\b",
    "Exporter": r"\b(exporters?|exports? (of|to)|export house|handicrafts?|textiles?|garments?|spices|seafood|carpets?|leather goods|gems?)\b",
    "SaaS": r"\b(saas|b2b software|software platform|crm|erp|api|devtools?|developer tools?|cloud|platform for (businesses|enterprises)|enterprise software|workflow|cybersecurity|security platform|observability|analytics platform)\b",
    "Manufacturing": r"\b(manufactur\w*|factory|industrial|electronics|semiconductors?|ev|electric vehicles?|drones?|aerospace|defence|robotics|hardware|chemicals?)\b",
    "Logistics": r"\b(logistics|shipping|supply chain|freight|warehous\w*|last-mile|cargo)\b",
    "Agency": r"\b(agency|marketing services|design studio|creative studio|consultancy|outsourcing|bpo|kpo|staffing)\b",
    "IT Services": r"\b(it services|software services|digital transformation|software development|engineering services|gcc|global capability)\b",
    "Marketplace": r"\b(marketplace|b2b commerce|quick commerce|e-?commerce|social commerce)\b",
    "AI": r"\b(ai|artificial intelligence|genai|gen ai|llms?|machine learning|agents?|agentic)\b",
    "Media": r"\b(media|content|creators?|ott|streaming|publishing|podcast)\b",
}
MARKETS = {
    "US": r"\b(us|u\.s\.|usa|united states|america|american|north america|silicon valley|new york|san francisco)\b",
    "UK": r"\b(uk|u\.k\.|united kingdom|britain|london)\b",
    "UAE": r"\b(uae|dubai|abu dhabi|emirates)\b",
    "Middle East": r"\b(middle east|gcc|saudi|ksa|riyadh|qatar|oman|kuwait|bahrain|mena)\b",
    "Europe": r"\b(europe|european|eu|germany|france|netherlands|spain|italy|nordics?)\b",
    "Southeast Asia": r"\b(southeast asia|sea|singapore|indonesia|malaysia|thailand|vietnam|philippines)\b",
    "Australia": r"\b(australia|new zealand|anz)\b",
    "Africa": r"\b(africa|nigeria|kenya|south africa|egypt)\b",
    "Canada": r"\b(canada|toronto)\b",
    "Japan": r"\b(japan|tokyo)\b",
    "Global": r"\b(global(ly)?|worldwide|international(ly)?|overseas|abroad|cross-border)\b",
}
GLOBAL_MARKET = "Global"
CITIES = [
    "Bengaluru", "Bangalore", "Mumbai", "Delhi", "Gurugram", "Gurgaon", "Noida", "Pune", "Hyderabad",
    "Chennai", "Kolkata", "Ahmedabad", "Jaipur", "Surat", "Kochi", "Chandigarh", "Indore", "Coimbatore",
]

# --- fixed values: headlines -------------------------------------------------
FUNDING_VERBS = "raises|raised|secures|secured|bags|bagged|lands|nets|mops up|picks up|gets|receives|closes|scoops up|garners|snags|grabs|attracts|announces|in talks to raise|to raise|eyes"
FUNDING_VERB_STEMS = "raise|secure|bag|land|net|mop|pick|get|receive|close|scoop|garner|snag|grab|attract"
EXPANSION_VERBS = "expands|expanding|enters|forays into|launches in|launches operations in|sets up|opens|goes global|takes .* global|debuts in|partners with|acquires|launches"
DESCRIPTORS = "startup|start-up|brand|platform|company|firm|maker|player|provider|marketplace|unicorn|soonicorn|fintech|edtech|healthtech|agritech|spacetech|deeptech|cleantech|proptech|insurtech|traveltech|saas|d2c|nbfc|lender|based|backed|owned|bound|operator|manufacturer|exporter|venture|app|unit|subsidiary|arm|major|giant|parent|retailer|chain|studio|label"
LEAD_INS = "exclusive|funding alert|breaking|report|update|just in|funding"
INVESTOR_VERBS = "leads?|invests?|backs?|bets on|pumps|puts|co-leads?|participates"
INVESTOR_TARGETS = "startup|start-up|brand|platform|company|firm|maker|challenger|player|provider"
INVESTOR_CONTEXT = "round|invest|back|crore|mn|million|seed|series"
ROUND_WORDS = "fund|round|invest"
GENERIC_NAME_WORDS = "startups?|companies|firms|brands|investors|government|centre|india|report|week|this|these|how|why|what|here"
ROLE_NAME_WORDS = "co-?founder|founder|ceo|minister|chairman|md|missile|ministry|mutual fund|govt|government"
LISTED_WORDS = r"\b(listed|nse|bse|pre-ipo)\b"
B2B_WORDS = "b2b|saas|developer|enterprise|api|infrastructure"

# What is cut off a headline's first words, in order; True where the cut must leave a name.
HEAD_TRIMS = [
    (rf"(?i)^(?:{LEAD_INS})\s*[:|-]\s*", False),
    (r"^\[[^\]]+\]\s*", False),
    (r"^.*[:|]", False),
    (rf"(?i)^.*\b(?:{DESCRIPTORS})\s+", True),
    (r"['’]s$", False),
    (r"(?i)^(?:the|india's|indian)\s+", False),
    (r"(?i)\s+(?:ipo|group)$", False),
]

# --- fixed values: intel -----------------------------------------------------
INTEL_REGION = r"\b(india|indian|rbi|reserve bank|npci|upi|dgft|sebi|gift (city|ifsc)|ifsca|rupee|inr|bengaluru|mumbai|delhi|piyush goyal|sitharaman|malhotra)\b|\brupees\b|₹"
INTEL_NOISE = [
    r"\b(high court|supreme court|\bhc\b|cestat|tribunal|writ petition|quashed|upholds?|dismisses appeals?)\b",
    r"\b(cbi|raid|custodial|arrest(ed)?|death|probe|fir into)\b",
    r"\b(ironman|marathon|felicitat|award ceremony)\b",
    r"\b(excise|alcohol|liquor|sugar|trq|rice export ban|minimum import price|anti-dumping|safeguard duty|scrap|psias?|gold dore)\b",
    r"\b(denied entity|sebi warns|imposes (monetary )?penalty|penalty on|discloses .* order)\b",
    r"\b(section 35 ?a|co-?operative bank|banking regulation act|amalgamation|cancels (the )?(certificate|licence))\b",
    r"\b(foreign exchange turnover data|money market operations|treasury bills?|auction|weekly statistical|reference rate|ways and means|state government securities)\b",
    r"\b(crypto(currenc(y|ies))?|bitcoin|stablecoins? (ban|caution))\b",
    r"\b(shareholding|listings?|ipo)\b",
]
INTEL_NOISE_EXCEPT = r"statement on developmental"
IMPORT_ONLY = r"\bimports?\b"
IMPORT_EXCEPT = r"\bexport|payment|remittance|forex"
COMPETITOR_STORY = r"\b(pay|payment|cross|launch|fees?|raise|licen|merchant|india|global|international|wallet|checkout|qr)"
COMPETITOR_ACTIONS = {
    "launch": r"\b(launch|introduc|rolls? out|unveil|adds?|links?|enables?)\w*",
    "capital": r"\b(raises?|funding|valuation|acqui)\w*",
    "licence": r"\b(licen[cs]e|approval|authori[sz]ation)\b",
    "pricing": r"\b(fees?|pricing|charges?)\b",
}
_UPI_COUNTRIES = "zimbabwe|uae|uk|france|singapore|nepal|bhutan|sri lanka|mauritius|namibia|peru|trinidad|qatar|oman|cyprus"
# id, category, importance, pattern
TOPICS = [
    ("policy-statement", "regulatory", 3, r"statement on developmental and regulatory policies|monetary policy statement"),
    ("pa-rules", "regulatory", 3, r"payment aggregators?|\bpa-?cb\b|\bpa-?o\b|payment system operators?|master direction.{0,40}payment"),
    ("export-realisation", "regulatory", 3, r"\bfema\b|export (proceeds|realis|realiz)|\bedpms\b|\be-?brc\b|\bfir[ac]s?\b|purpose codes?|inward remittance|softex"),
    ("freelancer-inflows", "regulatory", 3, r"(freelancers?|creators?|individuals?|professionals?).{0,60}(overseas|foreign|abroad|international)|(overseas|foreign) clients?"),
    ("remittance", "regulatory", 2, r"\blrs\b|outward remittance|form a2|remittance (limit|rules|norms)"),
    ("kyc-data", "regulatory", 2, r"\b(kyc|ckyc|video kyc|aml|anti-money laundering|dpdp|data localisation|data protection)\b"),
    ("export-incentives", "regulatory", 2, r"\b(rodtep|rosctl|duty drawback|interest equali[sz]ation|export promotion mission|niryat|trade finance|export credit|ecgc|insurance cover for .* exports?)\b"),
    ("trade-corridor", "market", 2, r"\b(fta|free trade agreement|trade deal|trade pact|cepa|tariffs?|new markets|leverage ftas?)\b"),
    ("upi-global", "market", 1, r"\b(upi|npci|rupay)\b.{0,100}\b(international|global|cross[- ]border|abroad|overseas|countr(y|ies)|" + _UPI_COUNTRIES + r")\b|\b(" + _UPI_COUNTRIES + r")\b.{0,60}\b(upi|npci|rupay)\b|npci international|\bnipl\b"),
    ("cards", "market", 2, r"\b(tokeni[sz]ation|card networks?|visa|mastercard|amex|apple pay|google pay|mdr|3-?d ?secure|additional factor of authentication|afa)\b"),
    ("gift-city", "market", 2, r"\b(gift city|gift ifsc|ifsca)\b"),
    ("export-data", "market", 1, r"\bexports?\b.{0,40}\b(rise|rises|grow|growth|jump|surge|fall|decline|could add|target|data|billion|record)\b"),
    ("xb-payments", "market", 1, r"cross[- ]border (payments?|collections?|remittances?|commerce|transfers?|platform)|instant payments|swift"),
]
REGULATOR_SOURCES = r"^rbi"

# --- fixed values: posts -----------------------------------------------------
POST_REGION_CHANNELS = r"^(indianstartups|startupindia|freelanceindia|freelance_india|ecommerceindia|indiatax|indiabusiness|indianentrepreneur|developersindia|indiainvestments|indiaspeaks|personalfinanceindia|legaladviceindia|caindia|india|bangalore|mumbai|delhi|hyderabad|pune|chennai|ahmedabad|kerala|kolkata)$"
POST_REGION = r"\b(india|indian|inr|rupees?|gst|lut|rbi|fema|nri|pvt\.? ?ltd|llp|proprietorship|bengaluru|bangalore|mumbai|delhi|pune|hyderabad|chennai|kolkata|ahmedabad|jaipur|surat|noida|gurgaon|gurugram)\b|₹|\b(crore|lakh)s?\b"
POST_RECEIVE = r"\b(receiv\w*|collect\w*|get(ting)? paid|accept\w*|payouts?|withdraw\w*|settle\w*|inward|invoic\w*|bill(ing)? (my |our )?clients?|charge (my |our )?(customers?|clients?)|clients? (pay|in the|from|abroad|overseas)|foreign (clients?|customers?|buyers?)|international (clients?|customers?|buyers?|sales|orders?)|overseas (clients?|customers?|buyers?)|us clients?|uk clients?|export\w*)\b"
POST_NO_RECEIVE = r"\b(don['’]?t|do not|no) need to (receive|transfer)"
POST_CROSS_BORDER = r"\b(international|abroad|foreign|overseas|cross[- ]border|global(ly)?|usd|eur|gbp|dollars?|swift|us (clients?|customers?)|north america|europe|uk)\b"
POST_BUSINESS = r"\b(freelanc\w*|client(s)?|saas|startup|founder|co-?founder|my (business|company|agency|store|shop|brand|app|product)|our (business|company|agency|store|shop|brand|app|product|customers)|agency|consult\w*|subscription|customers?|merchant|seller|shopify|etsy|woocommerce|amazon global|exporter|export house|manufacturer|services? business|b2b|llp|pvt\.? ?ltd|proprietor)\b"
POST_CONSUMER = r"\b(send money (to|home)|money to (family|parents)|credit card|debit card|forex card|forex markup|zero[- ]forex|lounge|cashback|rewards card|pay(ing)? (on|for) international (websites?|sites?)|international (shopping|websites?|sites?)|application fee|tuition|visa (fee|application)|study abroad|trip|travel(l)?ing (to|from)|holiday|flight|hotel|amazon\.com order|temu|shein|aliexpress|steam|netflix|spotify|chatgpt (plus|subscription)|apple id|google play (balance|gift))\b"
POST_CORE = r"\b(stripe|paypal|payoneer|wise|skydo|xflow|briskpe|razorpay|cashfree|payu|dodo ?payments|paddle|lemon ?squeezy|airwallex|whop|merchant of record|payment (gateway|provider|platform|processor|aggregator)s?|receiv\w* (international |foreign )?(payments?|money|funds|usd|dollars)|get(ting)? paid|payouts?|collect\w* payments?|accept\w* (international )?(payments?|cards)|international (payments?|cards?|transactions?|transfers?|clients?|customers?)|foreign (remittance|payments?|clients?|currency|buyers?)|payments? from (the )?(usa?|uk|abroad)|cross[- ]border payments?|inward remittance|fir[ac]s?|e-?brc|edpms|export of services|swift|wire transfers?|forex|fx (rate|fee|markup)|usd|paid in (usd|dollars))\b"
POST_PROMO_TITLE = r"\b(feedback (wanted|needed|on)|roast my|validate|would (a|an|this) .{0,60} help|is this a (real )?problem|co-?founder|sponsor|selected (among|for)|i (built|made|created|launched)|we (built|launched)|introducing|beta test|hiring|job)\b"
POST_OFFTOPIC = r"^\s*\[(wts|wtb|selling|buying|us|eu|uk|for hire|hiring)\]|\b(resume|ats|interview|job (offer|hunt|search)|hiring|for hire|salary|appraisal|lut (for|to|on) (photo|video|footage)|color grad\w*|colour grad\w*|s-?log|davinci|premiere pro|lightroom|fpga|lut6|instagram|tiktok account|giveaway)\b"
POST_PROBLEM = r"\b(declin\w*|fail(ed|ing|s)?|delay\w*|settlement|conversion|fx|exchange rate|fees?|charges?|on hold|chargebacks?|refunds?|frozen|rejected|blocked|limited|deduct\w*|lost|losing)\b"
POST_REVENUE_ABROAD = r"\b(clients? (in|from) (the )?(us|usa|uk|europe|eu|canada|australia|uae)|(us|uk|eu|foreign|international|overseas|global) (clients?|customers?|buyers?|users?)|customers (abroad|overseas)|revenue|mrr|arr|orders? from|paying (customers|users)|sales (abroad|overseas))\b"
POST_UNHAPPY = r"\b(high fees|too (expensive|high|much)|expensive|rip-?off|worst|terrible|horrible|hate|frustrat\w*|annoy\w*|nightmare|froze|frozen|on hold|limited|rejected|declined|banned|lost|losing|slow|delay\w*|stuck|unhappy|fed up|sucks|issues?|problems?)\b"
POST_URGENT = r"\b(urgent\w*|asap|immediately|this week|next week|this month|launching|about to launch|going live|go live|deadline|stuck|help!)\b"
POST_RESTRICTED = r"\b(gambling|betting|casino|fantasy (sports|league)|crypto\w*|bitcoin|nft|forex trading|binary options|adult|onlyfans|escort|vape|tobacco|cbd|cannabis|kratom|prescription|online pharmacy|firearms?|weapons?|mlm|network marketing|chit fund|loan app|lottery|matka)\b"
POST_PROVIDERS = [
    "stripe", "paypal", "payoneer", "wise", "skydo", "xflow", "briskpe", "razorpay", "cashfree", "payu",
    "dodo ?payments", "paddle", "lemon ?squeezy", "airwallex", "whop", "gumroad", "instamojo", "ccavenue",
]
POST_INTENTS = {
    "switching": r"\b(looking for (a |an )?(payment|provider|gateway|platform|solution|way|alternative)|is (it |\w+ )?safe|should i use|good option|merchant of record|\bmor\b|do (i|we) need|which|best|recommend\w*|suggest\w*|alternatives?|vs\.?|versus|compare|comparison|switch(ing)? (from|to)|instead of|options? for|what (do|are) (you|people) us(e|ing)|anyone (use|used|using|tried))\b",
    "blocked": r"\b(frozen|freez\w*|on hold|account (was |got |is |has been )?(limited|closed|restricted)|blocked|banned|suspended|rejected|declined|invite[- ]only|not available in india|not supported in india)\b",
    "compliance": r"\b(fir[ac]s?|e-?brc|softex|export of services|lut|gst (on|for) (export|foreign|international)|zero[- ]rated|purpose code|inward remittance|fema|rbi (rules?|guidelines?)|edf|edpms|tds|form 10f|trc)\b",
    "fees": r"\b(fees?|charges?|commission|markup|spread|conversion (rate|fee)|exchange rate|lost|losing|deduct\w*|hidden cost|expensive|swift|wire (fee|transfer)|intermediary bank|\d+(\.\d+)? ?%)\b",
    "setup": r"\b(how (do|can|should) (i|we)|how to|set ?up|start accepting|integrate|onboard\w*|first international|payment gateway for|accept international (cards|payments))\b",
}
POST_INTENT_COMPLAINT = "provider-complaint"
POST_INTENT_DEFAULT = "discussion"
POST_SEGMENTS = {
    "saas": r"\b(saas|subscription|software|app store|api|ai (product|startup|tool)|b2b software|mrr|arr|indie ?hacker|digital (product|service)s?|online course|course creator)\b",
    "ecommerce": r"\b(shopify|woocommerce|bigcommerce|etsy|d2c|brand|online store|e-?commerce|checkout|dropship\w*|print on demand|amazon (global|fba|seller))\b",
    "goods": r"\b(exporter|export house|shipment|importer|letter of credit|\blc\b|iec|ad code|fob|cif|handicraft|textile|garment|jewell?ery|spices|rice|manufactur\w*|containers?)\b",
    "services": r"\b(freelanc\w*|upwork|fiverr|contractor|agency|consult\w*|it services|software services|outsourc\w*|designer|developer|writer|editor|translator|virtual assistant|creator|clients?)\b",
}
POST_SEGMENT_DEFAULT = "other"
POST_SEGMENT_FIT = {"saas": "IPG + recurring", "ecommerce": "IPG", "goods": "MCA", "services": "MCA"}
POST_FIT_CARDS = ("IPG", r"\b(cards?|checkout|declin\w*|payment gateway|gateway|subscription|recurring|website|store|shopify|woocommerce|payment links?)\b")
POST_FIT_ACCOUNTS = ("MCA", r"\b(invoic\w*|bank transfer|wire|swift|usd account|receive usd|remittance|ach|sepa|fir[ac]|payoneer|wise|upwork)\b")

# --- fixed values: sites -----------------------------------------------------
SITE_PROVIDERS = {
    "Stripe": r"js\.stripe\.com|checkout\.stripe\.com|buy\.stripe\.com|stripe\.com\/v3",
    "Razorpay": r"checkout\.razorpay\.com|razorpay\.com\/(payment|pl)|rzp\.io|razorpay-checkout",
    "PayPal": r"paypal\.com\/sdk|paypalobjects\.com|paypal\.me\/|www\.paypal\.com\/(cgi-bin|checkoutnow|donate)",
    "Cashfree": r"sdk\.cashfree\.com|cashfree\.com\/(checkout|pg)|payments\.cashfree",
    "PayU": r"secure\.payu\.in|payumoney\.com|payu\.in\/pay",
    "CCAvenue": r"ccavenue\.com",
    "Instamojo": r"instamojo\.com",
    "Paddle": r"cdn\.paddle\.com|paddle\.js|checkout\.paddle\.com",
    "Lemon Squeezy": r"lemonsqueezy\.com",
    "Chargebee": r"js\.chargebee\.com|chargebee\.com\/checkout",
}
SITE_PLATFORMS = {
    "Shopify": r"cdn\.shopify\.com|myshopify\.com|Shopify\.theme",
    "WooCommerce": r"woocommerce",
    "Magento": r"Magento_|mage\/cookies|static\/version\d+\/frontend",
    "Wix": r"wixstatic\.com|wix\.com",
    "Webflow": r"webflow\.(com|io)",
}
SITE_CURRENCIES = {
    "USD": r"(US\$|\$\s?\d|\bUSD\b)", "EUR": r"(€\s?\d|\bEUR\b)", "GBP": r"(£\s?\d|\bGBP\b)",
    "AED": r"\bAED\b", "INR": r"(₹\s?\d|\bINR\b|Rs\.?\s?\d)",
}
SITE_SWITCHER = r"currency[-_ ]?(switcher|selector|picker|converter)|select (your )?currency|data-currency|localization-form"
SITE_SHIPS_ABROAD = r"ships? (worldwide|internationally|globally|to \d+\+? countries)|international shipping|worldwide shipping|we ship (to|across) (the )?(world|globe|\d+)|global shipping"
SITE_ROLE_INBOX = r"\b(sales|hello|contact|info|support|partnerships|business|team)@[a-z0-9.-]+\.[a-z]{2,}\b"
SITE_PARKED = r"domain (is )?for sale|buy this domain|parked free|sedoparking|hugedomains|dan\.com|godaddy\.com\/domainsearch|this domain may be for sale"
SITE_PARKED_WINDOW = 20000
SITE_ABOUT = r"about|team|leadership|founders?|people|our-story|who-we-are|company"
SITE_TEAM = r"team|leadership|founder|people"
JOB_BOARDS = r"(?:boards|job-boards)\.greenhouse\.io\/(?:embed\/job_board\?for=)?([a-z0-9_-]+)|jobs\.lever\.co\/([a-z0-9_-]+)|jobs\.ashbyhq\.com\/([a-z0-9_.-]+)"
INTERNATIONAL_ROLE = r"international|global|\b(us|usa|uk|uae|emea|apac|europe|dubai|singapore|north america)\b|export|overseas"
PAYMENT_TECH = r"stripe|paypal|razorpay|cashfree|payu|ccavenue|braintree|adyen|checkout\.com|square|klarna|afterpay|paddle|chargebee|recurly|shopify payments|apple pay|google pay|amazon pay|instamojo|juspay|easebuzz|phonepe|paytm|2checkout|worldpay|payoneer|wise"
COMMERCE_TECH = r"shopify|woocommerce|magento|bigcommerce|wix|squarespace|prestashop|opencart|salesforce commerce"

# --- fixed values: search rotation -------------------------------------------
SEARCH_SEGMENTS = [
    "SaaS startup", "AI startup", "D2C brand", "edtech startup", "travel startup", "IT services company",
    "digital agency", "exporter", "handicrafts exporter", "textile exporter", "jewellery exporter",
    "gaming studio", "spices exporter", "ayurveda brand", "fashion brand", "B2B marketplace",
    "healthtech startup", "deeptech startup", "SaaS company", "software company", "beauty brand",
    "furniture exporter",
]
SEARCH_INTENTS = [
    "raises seed funding", "raises Series A", "raises pre-Series A", "expands to US", "launches in UAE",
    "enters Europe", "international expansion", "global customers", "export orders",
    "opens office in Dubai", "launches on Amazon US", "ships worldwide", "Singapore expansion",
    "UK launch", "Middle East expansion", "Australia launch",
]
LOOKALIKE_SEGMENTS = {
    "SaaS": "SaaS startup", "AI": "AI startup", "D2C": "D2C brand", "Exporter": "exporter",
    "Edtech": "edtech startup", "Travel": "travel startup", "IT Services": "IT services company",
    "Agency": "agency", "Manufacturing": "manufacturer", "Gaming": "gaming studio",
    "Marketplace": "marketplace",
}
LOOKALIKE_DEFAULT = "startup"

# --- fixed values: explanation of a score -------------------------------------
# Slots of clauses; in each the first fact that holds speaks.
WHY_TRIGGERS = [
    [("round", "raised a {stage} round{of}{ago}"), ("capital", "raised fresh capital{of}{ago}"), ("listed", "is listed in a start-up directory")],
    [("launched into", "launched into {markets}"), ("launched", "launched internationally"),
     ("expands into", "is expanding into {markets}"), ("expands", "is expanding internationally")],
    [("pained", "has publicly described payment friction")],
]
WHY_FITS = [
    [("sells into", "already sells abroad ({markets})"), ("sells", "already sells abroad"), ("likely", "{sector} model usually bills foreign customers")],
    [("foreign prices", "site prices in {currencies}")],
    [("ships", "ships internationally")],
    [("collects", "collects via {providers}"), ("platform", "runs on {platform}")],
]
WHY_AMOUNT, WHY_AGO, WHY_NOTHING, WHY_MARKETS = " of {x}", " {x}d ago", "shows cross-border potential", 3

# --- fixed values: people in text --------------------------------------------
PERSON_NAME = r"[A-Z][a-z]+(?:[ -](?:[A-Z][a-z]+|[A-Z]\.?(?=\s))){1,2}(?![\w-])"
PERSON_ROLE = (
    r"(?:(?:[Aa]ssistant |[Ss]enior |[Ee]xecutive )?(?:Vice President|VP)(?:\s*[-–,]\s*[A-Z][a-z]+(?:\s*(?:&|and)\s*[A-Z][a-z]+| [A-Z][a-z]+)?)?"
    r"|[Cc]o-?[Ff]ounder|[Ff]ounder|CEO|CTO|COO|CFO|CMO|CPO|CBO|[Cc]hief [A-Z]?[a-z]+ [Oo]fficer|[Mm]anaging [Dd]irector|MD"
    r"|[Hh]ead of [A-Z]?[a-z]+(?: [A-Z]?[a-z]+)?|VP,? [A-Z][a-z]+|[Pp]resident|[Cc]hairman)"
)
#: How any role begins, and any way to say "founded by".
PERSON_MARK_STARTS = (
    r"(?=[ACEFHMPSVacefhmps])(?:[Cc](?:o-?[Ff]|hief|hair)|C[ETOFMPB]O|[Ff]ound|[Ss](?:enior|tarted|et )|[Ee](?:xec|stab)|[Hh]ead|[Pp]resid|[Mm]anag|MD|V(?:ice|P)|[Aa]ssis)"
)
PERSON_DEPARTMENT = r"(?:Finance|Accounts|Treasury|Payments|Sales|Ad Sales|Marketing|Growth|Revenue|Partnerships|Business Development|Strategy|Operations|Engineering|Technology|Product|E-?commerce|Digital|Exports?|International Business|Global Business|HR|People|Legal|Compliance|Risk)"
PERSON_ORGS = r"\b(Technologies|Technology|Pvt|Ltd|Limited|Inc|LLC|Labs|Solutions|Products|Systems|Ventures|Capital|Partners|Group|Industries|Enterprises|Corp|Company|Studio|Media|Foods|Brands)\b"
PERSON_ORGS_MORE = r"\b(Initiative|Foundation|Network|Association|Council|Mobility|Energy|Motors|Pharma|Healthcare|Infra)\b"
NOT_A_NAME = (
    "Founder Co Cofounder Ceo Cto India Indian Ventures Venture Capital Partners Partner Fund Funds Labs Lab Technologies Technology Tech Private Limited "
    "Bengaluru Bangalore Mumbai Delhi Gurugram Gurgaon Noida Pune Hyderabad Chennai Kolkata Jaipur Ahmedabad Series Seed Round Angel Network Group Global Holdings "
    "The This That Its Their Our His Her Said Says Also Startup Company Inc Media News Today Read More Team Board Advisor Investor Investors Family Office "
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "Managing Director Chief Officer Head President Chairman Executive Vice Assistant Senior Junior Lead Manager Engineer Consultant Sales Marketing "
    "Business School University College Institute Chartered Accountant Doctor Resident Professor Prof Dr Mr Ms Mrs Ex Former Associate Analyst Intern "
    "Operations Finance Product Engineering Growth Strategy Design Legal Human Resources People Talent Customer Success Support Admin Meet Join"
).split()
PERSON_ORG_STARTS = "[A-Z]"
INVESTOR_BEFORE = r"investor|angel|participation from|participated|backed by|led by|along with|alongside|including|family office|venture partner|general partner"
INVESTOR_NEAR = r"investors? includ(?:e|ing)|participation from"
FOUNDED_BY = r"(?:[Ff]ounded|[Cc]o-founded|[Ss]tarted|[Ss]et up|[Ee]stablished)\s+(?:in\s+\d{4}\s+)?by\s+"
FOUNDER_LEAD_IN = r"former\s+[\w ]+?\s+executives?|IIT[\w ]*?alumni|serial entrepreneurs?"
PERSON_GUARDS = [
    {"shapes": ("name first", "role first"), "side": "after", "reach": 70, "pattern": r"^[^.]{0,60}[“\"]"},
    {"shapes": ("name first", "role first"), "side": "before", "reach": 90, "pattern": rf"(?i)(?:{INVESTOR_BEFORE})[^A-Za-z0-9_]*\z", "starts": "[iapblfvg]", "in_speech": False},
    {"shapes": ("name first", "role first"), "side": "before", "reach": 160, "pattern": rf"(?i)\b(?:{INVESTOR_NEAR})\b", "starts": "[ip]", "in_speech": False},
    {"shapes": ("name first", "role first"), "side": "after", "reach": 60, "pattern": r"^\s*[,@|]\s*([A-Z][\w&.'-]*(?:\s+[A-Z][\w&.'-]*){0,4})",
     "foreign": "other start", "like": PERSON_ORGS + "|^[A-Z][a-z]+[A-Z]"},
    {"shapes": ("name first", "role first"), "side": "after", "reach": 60, "pattern": r"^\s*(?:of|at)\s+([A-Z0-9][\w&.'-]*(?:\s+[A-Z0-9][\w&.'-]*){0,3})",
     "foreign": "unrelated", "spared": "(?i)^(?:the|our|its|this)"},
    {"shapes": ("role first",), "side": "before", "reach": 40, "pattern": r"((?!(?:The|Its|And|Said|Says|While|According)\s*\z)[A-Z][\w&.'-]*)\s*\z",
     "foreign": "not in name"},
]
TEAM_PATTERNS = [
    r"\b(?:team|workforce|headcount|staff) of (?:about |around |over |more than |nearly |close to |~)?(\d[\d,]*)\+?",
    r"\b(\d[\d,]*)\+?[- ](?:member|people|person|strong)\b",
    r"\b(?:employs|employing|employ) (?:about |around |over |more than |nearly |close to )?(\d[\d,]*)",
    r"\b(\d[\d,]*)\+? (?:employees|full-time employees|staff members|team members)\b",
]
TEAM_MIN, TEAM_MAX = 2, 200000
