"""Word lists, patterns and constants that rules refer to.

Fixed values: they must equal the rule set's for its results, and stand here in natural order.
"""

# Relevance keywords: two points each, one point each.
HIGH_KEYWORDS = [
    "dpdpa", "data protection board", "meity", "personal data protection", "dsar",
    "consent management", "breach notification", "72 hour", "6 hour", "enforcement",
    "penalty", "fine", "data fiduciary", "significant data fiduciary",
]
MEDIUM_KEYWORDS = [
    "gdpr", "ccpa", "ico", "edpb", "data breach", "data localization", "data localisation",
    "cross-border transfer", "right to erasure", "privacy by design",
    "privacy policy", "data sharing", "consent", "data privacy",
]
PROCEEDINGS = [
    "supreme court", "high court", "nclat", "nclt", "tribunal", "tdsat",
    "hearing", "appeal", "petition", "pil", "writ", "bench", "verdict",
    "judgment", "ruling", "stay", "interim order", "notice to",
]
ENTERPRISES = [
    "tcs", "infosys", "wipro", "reliance", "jio", "airtel", "hdfc", "icici", "sbi",
    "paytm", "phonepe", "zerodha", "zomato", "swiggy", "flipkart", "cred", "byju",
    "star health", "mastercard", "amex", "american express",
]
ORIGIN_SOURCES = ["meity", "dpbi", "cert-in", "rbi", "yourstory", "inc42", "entrackr"]
ENFORCEMENT_VERBS = ["penalty", "penalize", "fine", "adjudicate", "prosecute", "order", "investigation"]
URGENCY = ["effective immediately", "deadline", "urgency", "timeline", "urgent"]
AUTHORITY_TWO = ["dataguidance", "dsci"]
AUTHORITY_ONE = ["iapp", "privacyenforcement"]
JUDICIAL_SOURCES = ["indiankanoon", "supreme court", "high court", "adjudication", "nclt", "cci"]
PRESS_SOURCES = ["et business", "economictimes", "inc42", "yourstory", "entrackr", "livemint"]
COURT_SOURCES = ["indiankanoon", "supreme court", "high court"]

MONEY = r"(?:₹|rs\.?|rupees?|\b\d+\s*(?:lakh|crore|million|billion)\b)"
CORPORATE_NAME = r"\b[a-z0-9]+\s+(?:pvt\.?\s+ltd\.?|ltd\.?|llp)\b"
CITATION = r"\b(?:section|sec\.?|rule|clause|article|art\.?)\s+\d+\b"
SECTION_OR_RULE = r"\b(?:section|rule)\s+\d+\b"

# Pre-filter.
ANCHORS = [
    "dpdp", "data protection", "personal data", "privacy", "data breach",
    "cert-in", "cert in", "data fiduciary", "data principal", "consent manager",
    "data localisation", "data localization", "gdpr", "cyber security",
    "cybersecurity", "information technology act", "it act", "aadhaar",
    "surveillance", "data leak", "breach notification", "dsar",
]
ACTIONS = (
    r"\b(?:penal(?:ty|ise|ize|ised|ized)|fine[ds]?|fined|order(?:ed|s)?|direct(?:ed|ion|ions)?|notice|ban(?:ned)?|barred|restrict\w*|"
    r"adjudicat\w*|investigat\w*|prosecut\w*|judgment|ruling|verdict|notifi(?:ed|cation)|circular|advisory|breach|leak(?:ed)?)\b"
)
NOISE = (
    r"\b(?:webinar|conference|summit|workshop|hiring|job|internship|sponsored|advertorial|coupon|discount|horoscope|cricket|box office|"
    r"how to|top \d+|best \d+|listicle)\b"
)
CORPORATE_NOISE = (
    r"\b(?:seed round|series [a-f]\b|funding|raises|raised|valuation|ipo|acquires|acquisition|merger|appoints|appointment|resigns|steps down|"
    r"quarterly results|q[1-4] results|revenue|profit|share price|launches|unveils|partners with|partnership)\b"
)
OFF_TOPIC = (
    r"\b(?:priority sector lending|cash reserve ratio|statutory liquidity|foreign exchange management|fema|know your customer|kyc|"
    r"monetary policy|repo rate|interest rate|liquidity adjustment|government securities|treasury bill|banking ombudsman|"
    r"co-operative bank|basel|capital adequacy|inflation|gdp|msme credit|prompt corrective action|deposit insurance)\b"
)
COUNTRY_HINTS = [
    "india", "indian", "rbi", "meity", "cert-in", "sebi", "irdai",
    "cci", "trai", "uidai", "delhi", "mumbai", "bengaluru", "supreme court",
]
MONEY_HINT = r"(?:₹|rs\.?|inr)\s?[\d,]+|crore|lakh|million|billion"

# Routers: the first rule that fires wins.
SECTION_RULES = [
    ("dpdpa_board", ["dpdpa", "data protection board", "dpbi", "meity", "dpdp rules"]),
    ("cert_in_breach", ["cert-in", "cert in", "breach notification", "6 hour", "6-hour", "70b"]),
    ("courts_case_law", ["supreme court", "high court", "tribunal", "tdsat", "judgment", "43a", "72a", "court"]),
    ("sectoral_regulators", ["rbi", "reserve bank", "sebi", "irdai", "cci", "trai", "npci", "uidai", "dot ", "ccpa"]),
    ("international_benchmarks", ["gdpr", "edpb", "ico", "cnil", "garante", "pdpc", "oaic", "eu ", "ireland", "european"]),
]
SECTION_DEFAULT = "sectoral_regulators"
SECTOR_RULES = [
    ("Fintech", ["bank", "fintech", "payment", "upi", "paytm", "phonepe", "rbi", "lending", "npci"]),
    ("Healthcare", ["health", "hospital", "insurance", "irdai", "star health", "pharma", "medical"]),
    ("Social Media / Tech", ["social", "meta", "facebook", "whatsapp", "google", "twitter", "x corp", "tech", "app ", "platform"]),
    ("Government", ["government", "aadhaar", "uidai", "ministry", "govt", "public sector", "state"]),
]
SECTOR_DEFAULT = "Other"
SECTIONS = ["dpdpa_board", "sectoral_regulators", "cert_in_breach", "courts_case_law", "international_benchmarks"]
SECTOR_BUCKETS = [
    ("social_tech_count", ["Social Media / Tech"]),
    ("healthcare_count", ["Healthcare", "Insurance / Healthcare", "Insurance"]),
    ("fintech_count", ["Fintech", "Payments / Fintech", "Payments"]),
    ("gov_count", ["Government"]),
]
BADGES = [
    ("badge-fine", ["fine", "penalty"]),
    ("badge-ban", ["ban", "restrict"]),
    ("badge-compliance", ["compliance"]),
    ("badge-enacted", ["enacted", "rule", "force"]),
    ("badge-investigation", ["investigation", "ongoing", "consultation"]),
]

# Tokens.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with",
    "at", "by", "from", "as", "is", "are", "was", "were", "be", "been", "has",
    "have", "had", "it", "its", "this", "that", "these", "those", "will", "would",
    "can", "could", "may", "might", "said", "says", "new", "also", "more", "after",
    "over", "into", "about", "than", "then", "not", "no", "we", "you", "they",
]
SUFFIXES_SIGNATURE = r"\b(pvt|private|ltd|limited|llp|inc|corp|corporation|company|co|plc|technologies|technology|solutions|services|india|bank)\b"
SUFFIXES_ENTITY = r"\b(pvt|private|ltd|limited|llp|inc|corp|corporation|company|co|plc|technologies|technology|solutions|services|holdings|group)\b"
SUFFIXES_REVIEW = r"\b(pvt|private|ltd|limited|llp|inc|corp|company|co|india|bank|technologies|solutions|services)\b"
ENTITY_STOP = ["the", "of", "and", "a", "an", "for"]
SLUG_STOP = ["the", "of", "and", "a", "an", "for", "ltd", "limited", "pvt", "private", "inc"]
AUTHORITY_SHORT = {
    "Data Protection Board of India": "dpb",
    "Reserve Bank of India": "rbi",
    "Competition Commission of India": "cci",
    "High Court / Supreme Court": "court",
    "Irish Data Protection Commission": "dpc",
    "CERT-In / IRDAI": "cert-in",
}
AUTHORITY_SEPARATOR = r"\s*(?:/|&|\band\b|,)\s*"
WEAK_TOKENS = [
    "india", "indian", "limited", "ltd", "private", "pvt", "company", "corp",
    "services", "technologies", "solutions", "bank", "finance", "financial",
    "insurance", "data", "digital", "group", "holdings", "international",
]

# Entity types.
CASE_CAPTION = r"\b(?:v|vs|versus)\b\.?\s"
GENERIC_ADDRESSEES = [
    "all body corporates", "industry-wide", "industry wide", "all data fiduciaries",
    "statute", "draft", "rules", "intermediaries", "needs review", "unknown",
]
REGULATORS = [
    "reserve bank of india", "competition commission of india", "cert-in",
    "securities and exchange board of india",
    "insurance regulatory and development authority of india",
    "telecom regulatory authority of india", "data protection board of india",
    "ministry of electronics and information technology",
    "unique identification authority of india", "irish data protection commission",
]
REGULATOR_WORDS = ["commission", "authority", "ministry", "board", "cert", "bank of india"]
COURT_WORDS = ["court", "tribunal", "tdsat", "bench"]
STATUTE_WORDS = ["act", "rules", "section", "article", "constitution"]
PAGEABLE_TYPES = ["company", "regulator", "court"]

# Amounts.
MULTIPLIERS = {
    "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "mn": 1e6, "m": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9, "trillion": 1e12,
}
MULTIPLIER_WORDS = "thousand|trillion|million|billion|crores|lakhs|crore|lakh|lacs|lac|mn|cr|bn|k|m"
CURRENCIES = r"₹|rs\.?|inr|rupees?|usd|\$|eur|€|£"
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "twenty": 20, "fifty": 50, "hundred": 100,
}

# Statute references.
SECTION_REFERENCE = r"(?i)(?:section|sec\.?|s\.)\s*(\d{1,2})(?:\s*\(\s*\d+\s*\))?"
OTHER_STATUTES = ["it act", "information technology act", "gdpr", "competition act", "constitution"]

# Dates, in the order they are tried.
DATE_FORMATS = ["yyyy-M-d", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "MMMM yyyy", "MMM yyyy", "yyyy"]

SECOND_LEVEL_LABELS = ["co", "com", "gov", "org", "net", "ac"]
OPEN_OUTCOMES = ["Investigation Ongoing", "Consultation"]
ENFORCEMENT_SIGNAL = (
    r"\b(?:penalty|penalti(?:es|se|ze)d?|fine[ds]?|fined|order(?:ed|s)?|ban(?:ned|s)?|adjudicat\w*|investigat\w*|notice|direct(?:s|ed|ion)?|imposed|"
    r"prosecut\w*|restrict\w*|barred)\b"
)

# Official sources.
TRUSTED_DOMAINS = [
    "meity.gov.in", "rbi.org.in", "cert-in.org.in", "sebi.gov.in", "irdai.gov.in",
    "cci.gov.in", "sci.gov.in", "indiacode.nic.in", "egazette.gov.in", "uidai.gov.in",
    "trai.gov.in", "pib.gov.in", "prsindia.org", "indiankanoon.org",
]
AGGREGATOR_HOSTS = ["news.google.com", "news.yahoo.com/rss"]
AUTHORITY_DOMAINS = {
    "Data Protection Board of India": ["meity.gov.in", "pib.gov.in"],
    "MeitY": ["meity.gov.in", "egazette.gov.in", "pib.gov.in"],
    "CERT-In": ["cert-in.org.in"],
    "Reserve Bank of India": ["rbi.org.in"],
    "Competition Commission of India": ["cci.gov.in"],
    "IRDAI": ["irdai.gov.in"],
    "SEBI": ["sebi.gov.in"],
    "High Court / Supreme Court": ["sci.gov.in", "indiankanoon.org"],
}
AUTHORITY_SECTION = {
    "Data Protection Board of India": "dpdpa_board",
    "MeitY": "dpdpa_board",
    "CERT-In": "cert_in_breach",
    "Reserve Bank of India": "sectoral_regulators",
    "Competition Commission of India": "sectoral_regulators",
    "IRDAI": "sectoral_regulators",
    "SEBI": "sectoral_regulators",
    "High Court / Supreme Court": "courts_case_law",
}
RESOLVED_WORDS = ["fine of", "penalty of", "imposed a penalty", "ordered to pay", "dismissed", "closed the", "settled", "banned", "barred"]
EXTRACTED_MONEY = r"(?i)(?:₹|rs\.?|inr)\s?[\d,]+(?:\.\d+)?\s?(?:lakh|crore|cr|million|bn|billion)?|[\d,]+(?:\.\d+)?\s?(?:lakh|crore|million|billion)"

# canonical entities and the variants seen of them
ALIAS_SEEDS = {
    "Meta Platforms": ["meta", "facebook", "whatsapp meta", "whatsapp", "meta india", "facebook india", "whatsapp llc"],
    "Reserve Bank of India": ["rbi", "reserve bank"],
    "Competition Commission of India": ["cci"],
    "Ministry of Electronics and Information Technology": ["meity", "ministry of electronics", "ministry of electronics and it"],
    "CERT-In": ["cert in", "certin", "indian computer emergency response team"],
    "Securities and Exchange Board of India": ["sebi"],
    "Insurance Regulatory and Development Authority of India": ["irdai", "irda"],
    "Telecom Regulatory Authority of India": ["trai"],
    "Unique Identification Authority of India": ["uidai", "aadhaar authority"],
    "Data Protection Board of India": ["dpb", "dpbi", "data protection board"],
    "Supreme Court of India": ["supreme court", "sci", "hon'ble supreme court"],
    "Irish Data Protection Commission": ["irish dpc", "dpc ireland", "data protection commission"],
    "Star Health and Allied Insurance": ["star health", "star health allied insurance"],
    "American Express": ["amex", "american express diners club", "diners club"],
    "Mastercard": ["mastercard incorporated", "master card"],
    "LinkedIn": ["linkedin ireland", "linkedin corporation"],
}

# the act's sections: number, title, chapter
STATUTE_SECTIONS = {
    "3": ("Application of the Act", "I — Preliminary"),
    "4": ("Grounds for processing personal data", "II — Obligations"),
    "5": ("Notice", "II — Obligations"),
    "6": ("Consent", "II — Obligations"),
    "7": ("Certain legitimate uses", "II — Obligations"),
    "8": ("General obligations of a Data Fiduciary", "II — Obligations"),
    "9": ("Processing of personal data of children", "II — Obligations"),
    "10": ("Additional obligations of Significant Data Fiduciaries", "II — Obligations"),
    "11": ("Right to access information", "III — Rights"),
    "12": ("Right to correction and erasure", "III — Rights"),
    "13": ("Right of grievance redressal", "III — Rights"),
    "14": ("Right to nominate", "III — Rights"),
    "15": ("Duties of a Data Principal", "III — Rights"),
    "16": ("Processing personal data outside India", "IV — Transfers"),
    "17": ("Exemptions", "IV — Transfers"),
    "27": ("Powers and functions of the Board", "V — Data Protection Board"),
    "33": ("Penalties and adjudication", "VII — Penalties"),
}

# words of company names that identify none
GENERIC_NAME_WORDS = ["india", "indian", "limited", "ltd", "private", "pvt", "bank", "commission", "authority", "ministry", "board", "court", "of", "and", "the", "insurance", "financial", "services", "data"]

# names that give no useful watch, and the topical words a watch is paired with
WATCH_SKIPPED = ["unknown", "industry-wide", "generic"]
WATCH_ANCHOR = "(data OR privacy OR breach OR penalty OR DPDP OR CERT-In)"

# fixed texts of records made without a model
NEEDS_REVIEW = "[Needs review]"
NEEDS_REVIEW_SOURCE = "[Needs review — see source]"
AUTO_FLAGGED = "[Auto-flagged — verify]"
AUTO_RESOLVED = "Auto-flagged possible resolution — verify."
AUTO_DETECTED, SNIPPET = "AUTO-DETECTED: ", "Snippet: "
