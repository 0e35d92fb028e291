"""Word lists, label domains and mappings.

Every operator that uses a list takes it as an argument; the values below are
only the defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES -- must equal the reference application's for identical results.
# Kept verbatim, in their natural order.
# ---------------------------------------------------------------------------

# Contractions expanded before cleaning (applied in this order, case-insensitive,
# as substring replacements).
CONTRACTIONS: list[tuple[str, str]] = [
    ("can't", "cannot"),
    ("won't", "will not"),
    ("I'm", "I am"),
    ("I've", "I have"),
    ("I'll", "I will"),
    ("I'd", "I would"),
    ("don't", "do not"),
    ("doesn't", "does not"),
    ("didn't", "did not"),
    ("isn't", "is not"),
    ("aren't", "are not"),
    ("wasn't", "was not"),
    ("weren't", "were not"),
    ("hasn't", "has not"),
    ("haven't", "have not"),
    ("hadn't", "had not"),
    ("it's", "it is"),
    ("they're", "they are"),
    ("we're", "we are"),
    ("you're", "you are"),
    ("he's", "he is"),
    ("she's", "she is"),
]

# Characters kept by the cleaner; everything else becomes a space.
ALLOWED_CHARS_CLASS = "A-Za-z0-9 .,!?'\\-"

# Explicit profanity: matched as a word prefix, case-insensitive.
PROFANITY: list[str] = ["fuck", "shit", "bitch", "asshole", "cunt"]

# Category relevance keywords (substring match on lower-cased text).
CATEGORY_KEYWORDS: dict[str, list[str]] = {
    "ATM_FAILURE": [
        "atm", "machine", "card", "cash", "withdraw", "deposit",
        "screen", "error", "keypad", "transaction",
    ],
    "FRAUD_DETECTION": [
        "fraud", "unauthorized", "suspicious", "transaction", "charge",
        "account", "security", "stolen", "identity", "access",
    ],
    "UX_ISSUES": [
        "app", "website", "interface", "login", "crash", "slow",
        "error", "navigation", "portal", "banking",
    ],
}

# Raw-feed product name -> category (exact match; unmapped rows are dropped).
CATEGORY_MAP: dict[str, str] = {
    "retail_banking": "ATM_FAILURE",
    "credit_card": "FRAUD_DETECTION",
    "debt_collection": "FRAUD_DETECTION",
    "credit_reporting": "UX_ISSUES",
    "mortgages_and_loans": "UX_ISSUES",
    "Checking or savings account": "ATM_FAILURE",
    "Bank account or service": "ATM_FAILURE",
    "Prepaid card": "ATM_FAILURE",
    "Money transfers": "ATM_FAILURE",
    "Money transfer, virtual currency, or money service": "ATM_FAILURE",
    "Credit card": "FRAUD_DETECTION",
    "Credit card or prepaid card": "FRAUD_DETECTION",
    "Debt collection": "FRAUD_DETECTION",
    "Identity theft / Fraud / Embezzlement": "FRAUD_DETECTION",
    "Payday loan": "FRAUD_DETECTION",
    "Payday loan, title loan, or personal loan": "FRAUD_DETECTION",
    "Mortgage": "UX_ISSUES",
    "Student loan": "UX_ISSUES",
    "Consumer loan": "UX_ISSUES",
    "Vehicle loan or lease": "UX_ISSUES",
    "Credit reporting": "UX_ISSUES",
    "Credit reporting, credit repair services, or other personal consumer reports": "UX_ISSUES",
    "Other financial service": "UX_ISSUES",
}

# Severity keyword tiers (first matching tier wins; otherwise "low").
SEVERITY_TIERS: list[tuple[str, list[str]]] = [
    ("critical", ["fraud", "stolen", "unauthorized", "identity theft", "scam",
                  "criminal", "illegal", "stole", "hack"]),
    ("high", ["urgent", "immediately", "emergency", "cannot access", "locked out",
              "suspended", "blocked", "threatening", "lawsuit"]),
    ("medium", ["weeks", "months", "repeated", "multiple times", "still waiting",
                "no response", "ignored", "unresolved", "never"]),
]
SEVERITY_DEFAULT = "low"

# Emotion keyword tiers (first matching tier wins; otherwise "frustrated").
EMOTION_TIERS: list[tuple[str, list[str]]] = [
    ("angry", ["fraud", "steal", "unauthorized", "scam", "stolen"]),
    ("frustrated", ["disappointed", "terrible", "awful", "horrible"]),
    ("confused", ["confus", "don't understand", "unclear"]),
    ("anxious", ["please", "help", "need", "urgent"]),
]
EMOTION_DEFAULT = "frustrated"

# Raw-feed optional columns: output name -> candidate input names, first wins.
OPTIONAL_FEED_COLUMNS: list[tuple[str, list[str]]] = [
    ("customer_name", ["Consumer name", "consumer_name"]),
    ("location", ["State", "state"]),
    ("channel", ["Submitted via", "submitted_via"]),
    ("customer_id", ["Complaint ID", "complaint_id"]),
    ("specific_issue", ["Issue", "issue"]),
]

# Label domains.
CATEGORIES = ["ATM_FAILURE", "FRAUD_DETECTION", "UX_ISSUES"]
SEVERITIES = ["low", "medium", "high", "critical"]
EMOTIONS = ["angry", "anxious", "confused", "frustrated"]
STATUSES = ["open", "in_progress", "resolved", "closed"]

# Sentinels used when a label is missing and no prediction is available.
MISSING_LABEL_DEFAULTS = {"category": "UNKNOWN", "severity": "medium", "emotion": "neutral"}
# Defaults used by the seeding path when a prepared column is absent.
SEED_LABEL_DEFAULTS = {"category": "UX_ISSUES", "severity": "medium", "emotion": "frustrated"}

# Spellings the pandas CSV reader treats as missing (case-sensitive).
CSV_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# English stop words: the default list of Spark ML's StopWordsRemover (Apache License 2.0),
# stated here so that no file of the Spark installation is read.
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which
    who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will
    just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
    they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
    wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
    shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
""".split()

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------
