"""Word lists, patterns, thresholds and formats that results depend on.

They are kept together so that Spark expressions and the SQL used to check them read the same source.
"""

# Clause taxonomy, in its declared order.
LABELS = (
    "obligation",
    "permission",
    "prohibition",
    "definition",
    "reporting_requirement",
    "record_retention_requirement",
    "non_obligation",
)

# Every character Python's str.split() treats as white space (Java's \s is ASCII only). Characters up to 255 are listed
# one by one, which the regex engine keeps as a bitmap.
WS = (
    r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x{85}\x{A0}"
    r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_NOT_NEWLINE = WS.replace(r"\x0A", "")
# The same set with the rare characters behind one range test, in Java's class syntax.
WS_FAST = (
    r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x{85}\x{A0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
)
WS_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

TOKEN = r"[a-z0-9]+"
SENTENCE_BOUNDARY = r"(?<=[.!?])\s+(?=[A-Z0-9])"

SECTION_HEADING = r"(?i)^((?:section\s+)?\d+(?:\.\d+)*[A-Za-z]?)\s*[-–—.:]?\s+(\S.*)$"

# Binding language: subject, modal verb, action.
MODALITY = (
    r"(?i)\b([A-Z][A-Za-z0-9 &'()/-]{1,100}?)\s+"
    r"(must\s+not|shall\s+not|must|shall|(?:is|are)\s+required\s+to)\s+"
    r"([^.!?]+)"
)
DEADLINE = (
    r"(?i)\b(?:within\s+\d+\s+(?:hours?|days?|business\s+days?|months?|years?)|"
    r"no\s+later\s+than\s+[^,.;]+|by\s+(?:the\s+)?[^,.;]+|"
    r"(?:daily|weekly|monthly|quarterly|annually))\b"
)
MODALITIES = {
    "must": "must",
    "must not": "must_not",
    "shall": "shall",
    "shall not": "shall_not",
    "is required to": "required_to",
    "are required to": "required_to",
}
EXTRACTION_METHOD = "deterministic-rules-v1"

# Confidence: base score, the increments of each rule, the cap, and the calibration bins (upper bound, value).
RULE_SCORES = {
    "base": 0.72,
    "action_phrase": 0.08,
    "temporal_constraint": 0.10,
    "explicit_prohibition": 0.04,
    "cap": 0.98,
}
CALIBRATION_POLICY = "obligation-calibration-v1"
CALIBRATION_BINS = ((0.819, 0.727), (0.869, 0.800), (1.0, 0.875))
REVIEW_THRESHOLD = 0.80

# Sampling strata: the first pattern that matches names the stratum.
STRATA = (
    (
        "record_retention_requirement",
        r"(?i)\b(retain|retention|keep|preserve|maintain).{0,50}\b(record|document|information|year|month)",
    ),
    ("prohibition", r"(?i)\b(shall not|must not|may not|no person shall|prohibited|forbidden)\b"),
    (
        "reporting_requirement",
        r"(?i)\b(report|notify|notification|file|submit|disclose|return|statement)\b",
    ),
    ("permission", r"(?i)\b(may|is authorized to|is entitled to|permission)\b"),
    ("definition", r"(?i)\b(means|includes|refers to|is defined as)\b"),
    ("obligation", r"(?i)\b(must|shall|required to|is to)\b"),
)
SAMPLING_POLICY = "clause-pilot-v1"
GUIDELINE_VERSION = "clause-guideline-v1"

AWARE_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})$"

# Control mapping.
MAPPING_METHOD = "token-overlap-v1"
EXPLANATION_STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with")
MAPPING_LIMIT = 3
AMBIGUITY_GAP = 0.08
SUGGESTED_MINIMUM = 0.12

REVIEW_DECISIONS = ("accepted", "rejected", "deferred", "confirmed_unmapped")
WORKFLOW_DECISIONS = ("approved", "rejected", "changes_requested")
WORKFLOW_CONFIDENCE_GATE = 0.70

# Retrieval.
EMBEDDING_DIMENSIONS = 384
EMBEDDING_MODEL = "feature-hash-384-v1"
RRF_K = 60
RRF_DEPTH = 50

# Promotion policy.
PROMOTION = {
    "examples": 500,
    "documents": 25,
    "regulators": 3,
    "macro_f1": 0.75,
    "per_class_f1": 0.55,
    "covered_accuracy": 0.85,
    "expected_calibration_error": 0.10,
    "coverage": 0.60,
}
EXAMPLES_PER_CLASS = 30
NEAR_DUPLICATE = 0.9

# Labelling slots: prompt version and the order in which labels are offered.
# This library's own wording of what each label stands for.
LABEL_RULES = {
    "obligation": "any other action that someone is bound to take",
    "permission": "conduct that is allowed or left to choice in so many words",
    "prohibition": "conduct that is forbidden in so many words",
    "definition": "what a term means or covers",
    "reporting_requirement": "a named party has to hand in, announce or disclose information",
    "record_retention_requirement": "records have to be made and kept",
    "non_obligation": "procedure, proof, enforcement, penalties, exemptions, transitions and plain description",
}
REQUEST_SCHEMA = "clause-label-request-1"
SLOTS = {
    "A": (
        "clause-label-a-1",
        "reporting_requirement, record_retention_requirement, prohibition, permission, "
        "definition, obligation, non_obligation",
    ),
    "B": (
        "clause-label-b-1",
        "definition, prohibition, permission, record_retention_requirement, "
        "reporting_requirement, obligation, non_obligation",
    ),
    "C": (
        "clause-label-c-1",
        "prohibition, definition, reporting_requirement, permission, "
        "record_retention_requirement, non_obligation, obligation",
    ),
}
SILVER_MINIMUM_CONFIDENCE = 0.80
SILVER_TRAINING_MINIMUM = 500
ADJUDICATION_REASONS = (
    "annotation_error",
    "guideline_interpretation",
    "scope_resolution",
    "taxonomy_boundary",
    "other_governed_reason",
)

# Rights review.
RIGHTS_CHECKS = (
    "authoritative_source_confirmed",
    "licence_scope_reviewed",
    "attribution_plan_confirmed",
    "accuracy_disclaimer_confirmed",
    "no_official_status_claim_confirmed",
    "portfolio_assignment_confirmed",
)

# Operations.
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
TRACEPARENT = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
RATE_LIMITS = {"all": 120, "search": 30}
OUTBOX_ATTEMPTS = 10

# Credential patterns (category, pattern, group that is the evidence).
SECRET_PATTERNS = (
    ("private_key_material", r"-----BEGIN(?: [A-Z0-9]+)? PRIVATE KEY-----"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b"),
    ("bearer_token", r"\bBearer\s+[A-Za-z0-9._~+/=-]{20,}\b"),
)
SECRET_ASSIGNMENT = (
    r"(?im)^\s*(?:export\s+)?"
    r"([A-Z][A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|API_KEY|PRIVATE_KEY)[A-Z0-9_]*)"
    r"\s*=\s*[\"']?([^\"'\s#]+)"
)
PLACEHOLDER_VALUES = (
    "", "changeme", "example", "false", "none", "placeholder", "redacted", "test", "true",
)
SCAN_VERSION = "secret-scan-v1"
SCAN_MAX_BYTES = 1_000_000

PDF_SIGNATURE = "%PDF-"
HTML_PREFIXES = ("<!doctype html", "<html", "<?xml")
