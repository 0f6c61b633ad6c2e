"""Every constant whose exact value decides a result.

Nothing here is logic. Patterns are written once, in the common regex notation
with ``\\b``, ``\\d`` and ``\\s``; ``leaksieve.dialect`` gives those three their
profile-specific meaning.
"""

from __future__ import annotations

# The twelve detection rules, in registry order.
# (key, label, category, severity, confidence)
RULE_ROWS = (
    ("email", "Email Address", "PII", "medium", "MEDIUM"),
    ("phone_in", "Indian Phone Number", "PII", "medium", "MEDIUM"),
    ("pan", "PAN Card (India)", "PII", "high", "HIGH"),
    ("aadhaar", "Aadhaar Card (India)", "PII", "high", "HIGH"),
    ("passport", "Passport Number", "PII", "high", "MEDIUM"),
    ("credit_card", "Credit / Debit Card", "PII", "high", "HIGH"),
    ("api_key", "API Key / Token", "Secrets", "critical", "LOW"),
    ("aws_access", "AWS Access Key ID", "Secrets", "critical", "HIGH"),
    ("aws_secret", "AWS Secret Access Key", "Secrets", "critical", "MEDIUM"),
    ("jwt", "JWT Token", "Secrets", "critical", "HIGH"),
    ("password", "Password / Secret (hard-coded)", "Secrets", "critical", "LOW"),
    ("db_conn", "Database Connection String", "Secrets", "critical", "MEDIUM"),
)

# Patterns. A leading (?i) marks a case-insensitive rule.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "phone_in": r"(?<![0-9])(?:\+91[\-\s]?|91[\-\s]?|0)?[6-9]\d{9}(?![0-9])",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "aadhaar": r"(?<![0-9])[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}(?![0-9])",
    "passport": r"\b[A-Z][1-9]\d{6}\b",
    "credit_card": r"(?<!\d)(?:4\d{3}|5[1-5]\d{2}|6\d{3}|3[47]\d{2}|3(?:0[0-5]|[68]\d)\d|(?:50|5[6-9]|6\d)\d{2})[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7}(?!\d)",
    "api_key": r"""(?i)(?:api[_-]?key|apikey|api secret|access[_\-]?key)[\s:=]+["']?([A-Za-z0-9_\-]{16,})["']?""",
    "aws_access": r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASCA)[0-9A-Z]{16}\b",
    "aws_secret": r"""(?i)(?:aws[_-]?secret[_-]?access[_-]?key|aws[_-]?secret)[\s:=]+["']?([A-Za-z0-9/+=]{40})["']?""",
    "jwt": r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b",
    "password": r"""(?i)(?:password|passwd|pwd|secret|token|private[_\-]?key)[\s:=]+["']?([^\s"',;]{8,})["']?""",
    "db_conn": r"""\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|mssql|oracle|sqlite|amqp|amqps)://[^\s"'<>]{6,}\b""",
}

# The rules whose pattern the browser profile reads case-insensitively.
BROWSER_IGNORE_CASE = ("db_conn",)

# Severity weights, and the weight of a key without one.
WEIGHTS = {
    "aadhaar": 35,
    "pan": 30,
    "passport": 30,
    "credit_card": 30,
    "aws_access": 30,
    "aws_secret": 30,
    "api_key": 25,
    "jwt": 25,
    "db_conn": 25,
    "password": 20,
    "phone_in": 15,
    "email": 10,
}
DEFAULT_WEIGHT = 10

# Confidence factors, and the factor of any other confidence.
CONFIDENCE_FACTORS = {"HIGH": "1.0", "MEDIUM": "0.7", "LOW": "0.4"}
DEFAULT_FACTOR = "0.7"

# Volume tiers (lowest count, highest count, multiplier), then the rest.
VOLUME_TIERS = ((0, 0, "0.0"), (1, 1, "1.0"), (2, 5, "1.3"), (6, 20, "1.6"), (21, 100, "2.0"))
VOLUME_ABOVE = "2.5"

# Co-occurrence bonus by number of active data types.
BONUS_ONE, BONUS_TWO, BONUS_MANY = 0, 5, 12

# Highest score of each risk level, then the level above them.
LEVELS = ((29, "LOW"), (59, "MEDIUM"), (84, "HIGH"))
LEVEL_ABOVE = "CRITICAL"
MAX_SCORE = 100

# Redaction and sampling.
MAX_SAMPLES = 3
REDACT_SHORT = 6

# Verhoeff multiplication and permutation tables.
VERHOEFF_D = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 2, 3, 4, 0, 6, 7, 8, 9, 5),
    (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7),
    (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2),
    (7, 6, 5, 9, 8, 2, 1, 0, 4, 3),
    (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_P = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 5, 7, 6, 2, 8, 3, 0, 9, 4),
    (5, 8, 0, 3, 7, 9, 6, 1, 4, 2),
    (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0),
    (4, 2, 8, 6, 5, 7, 3, 9, 0, 1),
    (2, 7, 9, 3, 8, 0, 6, 4, 1, 5),
    (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)
AADHAAR_DIGITS = 12
CARD_MIN_DIGITS = 13

# What the input gates say, by profile.
GATE_TEXTS_BACKEND = {
    "type": "Unsupported file type '.{extension}'. Allowed: {allowed}",
    "size": "File too large ({size} bytes). Maximum allowed size is {limit} bytes ({limit_mb}).",
    "empty": "Uploaded file is empty.",
}
GATE_TEXTS_BROWSER = {
    "type": "Unsupported file type. Allowed: {allowed}",
    "size": "File too large ({size}). Maximum is {limit_mb}.",
    "empty": "Uploaded file is empty.",
}
# Input gates.
ALLOWED_EXTENSIONS = ("csv", "docx", "pdf", "txt")
ALLOWED_EXTENSIONS_BROWSER = ("txt", "csv", "pdf", "docx")
TEXT_EXTENSIONS = ("txt", "csv")
MAX_BYTES = 10 * 1024 * 1024
DEFAULT_CONTENT_TYPE = "application/octet-stream"
MAX_FILENAME = 255

# Recommendation texts, backend profile.
ADVICE_BACKEND = {
    "email": "Email addresses detected – classify dataset as Personally Identifiable Information (PII) under GDPR / DPDP Act and implement access controls.",
    "phone_in": "Indian phone numbers detected – ensure consent records exist per DPDP Act 2023 and restrict access to authorised personnel only.",
    "pan": "PAN card numbers found – this is sensitive financial PII under the IT Act. Encrypt at rest (AES-256) and enable field-level audit logging.",
    "aadhaar": "Aadhaar numbers discovered – UIDAI regulations strictly prohibit storage of Aadhaar numbers unless absolutely necessary. Anonymize or tokenize immediately.",
    "passport": "Passport numbers detected – treat as high-sensitivity travel identity data and notify your DPO (Data Protection Officer).",
    "credit_card": "Payment card data detected – verify PCI-DSS compliance scope, ensure PAN is masked, and confirm tokenization is in place.",
    "api_key": "Hard-coded API keys found – rotate credentials immediately via your provider dashboard and move them to a secrets manager (Vault / AWS Secrets Manager / environment variables).",
    "aws_access": "AWS Access Key IDs detected – treat as CRITICAL. Rotate keys NOW, review CloudTrail for abuse, and enforce IAM least-privilege.",
    "aws_secret": "AWS Secret Access Keys exposed – IMMEDIATELY rotate, invalidate any active sessions, and audit S3 / resource access for the last 90 days.",
    "jwt": "JWT tokens discovered – revoke the signing key/secret, invalidate active sessions, and ensure tokens are never logged in plaintext.",
    "password": "Hard-coded passwords/secrets detected – migrate to a secrets vault, force credential rotation, and implement pre-commit secret scanning.",
    "db_conn": "Database connection strings with embedded credentials found – move credentials to environment variables or a secrets manager and rotate database passwords.",
}
ADVICE_ALWAYS_BACKEND = (
    "Implement continuous automated secret scanning in CI/CD pipelines (e.g., GitLeaks, TruffleHog).",
    "Educate engineering teams on secure handling of PII and secrets via mandatory security training.",
)

# Recommendation texts, browser profile.
ADVICE_BROWSER = {
    "email": "Email addresses detected – classify dataset as PII under GDPR / DPDP Act and implement access controls.",
    "phone_in": "Indian phone numbers detected – ensure consent records exist per DPDP Act 2023.",
    "pan": "PAN card numbers found – sensitive financial PII. Encrypt at rest (AES-256) and enable audit logging.",
    "aadhaar": "Aadhaar numbers discovered – UIDAI regulations restrict storage. Anonymize or tokenize immediately.",
    "passport": "Passport numbers detected – treat as high-sensitivity identity data and notify your DPO.",
    "credit_card": "Payment card data detected – verify PCI-DSS compliance, ensure PAN masking and tokenization.",
    "api_key": "Hard-coded API keys found – rotate credentials immediately and move to secrets manager.",
    "aws_access": "AWS Access Key IDs detected – CRITICAL. Rotate keys now, review CloudTrail, enforce least-privilege.",
    "aws_secret": "AWS Secret Keys exposed – immediately rotate, invalidate sessions, audit AWS access for 90 days.",
    "jwt": "JWT tokens discovered – revoke signing key, invalidate sessions, never log tokens in plaintext.",
    "password": "Hard-coded passwords detected – migrate to secrets vault, force rotation, add pre-commit scanning.",
    "db_conn": "Database connection strings with credentials found – move credentials to env vars, rotate passwords.",
}
ADVICE_ALWAYS_BROWSER = (
    "Implement continuous automated secret scanning in CI/CD pipelines (GitLeaks, TruffleHog).",
    "Educate engineering teams on secure handling of PII and secrets via mandatory security training.",
)

# The coverage listing (rule, short label, category, confidence), in display order.
COVERAGE_ROWS = (
    ("email", "Email", "PII", "MED"),
    ("phone_in", "Phone (India)", "PII", "MED"),
    ("pan", "PAN Card", "PII", "HIGH"),
    ("aadhaar", "Aadhaar", "PII", "HIGH"),
    ("passport", "Passport", "PII", "MED"),
    ("credit_card", "Credit Card", "PII", "HIGH"),
    ("api_key", "API Keys", "Secret", "LOW"),
    ("aws_access", "AWS Keys", "Secret", "HIGH"),
    ("jwt", "JWT Tokens", "Secret", "HIGH"),
    ("password", "Passwords", "Secret", "LOW"),
    ("db_conn", "DB Strings", "Secret", "MED"),
    ("aws_secret", "AWS Secrets", "Secret", "MED"),
)
