"""Regular expressions and lookup values shared by the PII operators.

Patterns are kept to the subset that Java regex (Spark) and RE2 (DuckDB)
read the same way.  Case-insensitive patterns carry an inline ``(?i)``.
"""
from __future__ import annotations

# Content patterns, column-name rules, sensitivity, actions and
# risk weights of the reference PII scanner.
EMAIL = r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?i)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\d{10,15})"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7,19}\b"
IP_ADDRESS = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
# Card candidates: 15-16 digits with optional single space/dash separators.  The
# reference writes this as (?:\d[ -]?){15,16}; anchoring on a digit at both ends
# finds the same digit runs but never swallows a trailing separator, which Java
# and RE2 would otherwise treat differently next to non-ASCII letters.
CREDIT_CARD = r"\b\d(?:[ -]?\d){14,15}\b"

NAME_COLS = r"(?i)\b(full_?name|first_?name|last_?name|name)\b"
ADDRESS_COLS = r"(?i)\b(address|street|city|postal|zip)\b"
DOB_COLS = r"(?i)\b(dob|date_?of_?birth|birth_?date|birthdate)\b"
NATIONAL_ID_COLS = r"(?i)\b(ssn|national_?id|id_?number|sin)\b"

# name rules in priority order
NAME_RULES = [(NAME_COLS, "NAME"), (DOB_COLS, "DATE_OF_BIRTH"),
              (NATIONAL_ID_COLS, "NATIONAL_ID"), (ADDRESS_COLS, "ADDRESS")]

SENSITIVITY = {
    "EMAIL": "high", "PHONE": "high", "SSN": "high", "CREDIT_CARD": "high", "IBAN": "high",
    "NATIONAL_ID": "high", "DATE_OF_BIRTH": "medium", "NAME": "medium", "ADDRESS": "medium",
    "IP_ADDRESS": "low",
}
ACTION = {
    "EMAIL": "mask", "PHONE": "mask", "SSN": "hash", "CREDIT_CARD": "encrypt", "IBAN": "encrypt",
    "NATIONAL_ID": "hash", "DATE_OF_BIRTH": "pseudonymize", "NAME": "pseudonymize",
    "ADDRESS": "mask", "IP_ADDRESS": "mask",
}
RISK_WEIGHT = {"high": 3, "medium": 2, "low": 1}

CONTENT_PATTERNS = {"EMAIL": EMAIL, "SSN": SSN, "IBAN": IBAN, "IP_ADDRESS": IP_ADDRESS,
                    "PHONE": PHONE, "CREDIT_CARD": CREDIT_CARD}
# scan order of the reference (phone before cards) and ours (cards before phone, quirk Q3)
STRICT_ORDER = ["EMAIL", "SSN", "IBAN", "IP_ADDRESS", "PHONE", "CREDIT_CARD"]
DEFAULT_ORDER = ["EMAIL", "SSN", "IBAN", "IP_ADDRESS", "CREDIT_CARD", "PHONE"]
# redaction order for free text: most specific first
REDACT_ORDER = ["EMAIL", "SSN", "IBAN", "CREDIT_CARD", "IP_ADDRESS", "PHONE"]
