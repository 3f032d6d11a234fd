"""Text expressions. Patterns keep to what Java and RE2 share: no look-around, no back-references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SEPARATOR = r"[^\p{L}\p{N}-]+"

#: Words before, comparator, currency, number, k, unit; a number inside a word is none.
MEASURE = r"(?s)(.*?)\s*(<=|>=|<|>)?\s*(\$)?\b([0-9]+(?:\.[0-9]+)?)(?:(k)\b)?\s*(%|×|/?[A-Za-z]+(?:/[A-Za-z]+)?)?"
MEASURE_LEAD = r"^[^\p{L}\p{N}]+"

# Shapes of regulated data and of credentials.
DATA_CLASS_PATTERNS = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "payment_term": r"(?i)\b(iban|invoice|credit card|payment)\b",
    "health_term": r"(?i)\b(diagnosis|patient|prescription|allergy)\b",
}
SECRET_PATTERN = (
    r"""(?i)\b(?:api[_-]?key|token|secret|password|passwd)\s*[=:]\s*["']?[A-Za-z0-9_/+.-]{8,}["']?"""
    r"|\bAKIA[0-9A-Z]{16}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)


# Lower-case strings of which every match of the pattern contains at least one.
DATA_CLASS_HINTS = {
    "mail": ["@"],
    "payment_term": ["iban", "invoice", "credit card", "payment"],
    "health_term": ["diagnosis", "patient", "prescription", "allergy"],
}
SECRET_HINTS = ["key", "token", "secret", "passw", "akia"]
DIGITS = "[0-9]{3}"


def tokens(text: Column) -> Column:
    """Lower-case words of a text in order; the first or last may be blank."""
    return F.split(F.lower(text), TOKEN_SEPARATOR)


def words(text: Column) -> Column:
    """The same without blanks."""
    return F.filter(tokens(text), lambda w: w != "")


def may_match(text: Column, hints: Sequence[str]) -> Column:
    """Cheap necessary condition for a pattern whose matches all contain one of the hints."""
    lowered = F.lower(text)
    return reduce(Column.__or__, [F.contains(lowered, F.lit(h)) for h in hints])


def count_matches(text: Column, pattern: str, hints: Sequence[str] = ()) -> Column:
    """Matches in the whole text. Texts without a hint (default: three digits in a row) skip the pattern."""
    possible = may_match(text, hints) if hints else text.rlike(DIGITS)
    return F.when(possible, F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("bigint")
