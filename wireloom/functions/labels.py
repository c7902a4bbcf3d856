"""Turning free-text flow labels into flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label patterns. `_` is a word character, so `from_botnet` is a
# botnet flag but not a binary-label word.
FROM_BOTNET = r"from[-_]?botnet"
TO_BOTNET = r"to[-_]?botnet"
ANY_BOTNET = r"botnet"
MALICIOUS_WORDS = r"\b(bot|botnet|cnc|c&c|malware|infected|attack|spam|ddos|trojan|worm|zombie|backdoor)\b"

# Spark would also read '1d' or 'NaN' as numbers.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*\z"


def has_text(label: Column, pattern: str) -> Column:
    """Case-insensitive search that is false, not null, on a missing label."""
    return F.coalesce(F.lower(label).rlike(pattern), F.lit(False))


def cnc_label(label: Column) -> Column:
    """1 for traffic to a botnet controller, else 0."""
    return has_text(label, TO_BOTNET).cast("int")


def binary_label(label: Column) -> Column:
    """1 for malicious: a number of at least 0.5, or text holding a malicious word."""
    number = F.when(label.rlike(NUMBER_TEXT), label.try_cast("double"))
    # A number too large for a double is no number: only a spelled-out infinity is infinite.
    overflow = (F.abs(number) == float("inf")) & ~F.lower(label).contains("inf")
    by_number = F.when(~overflow, (number >= 0.5).cast("int"))
    by_word = label.rlike("(?iU)" + MALICIOUS_WORDS).cast("int")
    return F.coalesce(by_number, by_word, F.lit(0))
