"""Contact-list hygiene and pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import as_col

# --- fixed values ----------------------------------------------------------
EMAIL_PATTERN = r"(?i)^[^@\s]+@[^@\s]+\.[^@\s]+$"
EMAIL_MAX = 254


def contact_hygiene(contacts: DataFrame) -> DataFrame:
    """Trimmed lower-case addresses that look like one, each once, at its first sign-up."""
    email = F.lower(F.trim("email"))
    return (contacts.select(email.alias("email"), "created_at")
            .filter((F.length("email") <= EMAIL_MAX) & F.col("email").rlike(EMAIL_PATTERN))
            .groupBy("email").agg(F.min("created_at").alias("created_at"), F.count("*").alias("signups")))


def pseudonym(c: Column | str) -> Column:
    """SHA-256 of an identifier, in hex."""
    return F.sha2(as_col(c).cast("string"), 256)
