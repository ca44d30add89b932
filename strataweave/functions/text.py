"""Text expressions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space, for a regular expression's class.
WHITE_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return F.coalesce(~c.rlike(f"[^{WHITE_SPACE}]"), F.lit(True))


def word_count(c: Column) -> Column:
    """Runs of characters other than Unicode white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{WHITE_SPACE}]+")), F.lit(0))


def project_key(c: Column) -> Column:
    """Project names compare without regard to case and surrounding spaces."""
    return F.lower(trimmed(c))


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)
