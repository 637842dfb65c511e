"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: all Unicode white space and the separators U+001C to U+001F.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def rel_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance by the longer length; 0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / F.when(longest == 0, 1).otherwise(longest))


def matches_start(text: Column, pattern: str) -> Column:
    """The pattern matches at the start; digits and letters are those of Unicode."""
    return text.rlike(rf"(?U)\A(?:{pattern})")


def found_in(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?U){pattern}")


def label_equals(text: Column, label: str) -> Column:
    """Equality without blanks."""
    return F.replace(text, F.lit(" "), F.lit("")) == label
