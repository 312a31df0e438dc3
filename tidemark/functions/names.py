"""Names and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, of trimmed lower-case names."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    most = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / most)


def tokens(name: Column) -> Column:
    """Distinct words of more than one letter or digit."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +"), lambda w: F.length(w) > 1))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words; two names without words are equal."""
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def name_similarity(a: Column, b: Column) -> Column:
    return 0.4 * edit_similarity(a, b) + 0.6 * token_similarity(a, b)


def match_key(name: Column) -> Column:
    """Lower-case letters and digits alone, after parting camel case."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]", "")


def same_entity(a: Column, b: Column, threshold: float = 0.85) -> Column:
    """Whether two names are one: equal or one within the other, whatever the case, or similar enough; an empty name is nobody's."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    return F.coalesce((a != "") & (b != "") & (x.contains(y) | y.contains(x) | (name_similarity(a, b) >= threshold)), F.lit(False))


def family_key(direction: Column, account: Column, text: Column) -> Column:
    """Direction, account and the text's first 40 characters, with long numbers made alike."""
    return F.concat_ws("|", direction, account, F.substring(F.regexp_replace(F.upper(text), "[0-9]{4,}", "NNNNN"), 1, 40))


def vendor_name(text: Column) -> Column:
    """Without wholesale marks, numbers and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "^sp | - wholesale$", ""), "[^a-z ]", ""))


# What bookkeeping adds to a name (invoice marks, months with a year, dates).
BOILERPLATE = (
    r"(?i)\b(?:invoices?inv|oices?inv|inv\.?)\b",
    r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*\d{0,4}\b",
    r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}",
)


def vendor_key(name: Column) -> Column:
    """Letters and digits of a name without bookkeeping's additions, in lower case."""
    for pattern in BOILERPLATE:
        name = F.regexp_replace(name, pattern, "")
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
