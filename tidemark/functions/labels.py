"""Labels of counterparties and accounts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.names import name_similarity

#: Patterns of labels that are not names, and the spacing of known brands.
SLUDGE = r"(?i)^(INV-\d+|Payment\s+for\s+invoice|Invoice\s+#?\d*)$"
TEST = r"(?i)(\s+test$|\btest\b)"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PAYMENT = r"(?i)/?\s*Payment\s+(\d+)\s*(.*)$"
TEAM = r"(?i)^(.+?)\s*TEAM\s*\d+"
INVOICE = r"(?i)(?:INV|Invoice)\s*#?\s*(\d+)"
DELETED = r"(?i)\s*\(deleted\)\s*$"
BRANDS = [(r"(?i)\bQuick\s+Books\b", "QuickBooks"), (r"(?i)\bDocu\s*Sign\b", "DocuSign"), (r"(?i)\bMac\s+Lean\b", "MacLean"), (r"(?i)\bHuman\s+N\s+Professional\b", "Human N Professional")]
#: Words that say nothing about who a counterparty is.
STOPWORDS = (
    "inc", "llc", "ltd", "corp", "co", "company", "the", "and", "of",
    "for", "services", "service", "solutions", "group", "international", "global", "consulting", "management", "enterprises", "holdings", "partners",
    "city", "team", "west", "east", "north", "south", "tech", "data", "home", "care", "blue", "state", "food", "foods", "sports", "sport",
)


def split_camel(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def match_form(s: Column) -> Column:
    """Lower-case letters and digits alone; a null counts as empty."""
    return F.regexp_replace(F.lower(split_camel(F.coalesce(s, F.lit("")))), "[^a-z0-9]", "")


def alias_match(a: Column, b: Column) -> Column:
    """Equal forms, one within the other, or a common start of 85 percent of the shorter; forms below three characters only match if equal."""
    x, y = match_form(a), match_form(b)
    shorter = F.least(F.length(x), F.length(y))
    start = F.ceil(shorter * 85 / 100).cast("int")
    return (x == y) | ((shorter >= 3) & (x.contains(y) | y.contains(x) | (F.substring(x, F.lit(1), start) == F.substring(y, F.lit(1), start))))


def is_sludge(s: Column) -> Column:
    return F.coalesce(F.trim(s).rlike(SLUDGE), F.lit(False))


def is_test(s: Column) -> Column:
    return F.trim(s).rlike(TEST)


def is_clean(s: Column) -> Column:
    """A label of two characters or more that is no address, invoice text or test."""
    return F.coalesce((F.length(s) >= 2) & ~s.rlike(EMAIL) & ~s.rlike(SLUDGE) & ~is_test(s), F.lit(False))


def is_owner(s: Column, owner: Column) -> Column:
    """Whether one of a label and an owner's name holds the other."""
    x, y = match_form(s), match_form(owner)
    return (F.length(x) >= 2) & (F.length(y) > 0) & (x.contains(y) | y.contains(x))


def clean_display(s: Column) -> Column:
    out = split_camel(F.trim(F.regexp_replace(s, DELETED, "")))
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\b([a-z])([A-Z][a-z])", "$1 $2"), r"\b([A-Z][a-z]+)([A-Z][a-z])", "$1 $2")
    return reduce(lambda c, b: F.regexp_replace(c, *b), BRANDS, F.trim(out))


def display_label(raw: Column, preferred: Column, owner: Column) -> Column:
    """The preferred label if it is clean, else the raw one; owners are called Owner, and what is no name a dash."""
    ours = lambda s: F.coalesce(is_owner(s, owner), F.lit(False))
    return (
        F.when(is_clean(preferred), F.when(ours(preferred), "Owner").otherwise(clean_display(preferred)))
        .when(raw.isNull() | (raw == "") | is_test(raw) | is_sludge(raw), "—").when(ours(raw), "Owner").otherwise(clean_display(raw))
    )


def entity_of_descriptor(raw: Column) -> Column:
    """The name in a bank's text, with its invoice number in brackets; null where there is none."""
    s = F.trim(raw)
    paid = F.regexp_extract(s, PAYMENT, 1)
    number = F.when(paid != "", paid).otherwise(F.regexp_extract(s, INVOICE, 1))
    part = F.trim(F.regexp_replace(s, PAYMENT, ""))
    team = F.regexp_extract(part, TEAM, 1)
    part = F.when(team != "", F.trim(team)).otherwise(part)
    title = F.array_join(F.transform(F.split(part, r"[\s/]+"), lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    part = F.when((part == F.upper(part)) & (F.length(part) > 2), title).otherwise(part)
    part = F.when(part == "", "Customer").otherwise(part)
    return F.when((F.length(s) >= 2) & ~is_sludge(s) & (F.length(part) >= 2), F.concat(part, F.when(number != "", F.concat(F.lit(" (Invoice "), number, F.lit(")"))).otherwise("")))


def account_label(raw: Column, kind: Column, subtype: Column) -> Column:
    """A bank account's name for people."""
    s, t, u = F.trim(raw), F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(subtype, F.lit("")))
    every = F.lower(F.concat_ws(" ", s, t, u))
    short = r"^([^:]+)(?::.*?)?\s*\((\d{4})\)"
    return (
        F.when(s.isNull() | (s == ""), "External / unlinked account")
        .when(s.rlike(r"(?i)\bparent\s*account\b") | ((t == "credit") & s.rlike("(?i)parent|personal")), "Owner credit card")
        .when((t == "credit") | (u == "credit card"), "Credit card")
        .when((u == "checking") | ((t == "depository") & every.rlike("check")), "Business checking")
        .when(u.isin("savings", "money market") | every.rlike(r"savings|money\s*market|mma"), "Business MMA")
        .when(t == "depository", "Business checking")
        .when(s.rlike(short), F.concat(F.trim(F.regexp_extract(s, short, 1)), F.lit(" ("), F.regexp_extract(s, short, 2), F.lit(")")))
        .when(F.length(s) > 40, F.concat(F.substring(s, 1, 37), F.lit("...")))
        .otherwise(s)
    )


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\w\s]", " "), r"\s+", " "))


def _words(plain: Column, longer_than: int, stop: tuple[str, ...]) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(plain, " "), lambda w: F.length(w) > longer_than)), F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"))


def name_parts(s: Column) -> Column:
    """A name without punctuation, its telling words, and all its words of more than a letter: what both rules compare, worked out once a row."""
    plain = _plain(s)
    return F.struct(plain.alias("plain"), _words(plain, 2, STOPWORDS).alias("telling"), _words(plain, 1, ()).alias("words"))


def receivable_parts_match(a: Column, b: Column) -> Column:
    x, y, u, v = a["plain"], b["plain"], a["telling"], b["telling"]
    both, least = F.size(F.array_intersect(u, v)), F.least(F.size(u), F.size(v))
    within = (F.length(x) >= 8) & (F.length(y) >= 8) & (x.contains(y) | y.contains(x))
    return (x != "") & (y != "") & ((x == y) | within | ((least >= 2) & (both >= 2) & (2 * both >= least)))


def receivable_names_match(a: Column, b: Column) -> Column:
    """Equal names, one of eight characters or more within the other, or two telling words and half of the fewer in common."""
    return receivable_parts_match(name_parts(a), name_parts(b))


def payable_parts_match(a: Column, b: Column) -> Column:
    x, y, u, v = a["plain"], b["plain"], a["words"], b["words"]
    both = F.size(F.array_intersect(u, v))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | (both >= F.least(F.size(u), F.size(v), F.lit(2))))


def payable_names_match(a: Column, b: Column) -> Column:
    """The looser rule for vendors: one name within the other, or two words in common (all of the fewer, if that is one)."""
    return payable_parts_match(name_parts(a), name_parts(b))


def entity_match(description: Column, name: Column, aliases: Column, threshold: float = 0.80) -> Column:
    """match, score and method: direct similarity, the first alias that reaches the threshold, or one name within the other.

    Equal names are wholly alike. Each similarity is worked out once (a list of one value stands for a name given to it), and aliases only where the name does not do.
    """
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    x, y = F.trim(F.lower(description)), F.trim(F.lower(name))
    out = lambda ok, score, how: F.struct(F.lit(ok).alias("match"), score.cast("double").alias("score"), F.lit(how).alias("method"))
    inside = lambda direct: (
        F.when((F.length(y) >= 4) & x.contains(y), out(True, F.lit(0.88), "contains")).when((F.length(y) >= 4) & y.contains(x), out(True, F.lit(0.85), "contains_reverse")).otherwise(out(False, direct, "none"))
    )
    first = F.get(F.filter(F.transform(aliases, lambda a: name_similarity(description, a)), lambda s: s >= threshold), F.lit(0))
    by_alias = lambda direct: once(first, lambda s: F.when(s.isNotNull(), out(True, s, "alias")).otherwise(inside(direct)))
    return F.when(x == y, out(True, F.lit(1.0), "direct")).otherwise(once(name_similarity(description, name), lambda direct: F.when(direct >= threshold, out(True, direct, "direct")).otherwise(by_alias(direct))))
