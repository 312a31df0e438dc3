"""Texts of banks: noise, references, processors, and whether a name is in them at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import names

# Phrases and patterns that scrubbing takes out of upper-case text, in their order.
NOISE = (
    "PREAUTHORIZED ACH CREDIT",
    "PREAUTHORIZED ACH DEBIT",
    "PREAUTHORIZED ACH",
    "MISCELLANEOUS DEBIT",
    "MISCELLANEOUS CREDIT",
    "ACCT-TO-ACCT TRANSFER",
    "ACCOUNT TO ACCOUNT TRANSFER",
    "INCOMING WIRE TRANSFER",
    "OUTGOING WIRE TRANSFER",
    "INCOMING WIRE",
    "OUTGOING WIRE",
    "WEBPAYMENT",
    "WEB PAYMENT",
    "EPAY",
    "ACH CREDIT",
    "ACH DEBIT",
    "AUTOMATIC TRANSFER",
    "ONLINE TRANSFER",
    "MOBILE TRANSFER",
)
LINKS = (r"HTTPS?:\/\/[^\s]+", r"WWW\.[^\s]+", r"ORDER\s*#?\s*[:#]?\s*[\dA-Z-]+", r"ORDER\s+ID\s*:\s*[\dA-Z-]+", r"ORDER\s+ID\s*[\dA-Z-]+", r"\bREF\s*#?\s*[\dA-Z]+\b", r"\bCONF\s*#?\s*[\dA-Z]+\b")
# What precedes the number of a document, an order or a check; texts of the bank itself, without a name; parts of names with the processor that they mean.
REFERENCES = (r"(?i)(?:inv|invoice|bill|ref|reference|#)[\s#]*(\d+)", r"(?i)(?:po|purchase order)[\s#]*(\d+)", r"(?i)(?:check|chk)[\s#]*(\d+)")
GENERIC = (
    r"(?i)^(mobile\s+deposit|deposit|wire transfer|incoming wire|transfer|zelle|ach credit|ach debit|preauthorized ach|preauth)",
    r"(?i)^(interest\s+(credit|paid)|miscellaneous\s+(credit|debit))",
    r"(?i)^(order\s+id\s*:?\s*\d+|order\s+#)",
    r"(?i)\b(bill\.com|shopify|paypal|venmo)\b",
    r"(?i)preauthorized\s+ach\s+(credit|debit)\s+\S+",
)
PROCESSORS = ("stripe", "square", "ach")
QUALIFIER = r"\s*\([^)]*\)\s*$"


def scrubbed(raw: Column) -> Column:
    """Upper-case text without links, order and reference numbers and the bank's phrases; one space between words."""
    out = reduce(lambda c, p: F.regexp_replace(c, p, " "), LINKS, F.upper(F.trim(raw)))
    out = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit(" ")), NOISE, out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def references(text: Column) -> Column:
    """The distinct numbers of invoices, orders and checks in a text, by kind and place."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in REFERENCES]
    return F.array_distinct(F.concat(*(F.coalesce(f, F.array().cast("array<string>")) for f in found)))


def has_name(text: Column) -> Column:
    """Whether a bank's text of three characters or more holds more than the bank's own words."""
    t = F.trim(text)
    generic = reduce(lambda a, b: a | b, (t.rlike(p) for p in GENERIC))
    return F.coalesce((F.length(t) >= 3) & ~generic, F.lit(False))


def without_qualifier(name: Column) -> Column:
    """A name without what stands in brackets at its end."""
    return F.trim(F.regexp_replace(name, QUALIFIER, ""))


def processor(counterparty: Column) -> Column:
    """The processor that a counterparty's name holds, or null."""
    low = F.lower(counterparty)
    return F.coalesce(*(F.when(low.contains(p), p) for p in PROCESSORS))


def domain(address: Column) -> Column:
    """The domain of an e-mail address or a link, in lower case and without www; null where there is none."""
    mail = F.lower(F.get(F.split(address, "@"), F.lit(1)))
    host = F.regexp_extract(F.lower(address), r"^(?:https?://)?(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.when(address.contains("@") & ~address.startswith("http"), F.nullif(mail, F.lit(""))).otherwise(F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit("")))


def case_similarity(a: Column, b: Column) -> Column:
    """How like two names are by their keys: equal, nine tenths of the shorter's share where one holds the other, else by edit distance; a missing name is like none."""
    x, y = names.match_key(a), names.match_key(b)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    like = F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), F.try_divide(short, long) * 0.9).otherwise(1 - F.try_divide(F.levenshtein(x, y), long))
    return F.when(a.isNull() | (a == "") | b.isNull() | (b == ""), 0.0).otherwise(like)
