"""Published values of names, labels, confidence and patterns, independent of any query's SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels, names
from tidemark.plans import profiles, state


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def text(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(("raw", "want"), [("Marten Oakhurstd", "martenoakhurstd"), ("Tove's Oven Food", "tovesovenfood"), ("  Harbor Chandlery!  ", "harborchandlery"), ("OrsolVint", "orsolvint"), ("", ""), (None, ""), ("Café #1", "caf1")])
def test_match_form(spark, raw, want):
    assert one(spark, labels.match_form(text(raw))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("OrsolVint", "Orsol Vint", True), ("Marten Oakhurstd", "Marten Oakhurst", True), ("Ovensy", "Ovensy Wholesale", True), ("Lumora", "FernCups", False), ("ab", "abcdef", False), ("ab", "ab", True), ("Oakhurstdd", "Oakhurstdx", True), ("Oakhurstd", "Xakhurstd", False)],
)
def test_alias_match(spark, a, b, want):
    assert one(spark, labels.alias_match(text(a), text(b))) is want


@pytest.mark.parametrize(("raw", "want"), [("INV-123", True), ("Invoice #45", True), ("Invoice 45", True), ("Payment for invoice", True), ("Invoice", False), ("  inv-9  ", True), ("Lumora", False), ("Invoice Systems LLC", False), (None, False), ("", False)])
def test_sludge(spark, raw, want):
    assert one(spark, labels.is_sludge(text(raw))) is want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("ACME FOODS TEAM1234/Payment 30280 PERFORMAN", "Acme Foods (Invoice 30280)"), ("LUMORA TEAM99/Payment 1", "Lumora (Invoice 1)"), ("HARBOR CHANDLERY/Payment 77", "Harbor Chandlery (Invoice 77)"),
        ("Lumora Foods/Payment 12", "Lumora Foods (Invoice 12)"), ("Lumora Foods INV 445", "Lumora Foods INV 445 (Invoice 445)"), ("INV-123", None), ("", None), ("x", None), (None, None),
    ],
)
def test_descriptor(spark, raw, want):
    assert one(spark, labels.entity_of_descriptor(text(raw))) == want


@pytest.mark.parametrize(("raw", "owner", "want"), [("J. Brandt", "Joachim Brandt", False), ("Brandt", "Brandt", True), ("Joachim Brandt", "Brandt", True), ("a", "a", False)])
def test_owner(spark, raw, owner, want):
    assert one(spark, labels.is_owner(text(raw), text(owner))) is want


@pytest.mark.parametrize(
    ("raw", "preferred", "owner", "want"),
    [
        ("SP LUMORA WHOLESALE", "Lumora", None, "Lumora"), ("Lumora Foods", None, None, "Lumora Foods"), ("Brandt", None, "Brandt", "Owner"), ("raw", "Brandt", "Brandt", "Owner"), ("INV-123", None, None, "—"), (None, None, None, "—"),
        ("Lumora Foods (deleted)", None, None, "Lumora Foods"), ("QuickBooks", None, None, "QuickBooks"), ("Quick Books", None, None, "QuickBooks"), ("DocuSign", None, None, "DocuSign"), ("Lumora Foods", "billing@lumora.com", None, "Lumora Foods"),
        ("Lumora Foods", "INV-9", None, "Lumora Foods"), ("Test Kitchen LLC", None, None, "—"),
    ],
)
def test_display(spark, raw, preferred, owner, want):
    assert one(spark, labels.display_label(text(raw), text(preferred), text(owner))) == want


@pytest.mark.parametrize(
    ("raw", "kind", "subtype", "want"),
    [
        ("Union Parent Account:J. BRANDT (4821) - 2", None, None, "Owner credit card"), ("Blue Card", "credit", None, "Credit card"), ("Some Card", None, "credit card", "Credit card"), ("Acct", None, "checking", "Business checking"),
        ("Acct", "depository", None, "Business checking"), (None, None, None, "External / unlinked account"), ("First:Main (1234) x", None, None, "First (1234)"),
    ],
)
def test_account(spark, raw, kind, subtype, want):
    assert one(spark, labels.account_label(text(raw), text(kind), text(subtype))) == want


@pytest.mark.parametrize(("a", "b", "threshold", "want"), [("EASTGALE", "eastgale", 0.85, True), ("", "Eastgale", 0.85, False), ("Tove's Oven Food", "Tove's Oven Food [Wholesale]", 0.85, True), ("Lumora", "FernCups", 0.85, False), ("Lumora", "FernCups", 0.0, True), ("Inc", "Incredible Foods", 0.85, True)])
def test_same_entity(spark, a, b, threshold, want):
    assert one(spark, names.same_entity(text(a), text(b), threshold)) is want


@pytest.mark.parametrize(
    ("description", "name", "aliases", "threshold", "want"),
    [
        ("Lumora", "Lumora", [], 0.8, (True, 1.0, "direct")), ("Stillbrook Orchard", "Pim's Finest Kettlecorn", ["Stillbrook Orchard"], 0.8, (True, 1.0, "alias")), ("ACH CREDIT ACMEFOODS LLC", "ACMEFOODS", [], 0.8, (True, 0.88, "contains")),
        ("ACMEFOODS", "ACMEFOODS WHOLESALE LLC", [], 0.8, (True, 0.85, "contains_reverse")), ("ACH CREDIT ABC", "ABC", [], 0.8, (False, None, "none")), ("Oakhurstd Holdings", "Oakhurst Holding", [], 0.99, (False, None, "none")),
    ],
)
def test_entity_match(spark, description, name, aliases, threshold, want):
    got = one(spark, labels.entity_match(text(description), text(name), F.array(*map(F.lit, aliases)).cast("array<string>"), threshold))
    assert (got["match"], got["method"]) == (want[0], want[2])
    assert want[1] is None or got["score"] == pytest.approx(want[1])


@pytest.mark.parametrize(("a", "b", "receivable", "payable"), [("Blue Sky Trading Inc", "blue sky trading", True, True), ("ACME", "ACME Foods", False, True), ("Green Valley Farm Shop", "Valley Shop Green", True, True), ("Global Services", "Global Services Group", True, True), ("", "x", False, False), ("North Co", "South Co", False, False)])
def test_names_match(spark, a, b, receivable, payable):
    assert one(spark, labels.receivable_names_match(text(a), text(b))) is receivable
    assert one(spark, labels.payable_names_match(text(a), text(b))) is payable


@pytest.mark.parametrize(
    ("total", "excluded", "unresolved", "provisional", "low", "want"),
    [(0, 0, 0, 0, 0, 100.0), (100, 0, 0, 0, 0, 100.0), (1000, 1, 0, 0, 0, 99.0), (100, 10, 0, 0, 0, 95.0), (100, 10, 10, 20, 40, 78.0), (100, 100, 100, 100, 100, 0.0)],
)
def test_area_confidence(spark, total, excluded, unresolved, provisional, low, want):
    assert one(spark, state.area_confidence(*(F.lit(float(x)) for x in (total, excluded, unresolved, provisional, low)))) == want


@pytest.mark.parametrize(("n", "cv", "on_time", "delay", "want"), [(2, 0.0, 1.0, 0, "low_data"), (9, 0.2, 0.9, 5, "clockwork"), (9, 0.4, 0.8, 25, "slow_reliable"), (9, 0.9, 0.6, 5, "bursty"), (9, 1.5, 0.9, 5, "volatile"), (9, 0.6, 0.4, 5, "volatile"), (9, 0.6, 0.6, 5, "bursty")])
def test_archetype(spark, n, cv, on_time, delay, want):
    assert one(spark, profiles.archetype(F.lit(n), F.lit(cv), F.lit(on_time), F.lit(delay))) == want


@pytest.mark.parametrize(("n", "gap", "gap_sd", "mean", "sd", "want"), [(2, 30.0, 0.0, 100.0, 0.0, 0.0), (5, 30.0, 0.0, 100.0, 0.0, 1.0), (5, 30.0, 15.0, 100.0, 50.0, 0.5), (5, 0.0, 0.0, 100.0, 0.0, 0.3), (5, 10.0, 30.0, 100.0, 10.0, 0.27)])
def test_recurrence(spark, n, gap, gap_sd, mean, sd, want):
    assert one(spark, profiles.recurrence_confidence(F.lit(n), *(F.lit(x) for x in (gap, gap_sd, mean, sd)))) == pytest.approx(want)


def test_quality_score(spark):
    # 50 transactions a week apart, all on time and perfectly steady: 0.3 + 0.3 x 350 / 365 + 0.2 + 0.2
    assert one(spark, profiles.quality_score(F.lit(50), F.lit(7.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(100 * (0.7 + 0.3 * 350 / 365))
