"""Rules as column expressions: inclusion policies, classes, bands, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Economic class to payment class.
PAYMENT_CLASS = {
    "customer_receipt": "AR_COLLECTION",
    "refund": "AR_COLLECTION",
    "vendor_payment": "AP_PAYMENT",
    "payroll": "AP_PAYMENT",
    "debt_payment": "AP_PAYMENT",
    "tax": "AP_PAYMENT",
    "transfer": "INTERNAL_TRANSFER",
    "processor_payout": "PROCESSOR_SETTLEMENT",
    "settlement_in": "PROCESSOR_SETTLEMENT",
    "bank_fee": "FEES",
    "bank_fee_refund": "FEES",
    "processor_fee": "FEES",
    "owner_contribution": "FINANCING",
    "owner_draw": "FINANCING",
}
#: Priority of sources when duplicates are resolved.
SOURCE_PRIORITY = {"plaid": 100, "qbo": 80, "xero": 80, "stripe": 60, "shopify": 40, "manual": 20}


def bands(x: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step that ``x`` does not exceed."""
    first, *rest = steps
    return reduce(lambda c, s: c.when(x <= s[0], s[1]), rest, F.when(x <= first[0], first[1])).otherwise(otherwise)


def at_least(x: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step that ``x`` reaches."""
    first, *rest = steps
    return reduce(lambda c, s: c.when(x >= s[0], s[1]), rest, F.when(x >= first[0], first[1])).otherwise(otherwise)


def lookup(x: Column, values: dict[str, object], otherwise: object) -> Column:
    """A small literal map, with a default."""
    pairs = [F.lit(y) for kv in values.items() for y in kv]
    return F.coalesce(F.create_map(*pairs)[x], F.lit(otherwise))


def state_policy(confidence: Column, evidence: Column, review: Column, cls: Column) -> Column:
    """Whether a movement counts: fully, provisionally, or not before review."""
    return (
        F.when((cls == "unknown") | review | (confidence < 0.55), "exclude_and_review").when((confidence >= 0.80) & (evidence >= 0.15), "include").otherwise("include_provisional")
    )


def payment_class(cls: Column) -> Column:
    return lookup(F.lower(F.coalesce(cls, F.lit("unknown"))), PAYMENT_CLASS, "OTHER")


def status_from_outstanding(outstanding: Column, amount: Column) -> Column:
    """paid, partially_paid or open, within a cent."""
    return F.when(outstanding <= 0.01, "paid").when(outstanding < amount - 0.01, "partially_paid").otherwise("open")


def amount_score(amount: Column, target: Column) -> Column:
    """How near an amount is to its target: bands of relative difference, then under- and overpayment."""
    rel = F.abs(amount - target) / F.nullif(target, F.lit(0.0))
    near = bands(rel, [(0.001, 1.0), (0.01, 0.97), (0.03, 0.92), (0.05, 0.88), (0.10, 0.80), (0.20, 0.65)], None)
    return F.when(target <= 0, 0.0).otherwise(F.coalesce(near, F.when(amount < target, 0.60).otherwise(0.40)))


def date_score(a: Column, b: Column) -> Column:
    """How near two dates are; 0.75 where either is missing."""
    days = F.abs(F.datediff(a, b))
    return F.when(days.isNull(), 0.75).otherwise(bands(days, [(1, 1.0), (7, 0.93), (14, 0.87), (30, 0.80), (60, 0.72), (90, 0.65)], 0.50))


def confidence_label(x: Column) -> Column:
    return at_least(x, [(0.88, "very_high"), (0.75, "high"), (0.60, "medium")], "low")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.when(F.isnan(x), 0.0).otherwise(x)))


def half_up(x: Column, digits: int) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def normal_cdf(x: Column) -> Column:
    """The normal distribution by the polynomial of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)
