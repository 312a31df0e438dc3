"""The nearest expectations against all pairs."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import nearest
from tidemark.plans import matching


def frame(spark, rows, columns, amount, day):
    return spark.createDataFrame(rows, columns).withColumns({amount: F.col(amount).cast("decimal(18,2)"), day: F.to_date(day)})


def drawn(seed, payments, expectations, names, amounts):
    r = random.Random(seed)
    start = date(2024, 1, 1)
    m = [(f"m{i:04d}", r.choice([None, "C1", "C2", "C9"]), r.choice(names), str(r.choice(amounts)), str(start + timedelta(r.randrange(60)))) for i in range(payments)]
    e = [(f"e{i:04d}", o := r.choice(["C1", "C2", "C3"]), names[int(o[1]) % len(names)], str(r.choice(amounts)), str(start + timedelta(r.randrange(60)))) for i in range(expectations)]
    return m, e


@pytest.mark.parametrize(("rule", "days", "least", "count"), [(labels.payable_parts_match, 14, 0.8, 1), (labels.receivable_parts_match, 45, 0.3, 5), (labels.payable_parts_match, 7, 0.0, 2)])
def test_best_pairs_are_those_of_all_pairs(spark, rule, days, least, count):
    """Ties of all kinds: repeated amounts and dates, amounts a cent apart where nine digits cannot tell them, names within names, of one word, of single letters and of none."""
    names = ["Blue Sky Trading", "Blue Sky Trading Inc", "Sky", "a b", "#", "Smith Foods", "Foods Smith & Co", "Trading"]
    amounts = ["100.00", "100.00", "99.50", "104.99", "105.00", "95.24", "0.01", "90000000.00", "90000000.01", "90000000.02", "89999999.99", *(f"{x}.37" for x in range(90, 112))]
    rows = drawn(days, 150, 400, names, amounts)
    m = frame(spark, rows[0], "movement_id string, entity_id string, name string, amount string, date string", "amount", "date")
    e = frame(spark, rows[1], "event_id string, entity_id string, name string, due string, expected_date string", "due", "expected_date")
    got = matching.scored_pairs(m, e, days, rule, least, count).filter(F.col("confidence") >= least)
    gap, ratio = F.abs(F.datediff("date", "expected_date")), F.col("amount").cast("double") / F.col("due").cast("double")
    near = (gap <= days) & (F.col("amount") * 100 >= F.col("due") * 95) & (F.col("amount") * 100 <= F.col("due") * 105)
    p = m.join(e.withColumnsRenamed({"entity_id": "owner", "name": "other"}), near & (F.col("entity_id").isNull() | (F.col("entity_id") == F.col("owner"))))
    who = F.when(F.col("entity_id").isNotNull(), 1.0).when(rule(labels.name_parts(F.col("name")), labels.name_parts(F.col("other"))), 0.85).otherwise(0.5)
    every = p.select("movement_id", "event_id", (((1 - F.abs(ratio - 1)) + (1 - gap / F.lit(float(days))) + who) / 3).alias("confidence")).filter(F.col("confidence") >= least)

    def best(df):
        of = {}
        for r in df.collect():
            of.setdefault(r["movement_id"], []).append((-round(r["confidence"], 9), r["event_id"]))
        return {k: sorted(v)[:count] for k, v in of.items()}

    want = best(every)
    assert want
    assert best(got) == want


def test_unresolved_payments_form_no_pairs(spark):
    """As many payments as expectations of like amount and date: a few of each payment's pairs are formed, not all."""
    n = 300
    m = spark.range(n).select(F.format_string("m%03d", "id").alias("movement_id"), F.lit(None).cast("string").alias("entity_id"), F.lit("Someone Else").alias("name"), (1000 + F.col("id") % 7).cast("decimal(18,2)").alias("amount"), F.lit("2024-01-10").cast("date").alias("date"))
    e = spark.range(n).select(F.format_string("e%03d", "id").alias("event_id"), F.lit("C1").alias("entity_id"), F.lit("Blue Sky").alias("name"), (1000 + F.col("id") % 11).cast("decimal(18,2)").alias("due"), F.lit("2024-01-10").cast("date").alias("expected_date"))
    assert matching.scored_pairs(m, e, 45, labels.receivable_parts_match, 0.3).count() <= 10 * n


@pytest.mark.parametrize("count", [1, 3])
def test_crowded_days(monkeypatch, count):
    """Days with so many amounts that only those next to a payment's own are looked at, in batches that part the cells."""
    monkeypatch.setattr(nearest, "ROWS", 70)
    monkeypatch.setattr(nearest, "PAIRS", 500)
    r = np.random.default_rng(3)
    rows = [("k" if r.random() < 0.5 else "", 0, 0, side, int(r.integers(0, 4)), int(r.integers(9000, 9900)), f"{'ep'[side]}{i:04d}", 0.4 * side, 1.0 * side) for side, n in ((0, 2000), (1, 60)) for i in range(n)]
    rows.sort(key=lambda x: (x[0], *x[3:7]))
    names = ["key", "scale", "block", "side", "day", "cents", "id", "reach", "who"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[j : j + 40]], k) for i, k in enumerate(kinds)], names) for j in range(0, len(rows), 40)]
    got = {}
    for b in nearest._searched(iter(batches), 10, count):
        for x in b.to_pylist():
            got.setdefault(x["movement_id"], []).append((round(abs(x["paid"] / x["due"] - 1) + x["gap"] / 10, 9), x["event_id"]))
    for p in (x for x in rows if x[3]):
        near = [(round(abs(p[5] / e[5] - 1) + abs(p[4] - e[4]) / 10, 9), e[6]) for e in rows if not e[3] and e[0] == p[0] and 95 * e[5] <= 100 * p[5] <= 105 * e[5]]
        assert sorted(got.pop(p[6], []))[:count] == sorted(x for x in near if x[0] <= 0.4)[:count]
    assert not got
