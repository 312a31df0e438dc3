"""Pure expressions against published values, and operators against invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import names, rules
from tidemark.operators import joins

SF = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("amount", "want"), [(100.0, 1.0), (100.05, 1.0), (100.5, 0.97), (102.0, 0.92), (104.0, 0.88), (109.0, 0.80), (115.0, 0.65), (50.0, 0.60), (200.0, 0.40)])
def test_amount_score(spark, amount, want):
    assert one(spark, rules.amount_score(F.lit(amount), F.lit(100.0))) == want


@pytest.mark.parametrize("target", [0.0, -5.0])
def test_amount_score_without_target(spark, target):
    assert one(spark, rules.amount_score(F.lit(10.0), F.lit(target))) == 0.0


def test_date_score(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, rules.date_score(day("2024-01-01"), F.lit(None).cast("date"))) == 0.75
    assert one(spark, rules.date_score(day("2024-01-01"), day("2024-01-02"))) == 1.0
    assert one(spark, rules.date_score(day("2024-01-01"), day("2024-08-02"))) == 0.5


@pytest.mark.parametrize(("a", "b", "want"), [("Summit Provisions", "Summit Provisions Foods", 2 / 3), ("a Northwind", "Northwind a", 1.0), ("!!!", "???", 1.0), ("!!!", "Northwind", 0.0)])
def test_token_similarity(spark, a, b, want):
    assert one(spark, names.token_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)
    assert one(spark, names.token_similarity(F.lit(b), F.lit(a))) == pytest.approx(want)


def test_edit_similarity(spark):
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert one(spark, names.edit_similarity(F.lit("NORTHWIND"), F.lit("northwind"))) == 1.0
    assert one(spark, names.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, names.name_similarity(F.lit("Verano"), F.lit("PalmTaps"))) < 0.2


def test_policy(spark):
    p = lambda c, e, r, k: one(spark, rules.state_policy(F.lit(c), F.lit(e), F.lit(r), F.lit(k)))
    assert p(0.9, 0.2, False, "tax") == "include"
    assert p(0.9, 0.1, False, "tax") == "include_provisional"
    assert p(0.5, 0.2, False, "tax") == p(0.9, 0.2, True, "tax") == p(0.9, 0.2, False, "unknown") == "exclude_and_review"


@pytest.mark.parametrize("days", [0, 1, 3, 10])
def test_range_join(spark, days):
    a = spark.createDataFrame([(i % 3, i) for i in range(40)], "k int, x int").withColumn("da", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("x") * 2) % 60))
    b = a.select("k", F.col("x").alias("y"), F.date_add("da", 1).alias("db"))
    got = {(r["x"], r["y"]) for r in joins.range_join(a, b, ["k"], "da", "db", days).collect()}
    want = {(r["x"], r["y"]) for r in a.join(b, "k").filter(F.abs(F.datediff("da", "db")) <= days).collect()}
    assert got == want


def test_asof_bounds(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "five"), (1, 3, "three")], "k int, t2 int, v string")
    strict = {(r["k"], r["t"]): r["asof_v"] for r in joins.asof_join(left, right, ["k"], "t", "t2", "v", strict=True).collect()}
    loose = {(r["k"], r["t"]): r["asof_v"] for r in joins.asof_join(left, right, ["k"], "t", "t2", "v", strict=False).collect()}
    assert strict == {(1, 5): "three", (1, 1): None, (2, 5): None}
    assert loose == {(1, 5): "five", (1, 1): None, (2, 5): None}


def test_fifo_conserves(spark):
    rows = registry.queries()["fifo_application"](spark, SF)
    from tidemark.sources import domain

    paid = rows.groupBy("movement_id").agg(F.sum("applied").alias("a")).join(domain.movements(spark, SF), "movement_id")
    assert paid.filter(F.col("a") > F.col("amount") + 0.01).count() == 0


def test_monte_carlo_is_reproducible(spark):
    f = registry.queries()["monte_carlo"]
    a = sorted(map(tuple, f(spark, SF).collect()))
    assert len(a) == 30
    assert a == sorted(map(tuple, f(spark, SF).collect()))
    assert all(r[1] <= r[2] <= r[3] for r in a)


def test_journal_balances(spark):
    j = registry.queries()["journal_entries"](spark, SF)
    assert j.groupBy("movement_id").agg(F.abs(F.sum("debit") - F.sum("credit")).alias("d")).filter("d > 0.01").count() == 0


def test_stream_upsert(spark, tmp_path):
    from tidemark.streaming import flows

    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    second = spark.createDataFrame([(1, "c", 2), (3, "d", 1), (2, "e", 1)], "id int, v string, at int")
    flows.upsert(first, path, "id", "at", 0)
    (tmp_path / "t" / "v=1").mkdir()  # what a failure leaves: a version without its mark
    assert sorted(map(tuple, flows.current(spark, path).collect())) == [(1, "a", 1), (2, "b", 1)]
    want = [(1, "c", 2), (2, "e", 1), (3, "d", 1)]
    for _ in range(2):  # the same batch twice
        flows.upsert(second, path, "id", "at", 1)
        assert sorted(map(tuple, flows.current(spark, path).collect())) == want
    assert flows.versions(spark, path) == [0, 1]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(registry.queries()) > 80
