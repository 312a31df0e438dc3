"""Queries that once ran over a part of their rows: the whole job on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.plans import forecast, matching
from tidemark.sources import domain

SF = "/root/testdata/sf0.001"


def test_every_movement_has_name_scores(spark):
    got = registry.queries()["name_similarity"](spark, SF)
    every = domain.movements(spark, SF).select("movement_id", F.pmod("key", F.lit(4)).alias("style"))
    assert got.count() == every.count()
    of = {r["style"]: r for r in got.join(every, "movement_id").groupBy("style").agg(F.min("edit_sim").alias("low"), F.max("edit_sim").alias("high"), F.max("token_sim").alias("t")).collect()}
    assert set(of) == {0, 1, 2, 3}
    assert of[0]["low"] == of[1]["low"] == 1.0
    assert of[2]["high"] < 1.0
    assert of[3]["high"] < 1.0


def test_odd_payments_are_allocated(spark):
    left = {r["movement_id"]: r["residual"] for r in registry.queries()["residual_cash"](spark, SF).collect()}
    rows = domain.movements(spark, SF).join(domain.cash_events(spark, SF).select("event_id", F.col("amount").alias("due")), "event_id").collect()
    assert {r["key"] % 2 for r in rows} == {0, 1}
    want = {r["movement_id"]: float(r["amount"] - r["due"]) for r in rows if float(r["amount"] - r["due"]) > 0.01}
    assert left == pytest.approx(want)
    assert want


def test_residuals_sum_all_lines_but_fees(spark):
    money = "decimal(18,2)"
    m = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "movement_id string, amount int").withColumn("amount", F.col("amount").cast(money))
    lines = spark.createDataFrame([("a", "ar", 40), ("a", "ar", 60), ("b", "ar", 70), ("b", "fee", 30)], "movement_id string, component_type string, net_amount int").withColumn("net_amount", F.col("net_amount").cast(money))
    assert {tuple(r) for r in matching.residuals(m, lines).collect()} == {("b", 30.0), ("c", 100.0)}


def test_every_day_is_forecast(spark):
    rows = {r["day"]: r for r in registry.queries()["baseline_forecasts"](spark, SF).collect()}
    a, z = domain.movements(spark, SF).agg(F.min("date"), F.max("date")).first()
    assert len(rows) == (z - a).days + 1
    assert {d.year for d in rows} == set(range(a.year, z.year + 1))
    assert sum(r["net"] != 0 for r in rows.values() if r["day"].year != 2000) > 100
    models = {r["model"]: r["days"] for r in registry.queries()["backtest_scores"](spark, SF).collect()}
    assert set(models) == set(forecast.MODELS)
    assert min(models.values()) > 366


def test_baselines_without_the_year_2000(spark):
    data = [("2010-01-01", "inflow", 70), ("2010-01-08", "outflow", 30), ("2010-02-10", "inflow", 5)]
    m = spark.createDataFrame(data, "date string, direction string, amount int").withColumns({"date": F.to_date("date"), "amount": F.col("amount").cast("decimal(18,2)")})
    b = {str(r["day"]): r for r in forecast.all_baselines(m).collect()}
    assert len(b) == 41
    assert b["2010-01-08"]["naive7"] == 10.0
    assert b["2010-01-29"]["last_cycle"] == 70.0
    assert b["2010-01-29"]["due_date"] == 0.0
    assert b["2010-01-01"]["naive7"] is None
    cut = forecast.all_baselines(m, "2010-01-07", 3).collect()
    assert [(str(r["day"]), r["net"]) for r in sorted(cut)] == [("2010-01-08", -30.0), ("2010-01-09", 0.0), ("2010-01-10", 0.0)]


def test_simulations_are_whole(spark):
    got = registry.queries()["monte_carlo"](spark, SF).collect()
    assert all(r["p5"] <= r["p25"] <= r["p50"] <= r["p75"] <= r["p95"] for r in got)
    assert all(abs(r["negative"] * 500 - round(r["negative"] * 500)) < 1e-6 for r in got)
    last = {r["day"]: r for r in got}
    risk = registry.queries()["monte_carlo_risks"](spark, SF).first()
    assert risk["prob_below_zero_30d"] == pytest.approx(last[30]["negative"], abs=0.0051)
    assert risk["worst_case_cash_30d"] <= risk["expected_cash_30d"] <= risk["best_case_cash_30d"]
    found = {r["scenario"]: r for r in registry.queries()["monte_carlo_scenarios"](spark, SF).collect()}
    assert set(found) == {"base", "conservative", "aggressive"}
    assert found["conservative"]["cash_30d"] < found["base"]["cash_30d"] < found["aggressive"]["cash_30d"]


def test_biases_move_certain_payments(spark):
    e = spark.createDataFrame([("c", "inflow", 100.0, 1.0, 15), ("v", "outflow", 50.0, 1.0, 15)], "entity_id string, direction string, amount double, probability double, day int")
    paths = forecast.simulated(e, 400, tuple(forecast.BIASES))
    assert paths.count() == 3 * 400 * 30
    end = {r["scenario"]: r["cash"] - forecast.START for r in paths.filter("day = 30").groupBy("scenario").agg(F.avg("cash").alias("cash")).collect()}
    assert end["base"] == pytest.approx(50, abs=4)
    assert end["conservative"] == pytest.approx(0.75 * 90 - 55, abs=8)
    assert end["aggressive"] == pytest.approx(110 - 0.85 * 46, abs=5)


@pytest.fixture(scope="module")
def transfers(spark):
    data = [
        ("o1", "outflow", "9999.99", "2024-01-01", "A", "transfer"), ("o2", "outflow", "900.00", "2024-01-01", "A", "vendor_payment"), ("i1", "inflow", "10000.00", "2024-01-04", "A", "customer_receipt"),
        ("i2", "inflow", "9999.99", "2024-01-03", "B", "transfer"), ("i3", "inflow", "9999.99", "2024-01-05", "B", "transfer"), ("i4", "inflow", "10000.00", "2024-01-02", "B", "transfer"),
        ("i5", "inflow", "1799.99", "2023-12-29", "A", "customer_receipt"), ("i6", "inflow", "1800.00", "2024-01-01", "A", "customer_receipt"), ("i7", "inflow", "0.01", "2024-01-01", "A", "customer_receipt"), ("i8", "inflow", "9999.99", "2024-01-01", "A", "transfer"),
    ]
    m = spark.createDataFrame(data, "movement_id string, direction string, amount string, date string, account string, economic_class string")
    return m.withColumns({"amount": F.col("amount").cast("decimal(18,2)"), "date": F.to_date("date")})


def test_pairs_across_amount_bins(transfers):
    got = {(r["outflow_id"], r["inflow_id"]) for r in matching.near_pairs(transfers, ["account"], "900", 3).collect()}
    assert got == {("o1", "i1"), ("o1", "i8"), ("o2", "i5"), ("o2", "i7")}


def test_own_transfers(transfers):
    assert [tuple(r) for r in matching.own_transfers(transfers).collect()] == [("o1", "i2")]


def test_unresolved_payments_find_expectations_by_amount_date_and_name(spark):
    m = spark.createDataFrame(
        [("a", None, "Blue Sky Trading", "97.10", "2024-01-10"), ("b", None, "Someone Else", "97.10", "2024-01-10"), ("c", "C1", "x", "100.00", "2024-01-10"), ("d", "C2", "x", "100.00", "2024-01-10"), ("e", None, "Blue Sky Trading", "94.99", "2024-01-10")],
        "movement_id string, entity_id string, name string, amount string, date string",
    ).withColumns({"amount": F.col("amount").cast("decimal(18,2)"), "date": F.to_date("date")})
    e = spark.createDataFrame([("E1", "C1", "Blue Sky Trading Inc", "100.00", "2024-01-19")], "event_id string, entity_id string, name string, due string, expected_date string").withColumns({"due": F.col("due").cast("decimal(18,2)"), "expected_date": F.to_date("expected_date")})
    got = {r["movement_id"]: r for r in matching.scored_pairs(m, e, 45, matching.labels.receivable_parts_match).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["confidence"] == pytest.approx((0.971 + 0.8 + 0.85) / 3)
    assert got["b"]["confidence"] == pytest.approx((0.971 + 0.8 + 0.5) / 3)
    assert got["c"]["confidence"] == pytest.approx((1 + 0.8 + 1) / 3)
    assert got["a"]["fee"] == pytest.approx(2.9)
    assert got["c"]["method"] == "tolerance"


def test_one_entity_meets_without_pairs(spark, monkeypatch):
    """Ties in date, equal ends, an empty amount and a missing date, all in one entity."""
    day = lambda k: F.date_add(F.lit("2001-01-01").cast("date"), k)
    money = lambda x: x.cast("decimal(18,2)")
    k = F.col("id").cast("int")
    name = lambda tag: F.format_string(f"{tag}%03d", k)
    moves = spark.range(60).select(name("m").alias("movement_id"), F.lit("x").alias("entity_id"), F.lit("inflow").alias("direction"), money(F.when(k == 7, 0).otherwise(k % 5 + 1)).alias("amount"), F.when(k != 9, day(k % 11)).alias("date"), name("e").alias("event_id"))
    events = spark.range(70).select(name("e").alias("event_id"), F.lit("x").alias("entity_id"), F.lit("ar").alias("event_type"), money(k % 4 + 1).alias("amount"), day(k % 13).alias("expected_date"))
    monkeypatch.setattr(domain, "movements", lambda *_: moves)
    monkeypatch.setattr(domain, "cash_events", lambda *_: events)
    ms, es = moves.collect(), events.collect()
    near = {(m["movement_id"], e["event_id"]) for m in ms if m["date"] for e in sorted(es, key=lambda e: (abs((m["date"] - e["expected_date"]).days), e["event_id"]))[:15]}
    assert {(r["movement_id"], r["event_id"]) for r in matching.case_candidates(spark, "").collect()} == near

    monkeypatch.setattr(domain, "movements", lambda *_: moves.filter("date IS NOT NULL"))
    want = {}
    left = [[e["event_id"], float(e["amount"])] for e in sorted(es, key=lambda e: (e["expected_date"], e["event_id"]))]
    for m in sorted((m for m in ms if m["date"]), key=lambda m: (m["date"], m["movement_id"])):
        rest = float(m["amount"])
        while rest > 0 and left:
            part = min(rest, left[0][1])
            want[m["movement_id"], left[0][0]] = part
            rest, left[0][1] = rest - part, left[0][1] - part
            if left[0][1] == 0:
                left.pop(0)
    assert {(r["movement_id"], r["event_id"]): r["applied"] for r in matching.fifo_application(spark, "").collect()} == want


def test_amounts_on_a_bands_edge_score_as_money(spark, monkeypatch):
    """1130.00 and 1128.87 are just a thousandth apart, though their doubles are further."""
    rows = [("plaid", "a", "1130.00"), ("qbo", "b", "1128.87"), ("xero", "c", "1130.00")]
    frame = spark.createDataFrame(rows, "source string, source_id string, amount string").withColumns({"entity_id": F.lit("C1"), "direction": F.lit("inflow"), "amount": F.col("amount").cast("decimal(18,2)"), "date": F.to_date(F.lit("2024-01-01")), "counterparty": F.lit("x")})
    monkeypatch.setattr(domain, "observations", lambda *_: frame)
    assert {(r["a_id"], r["b_id"]): r["score"] for r in matching.cross_source_duplicates(spark, "").collect()} == {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 1.0}


def test_near_pairs_repeat_only_inflows(spark):
    k = F.col("id")
    side = lambda way, n, step: spark.range(n).select(F.concat(F.lit(way[0]), k).alias("movement_id"), F.lit(way).alias("direction"), F.lit("A").alias("account"), (k * step % 5000).cast("decimal(18,2)").alias("amount"), F.date_add(F.lit("1969-12-20").cast("date"), (k % 23).cast("int")).alias("date"))
    m = side("outflow", 150, 37).unionByName(side("inflow", 120, 53))
    got = matching.near_pairs(m, ["account"], "900", 3)
    rows = m.collect()
    want = sorted((o["movement_id"], i["movement_id"]) for o in rows for i in rows if o["direction"] == "outflow" and i["direction"] == "inflow" and abs(o["amount"] - i["amount"]) < 900 and abs((o["date"] - i["date"]).days) <= 3)
    assert sorted((r["outflow_id"], r["inflow_id"]) for r in got.collect()) == want
    plan = matching.near_pairs(domain.movements(spark, SF), ["account"], "900", 3)._jdf.queryExecution().analyzed().toString()
    assert "Generate" not in plan[: plan.index("= outflow")]


def test_similarities_are_worked_out_once(spark):
    plan = registry.queries()["entity_name_match"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == 2
