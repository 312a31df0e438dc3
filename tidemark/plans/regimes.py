"""Spend and liquidity of a period in full, and the seven signals of change from one month to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.sources import domain as d

# Classes that operate, that a contract fixes and that settle; bands with their limits; months of the rolling base, deviations and percentages that signals name.
OPERATING = ("customer_receipt", "refund", "vendor_payment", "payroll", "tax", "bank_fee", "processor_fee")
OPEX = ("vendor_payment", "payroll", "bank_fee", "processor_fee", "tax")
CONTRACTUAL = ("payroll", "bank_fee", "bank_fee_refund", "tax", "processor_fee")
OWNER = ("owner_contribution", "owner_draw")
CONCENTRATION = ((50, "critical"), (35, "high"), (15, "moderate"))
SPIKE = ((2.0, "critical"), (1.5, "high"), (1.25, "elevated"), (1.1, "moderate"))
OWNERS = ((40, "critical"), (25, "high"), (10, "elevated"), (3, "moderate"))
SETTLEMENT = ((50, "critical"), (30, "high"), (15, "elevated"), (5, "moderate"))
OPERATED = ((80, "low"), (60, "moderate"), (40, "elevated"))
ROLLING, LEAST, DEVIATIONS = 6, 3, 2
SIGNALS = ("revenue_concentration", "abnormal_outflow_spike", "owner_dependency", "liquidity_regime", "settlement_lag", "settlement_drag", "operating_dependency")


def above(x: Column, steps, otherwise: str, at_least: bool = False) -> Column:  # noqa: ANN001
    """The name of the first limit that ``x`` exceeds, or reaches."""
    return F.coalesce(*(F.when((x >= limit) if at_least else (x > limit), name) for limit, name in steps), F.lit(otherwise))


def _above(x: str, steps, otherwise: str, at_least: bool = False) -> str:  # noqa: ANN001
    return "CASE " + " ".join(f"WHEN {x} {'>=' if at_least else '>'} {limit} THEN '{name}'" for limit, name in steps) + f" ELSE '{otherwise}' END"


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Movements that count, with what states need: some of the test's inflows stand as owners' or settlements', some outflows as processor fees, a sixth of the vendors' as direct costs."""
    k, cls, inflow = F.col("key"), F.col("economic_class"), F.col("direction") == "inflow"
    named = F.when(inflow & (k % 41 == 0), "owner_contribution").when(inflow & (k % 43 == 0), "processor_payout").when(~inflow & (k % 47 == 0), "processor_fee").otherwise(cls)
    late = F.datediff("date", "expected_date")
    e = d.cash_events(spark, sf).select("event_id", "expected_date")
    m = d.tagged(spark, sf).withColumn("cls", named).join(e, "event_id", "left")
    return m.select("movement_id", F.trunc("date", "month").alias("month"), "date", "entity_id", "account", "amount", "policy", "is_recurring", "cls", inflow.alias("inflow"), F.when((F.col("cls") == "vendor_payment") & (k % 6 == 0), "cogs_out").otherwise("opex_out").alias("bucket"), F.greatest(F.lit(0), late).alias("lag"))


_FLOWS = """f AS (SELECT movement_id, date_trunc('month', date)::DATE AS month, date, t.entity_id, account, t.amount, policy, is_recurring, cls, direction = 'inflow' AS inflow, CASE WHEN cls = 'vendor_payment' AND t.key % 6 = 0 THEN 'cogs_out' ELSE 'opex_out' END AS bucket, greatest(0, date - expected_date) AS lag
  FROM (SELECT *, CASE WHEN direction = 'inflow' AND key % 41 = 0 THEN 'owner_contribution' WHEN direction = 'inflow' AND key % 43 = 0 THEN 'processor_payout' WHEN direction = 'outflow' AND key % 47 = 0 THEN 'processor_fee' ELSE economic_class END AS cls FROM tagged) t
  LEFT JOIN (SELECT event_id, expected_date FROM cash_events) e USING (event_id))"""


def _total(c: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("double").alias(name)


def _sum(c: str, name: str) -> str:
    return f"coalesce(sum(amount) FILTER (WHERE {c}), 0)::DOUBLE AS {name}"


_SPEND = {
    "total_opex": f"counts AND cls IN {OPEX}",
    "total_cogs": "counts AND bucket = 'cogs_out'",
    "direct_cost_candidates": "counts AND cls = 'vendor_payment' AND is_recurring",
    "payroll": "counts AND cls = 'payroll'",
    "vendor_payments": "counts AND cls = 'vendor_payment'",
    "bank_fees": "counts AND cls = 'bank_fee'",
    "taxes": "counts AND cls = 'tax'",
    "processor_fees": "counts AND cls = 'processor_fee'",
    "recurring_obligations": "counts AND is_recurring",
    "recurring_fixed_contractual": f"counts AND is_recurring AND cls IN {CONTRACTUAL}",
    "recurring_soft": "counts AND is_recurring AND cls = 'vendor_payment'",
    "non_recurring_spend": "counts AND NOT is_recurring",
    "provisional_spend": "counts AND policy = 'include_provisional'",
    "excluded_spend": "NOT counts",
}


@query(
    "spend_breakdown",
    d.with_tables(
        f"""WITH {_FLOWS}, s AS (SELECT *, policy <> 'exclude_and_review' AS counts FROM f WHERE NOT inflow AND cls <> 'transfer'),
v AS (SELECT entity_id, sum(amount)::DOUBLE AS total, count(*) AS n FROM s WHERE counts GROUP BY 1), t AS (SELECT {", ".join(_sum(c, n) for n, c in _SPEND.items())}, count(*) FILTER (WHERE counts AND is_recurring) AS recurring_count FROM s)
SELECT t.*, total_opex + total_cogs AS total_spend, (SELECT count(*) FROM v) AS vendor_count, round((total_opex + total_cogs) / (SELECT sum(n) FROM v), 2) AS avg_payment, floor((SELECT max(total) FROM v) / (total_opex + total_cogs) * 1000 + 0.5) / 10 AS top_vendor_pct,
  round((SELECT sum(power(total / (total_opex + total_cogs), 2)) FROM v, t), 6) AS supplier_concentration FROM t""",
        "tagged",
        "cash_events",
    ),
)
def spend_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """What is spent, on what, how much of it recurs and under what bond, and how it falls on vendors; vendors first, then one row."""
    s = flows(spark, sf).filter("not inflow and cls <> 'transfer'").withColumn("counts", F.col("policy") != "exclude_and_review")
    per = s.groupBy("entity_id").agg(*(F.sum(F.when(F.expr(c), F.col("amount"))).alias(n) for n, c in _SPEND.items()), F.count_if("counts").alias("n"), F.count_if(F.col("counts") & F.col("is_recurring")).alias("recurring_count"), F.sum(F.when(F.col("counts"), F.col("amount"))).cast("double").alias("total"))
    t = per.agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in _SPEND), F.sum("recurring_count").alias("recurring_count"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("vendor_count"), F.max("total").alias("top"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    spent = F.col("total_opex") + F.col("total_cogs")
    return t.select(*_SPEND, "recurring_count", spent.alias("total_spend"), "vendor_count", F.round(spent / F.col("n"), 2).alias("avg_payment"), (F.floor(F.col("top") / spent * 1000 + 0.5) / 10).alias("top_vendor_pct"), F.round(F.col("squares") / (spent * spent), 6).alias("supplier_concentration"))


_LIQUID = {
    "total_inflows": "counts AND inflow",
    "total_outflows": "counts AND NOT inflow",
    "operating_inflows": f"counts AND inflow AND cls IN {OPERATING}",
    "operating_outflows": f"counts AND NOT inflow AND cls IN {OPERATING}",
    "financing_inflows": f"counts AND inflow AND cls IN {OWNER}",
    "financing_outflows": f"counts AND NOT inflow AND cls IN {OWNER}",
    "settlement_inflows": "counts AND inflow AND cls = 'processor_payout'",
    "settlement_outflows": "counts AND NOT inflow AND cls = 'processor_payout'",
    "excluded_cash": "cls <> 'transfer' AND policy = 'exclude_and_review'",
    "transfer_volume": "cls = 'transfer'",
}
_COUNTS = "cls <> 'transfer' AND policy <> 'exclude_and_review'"
_REGIME = "CASE WHEN {0} > 0.4 THEN 'strong' WHEN {0} >= 0.2 THEN 'stable' ELSE 'tightening' END"


def regime(x: Column) -> Column:
    return F.when(x > 0.4, "strong").when(x >= 0.2, "stable").otherwise("tightening")


@query(
    "liquidity_breakdown",
    d.with_tables(
        f"""WITH {_FLOWS}, s AS (SELECT *, {_COUNTS} AS counts FROM f), t AS (SELECT {", ".join(_sum(c, n) for n, c in _LIQUID.items())}, count(*) FILTER (WHERE cls = 'transfer') AS transfer_count, greatest(1, max(date) - min(date))::BIGINT AS period_days FROM s),
a AS (SELECT account, sum(CASE WHEN inflow THEN amount ELSE -amount END)::DOUBLE AS net FROM s WHERE counts GROUP BY 1), c AS (SELECT sum(greatest(0, net)) AS ending, max(net) AS largest, count(*) AS accounts FROM a)
SELECT t.*, accounts, largest AS largest_account, ending AS ending_cash, round(greatest(0, ending - (total_inflows - total_outflows)), 2) AS starting_cash, floor(transfer_volume / (total_inflows + total_outflows) * 1000 + 0.5) / 1000 AS transfer_ratio, floor(financing_inflows / total_inflows * 1000 + 0.5) / 1000 AS owner_ratio,
  floor(operating_inflows / total_inflows * 1000 + 0.5) / 1000 AS operating_ratio, {_REGIME.format("(operating_inflows - operating_outflows) / total_inflows")} AS regime, round(operating_outflows / period_days * 30, 2) AS burn_rate, CASE WHEN operating_outflows > 0 AND ending > 0 THEN floor(ending / (operating_outflows / period_days) + 0.5)::BIGINT END AS runway_days FROM t, c""",
        "tagged",
        "cash_events",
    ),
)
def liquidity_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Operating, financing, settlement and transfer flows of the period with their ratios, cash at both ends, burn and runway; accounts first, then one row."""
    s = flows(spark, sf).withColumn("counts", F.expr(_COUNTS))
    signed = F.when(F.col("inflow"), F.col("amount")).otherwise(-F.col("amount"))
    per = s.groupBy("account").agg(*(F.sum(F.when(F.expr(c), F.col("amount"))).alias(n) for n, c in _LIQUID.items()), F.count_if(F.expr("cls = 'transfer'")).alias("k"), F.min("date").alias("a"), F.max("date").alias("b"), F.sum(F.when(F.col("counts"), signed)).cast("double").alias("net"))
    t = per.agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in _LIQUID), F.sum("k").alias("transfer_count"), F.greatest(F.lit(1), F.datediff(F.max("b"), F.min("a"))).cast("long").alias("period_days"), F.count("net").alias("accounts"), F.max("net").alias("largest_account"), F.sum(F.greatest(F.lit(0.0), F.col("net"))).alias("ending_cash"))
    i, o, oo, end = F.col("total_inflows"), F.col("total_outflows"), F.col("operating_outflows"), F.col("ending_cash")
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000
    daily = oo / F.col("period_days")
    return t.select(
        *_LIQUID, "transfer_count", "period_days", "accounts", "largest_account", "ending_cash", F.round(F.greatest(F.lit(0.0), end - (i - o)), 2).alias("starting_cash"), three(F.col("transfer_volume") / (i + o)).alias("transfer_ratio"), three(F.col("financing_inflows") / i).alias("owner_ratio"),
        three(F.col("operating_inflows") / i).alias("operating_ratio"), regime((F.col("operating_inflows") - oo) / i).alias("regime"), F.round(daily * 30, 2).alias("burn_rate"), F.when((oo > 0) & (end > 0), F.floor(F.try_divide(end, daily) + 0.5)).alias("runway_days"),
    )


#: What each signal's value and band are, in SQL over a month's row x and with {p} before the names of the month before.
_MONTHLY = f"""{_FLOWS}, s AS (SELECT *, {_COUNTS} AS counts FROM f),
c AS (SELECT month, entity_id, sum(amount)::DOUBLE AS total FROM s WHERE counts AND inflow AND cls = 'customer_receipt' GROUP BY 1, 2), k AS (SELECT month, max(total) / sum(total) * 100 AS top FROM c GROUP BY 1),
t AS (SELECT month, {", ".join(_sum(c, n) for n, c in _LIQUID.items() if n not in ("transfer_volume", "excluded_cash"))}, coalesce(avg(lag) FILTER (WHERE counts AND inflow AND cls = 'customer_receipt'), 0)::DOUBLE AS lag FROM s GROUP BY 1),
m AS (SELECT t.month, floor(coalesce(top, 0) * 10 + 0.5) / 10 AS top, total_outflows AS spend, CASE WHEN total_inflows > 0 THEN financing_inflows / total_inflows * 100 ELSE 0 END AS owner, CASE WHEN total_inflows > 0 THEN (operating_inflows - operating_outflows) / total_inflows ELSE 0 END AS surplus,
  floor(lag * 10 + 0.5) / 10 AS lag, CASE WHEN total_inflows > 0 THEN settlement_inflows / total_inflows * 100 ELSE 0 END AS settled, CASE WHEN total_inflows > 0 THEN operating_inflows / total_inflows * 100 ELSE 0 END AS operated FROM t LEFT JOIN k USING (month)),
w AS (SELECT *, {_REGIME.format("surplus")} AS regime, avg(spend) OVER r AS mean, CASE WHEN count(*) OVER r >= {LEAST} THEN stddev_pop(spend) OVER r END AS dev, lag(month) OVER o IS NOT NULL AS has, lag(top) OVER o AS ptop, lag(spend) OVER o AS pspend, lag(owner) OVER o AS powner, lag(surplus) OVER o AS psurplus, lag(lag) OVER o AS plag, lag(settled) OVER o AS psettled,
  lag(operated) OVER o AS poperated FROM m WINDOW o AS (ORDER BY month), r AS (ORDER BY month ROWS BETWEEN {ROLLING} PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, coalesce(mean, pspend, spend) AS base, coalesce(abs(spend - mean) > {DEVIATIONS} * dev AND mean > 0, false) AS outside FROM w),
y AS (SELECT *, CASE WHEN base > 0 THEN spend / base ELSE 1 END AS ratio, CASE WHEN base > 0 THEN pspend / base ELSE 1 END AS pratio, CASE WHEN has THEN {_REGIME.format("psurplus")} END AS pregime FROM x)"""


def _row(signal: str, band: str, previous: str, value: str, before: str, change: str, triggered: str) -> str:
    return f"SELECT month, '{signal}' AS signal, {band} AS band, CASE WHEN has THEN {previous} END AS previous_band, ({value})::DOUBLE AS value, (CASE WHEN has THEN {before} END)::DOUBLE AS previous_value, coalesce({change}, false) AS regime_change, coalesce({triggered}, false) AS triggered FROM y"


_HALF = "floor({} + 0.5)"
_BAND_OF = "CASE {} WHEN 'strong' THEN 'low' WHEN 'stable' THEN 'moderate' ELSE 'elevated' END"
_LAG = ((14, "elevated"), (7, "moderate"))
_DETECT = " UNION ALL ".join(
    (
        _row(SIGNALS[0], b := _above("top", CONCENTRATION, "low"), p := _above("ptop", CONCENTRATION, "low"), "top", "ptop", f"has AND {b} <> {p}", f"(has AND {b} <> {p}) OR {b} IN ('high', 'critical')"),
        _row(SIGNALS[1], b := _above("ratio", SPIKE, "low"), p := _above("pratio", SPIKE, "low"), _HALF.format("ratio * 100"), _HALF.format("pratio * 100"), f"(has AND {b} <> {p}) OR outside", f"{b} <> 'low' OR outside"),
        _row(SIGNALS[2], b := _above("owner", OWNERS, "low"), p := _above("powner", OWNERS, "low"), _HALF.format("owner"), _HALF.format("powner"), f"has AND {b} <> {p}", f"(has AND {b} <> {p}) OR {b} IN ('high', 'critical')"),
        _row(SIGNALS[3], _BAND_OF.format("regime"), _BAND_OF.format("pregime"), _HALF.format("surplus * 100"), _HALF.format("psurplus * 100"), "has AND regime <> pregime", "(has AND regime <> pregime) OR regime = 'tightening'"),
        _row(SIGNALS[4], _above("lag", _LAG, "low"), _above("plag", _LAG, "low"), "lag", "plag", "has AND lag > plag * 1.2", "has AND lag > plag * 1.2") + " WHERE lag > 0",
        _row(SIGNALS[5], b := _above("settled", SETTLEMENT, "low", True), p := _above("psettled", SETTLEMENT, "low", True), _HALF.format("settled"), _HALF.format("psettled"), f"has AND {b} <> {p}", f"has AND {b} <> {p}"),
        _row(SIGNALS[6], b := _above("operated", OPERATED, "high", True), p := _above("poperated", OPERATED, "high", True), _HALF.format("operated"), _HALF.format("poperated"), f"has AND {b} <> {p}", "operated < 60"),
    )
)


@query("month_transitions", d.with_tables(f"WITH {_MONTHLY} {_DETECT}", "tagged", "cash_events"))
def month_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """The seven signals of each month against the month before and the six before: band, value, whether the regime changes and whether the signal is raised. Windows see a row for each month."""
    s = flows(spark, sf).withColumn("counts", F.expr(_COUNTS))
    receipt = F.expr("counts and inflow and cls = 'customer_receipt'")
    some = {n: c for n, c in _LIQUID.items() if n not in ("transfer_volume", "excluded_cash")}
    # A customer's month first, so that the second level sees few rows of a month.
    per = s.groupBy("month", "entity_id").agg(*(F.sum(F.when(F.expr(c), F.col("amount"))).alias(n) for n, c in some.items()), F.sum(F.when(receipt, F.col("amount"))).cast("double").alias("paid"), F.sum(F.when(receipt, F.col("lag"))).alias("lags"), F.count_if(receipt).alias("n"))
    t = per.groupBy("month").agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in some), F.coalesce(F.max("paid") / F.sum("paid") * 100, F.lit(0.0)).alias("top"), F.coalesce(F.try_divide(F.sum("lags"), F.sum("n")), F.lit(0.0)).alias("lag"))
    i = F.col("total_inflows")
    of = lambda x, by: F.when(i > 0, F.try_divide(x, i) * by).otherwise(0.0)
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    m = t.select(
        "month", tenth(F.col("top")).alias("top"), F.col("total_outflows").alias("spend"), of(F.col("financing_inflows"), 100).alias("owner"), of(F.col("operating_inflows") - F.col("operating_outflows"), 1).alias("surplus"), tenth(F.col("lag")).alias("lag"),
        of(F.col("settlement_inflows"), 100).alias("settled"), of(F.col("operating_inflows"), 100).alias("operated"),
    )
    order = Window.orderBy("month")
    rolling = order.rowsBetween(-ROLLING, -1)
    names = ("top", "spend", "owner", "surplus", "lag", "settled", "operated")
    w = m.select("*", *(F.lag(n).over(order).alias(f"p{n}") for n in names), F.lag("month").over(order).isNotNull().alias("has"), F.avg("spend").over(rolling).alias("mean"), F.when(F.count("*").over(rolling) >= LEAST, F.stddev_pop("spend").over(rolling)).alias("dev"))
    c = F.col
    base = F.coalesce("mean", "pspend", "spend")
    w = w.withColumns({"ratio": F.when(base > 0, F.try_divide(c("spend"), base)).otherwise(1.0), "pratio": F.when(base > 0, F.try_divide(c("pspend"), base)).otherwise(1.0), "outside": F.coalesce((F.abs(c("spend") - c("mean")) > DEVIATIONS * c("dev")) & (c("mean") > 0), F.lit(False))})
    half = lambda x: F.floor(x + 0.5).cast("double")
    level = lambda x: F.when(regime(x) == "strong", "low").when(regime(x) == "stable", "moderate").otherwise("elevated")
    rows = []

    def signal(name: str, band, x: str, value, triggered, change=None, when=None) -> None:  # noqa: ANN001
        now, was = band(c(x)), band(c(f"p{x}"))
        moved = c("has") & (now != was) if change is None else change(now, was)
        parts = [F.lit(name).alias("signal"), now.alias("band"), F.when(c("has"), was).alias("previous_band"), value(c(x)).alias("value"), F.when(c("has"), value(c(f"p{x}"))).alias("previous_value"), F.coalesce(moved, F.lit(False)).alias("regime_change"), F.coalesce(triggered(now, moved), F.lit(False)).alias("triggered")]
        rows.append(F.struct(*parts) if when is None else F.when(when, F.struct(*parts)))

    severe = lambda now, moved: moved | now.isin("high", "critical")
    signal(SIGNALS[0], lambda x: above(x, CONCENTRATION, "low"), "top", lambda x: x, severe)
    signal(SIGNALS[1], lambda x: above(x, SPIKE, "low"), "ratio", lambda x: half(x * 100), lambda now, _: (now != "low") | c("outside"), lambda now, was: c("has") & (now != was) | c("outside"))
    signal(SIGNALS[2], lambda x: above(x, OWNERS, "low"), "owner", half, severe)
    signal(SIGNALS[3], level, "surplus", lambda x: half(x * 100), lambda now, moved: moved | (now == "elevated"))
    longer = c("has") & (c("lag") > c("plag") * 1.2)
    signal(SIGNALS[4], lambda x: above(x, _LAG, "low"), "lag", lambda x: x, lambda *_: longer, lambda *_: longer, c("lag") > 0)
    signal(SIGNALS[5], lambda x: above(x, SETTLEMENT, "low", True), "settled", half, lambda _, moved: moved)
    signal(SIGNALS[6], lambda x: above(x, OPERATED, "high", True), "operated", half, lambda *_: c("operated") < 60)
    return w.select("month", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("month", "x.*")


# Fixed values of the five risks: days of buffer, shares of the largest customer and vendor, operating and other shares, recurring and other spend, lags, confidence, with their scores; weights; levels.
BUFFER, REGIME_SHIFT = ((7, 85), (14, 60), (30, 35), (None, 15)), {"tightening": 15, "strong": -10}
CUSTOMER, VENDOR, SPREAD = ((50, 80), (15, 50)), ((50, 75), (15, 45)), 10
OPERATED_SHARE, OWNED, MOVED = ((0.5, 85), (0.7, 55), (None, 15)), (0.15, 15), (0.3, 10)
FIXED_COSTS, LAGGING, OTHER_SPEND, QUIET = (0.8, 55), (5, 50), (0.4, 45), 10
CONFIDENT = ((70, 80), (85, 50), (95, 25), (None, 10))
WEIGHTS = {"liquidity": 0.30, "concentration": 0.20, "dependency": 0.25, "anomaly": 0.10, "uncertainty": 0.15}
LEVELS = ((70, "high"), (40, "medium"))


def below(x: Column, steps) -> Column:  # noqa: ANN001
    """The score of the first limit that ``x`` is below."""
    return F.coalesce(*(F.lit(score) if limit is None else F.when(x < limit, score) for limit, score in steps))


def _below(x: str, steps) -> str:  # noqa: ANN001
    return "CASE " + " ".join(f"WHEN {x} < {limit} THEN {score}" for limit, score in steps[:-1]) + f" ELSE {steps[-1][1]} END"


def _share(x: str, steps) -> str:  # noqa: ANN001
    return "CASE " + " ".join(f"WHEN {x} > {limit} THEN {score}" for limit, score in steps) + " ELSE 0 END"


def _risk_sql() -> str:
    from tidemark.plans import state  # noqa: F401  registers the queries that this one stands on
    from tidemark.registry import _SQL as known

    part = {n: f"({known[n]})" for n in ("revenue_state", "state_confidence", "spend_breakdown", "liquidity_breakdown")}
    lag = d.with_tables(f"WITH {_FLOWS} SELECT coalesce(avg(lag), 0) AS lag FROM f WHERE {_COUNTS} AND inflow AND cls = 'customer_receipt'", "tagged", "cash_events")
    spike = f"greatest(CASE WHEN recurring > {FIXED_COSTS[0]} THEN {FIXED_COSTS[1]} ELSE 0 END, CASE WHEN lag > {LAGGING[0]} THEN {LAGGING[1]} ELSE 0 END, CASE WHEN other > {OTHER_SPEND[0]} THEN {OTHER_SPEND[1]} ELSE 0 END)"
    share = f"greatest({_share('top', CUSTOMER)}, {_share('top_vendor', VENDOR)})"
    return f"""WITH v AS (SELECT rv.top_customer_pct AS top, sp.top_vendor_pct AS top_vendor, CASE WHEN lq.total_outflows > 0 THEN (lq.total_inflows - lq.total_outflows) / (lq.total_outflows / lq.period_days) ELSE 1e9 END AS buffer, lq.regime, lq.operating_ratio, lq.owner_ratio, lq.transfer_ratio,
  CASE WHEN sp.total_spend > 0 THEN sp.recurring_obligations / sp.total_spend ELSE 0 END AS recurring, CASE WHEN sp.total_spend > 0 THEN sp.non_recurring_spend / sp.total_spend ELSE 0 END AS other, lg.lag, cf.confidence
  FROM {part["revenue_state"]} rv, {part["spend_breakdown"]} sp, {part["liquidity_breakdown"]} lq, ({lag}) lg, (SELECT avg(confidence) AS confidence FROM {part["state_confidence"]}) cf),
s AS (SELECT least(100, greatest(0, {_below("buffer", BUFFER)} + CASE regime WHEN 'tightening' THEN 15 WHEN 'strong' THEN -10 ELSE 0 END)) AS liquidity, CASE WHEN {share} = 0 THEN {SPREAD} ELSE {share} END AS concentration,
  least(100, {_below("operating_ratio", OPERATED_SHARE)} + CASE WHEN owner_ratio > {OWNED[0]} THEN {OWNED[1]} ELSE 0 END + CASE WHEN transfer_ratio > {MOVED[0]} THEN {MOVED[1]} ELSE 0 END) AS dependency, CASE WHEN {spike} = 0 THEN {QUIET} ELSE {spike} END AS anomaly, {_below("confidence", CONFIDENT)} AS uncertainty FROM v),
r AS ({" UNION ALL ".join(f"SELECT '{n}' AS dimension, {n}::DOUBLE AS score, {w}::DOUBLE AS weight FROM s" for n, w in WEIGHTS.items())}),
o AS (SELECT * FROM r UNION ALL SELECT 'overall', floor(sum(score * weight) + 0.5), 1.0 FROM r)
SELECT dimension, score, weight, {_above("score", LEVELS, "low", True)} AS level FROM o"""


@query("risk_state", _risk_sql())
def risk_state(spark: SparkSession, sf: str) -> DataFrame:
    """The five risks of the period by their published scores, and all of them by weight: buffer and regime, the largest customer and vendor, what is not operating, oddities of spend and settlement, doubtful data. The states that it stands on are one row each."""
    from tidemark.plans import state

    rv, sp, lq = state.revenue_state(spark, sf), spend_breakdown(spark, sf), liquidity_breakdown(spark, sf)
    cf = state.state_confidence(spark, sf).agg(F.avg("confidence").alias("confidence"))
    lg = flows(spark, sf).filter(f"{_COUNTS} and inflow and cls = 'customer_receipt'").agg(F.coalesce(F.avg("lag"), F.lit(0.0)).alias("lag"))
    sp = sp.select("top_vendor_pct", "total_spend", "recurring_obligations", "non_recurring_spend")
    lq = lq.select("total_inflows", "total_outflows", "period_days", "regime", "operating_ratio", "owner_ratio", "transfer_ratio")
    v = rv.select("top_customer_pct").crossJoin(sp).crossJoin(lq).crossJoin(cf).crossJoin(lg)
    c = F.col
    out, spent = c("total_outflows"), c("total_spend")
    buffer = F.when(out > 0, F.try_divide(c("total_inflows") - out, out / c("period_days"))).otherwise(1e9)
    shift = F.coalesce(*(F.when(c("regime") == k, x) for k, x in REGIME_SHIFT.items()), F.lit(0))
    over = lambda x, *steps: F.coalesce(*(F.when(x > limit, score) for limit, score in steps), F.lit(0))
    share = F.greatest(over(c("top_customer_pct"), *CUSTOMER), over(c("top_vendor_pct"), *VENDOR))
    of_spend = lambda x: F.coalesce(F.try_divide(c(x), spent), F.lit(0.0))
    odd = F.greatest(over(of_spend("recurring_obligations"), FIXED_COSTS), over(c("lag"), LAGGING), over(of_spend("non_recurring_spend"), OTHER_SPEND))
    scores = {
        "liquidity": F.least(F.lit(100), F.greatest(F.lit(0), below(buffer, BUFFER) + shift)),
        "concentration": F.when(share == 0, SPREAD).otherwise(share),
        "dependency": F.least(F.lit(100), below(c("operating_ratio"), OPERATED_SHARE) + over(c("owner_ratio"), OWNED) + over(c("transfer_ratio"), MOVED)),
        "anomaly": F.when(odd == 0, QUIET).otherwise(odd),
        "uncertainty": below(c("confidence"), CONFIDENT),
    }
    rows = [F.struct(F.lit(n).alias("dimension"), s.cast("double").alias("score"), F.lit(WEIGHTS[n]).alias("weight")) for n, s in scores.items()]
    overall = F.floor(sum((s * WEIGHTS[n] for n, s in scores.items()), F.lit(0.0)) + 0.5).cast("double")
    found = v.select(F.explode(F.array(*rows, F.struct(F.lit("overall").alias("dimension"), overall.alias("score"), F.lit(1.0).alias("weight")))).alias("x")).select("x.*")
    return found.withColumn("level", above(c("score"), LEVELS, "low", at_least=True))
