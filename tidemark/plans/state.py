"""State metrics: revenue, spend, liquidity, confidence, receivables and payables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import at_least, half_up
from tidemark.operators.joins import asof_join
from tidemark.registry import query
from tidemark.sources import domain as d

AMOUNT = F.col


def _sum(condition, amount="amount"):  # noqa: ANN001, ANN202
    """A conditional sum of money, zero where nothing counts."""
    return F.coalesce(F.sum(F.when(condition, F.col(amount))), F.lit(0)).cast("double")


_R = """r AS (SELECT *, policy <> 'exclude_and_review' AND economic_class = 'customer_receipt' AS counts FROM tagged WHERE direction = 'inflow')"""


@query(
    "revenue_state",
    d.with_tables(
        f"""WITH {_R},
c AS (SELECT entity_id, sum(amount)::DOUBLE AS total FROM r WHERE counts GROUP BY 1),
t AS (SELECT coalesce(sum(amount) FILTER (WHERE counts), 0)::DOUBLE AS gross, coalesce(sum(amount) FILTER (WHERE economic_class = 'refund'), 0)::DOUBLE AS contra,
  coalesce(sum(amount) FILTER (WHERE counts AND is_recurring), 0)::DOUBLE AS recurring, coalesce(sum(amount) FILTER (WHERE counts AND policy = 'include_provisional'), 0)::DOUBLE AS provisional,
  coalesce(sum(amount) FILTER (WHERE economic_class = 'customer_receipt' AND policy = 'exclude_and_review'), 0)::DOUBLE AS excluded, count(*) FILTER (WHERE counts) AS receipts FROM r)
SELECT gross AS gross_revenue, contra AS contra_revenue, round(gross - contra, 2) AS net_revenue, (SELECT count(*) FROM c) AS customer_count, round(gross / receipts, 2) AS avg_receipt,
  floor((SELECT max(total) FROM c) / gross * 1000 + 0.5) / 10 AS top_customer_pct, round((SELECT sum(power(total / gross, 2)) FROM c, t), 6) AS concentration_index,
  floor(recurring / gross * 1000 + 0.5) / 1000 AS repeat_revenue_ratio, provisional AS provisional_revenue, excluded AS excluded_revenue FROM t""",
        "tagged",
    ),
)
def revenue_state(spark: SparkSession, sf: str) -> DataFrame:
    """Gross, contra and net revenue, customers, concentration; two-level aggregation, customers first."""
    counts = (F.col("policy") != "exclude_and_review") & (F.col("economic_class") == "customer_receipt")
    r = d.tagged(spark, sf).filter("direction = 'inflow'")
    # Per customer first; the second level sees a row for each customer.
    per = r.groupBy("entity_id").agg(
        F.coalesce(F.sum(F.when(counts, F.col("amount"))), F.lit(0)).alias("total"), F.count_if(counts).alias("n"), F.sum(F.when(F.col("economic_class") == "refund", F.col("amount"))).alias("contra"),
        F.sum(F.when(counts & F.col("is_recurring"), F.col("amount"))).alias("recurring"), F.sum(F.when(counts & (F.col("policy") == "include_provisional"), F.col("amount"))).alias("provisional"),
        F.sum(F.when((F.col("economic_class") == "customer_receipt") & (F.col("policy") == "exclude_and_review"), F.col("amount"))).alias("excluded"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    squares = F.sum(F.col("total").cast("double") * F.col("total").cast("double"))
    t = per.agg(total("total").alias("g"), total("contra").alias("c"), total("recurring").alias("r"), total("provisional").alias("p"), total("excluded").alias("e"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("k"), F.max("total").cast("double").alias("top"), squares.alias("sq"))
    g = F.col("g")
    return t.select(
        g.alias("gross_revenue"), F.col("c").alias("contra_revenue"), F.round(g - F.col("c"), 2).alias("net_revenue"), F.col("k").alias("customer_count"), F.round(g / F.col("n"), 2).alias("avg_receipt"),
        half_up(F.col("top") / g * 100, 1).alias("top_customer_pct"), F.round(F.col("sq") / (g * g), 6).alias("concentration_index"), half_up(F.col("r") / g, 3).alias("repeat_revenue_ratio"),
        F.col("p").alias("provisional_revenue"), F.col("e").alias("excluded_revenue"),
    )


@query(
    "revenue_by_customer",
    d.with_tables(
        """SELECT entity_id, min(counterparty) AS name, sum(amount)::DOUBLE AS total, count(*) AS receipts FROM tagged
WHERE direction = 'inflow' AND policy <> 'exclude_and_review' AND economic_class = 'customer_receipt' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""",
        "tagged",
    ),
)
def revenue_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    """The ten customers with most revenue."""
    r = d.tagged(spark, sf).filter("direction = 'inflow' and policy <> 'exclude_and_review' and economic_class = 'customer_receipt'")
    return r.groupBy("entity_id").agg(F.min("counterparty").alias("name"), F.sum("amount").cast("double").alias("total"), F.count("*").alias("receipts")).orderBy(F.desc("total"), "entity_id").limit(10)


@query(
    "spend_state",
    d.with_tables(
        """WITH s AS (SELECT *, policy <> 'exclude_and_review' AS counts FROM tagged WHERE direction = 'outflow' AND economic_class <> 'transfer'),
v AS (SELECT entity_id, sum(amount)::DOUBLE AS total FROM s WHERE counts AND economic_class = 'vendor_payment' GROUP BY 1)
SELECT coalesce(sum(amount) FILTER (WHERE counts), 0)::DOUBLE AS total_spend, coalesce(sum(amount) FILTER (WHERE counts AND economic_class = 'vendor_payment'), 0)::DOUBLE AS vendor_spend,
  coalesce(sum(amount) FILTER (WHERE counts AND economic_class = 'payroll'), 0)::DOUBLE AS payroll, coalesce(sum(amount) FILTER (WHERE counts AND economic_class = 'tax'), 0)::DOUBLE AS tax,
  coalesce(sum(amount) FILTER (WHERE counts AND economic_class = 'bank_fee'), 0)::DOUBLE AS fees, coalesce(sum(amount) FILTER (WHERE counts AND is_recurring), 0)::DOUBLE AS recurring,
  coalesce(sum(amount) FILTER (WHERE NOT counts), 0)::DOUBLE AS excluded, (SELECT count(*) FROM v) AS vendor_count,
  (SELECT round(sum(power(total / (SELECT sum(total) FROM v), 2)), 6) FROM v) AS vendor_concentration FROM s""",
        "tagged",
    ),
)
def spend_state(spark: SparkSession, sf: str) -> DataFrame:
    """Spend by class, the recurring part, and the concentration of vendors."""
    s = d.tagged(spark, sf).filter("direction = 'outflow' and economic_class <> 'transfer'")
    counts, cls = F.col("policy") != "exclude_and_review", F.col("economic_class")
    money = lambda c, n: F.sum(F.when(c, F.col("amount"))).alias(n)
    names = {"total_spend": counts, "vendor_spend": counts & (cls == "vendor_payment"), "payroll": counts & (cls == "payroll"), "tax": counts & (cls == "tax"), "fees": counts & (cls == "bank_fee"), "recurring": counts & F.col("is_recurring"), "excluded": ~counts}
    per = s.groupBy("entity_id").agg(*[money(c, n) for n, c in names.items()])
    v = F.col("vendor_spend").cast("double")
    out = per.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in names], F.count("vendor_spend").alias("vendor_count"), (F.sum(v * v) / (F.sum(v) * F.sum(v))).alias("c"))
    return out.select(*names, "vendor_count", F.round("c", 6).alias("vendor_concentration"))


_L = """l AS (SELECT account, sum(amount) FILTER (WHERE direction = 'inflow') AS i, sum(amount) FILTER (WHERE direction = 'outflow') AS o, count(*) AS n,
  sum(amount) FILTER (WHERE direction = 'inflow' AND is_operating) AS oi, sum(amount) FILTER (WHERE direction = 'outflow' AND is_operating) AS oo, min(date) AS a, max(date) AS b
  FROM tagged WHERE affects_liquidity AND policy <> 'exclude_and_review' GROUP BY 1)"""


@query(
    "liquidity_state",
    d.with_tables(
        f"""WITH {_L},
t AS (SELECT coalesce(sum(i), 0)::DOUBLE AS i, coalesce(sum(o), 0)::DOUBLE AS o, coalesce(sum(oi), 0)::DOUBLE AS oi, coalesce(sum(oo), 0)::DOUBLE AS oo, greatest(1, max(b) - min(a)) AS days,
  sum(greatest(0, coalesce(i, 0) - coalesce(o, 0)))::DOUBLE AS ending, count(*) AS accounts FROM l)
SELECT i AS total_inflows, o AS total_outflows, oi AS operating_inflows, oo AS operating_outflows, accounts AS account_count,
  CASE WHEN (oi - oo) / i > 0.4 THEN 'strong' WHEN (oi - oo) / i >= 0.2 THEN 'stable' ELSE 'tightening' END AS liquidity_regime, round(o / days, 2) AS avg_daily_outflow,
  round(oo / days * 30, 2) AS monthly_burn, ending AS ending_cash, CASE WHEN oo > 0 AND ending > 0 THEN floor(ending / (oo / days) + 0.5)::BIGINT END AS runway_days FROM t""",
        "tagged",
    ),
)
def liquidity_state(spark: SparkSession, sf: str) -> DataFrame:
    """Flows, regime, burn and runway; per account first."""
    m = d.tagged(spark, sf).filter("affects_liquidity and policy <> 'exclude_and_review'")
    i, op = F.col("direction") == "inflow", F.col("is_operating")
    some = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).alias(n)
    per = m.groupBy("account").agg(some(i, "i"), some(~i, "o"), some(i & op, "oi"), some(~i & op, "oo"), F.min("date").alias("a"), F.max("date").alias("b"))
    t = per.agg(
        *[F.sum(c).cast("double").alias(c) for c in ("i", "o", "oi", "oo")], F.greatest(F.lit(1), F.datediff(F.max("b"), F.min("a"))).alias("days"),
        F.sum(F.greatest(F.lit(0), F.col("i") - F.col("o"))).cast("double").alias("ending"), F.count("*").alias("accounts"),
    )
    ratio, daily = (F.col("oi") - F.col("oo")) / F.col("i"), F.col("oo") / F.col("days")
    return t.select(
        F.col("i").alias("total_inflows"), F.col("o").alias("total_outflows"), F.col("oi").alias("operating_inflows"), F.col("oo").alias("operating_outflows"), F.col("accounts").alias("account_count"),
        F.when(ratio > 0.4, "strong").when(ratio >= 0.2, "stable").otherwise("tightening").alias("liquidity_regime"), F.round(F.col("o") / F.col("days"), 2).alias("avg_daily_outflow"), F.round(daily * 30, 2).alias("monthly_burn"),
        F.col("ending").alias("ending_cash"), F.when((daily > 0) & (F.col("ending") > 0), F.floor(F.try_divide(F.col("ending"), daily) + 0.5)).alias("runway_days"),
    )


@query(
    "account_flows",
    d.with_tables(
        """SELECT account, coalesce(sum(amount) FILTER (WHERE direction = 'inflow'), 0)::DOUBLE AS inflows, coalesce(sum(amount) FILTER (WHERE direction = 'outflow'), 0)::DOUBLE AS outflows,
  sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END)::DOUBLE AS net_flow, count(*) AS movement_count FROM tagged WHERE affects_liquidity GROUP BY 1 ORDER BY abs(net_flow) DESC""",
        "tagged",
    ),
)
def account_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Net flow of each account, largest first."""
    i = F.col("direction") == "inflow"
    return (
        d.tagged(spark, sf).filter("affects_liquidity").groupBy("account")
        .agg(_sum(i).alias("inflows"), _sum(~i).alias("outflows"), F.sum(F.when(i, F.col("amount")).otherwise(-F.col("amount"))).cast("double").alias("net_flow"), F.count("*").alias("movement_count"))
        .orderBy(F.abs("net_flow").desc())
    )


#: A thirty-first of the movements stands as unresolved and a thirty-seventh as the owner's, as the test tables have neither.
_CLASSED = """c AS (SELECT *, CASE WHEN key % 31 = 0 THEN 'unknown' WHEN key % 37 = 0 THEN CASE direction WHEN 'inflow' THEN 'owner_contribution' ELSE 'owner_draw' END ELSE economic_class END AS cls FROM tagged)"""


def classed(spark: SparkSession, sf: str) -> DataFrame:
    k, owner = F.col("key"), F.when(F.col("direction") == "inflow", "owner_contribution").otherwise("owner_draw")
    return d.tagged(spark, sf).withColumn("cls", F.when(k % 31 == 0, "unknown").when(k % 37 == 0, owner).otherwise(F.col("economic_class")))


@query(
    "state_confidence",
    d.with_tables(
        f"""WITH {_CLASSED}, a AS (SELECT 'revenue' AS area, * FROM c WHERE direction = 'inflow' AND is_operating UNION ALL SELECT 'spend', * FROM c WHERE direction = 'outflow' AND is_operating UNION ALL SELECT 'liquidity', * FROM c WHERE affects_liquidity),
t AS (SELECT area, sum(amount)::DOUBLE AS total, coalesce(sum(amount) FILTER (WHERE policy = 'exclude_and_review'), 0)::DOUBLE AS excluded,
  coalesce(sum(amount) FILTER (WHERE cls = 'unknown' OR area = 'liquidity' AND policy = 'exclude_and_review'), 0)::DOUBLE AS unresolved,
  coalesce(sum(amount) FILTER (WHERE policy = 'include_provisional'), 0)::DOUBLE AS provisional, coalesce(sum(amount) FILTER (WHERE confidence < 0.7), 0)::DOUBLE AS low FROM a GROUP BY 1)
SELECT area, CASE WHEN total <= 0 THEN 100.0 ELSE floor(least(CASE WHEN excluded > 0 OR unresolved > 0 THEN 0.99 ELSE 1.0 END, 1 - least(1, 0.5 * (excluded / total) + 0.4 * (unresolved / total) + 0.15 * (provisional / total) + 0.25 * (low / total))) * 1000 + 0.5) / 10 END AS confidence FROM t""",
        "tagged",
    ),
)
def state_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of revenue, spend and liquidity: penalties for excluded, unresolved, provisional and uncertain amounts; never whole where anything is excluded or unresolved."""
    op = F.col("is_operating")
    areas = F.array_compact(F.array(F.when((F.col("direction") == "inflow") & op, "revenue"), F.when((F.col("direction") == "outflow") & op, "spend"), F.when(F.col("affects_liquidity"), "liquidity")))
    excluded = F.col("policy") == "exclude_and_review"
    t = classed(spark, sf).withColumn("area", F.explode(areas)).groupBy("area").agg(
        F.sum("amount").cast("double").alias("total"), _sum(excluded).alias("excluded"), _sum((F.col("cls") == "unknown") | (F.col("area") == "liquidity") & excluded).alias("unresolved"),
        _sum(F.col("policy") == "include_provisional").alias("provisional"), _sum(F.col("confidence") < 0.7).alias("low"),
    )
    return t.select("area", area_confidence(*map(F.col, ("total", "excluded", "unresolved", "provisional", "low"))).alias("confidence"))


def area_confidence(total: Column, excluded: Column, unresolved: Column, provisional: Column, low: Column) -> Column:
    """In percent, with one decimal; an area without amounts is certain."""
    penalty = F.least(F.lit(1.0), 0.5 * (excluded / total) + 0.4 * (unresolved / total) + 0.15 * (provisional / total) + 0.25 * (low / total))
    most = F.when((excluded > 0) | (unresolved > 0), 0.99).otherwise(1.0)
    return F.when(total <= 0, 100.0).otherwise(F.floor(F.least(most, 1 - penalty) * 1000 + 0.5) / 10)


@query(
    "unresolved_impact",
    d.with_tables(
        f"""WITH {_CLASSED}, t AS (SELECT coalesce(sum(amount) FILTER (WHERE u AND i), 0)::DOUBLE AS a, coalesce(sum(amount) FILTER (WHERE u AND NOT i), 0)::DOUBLE AS b, count(*) FILTER (WHERE u) AS n, coalesce(sum(amount) FILTER (WHERE u AND amount > 500), 0)::DOUBLE AS e,
  coalesce(sum(amount) FILTER (WHERE i), 0)::DOUBLE AS ti, coalesce(sum(amount) FILTER (WHERE i AND is_operating), 0)::DOUBLE AS oi, coalesce(sum(amount) FILTER (WHERE r), 0)::DOUBLE AS tr, coalesce(sum(amount) FILTER (WHERE r AND u), 0)::DOUBLE AS ur
  FROM (SELECT *, cls = 'unknown' AS u, direction = 'inflow' AS i, date >= DATE '{d.AS_OF}' - 30 AS r FROM c))
SELECT a AS unresolved_inflow_total, b AS unresolved_outflow_total, n AS unresolved_count, e AS unresolved_operating_exposure, CASE WHEN ti > 0 THEN floor(a / ti * 1000 + 0.5) / 10 ELSE 0.0 END AS unresolved_pct_of_inflows,
  CASE WHEN oi > 0 THEN floor(a / oi * 1000 + 0.5) / 10 ELSE 0.0 END AS unresolved_pct_of_operating_inflows, CASE WHEN tr > 0 THEN floor(ur / tr * 1000 + 0.5) / 10 ELSE 0.0 END AS unresolved_pct_of_last_30d FROM t""",
        "tagged",
    ),
)
def unresolved_impact(spark: SparkSession, sf: str) -> DataFrame:
    """What is of unknown class: totals by direction, what exceeds 500, and three shares in percent."""
    u, i, op = F.col("cls") == "unknown", F.col("direction") == "inflow", F.col("is_operating")
    recent = F.col("date") >= F.date_sub(F.lit(d.AS_OF).cast("date"), 30)
    t = classed(spark, sf).agg(
        _sum(u & i).alias("unresolved_inflow_total"), _sum(u & ~i).alias("unresolved_outflow_total"), F.count_if(u).alias("unresolved_count"), _sum(u & (F.col("amount") > 500)).alias("unresolved_operating_exposure"),
        _sum(i).alias("ti"), _sum(i & op).alias("oi"), _sum(recent).alias("tr"), _sum(recent & u).alias("ur"),
    )
    pct = lambda x, of: F.when(F.col(of) > 0, half_up(F.try_divide(F.col(x), F.col(of)) * 100, 1)).otherwise(0.0)
    shares = {"unresolved_pct_of_inflows": pct("unresolved_inflow_total", "ti"), "unresolved_pct_of_operating_inflows": pct("unresolved_inflow_total", "oi"), "unresolved_pct_of_last_30d": pct("ur", "tr")}
    return t.withColumns(shares).drop("ti", "oi", "tr", "ur")


@query(
    "owner_dependency",
    d.with_tables(
        f"""WITH {_CLASSED}, t AS (SELECT coalesce(sum(amount) FILTER (WHERE cls = 'owner_contribution'), 0)::DOUBLE AS a, coalesce(sum(amount) FILTER (WHERE cls = 'owner_draw'), 0)::DOUBLE AS b, count(*) FILTER (WHERE cls = 'owner_contribution') AS contribution_count,
  count(*) FILTER (WHERE cls = 'owner_draw') AS draw_count, coalesce(sum(amount) FILTER (WHERE direction = 'inflow' AND policy <> 'exclude_and_review'), 0)::DOUBLE AS ti FROM c)
SELECT a AS owner_inflow_total, ti AS total_inflow, CASE WHEN ti > 0 THEN floor(a / ti * 1000 + 0.5) / 1000 ELSE 0.0 END AS owner_dependency_ratio, b AS owner_draw_total, round(a - b, 2) AS net_owner_flow, contribution_count, draw_count FROM t""",
        "tagged",
    ),
)
def owner_dependency(spark: SparkSession, sf: str) -> DataFrame:
    """What owners put in and drew, against all that came in and is not excluded."""
    a, b = F.col("cls") == "owner_contribution", F.col("cls") == "owner_draw"
    t = classed(spark, sf).agg(
        _sum(a).alias("owner_inflow_total"), _sum(b).alias("owner_draw_total"), F.count_if(a).alias("contribution_count"), F.count_if(b).alias("draw_count"),
        _sum((F.col("direction") == "inflow") & (F.col("policy") != "exclude_and_review")).alias("total_inflow"),
    )
    ratio = F.when(F.col("total_inflow") > 0, half_up(F.try_divide("owner_inflow_total", "total_inflow"), 3)).otherwise(0.0)
    return t.withColumns({"owner_dependency_ratio": ratio, "net_owner_flow": F.round(F.col("owner_inflow_total") - F.col("owner_draw_total"), 2)})


@query(
    "settlement_lag",
    d.with_tables(
        """WITH r AS (SELECT ts FROM flows WHERE flow = 'inflow'), s AS (SELECT event_id, ts FROM flows WHERE flow = 'settlement'),
j AS (SELECT s.event_id, floor(date_diff('second', r.ts, s.ts) / 86400.0 + 0.5) AS lag FROM s ASOF JOIN r ON s.ts > r.ts)
SELECT round(avg(lag), 1) AS avg_lag_days, count(*) AS samples, CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 10 THEN 'medium' WHEN count(*) >= 3 THEN 'low' ELSE 'insufficient' END AS confidence
FROM j WHERE lag BETWEEN 0 AND 365""",
        "flows",
    ),
)
def settlement_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Days from the last receipt strictly before each settlement.

    Days are the keys of the union, so that no window spans the table: the last receipt of
    earlier days comes from a window over a row for each day, and meets its day by equality.
    """
    f = d.flows(spark, sf).withColumn("day", F.to_date("ts"))
    r, s = f.filter("flow = 'inflow'").select("day", "ts"), f.filter("flow = 'settlement'").select("day", "ts", "event_id")
    same_day = asof_join(s, r.withColumn("receipt", F.col("ts")), ["day"], "ts", "ts", "receipt", strict=True)
    days = s.select("day").distinct().join(r.groupBy("day").agg(F.max("ts").alias("last")), "day", "full")
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = days.select("day", F.last("last", ignorenulls=True).over(before).alias("last"))
    both = same_day.join(earlier, "day", "left").withColumn("receipt", F.coalesce("asof_receipt", "last"))
    lag = F.floor((F.unix_timestamp("ts") - F.unix_timestamp("receipt")) / 86400.0 + 0.5)
    kept = both.select(lag.alias("lag")).filter("lag between 0 and 365")
    n = F.count("*")
    return kept.agg(F.round(F.avg("lag"), 1).alias("avg_lag_days"), n.alias("samples"), at_least(n, [(20, "high"), (10, "medium"), (3, "low")], "insufficient").alias("confidence"))


@query(
    "entity_settlement_lag",
    d.with_tables(
        """WITH r AS (SELECT entity_id, ts FROM flows WHERE flow = 'inflow'), s AS (SELECT event_id, entity_id, ts FROM flows WHERE flow = 'settlement')
SELECT s.entity_id, s.event_id, r.ts AS receipt FROM s ASOF LEFT JOIN r ON s.entity_id = r.entity_id AND s.ts >= r.ts""",
        "flows",
    ),
)
def entity_settlement_lag(spark: SparkSession, sf: str) -> DataFrame:
    """The last receipt of the same entity at or before each settlement (inclusive as-of join)."""
    f = d.flows(spark, sf)
    r, s = f.filter("flow = 'inflow'").select("entity_id", "ts", F.col("ts").alias("receipt")), f.filter("flow = 'settlement'").select("entity_id", "event_id", "ts")
    return asof_join(s, r, ["entity_id"], "ts", "ts", "receipt", strict=False).select("entity_id", "event_id", F.col("asof_receipt").alias("receipt"))


@query(
    "ar_state",
    d.with_tables(
        f"""SELECT sum(outstanding)::DOUBLE AS outstanding, coalesce(sum(outstanding) FILTER (WHERE expected_date < DATE '{d.AS_OF}'), 0)::DOUBLE AS overdue, count(*) AS open_count,
  count(*) FILTER (WHERE expected_date < DATE '{d.AS_OF}') AS overdue_count, round(avg(expected_date - DATE '{d.AS_OF}'), 4) AS avg_days_to_due
FROM cash_events WHERE event_type = 'ar' AND outstanding > 0.01""",
        "cash_events",
    ),
)
def ar_state(spark: SparkSession, sf: str) -> DataFrame:
    """Receivables: outstanding, overdue and days to due."""
    today = F.lit(d.AS_OF).cast("date")
    late = F.col("expected_date") < today
    return d.cash_events(spark, sf).filter("event_type = 'ar' and outstanding > 0.01").agg(
        F.sum("outstanding").cast("double").alias("outstanding"), _sum(late, "outstanding").alias("overdue"), F.count("*").alias("open_count"), F.count_if(late).alias("overdue_count"), F.round(F.avg(F.datediff("expected_date", today)), 4).alias("avg_days_to_due")
    )


@query(
    "ap_obligations",
    d.with_tables(
        f"""WITH g AS (SELECT entity_id, date, amount, lag(date) OVER (PARTITION BY entity_id ORDER BY date, movement_id) AS p FROM movements WHERE direction = 'outflow'),
v AS (SELECT entity_id, max(date) AS last_paid, avg(date - p) AS cadence, count(*) AS n, round((sum(amount) / count(*))::DOUBLE, 2) AS avg_amount FROM g GROUP BY 1)
SELECT entity_id, last_paid, round(cadence, 4) AS cadence, avg_amount, last_paid + (ceil(greatest(1, (DATE '{d.AS_OF}' - last_paid)) / greatest(1.0, cadence)) * greatest(1.0, cadence))::INTEGER AS next_date
FROM (SELECT entity_id, last_paid, round(cadence) AS cadence, n, avg_amount FROM v) WHERE n >= 3 AND cadence IS NOT NULL""",
        "movements",
    ),
)
def ap_obligations(spark: SparkSession, sf: str) -> DataFrame:
    """The next payment of each vendor: the last one carried forward by its mean gap (in whole days) past today."""
    w = Window.partitionBy("entity_id").orderBy("date", "movement_id")
    g = d.movements(spark, sf).filter("direction = 'outflow'").withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    v = g.groupBy("entity_id").agg(F.max("date").alias("last_paid"), F.round(F.avg("gap")).alias("cadence"), F.count("*").alias("n"), F.round((F.sum("amount") / F.count("*")).cast("double"), 2).alias("avg_amount"))
    cadence = F.greatest(F.lit(1.0), F.col("cadence"))
    gap = F.greatest(F.lit(1), F.datediff(F.lit(d.AS_OF).cast("date"), F.col("last_paid")))
    return v.filter("n >= 3 and cadence is not null").select("entity_id", "last_paid", "cadence", "avg_amount", F.date_add("last_paid", (F.ceil(gap / cadence) * cadence).cast("int")).alias("next_date"))


@query(
    "transition_signals",
    d.with_tables(
        """WITH m AS (SELECT date_trunc('month', date)::DATE AS month, coalesce(sum(amount) FILTER (WHERE direction = 'inflow'), 0)::DOUBLE AS i, coalesce(sum(amount) FILTER (WHERE direction = 'outflow'), 0)::DOUBLE AS o FROM movements GROUP BY 1),
w AS (SELECT *, avg(i) OVER p AS mean_i, stddev_samp(i) OVER p AS sd_i, count(*) OVER p AS n FROM m WINDOW p AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT month, round(i, 2) AS inflow, round(o, 2) AS outflow, CASE WHEN n < 3 THEN 'insufficient' WHEN i > mean_i + 2 * sd_i THEN 'surge' WHEN i < mean_i - 2 * sd_i THEN 'drop' ELSE 'steady' END AS signal FROM w""",
        "movements",
    ),
)
def transition_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Months whose inflow leaves two deviations of the six before; the window sees a row for each month."""
    i = F.col("direction") == "inflow"
    m = d.movements(spark, sf).groupBy(F.trunc("date", "month").alias("month")).agg(_sum(i).alias("i"), _sum(~i).alias("o"))
    w = Window.orderBy("month").rowsBetween(-6, -1)
    x = m.withColumns({"mean": F.avg("i").over(w), "sd": F.stddev_samp("i").over(w), "n": F.count("*").over(w)})
    signal = F.when(F.col("n") < 3, "insufficient").when(F.col("i") > F.col("mean") + 2 * F.col("sd"), "surge").when(F.col("i") < F.col("mean") - 2 * F.col("sd"), "drop").otherwise("steady")
    return x.select("month", F.round("i", 2).alias("inflow"), F.round("o", 2).alias("outflow"), signal.alias("signal"))


@query(
    "risk_dimensions",
    d.with_tables(
        """WITH c AS (SELECT entity_id, sum(amount)::DOUBLE AS t FROM movements WHERE direction = 'inflow' GROUP BY 1),
k AS (SELECT sum(power(t / (SELECT sum(t) FROM c), 2)) AS hhi, max(t) / (SELECT sum(t) FROM c) AS top FROM c),
b AS (SELECT sum(amount) FILTER (WHERE direction = 'outflow')::DOUBLE / sum(amount) FILTER (WHERE direction = 'inflow')::DOUBLE AS burn, count(*) FILTER (WHERE policy = 'exclude_and_review') * 1.0::DOUBLE / count(*) AS unresolved FROM tagged),
o AS (SELECT sum(outstanding) FILTER (WHERE expected_date < DATE '2001-11-30')::DOUBLE / sum(outstanding)::DOUBLE AS overdue FROM cash_events WHERE event_type = 'ar')
SELECT dimension, weight, round(least(1.0, greatest(0.0, score)), 6) AS score FROM (
  SELECT 'burn' AS dimension, 0.30::DOUBLE AS weight, burn AS score FROM b UNION ALL SELECT 'concentration', 0.20, hhi * 10 FROM k UNION ALL SELECT 'collections', 0.25, overdue FROM o
  UNION ALL SELECT 'top_customer', 0.10, top * 5 FROM k UNION ALL SELECT 'data_quality', 0.15, unresolved FROM b)""",
        "tagged",
        "cash_events",
    ),
)
def risk_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Five weighted risks between 0 and 1."""
    t = d.tagged(spark, sf)
    i = F.col("direction") == "inflow"
    per = t.filter(i).groupBy("entity_id").agg(F.sum("amount").cast("double").alias("t"))
    k = per.agg((F.sum(F.col("t") * F.col("t")) / (F.sum("t") * F.sum("t"))).alias("hhi"), (F.max("t") / F.sum("t")).alias("top"))
    b = t.agg((_sum(~i) / _sum(i)).alias("burn"), (F.count_if(F.col("policy") == "exclude_and_review") / F.count("*")).alias("unresolved"))
    o = d.cash_events(spark, sf).filter("event_type = 'ar'").agg((_sum(F.col("expected_date") < F.lit(d.AS_OF).cast("date"), "outstanding") / F.sum("outstanding").cast("double")).alias("overdue"))
    rows = lambda df, parts: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.lit(w).alias("weight"), s.alias("score")) for n, w, s in parts])).alias("x")).select("x.*")
    out = rows(b, [("burn", 0.30, F.col("burn")), ("data_quality", 0.15, F.col("unresolved"))]).union(rows(k, [("concentration", 0.20, F.col("hhi") * 10), ("top_customer", 0.10, F.col("top") * 5)])).union(rows(o, [("collections", 0.25, F.col("overdue"))]))
    return out.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))), 6))
