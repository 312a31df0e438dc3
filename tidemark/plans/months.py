"""Months ahead from behaviour: what customers and vendors pay, what recurs, and the other classes, with floors by history; and credits applied to bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.profiles import pattern_statistics
from tidemark.registry import query
from tidemark.sources import domain as d

#: The day that stands for today, the months foretold, and what scenarios multiply inflows and outflows by.
TODAY, MONTHS = "1998-08-01", 6
SCENARIOS = {"base": (1.0, 1.0), "pessimistic": (0.88, 1.12), "optimistic": (1.15, 0.95)}
# Decay of customers, vendors and classes with the months; payments that make a model sure, and shares by confidence; collection of open invoices; floors by history; longest intervals.
CUSTOMER, VENDOR, CLASS = (0.15, 0.1), (0.1, 0.05), (0.05, 0.1)
SURE, SHARES = 6, {"high": 1.0, "medium": 0.7, "low": 0.4}
COLLECTED, PIPELINE, ALONE = (0.4, 0.1, 0.05), (0.35, 0.08, 0.05), 0.5
FLOOR, VENDOR_FLOOR, EPISODIC = 0.3, (0.85, 0.06), 0.5
LONGEST, VENDOR_LONGEST, LEAST_CONFIDENCE = 60, 45, 0.5
FIXED = ("payroll", "tax", "bank_fee")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return d.movements(spark, sf).filter(F.col("date") <= F.lit(TODAY).cast("date"))


def _months(df: DataFrame) -> DataFrame:
    """Each row once a month ahead: i, first and end."""
    today = F.lit(TODAY).cast("date")
    x = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
    return x.withColumns({"first": F.add_months(today, F.col("i")), "end": F.add_months(today, F.col("i") + 1)})


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """i and total: what customers pay in each month; a model's next date, else its interval, else its open invoices, else its mean."""
    today = F.lit(TODAY).cast("date")
    w = Window.partitionBy("entity_id").orderBy("date", "movement_id")
    g = _history(spark, sf).filter("direction = 'inflow'").select("entity_id", "date", "amount", F.datediff("date", F.lag("date").over(w)).alias("gap"))
    m = g.groupBy("entity_id").agg(F.count("*").alias("n"), (F.floor(F.sum("amount").cast("double") / F.count("*") * 100 + 0.5) / 100).alias("amount"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("interval"), F.max("date").alias("last"))
    owed = d.cash_events(spark, sf).filter((F.col("event_type") == "ar") & (F.col("status") != "paid") & (F.col("issued") <= today)).groupBy("entity_id").agg(F.sum("outstanding").cast("double").alias("open"))
    m = m.join(owed, "entity_id", "full").fillna(0, ["n", "amount", "interval", "open"])
    n, gap, i = F.col("n"), F.col("interval"), F.col("i")
    idle = F.datediff(today, "last")
    step = F.greatest(F.lit(1), F.floor(gap + 0.5)).cast("int")
    fade = 1 / (1 + F.exp(2.5 * (idle / step - 2)))
    chance = F.when(n == 0, 0.3).otherwise(F.greatest(F.lit(0.02), F.least(F.lit(0.95), F.when(n >= 3, fade * 0.9 * (1 + 0.1 * F.least(F.lit(1.0), n / 6.0))).otherwise(0.45 * fade))))
    due = F.when(gap > 0, F.date_add("last", (F.ceil(F.greatest(F.lit(1), idle) / step) * step).cast("int")))
    share = F.when(n >= 6, SHARES["high"]).when(n >= 3, SHARES["medium"]).otherwise(SHARES["low"])
    m = _months(m.withColumns({"chance": chance, "due": due, "quality": F.least(F.lit(1.0), n / float(SURE)) * share}))
    decay = 1 / (1 + i * (CUSTOMER[0] - F.col("quality") * CUSTOMER[1]))
    rate = F.greatest(F.lit(COLLECTED[2]), COLLECTED[0] - i * COLLECTED[1])
    expected = F.col("amount") * F.col("chance")
    pays = (
        F.when((F.col("due") >= F.col("first")) & (F.col("due") < F.col("end")), expected)
        .when((gap > 0) & (gap <= LONGEST), expected * F.least(F.lit(4.0), F.try_divide(F.lit(30.0), gap)) * decay)
        .when(F.col("open") > 0, F.col("open") * F.col("chance") * rate)
        .when((n >= 2) & (F.col("amount") > 0), expected * decay * ALONE)
        .otherwise(0.0)
    )
    return m.groupBy("i").agg(F.sum(pays).alias("customers"), F.sum("open").alias("pipeline"))


def vendors(spark: SparkSession, sf: str) -> DataFrame:
    """i and total: what vendors of a steady pattern are paid in each month."""
    today = F.lit(TODAY).cast("date")
    p = pattern_statistics(_history(spark, sf).filter("direction = 'outflow'")).filter(F.col("recurrence").isin("clockwork", "recurring") & (F.col("conf") >= LEAST_CONFIDENCE))
    step = F.greatest(F.lit(1), F.floor(F.col("gap") + 0.5)).cast("int")
    due = F.date_add("last", (F.ceil(F.greatest(F.lit(1), F.datediff(today, "last")) / step) * step).cast("int"))
    m = _months(p.withColumn("due", due))
    decay = 1 / (1 + F.col("i") * (VENDOR[0] - F.col("conf") * VENDOR[1]))
    pays = (
        F.when((F.col("due") >= F.col("first")) & (F.col("due") < F.col("end")), F.col("mean") * F.greatest(F.lit(0.5), F.col("conf")))
        .when((F.col("gap") > 0) & (F.col("gap") <= VENDOR_LONGEST), F.col("mean") * F.least(F.lit(4.0), F.try_divide(F.lit(30.0), F.col("gap"))) * F.col("conf") * decay)
        .otherwise(0.0)
    )
    return m.groupBy("i").agg(F.sum(pays).alias("vendors"))


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """direction, economic_class, mean a month, volatility and the share of months with movements."""
    h = _history(spark, sf)
    c = h.groupBy("direction", "economic_class", F.trunc("date", "month").alias("month")).agg(F.sum("amount").cast("double").alias("total"), F.min("date").alias("a"), F.max("date").alias("b"))
    span = F.greatest(F.lit(1.0), F.datediff(F.max("b"), F.min("a")) / 30.0)
    every = h.agg(F.greatest(F.lit(1.0), F.months_between(F.trunc(F.max("date"), "month"), F.trunc(F.min("date"), "month")) + 1).alias("every"))
    x = c.groupBy("direction", "economic_class").agg((F.sum("total") / span).alias("mean"), F.least(F.lit(3.0), F.coalesce(F.stddev_samp("total") / F.avg("total"), F.lit(0.0))).alias("volatility"), F.count("*").alias("months"))
    return x.crossJoin(F.broadcast(every)).withColumn("cover", F.col("months") / F.col("every")).drop("months", "every")


_SQL = f"""h AS (SELECT * FROM movements WHERE date <= DATE '{TODAY}'),
mo AS (SELECT i::INTEGER AS i, (DATE '{TODAY}' + to_months(i::INTEGER))::DATE AS first, (DATE '{TODAY}' + to_months(i::INTEGER + 1))::DATE AS "end" FROM range({MONTHS}) r(i)),
cg AS (SELECT entity_id, date, amount, date - lag(date) OVER (PARTITION BY entity_id ORDER BY date, movement_id) AS gap FROM h WHERE direction = 'inflow'),
cm AS (SELECT entity_id, count(*) AS n, floor(sum(amount)::DOUBLE / count(*) * 100 + 0.5) / 100 AS amount, coalesce(avg(gap), 0) AS interval, max(date) AS last FROM cg GROUP BY 1),
ow AS (SELECT entity_id, sum(outstanding)::DOUBLE AS open FROM cash_events WHERE event_type = 'ar' AND status <> 'paid' AND issued <= DATE '{TODAY}' GROUP BY 1),
cj AS (SELECT coalesce(n, 0) AS n, coalesce(amount, 0) AS amount, coalesce(interval, 0) AS gap, last, coalesce(open, 0) AS open, DATE '{TODAY}' - last AS idle, greatest(1, floor(coalesce(interval, 0) + 0.5))::INTEGER AS step FROM cm FULL JOIN ow USING (entity_id)),
ck AS (SELECT *, CASE WHEN n = 0 THEN 0.3 ELSE greatest(0.02, least(0.95, CASE WHEN n >= 3 THEN 1 / (1 + exp(2.5 * (idle::DOUBLE / step - 2))) * 0.9 * (1 + 0.1 * least(1.0, n / 6.0)) ELSE 0.45 / (1 + exp(2.5 * (idle::DOUBLE / step - 2))) END)) END::DOUBLE AS chance,
  CASE WHEN gap > 0 THEN last + (ceil(greatest(1, idle)::DOUBLE / step) * step)::INTEGER END AS due, least(1.0, n / 6.0) * CASE WHEN n >= 6 THEN 1.0 WHEN n >= 3 THEN 0.7 ELSE 0.4 END AS quality FROM cj),
cu AS (SELECT i, sum(CASE WHEN due >= first AND due < "end" THEN amount * chance WHEN gap > 0 AND gap <= {LONGEST} THEN amount * chance * least(4.0, 30.0 / gap) / (1 + i * ({CUSTOMER[0]} - quality * {CUSTOMER[1]})) WHEN open > 0 THEN open * chance * greatest({COLLECTED[2]}, {COLLECTED[0]} - i * {COLLECTED[1]})
  WHEN n >= 2 AND amount > 0 THEN amount * chance / (1 + i * ({CUSTOMER[0]} - quality * {CUSTOMER[1]})) * {ALONE} ELSE 0.0 END)::DOUBLE AS customers, sum(open) AS pipeline FROM ck, mo GROUP BY 1),
vg AS (SELECT entity_id, date, amount::DOUBLE AS amount, date - lag(date) OVER (PARTITION BY entity_id ORDER BY date, movement_id) AS gap FROM h WHERE direction = 'outflow'),
va AS (SELECT entity_id, count(*) AS n, avg(amount) AS mean, stddev_pop(amount) AS sd, coalesce(avg(gap), 0) AS gap, coalesce(stddev_pop(gap), 0) AS gap_sd, max(date) AS last FROM vg GROUP BY 1),
vp AS (SELECT *, CASE WHEN n < 3 THEN 0.0 ELSE 0.7 * greatest(0, 1 - CASE WHEN gap > 0 THEN gap_sd / gap ELSE 1 END) + 0.3 * greatest(0, 1 - CASE WHEN mean > 0 THEN sd / mean ELSE 1 END) END AS conf, greatest(1, floor(gap + 0.5))::INTEGER AS step FROM va),
vd AS (SELECT *, last + (ceil(greatest(1, DATE '{TODAY}' - last)::DOUBLE / step) * step)::INTEGER AS due FROM vp WHERE conf > 0.5),
ve AS (SELECT i, sum(CASE WHEN due >= first AND due < "end" THEN mean * greatest(0.5, conf) WHEN gap > 0 AND gap <= {VENDOR_LONGEST} THEN mean * least(4.0, 30.0 / gap) * conf / (1 + i * ({VENDOR[0]} - conf * {VENDOR[1]})) ELSE 0.0 END)::DOUBLE AS vendors FROM vd, mo GROUP BY 1),
k0 AS (SELECT direction, economic_class, date_trunc('month', date) AS month, sum(amount)::DOUBLE AS total, min(date) AS a, max(date) AS b FROM h GROUP BY 1, 2, 3),
ev AS (SELECT greatest(1, date_diff('month', min(date), max(date)) + 1)::DOUBLE AS every FROM h),
kc AS (SELECT direction, economic_class, sum(total) / greatest(1.0, (max(b) - min(a)) / 30.0) AS mean, least(3.0, coalesce(stddev_samp(total) / avg(total), 0)) AS volatility, count(*) / any_value(every) AS cover FROM k0, ev GROUP BY 1, 2),
hi AS (SELECT coalesce(max(mean) FILTER (WHERE direction = 'inflow' AND economic_class = 'customer_receipt'), 0) AS receipts, coalesce(max(volatility) FILTER (WHERE direction = 'inflow' AND economic_class = 'customer_receipt'), 0.5) AS vol, coalesce(max(mean) FILTER (WHERE direction = 'outflow' AND economic_class = 'vendor_payment'), 0) AS paid,
  coalesce(sum(mean) FILTER (WHERE direction = 'outflow' AND economic_class IN {FIXED}), 0) AS fixed FROM kc),
ot AS (SELECT i, coalesce(sum(x) FILTER (WHERE direction = 'inflow'), 0)::DOUBLE AS other_in, coalesce(sum(x) FILTER (WHERE direction = 'outflow'), 0)::DOUBLE AS other_out FROM (SELECT i, direction, mean * CASE WHEN cover > 0.5 THEN 1.0 ELSE {EPISODIC} / (1 + i * ({CLASS[0]} + volatility * {CLASS[1]})) END AS x FROM kc, mo
  WHERE cover > 0.2 AND NOT (direction = 'inflow' AND economic_class = 'customer_receipt') AND NOT (direction = 'outflow' AND economic_class IN ('vendor_payment', {", ".join(repr(x) for x in FIXED)}))) GROUP BY 1),
b0 AS (SELECT mo.i, first AS month, CASE WHEN coalesce(customers, 0) = 0 THEN coalesce(pipeline, 0) * greatest({PIPELINE[2]}, {PIPELINE[0]} - mo.i * {PIPELINE[1]}) ELSE customers END AS c, coalesce(vendors, 0) AS v, hi.*, coalesce(other_in, 0) AS other_in, coalesce(other_out, 0) AS other_out,
  receipts * (1 - least(1, vol) * {FLOOR}) / (1 + mo.i * ({CLASS[0]} + least(1, vol) * {CLASS[1]})) AS f, paid * {VENDOR_FLOOR[0]} / (1 + mo.i * {VENDOR_FLOOR[1]}) AS vf FROM mo LEFT JOIN cu USING (i) LEFT JOIN ve USING (i) LEFT JOIN ot USING (i), hi),
b1 AS (SELECT *, CASE WHEN f > 0 AND c < f THEN c * least(1, c / f) + f * (1 - least(1, c / f)) ELSE c END AS cc, CASE WHEN paid > 0 AND v + fixed < vf THEN vf - fixed ELSE v END AS vv FROM b0)"""
_SCEN = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in SCENARIOS.items()) + ") AS s(scenario, up, down)"


@query(
    "month_simulation",
    d.with_tables(
        f"""WITH {_SQL} SELECT scenario, month, round(cc * up, 2) AS customers, round(vv * down, 2) AS vendors, round(fixed * down, 2) AS recurring, round(other_in * up, 2) AS other_in, round(other_out * down, 2) AS other_out,
  round((cc + other_in) * up, 2) AS inflows, round((vv + fixed + other_out) * down, 2) AS outflows FROM b1, {_SCEN}""",
        "movements",
        "cash_events",
    ),
)
def month_simulation(spark: SparkSession, sf: str) -> DataFrame:
    """Six months from the models of customers and vendors, drawn up to floors by history, with what recurs and the other classes, under three scenarios. Entities meet the months in an explode and are summed by month; then there are six rows."""
    k = classes(spark, sf)
    inflow, cls, mean = F.col("direction") == "inflow", F.col("economic_class"), F.col("mean")
    receipt, vendor, fixed = inflow & (cls == "customer_receipt"), ~inflow & (cls == "vendor_payment"), ~inflow & cls.isin(*FIXED)
    of = lambda c, x: F.max(F.when(c, F.col(x)))
    past = k.agg(F.coalesce(of(receipt, "mean"), F.lit(0.0)).alias("receipts"), F.coalesce(of(receipt, "volatility"), F.lit(0.5)).alias("vol"), F.coalesce(of(vendor, "mean"), F.lit(0.0)).alias("paid"), F.coalesce(F.sum(F.when(fixed, mean)), F.lit(0.0)).alias("fixed"))
    fade = F.when(F.col("cover") > 0.5, 1.0).otherwise(EPISODIC / (1 + F.col("i") * (CLASS[0] + F.col("volatility") * CLASS[1])))
    other = _months(k.filter(~receipt & ~vendor & ~fixed & (F.col("cover") > 0.2))).withColumn("x", mean * fade).groupBy("i").agg(F.sum(F.when(inflow, F.col("x"))).alias("other_in"), F.sum(F.when(~inflow, F.col("x"))).alias("other_out"))
    every = _months(spark.range(1))
    x = every.join(customers(spark, sf), "i", "left").join(vendors(spark, sf), "i", "left").join(other, "i", "left").crossJoin(F.broadcast(past)).fillna(0.0, ["customers", "pipeline", "vendors", "other_in", "other_out"])
    i, vol = F.col("i"), F.least(F.lit(1.0), F.col("vol"))
    x = x.withColumns(
        {
            "c": F.when(F.col("customers") == 0, F.col("pipeline") * F.greatest(F.lit(PIPELINE[2]), PIPELINE[0] - i * PIPELINE[1])).otherwise(F.col("customers")),
            "f": F.col("receipts") * (1 - vol * FLOOR) / (1 + i * (CLASS[0] + vol * CLASS[1])),
            "vf": F.col("paid") * VENDOR_FLOOR[0] / (1 + i * VENDOR_FLOOR[1]),
        }
    )
    part = F.least(F.lit(1.0), F.try_divide("c", "f"))
    x = x.withColumns({"cc": F.when((F.col("f") > 0) & (F.col("c") < F.col("f")), F.col("c") * part + F.col("f") * (1 - part)).otherwise(F.col("c")), "vv": F.when((F.col("paid") > 0) & (F.col("vendors") + F.col("fixed") < F.col("vf")), F.col("vf") - F.col("fixed")).otherwise(F.col("vendors"))})
    s = x.withColumn("s", F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(a).alias("up"), F.lit(b).alias("down")) for k, (a, b) in SCENARIOS.items())))).select("*", "s.*")
    two = lambda value, name: F.round(value, 2).alias(name)
    up, down = F.col("up"), F.col("down")
    return s.select(
        "scenario", F.col("first").alias("month"), two(F.col("cc") * up, "customers"), two(F.col("vv") * down, "vendors"), two(F.col("fixed") * down, "recurring"), two(F.col("other_in") * up, "other_in"), two(F.col("other_out") * down, "other_out"),
        two((F.col("cc") + F.col("other_in")) * up, "inflows"), two((F.col("vv") + F.col("fixed") + F.col("other_out")) * down, "outflows"),
    )


def overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """a, b and applied: what intervals of amounts laid end to end on both sides have in common, within each key; left: key, a, amount and order, right: key, b, amount and order, amounts above zero.

    The ends of both sides stand in one order, and what lies between two ends goes to the next of each side: one window for each key, no pairs.
    """
    by = Window.partitionBy(key)
    ends = lambda x: x.withColumn("end", F.sum("amount").over(by.orderBy("order").rowsBetween(Window.unboundedPreceding, 0))).drop("order")
    both = ends(left).unionByName(ends(right), allowMissingColumns=True)
    back = by.orderBy(F.desc("end"))
    grown = back.rowsBetween(Window.unboundedPreceding, 0)
    parts = both.select(key, F.last("a", ignorenulls=True).over(grown).alias("a"), F.last("b", ignorenulls=True).over(grown).alias("b"), (F.col("end") - F.coalesce(F.lead("end").over(back), F.lit(0))).alias("applied"))
    return parts.filter("applied > 0 AND a IS NOT NULL AND b IS NOT NULL")


_CREDITS = """e AS (SELECT event_id, event_type, entity_id, CASE WHEN event_type = 'ap' AND key % 9 = 0 THEN -floor(amount / 4) WHEN event_type = 'ar' AND key % 25 = 0 THEN -floor(amount / 10) ELSE outstanding END::DECIMAL(18,2) AS outstanding FROM cash_events)"""


def _with_credits(spark: SparkSession, sf: str) -> DataFrame:
    """Events, some of which stand for credits: a ninth of the payables and a twenty-fifth of the receivables are paid beyond what they asked."""
    k, a = F.col("key"), F.col("amount")
    owed = F.when((F.col("event_type") == "ap") & (k % 9 == 0), -F.floor(a / 4)).when((F.col("event_type") == "ar") & (k % 25 == 0), -F.floor(a / 10)).otherwise(F.col("outstanding"))
    return d.cash_events(spark, sf).select("event_id", "event_type", "entity_id", owed.cast(d.MONEY).alias("outstanding"))


@query(
    "credit_types",
    d.with_tables(
        f"WITH {_CREDITS} SELECT CASE WHEN event_type = 'ap' AND outstanding < -0.01 THEN 'vendor_credit' WHEN event_type = 'ar' AND outstanding < -0.01 THEN 'customer_overpayment' ELSE 'none' END AS credit_type, count(*) AS n, sum(abs(outstanding))::DOUBLE AS total FROM e GROUP BY 1", "cash_events"
    ),
)
def credit_types(spark: SparkSession, sf: str) -> DataFrame:
    """Events below zero by what they are: credits of vendors, overpayments of customers."""
    below = F.col("outstanding") < -0.01
    kind = F.when((F.col("event_type") == "ap") & below, "vendor_credit").when((F.col("event_type") == "ar") & below, "customer_overpayment").otherwise("none")
    return _with_credits(spark, sf).groupBy(kind.alias("credit_type")).agg(F.count("*").alias("n"), F.sum(F.abs("outstanding")).cast("double").alias("total"))


@query(
    "credit_applications",
    d.with_tables(
        f"""WITH {_CREDITS}, c AS (SELECT entity_id, event_id AS credit_id, -outstanding AS amount, sum(-outstanding) OVER (PARTITION BY entity_id ORDER BY outstanding, event_id ROWS UNBOUNDED PRECEDING) AS hi FROM e WHERE event_type = 'ap' AND outstanding < -0.01),
b AS (SELECT entity_id, event_id AS bill_id, outstanding AS amount, sum(outstanding) OVER (PARTITION BY entity_id ORDER BY outstanding, event_id ROWS UNBOUNDED PRECEDING) AS hi FROM e WHERE event_type = 'ap' AND outstanding > 0.01)
SELECT credit_id, bill_id, (least(c.hi, b.hi) - greatest(c.hi - c.amount, b.hi - b.amount))::DOUBLE AS applied FROM c JOIN b USING (entity_id) WHERE least(c.hi, b.hi) > greatest(c.hi - c.amount, b.hi - b.amount)""",
        "cash_events",
    ),
)
def credit_applications(spark: SparkSession, sf: str) -> DataFrame:
    """Vendors' credits, the largest first, against the open bills of the same vendor, the smallest first: a bill that a credit leaves in part is the smallest for the next one, so the order of bills stays and running sums say it all."""
    e = _with_credits(spark, sf).filter("event_type = 'ap'")
    order = F.struct("outstanding", "event_id").alias("order")
    c = e.filter("outstanding < -0.01").select("entity_id", F.col("event_id").alias("a"), (-F.col("outstanding")).alias("amount"), order)
    b = e.filter("outstanding > 0.01").select("entity_id", F.col("event_id").alias("b"), F.col("outstanding").alias("amount"), order)
    return overlaps(c, b, "entity_id").select(F.col("a").alias("credit_id"), F.col("b").alias("bill_id"), F.col("applied").cast("double").alias("applied"))
