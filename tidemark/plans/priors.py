"""Priors of receipts from entity to cohort to portfolio, the ladder of open invoices by them, and the back-test of payment patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import normal_cdf
from tidemark.plans.profiles import pattern_statistics
from tidemark.registry import query
from tidemark.sources import domain as d

#: The day that stands for today: some invoices are not due yet.
TODAY = "1998-08-01"

# Limits of archetypes and clusters, the multipliers and fallbacks of archetypes, and the portfolio's base chances.
CLOCKWORK, VOLATILE, SLOW, BURSTY, EPISODIC = (0.25, 0.3), 0.8, 30, (0.5, 0.8), (3, 6, 0.4)
STEADY, RELIABLE, MODERATE, RISING, FALLING, WEEKDAY = 0.5, 0.3, 0.6, 1.15, 0.85, (5, 0.4)
#: archetype: multiplier of the chance, of the interval, of an invoice's chance, and the chance and interval without a cohort.
ARCHETYPES = {
    "clockwork": (1.3, 0.8, 1.4, 0.6, 30),
    "bursty": (0.9, 1.2, 0.8, 0.4, 45),
    "episodic": (0.6, 1.5, 0.6, 0.2, 60),
    "slow_reliable": (1.1, 1.3, 0.9, 0.5, 45),
    "volatile": (0.7, 1.4, 0.5, 0.25, 50),
    "low_data": (1.0, 1.0, 0.7, 0.3, 30),
}
LEAST, MOST = 0.02, 0.95
#: The portfolio without enough receipts; receipts, paid invoices and receipts with intervals that are enough.
PORTFOLIO, ENOUGH = (0.25, 0.45, 0.65, 21), (5, 3, 10)
#: Base, factor of the frequency and cap of the chances in 7, 14 and 30 days, each on top of the one before; the frequency's divisor and cap; the delay's least, most and offset.
STEPS, FREQUENCY, DELAY = ((0.15, 0.1, 0.6), (0.15, 0.05, 0.75), (0.15, 0.05, 0.9)), (10, 2), (7, 45, 7)
#: What multiplies chances in 7, 14 and 30 days: payers that are reliable or volatile, invoices matched in full; what the matched share adds.
PAYERS = {"reliable": (1.3, 1.2, 1.1), "volatile": (0.7, 0.8, 0.9)}
MATCHED, PARTIAL, DSO = (1.5, 1.4, 1.3), 0.3, (0.5, 1.5)


def cents(x: Column) -> Column:
    """Two places, halves up."""
    return F.floor(x * 100 + 0.5) / 100


_CENTS = "floor(({}) * 100 + 0.5) / 100"


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' payments up to today."""
    return d.movements(spark, sf).filter((F.col("direction") == "inflow") & (F.col("economic_class") == "customer_receipt") & (F.col("date") <= F.lit(TODAY).cast("date")))


_RECEIPTS = f"""r AS (SELECT movement_id, entity_id, event_id, date, amount::DOUBLE AS amount FROM movements WHERE direction = 'inflow' AND economic_class = 'customer_receipt' AND date <= DATE '{TODAY}'),
o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY entity_id) AS n, date - lag(date) OVER w AS gap, dayofweek(date) AS weekday FROM r WINDOW w AS (PARTITION BY entity_id ORDER BY date, movement_id)),
wd AS (SELECT entity_id, weekday, count(*) AS c FROM o GROUP BY 1, 2),
wb AS (SELECT entity_id, arg_max(weekday, (c, -weekday)) AS weekday, max(c) AS c FROM wd GROUP BY 1),
a AS (SELECT entity_id, count(*) AS n, avg(amount) AS mean, coalesce(stddev_samp(amount), 0) AS sd, coalesce(avg(gap), 0) AS gap, coalesce(stddev_samp(gap), 0) AS gap_sd, avg(amount) FILTER (WHERE k <= n // 2) AS early, avg(amount) FILTER (WHERE k > n // 2) AS late,
  max(date) AS last, min(date) AS first FROM o GROUP BY 1),
f AS (SELECT a.entity_id, a.n, mean, sd, gap, gap_sd, CASE WHEN gap > 0 THEN gap_sd / gap ELSE 999.0 END AS cv, CASE WHEN mean > 0 THEN sd / mean ELSE 0.0 END AS amount_cv,
  CASE WHEN a.n < 4 OR early <= 0 THEN 'insufficient' WHEN late / early > {RISING} THEN 'accelerating' WHEN late / early < {FALLING} THEN 'decelerating' ELSE 'stable' END AS trend,
  (DATE '{TODAY}' - last)::INTEGER AS recency, CASE WHEN a.n >= {WEEKDAY[0]} AND c::DOUBLE / a.n > {WEEKDAY[1]} THEN weekday::INTEGER END AS weekday_bias, CASE WHEN a.n < 2 OR last = first THEN 0.0 ELSE a.n / ((last - first) / 30.0) END AS cadence
  FROM a JOIN wb USING (entity_id)),
ft AS (SELECT *, CASE WHEN cv < {RELIABLE} THEN 'reliable' WHEN cv < {MODERATE} THEN 'moderate' ELSE 'volatile' END AS payer,
  CASE WHEN n < 3 THEN 'low_data' WHEN cv < {CLOCKWORK[0]} AND amount_cv < {CLOCKWORK[1]} THEN 'clockwork' WHEN cv > {VOLATILE} THEN 'volatile' WHEN gap > {SLOW} AND cv < {STEADY} THEN 'slow_reliable' WHEN cv > {BURSTY[0]} AND cv <= {BURSTY[1]} THEN 'bursty'
    WHEN n BETWEEN {EPISODIC[0]} AND {EPISODIC[1]} AND cv > {EPISODIC[2]} THEN 'episodic' WHEN cv < {STEADY} THEN 'clockwork' ELSE 'bursty' END AS archetype FROM f)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's payments as statistics: amounts, intervals, trend between halves, day of the week, reliability, archetype."""
    by = Window.partitionBy("entity_id")
    order = by.orderBy("date", "movement_id")
    o = receipts(spark, sf).select(
        "entity_id", "date", F.col("amount").cast("double").alias("amount"), F.row_number().over(order).alias("k"), F.count("*").over(by).alias("size"), F.datediff("date", F.lag("date").over(order)).alias("gap"), (F.dayofweek("date") - 1).alias("weekday")
    )
    half = F.floor(F.col("size") / 2)
    a = o.groupBy("entity_id").agg(
        F.count("*").alias("n"),
        F.avg("amount").alias("mean"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("sd"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap"),
        F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("gap_sd"),
        F.avg(F.when(F.col("k") <= half, F.col("amount"))).alias("early"),
        F.avg(F.when(F.col("k") > half, F.col("amount"))).alias("late"),
        F.max("date").alias("last"),
        F.min("date").alias("first"),
        *(F.count_if(F.col("weekday") == i).alias(f"w{i}") for i in range(7)),
    )
    n, cv, gap, days = F.col("n"), F.col("cv"), F.col("gap"), [F.col(f"w{i}") for i in range(7)]
    most = F.greatest(*days)
    ratio = F.try_divide("late", "early")
    a = a.withColumns({"cv": F.when(gap > 0, F.col("gap_sd") / gap).otherwise(999.0), "amount_cv": F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0)})
    span = F.datediff("last", "first")
    return a.select(
        "entity_id",
        "n",
        "mean",
        "sd",
        "gap",
        "gap_sd",
        "cv",
        "amount_cv",
        F.when((n < 4) | (F.col("early") <= 0), "insufficient").when(ratio > RISING, "accelerating").when(ratio < FALLING, "decelerating").otherwise("stable").alias("trend"),
        F.datediff(F.lit(TODAY).cast("date"), "last").alias("recency"),
        F.when((n >= WEEKDAY[0]) & (most / n > WEEKDAY[1]), F.array_position(F.array(*days), most).cast("int") - 1).alias("weekday_bias"),
        F.when((n < 2) | (span == 0), 0.0).otherwise(n / (span / 30.0)).alias("cadence"),
        F.when(cv < RELIABLE, "reliable").when(cv < MODERATE, "moderate").otherwise("volatile").alias("payer"),
        archetype(n, cv, gap, F.col("amount_cv")).alias("archetype"),
    )


def archetype(n: Column, cv: Column, gap: Column, amount_cv: Column) -> Column:
    """How a customer pays, by the variation of intervals and amounts."""
    return (
        F.when(n < 3, "low_data")
        .when((cv < CLOCKWORK[0]) & (amount_cv < CLOCKWORK[1]), "clockwork")
        .when(cv > VOLATILE, "volatile")
        .when((gap > SLOW) & (cv < STEADY), "slow_reliable")
        .when((cv > BURSTY[0]) & (cv <= BURSTY[1]), "bursty")
        .when(n.between(*EPISODIC[:2]) & (cv > EPISODIC[2]), "episodic")
        .when(cv < STEADY, "clockwork")
        .otherwise("bursty")
    )


@query(
    "customer_features",
    d.with_tables(
        f"""WITH {_RECEIPTS} SELECT entity_id, n, {_CENTS.format("mean")} AS amount_mean, {_CENTS.format("sd")} AS amount_std, round(gap, 6) AS avg_interval, round(gap_sd, 6) AS std_interval, {_CENTS.format("cv")} AS interval_cv, trend, recency, weekday_bias,
  {_CENTS.format("cadence")} AS monthly_cadence, payer, archetype FROM ft""",
        "movements",
    ),
)
def customer_features(spark: SparkSession, sf: str) -> DataFrame:
    f = features(spark, sf)
    return f.select(
        "entity_id", "n", cents(F.col("mean")).alias("amount_mean"), cents(F.col("sd")).alias("amount_std"), F.round("gap", 6).alias("avg_interval"), F.round("gap_sd", 6).alias("std_interval"), cents(F.col("cv")).alias("interval_cv"), "trend", "recency", "weekday_bias",
        cents(F.col("cadence")).alias("monthly_cadence"), "payer", "archetype",
    )


def cohort(f: DataFrame) -> DataFrame:
    """One row: the chance of a payment within 7, 14 and 30 days and the interval, over customers of three payments or more, each by the logarithm of its payments; sums alone, so one pass."""
    some = f.filter("n >= 3")
    weight, gap = F.log(F.col("n") + F.lit(1.0)), F.when(F.col("gap") > 0, F.col("gap")).otherwise(30.0)
    dev = F.when(F.col("gap_sd") > 0, F.col("gap_sd")).otherwise(gap * 0.3)
    mean = lambda x: cents(F.sum(x * weight) / F.sum(weight))
    default = (0.3, 0.5, 0.7)
    chances = [F.coalesce(mean(normal_cdf((days - gap) / dev)), F.lit(p)).alias(f"p{days}") for days, p in zip((7, 14, 30), default, strict=True)]
    return some.agg(*chances, F.coalesce(mean(gap), F.lit(30.0)).alias("interval"), F.count("*").alias("customers"))


def _phi(z: str) -> str:
    """The normal distribution in SQL, as rules.normal_cdf has it."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    u = f"(exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN ({z}) >= 0 THEN 1 - {u} ELSE {u} END"


_COHORT = f"""cw AS (SELECT ln(n + 1) AS w, CASE WHEN gap > 0 THEN gap ELSE 30 END AS gap, CASE WHEN gap_sd > 0 THEN gap_sd ELSE CASE WHEN gap > 0 THEN gap ELSE 30 END * 0.3 END AS dev FROM ft WHERE n >= 3),
co AS (SELECT {", ".join(f"coalesce({_CENTS.format(f'sum(w * {_phi(f"({days} - gap) / dev")}) / sum(w)')}, {p})::DOUBLE AS p{days}" for days, p in ((7, 0.3), (14, 0.5), (30, 0.7)))}, coalesce({_CENTS.format("sum(w * gap) / sum(w)")}, 30)::DOUBLE AS interval, count(*) AS customers FROM cw)"""


@query("cohort_statistics", d.with_tables(f"WITH {_RECEIPTS}, {_COHORT} SELECT * FROM co", "movements"))
def cohort_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return cohort(features(spark, sf))


_ARCHETYPES = "(VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in ARCHETYPES.items()) + ") AS t(archetype, chance, stretch, invoice, chance_alone, interval_alone)"


def archetypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in ARCHETYPES.items()], "archetype string, chance double, stretch double, invoice double, chance_alone double, interval_alone double")


@query(
    "entity_priors",
    d.with_tables(
        f"""WITH {_RECEIPTS}, {_COHORT} SELECT entity_id, archetype, round(CASE WHEN customers > 0 THEN least({MOST}, p30 * chance) ELSE chance_alone END, 6)::DOUBLE AS prior_probability, round(CASE WHEN customers > 0 THEN interval * stretch ELSE interval_alone END, 6)::DOUBLE AS prior_interval,
  round((n * gap + 3 * CASE WHEN customers > 0 THEN interval * stretch ELSE interval_alone END) / (n + 3), 6)::DOUBLE AS blended_interval FROM ft JOIN {_ARCHETYPES} USING (archetype), co""",
        "movements",
    ),
)
def entity_priors(spark: SparkSession, sf: str) -> DataFrame:
    """The cohort's chance and interval bent by each customer's archetype, and its own interval drawn towards that as if it were three payments; the cohort is one row."""
    f = features(spark, sf)
    own = f.join(F.broadcast(archetypes(spark)), "archetype").crossJoin(F.broadcast(cohort(f)))
    there = F.col("customers") > 0
    interval = F.when(there, F.col("interval") * F.col("stretch")).otherwise(F.col("interval_alone"))
    return own.select(
        "entity_id", "archetype", F.round(F.when(there, F.least(F.lit(MOST), F.col("p30") * F.col("chance"))).otherwise(F.col("chance_alone")), 6).alias("prior_probability"), F.round(interval, 6).alias("prior_interval"),
        F.round((F.col("n") * F.col("gap") + 3 * interval) / (F.col("n") + 3), 6).alias("blended_interval"),
    )


_LATE = f"""lt AS (SELECT count(*) AS n, avg(late) AS late FROM (SELECT event_id, greatest(0, min(date) - any_value(expected_date)) AS late FROM r JOIN cash_events e USING (event_id) WHERE e.status = 'paid' GROUP BY 1)),
pf0 AS (SELECT count(*) AS n, least({FREQUENCY[1]}, count(*)::DOUBLE / greatest(1, count(DISTINCT date_trunc('month', date))) / {FREQUENCY[0]}) AS q, (max(date) - min(date))::DOUBLE / nullif(count(*) - 1, 0) AS gap FROM r),
pf1 AS (SELECT pf0.*, lt.n AS paid, lt.late, least({STEPS[0][2]}, {STEPS[0][0]} + {STEPS[0][1]} * q) AS b7 FROM pf0, lt),
pf2 AS (SELECT *, least({STEPS[1][2]}, b7 + {STEPS[1][0]} + {STEPS[1][1]} * q) AS b14 FROM pf1),
pf3 AS (SELECT *, least({STEPS[2][2]}, b14 + {STEPS[2][0]} + {STEPS[2][1]} * q) AS b30 FROM pf2),
pf AS (SELECT CASE WHEN n < {ENOUGH[0]} THEN {PORTFOLIO[0]} ELSE b7 END::DOUBLE AS base_p7, CASE WHEN n < {ENOUGH[0]} THEN {PORTFOLIO[1]} ELSE b14 END::DOUBLE AS base_p14, CASE WHEN n < {ENOUGH[0]} THEN {PORTFOLIO[2]} ELSE b30 END::DOUBLE AS base_p30,
  CASE WHEN n < {ENOUGH[0]} THEN {PORTFOLIO[3]} WHEN paid >= {ENOUGH[1]} THEN greatest({DELAY[0]}, least({DELAY[1]}, late + {DELAY[2]})) WHEN n >= {ENOUGH[2]} THEN greatest({DELAY[0]}, least({DELAY[1]}, gap)) ELSE {PORTFOLIO[3]} END::DOUBLE AS delay FROM pf3)"""


def portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """One row: base chances by how often customers pay, and the delay by how late they do. The mean interval of all receipts is their span over their number, so nothing is sorted."""
    r = receipts(spark, sf)
    due = d.cash_events(spark, sf).filter("event_type = 'ar' and status = 'paid'").select("event_id", "expected_date")
    late = r.join(due, "event_id").groupBy("event_id").agg(F.greatest(F.lit(0), F.datediff(F.min("date"), F.min("expected_date"))).alias("late")).agg(F.count("*").alias("paid"), F.avg("late").alias("late"))
    months = F.size(F.collect_set(F.trunc("date", "month")))
    totals = r.agg(F.count("*").alias("n"), months.alias("months"), (F.datediff(F.max("date"), F.min("date")) / F.nullif(F.count("*") - 1, F.lit(0))).alias("span"))
    n = F.col("n")
    q = F.least(F.lit(float(FREQUENCY[1])), n / F.greatest(F.lit(1), F.col("months")) / FREQUENCY[0])
    bases, last = [], F.lit(0.0)
    for base, factor, cap in STEPS:
        last = F.least(F.lit(cap), last + base + factor * q)
        bases.append(last)
    within = lambda x: F.greatest(F.lit(float(DELAY[0])), F.least(F.lit(float(DELAY[1])), x))
    few = n < ENOUGH[0]
    delay = F.when(few, float(PORTFOLIO[3])).when(F.col("paid") >= ENOUGH[1], within(F.col("late") + DELAY[2])).when(n >= ENOUGH[2], within(F.col("span"))).otherwise(float(PORTFOLIO[3]))
    return totals.crossJoin(late).select(*(F.when(few, p).otherwise(b).alias(f"base_p{x}") for x, p, b in zip((7, 14, 30), PORTFOLIO, bases, strict=False)), delay.alias("delay"))


@query(
    "portfolio_priors",
    d.with_tables(f"WITH {_RECEIPTS}, {_LATE} SELECT round(base_p7, 6) AS base_p7, round(base_p14, 6) AS base_p14, round(base_p30, 6) AS base_p30, round(delay, 6) AS delay FROM pf", "movements", "cash_events"),
)
def portfolio_priors(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio(spark, sf).select(*(F.round(c, 6).alias(c) for c in ("base_p7", "base_p14", "base_p30", "delay")))


_PAYER = lambda i: "CASE payer " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in PAYERS.items()) + " ELSE 1.0 END"


@query(
    "invoice_ladder",
    d.with_tables(
        f"""WITH {_RECEIPTS}, {_LATE},
i AS (SELECT event_id, entity_id, amount::DOUBLE AS amount, outstanding::DOUBLE AS due, expected_date, greatest(0, DATE '{TODAY}' - expected_date) AS overdue, greatest(0, expected_date - DATE '{TODAY}') AS until FROM cash_events
  WHERE event_type = 'ar' AND status <> 'paid' AND issued <= DATE '{TODAY}'),
j AS (SELECT i.*, coalesce(ft.n, 0) AS n, coalesce(gap, 0) AS dso, coalesce(payer, 'none') AS payer, t.invoice AS m, pf.* FROM i LEFT JOIN ft USING (entity_id) JOIN {_ARCHETYPES} ON t.archetype = coalesce(ft.archetype, 'low_data'), pf),
k AS (SELECT *, greatest(0, 1 - until / 30.0) AS time_score, CASE WHEN dso > 0 AND n >= 2 THEN greatest({DSO[0]}, least({DSO[1]}, delay / dso)) ELSE 1.0 END AS fd, CASE WHEN due < amount THEN 1 + (amount - due) / amount * {PARTIAL} ELSE 1.0 END AS fm FROM j),
p AS (SELECT *, base_p7 * m * CASE WHEN overdue > 0 THEN {MATCHED[0]} ELSE time_score END * fd * {_PAYER(0)} * fm AS x7, base_p14 * m * CASE WHEN overdue > 0 THEN {MATCHED[1]} ELSE greatest(time_score, 0.5) END * fd * {_PAYER(1)} * fm AS x14, base_p30 * m * sqrt(fd) * {_PAYER(2)} * fm AS x30 FROM k),
c7 AS (SELECT *, least({MOST}, greatest({LEAST}, x7)) AS p7 FROM p), c14 AS (SELECT *, least({MOST}, greatest(p7, x14)) AS p14 FROM c7), c30 AS (SELECT *, least({MOST}, greatest(p14, x30)) AS p30 FROM c14)
SELECT event_id, entity_id, due AS amount_due, expected_date AS due_date, overdue::INTEGER AS days_overdue, round(p7, 6)::DOUBLE AS p7, round(p14, 6)::DOUBLE AS p14, round(p30, 6)::DOUBLE AS p30,
  CASE WHEN overdue > 0 THEN DATE '{TODAY}' + greatest(1, floor(CASE WHEN dso > 0 THEN greatest(1, dso - overdue) ELSE delay END + 0.5))::INTEGER WHEN dso > 0 THEN expected_date + floor(dso + 0.5)::INTEGER ELSE expected_date END AS expected_collection FROM c30""",
        "movements",
        "cash_events",
    ),
)
def invoice_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The chance that each open invoice is paid in 7, 14 and 30 days, and when: the portfolio's base by archetype, time to due, delay, reliability and what is matched. Priors are one row, invoices meet their customer's row once."""
    today = F.lit(TODAY).cast("date")
    i = d.cash_events(spark, sf).filter((F.col("event_type") == "ar") & (F.col("status") != "paid") & (F.col("issued") <= today))
    i = i.select(
        "event_id", "entity_id", F.col("amount").cast("double").alias("amount"), F.col("outstanding").cast("double").alias("due"), "expected_date",
        F.greatest(F.lit(0), F.datediff(today, "expected_date")).alias("overdue"), F.greatest(F.lit(0), F.datediff("expected_date", today)).alias("until"),
    )
    f = features(spark, sf).select("entity_id", "n", F.col("gap").alias("dso"), "payer", "archetype")
    j = i.join(f, "entity_id", "left").withColumn("archetype", F.coalesce("archetype", F.lit("low_data"))).join(F.broadcast(archetypes(spark)), "archetype").crossJoin(F.broadcast(portfolio(spark, sf)))
    dso, late = F.coalesce("dso", F.lit(0.0)), F.col("overdue") > 0
    time = F.greatest(F.lit(0.0), 1 - F.col("until") / 30.0)
    slow = F.when((dso > 0) & (F.col("n") >= 2), F.greatest(F.lit(DSO[0]), F.least(F.lit(DSO[1]), F.try_divide(F.col("delay"), dso)))).otherwise(1.0)
    matched = F.when(F.col("due") < F.col("amount"), 1 + (F.col("amount") - F.col("due")) / F.col("amount") * PARTIAL).otherwise(1.0)
    chance, last = {}, F.lit(LEAST)
    for at, (days, when_due, effect) in enumerate(((7, time, slow), (14, F.greatest(time, F.lit(0.5)), slow), (30, None, F.sqrt(slow)))):
        payer = F.coalesce(*(F.when(F.col("payer") == k, v[at]) for k, v in PAYERS.items()), F.lit(1.0))
        due = F.lit(1.0) if when_due is None else F.when(late, MATCHED[at]).otherwise(when_due)
        last = F.least(F.lit(MOST), F.greatest(last, F.col(f"base_p{days}") * F.col("invoice") * due * effect * payer * matched))
        chance[days] = last
    wait = F.greatest(F.lit(1), F.floor(F.when(dso > 0, F.greatest(F.lit(1.0), dso - F.col("overdue"))).otherwise(F.col("delay")) + 0.5)).cast("int")
    collected = F.when(late, F.date_add(today, wait)).when(dso > 0, F.date_add("expected_date", F.floor(dso + 0.5).cast("int"))).otherwise(F.col("expected_date"))
    return j.select("event_id", "entity_id", F.col("due").alias("amount_due"), F.col("expected_date").alias("due_date"), F.col("overdue").alias("days_overdue"), *(F.round(p, 6).alias(f"p{x}") for x, p in chance.items()), collected.alias("expected_collection"))


# Fixed values of the back-test, by number of movements (below 15, below 30, more): the share for training, the least confidence and payments, days and share of the amount that a prediction may miss.
BACKTEST = ((15, 0.4, 0.2, 1, 10, 0.5), (30, 0.5, 0.3, 2, 8, 0.4), (None, 0.6, 0.5, 3, 5, 0.2))


def train_and_test(m: DataFrame, share: float, total: int) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of the movements by date and id, and the rest. Counts a day place the cut; only the rows of the day it falls into are ranked."""
    days = m.groupBy("date").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    first = int(total * share)
    cut = days.filter((F.col("before") <= first) & (F.col("before") + F.col("n") > first)).select(F.col("date").alias("cut"), (first - F.col("before")).alias("left"))
    placed = m.crossJoin(F.broadcast(cut))
    on_day = placed.filter("date = cut").withColumn("k", F.row_number().over(Window.orderBy("movement_id"))).filter(F.col("k") <= F.col("left")).drop("k")
    rest = on_day.select("movement_id")
    train = placed.filter("date < cut").unionByName(on_day)
    test = placed.filter("date > cut").unionByName(placed.filter("date = cut").join(rest, "movement_id", "left_anti"))
    return train.drop("cut", "left"), test.drop("cut", "left")


def backtest(m: DataFrame) -> DataFrame:
    """entity_id, direction, recurrence, strength, tested and accurate of each pattern that the first movements prove, held against the later ones: every payment but the first is foretold from the one before it by the pattern's interval and amount."""
    total = m.count()
    _, share, least, n, days, part = next(x for x in BACKTEST if x[0] is None or total < x[0])
    train, test = train_and_test(m.select("movement_id", "entity_id", "direction", "date", "amount"), share, total)
    p = pattern_statistics(train).filter((F.col("conf") >= least) & (F.col("n") >= n))
    w = Window.partitionBy("entity_id", "direction").orderBy("date", "movement_id")
    pairs = test.withColumn("wait", F.datediff("date", F.lag("date").over(w))).select("entity_id", "direction", "wait", F.col("amount").cast("double").alias("amount"))
    hit = (F.abs(F.floor(F.col("gap") + 0.5) - F.col("wait")) <= days) & (F.abs(F.col("mean") - F.col("amount")) <= F.col("amount") * part)
    found = p.join(pairs, ["entity_id", "direction"], "left")
    keys = ["entity_id", "direction", "recurrence", "strength"]
    return found.groupBy(*keys).agg(F.count("wait").alias("tested"), F.count_if(hit).alias("accurate"))


_BACK = f"""bo AS (SELECT *, row_number() OVER (ORDER BY date, movement_id) AS k, count(*) OVER () AS total FROM movements),
bt AS (SELECT entity_id, direction, date, movement_id, amount::DOUBLE AS amount, date - lag(date) OVER (PARTITION BY entity_id, direction ORDER BY date, movement_id) AS gap FROM bo WHERE k <= floor(total * {BACKTEST[-1][1]})),
ba AS (SELECT entity_id, direction, count(*) AS n, avg(amount) AS mean, stddev_pop(amount) AS sd, coalesce(avg(gap), 0) AS gap, coalesce(stddev_pop(gap), 0) AS gap_sd FROM bt GROUP BY 1, 2),
bp AS (SELECT *, CASE WHEN n < 3 THEN 0.0 ELSE 0.7 * greatest(0, 1 - CASE WHEN gap > 0 THEN gap_sd / gap ELSE 1 END) + 0.3 * greatest(0, 1 - CASE WHEN mean > 0 THEN sd / mean ELSE 1 END) END AS conf FROM ba),
bk AS (SELECT *, CASE WHEN conf > 0.8 AND gap_sd < 0.2 * gap THEN 'clockwork' WHEN conf > 0.5 THEN 'recurring' WHEN n <= 3 THEN 'episodic' ELSE 'bursty' END AS recurrence, round(conf * least(n, 20) / 20, 4)::DOUBLE AS strength FROM bp WHERE conf >= {BACKTEST[-1][2]} AND n >= {BACKTEST[-1][3]}),
bw AS (SELECT entity_id, direction, amount::DOUBLE AS amount, date - lag(date) OVER (PARTITION BY entity_id, direction ORDER BY date, movement_id) AS wait FROM bo WHERE k > floor(total * {BACKTEST[-1][1]})),
br AS (SELECT entity_id, direction, recurrence, strength, count(wait) AS tested, count(*) FILTER (WHERE abs(floor(gap + 0.5) - wait) <= {BACKTEST[-1][4]} AND abs(mean - amount) <= amount * {BACKTEST[-1][5]}) AS accurate
  FROM bk LEFT JOIN bw USING (entity_id, direction) GROUP BY ALL)"""


@query("movement_backtest", d.with_tables(f"WITH {_BACK} SELECT * FROM br", "movements"))
def movement_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return backtest(d.movements(spark, sf))


@query(
    "movement_backtest_summary",
    d.with_tables(
        f"""WITH {_BACK} SELECT count(*) AS patterns, coalesce(sum(accurate), 0)::BIGINT AS accurate, round(coalesce(CASE WHEN count(*) <= 3 AND sum(accurate) > 0 THEN least(0.6, sum(accurate) / count(*) + 0.2) ELSE sum(accurate) / count(*) END, 0), 6)::DOUBLE AS accuracy_rate,
  {", ".join(f"round(coalesce(sum(accurate) FILTER (WHERE {c} = '{v}') / nullif(count(*) FILTER (WHERE {c} = '{v}'), 0), 0), 6)::DOUBLE AS {v}" for c, v in (("direction", "inflow"), ("direction", "outflow"), ("recurrence", "clockwork"), ("recurrence", "recurring"), ("recurrence", "episodic")))},
  count(*) FILTER (WHERE tested > 0 AND strength >= 0.7) AS high, count(*) FILTER (WHERE tested > 0 AND strength >= 0.4 AND strength < 0.7) AS medium, count(*) FILTER (WHERE tested > 0 AND strength < 0.4) AS low FROM br""",
        "movements",
    ),
)
def movement_backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row: how often patterns were right, by direction and kind (hits a pattern, as the measure is defined), and how many of what strength met a later payment."""
    b = backtest(d.movements(spark, sf))
    n, hits = F.count("*"), F.coalesce(F.sum("accurate"), F.lit(0))
    of = lambda c, v: F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col(c) == v, F.col("accurate"))), F.count_if(F.col(c) == v)), F.lit(0.0)), 6).alias(v)
    rate = F.coalesce(F.try_divide(hits, n), F.lit(0.0))
    met = F.col("tested") > 0
    strong = F.col("strength")
    return b.agg(
        n.alias("patterns"),
        hits.cast("long").alias("accurate"),
        F.round(F.when((n <= 3) & (hits > 0), F.least(F.lit(0.6), rate + 0.2)).otherwise(rate), 6).alias("accuracy_rate"),
        *(of("direction", v) for v in ("inflow", "outflow")),
        *(of("recurrence", v) for v in ("clockwork", "recurring", "episodic")),
        F.count_if(met & (strong >= 0.7)).alias("high"),
        F.count_if(met & (strong >= 0.4) & (strong < 0.7)).alias("medium"),
        F.count_if(met & (strong < 0.4)).alias("low"),
    )
