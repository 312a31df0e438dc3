"""Entity metrics from windows and aggregates: payments, trends, seasonality, profiles, timing, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import at_least
from tidemark.registry import query
from tidemark.sources import domain as d

_TX = """tx AS (SELECT m.entity_id, m.direction, m.date, m.amount::DOUBLE AS amount, m.movement_id, (m.date - e.issued)::INTEGER AS days_to_pay, m.date <= e.expected_date AS on_time
  FROM movements m JOIN cash_events e ON e.event_id = m.event_id)"""


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Movements with the days to pay of the event they settle."""
    e = d.cash_events(spark, sf).select("event_id", "issued", "expected_date")
    m = d.movements(spark, sf).join(e, "event_id")
    return m.select("entity_id", "direction", "date", F.col("amount").cast("double").alias("amount"), "movement_id", F.datediff("date", "issued").alias("days_to_pay"), (F.col("date") <= F.col("expected_date")).alias("on_time"))


@query(
    "entity_transactions",
    d.with_tables(f"WITH {_TX} SELECT entity_id, direction, date, amount, movement_id, days_to_pay, on_time FROM tx", "movements", "cash_events"),
)
def entity_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return transactions(spark, sf)


@query(
    "payment_metrics",
    d.with_tables(
        f"""WITH {_TX} SELECT entity_id, count(*) AS n, round(avg(amount), 6) AS avg_amount, round(coalesce(stddev_samp(amount), 0), 3) AS amount_sd, round(avg(days_to_pay), 4) AS avg_days_to_pay,
  round(avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END), 6) AS on_time_rate, round(avg(CASE WHEN days_to_pay < 15 THEN 1.0 ELSE 0.0 END), 6) AS early_rate FROM tx GROUP BY 1""",
        "movements",
        "cash_events",
    ),
)
def payment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, means, deviation and punctuality of each entity."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return transactions(spark, sf).groupBy("entity_id").agg(
        F.count("*").alias("n"), F.round(F.avg("amount"), 6).alias("avg_amount"), F.round(F.coalesce(F.stddev_samp("amount"), F.lit(0.0)), 3).alias("amount_sd"), F.round(F.avg("days_to_pay"), 4).alias("avg_days_to_pay"),
        share(F.col("on_time")).alias("on_time_rate"), share(F.col("days_to_pay") < 15).alias("early_rate"),
    )


_GAPS = """g AS (SELECT entity_id, date, amount::DOUBLE AS amount, movement_id, date - lag(date) OVER w AS gap, row_number() OVER w AS rn, count(*) OVER (PARTITION BY entity_id) AS n
  FROM movements WINDOW w AS (PARTITION BY entity_id ORDER BY date, movement_id))"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Movements with the days since the entity's last one, their rank and their number."""
    w = Window.partitionBy("entity_id").orderBy("date", "movement_id")
    m = d.movements(spark, sf).select("entity_id", "date", F.col("amount").cast("double").alias("amount"), "movement_id")
    return m.withColumns({"gap": F.datediff("date", F.lag("date").over(w)), "rn": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("entity_id"))})


@query(
    "interval_trends",
    d.with_tables(
        f"""WITH {_GAPS} SELECT entity_id, count(*) AS n, round(avg(gap), 4) AS avg_interval, round(coalesce(stddev_samp(gap), 0), 4) AS interval_sd, round(100 * coalesce(stddev_samp(gap), 0) / nullif(avg(gap), 0), 3) AS interval_cv_pct,
  round(avg(amount) FILTER (WHERE rn > n - 3), 6) AS recent_avg, round(avg(amount) FILTER (WHERE rn <= n - 3), 6) AS history_avg,
  CASE WHEN avg(amount) FILTER (WHERE rn <= n - 3) IS NULL THEN 'stable' WHEN avg(amount) FILTER (WHERE rn > n - 3) > 1.1 * avg(amount) FILTER (WHERE rn <= n - 3) THEN 'increasing'
    WHEN avg(amount) FILTER (WHERE rn > n - 3) < 0.9 * avg(amount) FILTER (WHERE rn <= n - 3) THEN 'decreasing' ELSE 'stable' END AS trend FROM g GROUP BY 1""",
        "movements",
    ),
)
def interval_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals by lag, and recent against earlier amounts."""
    recent, old = F.avg(F.when(F.col("rn") > F.col("n") - 3, F.col("amount"))), F.avg(F.when(F.col("rn") <= F.col("n") - 3, F.col("amount")))
    sd = F.coalesce(F.stddev_samp("gap"), F.lit(0.0))
    return gaps(spark, sf).groupBy("entity_id").agg(
        F.count("*").alias("n"), F.round(F.avg("gap"), 4).alias("avg_interval"), F.round(sd, 4).alias("interval_sd"), F.round(100 * sd / F.nullif(F.avg("gap"), F.lit(0.0)), 3).alias("interval_cv_pct"),
        F.round(recent, 6).alias("recent_avg"), F.round(old, 6).alias("history_avg"),
        F.when(old.isNull(), "stable").when(recent > 1.1 * old, "increasing").when(recent < 0.9 * old, "decreasing").otherwise("stable").alias("trend"),
    )


@query(
    "amount_trend_halves",
    d.with_tables(
        f"""WITH {_GAPS} SELECT entity_id, CASE WHEN max(n) < 4 THEN 'unknown' WHEN avg(amount) FILTER (WHERE 2 * rn > n) > 1.15 * avg(amount) FILTER (WHERE 2 * rn <= n) THEN 'increasing'
  WHEN avg(amount) FILTER (WHERE 2 * rn > n) < 0.85 * avg(amount) FILTER (WHERE 2 * rn <= n) THEN 'decreasing' ELSE 'stable' END AS trend FROM g GROUP BY 1""",
        "movements",
    ),
)
def amount_trend_halves(spark: SparkSession, sf: str) -> DataFrame:
    """Newer against older half of each entity's amounts."""
    late = 2 * F.col("rn") > F.col("n")
    new, old = F.avg(F.when(late, F.col("amount"))), F.avg(F.when(~late, F.col("amount")))
    return gaps(spark, sf).groupBy("entity_id").agg(F.when(F.max("n") < 4, "unknown").when(new > 1.15 * old, "increasing").when(new < 0.85 * old, "decreasing").otherwise("stable").alias("trend"))


@query(
    "seasonality_counts",
    d.with_tables(
        """WITH c AS (SELECT entity_id, month(date)::INTEGER AS m, count(*) AS n FROM movements GROUP BY 1, 2), t AS (SELECT entity_id, sum(n) / 12.0 AS mean FROM c GROUP BY 1)
SELECT c.entity_id, coalesce(list(m ORDER BY m) FILTER (WHERE n > 1.2 * mean), []) AS peak_months, coalesce(list(m ORDER BY m) FILTER (WHERE n < 0.8 * mean), []) AS low_months FROM c JOIN t USING (entity_id) GROUP BY 1""",
        "movements",
    ),
)
def seasonality_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Months well above or below a twelfth of the entity's count; months without rows are left out."""
    c = d.movements(spark, sf).groupBy("entity_id", F.month("date").alias("m")).agg(F.count("*").alias("n"))
    mean = F.sum("n").over(Window.partitionBy("entity_id")) / 12.0
    months = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("m"))))
    return c.withColumn("mean", mean).groupBy("entity_id").agg(months(F.col("n") > 1.2 * F.col("mean")).alias("peak_months"), months(F.col("n") < 0.8 * F.col("mean")).alias("low_months"))


@query(
    "seasonality_weights",
    d.with_tables(
        """WITH c AS (SELECT entity_id, month(date)::INTEGER AS month, count(*) AS n FROM movements GROUP BY 1, 2), t AS (SELECT entity_id, sum(n) / 12.0::DOUBLE AS mean FROM c GROUP BY 1),
g AS (SELECT entity_id, mean, unnest(generate_series(1, 12))::INTEGER AS month FROM t)
SELECT entity_id, month, round(coalesce(n, 0) / mean, 6)::DOUBLE AS weight, CASE WHEN coalesce(n, 0) / mean > 1.3 THEN 'peak' WHEN n > 0 AND n / mean < 0.7 THEN 'low' ELSE 'normal' END AS kind FROM g LEFT JOIN c USING (entity_id, month)""",
        "movements",
    ),
)
def seasonality_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve weights for each entity: the month's count over a twelfth of all; months without transactions weigh nothing and are not low."""
    months = F.count("*").alias("n")
    c = d.movements(spark, sf).groupBy("entity_id", F.month("date").alias("month")).agg(months)
    t = c.groupBy("entity_id").agg((F.sum("n") / F.lit(12.0)).alias("mean"), F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("by_month"))
    n = F.coalesce(F.col("by_month")[F.col("month")], F.lit(0))
    w = n / F.col("mean")
    kind = F.when(w > 1.3, "peak").when((n > 0) & (w < 0.7), "low").otherwise("normal")
    return t.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).select("entity_id", "month", F.round(w, 6).alias("weight"), kind.alias("kind"))


@query(
    "behavioural_profiles",
    d.with_tables(
        f"""WITH {_GAPS}, {_TX}, a AS (SELECT entity_id, count(*) AS n, coalesce(stddev_samp(gap) / nullif(avg(gap), 0), 0) AS icv, coalesce(stddev_samp(amount) / nullif(avg(amount), 0), 0) AS acv,
  round(count(*) * 30.0 / greatest(1, max(date) - min(date)), 4) AS per_month FROM g GROUP BY 1), o AS (SELECT entity_id, avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END) AS r, avg(days_to_pay) AS delay FROM tx GROUP BY 1)
SELECT entity_id, n, round(icv, 4) AS interval_cv, round(acv, 4) AS amount_cv, per_month::DOUBLE AS per_month, round(r, 4) AS on_time_rate, CASE WHEN n < 3 THEN 'low_data' WHEN icv < 0.3 AND r > 0.85 THEN 'clockwork' WHEN icv < 0.5 AND r > 0.7 AND delay > 20 THEN 'slow_reliable'
  WHEN icv > 0.7 AND icv < 1.2 AND r > 0.5 THEN 'bursty' WHEN icv > 1.0 OR r < 0.5 THEN 'volatile' ELSE 'bursty' END AS archetype
FROM a JOIN o USING (entity_id)""",
        "movements",
        "cash_events",
    ),
)
def behavioural_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Variation, frequency, punctuality and archetype of each entity."""
    cv = lambda c: F.coalesce(F.stddev_samp(c) / F.nullif(F.avg(c), F.lit(0.0)), F.lit(0.0))
    a = gaps(spark, sf).groupBy("entity_id").agg(
        F.count("*").alias("n"), cv("gap").alias("icv"), cv("amount").alias("acv"), F.round(F.count("*") * 30.0 / F.greatest(F.lit(1), F.datediff(F.max("date"), F.min("date"))), 4).alias("per_month")
    )
    o = transactions(spark, sf).groupBy("entity_id").agg(F.avg(F.when(F.col("on_time"), 1.0).otherwise(0.0)).alias("r"), F.avg("days_to_pay").alias("delay"))
    kind = archetype(F.col("n"), F.col("icv"), F.col("r"), F.col("delay"))
    return a.join(o, "entity_id").select("entity_id", "n", F.round("icv", 4).alias("interval_cv"), F.round("acv", 4).alias("amount_cv"), "per_month", F.round("r", 4).alias("on_time_rate"), kind.alias("archetype"))


def archetype(n: Column, cv: Column, on_time: Column, delay: Column) -> Column:
    """How an entity pays: by number of transactions, variation of intervals, share paid on time and mean days to pay."""
    return (
        F.when(n < 3, "low_data").when((cv < 0.3) & (on_time > 0.85), "clockwork").when((cv < 0.5) & (on_time > 0.7) & (delay > 20), "slow_reliable")
        .when((cv > 0.7) & (cv < 1.2) & (on_time > 0.5), "bursty").when((cv > 1.0) | (on_time < 0.5), "volatile").otherwise("bursty")
    )


@query(
    "settlement_timing",
    d.with_tables(
        f"""WITH {_TX}, k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC, movement_id DESC) AS rn FROM tx)
SELECT entity_id, count(*) AS n, round(avg(days_to_pay), 4) AS mean_days, quantile_cont(days_to_pay, 0.5)::DOUBLE AS median_days, round(coalesce(stddev_samp(days_to_pay), 0), 4) AS sd_days, min(days_to_pay)::INTEGER AS least, max(days_to_pay)::INTEGER AS most,
  round(avg(CASE WHEN rn <= 3 THEN days_to_pay END), 4) AS last_three FROM k GROUP BY 1 HAVING count(*) >= 2""",
        "movements",
        "cash_events",
    ),
)
def settlement_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Days to pay with the real dates: mean, median, spread and the last three."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("date"), F.desc("movement_id"))
    k = transactions(spark, sf).withColumn("rn", F.row_number().over(w))
    x = F.col("days_to_pay")
    return k.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean_days"), F.percentile(x, 0.5).alias("median_days"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 4).alias("sd_days"), F.min(x).alias("least"), F.max(x).alias("most"),
        F.round(F.avg(F.when(F.col("rn") <= 3, x)), 4).alias("last_three"),
    ).filter("n >= 2")


@query(
    "settlement_timing_constant",
    d.with_tables(
        """SELECT direction, count(*) AS matched, avg(7)::DOUBLE AS mean_days, quantile_cont(7, 0.5)::DOUBLE AS median_days, 0.0::DOUBLE AS sd_days FROM movements GROUP BY 1 HAVING count(*) >= 2""", "movements"
    ),
)
def settlement_timing_constant(spark: SparkSession, sf: str) -> DataFrame:
    """The variant in which every settlement takes the constant of seven days."""
    return d.movements(spark, sf).groupBy("direction").agg(F.count("*").alias("matched"), F.avg(F.lit(7)).alias("mean_days"), F.percentile(F.lit(7), 0.5).alias("median_days"), F.lit(0.0).alias("sd_days")).filter("matched >= 2")


@query(
    "timing_confidence",
    d.with_tables(
        f"""WITH {_TX}, k AS (SELECT entity_id, count(*) AS n, coalesce(stddev_samp(days_to_pay), 0) / nullif(avg(days_to_pay), 0) AS cv FROM tx GROUP BY 1)
SELECT round(sum(n * CASE WHEN n >= 10 AND cv < 0.3 THEN 0.9 WHEN n >= 5 AND cv < 0.5 THEN 0.7 ELSE 0.4 END)::DOUBLE / sum(n), 6) AS confidence FROM k""",
        "movements",
        "cash_events",
    ),
)
def timing_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The count-weighted mean of the entities' timing confidence."""
    k = transactions(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"), (F.coalesce(F.stddev_samp("days_to_pay"), F.lit(0.0)) / F.nullif(F.avg("days_to_pay"), F.lit(0.0))).alias("cv"))
    c = F.when((F.col("n") >= 10) & (F.col("cv") < 0.3), 0.9).when((F.col("n") >= 5) & (F.col("cv") < 0.5), 0.7).otherwise(0.4)
    return k.agg(F.round(F.sum(F.col("n") * c) / F.sum("n"), 6).alias("confidence"))


_PATTERNS = f"""g AS (SELECT entity_id, direction, date, amount::DOUBLE AS amount, date - lag(date) OVER (PARTITION BY entity_id, direction ORDER BY date, movement_id) AS gap FROM movements),
a AS (SELECT entity_id, direction, count(*) AS n, avg(amount) AS mean, stddev_pop(amount) AS sd, coalesce(avg(gap), 0) AS gap, coalesce(stddev_pop(gap), 0) AS gap_sd, min(amount) AS least, max(amount) AS most, max(date) AS last, min(date) AS first FROM g GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN n < 3 THEN 0.0 ELSE 0.7 * greatest(0, 1 - CASE WHEN gap > 0 THEN gap_sd / gap ELSE 1 END) + 0.3 * greatest(0, 1 - CASE WHEN mean > 0 THEN sd / mean ELSE 1 END) END AS conf FROM a),
k AS (SELECT entity_id, direction, n, round(mean, 6) AS mean_amount, round(sd, 3) AS amount_sd, least AS min_amount, most AS max_amount, round(gap, 4)::DOUBLE AS mean_gap, round(gap_sd, 4)::DOUBLE AS gap_sd, round(conf, 4)::DOUBLE AS confidence,
  CASE WHEN conf > 0.8 AND gap_sd < 0.2 * gap THEN 'clockwork' WHEN conf > 0.5 THEN 'recurring' WHEN n <= 3 THEN 'episodic' ELSE 'bursty' END AS recurrence, round(conf * least(n, 20) / 20, 4)::DOUBLE AS strength,
  (DATE '{d.AS_OF}' - last)::INTEGER AS last_days_ago, DATE '{d.AS_OF}' - last <= 90 AS is_active, (DATE '{d.AS_OF}' - first)::INTEGER AS days_of_history, conf FROM p)"""


def pattern_statistics(movements: DataFrame) -> DataFrame:
    """Amount and interval statistics (population deviations) of each entity and direction, the confidence that payments recur, how, and how strongly."""
    w = Window.partitionBy("entity_id", "direction").orderBy("date", "movement_id")
    g = movements.select("entity_id", "direction", "date", F.col("amount").cast("double").alias("amount"), F.datediff("date", F.lag("date").over(w)).alias("gap"))
    a = g.groupBy("entity_id", "direction").agg(
        F.count("*").alias("n"), F.avg("amount").alias("mean"), F.stddev_pop("amount").alias("sd"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_sd"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"), F.max("date").alias("last"), F.min("date").alias("first"),
    )
    n, gap, gap_sd, conf = F.col("n"), F.col("gap"), F.col("gap_sd"), F.col("conf")
    kind = F.when((conf > 0.8) & (gap_sd < 0.2 * gap), "clockwork").when(conf > 0.5, "recurring").when(n <= 3, "episodic").otherwise("bursty")
    a = a.withColumn("conf", recurrence_confidence(n, gap, gap_sd, F.col("mean"), F.col("sd")))
    return a.withColumns({"recurrence": kind, "strength": F.round(conf * F.least(n, F.lit(20)) / 20, 4)})


def patterns(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of all movements, as of today."""
    today = F.lit(d.AS_OF).cast("date")
    return pattern_statistics(d.movements(spark, sf)).select(
        "entity_id", "direction", "n", F.round("mean", 6).alias("mean_amount"), F.round("sd", 3).alias("amount_sd"), "min_amount", "max_amount", F.round("gap", 4).alias("mean_gap"), F.round("gap_sd", 4).alias("gap_sd"), F.round("conf", 4).alias("confidence"),
        "recurrence", "strength", F.datediff(today, "last").alias("last_days_ago"), (F.datediff(today, "last") <= 90).alias("is_active"), F.datediff(today, "first").alias("days_of_history"), "conf",
    )


def recurrence_confidence(n: Column, gap: Column, gap_sd: Column, mean: Column, sd: Column) -> Column:
    """0.7 of the steadiness of intervals and 0.3 of that of amounts; nothing below two intervals."""
    steady = lambda dev, of: F.greatest(F.lit(0.0), 1 - F.when(of > 0, F.try_divide(dev, of)).otherwise(1.0))
    return F.when(n < 3, 0.0).otherwise(0.7 * steady(gap_sd, gap) + 0.3 * steady(sd, mean))


@query("payment_patterns", d.with_tables(f"WITH {_PATTERNS} SELECT * EXCLUDE (conf) FROM k", "movements"))
def payment_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return patterns(spark, sf).drop("conf")


@query("confident_patterns", d.with_tables(f"WITH {_PATTERNS} SELECT entity_id, direction, n, confidence FROM k WHERE conf >= 0.6 AND n >= 5", "movements"))
def confident_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns fit for forecasts: confidence of 0.6 and five payments or more."""
    return patterns(spark, sf).filter("conf >= 0.6 and n >= 5").select("entity_id", "direction", "n", "confidence")


_SIGNALS = f"""{_GAPS}, {_TX}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC, movement_id DESC) AS k, count(*) OVER (PARTITION BY entity_id) AS n FROM tx),
b AS (SELECT entity_id, max(n) AS n, avg(days_to_pay) AS delay, avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END)::DOUBLE AS on_time, avg(days_to_pay) FILTER (WHERE k <= 3) AS new_delay, avg(days_to_pay) FILTER (WHERE k > n - 3) AS old_delay,
  count(*) FILTER (WHERE date > DATE '{d.AS_OF}' - INTERVAL 3 MONTH) AS recent, avg(amount) FILTER (WHERE 2 * k <= n) AS new_amount, avg(amount) FILTER (WHERE 2 * k > n) AS old_amount, count(*) * 30.0 / greatest(1, max(date) - min(date)) AS per_month FROM r GROUP BY 1),
i AS (SELECT entity_id, coalesce(stddev_samp(gap) / nullif(avg(gap), 0), 0) AS icv, coalesce(avg(gap), 0) AS gap FROM g GROUP BY 1),
f AS (SELECT b.*, icv, gap, n >= 6 AND new_delay > old_delay + 2 AS f1, n >= 4 AND new_amount < 0.85 * old_amount AS f2, on_time < 0.7 AS f3, icv > 1.0 AS f4, n >= 6 AND recent < 0.5 * (3 * per_month) AS f5 FROM b JOIN i USING (entity_id))"""


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity's punctuality, variation and frequency, with five warning signs (f1 to f5)."""
    w = Window.partitionBy("entity_id")
    r = transactions(spark, sf).withColumns({"k": F.row_number().over(w.orderBy(F.desc("date"), F.desc("movement_id"))), "n": F.count("*").over(w)})
    k, n = F.col("k"), F.col("n")
    some = lambda c, x: F.avg(F.when(c, F.col(x)))
    b = r.groupBy("entity_id").agg(
        F.max("n").alias("n"), F.avg("days_to_pay").alias("delay"), F.avg(F.when(F.col("on_time"), 1.0).otherwise(0.0)).alias("on_time"), some(k <= 3, "days_to_pay").alias("new_delay"), some(k > n - 3, "days_to_pay").alias("old_delay"),
        F.count_if(F.col("date") > F.add_months(F.lit(d.AS_OF).cast("date"), -3)).alias("recent"), some(2 * k <= n, "amount").alias("new_amount"), some(2 * k > n, "amount").alias("old_amount"),
        (F.count("*") * F.lit(30.0) / F.greatest(F.lit(1), F.datediff(F.max("date"), F.min("date")))).alias("per_month"),
    )
    i = gaps(spark, sf).groupBy("entity_id").agg(F.coalesce(F.try_divide(F.stddev_samp("gap"), F.avg("gap")), F.lit(0.0)).alias("icv"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap"))
    c = F.col
    return b.join(i, "entity_id").withColumns({
        "f1": (n >= 6) & (c("new_delay") > c("old_delay") + 2), "f2": F.coalesce((n >= 4) & (c("new_amount") < 0.85 * c("old_amount")), F.lit(False)), "f3": c("on_time") < 0.7, "f4": c("icv") > 1.0, "f5": (n >= 6) & (c("recent") < 0.5 * (3 * c("per_month"))),
    })


#: Each warning sign with its weight.
SIGNS = [("payment_slowing", 0.15), ("amount_declining", 0.1), ("low_on_time_rate", 0.15), ("high_timing_variance", 0.1), ("frequency_dropping", 0.15)]


@query(
    "risk_signals",
    d.with_tables(
        f"""WITH {_SIGNALS}, s AS (SELECT *, list_filter([{", ".join(f"CASE WHEN f{k} THEN '{name}' END" for k, (name, _) in enumerate(SIGNS, 1))}], lambda x: x IS NOT NULL) AS factors, 0.2{"".join(f" + CASE WHEN f{k} THEN {x} ELSE 0 END" for k, (_, x) in enumerate(SIGNS, 1))} AS score FROM f)
SELECT entity_id, round(least(1, score), 4)::DOUBLE AS risk_score, factors AS risk_factors, CASE WHEN len(factors) = 0 AND on_time > 0.9 THEN 'improving' WHEN len(factors) >= 2 THEN 'deteriorating' ELSE 'stable' END AS recent_trend FROM s""",
        "movements",
        "cash_events",
    ),
)
def risk_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Warning signs of each entity, their score above a base of 0.2, and the trend they show."""
    factors = F.array_compact(F.array(*[F.when(F.col(f"f{k}"), name) for k, (name, _) in enumerate(SIGNS, 1)]))
    score = sum((F.when(F.col(f"f{k}"), x).otherwise(0.0) for k, (_, x) in enumerate(SIGNS, 1)), F.lit(0.2))
    trend = F.when((F.size("risk_factors") == 0) & (F.col("on_time") > 0.9), "improving").when(F.size("risk_factors") >= 2, "deteriorating").otherwise("stable")
    s = signals(spark, sf).withColumn("risk_factors", factors)
    return s.select("entity_id", F.round(F.least(F.lit(1.0), score), 4).alias("risk_score"), "risk_factors", trend.alias("recent_trend"))


_QUALITY = "100 * (0.3 * least(n / 50.0::DOUBLE, 1) + 0.3 * least(gap * n / 365, 1) + 0.2 * CASE WHEN on_time > 0 THEN 1 ELSE 0 END + 0.2 * greatest(0, 1 - icv))"


@query(
    "data_quality",
    d.with_tables(f"WITH {_SIGNALS} SELECT entity_id, round({_QUALITY}, 4)::DOUBLE AS score, CASE WHEN {_QUALITY} >= 70 THEN 'High' WHEN {_QUALITY} >= 40 THEN 'Medium' ELSE 'Low' END AS level FROM f", "movements", "cash_events"),
)
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    """How much is known of an entity: transactions, span, due dates and steadiness."""
    s = signals(spark, sf).select("entity_id", quality_score(F.col("n"), F.col("gap"), F.col("on_time"), 100 * F.col("icv")).alias("s"))
    return s.select("entity_id", F.round("s", 4).alias("score"), at_least(F.col("s"), [(70, "High"), (40, "Medium")], "Low").alias("level"))


def quality_score(n: Column, gap: Column, on_time: Column, cv_percent: Column) -> Column:
    return 100 * (0.3 * F.least(n / F.lit(50.0), F.lit(1.0)) + 0.3 * F.least(gap * n / 365, F.lit(1.0)) + 0.2 * F.when(on_time > 0, 1).otherwise(0) + 0.2 * F.greatest(F.lit(0.0), 1 - cv_percent / 100))


@query(
    "peer_statistics",
    d.with_tables(
        f"""WITH {_SIGNALS}, k AS (SELECT *, CASE WHEN n < 3 THEN 'low_data' WHEN icv < 0.3 AND on_time > 0.85 THEN 'clockwork' WHEN icv < 0.5 AND on_time > 0.7 AND delay > 20 THEN 'slow_reliable'
  WHEN icv > 0.7 AND icv < 1.2 AND on_time > 0.5 THEN 'bursty' WHEN icv > 1.0 OR on_time < 0.5 THEN 'volatile' ELSE 'bursty' END AS archetype, 0.2{"".join(f" + CASE WHEN f{k} THEN {x} ELSE 0 END" for k, (_, x) in enumerate(SIGNS, 1))} AS risk FROM f)
SELECT archetype, count(*) AS members, round(avg(on_time), 4) AS avg_reliability, round(avg(least(1, risk)), 4)::DOUBLE AS avg_risk, round(avg(delay), 4) AS avg_days_to_pay, round(avg(per_month), 4)::DOUBLE AS avg_frequency FROM k GROUP BY 1""",
        "movements",
        "cash_events",
    ),
)
def peer_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the entities of each archetype: reliability (the share on time), risk, days to pay and transactions a month."""
    risk = F.least(F.lit(1.0), sum((F.when(F.col(f"f{k}"), x).otherwise(0.0) for k, (_, x) in enumerate(SIGNS, 1)), F.lit(0.2)))
    k = signals(spark, sf).withColumn("archetype", archetype(F.col("n"), F.col("icv"), F.col("on_time"), F.col("delay")))
    means = {"avg_reliability": F.col("on_time"), "avg_risk": risk, "avg_days_to_pay": F.col("delay"), "avg_frequency": F.col("per_month")}
    return k.groupBy("archetype").agg(F.count("*").alias("members"), *[F.round(F.avg(c), 4).alias(n) for n, c in means.items()])


@query(
    "percentile_rank",
    d.with_tables(
        """WITH e AS (SELECT entity_id, sum(amount)::DOUBLE AS total FROM movements WHERE direction = 'inflow' GROUP BY 1)
SELECT entity_id, total, round(100.0 * (rank() OVER (ORDER BY total) - 1) / count(*) OVER (), 6)::DOUBLE AS pct FROM e""",
        "movements",
    ),
)
def percentile_rank(spark: SparkSession, sf: str) -> DataFrame:
    """100 x the share of entities below each.

    Distinct totals with their counts fall into ranges between 1000 approximate quantiles; each range
    ranks its own totals and adds the entities of the ranges before, so no task sorts them all.
    """
    e = d.movements(spark, sf).filter("direction = 'inflow'").groupBy("entity_id").agg(F.sum("amount").cast("double").alias("total"))
    counts = e.groupBy("total").agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("total", F.array(*(F.lit(k / 1000) for k in range(1, 1000))), 10_000).alias("cuts"))
    ranged = counts.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("total")))).drop("cuts")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))  # a row for each range
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before("size", Window.orderBy("part")).alias("offset"))
    below = ranged.withColumn("within", before("n", Window.partitionBy("part").orderBy("total"))).join(F.broadcast(offsets), "part")
    n = e.agg(F.count("*").alias("all"))
    return e.join(below, "total").join(F.broadcast(n)).select("entity_id", "total", F.round(100.0 * (F.col("within") + F.col("offset")) / F.col("all"), 6).alias("pct"))


@query(
    "entity_risk",
    d.with_tables(
        f"""WITH {_TX}, a AS (SELECT entity_id, avg(days_to_pay) AS delay, avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END) AS on_time, count(*) AS n, coalesce(stddev_samp(amount) / nullif(avg(amount), 0), 0) AS cv FROM tx GROUP BY 1)
SELECT entity_id, (CASE WHEN delay > 45 THEN 30 WHEN delay > 30 THEN 15 ELSE 0 END + CASE WHEN on_time < 0.5 THEN 30 WHEN on_time < 0.8 THEN 15 ELSE 0 END + CASE WHEN n < 3 THEN 20 ELSE 0 END + CASE WHEN cv > 0.8 THEN 20 ELSE 0 END)::INTEGER AS risk,
  list_filter([CASE WHEN delay > 30 THEN 'slow' END, CASE WHEN on_time < 0.8 THEN 'late' END, CASE WHEN n < 3 THEN 'thin' END, CASE WHEN cv > 0.8 THEN 'erratic' END], lambda x: x IS NOT NULL) AS factors FROM a""",
        "movements",
        "cash_events",
    ),
)
def entity_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk points and their factors."""
    a = transactions(spark, sf).groupBy("entity_id").agg(
        F.avg("days_to_pay").alias("delay"), F.avg(F.when(F.col("on_time"), 1.0).otherwise(0.0)).alias("on_time"), F.count("*").alias("n"), F.coalesce(F.stddev_samp("amount") / F.nullif(F.avg("amount"), F.lit(0.0)), F.lit(0.0)).alias("cv")
    )
    c = F.col
    points = F.when(c("delay") > 45, 30).when(c("delay") > 30, 15).otherwise(0) + F.when(c("on_time") < 0.5, 30).when(c("on_time") < 0.8, 15).otherwise(0) + F.when(c("n") < 3, 20).otherwise(0) + F.when(c("cv") > 0.8, 20).otherwise(0)
    factors = F.array_compact(F.array(F.when(c("delay") > 30, "slow"), F.when(c("on_time") < 0.8, "late"), F.when(c("n") < 3, "thin"), F.when(c("cv") > 0.8, "erratic")))
    return a.select("entity_id", points.alias("risk"), factors.alias("factors"))


@query(
    "ap_median_delay",
    d.with_tables("""SELECT m.entity_id, median(m.date - e.expected_date)::DOUBLE AS median_delay, count(*) AS n FROM movements m JOIN cash_events e USING (event_id) WHERE m.direction = 'outflow' GROUP BY 1""", "movements", "cash_events"),
)
def ap_median_delay(spark: SparkSession, sf: str) -> DataFrame:
    """The median of days paid after the due date, by vendor."""
    e = d.cash_events(spark, sf).select("event_id", "expected_date")
    m = d.movements(spark, sf).filter("direction = 'outflow'").join(e, "event_id")
    return m.groupBy("entity_id").agg(F.median(F.datediff("date", "expected_date")).alias("median_delay"), F.count("*").alias("n"))


@query(
    "payment_ratio_profiles",
    d.with_tables(
        """SELECT m.entity_id, round(avg(m.amount::DOUBLE / e.amount::DOUBLE), 6) AS avg_ratio, round(var_pop(m.amount::DOUBLE / e.amount::DOUBLE), 6) AS ratio_variance, count(*) AS n
FROM movements m JOIN cash_events e USING (event_id) WHERE m.direction = 'inflow' AND e.amount > 0 GROUP BY 1 HAVING count(*) >= 2""",
        "movements",
        "cash_events",
    ),
)
def payment_ratio_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Paid over billed: mean and population variance."""
    e = d.cash_events(spark, sf).filter("event_type = 'ar' and amount > 0").select("event_id", F.col("amount").cast("double").alias("gross"))
    r = F.col("amount").cast("double") / F.col("gross")
    return d.movements(spark, sf).filter("direction = 'inflow'").select("entity_id", "event_id", "amount").join(e, "event_id").groupBy("entity_id").agg(
        F.round(F.avg(r), 6).alias("avg_ratio"), F.round(F.var_pop(r), 6).alias("ratio_variance"), F.count("*").alias("n")
    ).filter("n >= 2")


@query(
    "cash_profiles",
    d.with_tables(
        """SELECT entity_id, coalesce(sum(amount) FILTER (WHERE direction = 'inflow'), 0)::DOUBLE AS cash_in, coalesce(sum(amount) FILTER (WHERE direction = 'outflow'), 0)::DOUBLE AS cash_out, count(*) AS n,
  round(least(1.0, 0.35 + 0.05 * count(*)), 4)::DOUBLE AS reliability FROM movements GROUP BY 1""",
        "movements",
    ),
)
def cash_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Cash in and out and a reliability that grows with the count."""
    i = F.col("direction") == "inflow"
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("double")
    return d.movements(spark, sf).groupBy("entity_id").agg(some(i).alias("cash_in"), some(~i).alias("cash_out"), F.count("*").alias("n"), F.round(F.least(F.lit(1.0), 0.35 + 0.05 * F.count("*")), 4).alias("reliability"))


@query(
    "entities_with_transactions",
    d.with_tables(
        """SELECT entity_id, count(DISTINCT movement_id) AS n, sum(amount)::DOUBLE AS total, CASE WHEN count(*) FILTER (WHERE direction = 'inflow') >= count(*) FILTER (WHERE direction = 'outflow') THEN 'inflow' ELSE 'outflow' END AS main
FROM movements GROUP BY 1 HAVING count(*) >= 2""",
        "movements",
    ),
)
def entities_with_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with at least two movements."""
    i = F.count_if(F.col("direction") == "inflow")
    g = d.movements(spark, sf).groupBy("entity_id").agg(F.countDistinct("movement_id").alias("n"), F.sum("amount").cast("double").alias("total"), F.when(i >= F.count("*") - i, "inflow").otherwise("outflow").alias("main"), F.count("*").alias("rows"))
    return g.filter("rows >= 2").drop("rows")


@query(
    "movement_families",
    d.with_tables(
        """WITH f AS (SELECT direction || '|' || account || '|' || substr(regexp_replace(upper(raw_description), '[0-9]{4,}', 'NNNNN', 'g'), 1, 40) AS family_key, economic_class, confidence FROM movements),
c AS (SELECT family_key, economic_class, count(*) AS k, avg(confidence) AS conf FROM f WHERE confidence >= 0.6 GROUP BY 1, 2),
t AS (SELECT family_key, sum(k)::BIGINT AS n, arg_max(economic_class, struct_pack(k := k, c := economic_class)) AS dominant, max(k) AS top, sum(conf * k) / sum(k) AS conf FROM c GROUP BY 1)
SELECT family_key, n, dominant, round(least(0.85, conf + 0.05), 6)::DOUBLE AS confidence FROM t WHERE n >= 3 AND top >= 0.6 * n""",
        "movements",
    ),
)
def movement_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families of like descriptors and their dominant class: counts by class first, then the largest."""
    from tidemark.functions.names import family_key

    f = d.movements(spark, sf).filter("confidence >= 0.6").select(family_key(F.col("direction"), F.col("account"), F.col("raw_description")).alias("family_key"), "economic_class", "confidence")
    c = f.groupBy("family_key", "economic_class").agg(F.count("*").alias("k"), F.avg("confidence").alias("conf"))
    t = c.groupBy("family_key").agg(F.sum("k").alias("n"), F.max_by("economic_class", F.struct("k", "economic_class")).alias("dominant"), F.max("k").alias("top"), (F.sum(F.col("conf") * F.col("k")) / F.sum("k")).alias("conf"))
    return t.filter("n >= 3 and top >= 0.6 * n").select("family_key", "n", "dominant", F.round(F.least(F.lit(0.85), F.col("conf") + 0.05), 6).alias("confidence"))


@query(
    "outlier_tags",
    d.with_tables(
        """WITH s AS (SELECT economic_class, avg(amount::DOUBLE) AS mu, stddev_samp(amount::DOUBLE) AS sd FROM movements GROUP BY 1)
SELECT movement_id, CASE WHEN amount > mu + 3 * sd THEN 'outlier' ELSE 'anomaly' END AS tag FROM movements JOIN s USING (economic_class) WHERE amount > mu + 2.5 * sd""",
        "movements",
    ),
)
def outlier_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Movements far above their class's mean: class statistics are a few rows and are broadcast."""
    m = d.movements(spark, sf)
    x = F.col("amount").cast("double")
    s = m.groupBy("economic_class").agg(F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"))
    j = m.select("movement_id", "economic_class", x.alias("x")).join(F.broadcast(s), "economic_class").filter("x > mu + 2.5 * sd")
    return j.select("movement_id", F.when(F.col("x") > F.col("mu") + 3 * F.col("sd"), "outlier").otherwise("anomaly").alias("tag"))
