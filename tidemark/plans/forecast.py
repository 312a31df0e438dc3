"""Forecast: components, models, events, daily projection, scenarios, simulation, backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import normal_cdf
from tidemark.registry import query
from tidemark.sources import domain as d

TODAY = f"DATE '{d.AS_OF}'"

_COMP = """c AS (SELECT direction, economic_class, date_trunc('month', date)::DATE AS month, sum(amount)::DOUBLE AS total, count(*) AS n FROM movements GROUP BY 1, 2, 3),
s AS (SELECT direction, economic_class, min(date) AS a, max(date) AS b FROM movements GROUP BY 1, 2)"""


@query(
    "forecast_components",
    d.with_tables(
        f"""WITH {_COMP} SELECT direction, economic_class, round(sum(total) / greatest(1.0, (max(b) - max(a)) / 30.0), 4)::DOUBLE AS monthly_avg, round(least(3.0, coalesce(stddev_samp(total) / avg(total), 0)), 6)::DOUBLE AS volatility,
  count(*) AS months, sum(n)::BIGINT AS n FROM c JOIN s USING (direction, economic_class) GROUP BY 1, 2""",
        "movements",
    ),
)
def forecast_components(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly average and volatility of each class: months first, then classes."""
    c = d.movements(spark, sf).groupBy("direction", "economic_class", F.trunc("date", "month").alias("month")).agg(F.sum("amount").cast("double").alias("total"), F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    span = F.greatest(F.lit(1.0), F.datediff(F.max("b"), F.min("a")) / 30.0)
    return c.groupBy("direction", "economic_class").agg(
        F.round(F.sum("total") / span, 4).alias("monthly_avg"), F.round(F.least(F.lit(3.0), F.coalesce(F.stddev_samp("total") / F.avg("total"), F.lit(0.0))), 6).alias("volatility"), F.count("*").alias("months"), F.sum("n").alias("n")
    )


_MODEL = f"""g AS (SELECT entity_id, direction, date, amount AS money, date - lag(date) OVER (PARTITION BY entity_id, direction ORDER BY date, movement_id) AS gap FROM movements),
m AS (SELECT entity_id, direction, count(*) AS n, floor(sum(money)::DOUBLE / count(*) * 100 + 0.5) / 100 AS avg_amount, greatest(1, floor(coalesce(avg(gap), 30) + 0.5))::INTEGER AS cadence, max(date) AS last, {TODAY} - max(date) AS idle FROM g GROUP BY 1, 2),
p AS (SELECT *, round(CASE WHEN n >= 3 THEN 1 / (1 + exp(2.5 * (idle::DOUBLE / cadence - 2))) * 0.9 * (1 + 0.1 * least(1.0, n / 6.0)) ELSE 0.45 / (1 + exp(2.5 * (idle::DOUBLE / cadence - 2))) END, 6) AS raw FROM m),
q AS (SELECT entity_id, direction, n, avg_amount, cadence, last, greatest(0.02, least(0.98, raw))::DOUBLE AS probability FROM p)"""


def models(spark: SparkSession, sf: str) -> DataFrame:
    """For each entity and direction: amount, cadence and the chance of a next payment, decaying with idle time."""
    w = Window.partitionBy("entity_id", "direction").orderBy("date", "movement_id")
    g = d.movements(spark, sf).select("entity_id", "direction", "date", "amount", F.datediff("date", F.lag("date").over(w)).alias("gap"))
    mean = F.floor(F.sum("amount").cast("double") / F.count("*") * 100 + 0.5) / 100
    m = g.groupBy("entity_id", "direction").agg(
        F.count("*").alias("n"), mean.alias("avg_amount"), F.greatest(F.lit(1), F.floor(F.coalesce(F.avg("gap"), F.lit(30.0)) + 0.5)).cast("int").alias("cadence"), F.max("date").alias("last")
    )
    decay = 1 / (1 + F.exp(2.5 * (F.datediff(F.lit(d.AS_OF).cast("date"), F.col("last")).cast("double") / F.col("cadence") - 2)))
    raw = F.round(F.when(F.col("n") >= 3, decay * 0.9 * (1 + 0.1 * F.least(F.lit(1.0), F.col("n") / 6.0))).otherwise(0.45 * decay), 6)
    return m.withColumn("probability", F.greatest(F.lit(0.02), F.least(F.lit(0.98), raw)))


@query("payment_models", d.with_tables(f"WITH {_MODEL} SELECT * FROM q", "movements"))
def payment_models(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf)


_EVENTS = f"""k AS (SELECT *, last + (ceil(greatest(1, {TODAY} - last)::DOUBLE / cadence) * cadence)::INTEGER AS first FROM q WHERE probability >= 0.15),
e AS (SELECT entity_id, direction, avg_amount AS amount, probability, unnest(generate_series(0, 4))::INTEGER AS i, first, cadence FROM k),
ev AS (SELECT entity_id, direction, amount, probability, (first + i * cadence) - {TODAY} AS day FROM e WHERE (first + i * cadence) - {TODAY} BETWEEN 1 AND 30)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Expected payments of the next 30 days: at most five repeats by cadence (an explode, no join)."""
    today = F.lit(d.AS_OF).cast("date")
    m = models(spark, sf).filter("probability >= 0.15")
    first = F.date_add("last", (F.ceil(F.greatest(F.lit(1), F.datediff(today, "last")).cast("double") / F.col("cadence")) * F.col("cadence")).cast("int"))
    e = m.withColumn("first", first).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return e.select("entity_id", "direction", F.col("avg_amount").alias("amount"), "probability", (F.datediff("first", today) + F.col("i") * F.col("cadence")).alias("day")).filter("day between 1 and 30")


@query("forecast_events", d.with_tables(f"WITH {_MODEL}, {_EVENTS} SELECT entity_id, direction, amount, probability, day::INTEGER AS day FROM ev", "movements"))
def forecast_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf)


_SCEN = "(VALUES ('base', 1.0::DOUBLE, 1.0::DOUBLE), ('pessimistic', 0.88, 1.12), ('optimistic', 1.15, 0.95)) AS s(scenario, up, down)"


@query(
    "daily_projection",
    d.with_tables(
        f"""WITH {_MODEL}, {_EVENTS}, n AS (SELECT day, sum(round(amount * probability, 2)::DECIMAL(18,2)) FILTER (WHERE direction = 'inflow') AS i, sum(round(amount * probability, 2)::DECIMAL(18,2)) FILTER (WHERE direction = 'outflow') AS o FROM ev GROUP BY 1)
SELECT g.day::INTEGER AS day, round(coalesce(i, 0)::DOUBLE, 2) AS inflow, round(coalesce(o, 0)::DOUBLE, 2) AS outflow, (1000000 + sum(coalesce(i, 0) - coalesce(o, 0)) OVER (ORDER BY g.day))::DOUBLE AS cash FROM generate_series(1, 30) g(day) LEFT JOIN n ON n.day = g.day""",
        "movements",
    ),
)
def daily_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Expected cash of the next 30 days; the window sees 30 rows."""
    x = F.round(F.col("amount") * F.col("probability"), 2).cast(d.MONEY)
    i = F.col("direction") == "inflow"
    n = events(spark, sf).groupBy("day").agg(F.sum(F.when(i, x)).alias("i"), F.sum(F.when(~i, x)).alias("o"))
    g = spark.range(1, 31).select(F.col("id").cast("int").alias("day")).join(n, "day", "left").fillna(0, ["i", "o"])
    cash = 1000000 + F.sum(F.col("i") - F.col("o")).over(Window.orderBy("day"))
    return g.select("day", F.col("i").cast("double").alias("inflow"), F.col("o").cast("double").alias("outflow"), cash.cast("double").alias("cash"))


@query(
    "scenarios",
    d.with_tables(
        f"""WITH {_MODEL}, {_EVENTS}, t AS (SELECT coalesce(sum(round(amount * probability, 2)::DECIMAL(18,2)) FILTER (WHERE direction = 'inflow'), 0)::DOUBLE AS i, coalesce(sum(round(amount * probability, 2)::DECIMAL(18,2)) FILTER (WHERE direction = 'outflow'), 0)::DOUBLE AS o FROM ev)
SELECT scenario, round(i * up, 2) AS inflow, round(o * down, 2) AS outflow, round(i * up - o * down, 2) AS net FROM t, {_SCEN}""",
        "movements",
    ),
)
def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Base, pessimistic and optimistic totals: one aggregate row times three multipliers."""
    x = F.round(F.col("amount") * F.col("probability"), 2).cast(d.MONEY)
    i = F.col("direction") == "inflow"
    some = lambda c: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("double")
    t = events(spark, sf).agg(some(i).alias("i"), some(~i).alias("o"))
    rows = [F.struct(F.lit(n).alias("scenario"), F.lit(u).alias("up"), F.lit(v).alias("down")) for n, u, v in (("base", 1.0, 1.0), ("pessimistic", 0.88, 1.12), ("optimistic", 1.15, 0.95))]
    s = t.withColumn("s", F.explode(F.array(*rows))).select("i", "o", "s.*")
    up, down = F.col("i") * F.col("up"), F.col("o") * F.col("down")
    return s.select("scenario", F.round(up, 2).alias("inflow"), F.round(down, 2).alias("outflow"), F.round(up - down, 2).alias("net"))


@query(
    "sensitivity",
    d.with_tables(f"WITH {_MODEL}, {_EVENTS} SELECT entity_id, sum(round(amount * probability, 2)::DECIMAL(18,2))::DOUBLE AS impact FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "movements"),
)
def sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """The eight entities on whom the projection depends most."""
    x = F.round(F.col("amount") * F.col("probability"), 2).cast(d.MONEY)
    return events(spark, sf).groupBy("entity_id").agg(F.sum(x).cast("double").alias("impact")).orderBy(F.desc("impact"), "entity_id").limit(8)


@query(
    "runway",
    d.with_tables(
        """WITH m AS (SELECT date_trunc('month', date)::DATE AS month, sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END) AS net FROM movements GROUP BY 1), r AS (SELECT month, (5000000 + sum(net) OVER (ORDER BY month))::DOUBLE AS cash FROM m)
SELECT month, cash, (SELECT min(month) FROM r WHERE cash < 0) AS first_negative FROM r""",
        "movements",
    ),
)
def runway(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative cash by month and the first month below zero; both windows see a row for each month."""
    m = d.movements(spark, sf).groupBy(F.trunc("date", "month").alias("month")).agg(F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))).alias("net"))
    r = m.select("month", (5000000 + F.sum("net").over(Window.orderBy("month"))).cast("double").alias("cash"))
    return r.withColumn("first_negative", F.min(F.when(F.col("cash") < 0, F.col("month"))).over(Window.partitionBy()))


_BASE = """n AS (SELECT date AS day, sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END)::DOUBLE AS net FROM movements WHERE date IS NOT NULL GROUP BY 1),
f AS (SELECT g.day::DATE AS day, coalesce(net, 0) AS net FROM generate_series((SELECT min(day) FROM n), (SELECT max(day) FROM n), INTERVAL 1 DAY) g(day) LEFT JOIN n ON n.day = g.day::DATE),
b AS (SELECT day, net, avg(net) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS naive7, avg(net) OVER (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS rolling14, lag(net, 28) OVER (ORDER BY day) AS last_cycle, 0.0::DOUBLE AS due_date FROM f)"""

MODELS = ("naive7", "rolling14", "last_cycle", "due_date")


def all_baselines(m: DataFrame, cutoff: str | None = None, horizon: int | None = None) -> DataFrame:
    """Daily net flow from the first to the last date of ``m``, absent days as zero, with the four baselines' predictions.

    The due-date baseline predicts zero, as the reference's does. A row a day, so the window sees as many rows as there are days.
    With ``cutoff``, only the days after it, and with ``horizon`` only so many of them; days before still serve as history.
    """
    n = m.filter("date is not null").groupBy(F.col("date").alias("day")).agg(F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))).cast("double").alias("net"))
    ends = m.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a is not null")
    f = ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(n, "day", "left").fillna(0.0, ["net"])
    w = Window.orderBy("day")
    b = f.withColumns({"naive7": F.avg("net").over(w.rowsBetween(-7, -1)), "rolling14": F.avg("net").over(w.rowsBetween(-14, -1)), "last_cycle": F.lag("net", 28).over(w), "due_date": F.lit(0.0)})
    if cutoff is not None:
        b = b.filter(F.col("day") > F.lit(cutoff).cast("date"))
        if horizon is not None:
            b = b.filter(F.col("day") <= F.date_add(F.lit(cutoff).cast("date"), horizon))
    return b


@query(
    "baseline_forecasts",
    d.with_tables(f"WITH {_BASE} SELECT day, round(net, 2) AS net, round(naive7, 4) AS naive7, round(rolling14, 4) AS rolling14, round(last_cycle, 2) AS last_cycle, due_date FROM b", "movements"),
)
def baseline_forecasts(spark: SparkSession, sf: str, cutoff: str | None = None, horizon: int | None = None) -> DataFrame:
    """The baselines of every day; null where there is no day before to learn from."""
    b = all_baselines(d.movements(spark, sf), cutoff, horizon)
    return b.select("day", F.round("net", 2).alias("net"), F.round("naive7", 4).alias("naive7"), F.round("rolling14", 4).alias("rolling14"), F.round("last_cycle", 2).alias("last_cycle"), "due_date")


@query(
    "backtest_scores",
    d.with_tables(
        f"""WITH {_BASE}, u AS (SELECT net, model, p FROM (UNPIVOT b ON naive7, rolling14, last_cycle, due_date INTO NAME model VALUE p) WHERE p IS NOT NULL AND (abs(net) >= 1 OR abs(p) >= 1)),
s AS (SELECT model, avg(abs(net - p)) AS mae, avg(abs(net)) AS scale, avg(CASE WHEN (net >= 0) = (p >= 0) THEN 1.0 ELSE 0.0 END) AS direction, count(*) AS days FROM u GROUP BY 1)
SELECT model, days, round(mae, 3) AS mae, round(direction, 6) AS direction_accuracy, floor(greatest(0, least(100, direction * 60 + (1 - least(1, coalesce(mae / nullif(scale, 0), 1))) * 40)) + 0.5)::BIGINT AS score FROM s""",
        "movements",
    ),
)
def backtest_scores(spark: SparkSession, sf: str, cutoff: str | None = None, horizon: int | None = None) -> DataFrame:
    """The four baselines scored over every day that they predict."""
    return scored(all_baselines(d.movements(spark, sf), cutoff, horizon))


def scored(b: DataFrame) -> DataFrame:
    x = b.select("net", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("p")) for n in MODELS])).alias("m")).select("net", "m.*")
    x = x.filter(F.col("p").isNotNull() & ((F.abs("net") >= 1) | (F.abs("p") >= 1)))
    s = x.groupBy("model").agg(
        F.avg(F.abs(F.col("net") - F.col("p"))).alias("mae"), F.avg(F.abs("net")).alias("scale"), F.avg(F.when((F.col("net") >= 0) == (F.col("p") >= 0), 1.0).otherwise(0.0)).alias("direction"), F.count("*").alias("days")
    )
    missed = F.coalesce(F.col("mae") / F.nullif(F.col("scale"), F.lit(0.0)), F.lit(1.0))
    raw = F.col("direction") * 60 + (1 - F.least(F.lit(1.0), missed)) * 40
    return s.select("model", "days", F.round("mae", 3).alias("mae"), F.round("direction", 6).alias("direction_accuracy"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) + 0.5).alias("score"))


@query(
    "horizon_errors",
    d.with_tables(
        f"""WITH {_BASE}, e AS (SELECT min(day) AS a, max(day) AS z FROM b), h AS (SELECT horizon, z - horizon AS cutoff FROM e, (VALUES (7), (14), (30), (60), (90)) v(horizon) WHERE horizon <= 0.4 * (z - a))
SELECT horizon, cutoff, round(abs(avg(net) FILTER (WHERE day > cutoff AND day <= cutoff + horizon) - avg(net) FILTER (WHERE day <= cutoff)), 4) AS mean_gap FROM b, h GROUP BY 1, 2""",
        "movements",
    ),
)
def horizon_errors(spark: SparkSession, sf: str, cutoff: str | None = None) -> DataFrame:
    """The error of the mean of all days before a cutoff, at the horizons of at most 0.4 of the days; the cutoff is as far from the last day as the horizon unless one is given."""
    b = all_baselines(d.movements(spark, sf))
    ends = b.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    h = ends.withColumn("horizon", F.explode(F.array(*map(F.lit, (7, 14, 30, 60, 90))))).filter(F.col("horizon") <= 0.4 * F.datediff("z", "a"))
    cut = F.date_sub("z", F.col("horizon")) if cutoff is None else F.lit(cutoff).cast("date")
    x = b.join(F.broadcast(h.select("horizon", cut.alias("cutoff"))))
    ahead = F.datediff("day", "cutoff")
    gap = F.abs(F.avg(F.when((ahead > 0) & (ahead <= F.col("horizon")), F.col("net"))) - F.avg(F.when(ahead <= 0, F.col("net"))))
    return x.groupBy("horizon", "cutoff").agg(F.round(gap, 4).alias("mean_gap"))


@query(
    "calibration_error",
    d.with_tables(
        """WITH x AS (SELECT m.confidence, CASE WHEN abs(m.amount - e.amount) < 0.01 THEN 1.0 ELSE 0.0 END AS hit FROM movements m JOIN cash_events e USING (event_id) WHERE m.direction = 'inflow'),
g AS (SELECT least(4, floor(confidence * 5))::INTEGER AS bin, count(*) AS n, avg(confidence) AS c, avg(hit) AS h FROM x GROUP BY 1)
SELECT bin, n, round(c, 6) AS confidence, round(h, 6) AS hit_rate, round(n * abs(c - h) / (SELECT sum(n) FROM g), 6)::DOUBLE AS gap FROM g""",
        "movements",
        "cash_events",
    ),
)
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    """Five bins of confidence against hit rate; the gaps add up to the expected calibration error."""
    e = d.cash_events(spark, sf).select("event_id", F.col("amount").alias("due"))
    x = d.movements(spark, sf).filter("direction = 'inflow'").select("event_id", "amount", "confidence").join(e, "event_id")
    g = x.groupBy(F.least(F.lit(4), F.floor(F.col("confidence") * 5)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.when(F.abs(F.col("amount") - F.col("due")) < 0.01, 1.0).otherwise(0.0)).alias("h"))
    total = F.sum("n").over(Window.partitionBy())  # five rows
    return g.select("bin", "n", F.round("c", 6).alias("confidence"), F.round("h", 6).alias("hit_rate"), F.round(F.col("n") * F.abs(F.col("c") - F.col("h")) / total, 6).alias("gap"))


def _uniform(*keys: Column) -> Column:
    """A number in (0, 1) that the keys alone decide, so that any partitioning gives the same draw."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


#: What multiplies chance and amount of inflows and outflows, and shifts their days, in each scenario: the reference's calibration.
BIASES = {"base": (1.0, 1.0, 1.0, 1.0, 0, 0), "conservative": (0.75, 1.0, 0.9, 1.1, 3, -1), "aggressive": (1.0, 0.85, 1.1, 0.92, -2, 1)}

START = 1_000_000.0


def simulated(e: DataFrame, simulations: int, scenarios: tuple[str, ...] = ("base",), run: int = 0) -> DataFrame:
    """scenario, sim, day and cash of each of 30 days: each event happens with its chance, with noise in amount and, drawn apart, in day.

    Draws depend on (run, scenario, simulation, event) by hash. Simulated flows are summed by (scenario, simulation, day) before the
    running balance, so windows see 30 rows for each simulation.
    """
    spark = e.sparkSession
    rows = [F.struct(F.lit(n).alias("scenario"), *[F.lit(v).cast("double").alias(c) for c, v in zip(("ip", "op", "ia", "oa", "idelay", "odelay"), BIASES[n], strict=True)]) for n in scenarios]
    sims = e.withColumn("s", F.explode(F.array(*rows))).select("entity_id", "direction", "amount", "probability", "day", "s.*").withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(simulations))))
    key = lambda k: (F.lit(k), F.lit(run), F.col("scenario"), F.col("sim"), F.col("entity_id"), F.col("direction"), F.col("day"))
    gauss = lambda k: F.sqrt(-2 * F.log(_uniform(*key(k)))) * F.cos(2 * 3.141592653589793 * _uniform(*key(k + 1)))
    inflow = F.col("direction") == "inflow"
    happens = sims.filter(_uniform(*key(1)) <= F.least(F.lit(1.0), F.col("probability") * F.when(inflow, F.col("ip")).otherwise(F.col("op"))))
    flow = F.when(inflow, F.col("ia")).otherwise(-F.col("oa")) * F.col("amount") * F.greatest(F.lit(0.0), 1 + gauss(2) * 0.15)
    delay = F.round(gauss(4) * 1.5 + F.when(inflow, F.col("idelay")).otherwise(F.col("odelay"))).cast("int")
    day = F.greatest(F.lit(1), F.least(F.lit(30), F.col("day") + delay))
    daily = happens.select("scenario", "sim", day.alias("day"), flow.alias("flow")).groupBy("scenario", "sim", "day").agg(F.sum("flow").alias("flow"))
    grid = spark.range(1, simulations + 1).select(F.explode(F.array(*map(F.lit, scenarios))).alias("scenario"), F.col("id").cast("int").alias("sim")).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(30))))
    cash = START + F.sum("flow").over(Window.partitionBy("scenario", "sim").orderBy("day"))
    return grid.join(daily, ["scenario", "sim", "day"], "left").fillna(0.0, ["flow"]).select("scenario", "sim", "day", cash.alias("cash"))


@query("monte_carlo")
def monte_carlo(spark: SparkSession, sf: str, simulations: int = 500) -> DataFrame:
    """Quantiles of simulated daily cash and the chance that it is below zero, by day (those of 14 and 30 days are two of the rows)."""
    q = lambda p: F.round(F.percentile("cash", p), 2)
    return simulated(events(spark, sf), simulations).groupBy("day").agg(
        q(0.05).alias("p5"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.95).alias("p95"), F.avg(F.when(F.col("cash") < 0, 1.0).otherwise(0.0)).alias("negative")
    )


@query("monte_carlo_risks")
def monte_carlo_risks(spark: SparkSession, sf: str, simulations: int = 500) -> DataFrame:
    """Of the same simulations: chances below zero at 14 and 30 days and above the start at 30, and expected, worst and best cash at 30."""
    at = lambda day: F.when(F.col("day") == day, F.col("cash"))
    share = lambda day, hit: F.round(F.avg(F.when(F.col("day") == day, F.when(hit, 1.0).otherwise(0.0))), 2)
    rank = lambda p: F.round(F.element_at(F.sort_array(F.collect_list(at(30))), simulations * p // 100 + 1), 2)
    below, above = F.col("cash") < 0, F.col("cash") > START
    return simulated(events(spark, sf), simulations).agg(
        share(14, below).alias("prob_below_zero_14d"), share(30, below).alias("prob_below_zero_30d"), share(30, above).alias("prob_above_starting_30d"), F.round(F.avg(at(30)), 2).alias("expected_cash_30d"),
        rank(5).alias("worst_case_cash_30d"), rank(95).alias("best_case_cash_30d"),
    )


@query("monte_carlo_scenarios")
def monte_carlo_scenarios(spark: SparkSession, sf: str, simulations: int = 200) -> DataFrame:
    """For each scenario's own simulations: median cash at 14 and 30 days, and the least of the median path and the start, with its day (0: the start)."""
    m = simulated(events(spark, sf), simulations, tuple(BIASES), run=1).groupBy("scenario", "day").agg(F.percentile("cash", 0.5).alias("p50"))
    at = lambda day: F.round(F.max(F.when(F.col("day") == day, F.col("p50"))), 2)
    low = F.array_min(F.array(F.struct(F.lit(START).alias("cash"), F.lit(0).alias("day")), F.min(F.struct(F.col("p50").alias("cash"), "day"))))
    return m.groupBy("scenario").agg(at(14).alias("cash_14d"), at(30).alias("cash_30d"), low.alias("low")).select("scenario", "cash_14d", "cash_30d", F.round("low.cash", 2).alias("min_cash"), F.col("low.day").alias("min_cash_day"))


@query(
    "normal_distribution",
    """WITH x AS (SELECT event_id, (value - 100) / 100 AS z FROM events), t AS (SELECT event_id, z, 1 / (1 + 0.2316419 * abs(z)) AS t FROM x),
u AS (SELECT event_id, z, exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS u FROM t)
SELECT event_id, round(CASE WHEN z >= 0 THEN 1 - u ELSE u END, 8) AS p FROM u""",
)
def normal_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """The normal distribution function as a column expression."""
    from tidemark.session import table

    return table(spark, sf, "events").select("event_id", F.round(normal_cdf((F.col("value") - 100) / 100), 8).alias("p"))
