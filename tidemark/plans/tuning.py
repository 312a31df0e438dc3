"""Calibration: forecasts of a past fortnight under many parameters at once, the best of them, and bins of chances against what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.sources import domain as d

#: The last day that forecasts know, and the days that they foretell.
CUTOFF, DAYS = "1998-06-01", 14
# The steps of each parameter in the order in which they are tuned, with its default; the least flow a day; what a wrong direction costs; the least payments of a sure model.
GRID = {"scale": ((0.8, 0.9, 1.0, 1.1, 1.2), 1.0), "decay": ((1.5, 2.0, 2.5, 3.0, 3.5), 2.5), "floor": ((0.01, 0.02, 0.05), 0.02)}
LEAST_FLOW, WRONG, MOST = 100.0, 0.5, 0.98
#: The events that a bin of chances needs.
ENOUGH = 60


def due(m: DataFrame, cutoff: str = CUTOFF, days: int = DAYS) -> DataFrame:
    """entity_id, direction, amount, n, wait (idle time in intervals) and day of every payment that cadences place on the ``days`` after ``cutoff``, from what came before."""
    end = F.lit(cutoff).cast("date")
    w = Window.partitionBy("entity_id", "direction").orderBy("date", "movement_id")
    g = m.filter(F.col("date") <= end).select("entity_id", "direction", "date", "amount", F.datediff("date", F.lag("date").over(w)).alias("gap"))
    amount = F.floor(F.sum("amount").cast("double") / F.count("*") * 100 + 0.5) / 100
    s = g.groupBy("entity_id", "direction").agg(F.count("*").alias("n"), amount.alias("amount"), F.greatest(F.lit(1), F.floor(F.coalesce(F.avg("gap"), F.lit(30.0)) + 0.5)).cast("int").alias("cadence"), F.max("date").alias("last"))
    idle = F.datediff(end, "last")
    first = F.ceil(F.greatest(F.lit(1), idle).cast("double") / F.col("cadence")) * F.col("cadence") - idle
    s = s.withColumns({"wait": idle.cast("double") / F.col("cadence"), "first": first, "i": F.explode(F.sequence(F.lit(0), F.lit(days - 1)))})
    return s.withColumn("day", (F.col("first") + F.col("i") * F.col("cadence")).cast("int")).filter(F.col("day").between(1, days)).select("entity_id", "direction", "amount", "n", "wait", "day")


def chance(scale, decay, floor):
    """The chance of a payment, given its model's idle time."""
    fade = 1 / (1 + F.exp(decay * (F.col("wait") - 2)))
    sure = F.when(F.col("n") >= 3, fade * 0.9 * (1 + 0.1 * F.least(F.lit(1.0), F.col("n") / 6.0))).otherwise(0.45 * fade)
    return F.greatest(floor, F.least(F.lit(MOST), sure * scale))


_DUE = f"""g AS (SELECT entity_id, direction, date, amount, date - lag(date) OVER (PARTITION BY entity_id, direction ORDER BY date, movement_id) AS gap FROM movements WHERE date <= DATE '{CUTOFF}'),
s0 AS (SELECT entity_id, direction, count(*) AS n, floor(sum(amount)::DOUBLE / count(*) * 100 + 0.5) / 100 AS amount, greatest(1, floor(coalesce(avg(gap), 30) + 0.5))::INTEGER AS cadence, DATE '{CUTOFF}' - max(date) AS idle FROM g GROUP BY 1, 2),
s1 AS (SELECT *, idle::DOUBLE / cadence AS wait, (ceil(greatest(1, idle)::DOUBLE / cadence) * cadence - idle)::INTEGER AS first, unnest(range({DAYS}))::INTEGER AS i FROM s0),
due AS (SELECT entity_id, direction, amount, n, wait, first + i * cadence AS day FROM s1 WHERE first + i * cadence BETWEEN 1 AND {DAYS})"""
_CHANCE = "greatest({floor}, least(0.98, CASE WHEN n >= 3 THEN 1 / (1 + exp({decay} * (wait - 2))) * 0.9 * (1 + 0.1 * least(1.0, n / 6.0)) ELSE 0.45 / (1 + exp({decay} * (wait - 2))) END * {scale}))"
_VALUES = {k: "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in v) + f") AS {k}_({k})" for k, (v, _) in GRID.items()}
_GRID = f"""{_DUE}, grid AS (SELECT * FROM {", ".join(_VALUES.values())}),
told AS (SELECT scale, decay, floor, day, sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END * {_CHANCE.format(floor="floor", decay="decay", scale="scale")}) AS p FROM due, grid GROUP BY ALL),
real AS (SELECT r.day::INTEGER AS day, coalesce(sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END), 0)::DOUBLE AS net FROM range(1, {DAYS + 1}) r(day) LEFT JOIN movements m ON m.date = DATE '{CUTOFF}' + r.day::INTEGER GROUP BY 1),
flow AS (SELECT greatest({LEAST_FLOW}, sum(amount)::DOUBLE / greatest(1, max(date) - min(date))) AS flow FROM movements),
loss0 AS (SELECT scale, decay, floor, avg(abs(net - coalesce(p, 0))) AS mae, avg(CASE WHEN (net >= 0) = (coalesce(p, 0) >= 0) THEN 1.0 ELSE 0.0 END) AS direction FROM (SELECT * FROM grid, real) x LEFT JOIN told USING (scale, decay, floor, day) GROUP BY 1, 2, 3),
loss AS (SELECT scale, decay, floor, round(mae, 4) AS mae, round(direction, 6)::DOUBLE AS direction_accuracy, round(mae / flow + (1 - direction) * {WRONG}, 8)::DOUBLE AS loss FROM loss0, flow)"""


def losses(m: DataFrame) -> DataFrame:
    """scale, decay, floor, mae, direction_accuracy and loss of every combination, from one scan: each expected payment carries all of them, and tasks sum by combination and day before anything moves."""
    spark = m.sparkSession
    some = [F.struct(F.lit(a).alias("scale"), F.lit(b).alias("decay"), F.lit(c).alias("floor")) for a in GRID["scale"][0] for b in GRID["decay"][0] for c in GRID["floor"][0]]
    p = due(m).withColumn("g", F.explode(F.array(*some))).select("*", "g.*")
    signed = F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))
    told = p.groupBy("scale", "decay", "floor", "day").agg(F.sum(signed * chance(F.col("scale"), F.col("decay"), F.col("floor"))).alias("p"))
    ahead = F.datediff("date", F.lit(CUTOFF).cast("date"))
    real = m.filter(ahead.between(1, DAYS)).groupBy(ahead.alias("day")).agg(F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))).cast("double").alias("net"))
    flow = m.agg(F.greatest(F.lit(LEAST_FLOW), F.sum("amount").cast("double") / F.greatest(F.lit(1), F.datediff(F.max("date"), F.min("date")))).alias("flow"))
    # 75 combinations times 14 days.
    every = spark.range(1, DAYS + 1).select(F.col("id").cast("int").alias("day"), F.explode(F.array(*some)).alias("g")).select("day", "g.*")
    x = every.join(real, "day", "left").join(told, ["scale", "decay", "floor", "day"], "left").fillna(0.0, ["net", "p"])
    x = x.groupBy("scale", "decay", "floor").agg(F.avg(F.abs(F.col("net") - F.col("p"))).alias("mae"), F.avg(F.when((F.col("net") >= 0) == (F.col("p") >= 0), 1.0).otherwise(0.0)).alias("direction"))
    loss = F.col("mae") / F.col("flow") + (1 - F.col("direction")) * WRONG
    return x.crossJoin(F.broadcast(flow)).select("scale", "decay", "floor", F.round("mae", 4).alias("mae"), F.round("direction", 6).alias("direction_accuracy"), F.round(loss, 8).alias("loss"))


@query("calibration_grid", d.with_tables(f"WITH {_GRID} SELECT * FROM loss", "movements"))
def calibration_grid(spark: SparkSession, sf: str) -> DataFrame:
    return losses(d.movements(spark, sf))


def tuned(rows: list[tuple[float, float, float, float]]) -> tuple[dict[str, float], float, float]:
    """The parameters that coordinate by coordinate improve on the defaults, their loss, and the defaults' loss; rows: scale, decay, floor and loss of every combination."""
    loss = {r[:3]: r[3] for r in rows}
    at = {k: default for k, (_, default) in GRID.items()}
    value = lambda p: loss[tuple(p[k] for k in GRID)]
    first = value(at)
    for k, (steps, _) in GRID.items():
        for step in steps:
            if value(at | {k: step}) < value(at):
                at = at | {k: step}
    return at, value(at), first


@query(
    "calibration_tuned",
    d.with_tables(
        f"""WITH {_GRID}, t1 AS (SELECT scale FROM loss WHERE decay = 2.5 AND floor = 0.02 ORDER BY loss, scale <> 1.0, scale LIMIT 1),
t2 AS (SELECT l.scale, decay FROM loss l JOIN t1 USING (scale) WHERE floor = 0.02 ORDER BY loss, decay <> 2.5, decay LIMIT 1),
t3 AS (SELECT l.* FROM loss l JOIN t2 USING (scale, decay) ORDER BY loss, floor <> 0.02, floor LIMIT 1)
SELECT scale, decay, floor, loss, (SELECT loss FROM loss WHERE scale = 1.0 AND decay = 2.5 AND floor = 0.02) AS default_loss, (SELECT min(loss) FROM loss) AS least_loss FROM t3""",
        "movements",
    ),
)
def calibration_tuned(spark: SparkSession, sf: str) -> DataFrame:
    """The tuned parameters with their loss, beside those of the defaults and of an exhaustive search; 75 rows reach the driver."""
    rows = [tuple(r) for r in losses(d.movements(spark, sf)).select("scale", "decay", "floor", "loss").collect()]
    at, best, first = tuned(rows)
    return spark.createDataFrame([(*at.values(), best, first, min(r[3] for r in rows))], "scale double, decay double, floor double, loss double, default_loss double, least_loss double")


_BINS = f"""{_DUE}, pr AS (SELECT *, {_CHANCE.format(floor="0.02", decay="2.5", scale="1.0")} AS p FROM due),
hits AS (SELECT pr.*, EXISTS (SELECT 1 FROM movements m WHERE m.entity_id = pr.entity_id AND m.direction = pr.direction AND abs((m.date - DATE '{CUTOFF}') - pr.day) <= 1) AS hit FROM pr),
b0 AS (SELECT direction, least(4, floor(p * 5))::INTEGER AS bin, floor(avg(p) * 100 + 0.5) / 100 AS p, floor(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) * 100 + 0.5) / 100 AS a, count(*) AS n FROM hits GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY bin) AS k FROM b0),
r AS (SELECT direction, k, bin AS lo, bin AS hi, p, a, n, 1 AS grp FROM b WHERE k = 1
  UNION ALL SELECT b.direction, b.k, CASE WHEN r.n < {ENOUGH} THEN r.lo ELSE b.bin END, b.bin, CASE WHEN r.n < {ENOUGH} THEN floor((r.p * r.n + b.p * b.n) / (r.n + b.n) * 100 + 0.5) / 100 ELSE b.p END,
    CASE WHEN r.n < {ENOUGH} THEN floor((r.a * r.n + b.a * b.n) / (r.n + b.n) * 100 + 0.5) / 100 ELSE b.a END, CASE WHEN r.n < {ENOUGH} THEN r.n + b.n ELSE b.n END, CASE WHEN r.n < {ENOUGH} THEN grp ELSE grp + 1 END FROM r JOIN b ON b.direction = r.direction AND b.k = r.k + 1)
SELECT direction, (lo * 20) || '-' || (hi * 20 + 20) || '%' AS range, p AS predicted_prob, a AS actual_rate, n, round(abs(p - a) * n / sum(n) OVER (PARTITION BY direction), 6) AS gap
FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY direction, grp ORDER BY k DESC) = 1)"""


def merged(bins: DataFrame, by: str, enough: int = ENOUGH) -> DataFrame:
    """Bins (bin, p, a, n) of each ``by`` in order, where one with too few events takes in the next ones until it has enough: a fold over at most as many bins as there are edges."""
    two = lambda x: F.floor(x * 100 + 0.5) / 100
    kind = "array<struct<lo:int,hi:int,p:double,a:double,n:bigint>>"
    mean = lambda x, y, c: two((x[c] * x["n"] + y[c] * y["n"]) / (x["n"] + y["n"]))

    def step(acc, x):  # noqa: ANN001
        last = F.element_at(acc, -1)
        joined = F.struct(last["lo"].alias("lo"), x["hi"].alias("hi"), mean(last, x, "p").alias("p"), mean(last, x, "a").alias("a"), (last["n"] + x["n"]).alias("n"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["n"] < enough), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    rows = F.array_sort(F.collect_list(F.struct(F.col("bin").alias("lo"), F.col("bin").alias("hi"), "p", "a", "n")))
    return bins.groupBy(by).agg(rows.alias("rows")).select(by, F.explode(F.aggregate("rows", F.array().cast(kind), step)).alias("x")).select(by, "x.*")


@query("calibration_bins", "WITH RECURSIVE " + d.with_tables(f"WITH {_BINS}", "movements").removeprefix("WITH "))
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Chances of the fortnight after the cutoff in five bins against payments of the same entity within a day, sparse bins merged; the gaps add up to each direction's expected calibration error."""
    m = d.movements(spark, sf)
    e = due(m).withColumn("p", chance(F.lit(1.0), F.lit(2.5), F.lit(0.02)))
    ahead = F.datediff("date", F.lit(CUTOFF).cast("date"))
    real = m.select("entity_id", "direction", F.explode(F.array(ahead - 1, ahead, ahead + 1)).alias("day")).filter(F.col("day").between(1, DAYS)).distinct().withColumn("hit", F.lit(1.0))
    x = e.join(real, ["entity_id", "direction", "day"], "left").fillna(0.0, ["hit"])
    two = lambda c: F.floor(F.avg(c) * 100 + 0.5) / 100
    bins = x.groupBy("direction", F.least(F.lit(4), F.floor(F.col("p") * 5)).cast("int").alias("bin")).agg(two("p").alias("p"), two("hit").alias("a"), F.count("*").alias("n"))
    found = merged(bins, "direction")
    total = F.sum("n").over(Window.partitionBy("direction"))
    name = F.concat((F.col("lo") * 20).cast("string"), F.lit("-"), (F.col("hi") * 20 + 20).cast("string"), F.lit("%"))
    return found.select("direction", name.alias("range"), F.col("p").alias("predicted_prob"), F.col("a").alias("actual_rate"), "n", F.round(F.abs(F.col("p") - F.col("a")) * F.col("n") / total, 6).alias("gap"))
