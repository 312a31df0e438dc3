"""Books and dashboards: profit and loss, ledger, periods, paging, facets, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import at_least
from tidemark.operators.joins import first_per_key
from tidemark.registry import query
from tidemark.session import table
from tidemark.sources import domain as d


def _sum(c, x="amount"):  # noqa: ANN001, ANN202
    return F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).cast("double")


@query(
    "profit_and_loss",
    d.with_tables(
        """SELECT year(date)::INTEGER AS year, month(date)::INTEGER AS month, coalesce(sum(amount) FILTER (WHERE economic_class = 'customer_receipt'), 0)::DOUBLE AS revenue, coalesce(sum(amount) FILTER (WHERE economic_class = 'refund'), 0)::DOUBLE AS refunds,
  coalesce(sum(amount) FILTER (WHERE economic_class = 'vendor_payment'), 0)::DOUBLE AS cogs, coalesce(sum(amount) FILTER (WHERE economic_class IN ('payroll','tax','bank_fee')), 0)::DOUBLE AS opex,
  coalesce(sum(amount) FILTER (WHERE policy = 'exclude_and_review'), 0)::DOUBLE AS suspense FROM tagged GROUP BY 1, 2""",
        "tagged",
    ),
)
def profit_and_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue, cost and suspense by month, in one pass."""
    c = F.col("economic_class")
    return d.tagged(spark, sf).groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        _sum(c == "customer_receipt").alias("revenue"), _sum(c == "refund").alias("refunds"), _sum(c == "vendor_payment").alias("cogs"), _sum(c.isin("payroll", "tax", "bank_fee")).alias("opex"), _sum(F.col("policy") == "exclude_and_review").alias("suspense")
    )


@query(
    "chart_of_accounts",
    d.with_tables("SELECT economic_class, direction, year(date)::INTEGER AS year, month(date)::INTEGER AS month, sum(amount)::DOUBLE AS total, count(*) AS n FROM movements GROUP BY 1, 2, 3, 4", "movements"),
)
def chart_of_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return d.movements(spark, sf).groupBy("economic_class", "direction", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("amount").cast("double").alias("total"), F.count("*").alias("n"))


@query(
    "period_status",
    d.with_tables(
        """SELECT (SELECT count(*) FROM movements m WHERE NOT EXISTS (SELECT 1 FROM cash_events e WHERE e.event_id = m.event_id AND abs(e.amount - m.amount) < 0.01)) AS suspense,
  (SELECT count(*) FROM movements WHERE confidence < 0.6) AS low_confidence, (SELECT sum(outstanding)::DOUBLE FROM cash_events WHERE event_type = 'ar') AS open_ar, (SELECT sum(outstanding)::DOUBLE FROM cash_events WHERE event_type = 'ap') AS open_ap""",
        "movements",
        "cash_events",
    ),
)
def period_status(spark: SparkSession, sf: str) -> DataFrame:
    """Movements without an exactly equal event (anti-join), low confidence, and open totals."""
    m, e = d.movements(spark, sf), d.cash_events(spark, sf)
    left = m.select("event_id", "amount").join(e.select(F.col("event_id").alias("e"), F.col("amount").alias("ea")), (F.col("event_id") == F.col("e")) & (F.abs(F.col("ea") - F.col("amount")) < 0.01), "left_anti")
    a = left.agg(F.count("*").alias("suspense"))
    b = m.agg(F.count_if(F.col("confidence") < 0.6).alias("low_confidence"))
    c = e.agg(F.sum(F.when(F.col("event_type") == "ar", F.col("outstanding"))).cast("double").alias("open_ar"), F.sum(F.when(F.col("event_type") == "ap", F.col("outstanding"))).cast("double").alias("open_ap"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # three single rows


@query(
    "journal_entries",
    d.with_tables(
        """SELECT movement_id, line, account, debit::DOUBLE AS debit, credit::DOUBLE AS credit FROM (
  SELECT movement_id, 1 AS line, 'cash:' || account AS account, CASE WHEN direction = 'inflow' THEN amount ELSE 0 END AS debit, CASE WHEN direction = 'inflow' THEN 0 ELSE amount END AS credit FROM tagged
  UNION ALL SELECT movement_id, 2, CASE WHEN policy = 'exclude_and_review' THEN 'suspense' ELSE economic_class END, CASE WHEN direction = 'inflow' THEN 0 ELSE amount END, CASE WHEN direction = 'inflow' THEN amount ELSE 0 END FROM tagged)""",
        "tagged",
    ),
)
def journal_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines for each movement: cash, and its contra account or suspense. One explode, no join."""
    i, zero, a = F.col("direction") == "inflow", F.lit(0.0), F.col("amount").cast("double")
    contra = F.when(F.col("policy") == "exclude_and_review", "suspense").otherwise(F.col("economic_class"))
    cash = F.struct(F.lit(1).alias("line"), F.concat(F.lit("cash:"), "account").alias("account"), F.when(i, a).otherwise(zero).alias("debit"), F.when(i, zero).otherwise(a).alias("credit"))
    other = F.struct(F.lit(2).alias("line"), contra.alias("account"), F.when(i, zero).otherwise(a).alias("debit"), F.when(i, a).otherwise(zero).alias("credit"))
    return d.tagged(spark, sf).select("movement_id", F.explode(F.array(cash, other)).alias("x")).select("movement_id", "x.*")


@query(
    "trial_balance",
    d.with_tables(
        """SELECT CASE WHEN policy = 'exclude_and_review' THEN 'suspense' ELSE economic_class END AS account, sum(CASE WHEN direction = 'outflow' THEN amount ELSE 0 END)::DOUBLE AS debit,
  sum(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END)::DOUBLE AS credit FROM tagged GROUP BY 1""",
        "tagged",
    ),
)
def trial_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Debits and credits of the contra accounts."""
    lines = journal_entries(spark, sf).filter("line = 2")
    return lines.groupBy("account").agg(F.sum(F.col("debit").cast(d.MONEY)).cast("double").alias("debit"), F.sum(F.col("credit").cast(d.MONEY)).cast("double").alias("credit"))


@query(
    "journal_reversals",
    d.with_tables("SELECT movement_id, (date_trunc('month', date) + INTERVAL 1 MONTH)::DATE AS reversal_date, CASE WHEN direction = 'inflow' THEN 'outflow' ELSE 'inflow' END AS direction, amount::DOUBLE AS amount FROM tagged WHERE policy = 'exclude_and_review'", "tagged"),
)
def journal_reversals(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in suspense turned round on the first of the next month."""
    t = d.tagged(spark, sf).filter("policy = 'exclude_and_review'")
    return t.select("movement_id", F.trunc(F.add_months("date", 1), "month").alias("reversal_date"), F.when(F.col("direction") == "inflow", "outflow").otherwise("inflow").alias("direction"), F.col("amount").cast("double").alias("amount"))


@query(
    "general_ledger_page",
    d.with_tables(
        """SELECT movement_id, date, counterparty, amount::DOUBLE AS amount FROM movements WHERE account = 'ACCT1' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND (raw_description ILIKE '%sp cust%' OR counterparty ILIKE '%1%')
ORDER BY date DESC, movement_id LIMIT 50 OFFSET 50""",
        "movements",
    ),
)
def general_ledger_page(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional filters, case-insensitive search and one page of the order."""
    m = d.movements(spark, sf).filter((F.col("account") == "ACCT1") & F.col("date").between("1997-01-01", "1998-12-31") & (F.col("raw_description").ilike("%sp cust%") | F.col("counterparty").ilike("%1%")))
    return m.orderBy(F.desc("date"), "movement_id").offset(50).limit(50).select("movement_id", "date", "counterparty", F.col("amount").cast("double").alias("amount"))


@query(
    "ar_stats",
    d.with_tables(
        """SELECT count(*) AS events, count(*) FILTER (WHERE status = 'paid') AS paid, count(*) FILTER (WHERE status = 'partially_paid') AS partial, sum(outstanding) FILTER (WHERE status <> 'paid')::DOUBLE AS outstanding,
  sum(greatest(amount - outstanding, 0))::DOUBLE AS collected, count(*) FILTER (WHERE expected_date BETWEEN DATE '2001-11-01' AND DATE '2001-11-30') AS due_now, count(*) FILTER (WHERE expected_date > DATE '2001-11-30') AS due_later
FROM cash_events WHERE event_type = 'ar'""",
        "cash_events",
    ),
)
def ar_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered counts and sums over receivables."""
    s, e = F.col("status"), F.col("expected_date")
    return d.cash_events(spark, sf).filter("event_type = 'ar'").agg(
        F.count("*").alias("events"), F.count_if(s == "paid").alias("paid"), F.count_if(s == "partially_paid").alias("partial"), F.sum(F.when(s != "paid", F.col("outstanding"))).cast("double").alias("outstanding"),
        F.sum(F.greatest(F.col("amount") - F.col("outstanding"), F.lit(0))).cast("double").alias("collected"), F.count_if(e.between("2001-11-01", "2001-11-30")).alias("due_now"), F.count_if(e > "2001-11-30").alias("due_later"),
    )


@query(
    "confidence_histogram",
    d.with_tables(
        """SELECT CASE WHEN confidence >= 0.9 THEN '0.90+' WHEN confidence >= 0.75 THEN '0.75-0.90' WHEN confidence >= 0.6 THEN '0.60-0.75' ELSE '<0.60' END AS bucket, count(*) AS n, round(avg(confidence), 6) AS mean FROM movements GROUP BY 1 ORDER BY min(confidence)""",
        "movements",
    ),
)
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bucket = at_least(F.col("confidence"), [(0.9, "0.90+"), (0.75, "0.75-0.90"), (0.6, "0.60-0.75")], "<0.60")
    return d.movements(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("k")).orderBy("k").drop("k")


@query(
    "match_rate_trend",
    d.with_tables(
        "SELECT m.date AS day, count(*) AS n, round(avg(CASE WHEN abs(m.amount - e.amount) < 0.01 THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM movements m JOIN cash_events e USING (event_id) WHERE m.direction = 'inflow' GROUP BY 1", "movements", "cash_events"
    ),
)
def match_rate_trend(spark: SparkSession, sf: str) -> DataFrame:
    """The daily share of receipts that equal their invoice."""
    e = d.cash_events(spark, sf).select("event_id", F.col("amount").alias("billed"))
    m = d.movements(spark, sf).filter("direction = 'inflow'").select("event_id", "date", "amount").join(e, "event_id")
    return m.groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.abs(F.col("amount") - F.col("billed")) < 0.01, 1.0).otherwise(0.0)), 6).alias("match_rate"))


@query(
    "metrics_pivot",
    """SELECT user_id, avg(value) FILTER (WHERE event_type = 'purchase') AS purchase, avg(value) FILTER (WHERE event_type = 'error') AS error, avg(value) FILTER (WHERE event_type = 'signup') AS signup FROM events GROUP BY 1""",
)
def metrics_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Means by metric name, pivoted with its values named so that no extra pass finds them."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    return e.groupBy("user_id").pivot("event_type", ["purchase", "error", "signup"]).agg(F.avg("value"))


@query(
    "call_stats",
    """SELECT event_type, count(*) AS calls, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95) FILTER (WHERE value > 1), 6) AS p95, count(*) FILTER (WHERE value > 100) AS slow FROM events GROUP BY 1""",
)
def call_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered counts and an exact filtered percentile."""
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg(v), 4).alias("mean"), F.round(F.percentile(F.when(v > 1, v), 0.95), 6).alias("p95"), F.count_if(v > 100).alias("slow"))


@query(
    "business_state",
    d.with_tables(
        """SELECT coalesce(sum(amount) FILTER (WHERE direction = 'inflow'), 0)::DOUBLE AS cash_in, coalesce(sum(amount) FILTER (WHERE direction = 'outflow'), 0)::DOUBLE AS cash_out, count(DISTINCT CASE WHEN direction = 'inflow' THEN entity_id END) AS customers,
  count(DISTINCT CASE WHEN direction = 'outflow' THEN entity_id END) AS vendors, count(DISTINCT day(date)) AS active_days FROM movements WHERE date >= DATE '2001-01-01'""",
        "movements",
    ),
)
def business_state(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional sums and distinct counts."""
    i = F.col("direction") == "inflow"
    return d.movements(spark, sf).filter(F.col("date") >= "2001-01-01").agg(
        _sum(i).alias("cash_in"), _sum(~i).alias("cash_out"), F.countDistinct(F.when(i, F.col("entity_id"))).alias("customers"), F.countDistinct(F.when(~i, F.col("entity_id"))).alias("vendors"), F.countDistinct(F.dayofmonth("date")).alias("active_days")
    )


@query(
    "entity_profile_list",
    d.with_tables(
        """WITH m AS (SELECT entity_id, count(*) AS movements, sum(amount)::DOUBLE AS moved FROM movements GROUP BY 1), e AS (SELECT entity_id, count(*) AS events, sum(outstanding)::DOUBLE AS outstanding FROM cash_events GROUP BY 1)
SELECT x.entity_id, x.display_name, coalesce(m.movements, 0) AS movements, coalesce(m.moved, 0) AS moved, coalesce(e.events, 0) AS events, coalesce(e.outstanding, 0) AS outstanding FROM entities x LEFT JOIN m USING (entity_id) LEFT JOIN e USING (entity_id)""",
        "movements",
        "cash_events",
        "entities",
    ),
)
def entity_profile_list(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides aggregated before the joins, so that nothing is counted twice."""
    m = d.movements(spark, sf).groupBy("entity_id").agg(F.count("*").alias("movements"), F.sum("amount").cast("double").alias("moved"))
    e = d.cash_events(spark, sf).groupBy("entity_id").agg(F.count("*").alias("events"), F.sum("outstanding").cast("double").alias("outstanding"))
    x = d.entities(spark, sf).select("entity_id", "display_name").join(m, "entity_id", "left").join(e, "entity_id", "left")
    return x.fillna(0, ["movements", "events"]).fillna(0.0, ["moved", "outstanding"])


@query(
    "transaction_facets",
    d.with_tables("SELECT 'class' AS facet, economic_class AS value, count(*) AS n, sum(amount)::DOUBLE AS total FROM movements GROUP BY 2 UNION ALL SELECT 'account', account, count(*), sum(amount)::DOUBLE FROM movements GROUP BY 2", "movements"),
)
def transaction_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Both facets in one pass by grouping sets."""
    m = d.movements(spark, sf).select("economic_class", "account", "amount")
    g = m.groupingSets([["economic_class"], ["account"]], "economic_class", "account").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.grouping("economic_class").alias("g"))
    return g.select(F.when(F.col("g") == 0, "class").otherwise("account").alias("facet"), F.coalesce("economic_class", "account").alias("value"), "n", "total")


@query(
    "movement_with_observations",
    d.with_tables(
        """SELECT movement_id, list(source_id ORDER BY source_id) AS source_ids, count(*) AS n, CASE WHEN count(DISTINCT source) > 1 THEN 'coalesced' ELSE 'single' END AS provenance FROM observations GROUP BY 1""", "observations"
    ),
)
def movement_with_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Each movement with its nested evidence."""
    o = d.observations(spark, sf)
    return o.groupBy("movement_id").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"), F.count("*").alias("n"), F.when(F.countDistinct("source") > 1, "coalesced").otherwise("single").alias("provenance"))


@query(
    "distinct_sums",
    d.with_tables("SELECT entity_id, count(DISTINCT amount) AS amounts, sum(DISTINCT amount)::DOUBLE AS literal_sum, sum(amount)::DOUBLE AS full_sum FROM cash_events WHERE event_type = 'ar' GROUP BY 1", "cash_events"),
)
def distinct_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The literal sum over distinct amounts beside the full sum."""
    return d.cash_events(spark, sf).filter("event_type = 'ar'").groupBy("entity_id").agg(F.countDistinct("amount").alias("amounts"), F.sum_distinct("amount").cast("double").alias("literal_sum"), F.sum("amount").cast("double").alias("full_sum"))


@query(
    "latest_snapshots",
    d.with_tables("SELECT month, total FROM (SELECT date_trunc('month', date)::DATE AS month, sum(amount)::DOUBLE AS total FROM movements GROUP BY 1) ORDER BY month DESC LIMIT 6", "movements"),
)
def latest_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return d.movements(spark, sf).groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("amount").cast("double").alias("total")).orderBy(F.desc("month")).limit(6)


@query(
    "upsert_latest",
    d.with_tables("SELECT movement_id, source, source_id, date FROM (SELECT *, row_number() OVER (PARTITION BY movement_id ORDER BY date DESC, source_id DESC) AS rn FROM observations) WHERE rn = 1", "observations"),
)
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Merge by key: the last write of each key wins."""
    return first_per_key(d.observations(spark, sf), ["movement_id"], [F.desc("date"), F.desc("source_id")]).select("movement_id", "source", "source_id", "date")


@query(
    "delete_by_ids",
    d.with_tables("SELECT event_id, status FROM cash_events c WHERE NOT EXISTS (SELECT 1 FROM movements m WHERE m.event_id = c.event_id)", "cash_events", "movements"),
)
def delete_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    """What is left when a list of ids is deleted."""
    return d.cash_events(spark, sf).select("event_id", "status").join(d.movements(spark, sf).select("event_id"), "event_id", "left_anti")


@query(
    "open_ar_top",
    d.with_tables("SELECT entity_id, sum(outstanding)::DOUBLE AS outstanding, max(DATE '2001-11-30' - expected_date)::INTEGER AS days_overdue FROM cash_events WHERE event_type = 'ar' AND outstanding > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "cash_events"),
)
def open_ar_top(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest open customers, ordered by the number and not its text."""
    e = d.cash_events(spark, sf).filter("event_type = 'ar' and outstanding > 0")
    return e.groupBy("entity_id").agg(F.sum("outstanding").cast("double").alias("outstanding"), F.max(F.datediff(F.lit(d.AS_OF).cast("date"), "expected_date")).alias("days_overdue")).orderBy(F.desc("outstanding"), "entity_id").limit(5)


@query(
    "balance_walk_back",
    d.with_tables(
        """WITH n AS (SELECT account, date AS day, sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END)::DOUBLE AS net FROM movements WHERE date > DATE '2001-10-31' AND date <= DATE '2001-11-30' GROUP BY 1, 2)
SELECT account, day, round(100000 - sum(net) OVER (PARTITION BY account) + sum(net) OVER (PARTITION BY account ORDER BY day), 2) AS balance FROM n""",
        "movements",
    ),
)
def balance_walk_back(spark: SparkSession, sf: str) -> DataFrame:
    """Daily balances from the current one backwards; the window sees at most 30 rows for each account."""
    m = d.movements(spark, sf).filter((F.col("date") > "2001-10-31") & (F.col("date") <= "2001-11-30"))
    n = m.groupBy("account", F.col("date").alias("day")).agg(F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))).cast("double").alias("net"))
    w = Window.partitionBy("account")
    return n.select("account", "day", F.round(100000 - F.sum("net").over(w) + F.sum("net").over(w.orderBy("day")), 2).alias("balance"))


@query(
    "lookback_net",
    d.with_tables(
        """WITH n AS (SELECT account, date AS day, sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END)::DOUBLE AS net FROM movements GROUP BY 1, 2)
SELECT account, day, round(coalesce(sum(net) OVER (PARTITION BY account ORDER BY day RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 0), 2) AS net_3d FROM n""",
        "movements",
    ),
)
def lookback_net(spark: SparkSession, sf: str) -> DataFrame:
    """Net flow of the three days before each day, by a range frame."""
    n = d.movements(spark, sf).groupBy("account", F.col("date").alias("day")).agg(F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))).cast("double").alias("net"))
    w = Window.partitionBy("account").orderBy(F.unix_date("day").cast("long")).rangeBetween(-3, -1)
    return n.select("account", "day", F.round(F.coalesce(F.sum("net").over(w), F.lit(0.0)), 2).alias("net_3d"))
