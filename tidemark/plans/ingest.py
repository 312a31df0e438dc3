"""Sources, set operations and rule classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names, rules
from tidemark.operators.joins import first_per_key
from tidemark.registry import query
from tidemark.sources import domain as d
from tidemark.sources import records


@query(
    "ledger_observations",
    """SELECT 'qbo' AS source, ['Invoice','Payment','Bill','Purchase'][o_orderkey % 4 + 1] AS source_type, o_orderkey::VARCHAR AS source_id, o_orderdate::DATE AS date,
  (CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE -1 END * round(o_totalprice, 2))::DOUBLE AS amount, CASE WHEN o_orderkey % 5 > 0 THEN 'Customer ' ELSE 'Party ' END || o_custkey AS counterparty FROM orders""",
)
def ledger_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger JSON to signed observations."""
    return records.ledger_observations(records.ledger_records(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query(
    "processor_observations",
    "SELECT 'stripe' AS source, 'payment_intent' AS source_type, 'ch_' || event_id AS source_id, ts::DATE AS date, round(value, 2)::DOUBLE AS amount, 'cus_' || user_id AS counterparty FROM events WHERE event_type = 'purchase'",
)
def processor_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Processor JSON: cents to units, epochs to dates, succeeded intents alone."""
    return records.processor_observations(records.processor_records(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query(
    "storefront_movements",
    """SELECT 'o' || o_orderkey AS source_id, 'inflow' AS direction, o_orderdate::DATE AS date, round(o_totalprice::DECIMAL(20,4), 2)::DECIMAL(18,2)::DOUBLE AS amount FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'r' || o_orderkey, 'outflow', o_orderdate::DATE, round((o_totalprice / 4)::DECIMAL(20,4), 2)::DECIMAL(18,2)::DOUBLE FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0""",
)
def storefront_movements(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and their nested refunds as movements."""
    return records.storefront_movements(records.storefront_records(spark, sf))


@query(
    "unified_observations",
    """SELECT source, count(*) AS n, sum(amount)::DOUBLE AS total FROM (SELECT 'qbo' AS source, (CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE -1 END * round(o_totalprice::DECIMAL(20,4), 2))::DECIMAL(18,2) AS amount FROM orders
UNION ALL SELECT 'stripe', round(value::DECIMAL(20,4), 2)::DECIMAL(18,2) FROM events WHERE event_type = 'purchase') GROUP BY 1""",
)
def unified_observations(spark: SparkSession, sf: str) -> DataFrame:
    """All sources in one shape, by name."""
    a = records.ledger_observations(records.ledger_records(spark, sf))
    b = records.processor_observations(records.processor_records(spark, sf))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(
    "invoice_dedup",
    d.with_tables(
        """SELECT source_id, source FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, floor(amount), direction ORDER BY CASE source WHEN 'qbo' THEN 1 WHEN 'xero' THEN 2 WHEN 'stripe' THEN 3 WHEN 'shopify' THEN 4 ELSE 5 END, source_id) AS rn FROM observations) WHERE rn = 1""",
        "observations",
    ),
)
def invoice_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One observation for each entity and whole amount, by the sources' order."""
    order = rules.lookup(F.col("source"), {"qbo": 1, "xero": 2, "stripe": 3, "shopify": 4}, 5)
    o = d.observations(spark, sf).withColumn("whole", F.floor("amount"))
    return first_per_key(o, ["entity_id", "whole", "direction"], [order, F.col("source_id")]).select("source_id", "source")


@query("source_agreement", d.with_tables("SELECT movement_id, len(list_distinct(list(source)))::INTEGER AS sources, CASE WHEN count(DISTINCT source) >= 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS agreement FROM observations GROUP BY 1", "observations"))
def source_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How many sources saw a movement."""
    s = F.size(F.collect_set("source"))
    return d.observations(spark, sf).groupBy("movement_id").agg(s.alias("sources"), F.when(s >= 2, 1.0).otherwise(0.5).alias("agreement"))


@query(
    "open_invoices",
    d.with_tables(
        """SELECT event_id, outstanding::DOUBLE AS outstanding, (DATE '2001-11-30' - expected_date)::INTEGER AS days_overdue, CASE WHEN expected_date < DATE '2001-11-30' THEN 'overdue' ELSE status END AS display_status FROM cash_events WHERE event_type = 'ar' AND outstanding > 0""",
        "cash_events",
    ),
)
def open_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Receivables with a balance, days overdue and the status to show as of a given day."""
    today = F.lit(d.AS_OF).cast("date")
    e = d.cash_events(spark, sf).filter("event_type = 'ar' and outstanding > 0")
    return e.select("event_id", F.col("outstanding").cast("double").alias("outstanding"), F.datediff(today, "expected_date").alias("days_overdue"), F.when(F.col("expected_date") < today, "overdue").otherwise(F.col("status")).alias("display_status"))


@query(
    "open_bills",
    d.with_tables("SELECT event_id, entity_id, outstanding::DOUBLE AS outstanding, (expected_date - DATE '2001-11-30')::INTEGER AS days_until_due FROM cash_events WHERE event_type = 'ap' AND outstanding > 0.01", "cash_events"),
)
def open_bills(spark: SparkSession, sf: str) -> DataFrame:
    """Payables with a balance."""
    e = d.cash_events(spark, sf).filter("event_type = 'ap' and outstanding > 0.01")
    return e.select("event_id", "entity_id", F.col("outstanding").cast("double").alias("outstanding"), F.datediff("expected_date", F.lit(d.AS_OF).cast("date")).alias("days_until_due"))


@query(
    "invoice_reconciliation",
    d.with_tables(
        """WITH p AS (SELECT event_id, sum(amount) AS paid FROM movements GROUP BY 1) SELECT e.event_id, coalesce(p.paid, 0)::DOUBLE AS matched, CASE WHEN p.paid IS NULL THEN 'unmatched' WHEN p.paid >= e.amount - 0.01 THEN 'matched' ELSE 'partial' END AS state
FROM cash_events e LEFT JOIN p USING (event_id)""",
        "cash_events",
        "movements",
    ),
)
def invoice_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Events with what was matched to them, summed first."""
    p = d.movements(spark, sf).groupBy("event_id").agg(F.sum("amount").alias("paid"))
    state = F.when(F.col("paid").isNull(), "unmatched").when(F.col("paid") >= F.col("amount") - F.lit("0.01").cast("decimal(3,2)"), "matched").otherwise("partial")
    return d.cash_events(spark, sf).select("event_id", "amount").join(p, "event_id", "left").select("event_id", F.coalesce(F.col("paid"), F.lit(0)).cast("double").alias("matched"), state.alias("state"))


@query("state_policies", d.with_tables("SELECT movement_id, policy, payment_class, payment_class IN ('AR_COLLECTION','AP_PAYMENT','FEES') AS operating FROM tagged", "tagged"))
def state_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Inclusion policy, payment class and the operating test of each movement."""
    return d.tagged(spark, sf).select("movement_id", "policy", "payment_class", F.col("payment_class").isin("AR_COLLECTION", "AP_PAYMENT", "FEES").alias("operating"))


@query(
    "rule_classification",
    d.with_tables(
        """SELECT movement_id, CASE WHEN raw_description ILIKE '%wholesale%' AND direction = 'inflow' THEN 'wholesale_revenue' WHEN provenance IN ('stripe','shopify') AND direction = 'inflow' THEN 'processor_revenue' WHEN amount <= 1.00 THEN 'account_verification'
  WHEN direction = 'outflow' AND amount < 50 THEN 'fee' WHEN direction = 'outflow' AND regexp_matches(lower(raw_description), 'supplier') THEN 'vendor' WHEN direction = 'inflow' THEN 'unknown_inflow' ELSE 'unknown_outflow' END AS rule FROM movements""",
        "movements",
    ),
)
def rule_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered rules; the first that holds decides."""
    i, text = F.col("direction") == "inflow", F.col("raw_description")
    rule = (
        F.when(text.ilike("%wholesale%") & i, "wholesale_revenue").when(F.col("provenance").isin("stripe", "shopify") & i, "processor_revenue").when(F.col("amount") <= 1, "account_verification")
        .when(~i & (F.col("amount") < 50), "fee").when(~i & F.lower(text).rlike("supplier"), "vendor").when(i, "unknown_inflow").otherwise("unknown_outflow")
    )
    return d.movements(spark, sf).select("movement_id", rule.alias("rule"))


@query(
    "text_keys",
    d.with_tables(
        """SELECT movement_id, regexp_replace(lower(regexp_replace(raw_description, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]', '', 'g') AS match_key, trim(regexp_replace(regexp_replace(lower(raw_description), '^sp | - wholesale$', '', 'g'), '[^a-z ]', '', 'g')) AS vendor_name,
  direction || '|' || account || '|' || substr(regexp_replace(upper(raw_description), '[0-9]{4,}', 'NNNNN', 'g'), 1, 40) AS family_key FROM movements""",
        "movements",
    ),
)
def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised keys of descriptors."""
    t = F.col("raw_description")
    return d.movements(spark, sf).select("movement_id", names.match_key(t).alias("match_key"), names.vendor_name(t).alias("vendor_name"), names.family_key(F.col("direction"), F.col("account"), t).alias("family_key"))


@query(
    "entity_uris",
    d.with_tables("SELECT event_id, event_type || '://' || entity_id || '/' || event_id || '?date=' || strftime(expected_date, '%Y-%m-%d') AS uri, event_type AS scheme, entity_id AS host FROM cash_events", "cash_events"),
)
def entity_uris(spark: SparkSession, sf: str) -> DataFrame:
    """URIs built and parsed back."""
    uri = F.concat("event_type", F.lit("://"), "entity_id", F.lit("/"), "event_id", F.lit("?date="), F.date_format("expected_date", "yyyy-MM-dd"))
    e = d.cash_events(spark, sf).select("event_id", uri.alias("uri"))
    return e.select("event_id", "uri", F.regexp_extract("uri", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("uri", "^[a-z]+://([^/]+)/", 1).alias("host"))


@query(
    "evidence_confidence",
    d.with_tables("SELECT entity_id, round(1 - product(1 - confidence), 3)::DOUBLE AS noisy_or FROM (SELECT from_id AS entity_id, confidence FROM edges UNION ALL SELECT to_id, confidence FROM edges) GROUP BY 1", "edges"),
)
def evidence_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Independent evidence combined: one less the product of doubts."""
    e = d.edges(spark, sf)
    both = e.select(F.col("from_id").alias("entity_id"), "confidence").union(e.select("to_id", "confidence"))
    return both.groupBy("entity_id").agg(F.round(1 - F.product(1 - F.col("confidence")), 3).alias("noisy_or"))


@query(
    "recommendations",
    d.with_tables(
        """WITH a AS (SELECT entity_id, sum(outstanding) AS o, count(*) AS n, sum(CASE WHEN expected_date < DATE '2001-11-30' THEN outstanding ELSE 0 END) AS late FROM cash_events WHERE event_type = 'ar' GROUP BY 1)
SELECT entity_id, unnest(list_filter([CASE WHEN late > 0 THEN 'chase' END, CASE WHEN o > 200000 THEN 'limit_credit' END, CASE WHEN n >= 10 AND late = 0 THEN 'reward' END], lambda x: x IS NOT NULL)) AS action FROM a""",
        "cash_events",
    ),
)
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """None to several rows for each entity, by exploding the rules that hold."""
    late = F.sum(F.when(F.col("expected_date") < d.AS_OF, F.col("outstanding")).otherwise(0)).alias("late")
    a = d.cash_events(spark, sf).filter("event_type = 'ar'").groupBy("entity_id").agg(F.sum("outstanding").alias("o"), F.count("*").alias("n"), late)
    rows = F.array_compact(F.array(F.when(F.col("late") > 0, "chase"), F.when(F.col("o") > 200000, "limit_credit"), F.when((F.col("n") >= 10) & (F.col("late") == 0), "reward")))
    return a.select("entity_id", F.explode(rows).alias("action"))
