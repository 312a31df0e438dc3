"""Semi-structured source records and their canonical observations.

The test tables hold no JSON records, so the fixture writes them from orders and events;
the extractors know only the JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

#: Ledger entity types that bring money in; others take it out.
INFLOW_TYPES = ("Invoice", "Payment", "SalesReceipt", "Deposit", "CreditCardCredit")


def ledger_records(spark: SparkSession, sf: str) -> DataFrame:
    """entity_type, entity_id and data (JSON) of a ledger, one for each order."""
    o = table(spark, sf, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("Invoice", "Payment", "Bill", "Purchase"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    data = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("Id"), F.round("o_totalprice", 2).cast("string").alias("TotalAmt"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("TxnDate"),
            F.when(F.col("o_orderkey") % 5 > 0, F.struct(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"))).alias("CustomerRef"),
            F.struct(F.concat(F.lit("Party "), F.col("o_custkey").cast("string")).alias("name")).alias("EntityRef"),
        )
    )
    return o.select(kind.alias("entity_type"), F.col("o_orderkey").cast("string").alias("entity_id"), data.alias("data"))


def ledger_observations(records: DataFrame) -> DataFrame:
    """Signed amounts, dates and counterparties of ledger records."""
    at = lambda path: F.get_json_object("data", path)
    amount = at("$.TotalAmt").cast("decimal(18,2)")
    signed = F.when(F.col("entity_type").isin(*INFLOW_TYPES), amount).otherwise(-amount)
    who = F.coalesce(at("$.CustomerRef.name"), at("$.VendorRef.name"), at("$.EntityRef.name"))
    return records.select(F.lit("qbo").alias("source"), F.col("entity_type").alias("source_type"), at("$.Id").alias("source_id"), at("$.TxnDate").cast("date").alias("date"), signed.alias("amount"), who.alias("counterparty"))


def processor_records(spark: SparkSession, sf: str) -> DataFrame:
    """A payment processor's JSON: cents and epoch seconds, one for each purchase or signup event."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "signup"))
    cents = F.round(F.col("value") * 100).cast("long")
    data = F.to_json(F.struct(F.concat(F.lit("ch_"), "event_id").alias("id"), cents.alias("amount"), F.unix_timestamp("ts").alias("created"), F.concat(F.lit("cus_"), "user_id").alias("customer"), F.when(F.col("event_type") == "purchase", "succeeded").otherwise("failed").alias("status")))
    return e.select(F.lit("payment_intent").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"), data.alias("data"))


PROCESSOR_SCHEMA = "id string, amount long, created long, customer string, status string"


def processor_observations(records: DataFrame) -> DataFrame:
    """Succeeded intents in units and dates."""
    x = records.withColumn("x", F.from_json("data", PROCESSOR_SCHEMA)).filter("x.status = 'succeeded'")
    return x.select(
        F.lit("stripe").alias("source"), F.col("entity_type").alias("source_type"), F.col("x.id").alias("source_id"), F.to_date(F.timestamp_seconds("x.created")).alias("date"), (F.col("x.amount") / 100).cast("decimal(18,2)").alias("amount"), F.col("x.customer").alias("counterparty")
    )


def _money(x: Column) -> Column:
    return F.round(x.cast("decimal(20,4)"), 2).cast("decimal(18,2)").cast("string")


def storefront_records(spark: SparkSession, sf: str) -> DataFrame:
    """Storefront orders with nested refunds, one for each order with status F."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    refunds = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.struct(F.concat(F.lit("r"), "o_orderkey").alias("id"), _money(F.col("o_totalprice") / 4).alias("amount")))).otherwise(F.array())
    data = F.to_json(F.struct(F.col("o_orderkey").alias("id"), _money(F.col("o_totalprice")).alias("total_price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), refunds.alias("refunds")))
    return o.select(F.col("o_orderkey").cast("string").alias("entity_id"), data.alias("data"))


#: Amounts are decimals written as text, as storefronts send them.
STOREFRONT_SCHEMA = "id long, total_price string, created_at date, refunds array<struct<id:string,amount:string>>"


def storefront_movements(records: DataFrame) -> DataFrame:
    """An inflow for each order and an outflow for each refund."""
    x = records.select(F.from_json("data", STOREFRONT_SCHEMA).alias("x")).select("x.*")
    paid = x.select(F.concat(F.lit("o"), "id").alias("source_id"), F.lit("inflow").alias("direction"), F.col("created_at").alias("date"), F.col("total_price").cast("decimal(18,2)").cast("double").alias("amount"))
    back = x.select("created_at", F.explode("refunds").alias("r")).select(F.col("r.id").alias("source_id"), F.lit("outflow").alias("direction"), F.col("created_at").alias("date"), F.col("r.amount").cast("decimal(18,2)").cast("double").alias("amount"))
    return paid.unionByName(back)


def has_key(data: Column, key: str) -> Column:
    """Whether a JSON object has a key."""
    return F.get_json_object(data, f"$.{key}").isNotNull()
