"""The test tables as the domain's tables: the only module that knows both.

Every rule is a pure function of keys, stated once as DataFrame code and once as SQL
(:data:`SQL`), so that queries and their oracles start from the same rows. Money is
``DECIMAL(18,2)``, which sums exactly in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

#: The dates that stand for today: for orders and for events.
AS_OF, EVENTS_AS_OF = "2001-11-30", "2024-01-31"

MONEY = "decimal(18,2)"


def money(x: Column) -> Column:
    return F.round(x.cast("decimal(20,4)"), 2).cast(MONEY)


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """entity_id, entity_type, display_name, nation, region_key, seq of customers and vendors."""
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("entity_id"), F.lit("customer").alias("entity_type"), F.col("c_name").alias("display_name"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("seq"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.lit("vendor").alias("entity_type"), F.col("s_name").alias("display_name"), F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("seq"))
    return c.unionByName(s).join(nation, "n_nationkey").select("entity_id", "entity_type", "display_name", F.col("n_name").alias("nation"), F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").alias("region_key"), "seq")


def _descriptor(name: Column, key: Column) -> Column:
    """The bank's text for a counterparty, in four styles."""
    return (
        F.when(key % 4 == 0, name).when(key % 4 == 1, F.upper(name)).when(key % 4 == 2, F.regexp_replace(name, "#", "")).otherwise(F.concat(F.lit("SP "), F.upper(name), F.lit(" - WHOLESALE")))
    )


def cash_events(spark: SparkSession, sf: str) -> DataFrame:
    """Receivables (one for each order) and payables (one for each order and supplier)."""
    o = table(spark, sf, "orders")
    amount = money(F.col("o_totalprice"))
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "P", "partially_paid").otherwise("open")
    ar = o.select(
        F.concat(F.lit("AR"), "o_orderkey").alias("event_id"), F.lit("ar").alias("event_type"), F.concat(F.lit("C"), "o_custkey").alias("entity_id"), F.col("o_orderkey").alias("key"), amount.alias("amount"),
        F.to_date("o_orderdate").alias("issued"), F.date_add(F.to_date("o_orderdate"), 30).alias("expected_date"), status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.lit(0)).when(F.col("o_orderstatus") == "P", money(amount / 2)).otherwise(amount).cast(MONEY).alias("outstanding"),
    )
    line = F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))
    ap = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.sum(F.round(line, 2).cast(MONEY)).cast(MONEY).alias("amount"), F.max(F.to_date("l_shipdate")).alias("issued"))
        .select(
            F.concat(F.lit("AP"), "l_orderkey", F.lit("-"), "l_suppkey").alias("event_id"), F.lit("ap").alias("event_type"), F.concat(F.lit("S"), "l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("key"), "amount",
            "issued", F.date_add("issued", 30).alias("expected_date"), F.when(F.col("l_orderkey") % 3 != 0, "paid").otherwise("open").alias("status"), F.when(F.col("l_orderkey") % 3 != 0, F.lit(0)).otherwise(F.col("amount")).cast(MONEY).alias("outstanding"),
        )
    )
    return ar.unionByName(ap)


def movements(spark: SparkSession, sf: str, named: bool = True) -> DataFrame:
    """Cash movements: inflows that pay receivables in various ways, outflows that pay payables; not named: without the texts, which takes no join."""
    ev = cash_events(spark, sf)
    names = entities(spark, sf).select("entity_id", "display_name")
    k = F.col("key")
    paid = (
        F.when(k % 10 <= 4, F.col("amount")).when(k % 10 <= 6, F.col("amount") * F.lit("0.971").cast("decimal(4,3)")).when(k % 10 == 7, F.col("amount") * F.lit("0.980").cast("decimal(4,3)"))
        .when(k % 10 == 8, F.col("amount") * F.lit("0.500").cast("decimal(4,3)")).otherwise(F.col("amount") * F.lit("1.130").cast("decimal(4,3)"))
    )
    inflow = ev.filter("event_type = 'ar' and status <> 'open'").select(
        F.concat(F.lit("MI"), k).alias("movement_id"), F.lit("inflow").alias("direction"), "event_id", "entity_id", "key", F.round(paid, 2).cast(MONEY).alias("amount"),
        F.date_add("issued", (k % 50).cast("int")).alias("date"), F.when(k % 17 == 0, "refund").otherwise("customer_receipt").alias("economic_class"),
    )
    cls = F.when(k % 11 == 0, "payroll").when(k % 13 == 0, "tax").when(k % 19 == 0, "bank_fee").when(k % 23 == 0, "transfer").otherwise("vendor_payment")
    outflow = ev.filter("event_type = 'ap' and status = 'paid'").select(
        F.concat(F.lit("MO"), F.substring("event_id", 3, 99)).alias("movement_id"), F.lit("outflow").alias("direction"), "event_id", "entity_id", "key", "amount",
        F.date_add("expected_date", (k % 21 - 7).cast("int")).alias("date"), cls.alias("economic_class"),
    )
    confidence = F.round((40 + k % 60) / 100.0, 2)
    both = inflow.unionByName(outflow)
    texts = [F.col("display_name").alias("counterparty"), _descriptor(F.col("display_name"), k).alias("raw_description")] if named else []
    return (
        (both.join(names, "entity_id", "left") if named else both)
        .select(
            "movement_id", "direction", "event_id", "entity_id", "key", "amount", "date", "economic_class", *texts,
            F.element_at(F.array(*map(F.lit, ("plaid", "qbo", "xero", "stripe", "shopify"))), (k % 5 + 1).cast("int")).alias("provenance"), F.concat(F.lit("ACCT"), k % 4).alias("account"), confidence.alias("confidence"),
        )
    )


def attributions(spark: SparkSession, sf: str) -> DataFrame:
    """What each movement pays of its event: in order of date, movements take what is still open of the amount due, and never more than they hold.

    What an inflow lacks of a receivable, up to a tenth of it, is its fee and has a line of its own.
    """
    from pyspark.sql import Window

    due = cash_events(spark, sf).select("event_id", "event_type", F.col("amount").alias("due"))
    m = movements(spark, sf).select("movement_id", "event_id", "direction", "amount", "date").join(due, "event_id")
    before = F.coalesce(F.sum("amount").over(Window.partitionBy("event_id").orderBy("date", "movement_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("still", F.greatest(F.col("due") - before, F.lit(0)))
    lack = F.col("still") - F.col("amount")
    paid = m.select("movement_id", "event_id", F.col("event_type").alias("component_type"), F.least("amount", "still").cast(MONEY).alias("net_amount"))
    fee = m.filter((F.col("direction") == "inflow") & (lack > 0) & (lack <= F.col("due") * F.lit("0.1").cast("decimal(2,1)"))).select("movement_id", "event_id", F.lit("fee").alias("component_type"), lack.cast(MONEY).alias("net_amount"))
    return paid.unionByName(fee)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Each movement as one source saw it, and every sixth also as a second source did, a day later and a little less."""
    m = movements(spark, sf)
    first = m.select("movement_id", F.col("provenance").alias("source"), F.concat("movement_id", F.lit("-a")).alias("source_id"), "direction", "amount", "date", "counterparty", "raw_description", "entity_id")
    second = m.filter(F.col("key") % 6 == 0).select(
        "movement_id", F.when(F.col("provenance") == "plaid", "qbo").otherwise("plaid").alias("source"), F.concat("movement_id", F.lit("-b")).alias("source_id"), "direction",
        F.round(F.col("amount") * F.lit("0.999").cast("decimal(4,3)"), 2).cast(MONEY).alias("amount"), F.date_add("date", 1).alias("date"), "counterparty", "raw_description", "entity_id",
    )
    return first.unionByName(second)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """same_entity between entities of a nation with equal seq % 50, each with the next; related between those of a region with equal seq % 97, each with the next."""
    from pyspark.sql import Window

    e = entities(spark, sf)
    out = None
    for by, mod, name, conf in (("nation_key", 50, "same_entity", 0.9), ("region_key", 97, "related", 0.6)):
        w = Window.partitionBy(by, F.col("seq") % mod).orderBy("entity_id")
        some = e.select("entity_id", F.lead("entity_id").over(w).alias("to_id")).filter("to_id is not null").select(F.col("entity_id").alias("from_id"), "to_id", F.lit(name).alias("relationship"), F.lit(conf).alias("confidence"))
        out = some if out is None else out.unionByName(some)
    return out


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as cash flows: purchases are inflows, errors outflows, signups settlements."""
    kind = F.when(F.col("event_type") == "purchase", "inflow").when(F.col("event_type") == "error", "outflow").when(F.col("event_type") == "signup", "settlement")
    return table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("entity_id"), kind.alias("flow"), F.round("value", 2).alias("amount")).filter("flow is not null")


_NAMES = "SELECT entity_id, display_name FROM entities"

#: The same tables as DuckDB common table expressions.
SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "entities": (
        """SELECT e.entity_id, e.entity_type, e.display_name, n.n_name AS nation, n.n_nationkey AS nation_key, n.n_regionkey AS region_key, e.seq FROM (
  SELECT 'C' || c_custkey AS entity_id, 'customer' AS entity_type, c_name AS display_name, c_nationkey AS nk, c_custkey AS seq FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'vendor', s_name, s_nationkey, s_suppkey FROM supplier) e JOIN nation n ON n.n_nationkey = e.nk""",
        (),
    ),
    "cash_events": (
        """SELECT 'AR' || o_orderkey AS event_id, 'ar' AS event_type, 'C' || o_custkey AS entity_id, o_orderkey AS key, round(o_totalprice::DECIMAL(20,4), 2)::DECIMAL(18,2) AS amount,
  o_orderdate::DATE AS issued, o_orderdate::DATE + 30 AS expected_date, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'partially_paid' ELSE 'open' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN round(round(o_totalprice::DECIMAL(20,4), 2)::DECIMAL(18,2) * 0.5, 2) ELSE round(o_totalprice::DECIMAL(20,4), 2) END::DECIMAL(18,2) AS outstanding
FROM orders
UNION ALL
SELECT 'AP' || l_orderkey || '-' || l_suppkey, 'ap', 'S' || l_suppkey, l_orderkey, amount, issued, issued + 30, CASE WHEN l_orderkey % 3 <> 0 THEN 'paid' ELSE 'open' END,
  CASE WHEN l_orderkey % 3 <> 0 THEN 0 ELSE amount END::DECIMAL(18,2)
FROM (SELECT l_orderkey, l_suppkey, sum(round(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DECIMAL(18,2))::DECIMAL(18,2) AS amount, max(l_shipdate::DATE) AS issued
  FROM lineitem GROUP BY 1, 2)""",
        (),
    ),
    "movements": (
        """SELECT m.movement_id, m.direction, m.event_id, m.entity_id, m.key, m.amount, m.date, m.economic_class, n.display_name AS counterparty,
  CASE m.key % 4 WHEN 0 THEN n.display_name WHEN 1 THEN upper(n.display_name) WHEN 2 THEN replace(n.display_name, '#', '') ELSE 'SP ' || upper(n.display_name) || ' - WHOLESALE' END AS raw_description,
  ['plaid','qbo','xero','stripe','shopify'][m.key % 5 + 1] AS provenance, 'ACCT' || (m.key % 4) AS account, round((40 + m.key % 60) / 100.0, 2)::DOUBLE AS confidence
FROM (
  SELECT 'MI' || key AS movement_id, 'inflow' AS direction, event_id, entity_id, key,
    round(amount * (CASE WHEN key % 10 <= 4 THEN 1.000 WHEN key % 10 <= 6 THEN 0.971 WHEN key % 10 = 7 THEN 0.980 WHEN key % 10 = 8 THEN 0.500 ELSE 1.130 END)::DECIMAL(4,3), 2)::DECIMAL(18,2) AS amount,
    issued + (key % 50)::INTEGER AS date, CASE WHEN key % 17 = 0 THEN 'refund' ELSE 'customer_receipt' END AS economic_class
  FROM cash_events WHERE event_type = 'ar' AND status <> 'open'
  UNION ALL
  SELECT 'MO' || substr(event_id, 3), 'outflow', event_id, entity_id, key, amount, expected_date + (key % 21 - 7)::INTEGER,
    CASE WHEN key % 11 = 0 THEN 'payroll' WHEN key % 13 = 0 THEN 'tax' WHEN key % 19 = 0 THEN 'bank_fee' WHEN key % 23 = 0 THEN 'transfer' ELSE 'vendor_payment' END
  FROM cash_events WHERE event_type = 'ap' AND status = 'paid') m
LEFT JOIN entities n ON n.entity_id = m.entity_id""",
        ("entities", "cash_events"),
    ),
    "attribution_still": (
        """SELECT m.movement_id, m.event_id, m.direction, m.amount, e.event_type, e.amount AS due,
  greatest(e.amount - coalesce(sum(m.amount) OVER (PARTITION BY m.event_id ORDER BY m.date, m.movement_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS still
FROM movements m JOIN cash_events e USING (event_id)""",
        ("movements", "cash_events"),
    ),
    "attributions": (
        """SELECT movement_id, event_id, event_type AS component_type, least(amount, still)::DECIMAL(18,2) AS net_amount FROM attribution_still
UNION ALL SELECT movement_id, event_id, 'fee', (still - amount)::DECIMAL(18,2) FROM attribution_still WHERE direction = 'inflow' AND still > amount AND still - amount <= due * 0.1""",
        ("attribution_still",),
    ),
    "observations": (
        """SELECT movement_id, provenance AS source, movement_id || '-a' AS source_id, direction, amount, date, counterparty, raw_description, entity_id FROM movements
UNION ALL SELECT movement_id, CASE WHEN provenance = 'plaid' THEN 'qbo' ELSE 'plaid' END, movement_id || '-b', direction, round(amount * 0.999::DECIMAL(4,3), 2)::DECIMAL(18,2), date + 1, counterparty, raw_description, entity_id
FROM movements WHERE key % 6 = 0""",
        ("movements",),
    ),
    "edges": (
        """SELECT * FROM (SELECT entity_id AS from_id, lead(entity_id) OVER (PARTITION BY nation_key, seq % 50 ORDER BY entity_id) AS to_id, 'same_entity' AS relationship, 0.9::DOUBLE AS confidence FROM entities
UNION ALL SELECT entity_id, lead(entity_id) OVER (PARTITION BY region_key, seq % 97 ORDER BY entity_id), 'related', 0.6::DOUBLE FROM entities) WHERE to_id IS NOT NULL""",
        ("entities",),
    ),
    "flows": (
        """SELECT * FROM (SELECT event_id, ts, user_id AS entity_id, CASE event_type WHEN 'purchase' THEN 'inflow' WHEN 'error' THEN 'outflow' WHEN 'signup' THEN 'settlement' END AS flow, round(value, 2) AS amount FROM events)
WHERE flow IS NOT NULL""",
        (),
    ),
}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` after the definitions of the named tables and of what they need, each worked out once so that no plan multiplies them."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in SQL[name][1]:
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    rest = sql.strip()
    more = ", " + rest[5:] if rest[:5].upper() == "WITH " else "\n" + rest
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n][0]})" for n in order) + more


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Movements with their inclusion policy and the flags that state metrics need."""
    from tidemark.functions import rules

    k, cls = F.col("key"), F.col("economic_class")
    return movements(spark, sf).withColumns(
        {
            "policy": rules.state_policy(F.col("confidence"), k % 4 / 10, k % 29 == 0, cls),
            "is_recurring": k % 3 == 0,
            "payment_class": rules.payment_class(cls),
            "affects_liquidity": cls != "transfer",
            "is_operating": cls.isin("customer_receipt", "refund", "vendor_payment", "payroll", "tax", "bank_fee"),
        }
    )


SQL["tagged"] = (
    """SELECT *, CASE WHEN economic_class = 'unknown' OR key % 29 = 0 OR confidence < 0.55 THEN 'exclude_and_review'
    WHEN confidence >= 0.80 AND (key % 4) / 10 >= 0.15 THEN 'include' ELSE 'include_provisional' END AS policy, key % 3 = 0 AS is_recurring,
  CASE economic_class WHEN 'customer_receipt' THEN 'AR_COLLECTION' WHEN 'refund' THEN 'AR_COLLECTION' WHEN 'vendor_payment' THEN 'AP_PAYMENT' WHEN 'payroll' THEN 'AP_PAYMENT'
    WHEN 'tax' THEN 'AP_PAYMENT' WHEN 'transfer' THEN 'INTERNAL_TRANSFER' WHEN 'bank_fee' THEN 'FEES' ELSE 'OTHER' END AS payment_class,
  economic_class <> 'transfer' AS affects_liquidity, economic_class IN ('customer_receipt','refund','vendor_payment','payroll','tax','bank_fee') AS is_operating
FROM movements""",
    ("movements",),
)


def bank_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Movements as the bank saw them, with what one leg of an own transfer looks like: round amounts that repeat, and for every second outflow an inflow on another account up to two days on."""
    m = movements(spark, sf).filter("direction = 'outflow'").select("movement_id", "key", "account", "date", "amount")
    k = F.col("key")
    amount = ((F.floor(F.col("amount") / 250) + 1) * 250).cast(MONEY)
    own = k % 13 != 0
    out = m.select("movement_id", F.lit("outflow").alias("direction"), "account", "date", amount.alias("amount"), own.alias("own"))
    leg = F.concat(F.lit("ACCT"), ((k + k % 3) % 4).cast("string"))
    back = m.filter(k % 2 == 0).select(F.concat("movement_id", F.lit("-leg")).alias("movement_id"), F.lit("inflow").alias("direction"), leg.alias("account"), F.date_add("date", (k % 3).cast("int")).alias("date"), amount.alias("amount"), own.alias("own"))
    return out.unionByName(back)


SQL["bank_legs"] = (
    """SELECT movement_id, 'outflow' AS direction, account, date, ((floor(amount / 250) + 1) * 250)::DECIMAL(18,2) AS amount, key % 13 <> 0 AS own FROM movements WHERE direction = 'outflow'
UNION ALL SELECT movement_id || '-leg', 'inflow', 'ACCT' || ((key + key % 3) % 4), date + (key % 3)::INTEGER, ((floor(amount / 250) + 1) * 250)::DECIMAL(18,2), key % 13 <> 0
FROM movements WHERE direction = 'outflow' AND key % 2 = 0""",
    ("movements",),
)


def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What up to three sources say of each movement: equal amounts, a day or two apart, names that differ or lack, some with order ids, some of nothing, some twice."""
    m = movements(spark, sf)
    k = F.col("key")
    signed = F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount")).cast(MONEY)
    first = F.element_at(F.split("counterparty", "#"), 1)
    name = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.upper("counterparty")).when(k % 5 == 2, F.concat(F.col("counterparty"), F.lit(" Inv. Jan 2024"))).when(k % 5 == 3, F.concat(first, F.lit("zz"))).otherwise(F.col("counterparty"))
    order = F.when(k % 9 == 0, F.concat(F.lit("ord"), k.cast("string")))
    row = lambda there, source, days, counterparty, tag, amount=signed: F.when(there, F.struct(F.lit(source).alias("source"), F.concat("movement_id", F.lit(tag)).alias("source_id"), amount.alias("amount"), F.date_add("date", days).alias("date"), counterparty.alias("counterparty"), order.alias("order_id"), "account", "raw_description"))
    plain, day = F.col("counterparty"), F.lit(0)
    rows = F.array(
        row(F.lit(True), "plaid", day, plain, "-p"), row(k % 3 != 2, "qbo", (k % 3).cast("int"), name, "-q"), row(k % 4 == 1, "stripe", F.lit(-1), plain, "-s"), row(k % 50 == 0, "plaid", day, plain, "-p"), row(k % 40 == 0, "qbo", day, plain, "-z", F.lit(0).cast(MONEY))
    )
    return m.select(F.explode(F.array_compact(rows)).alias("row")).select("row.*")


_SIGNED = "CASE WHEN direction = 'inflow' THEN amount ELSE -amount END::DECIMAL(18,2)"
_ORDER = "CASE WHEN key % 9 = 0 THEN 'ord' || key END"

SQL["source_rows"] = (
    f"""SELECT 'plaid' AS source, movement_id || '-p' AS source_id, {_SIGNED} AS amount, date, counterparty, {_ORDER} AS order_id, account, raw_description FROM movements
UNION ALL SELECT 'qbo', movement_id || '-q', {_SIGNED}, date + (key % 3)::INTEGER, CASE key % 5 WHEN 0 THEN NULL WHEN 1 THEN upper(counterparty) WHEN 2 THEN counterparty || ' Inv. Jan 2024' WHEN 3 THEN split_part(counterparty, '#', 1) || 'zz' ELSE counterparty END,
  {_ORDER}, account, raw_description FROM movements WHERE key % 3 <> 2
UNION ALL SELECT 'stripe', movement_id || '-s', {_SIGNED}, date - 1, counterparty, {_ORDER}, account, raw_description FROM movements WHERE key % 4 = 1
UNION ALL SELECT 'plaid', movement_id || '-p', {_SIGNED}, date, counterparty, {_ORDER}, account, raw_description FROM movements WHERE key % 50 = 0
UNION ALL SELECT 'qbo', movement_id || '-z', 0::DECIMAL(18,2), date, counterparty, {_ORDER}, account, raw_description FROM movements WHERE key % 40 = 0""",
    ("movements",),
)


def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """movement_id and two texts of each movement: a counterparty as banks spell it (cut, longer, another number, with something before it, or none), and the raw text."""
    k, name = F.col("key") % 7, F.col("counterparty")
    spelt = (
        F.when(k == 1, F.expr("left(counterparty, length(counterparty) - 2)"))
        .when(k == 2, F.concat(name, F.lit(" LLC")))
        .when(k == 3, F.concat(F.lit("zz"), name))
        .when(k == 4, F.upper(name))
        .when(k == 5, F.concat(F.expr("left(counterparty, length(counterparty) - 1)"), F.lit("x9")))
        .when(k == 6, F.concat(F.lit("Payment to "), name))
    )
    return movements(spark, sf).select("movement_id", spelt.alias("counterparty"), "raw_description")


SQL["descriptors"] = (
    """SELECT movement_id, CASE key % 7 WHEN 1 THEN left(counterparty, length(counterparty) - 2) WHEN 2 THEN counterparty || ' LLC' WHEN 3 THEN 'zz' || counterparty WHEN 4 THEN upper(counterparty)
  WHEN 5 THEN left(counterparty, length(counterparty) - 1) || 'x9' WHEN 6 THEN 'Payment to ' || counterparty END AS counterparty, raw_description FROM movements""",
    ("movements",),
)
