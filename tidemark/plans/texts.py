"""Texts of movements: scrubbed, with references and processors, and their counterparties matched to known customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import cascade
from tidemark.registry import query
from tidemark.sources import domain as d

_RAW = """t AS (SELECT movement_id, key, direction, counterparty, amount, date, event_id, CASE key % 6 WHEN 0 THEN 'PreAuthorized ACH Credit ' || raw_description WHEN 1 THEN raw_description || ' Ref #A12 https://pay.example/x?y=1' WHEN 2 THEN 'Order # 77-A ' || raw_description
  WHEN 3 THEN raw_description || ' inv #' || key || ' check 12 PO 9' WHEN 4 THEN counterparty || ' (North Works) ' ELSE 'stripe payout ' || raw_description END AS raw,
  CASE key % 4 WHEN 0 THEN 'Ann@' || lower(replace(counterparty, '#', '')) || '.Example.com' WHEN 1 THEN 'https://www.' || lower(replace(counterparty, '#', '')) || '.example/path' WHEN 2 THEN lower(replace(counterparty, '#', '')) || '.example' END AS address FROM movements)"""


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Movements with texts as banks write them, and an address of the counterparty."""
    k, raw, name = F.col("key"), F.col("raw_description"), F.col("counterparty")
    plain = F.lower(F.regexp_replace(name, "#", ""))
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("PreAuthorized ACH Credit "), raw))
        .when(k % 6 == 1, F.concat(raw, F.lit(" Ref #A12 https://pay.example/x?y=1")))
        .when(k % 6 == 2, F.concat(F.lit("Order # 77-A "), raw))
        .when(k % 6 == 3, F.concat(raw, F.lit(" inv #"), k.cast("string"), F.lit(" check 12 PO 9")))
        .when(k % 6 == 4, F.concat(name, F.lit(" (North Works) ")))
        .otherwise(F.concat(F.lit("stripe payout "), raw))
    )
    address = F.when(k % 4 == 0, F.concat(F.lit("Ann@"), plain, F.lit(".Example.com"))).when(k % 4 == 1, F.concat(F.lit("https://www."), plain, F.lit(".example/path"))).when(k % 4 == 2, F.concat(plain, F.lit(".example")))
    return d.movements(spark, sf).select("movement_id", "key", "direction", "counterparty", "amount", "date", "event_id", text.alias("raw"), address.alias("address"))


def _scrub_sql(x: str) -> str:
    out = f"upper(trim({x}))"
    for p in texts.LINKS:
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    for p in texts.NOISE:
        out = f"replace({out}, '{p}', ' ')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_REFS = "list_concat(" + ", ".join(f"regexp_extract_all(raw, '{p}', 1)" for p in texts.REFERENCES[:2]) + ")"
_REFS = f"list_concat({_REFS}, regexp_extract_all(raw, '{texts.REFERENCES[2]}', 1))"
_GENERIC = " OR ".join(f"regexp_matches(trim(raw), '{p}')" for p in texts.GENERIC)
_NORM = r"regexp_replace(lower(regexp_replace({}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]', '', 'g')"


@query(
    "scrubbed_texts",
    d.with_tables(
        f"""WITH {_RAW}, x AS (SELECT *, {_NORM.format("raw")} AS a, {_NORM.format("counterparty")} AS b FROM t)
SELECT movement_id, {_scrub_sql("raw")} AS scrubbed, list_sort(list_distinct({_REFS})) AS refs, length(trim(raw)) >= 3 AND NOT ({_GENERIC}) AS has_name, trim(regexp_replace(raw, '{texts.QUALIFIER}', '')) AS core,
  CASE WHEN contains(lower(raw), 'stripe') THEN 'stripe' WHEN contains(lower(raw), 'square') THEN 'square' WHEN contains(lower(raw), 'ach') THEN 'ach' END AS processor,
  CASE key % 4 WHEN 0 THEN lower(replace(counterparty, '#', '')) || '.example.com' WHEN 3 THEN NULL ELSE lower(replace(counterparty, '#', '')) || '.example' END AS domain,
  round(CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) * 0.9 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6)::DOUBLE AS similarity FROM x""",
        "movements",
    ),
)
def scrubbed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What each movement's text says once noise is out of it."""
    raw = F.col("raw")
    return described(spark, sf).select(
        "movement_id", texts.scrubbed(raw).alias("scrubbed"), F.array_sort(texts.references(raw)).alias("refs"), texts.has_name(raw).alias("has_name"), texts.without_qualifier(raw).alias("core"), texts.processor(raw).alias("processor"), texts.domain(F.col("address")).alias("domain"),
        F.round(texts.case_similarity(raw, F.col("counterparty")), 6).alias("similarity"),
    )


# Fixed values of the case tests: cents that count as nothing, the largest fee and rounding, discounts with their days before the due date, days within which a reversal is one.
EPS, FEE, ROUNDING, DISCOUNT, EARLY, RECENT = 0.01, 0.05, 1.0, (0.01, 0.03), 10, 30


def fee_amount(paid: Column, due: Column) -> Column:
    """What a payment lacks, where a fee of at most a twentieth explains it; else null."""
    lack = due - paid
    return F.when((lack >= EPS) & (F.try_divide(lack, due) <= FEE), lack)


def paid_early(paid: Column, due: Column, days_late: Column) -> Column:
    """One to three percent short and up to ten days before the due date."""
    return F.coalesce(days_late.between(-EARLY, 0) & F.try_divide(due - paid, due).between(*DISCOUNT), F.lit(False))


def reversal(paid: Column, due: Column, direction: Column, kind: Column, days_late: Column) -> Column:
    """The same amount the other way within thirty days of the date, if there is one."""
    other = ((kind == "ar") & (direction == "outflow")) | ((kind == "ap") & (direction == "inflow"))
    return F.coalesce((F.abs(paid - due) < EPS) & other & (days_late.isNull() | (F.abs(days_late) <= RECENT)), F.lit(False))


@query(
    "case_tests",
    d.with_tables(
        f"""WITH p AS (SELECT m.movement_id, m.amount::DOUBLE AS paid, e.amount::DOUBLE AS due, m.date - e.expected_date AS late, CASE WHEN m.key % 5 = 0 THEN CASE m.direction WHEN 'inflow' THEN 'outflow' ELSE 'inflow' END ELSE m.direction END AS way, event_type AS kind FROM movements m JOIN cash_events e USING (event_id))
SELECT movement_id, CASE WHEN due - paid >= {EPS} AND (due - paid) / due <= {FEE} THEN round(due - paid, 2) END AS fee, late BETWEEN -{EARLY} AND 0 AND (due - paid) / due BETWEEN {DISCOUNT[0]} AND {DISCOUNT[1]} AS early,
  abs(paid - due) < {EPS} AND ((kind = 'ar' AND way = 'outflow') OR (kind = 'ap' AND way = 'inflow')) AND abs(late) <= {RECENT} AS reversal, abs(paid - due) >= {EPS} AND abs(paid - due) <= {ROUNDING} AS rounding FROM p""",
        "movements",
        "cash_events",
    ),
)
def case_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a fee, an early discount, a reversal or rounding explains how a movement differs from its event; every fifth goes the other way."""
    e = d.cash_events(spark, sf).select("event_id", F.col("amount").cast("double").alias("due"), "expected_date", F.col("event_type").alias("kind"))
    p = d.movements(spark, sf).join(e, "event_id")
    paid, due, late = F.col("amount").cast("double"), F.col("due"), F.datediff("date", "expected_date")
    way = F.when(F.col("key") % 5 == 0, F.when(F.col("direction") == "inflow", "outflow").otherwise("inflow")).otherwise(F.col("direction"))
    gap = F.abs(paid - due)
    return p.select(
        "movement_id", F.round(fee_amount(paid, due), 2).alias("fee"), paid_early(paid, due, late).alias("early"), reversal(paid, due, way, F.col("kind"), late).alias("reversal"), ((gap >= EPS) & (gap <= ROUNDING)).alias("rounding")
    )


_ALIAS = """(x = y OR (length(x) >= 3 AND length(y) >= 3 AND (contains(x, y) OR contains(y, x) OR left(x, ceil(least(length(x), length(y)) * 85 / 100)::INTEGER) = left(y, ceil(least(length(x), length(y)) * 85 / 100)::INTEGER))))"""


@query(
    "matched_customers",
    d.with_tables(
        f"""WITH a AS (SELECT DISTINCT counterparty AS name, {_NORM.format("counterparty")} AS x FROM descriptors WHERE counterparty IS NOT NULL),
k AS (SELECT DISTINCT display_name AS known_name, {_NORM.format("display_name")} AS y FROM entities WHERE entity_type = 'customer' AND seq % 3 <> 0),
e AS (SELECT name, min(known_name) AS known_name FROM a JOIN k ON x = y WHERE length(x) >= 2 GROUP BY 1),
l AS (SELECT name, min(known_name) AS known_name FROM a JOIN k ON {_ALIAS} WHERE length(x) >= 2 AND name NOT IN (SELECT name FROM e) GROUP BY 1)
SELECT name, known_name, 'exact' AS level FROM e UNION ALL SELECT name, known_name, 'alias' FROM l""",
        "descriptors",
        "entities",
    ),
)
def matched_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Counterparties as banks spell them, matched to two thirds of the customers. Names here have two words, so no two of them are similar without being aliases."""
    known = d.entities(spark, sf).filter("entity_type = 'customer' and seq % 3 <> 0").select(F.col("display_name").alias("name"))
    return cascade.matched(d.descriptors(spark, sf).select(F.col("counterparty").alias("name")).filter("name is not null"), known)
