"""From what sources say to canonical movements: clusters around seeds, and legs paired one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import names
from tidemark.operators import coalescing, pairing
from tidemark.registry import query
from tidemark.sources import domain as d

_PAIRS = """WITH RECURSIVE items AS (SELECT *, row_number() OVER (PARTITION BY amount ORDER BY date, account, direction, movement_id) AS o FROM bank_legs WHERE own),
edges AS (SELECT x.amount, x.o AS a, y.o AS b, row_number() OVER (PARTITION BY x.amount ORDER BY x.o, y.o) AS k
  FROM items x JOIN items y ON x.amount = y.amount AND x.o < y.o AND x.direction <> y.direction AND x.account <> y.account AND y.date - x.date <= 1),
scan AS (
  SELECT DISTINCT amount, 0::BIGINT AS k, []::BIGINT[] AS used FROM edges
  UNION ALL SELECT s.amount, e.k, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE used || [a, b] END FROM scan s JOIN edges e ON e.amount = s.amount AND e.k = s.k + 1),
done AS (SELECT amount, arg_max(used, k) AS used FROM scan GROUP BY amount),
pairs AS (SELECT amount, used[2 * i - 1] AS a, used[2 * i] AS b FROM done, unnest(range(1, len(used) // 2 + 1)) AS r(i)),
sides AS (SELECT p.amount, a, b, o.movement_id AS outflow_id, i.movement_id AS inflow_id, o.account AS from_account, i.account AS to_account
  FROM pairs p JOIN items o ON o.amount = p.amount AND o.direction = 'outflow' AND o.o IN (p.a, p.b) JOIN items i ON i.amount = p.amount AND i.direction = 'inflow' AND i.o IN (p.a, p.b))"""


def _recursive(sql: str, *tables: str) -> str:
    """As :func:`domain.with_tables`, for SQL that recurses."""
    return d.with_tables(sql.replace("WITH RECURSIVE", "WITH", 1), *tables).replace("WITH", "WITH RECURSIVE", 1)


@query("transfer_pairing", _recursive(f"{_PAIRS} SELECT amount::DOUBLE AS amount, outflow_id, inflow_id, from_account, to_account FROM sides", "bank_legs"))
def transfer_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Legs of transfers between own accounts, of equal amounts and a day apart at the most, each in one pair at most."""
    return pairing.pair_once(d.bank_legs(spark, sf).filter("own")).selectExpr("cast(amount as double) amount", "outflow_id", "inflow_id", "from_account", "to_account")


@query(
    "paired_movements",
    _recursive(
        f"""{_PAIRS} SELECT l.movement_id, l.direction, l.account, s.to_account AS linked_account, CASE WHEN s.inflow_id IS NULL THEN [l.movement_id] ELSE [l.movement_id, s.inflow_id] END AS evidence
FROM bank_legs l LEFT JOIN sides s ON s.outflow_id = l.movement_id WHERE l.movement_id NOT IN (SELECT inflow_id FROM sides)""",
        "bank_legs",
    ),
)
def paired_movements(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of the bank's legs: an outflow that found its inflow carries the other account and both ids, and the inflow goes."""
    legs = d.bank_legs(spark, sf)
    pairs = pairing.pair_once(legs.filter("own")).select("outflow_id", "inflow_id", "to_account")
    kept = legs.join(pairs.selectExpr("inflow_id movement_id"), "movement_id", "left_anti").join(pairs.withColumnRenamed("outflow_id", "movement_id"), "movement_id", "left")
    return kept.selectExpr("movement_id", "direction", "account", "to_account linked_account", "array_compact(array(movement_id, inflow_id)) evidence")


_VENDOR = "counterparty"
for _pattern in names.BOILERPLATE:
    _VENDOR = f"regexp_replace({_VENDOR}, '{_pattern}', '', 'g')"

_CLUSTERS = f"""WITH RECURSIVE rows AS (SELECT DISTINCT source, source_id, amount, date, counterparty, order_id, account, raw_description FROM source_rows WHERE abs(amount) >= 0.01),
items AS (SELECT *, regexp_replace(lower({_VENDOR}), '[^a-z0-9]', '', 'g') AS vendor, CASE source WHEN 'plaid' THEN 4 WHEN 'stripe' THEN 3 WHEN 'qbo' THEN 2 ELSE 1 END AS p,
  row_number() OVER (PARTITION BY amount ORDER BY p DESC, date, source_id) AS o FROM rows),
near AS (SELECT x.amount, x.o AS a, y.o AS b, x.source = y.source AS alike, coalesce(x.order_id = y.order_id, false) AS ordered, x.order_id IS NOT NULL OR y.order_id IS NOT NULL AS any_order,
    CASE WHEN x.vendor IS NULL OR y.vendor IS NULL THEN 0.5 WHEN x.vendor = y.vendor THEN 1.0 WHEN length(x.vendor) < 3 OR length(y.vendor) < 3 THEN 0.0
      WHEN starts_with(x.vendor, y.vendor) OR starts_with(y.vendor, x.vendor) OR ends_with(x.vendor, y.vendor) OR ends_with(y.vendor, x.vendor)
      THEN least(length(x.vendor), length(y.vendor))::DOUBLE / greatest(length(x.vendor), length(y.vendor)) ELSE 0.0 END >= 0.4 AS close
  FROM items x JOIN items y ON x.amount = y.amount AND x.o < y.o AND abs(x.date - y.date) <= 1),
edges AS (SELECT amount, a, b, row_number() OVER (PARTITION BY amount ORDER BY a, b) AS k FROM near WHERE CASE WHEN alike THEN ordered OR close ELSE ordered OR close OR any_order END),
scan AS (
  SELECT DISTINCT amount, 0::BIGINT AS k, []::BIGINT[] AS taken, []::BIGINT[] AS seeds FROM edges
  UNION ALL SELECT s.amount, e.k, CASE WHEN list_contains(taken, a) OR list_contains(taken, b) THEN taken ELSE taken || [b] END, CASE WHEN list_contains(taken, a) OR list_contains(taken, b) THEN seeds ELSE seeds || [a] END
  FROM scan s JOIN edges e ON e.amount = s.amount AND e.k = s.k + 1),
done AS (SELECT amount, arg_max(taken, k) AS taken, arg_max(seeds, k) AS seeds FROM scan GROUP BY amount),
placed AS (SELECT i.*, coalesce(d.seeds[list_position(d.taken, i.o)], i.o) AS seed FROM items i LEFT JOIN done d USING (amount)),
members AS (SELECT p.*, s.source || ':' || s.source_id AS cluster FROM placed p JOIN items s ON s.amount = p.amount AND s.o = p.seed)"""


@query("canonical_evidence", _recursive(f"{_CLUSTERS} SELECT source, source_id, cluster FROM members", "source_rows"))
def canonical_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every observation with the seed of its cluster."""
    return coalescing.coalesced(d.source_rows(spark, sf).drop("account", "raw_description")).select("source", "source_id", "cluster")


@query(
    "canonical_movements",
    _recursive(
        f"""{_CLUSTERS} SELECT cluster, CASE WHEN arg_min(amount, o) >= 0 THEN 'inflow' ELSE 'outflow' END AS direction, abs(arg_min(amount, o))::DOUBLE AS amount, arg_min(date, o) AS date, arg_min(raw_description, o) AS raw_description,
  arg_min(counterparty, o) FILTER (WHERE counterparty IS NOT NULL) AS counterparty, coalesce(arg_min(account, o) FILTER (WHERE source = 'plaid'), arg_min(account, o)) AS account, count(*) AS n, list_sort(list(DISTINCT source)) AS sources,
  CASE WHEN count(*) > 1 THEN 'coalesced' WHEN bool_or(source = 'plaid') THEN 'bank_observed' ELSE 'accounting_observed' END AS provenance,
  CASE WHEN count(DISTINCT source) <= 1 THEN -1.0 WHEN bool_or(source = 'plaid') THEN 1.0 ELSE 0.7 END::DOUBLE AS agreement FROM members GROUP BY cluster""",
        "source_rows",
    ),
)
def canonical_movements(spark: SparkSession, sf: str) -> DataFrame:
    """One movement a cluster, with merged evidence and its provenance."""
    lists, hot = coalescing.parts(d.source_rows(spark, sf))
    found = coalescing.canonical_lists(lists).unionByName(coalescing.canonical(hot))
    return found.withColumns({"amount": found["amount"].cast("double")})
