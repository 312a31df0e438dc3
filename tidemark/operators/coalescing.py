"""Clusters of observations around a seed: what several sources say of one movement.

Observations of one signed amount stand in the order of their source's priority, date and id. The first free one is a seed and takes every free one behind it
that is at most ``DAYS`` from the seed and agrees with it by order id or name. Members are compared with the seed alone, so nothing drifts along a chain.

Dates of one amount that are further apart than ``DAYS`` never meet; they are parted into stretches first. The rows of a stretch stand in one list, so that the rows are dealt
by amount once. Observations that agree in source, amount, date, name and order id always go together; amounts of more than ``HOT`` rows are scanned by such kinds,
not by rows, and each row meets its kind again. What one task holds is a list of ``HOT`` rows, or the kinds of one amount within one stretch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names

#: How far apart in days, how like two names must be, which source speaks first and which is the bank.
DAYS, LIKE = 1, 0.4
PRIORITY = {"plaid": 4, "stripe": 3, "qbo": 2, "xero": 1}
BANK = "plaid"
#: Rows of one amount that are held at once.
HOT = 20_000

_KIND = ["amount", "source", "date", "vendor", "order_id"]


def priority(source: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[source], F.lit(0))


def like(a: str | None, b: str | None) -> float:
    """How like two name keys are: 0.5 where one lacks, else the share of the longer that the shorter covers at either end."""
    if a is None or b is None:
        return 0.5
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    return len(short) / len(long) if len(short) >= 3 and (long.startswith(short) or long.endswith(short)) else 0.0


def joins(seed: tuple, other: tuple) -> bool:
    """Whether a seed takes another observation, dates aside; both: day, source, vendor and order id."""
    (_, source, vendor, order), (_, of, name, its) = seed, other
    if order is not None or its is not None:
        if order == its or source != of:
            return True
    return vendor == name or like(vendor, name) >= LIKE


def _seeds(kinds: list[tuple]) -> list[int]:
    """The place of each kind's seed; kinds: day, source, vendor and order id, in order."""
    free = defaultdict(list)
    for i, k in enumerate(kinds):
        free[k[0]].append(i)
    seed_of: list[int | None] = [None] * len(kinds)
    for i, k in enumerate(kinds):
        if seed_of[i] is None:
            for day in range(k[0] - DAYS, k[0] + DAYS + 1):
                if there := free.get(day):
                    left = []
                    for j in there:
                        if j == i or (j > i and joins(k, kinds[j])):
                            seed_of[j] = i
                        else:
                            left.append(j)
                    free[day] = left
    return seed_of


def _clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind and seed: the first ids of each kind and of the kind that seeds its cluster."""

    def out(kinds: list[dict]) -> pa.RecordBatch:
        seeds = _seeds([(k["day"], k["source"], k["vendor"], k["order_id"]) for k in kinds])
        columns = [[k["kind"] for k in kinds], [kinds[s]["kind"] for s in seeds]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "seed"])

    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and (r["amount"], r["stretch"]) != (held[0]["amount"], held[0]["stretch"]):
                yield out(held)
                held = []
            held.append(r)
    if held:
        yield out(held)


def _listed(days: pa.Array, sources: pa.Array, vendors: pa.Array, orders: pa.Array) -> pa.Array:
    """The clusters of each list, as places of its rows, the seed's first; null stays null."""
    rows = list(zip(*(x.flatten().to_pylist() for x in (days, sources, vendors, orders)), strict=True))
    found, start = [], 0
    for there, n in zip(days.is_valid().to_pylist(), pc.fill_null(pc.list_value_length(days), 0).to_pylist(), strict=True):
        if not there:
            found.append(None)
            continue
        kinds: dict[tuple, list[int]] = {}  # in the order of their first rows
        for i, k in enumerate(rows[start : start + n]):
            kinds.setdefault(k, []).append(i)
        places, clusters = list(kinds.values()), defaultdict(list)
        for own, seed in zip(places, _seeds(list(kinds)), strict=True):
            clusters[seed] += own
        found.append([sorted(x) for x in clusters.values()])
        start += n
    return pa.array(found, pa.list_(pa.list_(pa.int32())))


def coalesced(observations: DataFrame) -> DataFrame:
    """The observations, once each and without those of nothing, with cluster: the ``source:source_id`` of their seed, and place: their order.

    observations: source, source_id, amount (signed), date, counterparty, order_id and others. Of rows that repeat a source and id the least stays.
    A blank counterparty counts as none; rows without an amount or a date are no observations.
    """
    lists, hot = parts(observations)
    order = ["p", "date", "source_id"]
    usual = lists.select("amount", "cluster", F.explode("members").alias("x"))
    usual = usual.select(*("amount" if c == "amount" else F.col(f"x.{c}").alias(c) for c in observations.columns), F.struct(*(F.col(f"x.{c}").alias(c) for c in order)).alias("place"), "cluster")
    return usual.unionByName(hot)


def parts(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`coalesced` as lists, a row a cluster (amount, cluster and members in order, each with p), and the rows of amounts that have more than ``HOT``."""
    rest = [c for c in observations.columns if c not in ("source", "source_id")]
    once = observations.groupBy("source", "source_id").agg(F.min(F.struct(*rest)).alias("row")).select("source", "source_id", "row.*")
    blank = F.when(F.trim("counterparty") != "", F.col("counterparty"))
    once = once.filter("abs(amount) >= 0.01 and date is not null")
    # Of n rows at most n / HOT amounts are common, so they are broadcast.
    common = F.broadcast(once.groupBy("amount").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("amount"))
    keyed = lambda rows: rows.withColumn("counterparty", blank).withColumns({"vendor": names.vendor_key(F.col("counterparty")), "p": -priority(F.col("source"))})
    usual = keyed(once.join(common, "amount", "left_anti").repartition("amount"))
    hot = keyed(once.join(common, "amount", "left_semi")).withColumn("place", F.struct("p", "date", "source_id"))
    return _by_lists(usual, observations.columns), _by_kinds(hot, observations.columns)


def _by_lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    by_date = Window.partitionBy("amount").orderBy("date")
    apart = F.coalesce(F.datediff("date", F.lag("date").over(by_date)) > DAYS, F.lit(True))
    rows = rows.withColumn("apart", apart.cast("long")).withColumn("stretch", F.sum("apart").over(by_date.rangeBetween(Window.unboundedPreceding, 0)))
    order = ["p", "date", "source_id"]
    member = F.struct(*order, "source", "vendor", *(c for c in columns if c not in (*order, "source", "amount")))
    lists = rows.groupBy("amount", "stretch").agg(F.sort_array(F.collect_list(member)).alias("members"))
    several = F.when(F.size("members") > 1, F.col("members"))
    day = F.transform(several, lambda x: F.datediff(x["date"], F.lit("1970-01-01").cast("date")))
    found = F.coalesce(F.arrow_udf(_listed, "array<array<int>>")(day, several["source"], several["vendor"], several["order_id"]), F.array(F.array(F.lit(0))))
    # Each cluster's rows are picked before the list is taken apart, else every cluster would carry the whole list.
    picked = F.transform("found", lambda places: F.transform(places, lambda i: F.get("members", i)))
    lists = lists.withColumn("found", found).select("amount", F.explode(picked).alias("members"))
    seed = F.col("members")[0]
    return lists.select("amount", F.concat_ws(":", seed["source"], seed["source_id"]).alias("cluster"), "members")


def _by_kinds(rows: DataFrame, columns: list[str]) -> DataFrame:
    named = F.concat_ws(":", "source", "source_id")
    kinds = rows.groupBy(*_KIND).agg(F.min("place").alias("place"), F.min(named).alias("kind"))
    by_date = Window.partitionBy("amount").orderBy("date")
    apart = F.coalesce(F.datediff("date", F.lag("date").over(by_date)) > DAYS, F.lit(True))
    stretches = kinds.select("amount", "date").distinct().withColumn("stretch", F.sum(apart.cast("long")).over(by_date.rowsBetween(Window.unboundedPreceding, 0)))
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day")
    scan = kinds.join(stretches, ["amount", "date"]).select("amount", "stretch", "place", "kind", "source", "vendor", "order_id", day)
    found = scan.repartition("amount", "stretch").sortWithinPartitions("amount", "stretch", "place").drop("place").mapInArrow(_clustered, "kind string, seed string")
    labelled = kinds.select("kind", *(F.col(c).alias(f"_{c}") for c in _KIND)).join(found, "kind").drop("kind")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _KIND]
    return rows.join(labelled, same).select(*columns, "place", F.col("seed").alias("cluster"))


def canonical(members: DataFrame) -> DataFrame:
    """One row a cluster: the seed's amount, date and text; the first name and account in order, the bank's account before others; how many observations, of which sources, and what they prove."""
    first = lambda c, when: F.min_by(c, F.when(when, F.col("place")))
    there = lambda c: F.col(c).isNotNull()
    bank = F.col("source") == BANK
    seed = {c: F.min_by(c, "place").alias(c) for c in ("amount", "date", "raw_description")}
    found = members.groupBy("cluster").agg(
        *seed.values(),
        first("counterparty", there("counterparty")).alias("counterparty"),
        F.coalesce(first("account", bank & there("account")), first("account", there("account"))).alias("account"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return _told(found)


def canonical_lists(lists: DataFrame) -> DataFrame:
    """As :func:`canonical`, of clusters whose members stand in a list, in order."""
    members = F.col("members")
    first = lambda c, when=None: F.get(F.filter(members, lambda x: x[c].isNotNull() if when is None else x[c].isNotNull() & when(x)), F.lit(0))[c]
    seed = members[0]
    return _told(
        lists.select(
            "cluster", "amount", seed["date"].alias("date"), seed["raw_description"].alias("raw_description"), first("counterparty").alias("counterparty"),
            F.coalesce(first("account", lambda x: x["source"] == BANK), first("account")).alias("account"), F.size(members).cast("long").alias("n"), F.array_sort(F.array_distinct(members["source"])).alias("sources"),
        )
    )


def _told(found: DataFrame) -> DataFrame:
    n, sources = F.col("n"), F.size("sources")
    has_bank = F.array_contains("sources", BANK)
    provenance = F.when(n > 1, "coalesced").when(has_bank, "bank_observed").otherwise("accounting_observed")
    agreement = F.when((n <= 1) | (sources <= 1), -1.0).when(has_bank, 1.0).otherwise(0.7)
    direction = F.when(F.col("amount") >= 0, "inflow").otherwise("outflow")
    return found.select("cluster", direction.alias("direction"), F.abs("amount").alias("amount"), "date", "raw_description", "counterparty", "account", "n", "sources", provenance.alias("provenance"), agreement.alias("agreement"))
