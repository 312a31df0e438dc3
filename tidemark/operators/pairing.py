"""One-to-one pairing of opposite legs, from counts of like legs.

Legs of one amount stand in the order of date, account, direction and id; each takes the earliest free leg before it that
has the other direction, another account and a date at most some days earlier. As every leg prefers the earliest partner, the pairs are
those of a greedy scan over all candidate pairs in that order.

Legs that agree in amount, date, account and direction have the same partners, so the scan runs over such runs and their counts: what two runs
share is an interval of places in both. Rows meet by their places afterwards. An amount with a third of all rows is one short list of runs, and no pairs of candidates are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RUN = ["amount", "date", "account", "direction"]


def _scanned(batches: Iterator[pa.RecordBatch], days: int) -> Iterator[pa.RecordBatch]:
    """amount and, for both runs of a pair of runs, date, account, direction and first place; n: how many legs they share."""
    names = ["amount", *(f"{side}_{c}" for side in "ab" for c in (*_RUN[1:], "from")), "n"]
    amount, waiting = None, []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["amount"] != amount:
                amount, waiting = r["amount"], []
            waiting = [w for w in waiting if (r["date"] - w["date"]).days <= days]
            left, place = r["n"], 0
            for w in waiting:
                if left and w["left"] and w["direction"] != r["direction"] and w["account"] != r["account"]:
                    n = min(left, w["left"])
                    out.append((amount, w["date"], w["account"], w["direction"], w["n"] - w["left"], r["date"], r["account"], r["direction"], place, n))
                    w["left"], left, place = w["left"] - n, left - n, place + n
            # Legs are taken from the front of a run, so what is left of this one starts at ``place``.
            if left:
                waiting.append(r | {"left": left})
            waiting = [w for w in waiting if w["left"]]
        kinds = [batch.schema.field("amount").type, *(t for _ in "ab" for t in (pa.date32(), pa.string(), pa.string(), pa.int64())), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)


def pair_once(legs: DataFrame, days: int = 1) -> DataFrame:
    """amount, outflow_id, inflow_id, from_account and to_account; every leg is in one pair at most. legs: movement_id (a key), direction, account, date and amount.

    Legs without account, date or amount pair with nothing.
    """
    legs = legs.select("movement_id", *_RUN).dropna()
    runs = legs.groupBy(*_RUN).agg(F.count("*").alias("n"))
    kind = dict(legs.dtypes)["amount"]
    schema = f"amount {kind}, " + ", ".join(f"{s}_date date, {s}_account string, {s}_direction string, {s}_from long" for s in "ab") + ", n long"
    shared = runs.repartition("amount").sortWithinPartitions(*_RUN).mapInArrow(lambda batches: _scanned(batches, days), schema)
    # A leg's place in its run, counted from 0.
    placed = legs.withColumn("place", F.row_number().over(Window.partitionBy(*_RUN).orderBy("movement_id")).cast("long") - 1)
    pairs = shared.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    for s in "ab":
        side = placed.select("amount", *(F.col(c).alias(f"{s}_{c}") for c in _RUN[1:]), F.col("place").alias(f"{s}_place"), F.col("movement_id").alias(f"{s}_id"))
        pairs = pairs.withColumn(f"{s}_place", F.col(f"{s}_from") + F.col("i")).join(side, ["amount", *(f"{s}_{c}" for c in _RUN[1:]), f"{s}_place"])
    out = F.col("a_direction") == "outflow"
    pick = lambda column, first: F.when(out if first else ~out, F.col(f"a_{column}")).otherwise(F.col(f"b_{column}"))
    return pairs.select("amount", pick("id", True).alias("outflow_id"), pick("id", False).alias("inflow_id"), pick("account", True).alias("from_account"), pick("account", False).alias("to_account"))
