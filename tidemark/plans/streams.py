"""Streaming queries, run over the events table to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.session import shared_dir, table
from tidemark.streaming.changes import synced
from tidemark.streaming.flows import replayed


@query("streamed_daily_flow", "SELECT ts::DATE AS day, event_type, count(*) AS n, sum(round(value::DECIMAL(20,4), 2)::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def streamed_daily_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling daily flow with a watermark, replayed from Parquet."""
    out = replayed(spark, sf, table(spark, sf, "events").schema, f"daily_{uuid.uuid4().hex}")
    return out.withColumn("total", F.col("total").cast("double"))


@query(
    "synced_items",
    """WITH c AS (SELECT user_id AS item, epoch_us(ts::TIMESTAMP)::HUGEINT * 1000000 + event_id % 1000000 AS cursor, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'modified' END AS op, value FROM events WHERE user_id IS NOT NULL)
SELECT item, max(cursor)::VARCHAR AS cursor, arg_max(value, cursor) AS value FROM c GROUP BY 1 HAVING arg_max(op, cursor) <> 'removed'""",
)
def synced_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as changes of one item: signups add, errors remove, others modify. Pages by hash come in no order of time, and the first page comes twice."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("item"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * 1000000 + F.col("event_id") % 1000000).alias("cursor"),
        F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("modified").alias("op"), "value", "event_id",
    )
    name = f"changes_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-pages"
    paged = e.withColumn("page", F.pmod(F.xxhash64("event_id"), F.lit(4))).drop("event_id")
    twice = paged.unionByName(paged.filter("page = 0").withColumn("page", F.lit(4).cast("long")))
    twice.repartition(5, "page").drop("page").write.parquet(path)
    found = synced(spark, path, twice.drop("page").schema, name, "item", "cursor", at_once=2)
    return found.withColumn("cursor", F.col("cursor").cast("string"))
