"""A feed of changes (added, modified, removed) in pages, kept as a table of what is there now.

The state of a key is its latest change by the feed's own order, removals included: a tombstone stays, so an older change that comes late, or a page that comes twice,
changes nothing. The streaming aggregation holds that state in Spark's state store; each batch merges the keys that it changed into a table of versions (see :mod:`flows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir
from tidemark.streaming.flows import current, upsert


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest change of each key, by ``order``, which no two changes of a key share; of changes that come twice one counts. Changes without key or order are none."""
    rest = [c for c in changes.columns if c not in (key, order)]
    last = changes.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("last"))
    return last.select(key, "last.*")


def synced(spark: SparkSession, pages: str, schema, name: str, key: str, order: str, at_once: int = 1) -> DataFrame:  # noqa: ANN001
    """What is there after all pages (Parquet files) in ``pages``, ``at_once`` files a batch; a run under the same name goes on where the last one stopped."""
    root = f"{shared_dir(spark)}/{name}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(pages)
    out = latest(stream, key, order).writeStream.outputMode("update").foreachBatch(lambda rows, k: upsert(rows, f"{root}/rows", key, order, k))
    out.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{root}/rows").filter("op <> 'removed'").drop("op")
