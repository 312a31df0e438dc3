"""Structured Streaming over event flows: an extension, not a claim of parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import first_per_key
from tidemark.session import shared_dir


def deduplicated(stream: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """First arrival of each key; state older than the watermark goes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_flow(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling daily sums by kind of event."""
    w = F.window("ts", "1 day")
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of a table: folders v=N that hold the mark of a finished write."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "v=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{target}/v={versions(spark, target)[-1]}")


def replace(rows: DataFrame, target: str, version: int) -> None:
    """``rows`` as one version of a table. A version that is complete stays (a batch may come twice); one that a failure left open is written anew."""
    if version not in versions(rows.sparkSession, target):
        rows.write.mode("overwrite").parquet(f"{target}/v={version}")


def upsert(batch: DataFrame, target: str, key: str, order: str, version: int) -> None:
    """A micro-batch merged into a table of versions: the last row of each key wins, of equal ones the newer batch's.

    ``version`` rises with each batch, as the batch id of foreachBatch does. The version before is only
    read, so a failure leaves it whole, readers always find one, and a repeated batch changes nothing.
    """
    spark = batch.sparkSession
    both = batch.withColumn("_new", F.lit(1))
    before = [v for v in versions(spark, target) if v < version]
    if before:
        both = both.unionByName(spark.read.parquet(f"{target}/v={before[-1]}").withColumn("_new", F.lit(0)))
    replace(first_per_key(both, [key], [F.col(order).desc(), F.col("_new").desc()]).drop("_new"), target, version)


def replayed(spark: SparkSession, path: str, schema, name: str) -> DataFrame:  # noqa: ANN001
    """A Parquet file's rows pushed through :func:`daily_flow` to a table of versions in the shared folder, for tests and the query."""
    root = f"{shared_dir(spark)}/{name}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = daily_flow(stream).writeStream.outputMode("complete").foreachBatch(lambda rows, k: replace(rows, f"{root}/rows", k))
    out.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{root}/rows")
