"""Joins that Spark has no operator for, from equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str, days: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys whose dates are at most ``days`` apart.

    Dates fall into bins of ``days`` + 1; a left row probes its bin and both neighbours, so the
    join is an equi-join on keys and bin, with the exact distance as a residual.
    """
    width = days + 1
    bin_of = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width)
    a = left.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: bin_of(left_day) + i)))
    b = right.withColumn("_bin", bin_of(right_day))
    joined = a.join(b, [*on, "_bin"], how)
    return joined.filter(F.abs(F.datediff(F.col(left_day), F.col(right_day))) <= days).drop("_bin")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], count: int = 1) -> DataFrame:
    """The first ``count`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= count).drop("_rn")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, strict: bool = True) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` before (or, not strict, at or before) its time.

    One union and one running window for each key: no pairs are formed.
    """
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(0 if strict else 1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(*on, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w))
    return found.filter(F.col("_side") == (0 if strict else 1)).drop("_t", "_side", "_v")
