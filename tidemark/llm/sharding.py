"""Operator 5: shards of near equal bytes by sampled splitters, in DataFrame functions alone.

Records are ordered by (60 bits of the text's MD5, id), so equal texts stand together and a
group of copies of any size can still be cut between its ids. A size-weighted sample of
bounded size gives quantile boundaries; each record finds its range by them. Ranges with
too many records are subdivided by samples of their own. Running sums inside ranges,
offset by the ranges before, then give each record its exact place in the whole order, so
that shards differ in bytes by no more than a record at either end, whatever the samples were.

Law: ``bytes``. A null text counts as empty and has size 1. Repeated rows each get a slot of
their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Ranges at least and at most, and sampled records for each range.
FEWEST, MOST, DRAWN = 1024, 8192, 32

_CELL_BITS = 48  # the 60-bit key's upper 12 bits choose the boundaries to look at


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _chance(seed: int) -> Column:
    """A number in [0, 1) that depends on the record alone."""
    return F.pmod(F.xxhash64("key", "id", "seq", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _ranged(slim: DataFrame, bounds: list[tuple[int, object, int]]) -> DataFrame:
    """``slim`` with its range: the number of boundaries at or below the record."""
    spark = slim.sparkSession
    kind = dict(slim.dtypes)["id"]
    cells: dict[int, list] = {}
    for b in sorted(bounds):
        cells.setdefault(b[0] >> _CELL_BITS, []).append(b)
    rows, base = [], 0
    for cell in range(1 << 12):
        here = cells.get(cell, [])
        rows.append((cell, base, here))
        base += len(here)
    lookup = spark.createDataFrame(rows, f"cell long, base int, bounds array<struct<key:long,id:{kind},seq:long>>")
    me = F.struct("key", "id", "seq")
    joined = slim.withColumn("cell", F.shiftright("key", _CELL_BITS)).join(F.broadcast(lookup), "cell")
    return joined.withColumn("range", F.col("base") + F.size(F.filter("bounds", lambda b: b <= me))).drop("cell", "base", "bounds")


def _quantiles(sample: DataFrame, by: list[str], parts: Column) -> list[tuple]:
    """The first sampled record of each of ``parts`` equal shares of the weight; ``sample`` has a bounded number of rows."""
    order = Window.partitionBy(*by).orderBy("key", "id", "seq")
    whole = Window.partitionBy(*by)
    share = F.floor((F.sum("weight").over(order) - F.col("weight") / 2) * parts / F.sum("weight").over(whole))
    cut = sample.withColumn("share", share).groupBy(*by, "share").agg(F.min(F.struct("key", "id", "seq")).alias("b"))
    return [tuple(r["b"]) for r in cut.filter("share > 0").select("b").collect()]


def shards(docs: DataFrame, count: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard and the columns to ``carry``; write it partitioned by shard for the shards themselves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = common.written(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            text_key(text).alias("key"), F.monotonically_increasing_id().alias("seq"), *(F.col(c).alias(f"carry_{c}") for c in carry),
        ),
        "sized",
    )
    total = slim.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = min(MOST, max(FEWEST, total["rows"] // 100_000))
    drawn, size = ranges * DRAWN, F.col("size")
    fair = total["bytes"] / drawn if total["bytes"] else 1.0
    sample = slim.filter(_chance(1) * fair < size).withColumn("weight", F.greatest(size.cast("double"), F.lit(fair)))
    bounds = _quantiles(sample.select("key", "id", "seq", "weight"), [], F.lit(ranges))
    ranged = _ranged(slim, bounds)
    most = max(200, 4 * total["rows"] // ranges)
    for again in range(3):
        overfull = ranged.groupBy("range").count().filter(F.col("count") > most)
        held = [(r["range"], r["count"]) for r in overfull.collect()]  # fewer than a quarter of the ranges
        if not held:
            break
        crowd = slim.sparkSession.createDataFrame(held, "range int, n long")
        inside = ranged.join(F.broadcast(crowd), "range").withColumn("parts", F.ceil(F.col("n") * 2 / most))
        some = inside.filter(_chance(2 + again) * F.col("n") < F.col("parts") * DRAWN).withColumn("weight", F.lit(1.0))
        bounds = [*bounds, *_quantiles(some.select("range", "key", "id", "seq", "weight", "parts"), ["range"], F.col("parts"))]
        ranged = _ranged(slim, bounds)
    sums = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    up_to = Window.orderBy("range")  # a row for each range
    before = sums.select("range", (F.sum("rows").over(up_to) - F.col("rows")).alias("rows_before"), (F.sum("bytes").over(up_to) - F.col("bytes")).alias("bytes_before"))
    inside = Window.partitionBy("range").orderBy("key", "id", "seq")
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (
        ranged.join(F.broadcast(before), "range")
        .withColumn("shard", F.floor(start.cast("decimal(38,0)") * count / F.lit(max(1, total["bytes"])).cast("decimal(38,0)")).cast("int"))
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
        .drop("range", "rows_before", "bytes_before", "key", "seq")
    )
    placed = common.written(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *(F.col(f"carry_{c}").alias(c) for c in carry),
    )


def write(docs: DataFrame, path: str, count: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The shards as Parquet, a folder for each, with each record's slot."""
    found = shards(docs, count, id_col, text_col, carry=(text_col,))
    found.drop("grown_shard", "law").write.partitionBy("shard").parquet(path)


#: The same rows in DuckDB: CRC-32 from its rule, shards and slots from the whole order.
ORACLE_SQL = """
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], [0,0,0,0,0,0,0,0]::BIGINT[]),
      lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS v
    FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size,
    xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32,
    ('0x' || substr(md5(text), 1, 15))::BIGINT AS key
  FROM d, tab),
s AS (
  SELECT *, floor((sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size) * 16 / sum(size) OVER ())::INTEGER AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s
"""
