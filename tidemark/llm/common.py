"""What the operators share: tables, cutting lineage, words and batches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-casing of A-Z alone, for ``translate``.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words: the space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (as in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing will read again."""
    jvm = df.sparkSession._jvm
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns cannot clash with those an operator adds."""
    return df.select(*(F.col(f"`{x}`") for x in names))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null counts as an empty text."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() splits on just these bytes."""
    return text.split()


def crc_mod(ids: list[int], n: int) -> list[int]:
    """crc32 of each id's decimal text, modulo n."""
    return [zlib.crc32(b"%d" % i) % n for i in ids]


def by_bytes(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``most`` bytes at the most; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def hot_split(keyed: DataFrame, key: str, rows: int, share: int = 2000) -> tuple[DataFrame, int]:
    """Counts and the smallest number of rows that makes a key hot.

    A key is hot when it holds more than 1/``share`` of the rows, so that there
    are fewer than ``share`` hot keys whatever the input: a proven bound for a broadcast.
    """
    return keyed.groupBy(key).count(), max(1, rows // share)
