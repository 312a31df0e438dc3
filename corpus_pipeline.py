"""A corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read
again as the next one's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, ngram_join, pii, quality_classifier
from tidemark.llm.queries import packed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least 0.3; those below go."""
    common.tune(spark)
    model = quality_classifier.trained(docs, common.read(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model, keep=COLUMNS).filter("quality_score >= 0.3").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a Jaccard similarity of 0.8 on five-word shingles: the one of smallest id.

    Every row is a document of its own, whatever its id: ids may be null or repeated. Its place stands for the row in the join:
    the id, nulls last, then hashes of the whole row. In a group the least place stays; rows equal in all columns are one document.
    A null text counts as empty, and documents without shingles link to none; nulls in other columns pass through.
    An empty table gives an empty table; other columns than those of documents are dropped.
    """
    common.tune(spark)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"), F.hash(*COLUMNS).alias("more"))
    placed = docs.select(place.alias("place"), *COLUMNS)
    found = ngram_join.joined(placed.select("place", "text"), width=5, percent=80, id_col="place")
    kept = found.filter("place = component_id").groupBy("place").agg(F.count("*").alias("rows"), F.min("n_shingles").alias("n"))
    kept = common.written(kept.withColumn("several", (F.col("rows") > 1) & (F.col("n") > 0)).select("place", "several"), "kept")
    common.discard(found)
    rows = placed.join(kept, "place")
    once = rows.filter("several").dropDuplicates(["place"])
    return rows.filter("not several").unionByName(once).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; the others go whole."""
    common.tune(spark)
    found = decontamination.contamination(docs.select(F.struct(*COLUMNS).alias("row"), "text"), common.read(spark, sf_dir, "benchmark"), id_col="row")
    return found.filter("n_hit = 0").select("row.*").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the kind in brackets in place of each span of personal data."""
    common.tune(spark)
    found = pii.spans(docs, keep=COLUMNS)
    return found.withColumn("text", F.coalesce("pii_redacted", "text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    common.tune(spark)
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_personal_data", without_personal_data),
    ("packing", packing),
]

#: No stage can be said in SQL as a whole: models, tokenizers and packing are trained or read from files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
