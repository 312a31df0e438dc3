"""Operator 2: token counts, with lengths alone leaving the Arrow functions.

No shuffle: file splits spread the bytes over tasks, Arrow batches are bounded by
bytes, and the encoder is called with batches of segments of about equal bytes. Long texts are encoded
in segments cut at safe boundaries (see :mod:`encoding`), so memory follows the
Arrow batch. Null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, encoding


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each text; ``tokenizer``: a tokenizers file that every worker can open."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.Encoder(tokenizer)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = encoder.counts(texts)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
