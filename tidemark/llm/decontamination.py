"""Operator 10: benchmark decontamination by Aho-Corasick automata.

Items become windows of ``size`` consecutive normalised words (an item of fewer
words, but not none, is one window). The windows of all items form one automaton;
each text is normalised and scanned once, and what occurs is mapped back to places in
the original text. There is no shuffle. A benchmark too large for one automaton is
dealt into blocks by hash, and each text passes the automata one after
another; the result so far is written after each block, so that driver and broadcasts hold one block at a time, of about
``block_bytes`` of item text at most (an item longer than that is a block's whole content).

Null, empty and wordless texts have no words and no hits; an item without words has no
windows; repeated documents each give a row; items that share a window all count. An empty table of documents gives an empty table, and
an empty benchmark hits nothing; columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Bytes to their normal form: A-Z to a-z, digits, a-z and all bytes from 0x80 as they are, the rest a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_BUILT: dict[int, tuple] = {}


def windows(text: bytes, size: int) -> list[bytes]:
    """The windows of one item, each with a space at both ends."""
    w = text.translate(_NORMAL).split()
    n = min(size, len(w))
    return [b" " + b" ".join(w[i : i + n]) + b" " for i in range(len(w) - n + 1)] if w else []


def _automaton(key: int, items: list[tuple[str, bytes]], size: int) -> tuple:
    """The automaton of a block, built once in each worker; a window's value is its index in the list of its items."""
    if key not in _BUILT:
        import ahocorasick

        at: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                at.setdefault(w, set()).add(item)
        a = ahocorasick.Automaton()
        for i, w in enumerate(at):
            a.add_word(w.decode("latin-1"), (i, len(w)))  # a character for each byte
        if at:
            a.make_automaton()
        _BUILT.clear()
        _BUILT[key] = (a if at else None, list(at.values()))
    return _BUILT[key]


def _occurring(automaton, owners: list[set[str]], text: bytes) -> tuple[int, list[int], list[str], bytes]:  # noqa: ANN001
    """The number of words, first and last word of every occurrence, and the items that occur."""
    w = text.translate(_NORMAL).split()
    if not w or automaton is None:
        return len(w), [], []
    joined = b" " + b" ".join(w) + b" "
    found = [(end, v) for end, v in automaton.iter(joined.decode("latin-1"))]
    if not found:
        return len(w), [], []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.array([e for e, _ in found])
    lengths = np.array([v[1] for _, v in found])
    pairs = np.stack([np.searchsorted(gaps, ends - lengths + 1), np.searchsorted(gaps, ends) - 1], 1)
    items = sorted({x for _, v in found for x in owners[v[0]]})
    return len(w), np.unique(pairs, axis=0).ravel().tolist(), items


def _spans(text: bytes, hits: list[int]) -> tuple[int, list[dict]]:
    """The number of words inside occurrences, and their runs as code points of the original text."""
    if not hits:
        return 0, []
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hit = np.zeros(len(starts) + 1, np.int64)
    np.add.at(hit, hits[::2], 1)
    np.add.at(hit, np.array(hits[1::2]) + 1, -1)
    hit = np.cumsum(hit)[:-1] > 0
    turns = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # code points before each byte
    runs = zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) - 1, strict=True)
    return int(hit.sum()), [{"start": int(point[starts[a]]), "end": int(point[ends[b]])} for a, b in runs]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Per document: ``id_col``, n_words, n_hit, n_items, items (array), spans (of the original text, in code points).

    Items without an id are one item named ''; items that repeat an id are one item with the windows of all. Rows that repeat a document, or lack its id, each give a row.
    An empty benchmark hits nothing, an empty table gives an empty table, and other columns are never read.
    """
    listed = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("array<long>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    kind = dict(rows.dtypes)["id"]
    of = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for k in range(count):
        block = [(r["item"], r["text"].encode()) for r in listed.filter(of == k).collect()]  # bounded by ``block_bytes``
        sent, last, key = spark.sparkContext.broadcast(block), k + 1 == count, hash((k, size, tuple(block)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, last: bool = last, key: int = key) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            automaton, owners = _automaton(key, sent.value, size)
            for b in batches:
                texts = common.utf8(b.column("text"))
                out = []
                for t, hits, had in zip(texts, b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True):
                    n, new, found = _occurring(automaton, owners, t)
                    out.append((n, (hits or []) + new, sorted({*(had or []), *found})))
                items = pa.array([x[2] for x in out], pa.list_(pa.string()))
                if not last:
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array([x[1] for x in out], pa.list_(pa.int64())), items], ["id", "text", "hits", "items"])
                    continue
                spans = [_spans(t, x[1]) for t, x in zip(texts, out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array([x[0] for x in out], pa.int64()), pa.array([s[0] for s in spans], pa.int64()), items, pa.array([s[1] for s in spans], _SPANS)],
                    ["id", "n_words", "n_hit", "items", "spans"],
                )

        if last:
            rows = rows.mapInArrow(scan, f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
        else:
            done = common.written(rows.mapInArrow(scan, f"id {kind}, text string, hits array<long>, items array<string>"), "scanned")
            sent.destroy()
            if k:
                common.discard(rows)
            rows = done
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans")


def items_digest(items: Column) -> Column:
    """The hexadecimal SHA-256 of the items, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)
