"""The queries of the operators: those with SQL against it, digests and folds of others against their definition, null ids throughout."""

from __future__ import annotations

import glob
import hashlib
import os
import zlib

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from tests.llm.fixtures import documents  # noqa: E402
from tests.llm.test_decontamination import brute as hits  # noqa: E402
from tests.llm.test_models import brute_base  # noqa: E402
from tidemark.llm import decontamination, encoding, pii, queries, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, db, name):
    got, want = queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = {c: i for i, c in enumerate(want.columns)}
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted((tuple(r[at[c]] for c in order) for r in want.fetchall()), key=repr)


def test_decontamination_digests(spark, db):
    items = db.sql("SELECT item_id, text FROM benchmark").fetchall()
    got = {r["doc_id"]: r for r in queries.op10_decontamination(spark, SF).collect()}
    for i, text in db.sql("SELECT doc_id, text FROM documents").fetchall():
        n, hit, found, _ = hits(text, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_classifier_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(3).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(none).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op9_quality_classifier(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert 0 <= r["score"] <= 1


def test_personal_data_counts_are_those_of_base_spans(spark, tmp_path, monkeypatch):
    seen = [f"words come here {d} and go there again" for d in ("call +1 (743) 555-3824 now", "mail ab.cd@mail7.example.com ok", "host 10.2.33.4 up", "on 2024-05-06 at 12:30 for 1,299.00")] * 5
    model = pii.fit(documents(spark, seen))
    monkeypatch.setattr(pii, "fit", lambda *_: model)
    rows = ["ring (743) 555-3824 today please", "mail x@y.zz or 10.0.0.1, 4111 1111 1111 1111, +1 (743) 555-3824", "none", None]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_pii(spark, str(tmp_path)).collect()}
    assert got[0]["spans"] == "phone:5:19"  # the model's alone
    for i, text in enumerate(rows):
        base = brute_base(text or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(some) for some in base]
        want = ",".join(f"{k}:{a}:{b}" for k, some in zip(pii.KINDS, base, strict=True) for a, b in some)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_benchmark_items_without_ids(spark):
    words = " ".join(f"word{chr(97 + i)}" for i in range(12))
    items = spark.createDataFrame([(None, words), (None, "other text"), (3, words)], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"x {words} y"), (None, f"x {words} y"), (5, "other text"), (6, None)], "doc_id long, text string")
    rows = decontamination.contamination(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["n_items"], sorted(r["items"])) for r in rows) == [("5", 1, [""]), ("6", 0, []), ("None", 2, ["", "3"]), ("None", 2, ["", "3"])]


def test_pages_without_ids(spark, tmp_path):
    rows = [(None, "http://a/x", "same"), (5, "http://a/y", "same"), (None, None, "alone"), (None, "http://b", "both"), (None, "http://b", "both"), (7, "http://c", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archived(pages, f"{tmp_path}/w").collect()), key=str)
    assert got == sorted([(None, "revisit", 5, 4), (5, "response", None, 4), (None, "response", None, 5), (None, "response", None, 4), (None, "response", None, 4), (7, "response", None, 0)], key=str)


def test_calls_are_balanced_by_bytes(monkeypatch):
    monkeypatch.setattr(encoding, "CALL_BYTES", 2000)
    e = encoding.Encoder(queries.public_tokenizers.path(queries.TOKENIZER))
    texts = ["plain words " * 40, "x " * 30_000, "日本 " * 200, "", *["short é text"] * 300, "a\nb\tc " * 20_000]
    calls = list(e.calls(texts))
    sizes = [sum(len(s.encode()) for _, s in some) for _, some in calls]
    assert all(n <= 2000 or len(some) == 1 for n, (_, some) in zip(sizes, calls, strict=True))
    assert sum(len(some) for _, some in calls) > len(calls)
    by_text = ["".join(s for _, some in calls for i, s in some if i == k) for k in range(len(texts))]
    assert by_text == texts
    whole = [len(x.ids) for x in e.slow.encode_batch_fast(texts, add_special_tokens=False)]
    assert e.counts(texts) == whole
