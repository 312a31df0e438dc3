from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, texts
from tidemark.llm import common, quality_rules, sharding, warc


def test_sharding(spark):
    df = documents(spark)
    df = df.unionByName(df.filter("doc_id < 7"))  # repeated rows
    rows = sharding.shards(df, 4).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    order = sorted(((int(hashlib.md5((r["text"] or "").encode()).hexdigest()[:15], 16), r["doc_id"], len((r["text"] or "").encode()) + 1) for r in df.collect()))
    total, at, shard_of = sum(x[2] for x in order), 0, []
    for _, i, size in order:
        shard_of.append((i, at * 4 // total))
        at += size
    assert Counter((r["doc_id"], r["shard"]) for r in rows) == Counter(shard_of)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shards(documents(spark, []), 4).count() == 0


def test_sharding_subdivides(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FEWEST", 4)
    monkeypatch.setattr(sharding, "DRAWN", 1)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shards(df, 5).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sum(r["n"] for r in rows) == 3000
    assert max(r["b"] for r in rows) - min(r["b"] for r in rows) <= 12
    assert all(r["m"] == r["n"] - 1 for r in rows)


def test_shards_written(spark, tmp_path):
    sharding.write(documents(spark), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(texts())
    assert {r["text"] for r in back.collect()} == set(texts())


def counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    more = ["a b c d e f g h " * 5, "one\n\ntwo\none\n \none", "## $$ | x", "w " * 40, "\x0bx\x0cy\x1cz\r\n", "a b c d e f g h i a b c d e f g h j k a b c d e f g h"]
    rows = quality_rules.measured(documents(spark, [*texts(), *more])).collect()
    assert len(rows) == len(texts()) + len(more)
    for r, text in zip(sorted(rows, key=lambda r: r["id"]), [*texts(), *more], strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(text), text


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (50, 3, 0.1), (2000, 30, 0.025), (100_000, 2400, 0.025), (5, 5, 0.5)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality_rules.log_binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(p))).first()[0]
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    most = max(logs)
    assert got == pytest.approx(most + math.log(sum(math.exp(x - most) for x in logs)), abs=1e-6)


def test_thresholds_hold_the_risk(spark):
    rows = [(i, ("|#$ " * 7 if i % 5 == 0 else "word ") + " ".join(f"w{i}x{k}" for k in range(40)), "en") for i in range(1500)] + [(9000, "# " * 200, "xx"), (9001, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(1500)], "doc_id long, quality int")
    got = {r["id"]: r for r in quality_rules.judged(docs, labels).collect()}
    assert all(got[i]["kept"] == (i % 5 != 0) for i in range(1500))
    assert got[9000]["kept"] == (not got[9000]["base_failed"])  # a stratum without labels has no rules
    assert got[9001]["base_failed"]
    few = quality_rules.judged(docs, labels.filter("doc_id < 40"))
    assert few.filter("kept").count() >= 1500  # too few labels: nothing is shown, nothing rejected
    assert quality_rules.judged(docs.limit(0), labels.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    html = ["<p>one</p>", "<p>one</p>", "", None, "WARC/1.1\r\nx: y\r\n\r\nbody\r\n\r\n", "é　\x00z", "<p>one</p>", "b" * 70_000, "c" * 1_100_000]
    rows = [(i, f"http://a{i % 2}.Example.com/p{i}?q#f" if i != 5 else None, h, 3, "x") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, ts int, digest string")
    got = {r["page_id"]: r for r in warc.archived(pages, str(tmp_path / "w")).collect()}
    first = {}
    for i, h in enumerate(html):
        first[h or ""] = i
    assert len(got) == len(html)
    for i, h in enumerate(html):
        r, raw = got[i], (h or "").encode()
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["payload_bytes"] == len(raw)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    order = sorted(got.values(), key=lambda r: r["position"])
    assert [r["position"] for r in order] == list(range(len(html)))
    keys = [(r["url_key"], r["ts"], r["page_id"]) for r in order]
    assert keys == sorted(keys)
    assert {k[0] for k in keys if k[0] != ")"} == {f"com,example,a{i % 2})/p{i}?q" for i in range(len(html)) if i != 5}
    assert warc.archived(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_loser_tree():
    import random

    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        lists = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(lists)) == sorted(sum(lists, []))


def test_common(spark, tmp_path):
    assert list(common.by_bytes([b"ab", b"c", b"", b"defg", b"h"], 3)) == [(0, 3), (3, 4), (4, 5)]
    assert list(common.by_bytes([], 3)) == []
