"""The pipeline's stages on a small corpus against brute force, and over the whole run."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

from tests.llm.fixtures import sentence  # noqa: E402
from tests.llm.test_decontamination import brute as hits  # noqa: E402
from tests.llm.test_models import brute_base  # noqa: E402
from tests.llm.test_ngram_join import brute as groups  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(12, 25))) for i in range(8)]
    rows: list[str | None] = [None, "", sentence(rng, 40)]
    for i in range(160):
        body = text(rng.randint(60, 140))
        if i % 4 == 0:
            body = "## $$ || " * 40
        elif i % 9 == 0:
            body += " " + items[i % 8][1] + " " + text(5)
        elif i % 7 == 0:
            body += f" mail x{i}@mail.example.com or +1 (555) 555-{1000 + i} "
        rows.append(body)
        if i % 10 == 1:
            rows += [body, body + " tail", body.upper()]
    path = str(tmp_path_factory.mktemp("corpus"))
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    bad = {i for i, t in enumerate(rows) if (t or "").startswith("##")}
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(len(rows)) if i % 3 or i in bad], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items, bad


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, corpus):
    path, rows, items, bad = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = set(docs.columns)
    good = stage("quality")(spark, docs, path)
    assert set(good.columns) == columns
    kept = texts(good)
    assert not bad & set(kept)
    assert len(kept) >= 0.95 * (len(rows) - len(bad) - 2)
    whole = [t for t in rows if t]
    every = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(whole)], docs.schema)
    left = stage("near_duplicates")(spark, every, path)
    want = {i for i, (_, root) in groups(whole, 5, 80).items() if root == i}
    assert set(texts(left)) == want
    assert set(left.columns) == columns
    clean = stage("decontaminated")(spark, every, path)
    assert set(texts(clean)) == {i for i, t in enumerate(whole) if not hits(t, items)[1]}
    masked = texts(stage("without_personal_data")(spark, every, path))
    assert set(masked) == set(range(len(whole)))
    for i, t in masked.items():
        assert not any(brute_base(t))
        assert any(brute_base(whole[i])) or t == whole[i]
    pieces = stage("packing")(spark, every, path).collect()
    assert {r["doc_id"] for r in pieces} == set(range(len(whole)))


def test_run(spark, corpus):
    import corpus_pipeline

    path, rows, *_ = corpus
    out = corpus_pipeline.run(spark, path).collect()
    assert out
    assert all(r["offset"] + r["length"] <= 2048 for r in out)
    assert {r["doc_id"] for r in out} < set(range(len(rows)))


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids: each text that has no copy stays, and one row of each group."""
    rng = random.Random(31)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(60))
    alone, other, twin, nulls, shared = text(), text(), text(), text(), text()
    rows = [
        (None, alone), (None, nulls), (None, nulls + " tail"), (None, ""), (None, None),
        (7, other), (7, twin), (8, twin + " tail"), (6, twin),
        (9, shared), (None, shared), (3, shared + " tail"), (3, shared), (1, None), (1, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], schema)
    for parts in (1, 3):
        left = [(r["doc_id"], r["text"]) for r in stage("near_duplicates")(spark, docs.repartition(parts), "").collect()]
        assert (None, alone) in left
        assert (7, other) in left
        assert (6, twin) in left
        assert sum(t is not None and t.startswith(twin) for _, t in left) == 1
        assert sum(t is not None and t.startswith(nulls) for _, t in left) == 1
        assert [i for i, t in left if t is not None and t.startswith(shared)] == [3]
        assert left.count((None, "")) == left.count((None, None)) == 1
        assert left.count((1, None)) == 2
        assert len(left) == 5 + 4
