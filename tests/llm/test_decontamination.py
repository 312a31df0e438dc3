from __future__ import annotations

import random
import re

import pytest

pytest.importorskip("ahocorasick")

from tests.llm.fixtures import documents, sentence, texts  # noqa: E402
from tidemark.llm import decontamination  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(text, items, size=10):
    spans = [m.span() for m in WORD.finditer(lower(text or ""))]
    words = [lower(text or "")[a:b] for a, b in spans]
    hit, found = set(), []
    for item, body in items:
        w = WORD.findall(lower(body or ""))
        n = min(size, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in wins] if wins else []
        if at:
            found.append(str(item))
        for i in at:
            hit |= set(range(i, i + n))
    return len(words), hit, sorted(found), spans


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randint(1, 30))) for i in range(2, 14)] + [(20, None), (21, "--"), (22, "mu Nu"), (23, sentence(rng, 12))]
    docs = [t for t in texts() if t != "x"]
    docs += [f"Intro: {items[3][1].upper()}; and {items[15][1]} tail é", f"{items[5][1]}", "mu-nu", "MU, nu!", "munu"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in decontamination.contamination(documents(spark, docs), bench, block_bytes=block_bytes).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        n, hit, found, spans = brute(text, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], sorted(r["items"]), r["n_items"]) == (n, len(hit), found, len(found)), text
        covered = {k for k, (a, b) in enumerate(spans) if any(s["start"] <= a and b <= s["end"] for s in r["spans"])}
        assert covered == hit


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contamination(documents(spark), none).collect()
    assert len(rows) == len(texts())
    assert not any(r["n_hit"] for r in rows)
    assert decontamination.contamination(documents(spark, []), none).count() == 0
