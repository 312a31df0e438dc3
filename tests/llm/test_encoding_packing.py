from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tests.llm.fixtures import documents, texts  # noqa: E402
from tidemark.llm import encoding, packing, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return encoding.Encoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é1.'s \n\t　<|endoftext|>", max_size=60))
def test_segments_keep_the_ids(text):
    e, t = test_segments_keep_the_ids.pair
    for most in (1, 7, 1000):
        cut = list(encoding.segments(text, most))
        assert "".join(cut) == text
        assert sum((t.encode(s, add_special_tokens=False).ids for s in cut), []) == t.encode(text, add_special_tokens=False).ids
    assert e.ids([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


test_segments_keep_the_ids.pair = (encoding.Encoder(PATH), Tokenizer.from_file(PATH))


def test_token_counts(spark, tokenizer):
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents(spark), PATH).collect()}
    for i, text in enumerate(texts()):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)
    assert token_counts.token_counts(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("capacity", [64, 256])
def test_packing(spark, tokenizer, capacity):
    df = documents(spark)
    df = df.unionByName(df.limit(8))  # repeated rows
    cut = packing.pieces(df, PATH, capacity)
    rows = packing.pack(cut, capacity, bins=16).collect()
    want = Counter()
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.bounds(len(ids), capacity)):
            want[(r["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
            assert n == capacity or k == 0
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(packing.pieces(documents(spark, []), PATH, capacity), capacity).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 500), max_size=40))
def test_plan_is_tight(histogram):
    runs, n, begun = packing.plan(histogram, 128, bins=16)
    placed = Counter()
    for length, _, m, _, _ in runs:
        placed[length] += m
    assert placed == Counter(histogram)
    total = sum(k * v for k, v in histogram.items())
    ordered = sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True)
    rooms: list[int] = []
    for x in ordered:  # plain best-fit decreasing
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(128 - x)
    assert begun <= n
    assert -(-total // 128) <= n <= len(rooms)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patterns_carry_the_plan(seed):
    """Lengths like those of documents: many sequences beyond full pieces begin with a fitted pattern, and none are wasted."""
    rng = np.random.default_rng(seed)
    histogram = Counter(np.minimum(2048, 1 + rng.lognormal(6.2, 0.9, 4000).astype(int)).tolist())
    _, n, begun = packing.plan(histogram, 2048)
    total = sum(k * v for k, v in histogram.items())
    assert n <= -(-total // 2048) * 1.002 + 1
    assert begun - histogram[2048] > n / 5
