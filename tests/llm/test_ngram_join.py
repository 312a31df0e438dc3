from __future__ import annotations

import random

import pytest

pytest.importorskip("xxhash")

from tests.llm.fixtures import documents, texts  # noqa: E402
from tidemark.llm import ngram_join  # noqa: E402


def brute(rows, width, percent):
    sets = []
    for t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "percent", "group"), [(3, 90, 64), (5, 80, 3), (2, 60, 2)])
def test_against_brute_force(spark, monkeypatch, width, percent, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    rng = random.Random(width)
    vocabulary = [f"w{i}" * (1 + i % 3) for i in range(300)]
    rows = texts()
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 90))]
        if rng.random() < 0.5:
            base += passage
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [rows[i] for i in order]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(documents(spark, rows), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_edges(spark):
    assert ngram_join.joined(documents(spark, [])).count() == 0
    got = ngram_join.joined(documents(spark, [None, "", " \n"])).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in sorted(got)] == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_rows_without_ids_and_with_equal_ids(spark):
    """Every row links by its own text; a component's id is its smallest id that is not null."""
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    rows = [(None, a, "x"), (7, a, "y"), (3, b, "z"), (3, a, "z"), (9, b, "z"), (None, "u v w x y z", "w"), (4, "", "e"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(docs, 3, 90).collect()), key=str)
    assert got == sorted([(None, 8, 3), (7, 8, 3), (3, 8, 3), (3, 8, 3), (9, 8, 3), (None, 4, None), (4, 0, 4), (4, 0, 4)], key=str)


def test_a_large_cluster_and_its_outsiders(spark, monkeypatch):
    """Near copies in many blocks become one component in rounds; a text that links with one member alone joins it."""
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    words = [f"w{i}" for i in range(60)]
    rows = [" ".join([*words, f"x{i}"]) for i in range(70)]
    edge = [*words[:50], *(f"y{i}" for i in range(6)), "x5"]
    rows += [" ".join(edge), " ".join(["z", *edge[:-1], "q"]), "unlike all of them in every way it can be"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(documents(spark, rows), 2, 70).collect()}
    assert got == brute(rows, 2, 70)


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["id"]: r["component"] for r in ngram_join.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_blocks_of_one_home_token(spark):
    """Production limits: one boilerplate has a component beyond a group and many small ones, whose pairs share a home token and links that no block may hide."""
    words = [f"w{i}" for i in range(62)]
    rows = [" ".join([*words[:-1], f"x{i}"]) for i in range(100)]
    for i in range(60):
        pair = list(words)
        for j in range(6):
            pair[50 + 2 * j] = f"p{i}q{j}"
        rows += [" ".join(pair), " ".join([*pair[:-1], f"end{i}"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(documents(spark, rows), 3, 90).collect()}
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize("seed", range(2))
def test_one_large_component_and_many_small_ones(spark, monkeypatch, seed):
    """Random corpora of one boilerplate, in blocks so small that pairs of one block are dealt apart in the next."""
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    rows = [" ".join([*words[:-1], f"x{i}"]) for i in range(rng.randint(6, 30))]
    for i in range(25):
        base = list(words)
        for j in rng.sample(range(15, 50), rng.randint(4, 9)):
            base[j] = f"p{i}q{j}"
        for k in range(rng.randint(1, 3)):
            rows.append(" ".join([*base[: 49 - k], *(f"e{i}" for _ in range(k)), f"end{i}-{k}"]))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(documents(spark, rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)
