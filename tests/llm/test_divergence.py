"""Operator 11 against a plain count, and operator 12 against all distances."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from tidemark.llm import centroids, source_divergence  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, part string, rank int"


def brute_audit(rows, least=10, top=10):
    """rows of (text, lang, source)."""
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        tf[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        total = {s: sum(tf[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (tf[lang, s][t] + 2) // (total[s] + 2 * v) for t in kept} for s in sources}
        n = {t: sum(tf[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if tf[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, 10**9), ("term", terms, top)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out)


def corpus(seed=3, n=260):
    rng = random.Random(seed)
    words = ["The", "and", "Ä", "ä", "né", "o'clock", "x-ray", "Σ", "end.", "ß9ß", "中文", "q", "😀"] + [f"t{chr(97 + i)}" for i in range(26)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", "Z", None, "hot"])
        k = rng.choice([0, 1, 5, 30, 80])
        bias = ord((source or "n")[0]) % 7
        rows.append((" ".join(rng.choice(words[bias:]) for _ in range(k)), lang, source))
    rows += [(None, "en", "silent"), ("", "xx", "only"), (None, "yy", "a"), ("", "yy", "b"), ("the " * 20, "zz", "a")]
    return rows + rows[:40]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "part", 7) for i, (t, lang, s) in enumerate(rows)], DOCS)


def listed(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(source_divergence, "SEGMENT", 7)
        monkeypatch.setattr(source_divergence, "HELD", 20)
        monkeypatch.setattr(source_divergence, "CELLS", 8)
    rows = corpus()
    assert listed(source_divergence.audited(frame(spark, rows).repartition(5))) == brute_audit(rows)


def test_audit_of_nothing(spark):
    assert listed(source_divergence.audited(frame(spark, []))) == []
    assert listed(source_divergence.audited(frame(spark, [("a", "x", "s"), ("b", "x", "t")]))) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


def test_segments():
    rng = random.Random(1)
    for _ in range(200):
        text = bytes(rng.choice(b"aB9 \xc3\xa9") for _ in range(rng.randint(0, 60)))
        cut = [t for s in source_divergence.segments(text, 9) for t in s.split()]
        assert cut == text.translate(source_divergence._TERMS).split()


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.randint(1, 9 * 10**15)
        n = rng.randint(0, total)
        got = source_divergence.probability(np.array([n]), np.array([total]))
        assert int(got[0]) == 1 + 10**9 * n // total


def brute_clusters(rows, k=16, rounds=3):
    """rows of (id, vector)."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**20 for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w, strict=True))
    near = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        c = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else w for j, w in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), c[j]) for i, j, d in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, id int").repartition(3)


def clusters(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")) for r in df.collect()), key=repr)


def test_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) / 8).astype(np.float32).tolist()) for i in range(150)]
    same = rows[0][1]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] * 64, [float("nan")] * 64, [float("inf")] * 64, [2.0**21] * 64]
    rows += [(200 + i, same) for i in range(60)] + [(300 + i, v) for i, v in enumerate(odd)] + [(None, [0.25] * 64), (7, [-0.25] * 64), (7, [-0.25] * 64)]
    assert clusters(centroids.clustered(vectors(spark, rows))) == brute_clusters(rows)


def test_equal_and_few_vectors(spark):
    rows = [(i, [0.1] * 64) for i in range(40)]
    assert clusters(centroids.clustered(vectors(spark, rows))) == brute_clusters(rows)
    few = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.49] * 64)]
    assert clusters(centroids.clustered(vectors(spark, few))) == brute_clusters(few)
    assert clusters(centroids.clustered(vectors(spark, [(1, None)]))) == []
    assert clusters(centroids.clustered(vectors(spark, []))) == []


def test_nearest_by_partial_sums():
    rng = np.random.default_rng(5)
    for high in (2, 50, 1 << 20):
        x, c = rng.integers(-high, high, (300, 64)), rng.integers(-high, high, (16, 64))
        c[9], x[:40] = c[3], c[3]
        which, d = centroids.nearest(x, c, rng.permutation(64))
        every = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (which == every.argmin(1)).all()
        assert (d == every.min(1)).all()
