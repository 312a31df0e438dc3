"""Prefix resolution against all pairs of a prefix."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.operators import resolution


def plain_score(query, key):
    short, long = sorted((query, key), key=len)
    if long.startswith(short) or long.endswith(short):
        return len(short) / len(long)
    q, c = ([w for w in re.findall("[a-z]+", x) if len(w) >= 3] for x in (query, key))
    if not q or not c:
        return 0
    return sum(any(w == v or len(w) >= 4 and len(v) >= 4 and (w.startswith(v) or v.startswith(w)) for v in c) for w in q) / len(q)


@pytest.mark.parametrize("seed", range(2))
def test_best_of_a_prefix(spark, seed):
    rng = random.Random(seed)
    parts = ["shared", "shareds", "acme", "acm", "ab", "7", "42", "market", "mark", "x"]
    draw = lambda: "".join(rng.choice(["shared", "shared", "acmeab", "market"]) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 3))))
    queries, index = {draw() for _ in range(80)}, {draw() for _ in range(80)}
    queries -= index
    frame = lambda keys, name: spark.createDataFrame([(k,) for k in sorted(keys)], f"{name} string")
    got = {r["query"]: (r["key"], round(r["score"], 9)) for r in resolution.by_prefix(frame(queries, "query"), frame(index, "key")).collect()}
    want = {}
    for q in queries:
        near = [(-plain_score(q, k), k) for k in index if k[:6] == q[:6] and plain_score(q, k) >= 0.6]
        if near and len(q) >= 6:
            want[q] = (min(near)[1], round(-min(near)[0], 9))
    assert got == want


def test_levels(spark):
    texts = [(1, 0, "sharedname"), (2, 0, "sharednamex"), (2, 1, "other"), (3, 0, "paymenttoowner"), (4, 0, "a"), (4, 1, "other"), (5, 0, "unknownatall"), (6, 0, "shared"), (6, 1, "sharedname")]
    d = spark.createDataFrame(texts, "descriptor_id int, place int, key string")
    i = spark.createDataFrame([("sharedname", "E1"), ("sharedname", "E0"), ("other", "E2"), ("abc", "E3")], "key string, entity_id string")
    o = spark.createDataFrame([("owner", "O1"), ("own", "O0")], "key string, entity_id string")
    got = {r["descriptor_id"]: (r["entity_id"], r["level"], round(r["score"], 3)) for r in resolution.resolve(d, i, o).collect()}
    assert got == {1: ("E0", "exact", 1.0), 2: ("E0", "prefix", round(10 / 11, 3)), 3: ("O1", "owner", 1.0), 4: ("E2", "exact", 1.0), 6: ("E0", "prefix", 0.6)}
    assert resolution.resolve(d.filter("false"), i, o).count() == 0


def plain_key(s):
    return re.sub("[^a-z0-9]", "", re.sub("([a-z])([A-Z])", r"\1 \2", s).lower())


def plain_alias(a, b):
    x, y = plain_key(a), plain_key(b)
    if x == y:
        return True
    if min(len(x), len(y)) < 3:
        return False
    same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return x in y or y in x or same >= min(len(x), len(y)) * 0.85


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_similarity(a, b):
    x, y = a.strip().lower(), b.strip().lower()
    near = 1 if x == y else 0 if not x or not y else 1 - edit(x, y) / max(len(x), len(y))
    u, v = ({w for w in re.split(" +", re.sub("[^a-z0-9 ]", " ", s)) if len(w) > 1} for s in (x, y))
    return 0.4 * near + 0.6 * (len(u & v) / len(u | v) if u | v else 1)


@pytest.mark.parametrize("seed", range(2))
def test_cascade(spark, seed):
    from tidemark.operators import cascade

    rng = random.Random(seed)
    words = ["Northern", "Harbour", "Supply", "Tea", "Works", "and", "Sons", "Co", "Ltd", "x"]
    name = lambda: " ".join(rng.sample(words, rng.randint(1, 6)))
    known = sorted({" ".join(rng.sample(words, rng.randint(4, 6))) for _ in range(30)})
    asked = set()
    for k in known:
        asked |= {k, k.upper(), k + " Ltd", k[:-1], " ".join(rng.sample(k.split(), len(k.split()))), k.replace("a", "e", 1), name()}
        w = k.split()
        asked |= {" ".join([*w[:1], *w[2:3], *w[1:2], *w[3:]]), " ".join([*w[:-2], *w[-1:], *w[-2:-1]])}
    asked |= {"", "a", "Zz top"}
    want = {}
    for a in asked:
        if len(plain_key(a)) < 2:
            continue
        for level, test in (("exact", lambda a, k: plain_key(a) == plain_key(k)), ("alias", plain_alias), ("similar", lambda a, k: plain_similarity(a, k) >= 0.85)):
            hit = next((k for k in known if plain_key(k) and test(a, k)), None)
            if hit:
                want[a] = (hit, level)
                break
    frame = lambda names: spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = {r["name"]: (r["known_name"], r["level"]) for r in cascade.matched(frame(asked), frame(known)).collect()}
    assert got == want
    assert {x for _, x in want.values()} == {"exact", "alias", "similar"}
