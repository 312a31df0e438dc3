from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import documents, texts
from tidemark.llm import char_crf, language_model, pii, quality_classifier


def brute_base(text):
    luhn = lambda d: sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    ]


def test_base_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(["@", ".", "a", "b.c", "1", "22", "255", "4111", " ", "-", "+", "(", ")", "é", "x@y.z", "4111111111111111", "+1 (555) 555-5555"]) for _ in range(rng.randint(0, 25)))
        assert pii.base(text) == brute_base(text), text


@pytest.fixture(scope="module")
def model(spark):
    docs = [f"words come here {d} and go there again" for d in ("call +1 (743) 555-3824 now", "mail ab.cd@mail7.example.com ok", "host 10.2.33.4 up", "on 2024-05-06 at 12:30 for 1,299.00")] * 5
    return pii.fit(documents(spark, docs))


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in char_crf.start(3, 3).items()}
    x, y = rng.integers(0, char_crf.CLASSES, (2, 5)).astype(np.uint8), rng.integers(0, 3, (2, 5))
    _, g = char_crf.gradients(p, x, y)
    for k in p:
        flat = p[k].ravel()
        for i in rng.integers(0, flat.size, 3):
            was, e = flat[i], 1e-4
            flat[i] = was + e
            up, _ = char_crf.gradients(p, x, y)
            flat[i] = was - e
            down, _ = char_crf.gradients(p, x, y)
            flat[i] = was
            assert g[k].ravel()[i] == pytest.approx((up - down) / (2 * e), abs=2e-2), k


def test_model_adds_and_spares(spark, model):
    clean = ["plain text without any", "built 2024-05-06 12:30:11 v1.2.3", 'token = "3fa4d5b21"', "it cost 1,299.00 or 300", None, ""]
    found = ["reach 4111 1111 1111 1111 soon", "ring (743) 555-3824 today please", "x a@b.co y"]
    rows = {r["doc_id"]: r for r in pii.spans(documents(spark, [*clean, *found]), model, keep=("doc_id", "text", "id")).collect()}
    assert all(not rows[i]["pii_spans"] for i in range(len(clean)))
    assert [s["kind"] for s in rows[6]["pii_spans"]] == ["card"]
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in rows[7]["pii_spans"]] == [("phone", 5, 19, False)]
    assert [s["kind"] for s in rows[8]["pii_spans"]] == ["email"]
    whole = [t for t in texts() if t]
    for r in pii.spans(documents(spark, whole), model, keep=("text",)).collect():
        assert [(s["start"], s["end"]) for s in r["pii_spans"] if s["base"]] == sum(brute_base(r["text"]), [])


def test_model_beats_base_patterns_on_held_out_examples(model):
    """Spans of examples of another seed: the model finds more than base patterns do, of every kind but e-mail at least half, and hardly errs."""
    x, y = pii.examples([], count=600, seed=99)
    found, right, wrong = [0] * 4, [0] * 4, 0
    for gold, (tags, chance) in zip(y, char_crf.decode(model, list(char_crf.emissions(model, x))), strict=True):
        inner = lambda spans, n=len(gold): {s for s in spans if s[1] and s[2] < n}
        true = inner(s[:3] for s in pii._tagged(gold, np.ones(len(gold))))
        got = inner(s[:3] for s in pii._tagged(tags, chance) if s[3] >= model["cutoffs"][s[0]])
        for kind, *_ in true:
            found[kind] += 1
        for s in true & got:
            right[s[0]] += 1
        wrong += len(got - true)
    assert wrong <= 0.03 * sum(right)
    assert all(2 * r > n for r, n in zip(right[1:], found[1:], strict=True))
    assert right[0] > 0


def test_decoding_in_batches_is_decoding_alone(model):
    rng = np.random.default_rng(3)
    parts = [char_crf.classes("".join(rng.choice(list("ab1@. +")) for _ in range(n))) for n in (3, 64, 65, 200, 64, 9)]
    together = char_crf.decode(model, char_crf.joined(model, parts, pii.WINDOW))
    for part, (tags, chance) in zip(parts, together, strict=True):
        ((one, c),) = char_crf.decode(model, char_crf.joined(model, [part], pii.WINDOW))
        assert (one == tags).all()
        assert np.allclose(c, chance, atol=1e-3)


def test_many_spans_take_linear_time(model):
    from time import process_time

    took = []
    for n in (2000, 8000):
        text = "".join(f"u{i}@mail.example.com and 2024-01-{i % 28 + 1:02d} " for i in range(n))
        start = process_time()
        (found,) = pii.added(model, [text], [pii.base(text)])
        took.append(process_time() - start)
        assert not found[0]
        assert pii.redacted(text, [("email", a, b, True) for a, b in pii.base(text)[0]]).count("[EMAIL]") == n
    assert took[1] < 8 * took[0] + 1


def test_full_width_and_parts(model, monkeypatch):
    text = "write to jo＠mail.com or ring ０４３-５５５-３８２４ soon"
    assert pii.stretches(text)
    monkeypatch.setattr(pii, "PART", 40)
    text = "x " * 30 + "ring (743) 555-3824 today " + "3 " * 60
    assert pii.added(model, [text], [pii.base(text)])[0][3] == [(65, 79)]


def test_redaction(spark, model):
    rows = ["a +1 (743) 555-3824 b x@y.zz", "née 10.0.0.1", "none"]
    got = pii.spans(documents(spark, rows), model, keep=("doc_id", "text")).select("doc_id", "text", "pii_redacted", pii.digest().alias("d"))
    out = {r["doc_id"]: (r["pii_redacted"] or r["text"], r["d"]) for r in got.collect()}
    assert out == {0: ("a [PHONE] b [EMAIL]", "email:22:28,phone:2:19"), 1: ("née [IP]", "ip:4:12"), 2: ("none", "")}
    assert pii.redacted("0123456789", [("card", 1, 4, True), ("phone", 3, 6, True), ("ip", 7, 8, True)]) == "0[CARD]6[IP]89"
    assert pii.spans(documents(spark, []), model).count() == 0


def test_quality_classifier(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(80)) if i % 5 else "## $$ %% | " * 20, i) for i in range(800)] + [(900, None, 1), (901, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score int")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 800, 2)], "doc_id long, quality int")
    model = quality_classifier.trained(docs, labels)
    assert 0.6 < model["prior"] <= 0.99
    got = {r["doc_id"]: r["quality_score"] for r in quality_classifier.scored(docs, model).collect()}
    held = [i for i in range(800) if zlib.crc32(b"%d" % i) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 5 > 0) for i in held) > 0.97 * len(held)
    assert all(0 <= x <= 1 for x in got.values())
    assert len(got) == 802
    fewer = quality_classifier.trained(docs, labels, sampled=120, unlabelled=300)["prior"]
    assert abs(fewer - model["prior"]) < 0.15  # the prior is stable against the sizes of the samples
    few = quality_classifier.trained(docs, labels.filter("doc_id in (2, 4, 6)"))
    assert {0.0 < r["quality_score"] < 1.0 for r in quality_classifier.scored(docs.limit(5), few).collect()} == {True}
    none = quality_classifier.trained(docs, labels.filter("quality = 0"))
    assert {r["quality_score"] for r in quality_classifier.scored(docs.limit(5), none).collect()} == {0.5}
    assert quality_classifier.scored(docs.limit(0), model).count() == 0


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(language_model, "KNOWN", 40)
    rng = random.Random(9)
    two = ["ein zwei drei vier".split(), "uno dos tres cuatro".split()]
    rows = [" ".join(rng.choice(two[i % 2]) if rng.random() < 0.9 else f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))) for i in range(300)] + [None, "", "Ünseen tokens here", "EIN zwei"]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in language_model.scored(docs).collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in rows]
    train = [i for i in range(len(rows)) if zlib.crc32(b"%d" % i) % 5 != 1]
    c = Counter(t for i in train for t in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, ts in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(ts), sum(c[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), abs=1e-6)
    held = [i for i in range(300) if i not in train]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert language_model.scored(documents(spark, [])).count() == 0


def test_language_model_sums_to_one(spark):
    """Both factors, and the tail classes' shares, at every history."""
    texts_ = ["a b c d", "b c e", "a a f"] * 9
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "id long, text string")
    f = language_model.frame(language_model.token_counts(docs))
    shape = f["shape"]
    tables = language_model.trained(docs, f)
    before = [np.array([x]) for x in (0, 3, shape.start)]
    z, total = language_model._softmax(tables["class"], language_model.class_rows(before, shape))
    p = (z / total[:, None])[0]
    assert p.sum() == pytest.approx(1, abs=1e-4)
    for klass in range(shape.side):
        rows = language_model.word_rows(before, np.array([klass]), shape)
        logs = [10 ** language_model._logs(tables["word"], rows, np.array([t]))[0] for t in range(shape.side)]
        assert sum(logs) == pytest.approx(1, abs=1e-4)


def test_language_model_grows():
    """Head tokens, rows and rounds follow the training tokens; the broadcast tables stay within memory at 10^13 tokens."""
    shapes = [language_model.Shape.of(n) for n in (0, 10**4, 10**6, 10**8, 10**10, 10**13)]
    for a, b in zip(shapes[1:], shapes[2:], strict=False):
        assert b.head > a.head and b.rows > a.rows and b.rounds >= a.rounds
    last = shapes[-1]
    assert last.rows * (last.classes + last.side) * 4 < 1 << 30 and last.head < language_model.KNOWN and last.rounds > 2


def test_language_model_wide_rows(spark, monkeypatch):
    """Rows beyond 16 bits, and tokens too long for the broadcast counts, give whole results."""
    monkeypatch.setattr(language_model.Shape, "of", classmethod(lambda cls, n: cls(91, 3)))
    rows = [f"a b c {'x' * 300} {i % 7}" for i in range(60)]
    got = {r["doc_id"]: r for r in language_model.scored(documents(spark, rows)).collect()}
    assert language_model.Shape.of(0).row_type == np.uint32
    c = Counter(t for i, t_ in enumerate(rows) if zlib.crc32(b"%d" % i) % 5 != 1 for t in [*t_.split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(rows):
        assert got[i]["base_score"] == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), None]), abs=1e-6)
        assert got[i]["score"] > got[i]["base_score"]


def test_language_model_arithmetic():
    """Sums of runs, softmaxes and logarithms as their plain forms have them, with rows so far apart that exponentials vanish."""
    rng = np.random.default_rng(4)
    x, keys = rng.normal(size=(600, 7)).astype(np.float32), np.concatenate([np.zeros(150, np.int64), rng.integers(1, 200, 450)])
    order = np.argsort(keys)
    first, n = language_model._starts(keys[order])
    got = language_model._sums(x, order, first, n)
    assert np.allclose(got, [x[keys == k].sum(0) for k in np.unique(keys)], atol=1e-4)
    for scale in (1, 60):
        table = (rng.normal(size=(50, 9)) * scale).astype(np.float32)
        rows, target = [np.zeros(300, np.uint16), *(rng.integers(0, 50, 300).astype(np.uint16) for _ in range(4))], rng.integers(0, 9, 300)
        z = sum(table[r].astype(np.float64) for r in rows)
        z -= z.max(1, keepdims=True)
        want = z[np.arange(300), target] - np.log(np.exp(z).sum(1))
        assert np.allclose(language_model._logs(table, rows, target), want / np.log(10), atol=1e-3)
        exps, total = language_model._softmax(table, rows)
        assert np.allclose(exps / total[:, None], np.exp(z) / np.exp(z).sum(1)[:, None], atol=1e-3)


def test_language_model_steps():
    """A step as plain AdaGrad takes it: a row that several histories share gets the sum of their gradients, and counts each."""
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(12, 5)).astype(np.float32)
    low = plain.copy()
    low[3, 2] = -200  # its exponential vanishes
    zero = np.zeros(90, np.uint16)
    for table, none in ((plain, zero), (plain, rng.integers(10, 12, 90).astype(np.uint16)), (low, zero), (plain * 15, zero)):
        # Rows of each feature apart, so that the order of features does not matter; last tokens meet in the same n-gram rows.
        rows = [none, *(rng.integers(a, b, 90).astype(np.uint16) for a, b in ((1, 4), (4, 6), (6, 8), (8, 10)))]
        target = rng.integers(0, 5, 90)
        trainer = language_model.Trainer(table)
        trainer.step(rows, target)
        z = sum(table[r].astype(np.float64) for r in rows)
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1)[:, None]
        p[np.arange(90), target] -= 1
        g = sum(np.array([p[r == k].sum(0) for k in range(12)]) for r in rows)
        want = -language_model.RATE * g / np.sqrt(1e-2 + g * g)
        u, change, met = trainer.changes()
        assert u.tolist() == sorted(set(np.concatenate(rows).tolist())) and met.tolist() == [sum(int((r == k).sum()) for r in rows) for k in u]
        assert np.allclose(change, want[u], atol=1e-3)


def test_language_model_reads(monkeypatch):
    """Tokens, ranks and tail classes as words of bytes give them, with awkward white space and signs."""
    texts = ["".join(map(chr, range(128))), "", " \t\n\x0b\x0c\r ", " A b  a\x1cB\x85c ", "Éa\u00a0b É a\u2028b\n", "x" * 300, "a", None]
    want = [[*(t or "").encode().lower().split(), b""] for t in texts]
    words, ends = language_model.split(pa.array(["no", *texts]).slice(1))
    assert words.to_pylist() == [w for ws in want for w in ws] and ends.tolist() == np.cumsum([len(ws) for ws in want]).tolist()
    monkeypatch.setattr(language_model, "CHUNK", 130)
    assert [len(c) for c in language_model.chunks(pa.array(texts))] == [2, 3, 1, 2] and not list(language_model.chunks(pa.array([], pa.string())))
    shape = language_model.Shape(2, 2)
    known = [b"a", b"", b"b", "éa".encode(), b"c", b"abc"]
    f = {"shape": shape, "tokens": known, "tails": np.array([language_model._tail_class(t[-2:], shape.tails) for t in known])}
    r = language_model.Reader(f).read(pa.array(texts))
    rank = {t: k for k, t in enumerate(known)}
    assert r["rank"].tolist() == [rank.get(w, -1) for w in words.to_pylist()] and r["unknown"].to_pylist() == [w for w in words.to_pylist() if w not in rank]
    assert r["class"].tolist() == [rank[w] // 2 if rank.get(w, 9) < 4 else 2 + language_model._tail_class(w[-2:], shape.tails) for w in words.to_pylist()]
