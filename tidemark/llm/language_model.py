"""Operator 1: a hashed maximum-entropy language model with a class-factored softmax.

Tokens are the words of a text, A-Z lowered, then one end. Counts over all training texts give
the base score and the model's frame (:class:`Shape`): the most frequent tokens, the head, form classes
by rank, every other token belongs to a tail class by its last two bytes. The model is

    p(token | history) = p(class | history) x p(token | class, history)

Both factors are softmaxes over sums of rows of a hashed table, a row for each feature of the
history: none, the last token, the one before, the one before that (skips), and the last two together
(n-gram). Inside a tail class tokens follow their smoothed counts. Weights are trained by distributed
gradient updates: in each round every task takes AdaGrad steps over its share of the training
texts, and the tasks' changes are averaged row by row, weighted by how often each task met the row. A
round learns from a part of the training texts, and all rounds together learn from each of them once.

The frame grows with the training tokens n: head tokens and rows of the table as n^(1/4), classes, tail
classes and tokens of a class as n^(1/8), rounds as log10 n, so that a token costs n^(1/8) and the broadcast
tables n^(3/8). A round has the fewer tasks the more rounds there are, so all rounds together send as
many tables as there are partitions; the fan of the averaging follows the number of tasks.

Counts of the ``KNOWN`` most frequent tokens of at most ``KNOWN_BYTES`` are broadcast (a fixed bound); the
counts of all others meet their texts in a join on the token, which no frequent token of usual length enters.

A null text counts as empty and is its end alone. Repeated rows each give a row. Without training texts
every token is unseen and the model knows no more than the base.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt, log, log10
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Tokens whose counts are broadcast, and their greatest length.
KNOWN, KNOWN_BYTES = 131_072, 256
#: The end's token: empty, as no word is.
END = b""
STEP, RATE, FLUSH = 4096, 0.15, 200_000
#: Bytes of text that are looked up together.
CHUNK = 2 << 20
#: Sums of exponentials below this are made again from their own greatest term, and exponentials are at least ``LEAST``.
TINY, LEAST = 1e-20, 1e-37
#: Longest run of rows that is added up along with other runs.
LONG = 12


class Shape(NamedTuple):
    """What the model's size follows from: ``side`` head classes of ``side`` tokens each, and twice as many tail classes."""

    side: int
    rounds: int

    @classmethod
    def of(cls, n: int) -> Shape:
        """The shape for ``n`` training tokens."""
        return cls(max(8, round(3.5 * n**0.125)), 2 + max(0, round(log10(max(n, 1) / 1e7))))

    @property
    def head(self) -> int:
        return self.side**2

    @property
    def tails(self) -> int:
        return 2 * self.side

    @property
    def classes(self) -> int:
        return self.side + self.tails

    @property
    def start(self) -> int:
        """The context symbol of a text's start, after those of head tokens and tail classes."""
        return self.head + self.tails

    @property
    def rows(self) -> int:
        return 16 * self.head

    @property
    def row_type(self) -> np.dtype:
        return np.min_scalar_type(self.rows - 1)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in a row, and where those of each text end."""
    t = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # What follows the last space is empty, and so is the end.
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(t, ""), "", pc.binary_join_element_wise(t, "", " ")))
    return found.flatten().cast(pa.binary()), np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of consecutive texts that hold about ``CHUNK`` bytes at the most; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right"))
        yield texts.slice(a, max(b, a + 1) - a)
        a = max(b, a + 1)


def is_training(id_col: str = "id"):  # noqa: ANN201
    """Training texts: crc32 of the id's text modulo 5 is not 1."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 1


def token_counts(texts: DataFrame) -> DataFrame:
    """token and c over all texts; each task adds its own up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])
            held.clear()
            return b

        for b in batches:
            words, _ = split(b.column("text"))
            coded = words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            for t, c in zip(coded.dictionary.to_numpy(zero_copy_only=False), n.tolist(), strict=True):
                held[t] += c
            if len(held) > FLUSH:
                yield out()
        yield out()

    return texts.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _tail_class(last: bytes, tails: int) -> int:
    return zlib.crc32(last) % tails


def frame(counts: DataFrame) -> dict:
    """The bounded part of the counts: totals, the known tokens by rank, and the tail classes' totals."""
    scale = F.floor(F.log2("c") * 64)
    short = counts.filter(F.length("token") <= KNOWN_BYTES)
    steps = {int(r["s"]): r["n"] for r in short.groupBy(scale.alias("s")).agg(F.count("*").alias("n")).collect()}  # a row for each 1/64 of an octave
    most, cut = 0, 1 << 30
    for s in sorted(steps, reverse=True):
        if most + steps[s] > KNOWN:
            break
        most, cut = most + steps[s], s
    known = sorted(((bytes(r["token"]), r["c"]) for r in short.filter(scale >= cut).collect()), key=lambda x: (-x[1], x[0]))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    shape = Shape.of(int(total["n"]))
    tail_class = F.pmod(F.crc32(F.expr("substring(token, greatest(1, length(token) - 1), 2)")), F.lit(shape.tails))
    tails = {int(r["k"]): (r["n"], r["v"]) for r in counts.groupBy(tail_class.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n, v = np.zeros(shape.tails), np.zeros(shape.tails)
    for k, (a, b) in tails.items():
        n[k], v[k] = a, b
    for token, c in known[: shape.head]:  # head tokens are in no tail class
        k = _tail_class(token[-2:], shape.tails)
        n[k], v[k] = n[k] - c, v[k] - 1
    return {"shape": shape, "n": int(total["n"]), "v": int(total["v"]), "tokens": [t for t, _ in known], "tails": np.array([_tail_class(t[-2:], shape.tails) for t, _ in known], np.int64), "c": np.array([c for _, c in known], np.float64), "tail_n": n, "tail_v": v}


class Reader:
    """Texts to arrays: rank (or -1), class and symbol of each token, and those of its history."""

    def __init__(self, f: dict) -> None:
        self.shape = shape = f["shape"]
        self.known = pa.array(f["tokens"], pa.binary())
        ranks = np.arange(len(f["tokens"]))
        self.klass = np.where(ranks < shape.head, ranks // shape.side, shape.side + f["tails"])
        self.symbol = np.where(ranks < shape.head, ranks, shape.head + f["tails"])

    def tail(self, words: pa.Array) -> np.ndarray:
        """The tail class of each word."""
        last = pc.binary_slice(words, -2, None).dictionary_encode()
        tails, one = self.shape.tails, last.dictionary.to_pylist()
        return np.array([_tail_class(x, tails) for x in one], np.int64)[last.indices.to_numpy()]

    def read(self, texts: pa.Array) -> dict:
        words, ends_at = split(texts)
        rank = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        klass, symbol = (x[rank] if len(x) else np.zeros(len(words), np.int64) for x in (self.klass, self.symbol))
        missing = np.flatnonzero(rank < 0)
        unknown = words.take(pa.array(missing))
        tails = self.tail(unknown)
        klass[missing], symbol[missing] = self.shape.side + tails, self.shape.head + tails
        starts = np.concatenate([[0], ends_at[:-1]])
        place = np.arange(len(words)) - np.repeat(starts, ends_at - starts)
        before = []
        for k in (1, 2, 3):
            s = np.full(len(words), self.shape.start, np.int64)
            s[k:] = symbol[:-k]
            s[place < k] = self.shape.start
            before.append(s)
        return {"rank": rank, "class": klass, "before": before, "starts": starts, "ends": ends_at, "missing": missing, "unknown": unknown}


def _hash(x: np.ndarray, salt: int, shape: Shape) -> np.ndarray:
    """A row of the table other than the first rows, which hold what needs no history."""
    h = (x.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (shape.classes + (((h >> np.uint64(32)) * np.uint64(shape.rows - shape.classes)) >> np.uint64(32))).astype(shape.row_type)


def class_rows(before: list[np.ndarray], shape: Shape) -> list[np.ndarray]:
    b1, b2, b3 = before
    both = b1 * (shape.start + 1) + b2
    return [np.zeros(len(b1), shape.row_type), *(_hash(x, k, shape) for k, x in enumerate((b1, b2, b3, both), 1))]


def word_rows(before: list[np.ndarray], klass: np.ndarray, shape: Shape) -> list[np.ndarray]:
    b1, b2, b3 = before
    both = b1 * (shape.start + 1) + b2
    return [klass.astype(shape.row_type), *(_hash(x * shape.side + klass, k, shape) for k, x in enumerate((b1, b2, b3, both), 5))]


def start(f: dict) -> dict[str, np.ndarray]:
    """Tables whose first rows hold the logarithms of the counts."""
    shape = f["shape"]
    classes, words = np.zeros((shape.rows, shape.classes), np.float32), np.zeros((shape.rows, shape.side), np.float32)
    head = np.zeros(shape.head)
    head[: min(shape.head, len(f["c"]))] = f["c"][: shape.head]
    head = head.reshape(shape.side, shape.side)
    classes[0] = np.log(np.concatenate([head.sum(1), f["tail_n"] + 0.5 * (f["tail_v"] + 1)]) + 1e-3)
    words[: shape.side] = np.log(head + 1e-3)
    return {"class": classes, "word": words}


def _softmax(table: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the summed rows, each up to a factor, and their sums, in the plain way."""
    z = sum(table[r].astype(np.float64) for r in rows)
    exps = np.exp(z - z.max(1, keepdims=True))
    return exps, exps.sum(1)


class Histories:
    """Runs of equal histories up to the token before the last: of the rows that they ask for only the skip to the token before varies in a run."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        none, last, skip, further, both = rows
        order = np.argsort(last, kind="stable")
        self.order = order = order[np.argsort(both[order], kind="stable")]
        new = np.zeros(len(order), bool)
        new[::STEP] = True  # so that blocks of tokens are whole runs
        parts = [r[order] for r in (none, last, skip, both)]
        for r in parts:
            new[1:] |= r[1:] != r[:-1]
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(order)))
        self.rows, self.further = [r[self.first] for r in parts], further[order]

    def products(self, exps: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        """The product of the rows of the runs ``a`` to ``b``, for each of their tokens."""
        one, *others = (r[a:b] for r in self.rows)
        z = exps.take(one, axis=0)
        for r in others:
            z *= exps.take(r, axis=0)
        return z.repeat(self.n[a:b], axis=0)


class Trainer:
    """AdaGrad steps on one table, which is held as exponentials of weights, each row up to a factor."""

    def __init__(self, table: np.ndarray) -> None:
        self.was = table
        self.exps = self._start()
        self.g2 = np.full(table.shape, 1e-2, np.float32)
        self.met = np.zeros(len(table), np.int64)
        self.at = np.zeros(len(table), np.int64)

    def _start(self) -> np.ndarray:
        return np.maximum(_powers(self.was)[1], np.float32(LEAST))

    def _update(self, u: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        """Weights change by d = -RATE * g / sqrt(g2), exponentials by exp(d) as (2 + d) / (2 - d), which at these d differ by 3e-4 at most."""
        x = g * g
        x += self.g2.take(u, axis=0)
        _whole(self.g2)[u] = _whole(x)
        np.sqrt(x, out=x)
        g = g * np.float32(RATE / 2)
        y = x - g
        x += g
        y /= x
        y *= self.exps.take(u, axis=0)
        _whole(self.exps)[u] = _whole(y)
        np.add.at(self.met, u, n)

    def step(self, rows: list[np.ndarray], target: np.ndarray) -> None:
        """One step; the last row of ``rows`` refines the second (n-gram and last token), so one order serves both."""
        order = np.argsort(rows[-1], kind="stable")
        order = order[np.argsort(rows[1][order], kind="stable")]
        none, last, *skips, both = rows = [r[order] for r in rows]
        first, n = _starts(last, both)
        top, m = _starts(last[first])
        met = np.add.reduceat(n, top)
        z = self.exps.take(last[first[top]], axis=0)
        single = none[0] == none[-1] and not (none != none[0]).any()
        if single:
            z *= self.exps[none[0]]
        else:
            skips.append(none)
        p = z.repeat(met, axis=0)
        for r in (both, *skips):
            p *= self.exps.take(r, axis=0)
        total = p @ np.ones(p.shape[1], np.float32)
        far = np.flatnonzero(~((total > TINY) & (total < 1 / TINY)))
        if len(far):  # rows that vanish, or would not be finite, are made from their own greatest term
            part = [r[far] for r in rows]
            used = np.unique(np.concatenate(part))
            p[far], total[far] = _softmax(np.log(np.maximum(self.exps[used], LEAST)), [np.searchsorted(used, r) for r in part])
        p *= (1 / total)[:, None]
        p[np.arange(len(p)), target[order]] -= 1
        g = _sums(p, None, first, n)
        upper = _sums(g, None, top, m)
        self._update(last[first[top]], upper, met)
        if single:
            self._update(none[:1], upper.sum(0, keepdims=True), np.array([len(p)]))
        u = both[first]
        self.at[u] = np.arange(len(u))  # of runs that share a row the last counts
        at = self.at[u]
        again = np.flatnonzero(at != np.arange(len(u)))
        while len(again):
            to, one = np.unique(at[again], return_index=True)
            g[to] += g[again[one]]
            n[to] += n[again[one]]
            n[again[one]] = 0
            again = np.delete(again, one)
        self._update(u, g, n)
        for r in skips:
            order = np.argsort(r, kind="stable")
            r = r[order]
            first, n = _starts(r)
            self._update(r[first], _sums(p, order, first, n), n)

    def changes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = np.flatnonzero(self.met)
        now, before = (np.log(np.maximum(x[u], np.float32(LEAST))) for x in (self.exps, self._start()))
        return u, now - before, self.met[u]


def _whole(x: np.ndarray) -> np.ndarray:
    """The rows of a table, each as one value that is copied whole."""
    return x.view(f"V{x.itemsize * x.shape[1]}").ravel()


def _starts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values in all columns starts, and its length."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _sums(x: np.ndarray, order: np.ndarray | None, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each run of rows of ``x`` in an order (None: its own): runs by falling length, so that the k-th rows of all that have one are added at once; long runs by themselves."""
    out = x.take(first if order is None else order[first], axis=0)
    more = np.flatnonzero(n > 1)
    by = more[np.argsort(-n[more], kind="stable")]
    if not len(by):
        return out
    at, sums = first[by], out.take(by, axis=0)
    runs = np.searchsorted(-n[by], -np.arange(1, LONG + 2), side="right")
    long, ones = runs[LONG], np.ones(len(x), x.dtype)
    for k in range(1, LONG):
        if (some := runs[k]) == long:
            break
        a = at[long:some] + k
        sums[long:some] += x.take(a if order is None else order[a], axis=0)
    for i, (a, m) in enumerate(zip(at[:long].tolist(), n[by[:long]].tolist(), strict=True)):
        np.dot(ones[:m], x[a : a + m] if order is None else x.take(order[a : a + m], axis=0), out=sums[i])
    _whole(out)[by] = _whole(sums)
    return out


#: Changes of a block of rows, in half floats: they are small beside the weights that they are added to.
_CHANGE = "block long, fan int, rows binary, met binary, change binary"
_BLOCK = 128


def _round(texts: DataFrame, f: dict, tables: dict) -> dict:
    """The tables after one round over ``texts``."""
    spark, shape = texts.sparkSession, f["shape"]
    parts = texts.rdd.getNumPartitions()
    tasks = max(1, min(parts, max(spark.sparkContext.defaultParallelism, parts // shape.rounds)))
    fan = isqrt(tasks - 1) + 1
    sent = spark.sparkContext.broadcast((f, tables))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, tables = sent.value
        reader, trainers = Reader(f), {k: Trainer(t) for k, t in tables.items()}
        seen = 0
        for b in batches:
            for some_texts in chunks(b.column("text")):
                r = reader.read(some_texts)
                for a in range(0, len(r["rank"]), STEP):
                    part = slice(a, a + STEP)
                    before, klass, rank = [s[part] for s in r["before"]], r["class"][part], r["rank"][part]
                    trainers["class"].step(class_rows(before, shape), klass)
                    head = np.flatnonzero((rank >= 0) & (rank < shape.head))
                    if len(head):
                        trainers["word"].step(word_rows([s[head] for s in before], klass[head], shape), rank[head] % shape.side)
                seen += len(some_texts)
        out = []
        own = TaskContext.get().partitionId() % fan
        for k, t in enumerate(trainers.values()):
            u, change, met = t.changes()
            for block in np.unique(u // _BLOCK) if seen else []:
                some = u // _BLOCK == block
                out.append((int(k * shape.rows + block), own, u[some].astype("<i4").tobytes(), met[some].astype("<i8").tobytes(), change[some].astype("<f2").tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["block", "fan", "rows", "met", "change"])

    changes = texts.select("text").coalesce(tasks).mapInArrow(work, _CHANGE)
    # Two levels, so that no task gathers the changes of all others.
    once = changes.groupBy("block", "fan").applyInPandas(_averaged, _CHANGE).withColumn("fan", F.lit(0))
    new = {k: t.copy() for k, t in tables.items()}
    names = list(tables)
    for r in once.groupBy("block", "fan").applyInPandas(_averaged, _CHANGE).collect():  # a bounded model
        rows = np.frombuffer(r["rows"], "<i4")
        t = new[names[r["block"] // shape.rows]]
        t[rows] += np.frombuffer(r["change"], "<f2").reshape(len(rows), -1)
    return new


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean change of each row of a block, weighted by how often each task met it."""
    rows = [np.frombuffer(x, "<i4") for x in pdf["rows"]]
    low = int(rows[0][0]) // _BLOCK * _BLOCK
    width = len(pdf["change"].iloc[0]) // 2 // len(rows[0])
    total, met = np.zeros((_BLOCK, width)), np.zeros(_BLOCK, np.int64)
    for r, m, c in zip(rows, pdf["met"], pdf["change"], strict=True):
        m = np.frombuffer(m, "<i8")
        total[r - low] += np.frombuffer(c, "<f2").reshape(len(r), width) * m[:, None]
        met[r - low] += m
    u = np.flatnonzero(met)
    change = (total[u] / met[u, None]).astype("<f2")
    first = pdf.iloc[0]
    return pd.DataFrame({"block": [first["block"]], "fan": [first["fan"]], "rows": [(u + low).astype("<i4").tobytes()], "met": [met[u].astype("<i8").tobytes()], "change": [change.tobytes()]})


def trained(texts: DataFrame, f: dict) -> dict:
    """The model's tables; ``texts``: id and text of the training documents."""
    tables = start(f)
    rounds = f["shape"].rounds
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(rounds))
    for k in range(rounds):
        tables = _round(texts.filter(part == k), f, tables)
    return tables


def _powers(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest weight of each row, and the exponentials of the others against it."""
    top = table.max(1)
    return top, np.exp(table - top[:, None])


def _logs(table: np.ndarray, rows: list[np.ndarray], target: np.ndarray, powers: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 of each target's softmax, in blocks; exponentials of sums are products of the rows' own, which are made once."""
    _, exps = powers or _powers(table)
    out = np.empty(len(target))
    if not len(target):
        return out
    h = Histories(rows)
    to = target[h.order]
    cuts = np.searchsorted(h.first, np.arange(0, len(to) + STEP, STEP)).tolist()
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        block = slice(k * STEP, (k + 1) * STEP)
        z, further = h.products(exps, a, b), exps.take(h.further[block], axis=0)
        total = np.einsum("ij,ij->i", z, further)
        at = np.arange(len(z)), to[block]
        own = z[at] * further[at]
        far = np.flatnonzero((total < TINY) | (own < TINY))
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.log(own.astype(np.float64) / total)
        if len(far):
            z, total = _softmax(table, [r[h.order[block][far]] for r in rows])
            with np.errstate(divide="ignore"):
                found[far] = np.log(z[np.arange(len(far)), at[1][far]]) - np.log(total)
        out[h.order[block]] = found
    return out / log(10)


_SCORED = "n_tokens long, n_known long, known_log double, model_log double, rest array<binary>, times array<long>"


def _first_scores(docs: DataFrame, f: dict, tables: dict) -> DataFrame:
    """What the broadcast counts and the model give; ``rest``: the tokens whose counts are not broadcast, ``times``: how often the text has each."""
    sent = docs.sparkSession.sparkContext.broadcast((f, tables))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, tables = sent.value
        reader, shape = Reader(f), f["shape"]
        powers = {k: _powers(t) for k, t in tables.items()}
        logs = np.append(np.log10(f["c"] + 0.5), 0.0)  # the last for tokens that the join will add
        tail = np.log10(f["tail_n"] + 0.5 * (f["tail_v"] + 1))
        for b in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for texts in chunks(b.column("text")):
                r = reader.read(texts)
                rank, klass, before = r["rank"], r["class"], r["before"]
                own = logs[rank]
                model = _logs(tables["class"], class_rows(before, shape), klass, powers["class"])
                is_head = (rank >= 0) & (rank < shape.head)
                head = np.flatnonzero(is_head)
                model[head] += _logs(tables["word"], word_rows([s[head] for s in before], klass[head], shape), rank[head] % shape.side, powers["word"])
                others = np.flatnonzero(~is_head)
                model[others] += own[others] - tail[klass[others] - shape.side]
                begin = r["starts"]
                columns[0] += (r["ends"] - begin).tolist()
                columns[1] += np.add.reduceat((rank >= 0).astype(np.int64), begin).tolist()
                columns[2] += np.add.reduceat(own, begin).tolist()
                columns[3] += np.add.reduceat(model, begin).tolist()
                cut = np.searchsorted(r["missing"], r["ends"]).tolist()
                unknown = r["unknown"].to_numpy(zero_copy_only=False)
                rest = [Counter(unknown[p:q]) for p, q in zip([0, *cut[:-1]], cut, strict=True)]
                columns[4] += [list(c) for c in rest]
                columns[5] += [list(c.values()) for c in rest]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_tokens", "n_known", "known_log", "model_log", "rest", "times"])

    return docs.select("id", "text").mapInArrow(score, f"id {dict(docs.dtypes)['id']}, {_SCORED}")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, learning from those outside the held-out fold."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = texts.filter(F.coalesce(is_training(), F.lit(True)))
    counts = common.written(token_counts(training), "counts")
    f = frame(counts)
    tables = trained(training, f)
    first = common.written(_first_scores(texts, f, tables).withColumn("row", F.monotonically_increasing_id()), "first")
    # ``rest`` holds only tokens below the known ones in frequency, so no token is hot.
    rest = first.select("row", F.inline(F.arrays_zip("rest", "times"))).toDF("row", "token", "n")
    logs = rest.join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    added = logs.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rest_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rest_known"))
    base = F.lit(log10(f["n"] + 0.5 * (f["v"] + 1)))
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    return first.drop("rest", "times").join(added, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce(~is_training(), F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(f["n"]).cast("long").alias("train_tokens"), (F.col("known_log") + rest_log - F.col("n_tokens") * base).alias("base_score"), (F.col("model_log") + rest_log).alias("score"),
    )
