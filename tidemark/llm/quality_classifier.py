"""Operator 9: a quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good outside the held-out fold; unlabelled rows are documents outside
that fold, whatever their labels. A first logistic model of positives against unlabelled rows orders
the documents; the least ratio of the two distributions' upper tails estimates the share of positives among
unlabelled rows (the class prior). The final model minimises the non-negative unbiased
risk: prior x loss(positives, +) + max(0, loss(unlabelled, -) - prior x loss(positives, -)).

The positives are bounded by ``sampled`` rows and the unlabelled ones by ``unlabelled`` (those of the smallest hash, each a fixed
parameter of the fit); scoring reads every whole text. Inputs are the text's bytes alone. A null text counts as empty; repeated rows each
give a row; an empty table gives an empty table; columns to keep may have any name. Fewer positives mean a stronger decay of the
weights. Without a positive, or without an unlabelled row, nothing can be learned and every document scores 0.5; with one row of either
the prior cannot be estimated and is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Hashed word features, and positives and unlabelled rows of the fit at most.
BUCKETS, SAMPLED, UNLABELLED = 512, 6000, 6000

_KINDS = np.zeros((256, 9), np.float64)
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b, 0 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in " \t\r\x0b\x0c" else 5 if _c == "\n" else 6 if _c in "#*$%&|<>" else 7 if _c in ".,;:!?'\"()-" else 8] = 1
DENSE = _KINDS.shape[1] + 10


def features(texts: list[bytes]) -> np.ndarray:
    """A row of dense measures and hashed words for each text."""
    out = np.zeros((len(texts), DENSE + BUCKETS), np.float32)
    for i, t in enumerate(texts):
        n, low = max(1, len(t)), t.lower()
        w = low.split()
        distinct = set(w)
        lines = [x for x in t.split(b"\n") if x.strip()]
        pairs = len(set(zip(w, w[1:], strict=False)))
        out[i, : _KINDS.shape[1]] = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _KINDS / n
        nw = max(1, len(w))
        out[i, _KINDS.shape[1] : DENSE] = (
            np.log1p(len(w)) / 8, len(w) < 20, len(distinct) / nw, (pairs + 1) / nw, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 5,
            sum(len(x) == 1 and not x.isalnum() for x in w) / nw, min(5.0, n / nw / 6), min(5.0, nw / max(1, len(lines)) / 100), sum(x.isalpha() or x[0] >= 128 for x in distinct) / max(1, len(distinct)),
        )
        if distinct:
            at = np.fromiter((zlib.crc32(x) for x in distinct), np.uint32, len(distinct)) % BUCKETS
            out[i, DENSE:] = np.bincount(at, minlength=BUCKETS) / np.sqrt(len(distinct))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, n: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 800, rate: float = 0.03, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative risk under the logistic loss."""
    w = np.zeros(pos.shape[1] + 1)
    adam = Adam(len(w), rate)
    p1, u1 = np.c_[pos, np.ones(len(pos))], np.c_[unl, np.ones(len(unl))]
    for _ in range(steps):
        gp, gu = _sigmoid(p1 @ w), _sigmoid(u1 @ w)
        as_good = -(p1.T @ (1 - gp)) / len(p1)
        bad_risk = -np.log(1 - gu + 1e-9).mean() + prior * np.log(1 - gp + 1e-9).mean()
        as_bad = u1.T @ gu / len(u1) - prior * (p1.T @ gp) / len(p1)
        grad = prior * as_good + as_bad if bad_risk >= 0 else -as_bad  # past zero, the step undoes the overfit
        w = adam.step(w, grad + decay * np.r_[w[:-1], 0])
    return w


def prior_of(pos: np.ndarray, unl: np.ndarray) -> float:
    """The class prior: the least ratio of upper tails of a positive-against-unlabelled model's scores, over thresholds that keep half of the positives, on rows that model has not seen."""
    if min(len(pos), len(unl)) < 2:
        return 0.5
    half = len(pos) // 2, len(unl) // 2
    w = fit(pos[: half[0]], unl[: half[1]], 0.5, steps=200)
    score = lambda x: np.sort(x @ w[:-1] + w[-1])
    sp, su = score(pos[half[0] :]), score(unl[half[1] :])
    cuts = sp[: max(1, len(sp) // 2)]
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    return float(np.clip(np.min(above_u / above_p), 0.05, 0.99))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sampled: int = SAMPLED, unlabelled: int = UNLABELLED) -> dict:
    """The model: weights, scaling and prior.

    Rows without an id teach nothing. Of rows that repeat an id one text counts, whatever the order in which rows are read: that of the greatest features.
    """
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter((F.col("label") == 1) & fold).select("id").distinct()
    order = lambda df, most: df.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = [r["id"] for r in order(good, sampled).collect()]
    others = [r["id"] for r in order(texts.select("id").filter(fold).filter("id is not null").distinct(), unlabelled).collect()]
    kind = dict(texts.dtypes)["id"]
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, i in p, i in u) for p, u in [(set(ids), set(others))] for i in sorted(p | u)], f"id {kind}, good boolean, open boolean")
    drawn = texts.join(F.broadcast(wanted), "id").mapInArrow(_measure, f"id {kind}, good boolean, open boolean, x binary").collect()
    drawn = sorted({r["id"]: r for r in sorted(drawn, key=lambda r: bytes(r["x"]))}.values(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    rows = lambda some: np.array([np.frombuffer(r["x"], np.float16) for r in some], np.float64).reshape(len(some), DENSE + BUCKETS)
    pos, unl = rows([r for r in drawn if r["good"]]), rows([r for r in drawn if r["open"]])
    if not len(pos) or not len(unl):
        return {"w": np.zeros(DENSE + BUCKETS + 1), "mean": np.zeros(DENSE + BUCKETS), "scale": np.ones(DENSE + BUCKETS), "prior": 0.5}
    both = np.r_[pos, unl]
    mean, scale = both.mean(0), both.std(0) + 1e-2
    pos, unl = (pos - mean) / scale, (unl - mean) / scale
    prior = prior_of(pos, unl)
    return {"w": fit(pos, unl, prior, decay=max(1e-4, 3 / len(pos))), "mean": mean, "scale": scale, "prior": prior}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(common.utf8(b.column("text"))).astype(np.float16)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("good"), b.column("open"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "good", "open", "x"])


def scored(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns to ``keep`` and ``quality_score`` of every document: the model's chance that it is good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("quality_text"))
    types = dict(rows.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        w = m["w"][:-1] / m["scale"]
        bias = m["w"][-1] - float(m["mean"] @ w)
        for b in batches:
            z = features(common.utf8(b.column("quality_text"))) @ w + bias
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(_sigmoid(z), pa.float64())], [*names, "quality_score"])

    out = rows.mapInArrow(score, ", ".join([*(f"{n} {types[n]}" for n in names), "quality_score double"]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "quality_score")
