"""Operator 3: personal data by base patterns and a character-level BiLSTM-CRF.

Base patterns find what they define, in linear time, in the whole text. The model (see
:mod:`char_crf`) adds spans of all four kinds that they miss: telephone numbers without a plus sign, numbers whose match a neighbour spoils,
addresses with letters beyond ASCII, IPv6 addresses, cards with other separators or an expiry date after them. Every kind needs a digit
or an at sign (of any script, full width too), so the model reads the stretches around those characters: ``REACH`` characters
on either side, merged where they meet, in overlapping windows whose scores are reconciled before one decoding
of the whole stretch. A text without these characters holds nothing that the model is trained for. A span of the model's has a score, the mean
probability of its tags; it counts if it overlaps no base span and its score passes its kind's cutoff, the least that gives
a precision of ``PRECISION`` on labelled examples kept out of training (a kind that never reaches it adds nothing). Cards must have 13 to 19 digits that pass Luhn, and telephone numbers 7 to 15 digits.

The model is trained from labelled spans: drawn examples, which include forms that no base pattern has, and windows of at most ``SAMPLED`` documents
(at most ``PER_DOCUMENT`` of each) labelled by the base patterns. There is no shuffle. Null texts count as empty; repeated rows each give a row;
an empty table gives an empty table; columns to keep may have any name.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import char_crf

KINDS = ("email", "ip", "card", "phone")
WINDOW, REACH, SAMPLED, PER_DOCUMENT, PRECISION = 64, 24, 400, 6, 0.98
#: Characters of a stretch that are decoded at once, and what neighbouring parts of a longer one share.
PART, SHARED = 1 << 15, 128

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would have started at the run's head.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[\d@＠]")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """Each at sign with the whole run of local characters before it, from the last match on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[list[Span]]:
    """The base spans of each kind, in order."""
    found: list[list[Span]] = [[], [], [], []]
    if "@" in text:
        found[0] = _emails(text)
    if _TRIGGER.search(text) is None:
        return found
    small = lambda x: len(y := x.lstrip("0")) < 3 or len(y) == 3 and y <= "255"
    found[1] = [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    found[2] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def stretches(text: str) -> list[Span]:
    """The stretches around digits and at signs."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _covered(text: str, a: int, b: int, starts: list[int], ends: list[int]) -> bool:
    """Whether every digit and at sign of a stretch lies in the union of spans."""
    at, i = a, bisect_right(ends, a)
    while at < b:
        s = min(starts[i], b) if i < len(starts) else b
        if s > at and _TRIGGER.search(text, at, s):
            return False
        at = ends[i] if i < len(starts) else b
        i += 1
    return True


def _parts(a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """First and last place of each part of a stretch, and the places where its spans may start."""
    for k in range(a, b, PART):
        yield max(a, k - SHARED), min(b, k + PART + SHARED), k, min(b, k + PART)


def _tagged(tags: np.ndarray, chance: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """Kind, start, end and score of each tagged span."""
    i, at = 0, np.flatnonzero(tags).tolist()
    while i < len(at):
        start = at[i]
        kind, j = (int(tags[start]) - 1) // 2, start + 1
        while j < len(tags) and tags[j] == 2 * kind + 2:
            j += 1
        yield kind, start, j, float(chance[start:j].mean())
        while i < len(at) and at[i] < j:
            i += 1


def added(model: dict, texts: list[str], known: list[list[list[Span]]]) -> list[list[list[Span]]]:
    """The model's spans of each kind in each text that overlap no base span; all stretches run together."""
    out: list[list[list[Span]]] = [[[], [], [], []] for _ in texts]
    where, pieces = [], []
    unions = [_merged([s for spans in found for s in spans]) for found in known]
    for i, text in enumerate(texts):
        for a, b in stretches(text):
            if not _covered(text, a, b, *unions[i]):
                for part in _parts(a, b):
                    where.append((i, *part))
                    pieces.append(char_crf.classes(text[part[0] : part[1]]))
    if not pieces:
        return out
    for (i, a, _, lo, hi), (tags, chance) in zip(where, char_crf.decode(model, char_crf.joined(model, pieces, WINDOW)), strict=True):
        starts, ends = unions[i]
        for kind, s, e, score in _tagged(tags, chance):
            s, e = a + s, a + e
            k = bisect_right(ends, s)
            free = k == len(starts) or starts[k] >= e
            if lo <= s < hi and free and score >= model["cutoffs"][kind] and _is_number(KINDS[kind], texts[i][s:e]):
                out[i][kind].append((s, e))
    return out


def _is_number(kind: str, s: str) -> bool:
    """Whether a span has the digits of its kind: cards 13 to 19 that pass Luhn, telephone numbers 7 to 15."""
    if kind not in ("card", "phone"):
        return True
    d = "".join(str(unicodedata.decimal(c)) for c in s if c.isdecimal())
    return 7 <= len(d) <= 15 if kind == "phone" else 13 <= len(d) <= 19 and _luhn(d)


def _drawn(rng: random.Random) -> tuple[str, str]:
    """A text of a kind and the kind, or of none: dates, prices, versions, codes."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda letters="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    beyond = "abcdefghijklmnopqrstuvwxyzéüñöèçßйкл"
    kind = rng.choice(["email", "ip", "card", "phone", "phone", "", ""])
    sep = rng.choice(" .-")
    if kind == "email":
        letters = rng.choice([beyond, "abcdefghijklmnopqrstuvwxyz"])
        local = rng.choice([w(letters) + rng.choice("._-") + w(letters), w(letters) + d(2), w(letters), d(2)])
        return local + rng.choice("@@@＠") + w(letters) + rng.choice(["", d(1)]) + "." + rng.choice(["example.com", "com", "org", w(), w(letters)]), kind
    if kind == "ip":
        h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
        v4 = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return rng.choice([v4, v4, ":".join(h(rng.randint(1, 4)) for _ in range(8)), h(4) + "::" + ":".join(h(4) for _ in range(rng.randint(1, 5)))]), kind
    if kind == "card":
        digits = d(rng.choice([14, 15, 15, 15]))
        digits += next(c for c in "0123456789" if _luhn(digits + c))
        cut = rng.choice(["", " ", "-", ".", "/"])
        groups = [digits[:4], digits[4:10], digits[10:]] if len(digits) == 15 else [digits[k : k + 4] for k in range(0, 16, 4)]
        return cut.join(groups), kind
    if kind == "phone":
        forms = [
            f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", sep.join(["0" + d(1), d(2), d(2), d(2), d(2)]),
            f"0{d(3)} {d(7)}", f"00{d(2)} {d(3)} {d(6)}", f"+{d(2)}{d(9)}", f"0{d(2)}/{d(8)}",
        ]
        return rng.choice(forms), kind
    return rng.choice([
        f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)},{d(3)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", d(rng.randint(1, 8)), f'token = "{w("0123456789abcdef")}{w("0123456789abcdef")}{d(5)}"', f"{d(2)}/{d(2)}/{d(4)}",
        f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"{w()}@{w()}", f"{d(2)} - {d(2)}", f"{d(1)}.{d(1)}", f"No. {d(9)}", f"19{d(2)}-19{d(2)}", f"{d(2)}.{d(4)}, {d(1)}.{d(4)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(3)} {d(3)} {d(3)}",
        f"{d(2)}% ", f"{d(3)}-{d(4)}", f"{d(1)}.{d(1)}.{d(1)}.{d(4)}", f"EUR {d(1)}.{d(3)},{d(2)}", d(20), "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        rng.choice([" ", " ", "  ", "\t", ", "]).join(d(rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(4, 20))),
    ]), ""


def examples(sample: list[str], count: int = 2500, seed: int = 7, per_document: int = PER_DOCUMENT) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: classes and tags; tag 0 is none, then begin and inside of each kind."""
    rng, xs, ys = random.Random(seed), [], []
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuéè") for _ in range(rng.randint(1, 9)))

    def add(text: str, spans: list[tuple[int, int, int]], middle: int) -> None:
        tags = np.zeros(len(text), np.int64)
        for k, a, b in spans:
            tags[a:b], tags[a] = 2 * k + 2, 2 * k + 1
        a = max(0, min(len(text) - WINDOW, middle - rng.randrange(WINDOW)))
        part, tags = text[a : a + WINDOW], tags[a : a + WINDOW]
        if len(part) == WINDOW:
            xs.append(char_crf.classes(part))
            ys.append(tags)

    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randint(5, 12))) + rng.choice([" ", ". ", ", ", "\n", "."]), []
        for _ in range(rng.randint(1, 2)):
            s, kind = _drawn(rng)
            if kind:
                spans.append((KINDS.index(kind), len(text), len(text) + len(s)))
            middle = len(text) + len(s) // 2
            close = rng.random() < 0.3  # the next one, or an expiry date, follows at once
            text += s + (" " if close else rng.choice([" ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(rng.randint(4, 9))) + " ")
            if close and kind == "card":
                text += f"{rng.randint(10, 12)}/{rng.randint(24, 39)} "
        add(text + word() + " " * 12, spans, middle)
    for text in sample:
        found = base(text)
        found[2] = [m.span() for m in _CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]  # Luhn judges cards after the model
        spans = [(k, a, b) for k, some in enumerate(found) for a, b in some if not any(j < k and x < b and a < y for j, more in enumerate(found) for x, y in more)]
        for a, b in stretches(text)[:per_document]:
            add(text, spans, (a + b) // 2)
    return np.array(xs), np.array(ys)


def cutoffs(model: dict, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> np.ndarray:
    """For each kind the least score whose spans, and all with higher scores, are right in at least this share; spans that end at a window's edge do not count."""
    found: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    for gold, (tags, chance) in zip(y, char_crf.decode(model, list(char_crf.emissions(model, x))), strict=True):
        true = {s[:3] for s in _tagged(gold, np.ones(len(gold)))}
        for kind, a, b, score in _tagged(tags, chance):
            if a and b < len(gold):
                found[kind].append((score, (kind, a, b) in true))
    out = np.full(len(KINDS), 2.0)
    for kind, scored in enumerate(found):
        scored.sort(reverse=True)
        right = np.cumsum([r for _, r in scored])
        good = np.flatnonzero(right >= precision * np.arange(1, len(scored) + 1))
        if len(good) and good[-1] >= 20:
            out[kind] = scored[good[-1]][0]
    return out


def fit(docs: DataFrame, text_col: str = "text", sampled: int = SAMPLED, steps: int = 600) -> dict[str, np.ndarray]:
    """The model and its cutoffs, from drawn examples and at most ``sampled`` documents of at most 20,000 characters, those of the smallest hash."""
    text = F.col(text_col)
    keyed = docs.select(text.alias("t"), F.xxhash64(text).alias("h")).filter(text.rlike("[0-9@]") & (F.length(text) <= 20_000))
    chosen = [r["h"] for r in keyed.select("h").distinct().orderBy("h").limit(sampled).collect()]  # hashes first, so that no task sends texts that lose
    some = keyed.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("t").alias("t"))
    texts = sorted(r["t"] for r in some.collect())
    model = char_crf.train(*examples(texts[::2]), 2 * len(KINDS) + 1, hidden=20, steps=steps)
    return model | {"cutoffs": cutoffs(model, *examples(texts[1::2], seed=8))}


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def spans(docs: DataFrame, model: dict | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns to ``keep``, ``pii_spans`` (kind, start, end in code points, end exclusive, and base of every span, by kind as in ``KINDS``, then start) and ``pii_redacted``: the text with each span replaced by its kind in capitals and brackets, null where there is none."""
    model = model or fit(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text_col), F.lit("")).alias("pii_text"))
    kept = [f"keep_{i}" for i in range(len(keep))]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("pii_text").to_pylist()
            known = [base(t) for t in texts]
            found, clean = [], []
            for text, own_all, new_all in zip(texts, known, added(sent.value, texts, known), strict=True):
                every = [(k, s, e, is_base) for k, own, new in zip(KINDS, own_all, new_all, strict=True) for s, e, is_base in sorted([(*x, True) for x in own] + [(*x, False) for x in new])]
                found.append([dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in every])
                clean.append(redacted(text, every) if every else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, kind), pa.array(clean, pa.string())], [*kept, "pii_spans", "pii_redacted"])

    types = dict(rows.dtypes)
    found = rows.mapInArrow(find, ", ".join([*(f"{c} {types[c]}" for c in kept), f"pii_spans {_SPANS}", "pii_redacted string"]))
    return found.select(*(F.col(a).alias(b) for a, b in zip(kept, keep, strict=True)), "pii_spans", "pii_redacted")


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span (kind, start, end, base) replaced by its kind; of spans that overlap, the first and longest stands for all."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def base_count(kind: str, column: str = "pii_spans") -> Column:
    """The number of base spans of a kind."""
    return F.size(F.filter(column, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def digest(column: str = "pii_spans", base_only: bool = False) -> Column:
    """kind:start:end of the spans, joined by commas."""
    some = F.filter(column, lambda s: s["base"]) if base_only else F.col(column)
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
