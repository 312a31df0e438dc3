"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters come in as classes, so the input layer is a table look-up. A window of
characters gives a score for each tag at each place; transitions between tags
are learned with them. Training maximises the likelihood of labelled windows by
back-propagation through the forward-backward pass and through time, with Adam steps.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Characters that are classes of their own; after them digits, a-z, A-Z, other letters, other spaces, the rest.
ALONE = "@.-+() _%\n,:;/=\"'#|<>"
CLASSES = len(ALONE) + 6


def _table() -> np.ndarray:
    t = np.full(128, len(ALONE) + 5, np.uint8)
    for c in range(128):
        ch = chr(c)
        if ch in ALONE:
            t[c] = ALONE.index(ch)
        elif ch.isdigit():
            t[c] = len(ALONE)
        elif ch.islower():
            t[c] = len(ALONE) + 1
        elif ch.isupper():
            t[c] = len(ALONE) + 2
        elif ch.isspace():
            t[c] = len(ALONE) + 4
    return t


_ASCII = _table()


def classes(text: str) -> np.ndarray:
    """The class of each code point; digits and full-width signs of any script have the class of their ASCII form."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points < 128, _ASCII[np.minimum(points, 127)], len(ALONE) + 3).astype(np.uint8)
    for c in np.unique(points[points >= 128]).tolist():
        plain = unicodedata.normalize("NFKC", chr(c))
        if chr(c).isdecimal() or len(plain) == 1 and plain < "\x80":
            out[points == c] = len(ALONE) if chr(c).isdecimal() else _ASCII[ord(plain)]
    return out


def start(hidden: int, tags: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Random weights: for each direction input table, recurrence and bias; output layer; transitions with start and end scores."""
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
        p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        p[f"b{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # open forget gates
    p["out"], p["bias"] = rng.normal(0, 0.3, (2 * hidden, tags)), np.zeros(tags)
    p["trans"], p["first"], p["last"] = np.zeros((tags, tags)), np.zeros(tags), np.zeros(tags)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(p: dict, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of one direction, in the order of its steps."""
    n = p[f"h{d}"].shape[0]
    h = c = np.zeros((x.shape[0], n), np.float32)
    out = np.empty((x.shape[1], x.shape[0], n), np.float32)
    table = p[f"x{d}"] + p[f"b{d}"]
    steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
    for k, t in enumerate(steps):
        a = table[x[:, t]] + h @ p[f"h{d}"]
        gates, g = _sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        was_h, was_c = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[k] = h
        if keep is not None:
            keep.append((t, i, f, o, g, was_h, was_c, tc))
    return out


def emissions(p: dict, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Tag scores (batch, time, tags) of windows of classes (batch, time)."""
    kf, kb = ([], []) if keep is not None else (None, None)
    hf, hb = _run(p, "f", x, kf), _run(p, "b", x, kb)[::-1]
    both = np.concatenate([hf, hb], 2).transpose(1, 0, 2)
    if keep is not None:
        keep |= {"f": kf, "b": kb, "both": both}
    return both @ p["out"] + p["bias"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf(p: dict, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, dict]:
    """Mean negative log-likelihood, and its gradients by emissions and transitions."""
    b, t, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[:, 0] = p["first"] + e[:, 0]
    for i in range(1, t):
        alpha[:, i] = _lse(alpha[:, i - 1, :, None] + p["trans"], 1) + e[:, i]
    beta[:, -1] = p["last"]
    for i in range(t - 2, -1, -1):
        beta[:, i] = _lse(p["trans"] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1] + p["last"], 1)
    rows = np.arange(b)
    gold = p["first"][y[:, 0]] + p["last"][y[:, -1]] + np.take_along_axis(e, y[..., None], 2)[..., 0].sum(1) + p["trans"][y[:, :-1], y[:, 1:]].sum(1)
    share = np.exp(alpha + beta - z[:, None, None])
    de = share.copy()
    np.put_along_axis(de, y[..., None], np.take_along_axis(de, y[..., None], 2) - 1, 2)
    pair = np.exp(alpha[:, :-1, :, None] + p["trans"] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
    np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    first, last = share[:, 0].sum(0), share[:, -1].sum(0)
    np.subtract.at(first, y[rows, 0], 1)
    np.subtract.at(last, y[rows, -1], 1)
    return float((z - gold).mean()), de / b, {"trans": pair / b, "first": first / b, "last": last / b}


def _back(p: dict, d: str, x: np.ndarray, dh_all: np.ndarray, kept: list) -> dict:
    """Gradients of one direction; ``dh_all``: (time, batch, hidden) by place."""
    n = p[f"h{d}"].shape[0]
    dh = dc = np.zeros((x.shape[0], n), np.float32)
    gh, steps, places = np.zeros_like(p[f"h{d}"]), [], []
    for t, i, f, o, g, was_h, was_c, tc in reversed(kept):
        dh = dh + dh_all[t]
        do, dc = dh * tc, dc + dh * o * (1 - tc * tc)
        da = np.concatenate([dc * g * i * (1 - i), dc * was_c * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], 1)
        steps.append(da)
        places.append(x[:, t])
        gh += was_h.T @ da
        dh, dc = da @ p[f"h{d}"].T, dc * f
    one = np.eye(CLASSES, dtype=np.float32)[np.concatenate(places)]
    gx = one.T @ np.concatenate(steps)
    return {f"x{d}": gx, f"h{d}": gh, f"b{d}": gx.sum(0)}


def gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """The loss of labelled windows and its gradient by every weight."""
    keep: dict = {}
    e = emissions(p, x, keep)
    loss, de, grads = _crf(p, e, y)
    both, n = keep["both"], p["hf"].shape[0]
    grads |= {"out": np.einsum("bth,btk->hk", both, de), "bias": de.sum((0, 1))}
    dh = (de @ p["out"].T).transpose(1, 0, 2)
    return loss, grads | _back(p, "f", x, dh[..., :n], keep["f"]) | _back(p, "b", x, dh[..., n:], keep["b"])


def train(x: np.ndarray, y: np.ndarray, tags: int, hidden: int = 12, steps: int = 300, batch: int = 48, rate: float = 0.02, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights fitted to labelled windows (windows, time)."""
    p, rng = start(hidden, tags, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, steps + 1):
        some = rng.integers(0, len(x), batch)
        _, grads = gradients(p, x[some], y[some])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        lr = rate * (1 - step / (steps + 1))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def _cells(lengths: list[int], most: int) -> list[list[int]]:
    """Places of stretches in batches of like length, whose padded size stays below ``most`` (a longer stretch stands alone)."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if out and lengths[i] * (len(out[-1]) + 1) <= most and lengths[i] <= 2 * lengths[out[-1][0]]:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def joined(p: dict, stretches: list[np.ndarray], window: int, batch: int = 2048) -> list[np.ndarray]:
    """Tag scores of stretches of classes: windows of all of them run together; they overlap by half, and each place takes their mean, weighted by its distance from their edges."""
    places: list[tuple[int, int]] = []
    rows: list[np.ndarray] = []
    weight = (np.minimum(np.arange(window), np.arange(window)[::-1]) + 1.0).astype(np.float32)
    total = [np.zeros((len(x), len(p["bias"])), np.float32) for x in stretches]
    mass = [np.zeros(len(x), np.float32) for x in stretches]

    def run() -> None:
        for (i, at), e in zip(places, emissions(p, np.array(rows)), strict=True):
            n = min(window, len(stretches[i]) - at)
            total[i][at : at + n] += e[:n] * weight[:n, None]
            mass[i][at : at + n] += weight[:n]
        places.clear()
        rows.clear()

    blank = len(ALONE) + 4
    for i, x in enumerate(stretches):
        for at in sorted({*range(0, len(x) - window + 1, window // 2), max(0, len(x) - window)}):
            part = x[at : at + window]
            places.append((i, at))
            rows.append(part if len(part) == window else np.concatenate([part, np.full(window - len(part), blank, np.uint8)]))
            if len(rows) == batch:
                run()
    if rows:
        run()
    return [t / m[:, None] for t, m in zip(total, mass, strict=True)]


def decode(p: dict, scores: list[np.ndarray], cells: int = 1 << 17) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each stretch the best tags, by one Viterbi pass over its reconciled scores, and the probability of each of them at its place."""
    found: list = [None] * len(scores)
    for some in _cells([len(x) for x in scores], cells):
        length = np.array([len(scores[i]) for i in some])
        e = np.zeros((len(some), length.max(), len(p["bias"])), np.float32)
        for k, i in enumerate(some):
            e[k, : length[k]] = scores[i]
        b, t, n = e.shape
        best, alpha = np.empty_like(e), np.empty_like(e)
        back = np.zeros(e.shape, np.int8)
        best[:, 0] = alpha[:, 0] = p["first"] + e[:, 0]
        for k in range(1, t):
            on = (k < length)[:, None]
            ways = best[:, k - 1, :, None] + p["trans"]
            back[:, k] = ways.argmax(1)
            best[:, k] = np.where(on, ways.max(1) + e[:, k], best[:, k - 1])
            alpha[:, k] = np.where(on, _lse(alpha[:, k - 1, :, None] + p["trans"], 1) + e[:, k], alpha[:, k - 1])
        tags = np.zeros((b, t), np.int8)
        rows = np.arange(b)
        beta = np.broadcast_to(p["last"], (b, n)).astype(np.float32)
        chance = np.zeros((b, t), np.float32)
        z = _lse(alpha[:, -1] + p["last"], 1)
        tag = (best[:, -1] + p["last"]).argmax(1)
        for k in range(t - 1, -1, -1):
            if k < t - 1:
                inner = k + 1 < length
                tag = np.where(inner, back[rows, k + 1, tag], tag)
                beta = np.where(inner[:, None], _lse(p["trans"] + (e[:, k + 1] + beta)[:, None, :], 2), beta)
            tags[:, k] = tag
            chance[:, k] = np.exp(alpha[rows, k, tag] + beta[rows, tag] - z)
        for k, i in enumerate(some):
            found[i] = tags[k, : length[k]], chance[k, : length[k]]
    return found
