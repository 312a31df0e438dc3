"""The nearest expectations of each payment, by amount and date together: the few best of each, never all pairs.

How far a payment is from an expectation: by how much their ratio differs from 1, and their days apart as a share of the days allowed. On one day the amounts next to a payment's own,
above and below, are nearer than all others, so a payment looks at ``count`` amounts on either side of each day and not at all that lie within five percent. Expectations
of one day and amount are one kind, of which the ``count`` least ids stand for all.

Rows meet in cells: of one key (an entity) or, for payments without one, of all expectations of like amount, and of a stretch of dates. A payment goes to all cells that its days and its
five percent reach. A task holds a few cells at a time, and of a kind ``count`` rows alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The least and the largest ratio in percent, the width of a cell's amounts, how near to the last kept one others are kept too (ranks round at nine digits), rows and pairs held at once.
LOW, HIGH, WIDTH, MARGIN, ROWS, PAIRS = 95, 105, math.log(1.25), 1e-8, 200_000, 2_000_000


def _kept(probe: np.ndarray, kind: np.ndarray, far: np.ndarray, size: np.ndarray, count: int) -> np.ndarray:
    """Places of the pairs of each probe up to the kind that fills ``count``, and of those as good within the margin."""
    order = np.lexsort((kind, far, probe))
    p, f, s = probe[order], far[order], np.minimum(size[kind[order]], count)
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    of = np.cumsum(np.r_[True, p[1:] != p[:-1]]) - 1 if len(p) else first
    total = np.cumsum(s)
    so_far = total - (total[first] - s[first])[of]
    limit = np.full(len(first), np.inf)
    full = np.flatnonzero(so_far >= count)[::-1]
    limit[of[full]] = f[full]  # the first that fills comes last
    return order[f <= limit[of] + MARGIN]


def search(items: tuple[np.ndarray, ...], probes: tuple[np.ndarray, ...], days: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (probe, kind), the nearest of each probe; items: cell, day, cents and size of each kind, in order; probes: cell, day, cents and reach, the distance that they allow."""
    cell, day, cents, size = items
    pc, pd, pa_, reach = probes
    if not len(cell) or not len(pc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, span = min(day.min(), pd.min()) - days - 1, int(max(day.max(), pd.max()) - min(day.min(), pd.min())) + 2 * days + 3
    at = cell * span + (day - low)
    runs = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # a run: the kinds of one cell and day
    run_at, ends = at[runs], np.r_[runs[1:], len(at)]
    near = np.minimum(days, np.floor(days * reach + 1e-9)).astype(np.int64)
    from_run, to_run = np.searchsorted(run_at, pc * span + (pd - low) - near), np.searchsorted(run_at, pc * span + (pd - low) + near, "right")
    begin, end = np.r_[runs, len(at)][from_run], np.r_[runs, len(at)][to_run]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def far(p: np.ndarray, k: np.ndarray) -> np.ndarray:
        d = np.abs(pa_[p] / cents[k] - 1) + np.abs(day[k] - pd[p]) / days
        return np.where((100 * pa_[p] >= LOW * cents[k]) & (100 * pa_[p] <= HIGH * cents[k]), d, np.inf)

    def add(p: np.ndarray, k: np.ndarray) -> None:
        d = far(p, k)
        ok = d <= reach[p] + MARGIN
        p, k, d = p[ok], k[ok], d[ok]
        best = _kept(p, k, d, size, count)
        found.append((p[best], k[best], d[best]))

    # Where a probe reaches few kinds, all of them are looked at; else those next to its amount on each day.
    many = end - begin > 4 * count * (to_run - from_run)
    few = np.flatnonzero(~many & (end > begin))
    for part in np.array_split(few, max(1, math.ceil(int((end - begin)[few].sum()) / PAIRS))):
        n = (end - begin)[part]
        p = np.repeat(part, n)
        add(p, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[p])
    rest = np.flatnonzero(many)
    for part in np.array_split(rest, max(1, math.ceil(int((to_run - from_run)[rest].sum()) * 2 * count / PAIRS))):
        n = (to_run - from_run)[part]
        p = np.repeat(part, n)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + from_run[p]
        place = _place(cents, runs[run], ends[run], pa_[p])
        pairs = []
        for step, edge in ((1, ends[run]), (-1, runs[run] - 1)):
            q, k, e = p, place if step == 1 else place - 1, edge
            last = np.full(len(q), np.inf)
            for j in range(10**9):
                ok = (k < e) if step == 1 else (k > e)
                q, k, e, last = q[ok], k[ok], e[ok], last[ok]
                d = far(q, k)
                ok = (d <= reach[q] + MARGIN) & (d <= last + MARGIN)
                q, k, e, last, d = q[ok], k[ok], e[ok], last[ok], d[ok]
                if not len(q):
                    break
                pairs.append((q, k))
                if j == count - 1:
                    last = d  # from here on only what is as good within the margin
                k = k + step
        if pairs:
            add(np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, k, _ = (np.concatenate([x[i] for x in found]) for i in range(3))
    return p, k


def _place(cents: np.ndarray, low: np.ndarray, high: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """The first place of each run at which the amount is not below: a binary search in all runs at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = open_ & (cents[np.minimum(mid, len(cents) - 1)] < amount)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


_CELL = ["key", "scale", "block"]


def _searched(batches: Iterator[pa.RecordBatch], days: int, count: int) -> Iterator[pa.RecordBatch]:
    def out(t: pa.Table, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        get = lambda c: t[c].to_numpy()
        side, day, cents = get("side"), get("day").astype(np.int64), get("cents")
        item = np.flatnonzero(side == 0)
        probe = np.flatnonzero(side == 1)
        new = np.r_[True, (cell[item][1:] != cell[item][:-1]) | (day[item][1:] != day[item][:-1]) | (cents[item][1:] != cents[item][:-1])] if len(item) else np.zeros(0, bool)
        kind = np.flatnonzero(new)
        size = np.minimum(np.diff(np.r_[kind, len(item)]), count)
        of = item[kind]
        p, k = search((cell[of], day[of], cents[of], size), (cell[probe], day[probe], cents[probe], get("reach")[probe]), days, count)
        n = size[k]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, to = probe[np.repeat(p, n)], item[np.repeat(kind[k], n) + each]
        for i in range(0, len(row), ROWS):
            a, b = row[i : i + ROWS], to[i : i + ROWS]
            ids = t["id"].combine_chunks()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(cents[a]), pa.array(cents[b]), pa.array(np.abs(day[a] - day[b]).astype(np.int32)), pa.array(get("who")[a])], ["movement_id", "event_id", "paid", "due", "gap", "who"])

    def numbered(t: pa.Table) -> np.ndarray:
        """Cells as whole numbers, counted on where one differs from the row before."""
        differs = np.zeros(len(t), bool)
        for c in _CELL:
            x = t[c].combine_chunks()
            x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
            x = x.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(x.type) else x.to_numpy()
            differs[1:] |= x[1:] != x[:-1]
        return np.cumsum(differs)

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS:
            t = pa.Table.from_batches(held)
            cell = numbered(t)
            last = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if last:
                yield from out(t.slice(0, last), cell[:last])
                held, rows = t.slice(last).combine_chunks().to_batches(), len(t) - last
    if held:
        t = pa.Table.from_batches(held)
        yield from out(t, numbered(t))


def nearest(probes: DataFrame, items: DataFrame, days: int, count: int, farthest: tuple[float, float]) -> DataFrame:
    """movement_id, event_id, paid and due (cents), gap (days) and who of the pairs among which the ``count`` best of each payment are, by any rank that falls with the distance and then takes the least id.

    probes: id, key (or null: any), amount, date, reach (the distance that is allowed) and who, which is passed on; items: id, key, amount, date. farthest: the largest reach of probes with and without
    key, whose days set how long cells are. Only amounts above nothing and dates that are there meet.
    """
    cents, day = F.round(F.col("amount") * 100).cast("long"), F.datediff("date", F.lit("1970-01-01").cast("date"))
    length = [4 * min(days, math.floor(days * max(0.0, x) + 1e-9)) + 8 for x in farthest]
    block = lambda d, n: F.floor(d / n).cast("int")
    scale = lambda c: F.floor(F.log(c.cast("double")) / WIDTH).cast("int")
    probes = probes.filter("amount > 0 and date is not null and reach >= 0").select("id", "key", cents.alias("cents"), day.alias("day"), "reach", "who")
    items = items.filter("amount > 0 and date is not null").select("id", "key", cents.alias("cents"), day.alias("day"))
    far = F.least(F.lit(days), F.floor(F.col("reach") * days + 1e-9)).cast("int")
    blocks = lambda n: F.sequence(block(F.col("day") - far, n), block(F.col("day") + far, n))
    scales = F.sequence(scale(F.col("cents") / 1.0501), scale(F.col("cents") / 0.9499))
    no = F.lit(0).cast("int")
    own = probes.filter("key is not null").withColumn("scale", no).withColumn("block", F.explode(blocks(length[0])))
    any_ = probes.filter("key is null").withColumn("key", F.lit("")).withColumn("scale", F.explode(scales)).withColumn("block", F.explode(blocks(length[1])))
    cells = F.array(F.struct(F.concat(F.lit("="), "key").alias("key"), no.alias("scale"), block(F.col("day"), length[0]).alias("block")), F.struct(F.lit("").alias("key"), scale(F.col("cents")).alias("scale"), block(F.col("day"), length[1]).alias("block")))
    there = items.withColumn("cell", F.explode(cells)).select(F.col("cell.key").alias("key"), "cell.scale", "cell.block", F.lit(0).alias("side"), "day", "cents", "id")
    asked = own.withColumn("key", F.concat(F.lit("="), "key")).unionByName(any_).select(*_CELL, F.lit(1).alias("side"), "day", "cents", "id", "reach", "who")
    rows = there.unionByName(asked, allowMissingColumns=True)
    rows = rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "side", "day", "cents", "id").select(*_CELL, "side", "day", "cents", "id", F.coalesce("reach", F.lit(0.0)).alias("reach"), F.coalesce("who", F.lit(0.0)).alias("who"))
    return rows.mapInArrow(lambda batches: _searched(batches, days, count), "movement_id string, event_id string, paid long, due long, gap int, who double")
