"""Operator 13: the main text of pages by differencing against the nearest URLs of their hosts.

1. A page's markup gives its lines: the blocks of text of its article (or of the content, or of the whole page, where none is marked), without
   furniture that element names, classes, ids and roles mark. Only hashes of the lines leave the task; pages of one host and path with the same lines are one entry.
2. Entries are ordered by host, path and content, in ranges by sampled splitters, and numbered from counts of the ranges; ``BLOCK`` consecutive numbers
   are one group, with ``REACH`` entries of the groups on both sides. So a host with a third of all pages is many groups, and the result depends on the pages alone.
3. A page is paired with up to ``PAIRS`` nearest entries of its host. A copy, with nine tenths of the characters of both pages in common, is not a partner:
   its common lines are the article. Lines are aligned by a longest common subsequence, and a line that is common with at least half of the partners is deleted;
   in a marked article only one that is common with all of them, six at least, since articles may quote the same passage.
4. The few pages with deleted lines meet them by a key of host, path and lines.

A null html is empty: text '' of no characters. A null or relative url has no host, and its page no partners. Rows that repeat a page_id are pages of their own, with a row each.
A host's only page, and one whose neighbours within reach are all copies of it, keep all lines that markup leaves. An empty table gives an empty result. Other columns are never read.
A line is shared by its 64-bit hash. Alignments are exact whatever the pages' sizes and repeated lines; ``MOST_PAIRS`` bounds memory, not results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.page_blocks import lines

BLOCK, REACH, PAIRS = 64, 16, 8
#: Deleted lines' pages that come by a broadcast (about 50 MB), and equal pairs of lines that an alignment holds.
FEW, MOST_PAIRS = 500_000, 1_000_000


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", texts: bool = True) -> DataFrame:
    """Of every page: key, hashes and sizes of its lines, and whether an article is marked; with ``texts`` the page's columns and the lines themselves instead of sizes."""
    host, path = _place(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), path.alias("path"), F.col(f"`{html_col}`").alias("html"))
    names = ["id", "url", "key", "lines"] if texts else ["host", "path", "key", "hashes", "sizes", "article"]
    longs = "array<long>"
    schema = f"id {dict(rows.dtypes)['id']}, url string, key long, lines array<string>" if texts else f"host string, path string, key long, hashes {longs}, sizes {longs}, article boolean"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            columns: dict[str, list] = {n: [] for n in ("key", "lines", "hashes", "sizes", "article")}
            for host, path, html in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), b.column("html").to_pylist(), strict=True):
                found, article = lines(html or "")
                hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in found], np.uint64)
                seen = xxhash.xxh3_64(f"{host}\0{path}\0{article}\0")
                seen.update(hashes.tobytes())
                columns["key"].append(seen.intdigest() - (1 << 63))
                columns["lines"].append(found)
                columns["hashes"].append(hashes.view(np.int64))
                columns["sizes"].append([len(t) for t in found])
                columns["article"].append(article)
            kinds = {"key": pa.int64(), "lines": pa.list_(pa.string()), "hashes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "article": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[n]) if n in kinds else b.column(n) for n in names], names)

    return rows.mapInArrow(make, schema)


def _place(url):
    """Lower-case host without its port, and path without a closing slash or a file name's ending; null where there is no host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(path, r"(?:\.[A-Za-z0-9]{1,5})?/*$", "")
    return F.when(host != "", host), F.when(host != "", path)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: of all, that which ends earliest in ``b``, with the last line of ``a`` that fits each.

    Where lines repeat so often that pairs of equal ones are too many to hold, rows of bits give the same places.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    where = defaultdict(list)
    for j in range(lo, len(b) - end):
        where[b[j]].append(j)
    inner = [i for i in range(lo, len(a) - end) if a[i] in where]
    by_pairs = sum(len(where[a[i]]) for i in inner) <= MOST_PAIRS
    middle = _by_pairs([(i, where[a[i]]) for i in inner]) if by_pairs else _by_bits([a[i] for i in inner], b[lo : len(b) - end], inner)
    return [*range(lo), *middle, *range(len(a) - end, len(a))]


def _by_pairs(matches: list[tuple[int, list[int]]]) -> list[int]:
    """Places of the longest rising run of matches: place in a, and rising places of the same line in b."""
    tails: list[int] = []
    ends: list[tuple] = []
    for i, places in matches:
        for j in reversed(places):
            k = bisect_left(tails, j)
            node = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(node)
            else:
                tails[k], ends[k] = j, node
    out = []
    node = ends[-1] if ends else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _by_bits(a: list[int], b: list[int], places: list[int]) -> list[int]:
    """What :func:`_by_pairs` finds, in time len(a) * len(b) / 64: after i lines of ``a``, bit j is 0 where line j of ``b`` makes the subsequence longer.

    Each ``step``-th row of bits is kept, the rows between are made again on the way back, so memory is that of some 2 * sqrt(len(a)) rows.
    """
    met = set(a)
    b = [x for x in b if x in met]
    in_a, in_b = defaultdict(list), defaultdict(list)
    for i, x in enumerate(a):
        in_a[x].append(i)
    for j, x in enumerate(b):
        in_b[x].append(j)

    @lru_cache(256)
    def mask(x: int) -> int:
        bits = bytearray(len(b) // 8 + 1)
        for j in in_b[x]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    full, step = (1 << len(b)) - 1, isqrt(len(a)) + 1

    def after(row: int, x: int) -> int:
        same = row & mask(x)
        return ((row + same) | (row ^ same)) & full

    row, kept = full, [full]
    for i, x in enumerate(a, 1):
        row = after(row, x)
        if i % step == 0:
            kept.append(row)
    out, i, j, first, rows = [], len(a), len(b), len(a) + 1, []
    while True:
        if i < first:
            first = i // step * step
            rows = [kept[i // step]]
            for x in a[first:i]:
                rows.append(after(rows[-1], x))
        longer = (rows[i - first] ^ full) & ((1 << j) - 1)
        if not longer:
            return out[::-1]
        j = longer.bit_length() - 1
        same = in_a[b[j]]
        i = same[bisect_left(same, i) - 1]
        out.append(places[i])


class _Entry:
    def __init__(self, row: dict) -> None:
        self.host, self.key, self.article, self.home = row["host"], row["key"], row["article"], row["home"]
        self.hashes, self.sizes = row["hashes"], row["sizes"]
        self.count = Counter(self.hashes)
        self.size = dict(zip(self.hashes, self.sizes, strict=True))
        self.total = sum(self.sizes)

    def shared(self, other: _Entry) -> int:
        """Characters of the lines that both have, in any order."""
        few, many = sorted((self, other), key=lambda e: len(e.count))
        return sum(min(c, many.count[h]) * few.size[h] for h, c in few.count.items() if h in many.count)


def _partners(entries: list[_Entry], at: int) -> Iterator[tuple[_Entry, int]]:
    """The nearest entries of the host that are not copies, and the characters in common."""
    me, n = entries[at], 0
    for step in range(1, REACH + 1):
        for k in (at - step, at + step):
            if 0 <= k < len(entries) and entries[k].host == me.host and n < PAIRS:
                other = entries[k]
                both = me.shared(other)
                if 10 * both < 9 * max(me.total, other.total):
                    n += 1
                    yield other, both


def _deleted(entries: list[_Entry], at: int) -> list[int]:
    """Places of the lines of an entry that its partners have too."""
    me = entries[at]
    votes, pairs = Counter(), 0
    for other, both in _partners(entries, at):
        pairs += 1
        if both:
            votes.update(common_lines(me.hashes, other.hashes))
    least = max(6, pairs) if me.article else max(1, -(-pairs // 2))
    return sorted(i for i, v in votes.items() if v >= least)


def differences(entries: DataFrame) -> DataFrame:
    """key and gone (places of lines, from 0) of the entries with deleted lines; entries: host, path, key, hashes, sizes, article."""
    placed = common.written(entries.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("place", F.monotonically_increasing_id()), "ordered")
    # Upper bits of the place: the range; lower bits: the place in it. Counts of the ranges make them consecutive.
    part, low = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    numbered = placed.withColumn("part", part).join(F.broadcast(placed.sparkSession.createDataFrame(offsets, "part long, before long")), "part")
    numbered = numbered.withColumn("rank", F.col("before") + low).withColumn("home", F.floor(F.col("rank") / BLOCK).cast("long"))
    within = F.col("rank") % BLOCK
    also = F.array_compact(F.array(F.col("home"), F.when(within < REACH, F.col("home") - 1), F.when(within >= BLOCK - REACH, F.col("home") + 1)))
    grouped = numbered.select(F.explode(also).alias("block"), "rank", "home", "host", "key", "hashes", "sizes", "article")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            members, found = [_Entry(r) for r in rows], []
            for i, e in enumerate(members):
                if e.home == rows[0]["block"] and e.host is not None and e.hashes and (gone := _deleted(members, i)):
                    found.append((e.key, gone))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([g for _, g in found], pa.list_(pa.int64()))], ["key", "gone"])

        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and row["block"] != held[0]["block"]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    found = common.written(grouped.repartition("block").sortWithinPartitions("block", "rank").mapInArrow(compare, "key long, gone array<long>"), "gone")
    common.discard(placed)
    return found


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars of every page: the lines that are left, joined by an empty line."""
    entries = extracted(pages, id_col, url_col, html_col, texts=False).groupBy("key")
    entries = entries.agg(F.count("*").alias("pages"), *(F.first(c).alias(c) for c in ("host", "path", "hashes", "sizes", "article")))
    entries = common.written(entries, "entries")
    gone = differences(entries.drop("pages"))
    rows = extracted(pages, id_col, url_col, html_col)
    few = gone.count() <= FEW
    if few:
        found = rows.join(F.broadcast(gone), "key", "left")
    else:
        # Keys of more than 1/2000 of the pages are fewer than 2000 and meet their pages by a broadcast, all others by a shuffle.
        limit = max(1, pages.count() // 2000)
        hot = F.broadcast(entries.filter(F.col("pages") > limit).select("key").join(gone, "key", "left"))
        found = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(gone, "key", "left"))
    common.discard(entries)
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("gone", i.cast("long"))))
    found = found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(kept, "\n\n").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
