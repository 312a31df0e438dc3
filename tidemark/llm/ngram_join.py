"""Operator 4: an exact n-gram Jaccard self-join by a token-group matrix.

A text's tokens are its distinct word shingles, as 64-bit values: the upper nine bits order long shingles
first (they are the rare ones), the other 55 are a hash of the words.

1. One pass counts frequent tokens in every task (whole partitions, no sample) and sums them up; those counted ``HOT`` times
   or more move to the end of every text's order. Any common order is right; a good one keeps lists short.
2. Texts with equal token sets are one class from here on, named by 64 bits of the set's digest (checked for collisions).
   A task hands on the tokens of a class once, however many copies it meets.
3. Two sets that link share a token among the first |x| - ceil(t|x|) + 1 of each (the prefix filter).
   Prefix tokens that no other class has are dropped.
4. Classes are partitioned into groups of similar texts: those with the same first shared token, in blocks of about ``GROUP`` classes.
   A class has a sketch: the number of its tokens in each hashed column, about one column a token. A group's union is the
   largest number that any member has in each column, so sums of least numbers bound overlaps with one member and with all.
5. Inside a group, members that the sketches let link are opened: their texts meet in one task, which compares whole sets and returns
   a star for each local component, never all pairs. Where a first shared token has many blocks, the roots of the
   stars are dealt into new blocks, round by round, so that a large cluster becomes one component in a number of steps
   that is logarithmic in its size.
6. The token-group matrix holds, for each token, the groups that have it. A query (class) meets groups of other components that share a
   prefix token with it; the group's union closes most of them, the members' sketches open the others, and again only the texts
   of what is open travel. A component beyond ``GROUP`` classes has groups of its own, and meets itself nowhere.
7. Connected components join the stars, by minimum labels and pointer jumping over written tables.

The bounds never lose a link and overlaps are counted on whole sets, so the result is exact but for collisions of
the 55 hash bits of two tokens. A text with fewer words than a shingle is one shingle; a text without words (null, empty) has no tokens,
links with nothing and is its own component. Every row is a document by itself: rows that repeat an id link by their own texts.
A component's id is its smallest id that is not null. An empty table gives an empty table; columns other than id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Classes in a group and queries of a chunk, tokens of either, and the frequent tokens: counted at least ``HOT`` times, at most so many (1.6 MB).
GROUP, CHUNK, UNIT_TOKENS, HOT, HOT_TOKENS = 64, 128, 1 << 21, 64, 200_000
#: Columns of a sketch: a power of two, about one for a token, within these limits.
FEWEST, MOST = 64, 1 << 17

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Shingler:
    """Texts to sorted arrays of distinct tokens; word hashes are kept up to a bound."""

    def __init__(self, width: int) -> None:
        self.width, self.kept = width, {}

    def tokens(self, text: bytes) -> np.ndarray:
        import xxhash

        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        kept = self.kept
        if len(kept) > 400_000:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        k = min(self.width, len(words))
        n = len(words) - k + 1
        x, total = np.full(n, k, np.uint64), np.zeros(n, np.int64)
        for i in range(k):
            x = (x ^ (h[i : i + n] * _M[i % 4])) * _M[(i + 1) % 4]
            x ^= x >> np.uint64(31)
            total += size[i : i + n]
        order = (255 - np.minimum(total, 255)).astype(np.uint64)
        return np.unique((order << np.uint64(55)) | ((x * _M[3]) >> np.uint64(9)))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sketch(tokens: np.ndarray) -> bytes:
    """Tokens in each hashed column, in one byte each (or four, where a number is large)."""
    columns = FEWEST
    while columns < MOST and columns < len(tokens):
        columns *= 2
    counts = np.bincount((tokens % np.uint64(columns)).astype(np.int64), minlength=columns)
    return b"\1" + counts.astype("u1").tobytes() if counts.max() < 256 else b"\4" + counts.astype("<u4").tobytes()


def _row(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "u1" if sketch[0] == 1 else "<u4", offset=1).astype(np.uint32)


def _folded(rows: np.ndarray, columns: int) -> np.ndarray:
    """Rows with fewer columns: column c takes all that agree with it modulo the new number."""
    return rows.reshape(*rows.shape[:-1], -1, columns).sum(-2, dtype=np.uint32) if rows.shape[-1] > columns else rows


def _prefix(tokens: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix in the common order, rare tokens and frequent ones apart."""
    n = len(tokens)
    p = n - -(-percent * n // 100) + 1
    if not len(hot):
        return tokens[:p], tokens[:0]
    is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
    rare = tokens[~is_hot][:p]
    return rare, tokens[is_hot][: p - len(rare)]


def frequent(texts: DataFrame, width: int) -> DataFrame:
    """token and c: what each task (or four million of its tokens) has three times or more, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, n = Shingler(width), [], 0

        def out() -> pa.RecordBatch:
            tokens, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].astype(np.int64)), pa.array(c[often].astype(np.int64))], ["token", "c"])

        for b in batches:
            for t in common.utf8(b.column("text")):
                held.append(shingler.tokens(t))
                n += len(held[-1])
                if n > 4_000_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def hot_tokens(counts: DataFrame, least: int) -> np.ndarray:
    """The tokens counted at least ``least`` times, the most frequent ``HOT_TOKENS`` at the most."""
    step = F.floor(F.log2("c") * 32)
    sizes = {int(r["s"]): r["n"] for r in counts.filter(F.col("c") >= least).groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    total, cut = 0, None
    for s in sorted(sizes, reverse=True):
        if total + sizes[s] > HOT_TOKENS:
            break
        total, cut = total + sizes[s], s
    if cut is None:
        return np.zeros(0, np.uint64)
    rows = counts.filter((F.col("c") >= least) & (step >= cut)).select("token").collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def prefixes(texts: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    """id, handle, n, key and digest of every text; for the first text of a class in its task the prefix (rare and frequent tokens apart) and sketch."""
    sent = texts.sparkSession.sparkContext.broadcast(hot)
    longs = pa.list_(pa.int64())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met, hot = Shingler(width), set(), sent.value
        for b in batches:
            out = []
            for t in common.utf8(b.column("text")):
                tokens = shingler.tokens(t)
                digest = _digest(tokens)
                row = (len(tokens), _key(digest), digest, None, None, None)
                if len(tokens) and digest not in met:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(digest)
                    rare, often = _prefix(tokens, hot, percent)
                    row = (*row[:3], rare.astype(np.int64), often.astype(np.int64), _sketch(tokens))
                out.append(row)
            kinds = (pa.int64(), pa.int64(), pa.binary(), longs, longs, pa.binary())
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("handle"), *columns], ["id", "handle", "n", "key", "digest", "rare", "often", "sketch"])

    return texts.mapInArrow(make, f"id {dict(texts.dtypes)['id']}, handle long, n long, key long, digest binary, rare array<long>, often array<long>, sketch binary")


def _streamed(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each key, from batches sorted by it."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _can_link(nx: np.ndarray, ny: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes link, or may link where ``overlap`` is an upper bound."""
    return overlap * (100 + percent) >= percent * (nx + ny)


class _Group:
    """The members of one group: their sketches in matrices of equal numbers of columns, and the union of each."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows, self.kept = rows, {}
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.comp = np.array([r["comp"] for r in rows], np.int64)
        sketches = [_row(r["sketch"]) for r in rows]
        self.columns = np.array([len(x) for x in sketches])
        self.parts = {}
        for c in np.unique(self.columns).tolist():
            at = np.flatnonzero(self.columns == c)
            self.parts[c] = at, np.array([sketches[i] for i in at])

    def _part(self, columns: int, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, matrix and union of the members with so many columns, folded."""
        if (columns, fold) not in self.kept:
            at, rows = self.parts[columns]
            rows = _folded(rows, fold)
            self.kept[columns, fold] = at, rows, rows.max(0)
        return self.kept[columns, fold]

    def near(self, q: dict, percent: int) -> np.ndarray:
        """Places of the members of other components that the bounds let link with a query."""
        row, found = _row(q["sketch"]), []
        for c in self.parts:
            fold = min(c, len(row))
            if max(c, len(row)) * percent > 200 * fold:
                continue  # sizes too far apart for any link
            at, rows, union = self._part(c, fold)
            mine = _folded(row, fold)
            n = self.n[at]
            if not _can_link(q["n"], max(int(n.min()), -(-percent * q["n"] // 100)), int(np.minimum(union, mine).sum()), percent):
                continue  # this part of the group stays closed to the query
            fits = (100 * n >= percent * q["n"]) & (100 * q["n"] >= percent * n) & (self.comp[at] != q["comp"])
            some = np.flatnonzero(fits)
            if len(some):
                overlap = np.minimum(rows[some], mine).sum(1).astype(np.int64)
                found.append(at[some[_can_link(q["n"], n[some], overlap, percent)]])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _opened(units: DataFrame, percent: int) -> DataFrame:
    """unit, handle, key and member of what the sketches let link; units: unit, handle, key, n, comp, sketch, asks, member. A query that is a member meets those of greater key."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["unit", "handle", "key", "member"], [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return b

        for rows in _streamed(batches, "unit"):
            members = sorted((r for r in rows if r["member"]), key=lambda r: r["key"])
            if not members:
                continue
            group, asked, found = _Group(members), [], set()
            for q in rows:
                if q["asks"]:
                    near = group.near(q, percent)
                    if q["member"]:
                        near = near[[group.rows[i]["key"] > q["key"] for i in near]] if len(near) else near
                    if len(near):
                        asked.append(q)
                        found.update(near.tolist())
            inside = {members[i]["key"] for i in found}
            out += [(q["unit"], q["handle"], q["key"], False) for q in asked if q["key"] not in inside]
            out += [(members[i]["unit"], members[i]["handle"], members[i]["key"], True) for i in sorted(found)]
            if len(out) >= 2000:
                yield flush()
        yield flush()

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(make, "unit string, handle long, key long, member boolean")


class _Forest:
    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _links(texts: DataFrame, opened: DataFrame, width: int, percent: int) -> DataFrame:
    """a and b: every linked key of a unit with the smallest key of its local component; opened: unit, handle, key, member. Texts travel, smaller than their sets."""
    few = opened.count() <= 500_000  # about 30 MB
    rows = texts.join(F.broadcast(opened) if few else opened, "handle").select("unit", "key", "member", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        shingler = Shingler(width)
        for rows in _streamed(batches, "unit"):
            sets, members = {}, set()
            for r in rows:
                tokens = shingler.tokens(r["text"].encode())
                if r["key"] not in sets and _key(_digest(tokens)) == r["key"]:
                    sets[r["key"]] = tokens
                if r["member"]:
                    members.add(r["key"])
            members = sorted(members & sets.keys())
            if not members:
                continue
            size = np.array([len(sets[m]) for m in members])
            all_tokens = np.concatenate([sets[m] for m in members])
            owner = np.repeat(np.arange(len(members)), size)
            order = np.argsort(all_tokens, kind="stable")
            all_tokens, owner = all_tokens[order], owner[order]
            forest = _Forest()
            for q in sorted(sets):
                x = sets[q]
                lo, hi = np.searchsorted(all_tokens, x, "left"), np.searchsorted(all_tokens, x, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                overlap = np.bincount(owner[at], minlength=len(members))
                for i in np.flatnonzero(_can_link(len(x), size, overlap, percent)):
                    if members[i] != q:
                        forest.join(q, members[i])
            for x in list(forest.up):
                if (r := forest.root(x)) != x:
                    a.append(x)
                    b.append(r)
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(make, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (its smallest id) of every id in ``links`` (a, b)."""
    both = common.written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = common.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = common.written(labels.join(near, "id").select("id", F.least("label", "near").alias("low"), F.col("label").alias("was")), "lower")
        common.discard(labels)
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("further"))
        new = common.written(lower.join(jump, "low", "left").select("id", F.least("low", F.coalesce("further", "low")).alias("label"), "was"), "labels")
        common.discard(lower)
        labels = new.select("id", "label")
        if new.filter("label <> was").isEmpty():
            common.discard(both)
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError("the components did not settle")


def _postings(made: DataFrame) -> DataFrame:
    """token, key and n of every prefix token that more than one class has; frequent tokens are kept without a count."""
    rare = made.select(F.explode("rare").alias("token"), "key", "n")
    here = Window.partitionBy("token")
    rare = rare.withColumn("lo", F.min("key").over(here)).withColumn("hi", F.max("key").over(here)).filter("lo <> hi").select("token", "key", "n")
    often = made.select(F.explode("often").alias("token"), "key", "n")
    return rare.dropDuplicates(["token", "key"]).unionByName(often.dropDuplicates(["token", "key"]))


def _blocks(rows: DataFrame, by: str, salt: int) -> DataFrame:
    """``rows`` (key, n, ...) with group: blocks of about ``GROUP`` rows or ``UNIT_TOKENS`` tokens of each value of ``by``, and the number of blocks and of rows."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    sizes = sizes.select(by, "rows", F.greatest(F.ceil(F.col("rows") / GROUP), F.ceil(F.col("tokens") / UNIT_TOKENS)).alias("blocks"))
    # Values of more than 1/2000 of the rows are fewer than 2000 and come by a broadcast.
    limit = max(GROUP, rows.count() // 2000)
    hot = F.broadcast(sizes.filter(F.col("rows") > limit))
    sized = rows.join(hot, by).unionByName(rows.join(hot.select(by), by, "left_anti").join(sizes.filter(F.col("rows") <= limit), by))
    block = F.pmod(F.xxhash64("key", F.lit(salt)), F.col("blocks"))
    return sized.withColumn("group", F.concat_ws("-", F.hex(by), block.cast("string")))


def _inside(texts: DataFrame, members: DataFrame, width: int, percent: int) -> list[DataFrame]:
    """Stars (a, b) of the links inside groups; the roots of many blocks meet again in new ones."""
    found: list[DataFrame] = []
    current = members
    before, salt = None, 0
    while True:
        dealt = _blocks(current, "home", salt).filter("rows > 1")
        units = dealt.select(F.col("group").alias("unit"), "handle", "key", "n", F.col("key").alias("comp"), "sketch", F.lit(True).alias("asks"), F.lit(True).alias("member"))
        opened = common.written(_opened(units, percent), "opened")
        found.append(common.written(_links(texts, opened, width, percent), "stars"))
        common.discard(opened)
        if found[-1].isEmpty():
            break
        left = common.written(dealt.filter("blocks > 1").select(*members.columns).join(found[-1].select(F.col("a").alias("key")).distinct(), "key", "left_anti"), "roots")
        if salt:
            common.discard(current)
        current, salt, now = left, salt + 1, left.count()
        if not now or before is not None and 2 * now > before:
            break  # what is left hardly links, and meets as other groups do
        before = now
    return found


def _met(located: DataFrame, percent: int) -> DataFrame:
    """key, n and group of each query with the groups of other components that it must be compared with; located: token, key, n, comp, big, group."""
    matrix = located.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("big").alias("of_big"))
    matrix = common.written(matrix, "matrix")
    mine = located.select("token", "key", "n", F.col("comp").alias("own"), "big", F.col("group").alias("home"))
    sizes = (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    # Members of large components ask all groups of small ones, and those of small ones each other's, once a pair of groups,
    # their own included: blocks are dealt anew here, so classes of one group may never have met.
    small = matrix.filter("not of_big")
    first = mine.join(small, "token").filter(sizes & (F.col("big") | (F.col("home") <= F.col("group"))) & ((F.col("lo") != F.col("own")) | (F.col("hi") != F.col("own"))))
    # Large components ask each other's groups: components meet by token first, so that none is met with itself.
    large = matrix.filter("of_big").withColumnRenamed("lo", "other")
    both = large.select("token", "other").distinct()
    second = mine.filter("big").join(both, "token").filter("own < other").join(large, ["token", "other"]).filter(sizes)
    return first.select("key", "n", "group").unionByName(second.select("key", "n", "group")).distinct()


def _across(texts: DataFrame, members: DataFrame, kept: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Stars (a, b) of the links between groups; labels: id and component of keys that link inside groups."""
    known = members.select("key", "n", "home").join(labels.withColumnRenamed("id", "key"), "key", "left")
    known = known.withColumn("comp", F.coalesce("component", "key")).drop("component")
    large = known.groupBy("comp").count().filter(F.col("count") > GROUP).select("comp", F.lit(True).alias("big"))
    known = known.join(large, "comp", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    grouped = _blocks(known.withColumn("of", F.when(F.col("big"), F.col("comp")).otherwise(F.col("home"))), "of", 0)
    grouped = grouped.select("key", "comp", "big", F.concat(F.when(F.col("big"), "c").otherwise("h"), "group").alias("group"))
    grouped = common.written(grouped, "grouped")
    located = common.written(kept.join(grouped, "key"), "located")
    meet = common.written(_met(located, percent), "meet")
    common.discard(located)
    asked = meet.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / UNIT_TOKENS)).cast("int").alias("chunks"))
    asked = common.written(asked, "asked")
    part: Column = F.pmod(F.xxhash64("key"), F.col("chunks"))
    unit = F.concat_ws("/", "group", F.col("c").cast("string")).alias("unit")
    query = meet.select("key", "group").join(asked, "group").select("key", "group", part.alias("c"), F.lit(True).alias("asks"), F.lit(False).alias("member"))
    member = grouped.select("key", "group").join(asked, "group").select("key", "group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), F.lit(False).alias("asks"), F.lit(True).alias("member"))
    sides = query.unionByName(member).select("key", unit, "asks", "member")
    units = sides.join(members.select("key", "handle", "n", "sketch"), "key").join(grouped.select("key", "comp"), "key")
    opened = common.written(_opened(units, percent), "opened")
    for used in (meet, asked, grouped):
        common.discard(used)
    found = common.written(_links(texts, opened, width, percent), "stars")
    common.discard(opened)
    return found


def joined(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id of every document; sets of ``width``-word shingles link when 100 x intersection >= ``percent`` x union."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("id", F.xxhash64("id", "text").alias("handle"), "text")
    counts = common.written(frequent(texts, width), "frequent")
    hot = hot_tokens(counts, HOT)
    common.discard(counts)
    made = common.written(prefixes(texts, hot, width, percent), "prefixes")
    classes = made.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min("handle").alias("handle"), F.count("*").alias("copies"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    classes = common.written(classes, "classes")
    if not classes.filter("lo <> hi").isEmpty():
        raise RuntimeError("two different token sets have one key")
    kept = common.written(_postings(made.filter("rare is not null")), "postings")
    # Members: the classes that share a prefix token, with the first of these.
    home = kept.groupBy("key").agg(F.min("token").alias("home"))
    sketches = made.filter("sketch is not null").join(home, "key").groupBy("key").agg(F.min("home").alias("home"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    members = common.written(sketches.join(classes.select("key", "handle"), "key"), "members")
    plain = texts.select("handle", "text")
    inside = _inside(plain, members, width, percent)
    labels = components(reduce(DataFrame.unionByName, inside))
    across = _across(plain, members, kept, labels, width, percent)
    for used in (members, kept, *inside):
        common.discard(used)
    star = common.written(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(across)), "star")
    common.discard(across)
    out = common.written(_labelled(made, classes, star), "components")
    for used in (made, classes, star):
        common.discard(used)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _labelled(made: DataFrame, classes: DataFrame, star: DataFrame) -> DataFrame:
    """id, n and component_id of every document; star: id and component of linked keys."""
    named = classes.select("key", "rep").join(star.withColumnRenamed("id", "key"), "key")
    smallest = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(smallest, "component").select("key", "least")
    labelled = classes.select("key", "rep", "copies").join(named, "key", "left").select("key", F.coalesce("least", "rep").alias("component_id"), "copies")
    labelled = common.written(labelled, "labelled")
    # Classes of very many copies meet their documents by a broadcast of fewer than 2000 rows.
    limit = max(1, made.count() // 2000)
    hot = F.broadcast(labelled.filter(F.col("copies") > limit).drop("copies"))
    others = labelled.filter(F.col("copies") <= limit).drop("copies")
    every = made.select("id", "n", "key")
    some = every.filter("n > 0")
    none = every.filter("n = 0").withColumn("component_id", F.col("id"))
    return some.join(hot, "key").unionByName(some.join(hot, "key", "left_anti").join(others, "key")).unionByName(none).select("id", "n", "component_id")
