"""Operator 11: how the sources of a language differ in their use of terms, by sorted runs.

1. Tasks count the terms of their own documents, each a run of documents with a number (the ``run`` column), by language and source: the document
   frequency and the count of each term. A language, source or term with a third of all rows leaves a task as one row a term, not one an occurrence.
2. These rows are dealt by (lang, term) and sorted by (lang, term, source, run). A scan of run lengths sums them, closes a term
   where the next begins, and keeps the terms of at least ``least`` documents with the counts of their sources. It holds one open term.
3. Totals a group and a language follow from the kept terms. A second scan emits, for each run of a term, what it adds to the pairs of
   sources and what it scores for each source; a task sums pairs in blocks of bounded size and keeps ten terms a source.
   The terms without occurrences in either source of a pair add a constant, so only occurring sources are visited.

All arithmetic is of whole numbers: counts below 9.2 * 10^15, sums in 64 bits. The groups (lang, source) are held by the driver and
each task: their number is the square root of the number of rows that the result must have.

A null text, lang or source counts as ''. Every row is a document, whatever its id, so repeated rows count as often as they stand. A group
without terms has pairs and no term rows; a language without kept terms has pairs of value 0; one with a single source has no pairs. An empty table gives an empty result.
Other columns are never read. A text is counted in segments of ``SEGMENT`` bytes, cut between terms; only its distinct terms are held whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SCALE = 1_000_000_000
#: Bytes counted at once; distinct terms held by a task; elements of a block of pairs.
SEGMENT, HELD, CELLS = 4 << 20, 600_000, 1 << 22
#: A-Z become lower case, other bytes below 0x80 that are not letters separate terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def segments(text: bytes, most: int | None = None) -> Iterator[bytes]:
    """The text in segments of at most ``most`` bytes, or more where a term is longer; each ends between terms."""
    most = most or SEGMENT
    at = 0
    while len(text) - at > most:
        part = text[at : at + most].translate(_TERMS)
        cut = part.rfind(b" ") + 1
        if not cut:
            end = at + most
            while end < len(text) and _TERMS[text[end]] != 32:
                end += 1
            cut, part = end - at, text[at:end].translate(_TERMS)
        yield part[:cut]
        at += cut
    yield text[at:].translate(_TERMS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    task, run, size = TaskContext.get().partitionId(), 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in held.items():
            terms = list(counts)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                n = len(part)
                columns = [
                    pa.array([lang] * n),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([source] * n),
                    pa.array(np.full(n, (task << 32) + run)),
                    pa.array([documents[t] for t in part], pa.int64()),
                    pa.array([counts[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "run", "documents", "n"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), common.utf8(b.column("text")), strict=True):
            counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(counts)
            if len(text) <= SEGMENT:
                terms = text.translate(_TERMS).split()
                counts.update(terms)
                documents.update(set(terms))
            else:
                distinct: set[bytes] = set()
                for s in segments(text):
                    terms = s.split()
                    counts.update(terms)
                    distinct.update(terms)
                documents.update(distinct)
            size += len(counts) - before
            if size > HELD:
                yield from out()
                run, size = run + 1, 0
    yield from out()


def _starts(change: np.ndarray) -> np.ndarray:
    """Where runs start, given where a row differs from the one before."""
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _changes(b: pa.RecordBatch, *names: str) -> np.ndarray:
    found = np.zeros(max(0, b.num_rows - 1), bool)
    for name in names:
        c = b.column(name)
        found |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return found


_SCANNED = "lang string, term string, documents long, n long, sources array<string>, counts array<long>"


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The kept terms, from rows sorted by (hash, lang, term, source, run); the open term stays, summed by source."""
    open_term: pa.RecordBatch | None = None

    def summed(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        """A row a source of a term, and where terms start."""
        new_term = _changes(b, "hash", "lang", "term")
        at = _starts(new_term | _changes(b, "source"))
        rows = b.take(pa.array(at))
        sums = [np.add.reduceat(b.column(c).to_numpy(), at) for c in ("documents", "n")]
        columns = [rows.column(c) for c in ("hash", "lang", "term", "source")] + [pa.array(s) for s in sums]
        return pa.RecordBatch.from_arrays(columns, ["hash", "lang", "term", "source", "documents", "n"]), np.searchsorted(at, _starts(new_term))

    def closed(b: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        """The terms of ``least`` documents or more; term k has the rows from at[k] on."""
        size = np.diff(np.append(at, b.num_rows))
        documents, n = (np.add.reduceat(b.column(c).to_numpy(), at) for c in ("documents", "n"))
        kept = documents >= least
        rows = b.filter(pa.array(np.repeat(kept, size)))
        first = b.take(pa.array(at[kept]))
        offsets = pa.array(np.concatenate([[0], np.cumsum(size[kept])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("source", "n")]
        columns = [first.column("lang"), first.column("term"), pa.array(documents[kept]), pa.array(n[kept]), *lists]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "documents", "n", "sources", "counts"])

    for b in batches:
        if not b.num_rows:
            continue
        names = ["hash", "lang", "term", "source", "documents", "n"]
        b = pa.RecordBatch.from_arrays([b.column(c) for c in names], names)
        rows, at = summed(b if open_term is None else pa.concat_batches([open_term, b]))
        open_term = rows.slice(int(at[-1]))
        if len(at) > 1:
            yield closed(rows.slice(0, int(at[-1])), at[:-1])
    if open_term is not None:
        yield closed(open_term, np.array([0]))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, documents, n, sources and counts of every term in at least ``least`` documents of its language; docs: lang, source, text."""
    counted = docs.mapInArrow(_counted, "lang string, term string, source string, run long, documents long, n long")
    counted = counted.withColumn("hash", F.xxhash64("lang", "term"))
    ordered = counted.repartition("lang", "term").sortWithinPartitions("hash", "lang", "term", "source", "run")
    return ordered.mapInArrow(lambda batches: _scan(batches, least), _SCANNED)


def probability(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * n / total), by long division in three steps of a thousand so that 64 bits suffice."""
    found, rest = np.divmod(n, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digit
    return found + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


class _Language:
    """The sources of a language, and the share of a term that a source lacks."""

    def __init__(self, terms: int, n: int, groups: list[tuple[str, int]]) -> None:
        self.terms, self.total = terms, np.int64(n + 2 * terms)
        self.sources = sorted((s for s, _ in groups), key=str.encode)
        of = dict(groups)
        self.totals = np.array([of[s] + 2 * terms for s in self.sources], np.int64)
        self.absent = probability(np.full(len(of), 2, np.int64), self.totals) if terms else np.ones(len(of), np.int64)


def _emitted(batches: Iterator[pa.RecordBatch], languages: dict[str, _Language], top: int) -> Iterator[pa.RecordBatch]:
    """part, lang, source, item and value: sums over this task's terms of what pairs have beyond the constant, and the best terms of each source."""
    pairs: dict[tuple[str, int], np.ndarray] = {}
    best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "lang", "source", "item", "value"])

    def out() -> Iterator[pa.RecordBatch]:
        for (name, a), row in pairs.items():
            sources, there = languages[name].sources, np.flatnonzero(row)
            for at in range(0, len(there), 50_000):
                rows = [(sources[i], int(row[i])) for i in there[at : at + 50_000]]
                yield batch([("pair", name, sources[a], s, v) for s, v in rows] + [("pair", name, s, sources[a], v) for s, v in rows])
        pairs.clear()

    for b in batches:
        names = b.column("lang").to_numpy(zero_copy_only=False)
        for name in set(names.tolist()):
            lang = languages[name]
            part = b.filter(pa.array(names == name))
            size = pc.list_value_length(part.column("sources")).to_numpy()
            coded = pc.list_flatten(part.column("sources")).dictionary_encode()
            at = {s: i for i, s in enumerate(lang.sources)}
            source = np.array([at[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            counts = pc.list_flatten(part.column("counts")).to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            p = probability(counts + 2, lang.totals[source])
            q = probability(part.column("n").to_numpy() + 2, lang.total)[row]
            value = divergence(p, q)
            texts = part.column("term")
            for s in np.unique(source).tolist():
                some = np.flatnonzero((source == s) & (p > q))
                if len(some) > top:
                    some = some[value[some] >= np.partition(value[some], -top)[-top]]
                found = [(-int(value[i]), texts[int(row[i])].as_py().encode()) for i in some]
                best[name, s] = sorted(best.get((name, s), []) + found)[:top]
            for lo, hi in _chunks(size, len(lang.sources)):
                _add_pairs(pairs, name, lang, row[lo:hi] - row[lo], source[lo:hi], p[lo:hi])
                if sum(len(x) for x in pairs.values()) > CELLS:
                    yield from out()
    yield from out()
    rows = [("term", name, languages[name].sources[s], t.decode(), -v) for (name, s), found in best.items() for v, t in found]
    for at in range(0, len(rows), 50_000):
        yield batch(rows[at : at + 50_000])


def _chunks(size: np.ndarray, sources: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole terms' rows, with about ``CELLS`` elements of rows times sources."""
    ends = np.cumsum(size)
    most = max(1, CELLS // max(1, sources))
    at = 0
    while at < ends[-1]:
        k = max(int(np.searchsorted(ends, at + most, "right")) - 1, int(np.searchsorted(ends, at, "right")))
        yield at, int(ends[k])
        at = int(ends[k])


def _add_pairs(pairs: dict, name: str, lang: _Language, term: np.ndarray, source: np.ndarray, p: np.ndarray) -> None:
    """Add to row a of ``pairs``, for each other source b, what each term of a adds; where both occur, the smaller of a and b has it."""
    wide = np.broadcast_to(lang.absent, (int(term[-1]) + 1, len(lang.sources))).copy()
    there = np.zeros(wide.shape, bool)
    wide[term, source], there[term, source] = p, True
    step = max(1, CELLS // len(lang.sources))
    for lo in range(0, len(term), step):
        t, a = term[lo : lo + step], source[lo : lo + step]
        more = divergence(p[lo : lo + step, None], wide[t]) - divergence(lang.absent[a][:, None], lang.absent[None, :])
        more[there[t] & (np.arange(len(lang.sources)) <= a[:, None])] = 0
        order = np.argsort(a, kind="stable")
        first = _starts(np.diff(a[order]) != 0)
        sums = np.add.reduceat(more[order], first, axis=0)
        for s, row in zip(a[order][first].tolist(), sums, strict=True):
            pairs[name, s] = pairs[name, s] + row if (name, s) in pairs else row


def _constants(batches: Iterator[pa.RecordBatch], languages: dict[str, _Language]) -> Iterator[pa.RecordBatch]:
    """part, lang, source, item and value of every pair of sources, as if no term occurred in either."""
    for b in batches:
        for name, source in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
            lang = languages[name]
            here = lang.sources.index(source)
            value = lang.terms * divergence(lang.absent[here], lang.absent)
            others = [i for i in range(len(lang.sources)) if i != here]
            for at in range(0, len(others), 50_000):
                some = others[at : at + 50_000]
                n = len(some)
                columns = [pa.array(["pair"] * n), pa.array([name] * n), pa.array([source] * n), pa.array([lang.sources[i] for i in some], pa.string()), pa.array(value[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "lang", "source", "item", "value"])


_ROWS = "part string, lang string, source string, item string, value long"


def audited(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank: for each source the distances to the others of its language (``pair``) and the ``top`` terms it uses more than the language does (``term``)."""
    spark = docs.sparkSession
    texts = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = common.written(kept_terms(texts, least), "terms")
    groups = common.written(texts.select("lang", "source").distinct(), "groups")
    uses = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    by_lang = {r["lang"]: (r["terms"], r["n"]) for r in terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("n")).collect()}
    members: dict[str, list[tuple[str, int]]] = {}
    for r in groups.join(uses, ["lang", "source"], "left").collect():
        members.setdefault(r["lang"], []).append((r["source"], r["n"] or 0))
    sent = spark.sparkContext.broadcast({k: _Language(*by_lang.get(k, (0, 0)), v) for k, v in members.items()})
    found = terms.mapInArrow(lambda batches: _emitted(batches, sent.value, top), _ROWS)
    found = common.written(found, "partial")
    pairs = found.filter("part = 'pair'").unionByName(groups.mapInArrow(lambda batches: _constants(batches, sent.value), _ROWS))
    pairs = pairs.groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
uses AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
by_lang AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang),
by_group AS (
  SELECT g.lang, g.source, coalesce(b.v, 0) AS v, coalesce(sum(u.n), 0) AS n
  FROM groups g LEFT JOIN by_lang b USING (lang) LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + (1000000000 * (coalesce(u.n, 0) + 2)) // CAST(g.n + 2 * g.v AS HUGEINT) AS p,
    1 + (1000000000 * (k.n + 2)) // (b.n + 2 * b.v) AS q
  FROM by_group g JOIN kept k USING (lang) JOIN by_lang b USING (lang) LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL BY NAME
  SELECT * FROM (SELECT 'term' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
