"""Operator 8: WARC archives and a globally ordered index of their captures.

1. Equal payloads (by SHA-1 and length) are found; the largest id is the response, the others revisit it.
2. Spark's text writer writes the records: a row is a record without its two closing line
   ends, which are the writer's separator. Any Hadoop file system will do. Pages fall
   into classes of size so that a file stays bounded and can be read whole by one task.
3. Archives are read back by Content-Length, payload digests are verified, and each archive
   gives a locally sorted run of captures.
4. Sampled splitters cut the runs into ranges of (URL key, timestamp, id); for each range a loser tree
   merges the runs' slices, and range offsets give every capture its place in the global order.

Null html is an empty payload, null URLs are empty. Rows that repeat an id with an equal payload are all
responses if that id is the largest. Records are as the WARC 1.1 format describes them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Classes of pages by payload bytes, each with its records in a file.
CLASSES = [(1 << 16, 1000), (1 << 20, 64), (1 << 62, 1)]

_END = "\r\n"


#: What stands for a null id inside archives: it sorts before all others, and null comes back from the index.
NO_ID = -(1 << 63)


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four letters."""
    digest = F.sha1(text.cast("binary"))
    out = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_LETTERS), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """The key that sorts a host's captures together: its labels reversed, then the path, in lower case, without fragment."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(rest))


def _urn(x: Column) -> Column:
    h = F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(F.lit("<urn:uuid:00000000-0000-4000-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12), F.lit(">"))


def _record() -> Column:
    """A record without its closing line ends; columns: id, url, ts, payload, bytes, digest, response_id."""
    again = F.col("response_id") != F.col("id")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        line("WARC-Date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Record-ID", _urn(F.col("id"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("response_id"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-X-Page-Id", F.col("id").cast("string")),
        F.when(again, line("WARC-X-Refers-To-Page-Id", F.col("response_id").cast("string"))).otherwise(""),
        line("WARC-X-Url-Key", F.regexp_replace(url_key(F.col("url")), r"[\r\n]", "%0A")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END),
        block,
    )


def captures(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, ts, payload, bytes, digest and response_id of each page; groups too large for a task are met by a broadcast of fewer than 2000 rows."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("id", F.lit(1 << 28)))).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    groups = common.written(rows.groupBy("digest", "bytes").agg(F.max("id").alias("response_id"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = groups.filter(F.col("n") > total // 2000).filter("n > 1").drop("n")
    shared = groups.filter((F.col("n") > 1) & (F.col("n") <= total // 2000)).drop("n")
    in_hot = rows.join(F.broadcast(hot), ["digest", "bytes"])
    others = rows.join(F.broadcast(hot), ["digest", "bytes"], "left_anti").join(shared, ["digest", "bytes"], "left")
    return in_hot.unionByName(others).withColumn("response_id", F.coalesce("response_id", "id"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """WARC files of the pages; gives the folders, one for each class of size."""
    found = captures(pages, id_col, url_col, html_col)
    below, folders = -1, []
    for k, (most, records) in enumerate(CLASSES):
        some = found.filter((F.col("bytes") > below) & (F.col("bytes") <= most)).select(_record().alias("value"))
        writer = some.write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", records)
        writer.text(f"{path}/class-{k}")
        folders.append(f"{path}/class-{k}")
        below = most
    return folders


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(_END)
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        header = dict(x.split(": ", 1) for x in lines)
        start, n = end + 4, int(header["Content-Length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, header, data[start : start + n]
        at = start + n + 4


_CAPTURE = "url_key string, ts string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, run string, run_place long, offset long"


def _run(name: str, content: bytes) -> list[tuple]:
    """The captures of one archive, locally sorted."""
    out = []
    for at, h, block in records(zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{name}, {at}: the payload does not agree with its header")
        refers = h.get("WARC-X-Refers-To-Page-Id")
        out.append((h["WARC-X-Url-Key"], h["WARC-Date"], int(h["WARC-X-Page-Id"]), h["WARC-Type"], int(refers) if refers else None, digest, size, name, at))
    out.sort(key=lambda x: (x[0], x[1], x[2], x[8]))
    return [(*x[:8], i, x[8]) for i, x in enumerate(out)]


def runs(spark, folders: list[str]) -> DataFrame:  # noqa: ANN001
    """The captures of all archives, a sorted run for each file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in _CAPTURE.split(", ")]
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                found = _run(name.as_py(), content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folders)
    return files.select("path", "content").mapInArrow(parse, _CAPTURE)


class LoserTree:
    """Merges sorted lists: each inner node holds the loser of its match, so that a new head plays one match a level."""

    def __init__(self, lists: list[list]) -> None:
        self.lists, self.at, self.k = lists, [0] * len(lists), len(lists)
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether list a's head goes before list b's; a list that has ended loses."""
        if self.at[a] >= len(self.lists[a]):
            return False
        if self.at[b] >= len(self.lists[b]):
            return True
        return (self.lists[a][self.at[a]], a) < (self.lists[b][self.at[b]], b)

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.loser[node] == -1:  # the first to come waits for its opponent
                self.loser[node] = winner
                return
            if self._less(self.loser[node], winner):
                winner, self.loser[node] = self.loser[node], winner
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.at[w := self.loser[0]] < len(self.lists[w]):
            yield self.lists[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


def merged(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """``index`` (as :func:`runs` gives it, written out) with each capture's place in the order of URL key, timestamp and id."""
    spark = index.sparkSession
    total = index.count()
    ranges = ranges or min(4096, max(64, total // 50_000))
    key = F.struct("url_key", "ts", "page_id", "run", "run_place")
    # A bounded sample: 32 keys for each range.
    chance = F.pmod(F.xxhash64("run", "run_place"), F.lit(1 << 30)) / float(1 << 30)
    drawn = sorted(tuple(r) for r in index.filter(chance * total < 32 * ranges).select("url_key", "ts", "page_id", "run", "run_place").collect())
    bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    kind = "array<struct<url_key:string,ts:string,page_id:long,run:string,run_place:long>>"
    # Two levels, so that a capture is compared with few boundaries.
    step = max(1, int(len(bounds) ** 0.5))
    upper = [(i // step, bounds[i]) for i in range(0, len(bounds), step)]
    lower = spark.createDataFrame([(j, bounds[j * step : (j + 1) * step]) for j, _ in upper] or [(0, [])], f"j int, lower {kind}")
    marks = [F.struct(*[F.lit(x).alias(n) for x, n in zip(b, ("url_key", "ts", "page_id", "run", "run_place"), strict=True)]) for _, b in upper]
    upper_of = F.size(F.filter(F.array(*marks), lambda b: b <= key)) - 1 if marks else F.lit(-1)
    found = F.coalesce(F.size(F.filter("lower", lambda b: b <= key)), F.lit(0))
    ranged = index.withColumn("j", upper_of).join(F.broadcast(lower), "j", "left").withColumn("range", F.when(F.col("j") < 0, 0).otherwise(F.col("j") * step + found)).drop("j", "lower")
    names = [x.split()[0] for x in _CAPTURE.split(", ")]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = []
        for _, run in pdf.groupby("run", sort=True):
            run = run.sort_values("run_place")
            lists.append(list(zip(run["url_key"], run["ts"], run["page_id"], run["run"], run["run_place"], run.index, strict=True)))
        order = [x[5] for x in LoserTree(lists)]
        out = pdf.loc[order]
        return out.assign(place=range(len(out)))

    done = ranged.groupBy("range").applyInPandas(merge, ", ".join([*_CAPTURE.split(", "), "range int", "place long"]))
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # a row for each range
    offsets, n = [], 0
    for k in sorted(counts):
        offsets.append((k, n))
        n += counts[k]
    before = spark.createDataFrame(offsets, "range int, before long")
    named = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) if c == "page_id" else F.col(c) for c in names]
    return done.join(F.broadcast(before), "range").select(*named, (F.col("place") + F.col("before")).alias("position"))


def archived(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages' archives under ``path``, reads them back and gives the merged index."""
    folders = write(pages, path, id_col, url_col, html_col)
    return merged(common.written(runs(pages.sparkSession, folders), "captures"))


#: The same rows in DuckDB, less the position in the index.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4)::INTEGER * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)),
    'string_agg', '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""
