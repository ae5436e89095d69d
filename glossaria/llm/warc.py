"""WARC archives: written from pages, read back, and their capture index merged externally.

Writing: a page whose payload (HTML in UTF-8) has at least LEAST bytes and equals that of a page with a larger id becomes a
revisit record of the page with the largest id, else a response record. Records are built by built-in functions, each becomes
a gzip member of its own, and Spark's text sink writes them, so any file system will do.

Reading: each archive is parsed member by member, each along its Content-Length; positions are those of the members in the
compressed archive, so that a record can be read by itself. A task sorts the captures it read into a run by
(URL key, timestamp, page); runs are dealt by ranges of that order and each range merges its k runs with a loser tree, which
gives globally ordered capture histories over partitions in order. A range is as even as the sampled order allows, a
frequent host is split by URL, time and page.

Payload digests and sizes in the result are those of the payloads as read back; a revisit carries its own in its header.

Defined cases: null html is an empty payload; a null url is written as an empty target; line breaks and other control
characters in a URL are percent-encoded in the header; a null page_id is written without one and read as null; of repeated
rows (equal page_id and payload) those with the largest page_id are all responses; very long pages
are records like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, prepare, scratch, stash

LEAST = 1000
#: Records of one archive, bytes of a payload up to which that holds, and bytes of an archive of longer ones.
ARCHIVE_ROWS, SHORT, ARCHIVE_BYTES = 1000, 1 << 20, 1 << 29
EMPTY = gzip.compress(b"", mtime=0)
VERSION = "WARC/1.1"
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
CAPTURE = "page_id long, url_key string, stamp string, archive string, position long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _lines(*parts) -> F.Column:
    """Header lines of (name, value); a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in parts])


def judged(pages: DataFrame) -> DataFrame:
    """page_id, url, html, size, digest (SHA-1) and keeper: the largest page_id with an equal payload, where there are several.

    Equal is equal by SHA-256 and size. Only thin rows meet by payload; the rows with their HTML stay where they are, but for
    copies (and what a bitmap of fixed size takes for them), which find their keeper by page.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    own = own.withColumn("size", F.octet_length("html").cast("long")).withColumn("same", F.sha2("html", 256)).withColumn("k", F.xxhash64("page_id", "same"))
    thin = own.where(F.col("size") >= LEAST).select("page_id", "same", "k")
    again = thin.groupBy("same").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").select("same", "keeper")
    copies = stash(thin.distinct().join(again, "same"), "warc-copies")
    found = looked_up(own, copies, "k")
    alone = found.where("not _hit").withColumn("keeper", F.lit(None).cast("long"))
    several = found.where("_hit").join(copies.select(F.col("page_id").alias("p"), F.col("same").alias("s"), F.col("k").alias("j"), "keeper"), F.expr("k = j and same = s and page_id <=> p"), "left")
    return alone.unionByName(several.select(alone.columns)).drop("_hit", "k", "same").withColumn("digest", F.sha1(F.col("html").cast("binary")))


def records(pages: DataFrame) -> DataFrame:
    """One record per page, as (value, size of its payload) without the blank lines behind it."""
    own = judged(pages)
    revisit = F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    stamp = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    own = own.withColumn("revisit", revisit).withColumn("block", block)
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _lines(
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
            ("WARC-Target-URI", url),
            ("WARC-Date", stamp),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Payload-Length", F.col("size").cast("string")),
            ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("keeper").cast("string"), F.lit(">")))),
            ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length("block").cast("string")),
        ),
        F.lit("\r\n"),
    )
    return own.select(F.concat(head, "block").alias("value"), "size")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record with its blank lines as one gzip member."""
    for rows in batches:
        out = [gzip.compress(x.encode() + b"\r\n\r\n", 6, mtime=0) for x in rows.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str) -> None:
    """Archives of one gzip member per record, in the folders short and long below path.

    Records of short payloads go ARCHIVE_ROWS to an archive; longer ones so many that an archive stays below ARCHIVE_BYTES.
    Spark's text sink writes the members' bytes as they are, and an empty member where it would end a line.
    """
    made = stash(records(pages), "warc-records")
    longest = made.agg(F.max("size")).first()[0] or 0
    for name, some, rows in (("short", made.where(F.col("size") <= SHORT), ARCHIVE_ROWS), ("long", made.where(F.col("size") > SHORT), max(1, ARCHIVE_BYTES // (longest + 4096)))):
        if name == "short" or longest > SHORT:
            members = some.select("value").mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
            members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", rows).text(f"{path}/{name}")


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(position in the compressed bytes, content) of each gzip member that isn't empty."""
    at, step, view = 0, 1 << 16, memoryview(data)
    while at < len(data):
        start, out, unzip = at, [], zlib.decompressobj(31)
        while not unzip.eof:
            if at >= len(data):
                raise ValueError(f"no end of member at {start}")
            out.append(unzip.decompress(view[at : at + step]))
            at = min(at + step, len(data)) - len(unzip.unused_data)
        if content := b"".join(out):
            yield start, content


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(data, at, end)}
        size = int(header["content-length"])
        yield at, header, data[end : end + size]
        if data[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at {end + size}")
        at = end + size + 4


def url_key(url: str) -> str:
    """Sort-friendly form: host parts from the last to the first, then the path; case, scheme, www and fragment don't count."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)([^#]*)", url.strip().lower(), re.S)
    host, rest = m[1].rpartition("@")[2], m[2]
    host, _, port = host.partition(":")
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (rest or "/")


def _run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read archives; each becomes a locally sorted run of captures."""
    for some in rows:
        for path, data in zip(some["path"], some["content"], strict=True):
            out, data = [], bytes(data)
            zipped = data[:2] == b"\x1f\x8b"
            for at, header, block in ((at if zipped else own, header, block) for at, part in (members(data) if zipped else [(0, data)]) for own, header, block in parse(part)):
                page = _PAGE.match(header.get("warc-record-id", ""))
                refers = _PAGE.match(header.get("warc-refers-to", ""))
                if header["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if header["warc-payload-digest"] != f"sha1:{digest}":
                        raise ValueError(f"{path} at {at}: the payload doesn't match its digest")
                else:
                    size, digest = int(header["warc-payload-length"]), header["warc-payload-digest"].removeprefix("sha1:")
                out.append((int(page[1]) if page else None, url_key(header["warc-target-uri"]), header["warc-date"], path, at, size, digest, header["warc-type"], int(refers[1]) if refers else None))
            out.sort(key=lambda r: _order(r))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in CAPTURE.split(", ")])
            for c in ("page_id", "refers_to"):
                frame[c] = frame[c].astype("Int64")
            yield frame


def _order(r: tuple) -> tuple:
    return r[1], r[2], r[0] is not None, r[0] or 0, r[3], r[4]


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the winner moves up; a step plays log2 k matches."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if b < 0:
            return False
        if a < 0:
            return True
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, i: int) -> None:
        """Take entry i up from its leaf; while the tree is built, an empty node (-1) holds the first that arrives."""
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node], winner = winner, -1
                break
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        if winner >= 0:
            self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while True:
            i = self.tree[0]
            if i < 0 or self.head[i] is None:
                return
            yield self.head[i][1]
            self.head[i] = next(self.runs[i], None)
            self._play(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs in a range: its rows arrive run by run, each in order."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table)
    order = list(zip(*[rows.column(c).to_pylist() for c in ("url_key", "stamp", "page_id", "archive", "position")], strict=True))
    key = [(u, s, p is not None, p or 0, a, o) for u, s, p, a, o in order]
    starts = [0, *[i for i in range(1, len(order)) if order[i][3] != order[i - 1][3]], len(order)]
    runs = [iter([(key[i], i) for i in range(a, b)]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    yield from rows.take(pa.array(list(LoserTree(runs)), pa.int64())).combine_chunks().to_batches()


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The merged capture index of a folder of archives, globally ordered by URL key, timestamp and page."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    runs = stash(files.mapInPandas(_run, CAPTURE), "runs")
    dealt = runs.repartitionByRange("url_key", "stamp", "page_id").sortWithinPartitions("archive", "url_key", "stamp", F.col("page_id").asc_nulls_first(), "position")
    return dealt.mapInArrow(_merge, CAPTURE)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all archives: one row per page with its capture."""
    spark = prepare(pages.sparkSession)
    path = scratch(spark, "warc")
    write(pages, path)
    return captures(spark, path)
