"""WARC archives of pages, read back, with a globally ordered capture index.

Writing: payloads are known by SHA-256; of equal payloads of ``least`` bytes or
more the smallest page id is the response and the others are revisits without a
body.  Each task sorts its captures by (URL key, time, page id), so each file is a
sorted run.  Records go through Spark's text writer, whose line separator is the
CRLF CRLF that ends a WARC record; it reaches every store and commits tasks.  Files
are gzip (.gz), one member each, of at most ``MOST_BYTES`` inside (a longer record is
a file of its own); offsets in the index are those of the archive inside.

Reading: files come back as bytes and are unpacked as a stream, a record at a time by
its Content-Length.  A file gives one sorted run, or several where its captures are
not in order.  The captures are dealt by ranges of the index's whole order, as many
as keep a range at some ``RANGE_ROWS`` rows whatever the size of the table, and each
range is merged from its slices of the runs by a loser tree.  So the index is in
global order across its shards, and no task holds more than a range.

Defined cases: null html is an empty payload; a null url has an empty key; rows
that share id and payload are alike (all responses, or all revisits); a null page
id is never the response others refer to; an empty table gives no rows; other
columns are ignored.  A record must fit in a task's memory.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, shuffle_width, written

CRLF = "\r\n"
#: Bytes of the archive in a file at most, and captures in a range of the index, about.
MOST_BYTES, RANGE_ROWS = 1 << 29, 100_000
CAPTURE = "run string, seq long, url_key string, captured string, page_id long, record_type string, offset long, length long, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the path and query: com,example)/a?b."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def write(pages: DataFrame, path: str, least: int = 100, captured: str = "2024-01-01T00:00:00Z", records_a_file: int = 5000) -> None:
    """One record for each row of ``pages`` (page_id, url, html) under ``path``."""
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), clean.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    rows = rows.withColumn("url_key", F.when(F.col("url") == "", "").otherwise(url_key(F.col("url"))))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html")))
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    refers = F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first"))))).otherwise("")
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(captured)), line("WARC-Target-URI", F.col("url")), line("X-URL-Key", F.col("url_key")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), refers, F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"), line("Content-Length", length.cast("string")), F.lit(CRLF))
    longest = pages.select(F.max(F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0))).alias("n")).first()["n"] or 0
    records_a_file = max(1, min(records_a_file, MOST_BYTES // (longest + 1024)))
    runs = rows.select("url_key", "page_id", F.concat(head, block).alias("value")).sortWithinPartitions("url_key", "page_id")
    runs.select("value").write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_a_file).option("compression", "gzip").text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, named fields, block) of each record of an archive, read as a stream."""
    at = 0
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        size, fields = len(first), {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"the record at byte {at} is cut off")
            size += len(line)
            name, _, value = line[:-2].decode().partition(": ")
            fields[name] = value
        block = archive.read(int(fields["Content-Length"]))
        if archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        yield at, fields, block
        at += size + 2 + len(block) + 4


def _number(urn: str | None) -> int | None:
    text = (urn or "<urn:page:->")[len("<urn:page:") : -1]
    return None if text == "-" else int(text)


def _first(page: int | None) -> int:
    """A page id in the index's order, null before all others."""
    return -(1 << 63) if page is None else page


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``; payload sizes and digests are of
    the bytes read, for revisits those the record states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                out, runs, before = [], 0, None
                archive = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 20)
                for seq, (at, fields, block) in enumerate(parse(archive)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields["WARC-Type"]
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                            raise ValueError(f"{name}, byte {at}: the payload is not the one written")
                    else:
                        size, digest = int(head.rsplit(b"Content-Length: ", 1)[1]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    page = _number(fields["WARC-Record-ID"])
                    key = (fields["X-URL-Key"], fields["WARC-Date"], _first(page))
                    runs += before is not None and key < before
                    before = key
                    out.append((f"{name}#{runs}", seq, fields["X-URL-Key"], fields["WARC-Date"], page, kind, at, len(block), size, digest, _number(fields.get("WARC-Refers-To"))))
                if out:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted lists: the winner leaves, and its next item replays the
    comparisons on the way to the root, one a level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a comes before run b; runs at their end come last."""
        x, y = self.runs[a], self.runs[b]
        if self.at[a] >= len(x):
            return False
        return self.at[b] >= len(y) or (x[self.at[a]], a) < (y[self.at[b]], b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        if not self.k:
            return
        while True:
            winner = self.tree[0]
            if self.at[winner] >= len(self.runs[winner]):
                return
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self._replay(winner)


def merged_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``captures`` with (shard, position): the global order by (url_key, captured,
    page_id, run, seq).  Ranges are of the whole order, so one busy URL, or one capture
    that is there many times, spreads over shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        name = table.column("run").to_pylist()
        keys = list(zip(table.column("url_key").to_pylist(), table.column("captured").to_pylist(), map(_first, table.column("page_id").to_pylist()), name, range(table.num_rows)))
        cuts = [k for k in range(len(name)) if k == 0 or name[k] != name[k - 1]]  # rows come in the order of run and place
        order = [x[-1] for x in LoserTree([keys[a:b] for a, b in zip(cuts, [*cuts[1:], len(name)])])]
        table = table.take(pa.array(order)).combine_chunks()
        table = table.append_column("shard", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())).append_column("position", pa.array(range(len(order)), pa.int64()))
        yield from table.to_batches()

    width = max(shuffle_width(captures.sparkSession), -(-captures.count() // range_rows))
    ranges = captures.repartitionByRange(width, "url_key", "captured", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return ranges.mapInArrow(run, CAPTURE + ", shard int, position long")


def roundtrip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` into a new folder of the shared one, read the archives back and
    merge their index."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least)
    return merged_index(written(read(spark, path), "captures"))
