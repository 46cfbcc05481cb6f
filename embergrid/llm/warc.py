"""WARC archives, and a capture index merged from sorted runs.

Writing: each page is a record. Of records with equal payloads of at least ``min_bytes`` bytes, those with the largest page_id are
responses and the others revisits that refer to it. Which payloads occur more than once is found by a
two-pass Bloom filter over SHA-1 digests, so pages with a payload of their own pass without a shuffle; of the others the html of
responses alone is shuffled. The archives
are gzip text files of Spark's own writer (records end with CRLF CRLF), so attempts of lost tasks leave nothing behind.

Reading: each archive is unpacked and parsed record by record, by Content-Length, whatever its payloads contain, into one run of captures sorted by
URL key, time and page_id, which are written as a table. Ranges of that key, as many as keep a range to some RANGE_ROWS captures, each
merge their k pieces by a loser tree, so the index is in one order from the first partition to the last and no task's memory grows with the input.

Cases: a payload of any length is one record (a task that reads an archive holds it packed, and one record of it); a null html is an empty payload; a null or many-line url is written empty or percent-encoded; page ids may be null (they sort first
and are never referred to before others); rows that tie on the largest page_id are all responses; an empty table writes no
record and reads none; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import Staging, join_hot, small_batches, staged, tidy

RECORDS_PER_FILE = 1024
FIRST_DAY = "2023-11-14"
SPAN = 20 * 365 * 86_400
RANGE_ROWS = 100_000
CAPTURE = [("run", pa.string()), ("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("offset", pa.int64()), ("intact", pa.bool_())]
SCHEMA = "run string, url_key string, ts string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, offset bigint, intact boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, ts: str, html: str | None, size: int, sha1: bytes, refers_to: int | None) -> str:
    """A record without its last CRLF, which the writer adds."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http if refers_to is not None else http + (html or "")
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {ts}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n"


@tidy
def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array([record(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.string())], names=["value"])


def write(pages: DataFrame, target: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, id_col: str = "page_id") -> None:
    """Write the archives of pages (page_id, url, html) to the folder target."""
    spark = pages.sparkSession
    small_batches(spark)
    stage = Staging(spark)
    html, page = F.coalesce(F.col("html"), F.lit("")), F.col(id_col).cast("long")
    second = F.pmod(F.coalesce(page, F.lit(0)), F.lit(SPAN))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    ts = F.concat(F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(second / 86_400).cast("int")).cast("string"), F.lit("T"), two(second % 86_400 / 3_600), F.lit(":"), two(second % 3_600 / 60), F.lit(":"), two(second % 60), F.lit("Z"))
    rows = pages.select(page.alias("page_id"), "url", ts.alias("ts"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"))
    total = pages.count()
    bits = bloom.filter_bits(total, 16, 1 << 30)
    found = stage.send(bloom.build(rows.select("sha1"), bits, repeated=True))

    def maybe(sha1: pa.Array) -> pa.Array:
        return pa.array(bloom.test(found.value, bloom.pairs_of(sha1)) if len(sha1) else np.zeros(0, bool))

    repeated = F.arrow_udf(maybe, "boolean").asNondeterministic()("sha1") & (F.col("size") >= min_bytes)
    again = stage.table(rows.select("page_id", "size", "sha1").where(repeated), "again")
    last = stage.table(again.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")), "last")
    # who answers is known from the digests; a second filter picks out the html to send
    key = lambda page: F.unhex(F.md5(F.concat_ws("|", F.hex("sha1"), F.coalesce(page.cast("string"), F.lit("none")))))
    answers = stage.send(bloom.build(last.select(key(F.col("last")).alias("k")), bits, repeated=False))

    def answering(keys: pa.Array) -> pa.Array:
        return pa.array(bloom.test(answers.value, bloom.pairs_of(keys)) if len(keys) else np.zeros(0, bool))

    rows = rows.withColumn("maybe", repeated)
    own = rows.where(~F.col("maybe")).drop("maybe").withColumn("refers_to", F.lit(None).cast("long"))
    may = F.arrow_udf(answering, "boolean").asNondeterministic()(key(F.col("page_id")))
    met = rows.where("maybe").drop("maybe").withColumn("html", F.when(may, F.col("html")))
    met = join_hot(met, last, "sha1", F.xxhash64("page_id"), "copies", total).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))
    columns = ["page_id", "url", "ts", "html", "size", "sha1", "refers_to"]
    both = own.select(*columns).unionByName(met.select(*columns)).mapInArrow(_records, "value string")
    both.write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(target)
    stage.recall()
    stage.drop("again", "last")


def url_key(url: str) -> str:
    """Host parts from the last to the first, then path and query: pages of a site sort together."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def parse(archive: BinaryIO) -> Iterator[dict]:
    """Records of an archive, one after the other; one record is held at a time."""
    at = 0
    while line := archive.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record at {at}")
        lines, size = [], len(line)
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"the record at {at} has no end")
            lines.append(line.decode().removesuffix("\r\n"))
            size += len(line)
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        block, after = archive.read(int(head["Content-Length"])), archive.read(4)
        end = at + size + 2 + len(block)
        if after != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end at {end}")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", http + b"\r\n")[1])
        yield {"offset": at, "head": head, "payload_bytes": length, "payload": payload}
        at = end + 4


def _number(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def order(row: tuple) -> tuple:
    """Order of captures: URL key, time, page_id (null first)."""
    return row[1], row[2], row[3] is not None, row[3] or 0


@tidy
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files -> sorted runs of captures."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = []
            for r in parse(gzip.open(io.BytesIO(content))):
                head, revisit = r["head"], r["head"]["WARC-Type"] == "revisit"
                said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                digest = said if revisit else base32_sha1(hashlib.sha1(r["payload"]).digest())
                rows.append((path.rpartition("/")[2], url_key(head["WARC-Target-URI"]), head["WARC-Date"], _number(head["WARC-Record-ID"]), head["WARC-Type"], _number(head.get("WARC-Refers-To")), r["payload_bytes"] if revisit else len(r["payload"]), digest, r["offset"], digest == said and (revisit or len(r["payload"]) == r["payload_bytes"])))
            rows.sort(key=order)
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(CAPTURE)], names=[n for n, _ in CAPTURE])


class LoserTree:
    """Merge of k sorted lists: a match is played again only along the winner's way to the root."""

    def __init__(self, runs: list[list[tuple]], key=order):
        self.runs, self.key, k = runs, key, len(runs)
        self.at = [0] * k
        self.heads = [self._head(i) for i in range(k)]
        self.loser = [-1] * k
        winner = [0] * (2 * k)
        for i in range(k):
            winner[k + i] = i
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.best = winner[1] if k > 1 else 0

    def _head(self, i: int) -> tuple:
        run = self.runs[i]
        return (0, self.key(run[self.at[i]])) if self.at[i] < len(run) else (1,)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.heads[self.best][0] == 0:
            i = self.best
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            node = (k + i) // 2
            while node:
                if self.heads[self.loser[node]] < self.heads[i]:
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.best = i


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of all runs -> captures in order. Pieces of a run arrive sorted; where one does not go on, a new one begins."""
    pieces: list[list[tuple]] = []
    current: dict[str, list[tuple]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            piece = current.get(row[0])
            if piece is None or order(row) < order(piece[-1]):
                pieces.append(piece := [])
                current[row[0]] = piece
            piece.append(row)
    out: list[tuple] = []

    def batch():
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(CAPTURE)], names=[n for n, _ in CAPTURE])

    for row in LoserTree(pieces):
        out.append(row)
        if len(out) == 4096:
            yield batch()
            out.clear()
    if out:
        yield batch()


def read_index(spark: SparkSession, source: str, ranges: int | None = None) -> DataFrame:
    """All captures of the archives in folder source, in global order of URL key, time and page_id.

    `ranges`: their number, else as many as RANGE_ROWS asks for."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(source).select("path", "content")
    runs = staged(files.mapInArrow(_runs, SCHEMA), "runs")
    n = ranges or max(1, -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(n, "url_key", "ts", "page_id").mapInArrow(_merge, SCHEMA)
