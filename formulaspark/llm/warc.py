"""Operator 6: WARC archives of pages, and their index by external merge.

Tasks write pages as WARC/1.0 records, one gzip member each, into archive files below a
folder of any store that Arrow opens; of records with equal payloads the one with the
smallest page_id is a ``response`` and the others are ``revisit`` records that refer to it
and carry no payload (``least`` bytes or more; smaller payloads are always responses).
A file counts only if the task that wrote it ended well, as its name is in the manifest;
files of lost tasks are left aside.

Reading an archive back gives a *run* of captures, sorted by URL key, time and page_id.
Spark parts the runs by range, with splitters that it samples; each task merges its
share of all runs with a loser tree.  ``bucket`` and ``place`` give the global order, in
which a URL's captures follow each other by time.  The full key takes part in the range,
so that one URL with very many captures spreads over tasks.

Defined results: times outside the years 1 to 9999 count as the nearer end; null html is an empty payload; a null url has an empty key; a null
page_id sorts first and refers to the smallest known one of its payload, if there is
one, else it is a response; rows that repeat the smallest page_id are all responses;
empty tables give no rows.  Only ``page_id``, ``url``, ``html`` and, if named, the time
column are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, read_table, rows_of, shared_dir, stored
from .records import file_system

#: The time of page 0 where pages bring none; page n counts as n seconds later, modulo a century.
EPOCH, CENTURY = 1_704_067_200, 3_155_760_000
#: The first and last second of the years 1 to 9999; other times count as the nearer of them.
FIRST, LAST = -62_135_596_800, 253_402_300_799


def base32_sha1(payload: F.Column) -> F.Column:
    """Upper-case base32 of the SHA-1, by groups of 20 bits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    # base-32 digits 0-9A-V stand for A-Z2-7 of RFC 4648
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str) -> str:
    """Host from its last part on, then path and sorted query: ``com,example)/a?b=1``."""
    try:
        parts = urlsplit(url.strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.strip().lower()
    query = "&".join(sorted(q for q in parts.query.lower().split("&") if q))
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path.lower().rstrip("/") or "/") + (f"?{query}" if query else "")


def stamp(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z")


def record(page_id, url: str, time: int, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url),
        f"WARC-Date: {stamp(time)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream, size: int = 1 << 20):
    """(offset, stored length, content) of each gzip member of an open file."""
    offset, rest = 0, b""
    while True:
        rest = rest or stream.read(size)
        if not rest:
            return
        unzip, out, length = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not rest and not (rest := stream.read(size)):
                raise ValueError("an archive ends within a record")
            out.append(unzip.decompress(rest))
            length += len(rest)
            rest = unzip.unused_data
            length -= len(rest)
        yield offset, length, b"".join(out)
        offset += length


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record, and its payload (empty for a revisit)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload-length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return fields, payload


def write_archives(pages: DataFrame, path: str, time: str | None = None, least: int = 0, file_bytes: int = 64_000_000) -> DataFrame:
    """Writes the archives; the manifest has their ``path`` and ``n_records``."""
    when = F.unix_timestamp(time) if time else F.pmod(F.col("page_id").cast("long"), F.lit(CENTURY)) + EPOCH
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.least(F.greatest(F.coalesce(when, F.lit(EPOCH)), F.lit(FIRST)), F.lit(LAST)).alias("time"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    # only digests that occur again need the join's right side
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))) & (F.length("payload") >= least)
    rows = rows.join(first, "digest", "left").withColumn("refers_to", F.when(again, F.col("first"))).drop("first")

    def write(batches):
        store, root = file_system(path)
        store.create_dir(root, recursive=True)
        out, n, size = None, 0, 0
        for page_id, url, when, payload, digest, refers_to in rows_of(batches, "page_id", "url", "time", "payload", "digest", "refers_to"):
            if out is None:
                name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            zipper = zlib.compressobj(1, wbits=31)
            member = zipper.compress(record(page_id, url, when, payload, digest, refers_to)) + zipper.flush()
            out.write(member)
            n, size = n + 1, size + len(member)
            if size >= file_bytes:
                out.close()
                out = None
                yield f"{path}/{name}", n
        if out:
            out.close()
            yield f"{path}/{name}", n

    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
    return stored(rows.mapInArrow(lambda b: batched(write(b), schema), "path string, n_records long"), "warc-manifest")


_CAPTURE = pa.schema(
    [
        ("run", pa.string()),
        ("urlkey", pa.string()),
        ("time", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
_CAPTURE_KIND = "run string, urlkey string, time string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"


def order_key(row: tuple) -> tuple:
    """URL key, time, page_id (null first), place in the archive."""
    return row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[9]


def capture_runs(manifest: DataFrame) -> DataFrame:
    """The captures of each archive, read back from it and sorted; digests are checked."""

    def number(field: str) -> int | None:
        digits = field.removeprefix("<urn:page:").rstrip(">")
        return int(digits) if digits else None

    def read(batches):
        for (path,) in rows_of(batches, "path"):
            store, name = file_system(path)
            run = []
            with store.open_input_stream(name, compression=None) as stream:
                for offset, length, content in members(stream):
                    fields, payload = parsed(content)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path} at {offset}: the payload does not fit its digest")
                    refers_to = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                    url = fields["WARC-Target-URI"]
                    run.append((path, url_key(url), fields["WARC-Date"], number(fields["WARC-Record-ID"]), url, int(fields["payload-length"]), digest, fields["WARC-Type"], refers_to, offset, length))
            yield from sorted(run, key=order_key)

    files = max(1, manifest.count())
    return stored(manifest.select("path").repartition(files).mapInArrow(lambda b: batched(read(b), _CAPTURE), _CAPTURE_KIND), "warc-runs")


class LoserTree:
    """Merges sorted lists: inner nodes hold the loser of their match, the winner goes up."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.n = runs, [0] * len(runs), len(runs)
        self.head = [self._key(i) for i in range(self.n)]
        self.losers = [-1] * self.n
        self.winner = self._play(1) if self.n > 1 else 0

    def _key(self, i: int):
        return (0, *order_key(self.runs[i][self.at[i]])) if self.at[i] < len(self.runs[i]) else (1,)

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self.head[a] <= self.head[b] else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.n and self.head[self.winner][0] == 0:
            i = self.winner
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.head[i] = self._key(i)
            node = (i + self.n) // 2
            while node:
                other = self.losers[node]
                if self.head[other] < self.head[i]:
                    self.losers[node], i = i, other
                node //= 2
            self.winner = i


def merged_index(runs: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """All captures in global order of ``bucket, place``."""

    def merge(batches):
        by_run: dict[str, list[tuple]] = {}
        for row in rows_of(batches, *_CAPTURE.names):
            by_run.setdefault(row[0], []).append(row)
        for run in by_run.values():  # a run comes in order unless the shuffle changed it
            if any(order_key(a) > order_key(b) for a, b in zip(run, run[1:], strict=False)):
                run.sort(key=order_key)
        bucket = TaskContext.get().partitionId()
        for place, row in enumerate(LoserTree(list(by_run.values()))):
            yield (*row, bucket, place)

    schema = pa.schema([*_CAPTURE, ("bucket", pa.int64()), ("place", pa.int64())])
    buckets = max(1, -(-runs.count() // bucket_rows))
    ranged = runs.repartitionByRange(buckets, "urlkey", "time", F.col("page_id").asc_nulls_first(), "run", "offset")
    return ranged.mapInArrow(lambda b: batched(merge(b), schema), f"{_CAPTURE_KIND}, bucket long, place long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(read_table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    index = merged_index(capture_runs(manifest))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "time", "bucket", "place")
