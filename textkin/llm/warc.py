"""WARC archives of captured pages, and their index merged from sorted runs.

* ``write_archives`` writes one record per page. Of pages with equal payloads (at least ``min_bytes`` long) the one with the
  smallest id is a ``response``, the others are ``revisit`` records without payload that refer to it. A record is a line of
  Spark's text sink whose line separator is the blank line that ends WARC records. Archives hold about ``ARCHIVE_BYTES``
  and are compressed with gzip; offsets and lengths in the index are those of the uncompressed records.
* ``read_archives`` reads the files whole, checks every payload against its digest and returns the captures of each
  archive as a run sorted by URL key, timestamp and id.
* ``merge_index`` deals the runs to ranges of (URL key, timestamp, id) and merges the slices of each range with a loser
  tree. Ranges split the captures of one URL where it has very many; its capture numbers are then added up over ranges.

Nulls and edges: a null html is an empty payload. A null or empty URL has the key ``)/`` and no target URI; line breaks in URLs are
written as %0D and %0A. A null id is written as ``-`` and read back as null; it is never the smallest id, and pages
that only have null ids are all responses. Repeated rows are records of their own; of equal ids and payloads all are
responses if the id is the smallest. No rows give no archives and no captures. Other columns are not read.
"""

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textkin.session import cut

ARCHIVE_BYTES = 16_000_000
MERGE_ROWS = 500_000
START = "2024-01-01 00:00:00"
#: Seconds after which the timestamps made from ids start over.
CYCLE = 315_360_000

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648

CAPTURES = ("run string, seq long, offset long, length long, record_type string, page_id long, url string, url_key string, "
            "ts string, payload_bytes long, payload_digest string, refers_to long")
MERGED = "part int, place long, run string, seq long"


def digest(payload):
    """Bare upper-case base32 SHA-1 of a UTF-8 column: each 5 hex digits make 4 base32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def timestamp(id):
    """A capture time made from an id, in seconds after ``START``; no session time zone enters."""
    seconds = F.pmod(F.coalesce(id, F.lit(0)), F.lit(CYCLE))
    made = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.concat(F.replace(F.substring(made.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def roles(pages: DataFrame, min_bytes=0) -> DataFrame:
    """``(key, record_type, refers_to)`` of every id and payload: who keeps the payload and who refers to whom."""
    seen = pages.select("key", "page_id", "payload_digest", "payload_bytes").distinct()
    first = seen.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    again = (F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull())
    return seen.join(first, "payload_digest", "left").select(
        F.col("key").alias("role_key"), F.when(again, F.col("first")).alias("refers_to"))


def _record():
    shown = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    name = lambda x: F.concat(F.lit("<urn:page:"), x, F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END))
    headers = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(shown)),
        F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), uri)),
        F.concat(F.lit("WARC-Date: "), timestamp(F.col("page_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to").cast("string")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *headers), F.lit(END), http, body)


def write_archives(pages: DataFrame, path: str, id="page_id", url="url", html="html", min_bytes=0, archive_bytes=ARCHIVE_BYTES):
    """Write a record per page to archives under ``path``."""
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    size = rows.agg(F.sum(F.octet_length("payload") + 600)).first()[0] or 0
    archives = max(1, -(-size // archive_bytes))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", digest(F.col("payload")))
    rows = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "payload_digest"))
    role = roles(rows, min_bytes).repartition(archives, "role_key")
    rows = rows.repartition(archives, "key").join(role.hint("merge"), F.col("key") == F.col("role_key"))
    rows.select(_record().alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query; scheme, port, ``www.`` and fragment are left out."""
    rest = (url or "").split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cuts = [i for i in (rest.find("/"), rest.find("?")) if i >= 0]
    at = min(cuts, default=len(rest))
    host, path = rest[:at].rsplit("@", 1)[-1].split(":", 1)[0].lower(), rest[at:]
    host = host[4:] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + ")" + (path if path.startswith("/") else "/" + path)


def parse_archive(data: bytes):
    """Records of an archive: ``(offset, length, headers, payload)``."""
    at, blank = 0, END.encode()
    while at < len(data):
        head = data.index(blank, at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = head + len(blank)
        stop = start + int(headers["Content-Length"])
        if data[stop:stop + len(blank)] != blank:
            raise ValueError(f"record at {at} has another length")
        yield at, stop + len(blank) - at, headers, data[data.index(blank, start) + len(blank):stop]
        at = stop + len(blank)


def _id(name):
    shown = name.removeprefix("<urn:page:").removesuffix(">")
    return None if shown == "-" else int(shown)


def _read(batches):
    names = [x.split()[0] for x in CAPTURES.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            out = []
            for offset, length, headers, payload in parse_archive(gzip.decompress(content.as_buffer())):
                told, revisit = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"] == "revisit"
                if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != told:
                    raise ValueError(f"{path} at {offset}: payload doesn't match its digest")
                url = headers.get("WARC-Target-URI")
                out.append((url_key(url), headers["WARC-Date"], _id(headers["WARC-Record-ID"]), offset, length, headers["WARC-Type"], url,
                            None if revisit else len(payload), told, _id(headers["WARC-Refers-To"]) if revisit else None))
            out.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3]))
            if out:
                key, ts, page, offset, length, kind, url, size, told, refers = zip(*out)
                columns = dict(run=[path] * len(out), seq=range(len(out)), offset=offset, length=length, record_type=kind, page_id=page,
                               url=url, url_key=key, ts=ts, payload_bytes=size, payload_digest=told, refers_to=refers)
                kinds = [pa.string() if " string" in x else pa.int64() for x in CAPTURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(columns[c]), k) for c, k in zip(names, kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives under ``path``: per archive (``run``) sorted by URL key, timestamp and id.

    The payload length of a revisit is that of the response it refers to.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = cut(files.mapInArrow(_read, CAPTURES), "runs")
    # Lengths are asked for by digest: one row per payload.
    sizes = runs.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("known"))
    return runs.join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "known")).drop("known")


class LoserTree:
    """Merges sorted lists. Inner nodes keep the loser of their match, so a new head plays one match per level."""

    def __init__(self, runs):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [0] * max(1, self.k)
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a, b):
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, node):
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _merge(batches):
    """Loser-tree merge of the slices that a range has of every run."""
    from pyspark import TaskContext

    runs = {}
    for batch in batches:
        for r in zip(*[batch[c].to_pylist() for c in ("url_key", "ts", "page_id", "run", "seq")]):
            runs.setdefault(r[3], []).append((r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4]))
    for own in runs.values():
        own.sort(key=lambda r: r[5])  # slices come in order but for spills
    merged = list(LoserTree([runs[x] for x in sorted(runs)]))
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([
        pa.array([part] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64()),
        pa.array([r[4] for r in merged], pa.string()), pa.array([r[5] for r in merged], pa.int64())], ["part", "place", "run", "seq"])


def merge_index(captures: DataFrame, range_rows=MERGE_ROWS) -> DataFrame:
    """``captures`` with ``position`` in the global order and ``capture``, the number within the history of its URL key, both from 1."""
    order = ["url_key", "ts", "page_id"]
    held = cut(captures, "captures")
    ranges = max(1, -(-held.count() // range_rows), min(8, held.rdd.getNumPartitions()))
    merged = cut(held.repartitionByRange(ranges, *order).select(*order, "run", "seq").mapInArrow(_merge, MERGED), "merged")
    offsets = merged.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    offsets = offsets.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = held.join(merged, ["run", "seq"]).join(F.broadcast(offsets), "part").withColumn("position", F.col("before") + F.col("place") + 1)
    first = placed.groupBy("url_key").agg(F.min("position").alias("first_position"))
    return placed.join(first, "url_key").withColumn("capture", F.col("position") - F.col("first_position") + 1).drop(
        "part", "place", "before", "first_position")
