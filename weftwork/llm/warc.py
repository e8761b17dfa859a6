"""WARC archives and their index: sorted capture runs, merged by a loser tree.

``write_archives`` turns pages into WARC/1.1 records (one gzip member each) in
files in the shared folder. Of captures with equal payloads that with the
smallest page_id becomes a response, the others become revisits that refer to it
and carry no payload.

``capture_runs`` reads each archive from its start, checks every record, and
gives its captures in runs sorted by (URL key, time, page_id), each run bounded
in length. ``merged`` deals the runs out by ranges of that key, and in each range
a loser tree merges the parts of all runs. Order over all is (part, position): the
capture history of a URL, or of a host, lies together in time order, also where
it is so long that several ranges share it.

Scale: payloads stay where they are read (see ``write_archives``). Ranges are cut by the whole key, so one host or URL with a third of all
captures spreads over many ranges. A range holds index rows only, no payloads.
A writer that is run again writes a file of another name; only files named in
the stored manifest are read.

Defined cases: a null html is an empty payload, which is a payload like others;
a null url is written as ``urn:weftwork:no-url`` and has the empty URL key; a null
page_id is written as an empty number and is response only if no other has its
payload; all rows with the smallest page_id of a payload are responses; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm import common

#: Time of the capture of page 0; page n follows n seconds later where the table has no time of its own.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
NO_URL = "urn:weftwork:no-url"
RUN_ROWS = 50_000
READ_BYTES = 1 << 16


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query, in lower case; scheme and fragment go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    found = ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return found + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC record; without a payload a revisit, which keeps the HTTP header that tells the payload's length."""
    revisit = payload is None
    number = "" if page_id is None else str(page_id)
    when = (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % 10**10)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:weftwork:page:{number}>",
        f"WARC-Date: {when}", f"WARC-Target-URI: {(url or NO_URL).translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:weftwork:page:{'' if refers_to is None else refers_to}>",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Capture:
    page_id: int | None
    url: str
    date: str
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    payload: bytes | None


def _number(urn: str) -> int | None:
    found = urn.strip("<>").rpartition(":")[2]
    return int(found) if found else None


def parsed(raw: bytes) -> Capture:
    """A record read back. The digest of a response is computed from its payload and must be the one in its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record ends early or late")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    url = fields["WARC-Target-URI"]
    return Capture(
        _number(fields["WARC-Record-ID"]), "" if url == NO_URL else url, fields["WARC-Date"], length, digest, fields["WARC-Type"],
        _number(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload,
    )


def members(stream):
    """(offset, length, bytes) of each gzip member of a stream."""
    offset, held = 0, b""
    while True:
        held = held or stream.read(READ_BYTES)
        if not held:
            return
        unpack, out, used = zlib.decompressobj(wbits=31), [], 0
        while not unpack.eof:
            if not held:
                held = stream.read(READ_BYTES)
                if not held:
                    raise ValueError("an archive ends within a record")
            out.append(unpack.decompress(held))
            used += len(held) - len(unpack.unused_data)
            held = unpack.unused_data if unpack.eof else b""
        yield offset, used, b"".join(out)
        offset += used


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder as pyarrow sees it; a path without a scheme is a mounted folder."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def light(pages: DataFrame) -> DataFrame:
    """page_id, url, html and what tells payloads apart: SHA-1, length and a second hash."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return known.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long"), "other": F.xxhash64("html")})


PAYLOAD = ["digest", "size", "other"]


def revisits_of(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, size, other, first_id of the captures whose payload a smaller page_id has. No payload is dealt out."""
    known = light(pages).select("page_id", "url", *PAYLOAD)
    first = known.groupBy(*PAYLOAD).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return known.join(first, PAYLOAD).where(~F.col("page_id").eqNullSafe(F.col("first_id")))


def write_archives(pages: DataFrame, folder: str, bits: int = 1 << 23) -> DataFrame:
    """The manifest (file, records) of the archives; each partition writes one file.

    Revisits carry no payload, so they are written from their page_id, URL and
    digest alone. A bitmap of them, of a fixed size, lets the other pages be
    written where they are read; the few that it takes for revisits by mistake are
    found by an exact join, and only they and their payloads are dealt out.
    """
    spark = pages.sparkSession
    key = F.xxhash64("page_id", *PAYLOAD)
    whole = light(pages).withColumn("key", key)

    def write(batches, revisit: bool):
        out, name, n = None, f"{uuid.uuid4().hex}.warc.gz", 0
        fs, base = filesystem(folder)
        try:
            for batch in batches:
                for part in [batch] if revisit else common.slices(batch, "html"):
                    for row in part.select(["page_id", "url", "digest", "size", "first_id" if revisit else "html"]).to_pylist():
                        if out is None:
                            fs.create_dir(base, recursive=True)
                            out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        b32 = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                        payload = None if revisit else row["html"].encode()
                        raw = record(row["page_id"], row["url"], payload, row["size"], b32, row.get("first_id"))
                        pack = zlib.compressobj(5, wbits=31)
                        out.write(pack.compress(raw) + pack.flush())
                        n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    shape = "file string, records long"
    with common.passing(spark):
        again = common.stored(revisits_of(pages), "revisits")
        bitmap = common.sent(spark, common.bitmap_of(again.select(key.alias("key")), "key", bits))

        def hit(batch: pa.RecordBatch, held) -> np.ndarray:
            return common.in_bitmap(held, np.asarray(batch.column("key")).view(np.uint64))

        def apart(batches):
            yield from write((b.filter(pa.array(~hit(b, bitmap.value))) for b in batches), False)

        def keys(batches):
            for batch in batches:
                yield batch.filter(pa.array(hit(batch, bitmap.value)))

        # Pages that the bitmap takes for revisits and that are none.
        mistaken = whole.select("page_id", *PAYLOAD, "key").mapInArrow(common.frugal(keys), "page_id long, digest string, size long, other long, key long")
        mistaken = common.stored(mistaken.join(again.select(key.alias("key")), "key", "left_anti").select("key").distinct(), "mistaken")
        doubtful = common.sent(spark, common.bitmap_of(mistaken, "key", bits))

        def through(batches):
            for batch in batches:
                yield batch.filter(pa.array(hit(batch, doubtful.value)))

        wide = "page_id long, url string, html string, digest string, size long, other long, key long"
        rest = whole.mapInArrow(common.frugal(through), wide).join(mistaken, "key", "left_semi")
        done = whole.mapInArrow(common.frugal(apart), shape)
        done = done.unionByName(rest.mapInArrow(common.frugal(lambda b: write(b, False)), shape))
        done = done.unionByName(again.mapInArrow(common.frugal(lambda b: write(b, True)), shape))
        return common.stored(done, "manifest", outlives=True)


INDEX = (
    "run string, url_key string, date string, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, file string, offset long, length long"
)
INDEX_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def order_of(row) -> tuple:
    """The order of captures: URL key, time, page_id (a missing one first)."""
    return row[1], row[2], row[3] is not None, row[3] or 0


def capture_runs(manifest: DataFrame, folder: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Index rows of all archives, in sorted runs of bounded length."""

    def run(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, runs = [], 0

                def sorted_run(rows, name):
                    rows.sort(key=order_of)
                    for at in range(0, len(rows), 5000):
                        columns = zip(*((name, *r[1:]) for r in rows[at : at + 5000]), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, INDEX_TYPES, strict=True)], INDEX_NAMES)

                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for offset, length, raw in members(stream):
                        c = parsed(raw)
                        rows.append(("", url_key(c.url), c.date, c.page_id, c.url, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to, file, offset, length))
                        if len(rows) == run_rows:
                            yield from sorted_run(rows, f"{file}#{runs}")
                            rows, runs = [], runs + 1
                if rows:
                    yield from sorted_run(rows, f"{file}#{runs}")

    return manifest.select("file").mapInArrow(common.frugal(run), INDEX)


class LoserTree:
    """K-way merge of sorted lists: each inner node holds the loser of its match, so a step costs log k comparisons."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.keys = [order_of(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _build(self, node: int) -> int:
        """Play the matches below a node; leaf j stands at position k + j."""
        winner: dict[int, int] = {self.k + j: j for j in range(self.k)}
        for n in range(self.k - 1, 0, -1):
            a, b = winner.pop(2 * n), winner.pop(2 * n + 1)
            if self._beats(b, a):
                a, b = b, a
            winner[n], self.losers[n] = a, b
        return winner[node]

    def __iter__(self):
        while self.keys[self.winner] is not None:
            j = self.winner
            run = self.runs[j]
            yield run[self.at[j]]
            self.at[j] += 1
            self.keys[j] = order_of(run[self.at[j]]) if self.at[j] < len(run) else None
            node, best = (self.k + j) // 2, j
            while node:
                if self._beats(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def merged(runs: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """All index rows in one order: (part, position). The number of ranges grows with the rows, so a range stays small."""
    from pyspark import TaskContext

    held = common.stored(runs, "runs")
    ranges = max(1, -(-held.count() // range_rows), min(16, held.rdd.getNumPartitions()))

    def run(batches):
        found: dict[str, list[list[tuple]]] = {}
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in INDEX_NAMES), strict=True):
                parts = found.setdefault(row[0], [[]])
                # Rows of a run come in order; should a piece of it come late, it is a run of its own.
                if parts[-1] and order_of(parts[-1][-1]) > order_of(row):
                    parts.append([])
                parts[-1].append(row)
        tree = LoserTree([p for name in sorted(found) for p in found[name]])
        part, rows, position = TaskContext.get().partitionId(), [], 0

        def out(rows, position):
            columns = list(zip(*rows, strict=True))
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns, INDEX_TYPES, strict=True)), pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(position, position + n), pa.int64())],
                [*INDEX_NAMES, "part", "position"],
            )

        for row in tree:
            rows.append(row)
            if len(rows) == 5000:
                yield out(rows, position)
                rows, position = [], position + 5000
        if rows:
            yield out(rows, position)

    return held.repartitionByRange(ranges, "url_key", "date", "page_id").mapInArrow(common.frugal(run), INDEX + ", part int, position long")


def capture_index(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives of the pages, read them back, and merge their indexes."""
    folder = folder or f"{common.fresh_folder(pages.sparkSession)}/warc"
    manifest = write_archives(pages, folder)
    spread = manifest.repartition(max(1, pages.sparkSession.sparkContext.defaultParallelism * 2))
    return merged(capture_runs(spread, folder))


def ranked(index: DataFrame) -> DataFrame:
    """The merged index with capture_rank: the place of each capture in the order over all, from 1."""
    held = common.stored(index, "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_of"))
    return held.join(offsets, "part").withColumn("capture_rank", (F.col("offset_of") + F.col("position") + 1).cast("long"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(capture_index(common.read(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_rank"
    )


OP2_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['host', 'path', 'query']) AS x FROM pages),
ranks AS (SELECT page_id, row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(regexp_replace(x.host, '^www\.', ''), '.')), ',') || ')' ||
  CASE WHEN x.path = '' THEN '/' ELSE x.path END || CASE WHEN x.query = '' THEN '' ELSE '?' || x.query END, page_id) AS capture_rank FROM u),
p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits,
  min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
fives AS (SELECT string_agg((i // 16 % 2)::VARCHAR || (i // 8 % 2) || (i // 4 % 2) || (i // 2 % 2) || (i % 2), ' ' ORDER BY i) AS all_fives FROM range(32) t(i))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((strpos(all_fives, substr(bits, (5 * k + 1)::BIGINT, 5)) - 1) // 6 + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, capture_rank
FROM d JOIN ranks USING (page_id), fives
"""
