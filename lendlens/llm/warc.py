"""WARC archives: written, normalised to one gzip member for each record with an offset index, and read back.

Some crawlers gzip a whole archive as one stream, and then no record can be reached without inflating all before it. The
normaliser inflates such a file once, from start to end, and writes each record as a gzip member of its own, with a
sidecar index that has a line for each record: where its member starts, how long it is, its type, ID and payload digest. A
file that has members already goes through unharmed. Records are passed on in pieces, so a record of any length needs
little memory. Archives are rows of a table of paths; each is one task's work, and writers begin a new one after
``ARCHIVE_BYTES``, so the largest task is bounded.

Files get their name once they are whole, and the tables list only what finished tasks wrote: a task that runs again
writes new files and leaves none half done.

*Revisits.* Of records with equal payloads (SHA-1) the one with the largest page_id is a response, others refer to it
and carry no payload; payloads under ``least`` bytes are always responses. The winners are found by partial
maxima; only payloads of two records or more are joined back, and Spark splits a large group in that join.

Defined cases: a null html is an empty payload, a null url an urn; null page_ids come before all others, and records of a
group of only null ones are all responses, as are rows that repeat the winner's page_id; an empty table gives no archive
and no rows; a file cut short or without a WARC header where one must be stops the job with its name and place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import pieces, staged
from lendlens.llm.files import new_folder, open_draft, open_input, write_whole

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
BATCH_BYTES = 16 << 20
DATE = "2024-09-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"
ARCHIVES = "path string, records long"
NORMALISED = "path string, index string, records long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, archive string, offset long, length long"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str | None, page: str) -> str:
    """A URL on one line: blanks and control characters escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text) if text else page


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit where ``refers_to`` is given."""
    page = f"{PAGE}{'' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = [("WARC-Type", "response")] if refers_to is None else [
        ("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PAGE}{refers_to}>"),
    ]
    headers = [
        *kind, ("WARC-Record-ID", f"<{page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.when(F.length("html") >= least, F.unhex(F.sha1("html"))))
    groups = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    winners = staged(groups.where("n > 1 and winner is not null").select("sha", "winner"))
    joined = rows.join(winners, "sha", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


class _Archive:
    """A gzip file of one stream."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.out, self.finish = open_draft(self.path)
        self.gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.records = self.size = 0

    def add(self, data: bytes) -> None:
        self.out.write(self.gzip.compress(data))
        self.records += 1
        self.size += len(data)

    def close(self) -> tuple[str, int]:
        self.out.write(self.gzip.flush())
        self.out.close()
        self.finish()
        return self.path, self.records


def _listed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [pa.string()] * (len(names) - 1) + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write page_id, url, html, refers_to as archives of one gzip stream each; their paths and records."""
    folder = folder or new_folder(rows.sparkSession, "warc")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in pieces(batches, "html", BATCH_BYTES):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                archive = archive or _Archive(folder)
                archive.add(record(*row))
                if archive.size >= ARCHIVE_BYTES:
                    yield _listed([archive.close()], ["path", "records"])
                    archive = None
        if archive:
            yield _listed([archive.close()], ["path", "records"])

    return staged(rows.mapInArrow(written, ARCHIVES))


class _Inflated:
    """What a gzip file inflates to, all its members in one; read as it is needed."""

    def __init__(self, path: str):
        self.path, self.file, self.held, self.at = path, open_input(path), bytearray(), 0
        self.inflate, self.rest = zlib.decompressobj(31), b""

    def fill(self) -> bool:
        """Get some more; False at the end."""
        data = self.inflate.unconsumed_tail or self.rest or self.file.read(CHUNK)
        self.rest = b""
        if not data:
            if not self.inflate.eof:
                raise ValueError(f"{self.path}: the gzip stream ends early")
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        try:
            self.held += self.inflate.decompress(data, CHUNK)
        except zlib.error as e:
            raise ValueError(f"{self.path}: broken gzip stream after byte {self.at + len(self.held)}") from e
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
        return True

    def more(self) -> bool:
        """Pass over line ends; whether anything comes after them."""
        while True:
            self.take(len(self.held) - len(self.held.lstrip(b"\r\n")))
            if self.held:
                return True
            if not self.fill():
                return False

    def until(self, mark: bytes) -> bytes:
        """As far as the end of a mark."""
        start = 0
        while (end := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.fill():
                raise ValueError(f"{self.path}: the record at byte {self.at} has no end")
        return self.take(end + len(mark))

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out

    def chunks(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.fill():
                raise ValueError(f"{self.path}: ends within a record, at byte {self.at}")
            part = self.take(min(n, len(self.held)))
            n -= len(part)
            if part:
                yield part


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields, by lower-case name; folded lines are joined."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if ":" in line)}


def normalise_file(path: str, target: str) -> tuple[str, str, int]:
    """Write ``target`` with a member for each record of ``path``, and its index; (target, index, number of records)."""
    source = _Inflated(path)
    out, finish = open_draft(target)
    lines, offset = [], 0
    while source.more():
        at = source.at
        head = source.until(b"\r\n\r\n")
        fields = headers_of(head)
        if not head.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"{path}: no WARC record at byte {at}")
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        size = out.write(member.compress(head)) or 0
        for part in source.chunks(int(fields["content-length"])):
            size += out.write(member.compress(part))
        size += out.write(member.compress(b"\r\n\r\n") + member.flush())
        names = ("type", "warc-type"), ("id", "warc-record-id"), ("digest", "warc-payload-digest"), ("url", "warc-target-uri")
        lines.append(json.dumps({"offset": offset, "length": size} | {k: fields[n] for k, n in names if n in fields}))
        offset += size
    out.close()
    finish()
    index = f"{target}.index"
    write_whole(index, "".join(f"{x}\n" for x in lines).encode())
    return target, index, len(lines)


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Normalise the archives at ``path``; path, index and records of each result."""
    folder = folder or new_folder(archives.sparkSession, "warc-members")

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                made = normalise_file(path, f"{folder}/{uuid.uuid4().hex}.warc.gz")
                yield _listed([made], ["path", "index", "records"])

    return staged(_dealt(archives.select("path")).mapInArrow(normalised, NORMALISED))


def _dealt(rows: DataFrame) -> DataFrame:
    """One archive for each task, as far as there are slots to spare."""
    return rows.repartition(max(1, min(rows.count(), 4 * rows.sparkSession.sparkContext.defaultParallelism)))


def _page(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").removeprefix(PAGE)
    return int(digits) if digits else None


def read_member(data: bytes) -> dict:
    """The fields of one record's member, with the payload's own length and digest; fails if they don't fit its headers."""
    raw = zlib.decompress(data, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = headers_of(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    if response and base32_sha1(payload) != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "payload_bytes": len(payload) if response else int(headers_of(http)["content-length"]),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": None if response else _page(fields["warc-refers-to"]),
        "url": fields["warc-target-uri"],
    }


def read_records(normalised: DataFrame) -> DataFrame:
    """A row for each response or revisit, each read on its own by its place in the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with open_input(index) as lines:
                    entries = [json.loads(x) for x in lines.read().splitlines()]
                with open_input(path) as file:
                    rows = []
                    for entry in entries:
                        if entry["type"] in ("response", "revisit"):
                            file.seek(entry["offset"])
                            place = {"archive": path, "offset": entry["offset"], "length": entry["length"]}
                            rows.append(read_member(file.read(entry["length"])) | place)
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORDS.split(", "))])
    return _dealt(normalised.select("path", "index")).mapInArrow(read, RECORDS)


def report(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, normalise these, and read each record back."""
    return read_records(normalise(write_archives(with_revisits(pages))))


_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v{i} >> {shift}) & 31)::INT, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
_PARTS = ", ".join(f"('0x' || substr(h, {5 * i + 1}, 5))::INT AS v{i}" for i in range(8))
ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, h, {_PARTS} FROM p
), w AS (
  SELECT h, max(page_id) AS winner FROM p GROUP BY h
)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM d JOIN w USING (h)
"""
