"""WARC: converter for legacy ARC archives.

An ARC file is a version block and then records; each begins with one line of fields separated by
spaces, whose set the version block declares, and ends after the declared length:

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The converter parses lines and lengths and synthesises the WARC/1.1 record of the same meaning: a
record id derived from archive, offset and URL (the same on every run), the 14-digit date as
ISO 8601, a type (version block: warcinfo; http capture: response, or revisit; else resource), and
SHA-1 digests of block and payload. URLs may hold spaces, so fields are counted from the line's end.

Archives are files, plain or gzipped, of about IMAGE_BYTES each (a longer record gets a file of its
own). write_archives() writes them, and read_archives() reads them, with Spark's own sources, so they
may lie in any store that Spark reaches; a task that fails leaves no file behind.
Of captures with equal payloads of at least REVISIT_BYTES, the one with the largest key becomes the
response and others revisit it; keys are compared per digest, in partial aggregates, so a payload
that a third of all pages share is one row per task, and its copies meet the response without a
shuffle. Archives themselves are shuffled, compressed, only where their revisits are too many to be sent around.

Null html is an empty payload; null URLs are written as "-", and blanks or line ends in URLs are percent-coded. Rows with
equal page_id are separate records; of equal keys the larger record id is the response. Other columns play no part, and no page
gives no record. A very long payload is one record of one task. Malformed archives: a record with a broken line or
without a length, or that is cut short, ends its archive; what stands before it is converted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

IMAGE_BYTES = 16 << 20
REVISIT_BYTES = 1000
#: Field names of the two record lines, as the format's version blocks state them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Copies of a payload from which its rows meet the response by broadcast; there are at most rows / HOT_COPIES of these.
HOT_COPIES = 100_000
#: Revisits and hot payloads that are broadcast at most; more are a shuffled join.
BROADCAST_ROWS = 100_000


@dataclass
class Capture:
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


def arc_image(name: str, version: int, captures: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of captures (url, ip, 14-digit date, content type, block)."""
    info = f"{version} 0 chatloom\n{FIELDS[version]}\n".encode()
    out = bytearray(_arc_line(version, f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", name, 0, info) + info)
    for url, ip, date, mime, block in captures:
        out += b"\n" + _arc_line(version, url, ip, date, mime, name, len(out) + 1, block) + block
    return bytes(out + b"\n")


def _arc_line(version: int, url: str, ip: str, date: str, mime: str, name: str, offset: int, block: bytes) -> bytes:
    middle = f" 200 {hashlib.md5(block, usedforsecurity=False).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{middle} {len(block)}\n".encode()


def parse_arc(image: bytes) -> Iterator[Capture]:
    """Records of an ARC file, the version block first."""
    at, fields = 0, 5
    while at < len(image):
        if image[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = image.find(b"\n", at)
        if stop < 0:
            return
        parts = image[at:stop].decode("utf-8", "replace").rsplit(" ", fields - 1)
        if at == 0 and image.startswith(b"filedesc://"):  # the version block's own line has the fields that it declares
            end = image.find(b"\n", stop + 1)
            fields = 10 if image[stop + 1 : end].split(b" ", 1)[0] == b"2" else 5
            parts = image[at:stop].decode("utf-8", "replace").rsplit(" ", fields - 1)
        if len(parts) != fields or not parts[-1].isdigit() or stop + 1 + int(parts[-1]) > len(image):
            return
        block = image[stop + 1 : stop + 1 + int(parts[-1])]
        yield Capture(at, parts[0], parts[1], parts[2], parts[3], block)
        at = stop + 1 + len(block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP capture (its blank line included) and the payload."""
    cuts = [(at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    return (block[: min(cuts)], block[min(cuts) :]) if cuts else (b"", block)


def http_header(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


def is_capture(c: Capture) -> bool:
    return c.url.lower().startswith(("http://", "https://")) or c.block.startswith(b"HTTP/")


def record_id(archive: str, c: Capture) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {c.offset} {c.url}')}>"


def iso_date(date: str) -> str:
    d = (date + "00000101000000"[len(date) :]) if date.isdigit() and len(date) < 14 else date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z" if d[:14].isdigit() and len(d) >= 14 else "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def warc_record(archive: str, c: Capture, refers_to: dict | None = None) -> bytes:
    """The WARC record of an ARC record; refers_to: id, url and date of the response that a revisit points to."""
    kind, mime, block, payload = "resource", c.mime, c.block, c.block
    if c.url.startswith("filedesc://"):
        kind, mime = "warcinfo", "application/warc-fields"
        block = f"software: chatloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {archive}\r\n".encode()
    elif is_capture(c):
        head, payload = split_http(c.block)
        kind, mime = ("revisit", "application/http; msgtype=response") if refers_to else ("response", "application/http; msgtype=response")
        block = head if refers_to else c.block
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(archive, c)}", f"WARC-Date: {iso_date(c.date)}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {archive}")
    else:
        lines += [f"WARC-Target-URI: {c.url}", f"WARC-IP-Address: {c.ip}", f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Identified-Payload-Type: {c.mime}"]
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to['id']}", f"WARC-Refers-To-Target-URI: {refers_to['url']}", f"WARC-Refers-To-Date: {refers_to['date']}", f"X-Payload-Length: {len(payload)}", f"X-Refers-To-Key: {refers_to['key']}"]
    lines += [f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(image: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a WARC file."""
    at = 0
    while at < len(image):
        stop = image.find(b"\r\n\r\n", at)
        if stop < 0 or not image.startswith(b"WARC/", at):
            return
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in image[at:stop].decode("utf-8", "replace").split("\r\n")[1:])}
        size = headers.get("content-length", "")
        if not size.isdigit() or stop + 4 + (size := int(size)) > len(image):
            return
        yield headers, image[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


_ARC = "archive string, image binary"
_FACTS = "archive string, record long, key long, sha1 binary, length long, id string, url string, date string"


def archives_of_pages(pages: DataFrame, date: str = "20080229123456") -> DataFrame:
    """Legacy archives (archive, image) of pages (page_id, url, html): ARC versions 1 and 2 by turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{k:06d}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_image(name, 1 + k % 2, held)], pa.binary())], names=["archive", "image"])

        for batch in batches:
            for key, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                key = "" if key.as_py() is None else key.as_py()
                target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url.as_py() or "-")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {key}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                if held and size + len(block) > IMAGE_BYTES:
                    yield flush()
                    k, held, size = k + 1, [], 0
                held.append((target, "192.0.2.1", date, "text/html", block))
                size += len(block)
        if held:
            yield flush()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, _ARC)


def write_archives(archives: DataFrame, folder: str) -> None:
    """Each image (archive, image) as a gzipped file of its own below folder; one without a line end at its end gets one."""
    cut = F.when(F.endswith("image", F.lit(b"\n")), F.expr("substring(image, 1, length(image) - 1)")).otherwise(F.col("image"))
    # the text writer puts the bytes of a string as they are, and a line end after them
    archives.select(cut.cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """archive (a file's path), image of every file below folder."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("archive"), F.col("content").alias("image"))


def _plain(image: pa.Scalar) -> bytes:
    raw = image.as_buffer().to_pybytes() if image.is_valid else b""
    return gzip.decompress(raw) if raw.startswith(b"\x1f\x8b") else raw


def _name(archive: str, image: bytes) -> str:
    """What an ARC file calls itself in its version block."""
    return image[11 : image.find(b" ")].decode("utf-8", "replace") if image.startswith(b"filedesc://") else archive.rpartition("/")[2]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, image in zip(batch.column("archive").to_pylist(), batch.column("image"), strict=True):
            out, image = [], _plain(image)
            name = _name(archive, image)
            for k, c in enumerate(parse_arc(image)):
                if is_capture(c):
                    head, payload = split_http(c.block)
                    key = http_header(head, "X-Page-Id")
                    out.append((archive, k, int(key) if key and key.lstrip("-").isdigit() else None, hashlib.sha1(payload, usedforsecurity=False).digest(), len(payload), record_id(name, c), c.url, iso_date(c.date)))
            if out:
                types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["archive", "record", "key", "sha1", "length", "id", "url", "date"])


def _revisits(facts: DataFrame) -> DataFrame:
    """archive, revisits: array of (record, id, url, date, key) for the records that revisit another."""
    long = facts.where(F.col("length") >= REVISIT_BYTES)
    last = long.groupBy("sha1", "length").agg(F.count("*").alias("n"), F.max(F.struct("key", "id", "url", "date")).alias("last")).where("n > 1")
    hot = last.where(F.col("n") >= HOT_COPIES)
    dealt = long.select("archive", "record", "id", "sha1", "length")
    if 0 < hot.count() <= BROADCAST_ROWS:
        hits = dealt.join(F.broadcast(hot), ["sha1", "length"]).unionByName(dealt.join(F.broadcast(hot.select("sha1", "length")), ["sha1", "length"], "left_anti").join(last.where(F.col("n") < HOT_COPIES), ["sha1", "length"]))
    else:
        hits = dealt.join(last, ["sha1", "length"])
    one = F.struct("record", F.col("last.id").alias("id"), F.col("last.url").alias("url"), F.col("last.date").alias("date"), F.col("last.key").alias("key"))
    return hits.where(F.col("id") != F.col("last.id")).groupBy("archive").agg(F.collect_list(one).alias("revisits"))  # as many as a file has records


def arc_to_warc(archives: DataFrame, work: Workspace) -> DataFrame:
    """WARC archives (archive, image) of legacy archives (archive, image)."""
    facts = work.save(archives.mapInArrow(_facts, _FACTS), "facts")
    revisits = work.save(_revisits(facts), "revisits")
    few = (revisits.agg(F.sum(F.size("revisits"))).first()[0] or 0) <= BROADCAST_ROWS
    joined = archives.join(F.broadcast(revisits) if few else revisits, "archive", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, image, revisits in zip(batch.column("archive").to_pylist(), batch.column("image"), batch.column("revisits").to_pylist(), strict=True):
                to, image = {r["record"]: r for r in revisits or []}, _plain(image)
                name = _name(archive, image)
                out = b"".join(warc_record(name, c, to.get(k)) for k, c in enumerate(parse_arc(image)))
                yield pa.RecordBatch.from_arrays([pa.array([name.removesuffix(".arc") + ".warc"]), pa.array([out], pa.binary())], names=["archive", "image"])

    return joined.select("archive", "image", "revisits").mapInArrow(run, _ARC)


def warc_records(archives: DataFrame) -> DataFrame:
    """What stands in WARC archives (archive, image): a row per response or revisit record."""
    names = ["archive", "page_id", "url", "record_id", "warc_date", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload_ok"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, image in zip(batch.column("archive").to_pylist(), batch.column("image"), strict=True):
                out = []
                for h, block in parse_warc(_plain(image)):
                    if h.get("warc-type") not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    key, revisit = http_header(head, "X-Page-Id"), h["warc-type"] == "revisit"
                    to = h.get("x-refers-to-key", "")
                    bare = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    ok = digest(block) == h["warc-block-digest"] and (revisit or digest(payload) == h["warc-payload-digest"])
                    out.append((archive, int(key) if key and key.lstrip("-").isdigit() else None, h["warc-target-uri"], h["warc-record-id"], h["warc-date"], h["warc-type"], int(h["x-payload-length"]) if revisit else len(payload), bare, int(to) if revisit and to.lstrip("-").isdigit() else None, ok))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return archives.mapInArrow(run, "archive string, page_id long, url string, record_id string, warc_date string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload_ok boolean")


def op5_warc_from_arc(spark, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    write_archives(archives_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), f"{work.root}/arc")
    write_archives(arc_to_warc(read_archives(spark, f"{work.root}/arc"), work), f"{work.root}/warc")
    work.drop("arc", "facts", "revisits")
    return warc_records(read_archives(spark, f"{work.root}/warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to, TRUE AS payload_ok
FROM m
"""
