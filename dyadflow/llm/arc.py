"""Converter of the legacy ARC format to WARC.

An ARC archive is a version block followed by records: a header line whose fields depend on the version, then exactly as
many bytes as it declares, then a line end. Each record becomes a WARC record with a synthesised identifier, date, type and
digests; of records with equal payloads the first is a response and the others are revisits of it."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The header fields of each version, in order.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
#: Pages of an ARC batch; batches alternate between the versions.
BATCH = 64
BREAK = b"\r\n"


@dataclass
class Record:
    """A record of an archive: its header by name, and its content."""

    header: dict[str, str]
    content: bytes


def _word(value: str | None) -> str:
    """A header field: no white space, - if there is none."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), value) if value else "-"


def write_arc(pages: list[tuple[int | None, str | None, bytes]], version: int, date: str = "19960102030405") -> bytes:
    """An ARC archive of (page_id, url, payload), an HTTP response each; the page's id is one of its HTTP headers."""
    about = f"{version} 0 legacy\n{' '.join(_NAMES[f] for f in FIELDS[version])}\n".encode()
    out = [f"filedesc://pages.arc 0.0.0.0 {date} text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}{len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for page_id, url, payload in pages:
        http = b"HTTP/1.1 200 OK" + BREAK + b"Content-Type: text/html; charset=utf-8" + BREAK + f"X-Page-Id: {'' if page_id is None else page_id}".encode() + BREAK + BREAK
        values = {"url": _word(url), "ip": "0.0.0.0", "date": date, "type": "text/html", "result": "200", "checksum": "-", "location": "-", "offset": str(at), "filename": "pages.arc", "length": str(len(http) + len(payload))}
        part = [" ".join(values[f] for f in FIELDS[version]).encode() + b"\n", http, payload, b"\n"]
        at += sum(map(len, part))
        out += part
    return b"".join(out)


#: The names of the fields in a version block.
_NAMES = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}


def read_arc(data: bytes) -> Iterator[Record]:
    """The records after the version block, which says by its first number how header lines are to be read."""
    at, version = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        if not line.strip():
            at = end + 1
            continue
        length = int(line.rsplit(" ", 1)[1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"record of {length} bytes is cut short")
        at = end + 1 + length
        if version is None:
            version = int(content.split(b" ", 1)[0])
            if not line.startswith("filedesc:") or version not in FIELDS:
                raise ValueError("not an ARC version block")
            continue
        names = FIELDS[version]
        # URLs of old archives may hold blanks, so fields are counted from the end.
        values = line.rsplit(" ", len(names) - 1)
        yield Record(dict(zip(names, values, strict=True)), content)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_payload(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload of a response."""
    at = content.find(BREAK * 2)
    return (content[: at + 4], content[at + 4 :]) if at >= 0 else (b"", content)


def page_of(http: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
    return int(m[1]) if m else None


def record_id(url: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def write_warc(record: Record, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit if refers_to is a page's id, and then without payload."""
    http, payload = http_payload(record.content)
    digest, page_id, url = base32_sha1(payload), page_of(http), record.header["url"]
    when = datetime.strptime(record.header["date"], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    block = http if refers_to is not None else record.content
    header = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(url, page_id),
        "WARC-Date": when.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": url,
        "WARC-IP-Address": record.header["ip"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
    }
    if refers_to is not None:
        header |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(_word(refers_url), refers_to), "WARC-Refers-To-Target-URI": _word(refers_url), "X-Refers-To-Page": str(refers_to), "X-Payload-Length": str(len(payload))}
    header |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1" + BREAK + b"".join(f"{k}: {v}".encode() + BREAK for k, v in header.items()) + BREAK + block + BREAK * 2


def read_warc(data: bytes) -> Iterator[Record]:
    """The records of a WARC archive, by declared lengths; block digests are checked."""
    at = 0
    while at < len(data):
        end = data.index(BREAK * 2, at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        header = dict(line.split(": ", 1) for line in lines[1:])
        length = int(header["Content-Length"])
        content = data[end + 4 : end + 4 + length]
        if f"sha1:{base32_sha1(content)}" != header["WARC-Block-Digest"]:
            raise ValueError("digest of a block does not match")
        yield Record(header, content)
        at = end + 4 + length + 4


def legacy(pages: DataFrame) -> DataFrame:
    """(arc, refers_to, refers_url): ARC archives of batches of pages (page_id, url, html, refers_to, refers_url), the last two
    columns carried beside each archive's records in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            ids, urls, html, refers, whose = (batch.column(i).to_pylist() for i in range(5))
            for a in range(0, len(ids), BATCH):
                cut = slice(a, a + BATCH)
                arc = write_arc([(i, u, (h or "").encode()) for i, u, h in zip(ids[cut], urls[cut], html[cut], strict=True)], 1 + k % 2)
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([arc], pa.binary()), pa.array([refers[cut]], pa.list_(pa.int64())), pa.array([whose[cut]], pa.list_(pa.string()))], names=["arc", "refers_to", "refers_url"])

    return pages.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(pack, "arc binary, refers_to array<long>, refers_url array<string>")


def convert(archives: DataFrame) -> DataFrame:
    """(warc): a WARC archive for each ARC archive (arc, refers_to, refers_url), record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc, refers, whose in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made = b"".join(write_warc(r, to, url) for r, to, url in zip(read_arc(arc.as_buffer().to_pybytes()), refers, whose, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["warc"])

    return archives.select("arc", "refers_to", "refers_url").mapInArrow(run, "warc binary")


def records(warcs: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date) of WARC archives (warc)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for warc in batch.column(0):
                out = []
                for r in read_warc(warc.as_buffer().to_pybytes()):
                    http, payload = http_payload(r.content)
                    kind, h = r.header["WARC-Type"], r.header
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest != base32_sha1(payload):
                        raise ValueError("digest of a payload does not match")
                    out.append((page_of(http), len(payload) if kind == "response" else int(h["X-Payload-Length"]), digest, kind, int(h["X-Refers-To-Page"]) if kind == "revisit" else None, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names=names)

    return warcs.select("warc").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string")


def convert_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC by way of ARC, to the shared folder, and return what is read back.

    Of records with equal payloads of at least `least_bytes` bytes, that with the least page_id is the response and the
    others revisit it; smaller ones are all responses. A null html is an empty payload; a null url is written as -; a record
    with a null page_id revisits one with the same payload that has an id, and is a response if there is none; records of one
    page_id with equal payloads are all responses if theirs is the least, and those with equal urls share a record id; a page_id
    may have several payloads, each of which is judged by itself; an html of any length is one record; an empty table gives
    no records; other columns are ignored."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("bytes"))
    # Small rows only: copies are counted on both sides of the shuffle, and a hot payload is one row a task.
    first = F.min(F.struct("page_id", "url"))
    firsts = pages.filter((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(first["page_id"].alias("refers_to"), first["url"].alias("refers_url"))
    again = pages.select("page_id", "sha").distinct().join(firsts, "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = again.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to", "refers_url")
    marked = pages.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "refers_to", "refers_url")
    return records(materialise(convert(legacy(marked)), "warc", "zstd"))


def warc_bytes(col: Column) -> Column:
    """An archive's size."""
    return F.octet_length(col)
