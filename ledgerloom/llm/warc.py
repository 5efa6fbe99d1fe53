"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Both records name the response in WARC-Refers-To and repeat its target, date and payload digest (as the response states it; it is worked out only where the
response has none); the metadata block
keeps the response's HTTP headers, and the conversion block is the page's text. Record ids are name-based (a digest of
the response's id and the kind), so that a task that runs twice writes the same record.

``record`` is the whole record up to the two line ends that close it; write_warc() writes such records as files, and read_responses() reads
the responses of such files, plain or compressed.

A head without an end tag ends at body, or at the first element or text that can't be in it.

Defined edge cases: a null payload is an empty one and gives an empty conversion block; a null target leaves out
the target line; repeated responses give repeated records with equal ids; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .textbatch import CHUNK_BYTES

_SKIPPED = frozenset(("script", "style", "noscript", "template", "head"))
_IN_HEAD = frozenset(["html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"])
_BLOCKS = frozenset(["address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul", "title"])
SCHEMA = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_headers string, payload_digest string, block_digest string, content_length long, block string, record string"
)


class _Text(HTMLParser):
    """Text is kept as it comes, and dropped where the element that hides it ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[tuple[str, int]] = []  # open hidden elements, and where their text begins
        self.title = False

    def _end(self, tag):
        while self.skip:
            name, at = self.skip.pop()
            if name == tag:
                del self.out[at:]
                return

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            if any(name == "head" for name, _ in self.skip):
                self._end("head")
        elif self.skip and self.skip[-1][0] == "head" and tag not in _IN_HEAD:
            self._end("head")
        self.title = tag == "title"
        if tag in _SKIPPED:
            self.skip.append((tag, len(self.out)))
        elif tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.title = False
        if any(name == tag for name, _ in self.skip):
            self._end(tag)
        elif tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.skip and self.skip[-1][0] == "head" and not self.title and data.strip():
            self._end("head")
        self.out.append(data)

    def close(self):
        super().close()
        # a noscript or template that never ends hides nothing
        end = len(self.out)
        for name, at in reversed(self.skip):
            if name not in ("noscript", "template"):
                del self.out[at:end]
            end = at


def page_text(html: str) -> str:
    """Visible text, one block element a line, white space collapsed."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, record_id, target_uri, warc_date, headers, payload of the response that a crawled page came with."""
    payload = F.coalesce("html", F.lit(""))
    name = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))))
    dashed = F.concat_ws("-", F.substring(name, 1, 8), F.substring(name, 9, 4), F.substring(name, 13, 4), F.substring(name, 17, 4), F.substring(name, 21, 12))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n")).alias("headers"), payload.alias("payload"),
    )


def _record(kind: str, source: dict, content_type: str, block: str) -> tuple:
    body = block.encode()
    target = re.sub(r"\s+", "%20", source["target_uri"].strip()) if source["target_uri"] else None
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + ' ' + source['record_id'])}>"
    payload_digest, block_digest = source.get("payload_digest") or digest(source["payload"].encode()), digest(body)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Refers-To: {source['record_id']}", f"WARC-Date: {source['warc_date']}"]
    lines += [f"WARC-Target-URI: {target}"] * bool(target)
    lines += [f"WARC-Refers-To-Payload-Digest: {payload_digest}", f"WARC-Block-Digest: {block_digest}", f"Content-Type: {content_type}", f"Content-Length: {len(body)}"]
    return (source["page_id"], kind, rid, source["record_id"], target, source["warc_date"], content_type, source["headers"], payload_digest, block_digest, len(body), block, "\r\n".join(lines) + "\r\n\r\n" + block)


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response of ``source`` (the columns that responses() gives, and payload_digest if it is there)."""
    columns = ["page_id", "record_id", "target_uri", "warc_date", "headers", "payload", *(["payload_digest"] if "payload_digest" in source.columns else [])]

    def derive(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = []
                for r in b.slice(at, 200).to_pylist():
                    r["payload"], r["headers"] = r["payload"] or "", r["headers"] or ""
                    text = page_text(r["payload"])
                    fields = [f"sourceRecord: {r['record_id']}", f"sourceLength: {len(r['payload'].encode())}", f"textLength: {len(text.encode())}", *(f"sourceHeader: {x}" for x in r["headers"].split("\r\n") if x)]
                    rows.append(_record("metadata", r, "application/warc-fields", "".join(f"{x}\r\n" for x in fields)))
                    rows.append(_record("conversion", r, "text/plain; charset=utf-8", text))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (0, 10) else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return source.select(*columns).mapInArrow(derive, SCHEMA)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write ``record`` as WARC files, one for each partition: two line ends close a record, as the format wants."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


class _Unzipped(io.RawIOBase):
    """What a file's gzip members hold, as far as they go."""

    def __init__(self, raw: io.BytesIO):
        self.raw, self.inflate, self.left = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while data := self.inflate.unconsumed_tail or self.left or self.raw.read(1 << 16):
            self.left = b""
            try:
                out = self.inflate.decompress(data, len(into))
            except zlib.error:
                break
            if self.inflate.eof:
                self.left, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if out:
                into[: len(out)] = out
                return len(out)
        return 0


def _records(stream: io.BufferedIOBase):
    """(fields, block) of each record of a file as it is read, by their lengths; a broken end is left out."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            return
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length", "0"))
        block = stream.read(size)
        if not line or len(block) < size:
            return
        yield fields, block


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files: page_id (null), record_id, target_uri, warc_date, headers, payload, payload_digest.

    A task reads a file at a time, as Spark gives it (up to 2 GB, compressed or plain); of what it decompresses one record and CHUNK_BYTES of found ones are in memory.
    """
    names = ["page_id", "record_id", "target_uri", "warc_date", "headers", "payload", "payload_digest"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names)

    def read(batches):
        for b in batches:
            for content in b.column(0):
                raw = io.BytesIO(content.as_buffer())
                zipped = raw.getbuffer()[:2] == b"\x1f\x8b"
                rows, held = [], 0
                for fields, block in _records(io.BufferedReader(_Unzipped(raw)) if zipped else raw):
                    if fields.get("warc-type") != "response":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    rows.append((None, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), head.decode("utf-8", "replace") + "\r\n", payload.decode("utf-8", "replace"), fields.get("warc-payload-digest")))
                    held += len(block)
                    if held >= CHUNK_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, "page_id long, record_id string, target_uri string, warc_date string, headers string, payload string, payload_digest string")
