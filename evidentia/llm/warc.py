"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Each derived record names its response (WARC-Refers-To), keeps its target, its date and the digest of its payload, and has digests of
its own; the metadata record also has the source's HTTP status, headers and outlinks. Record ids are name-based UUIDs of the
response's id, so a repeated run makes the same records. Responses are read one by one inside Arrow functions and nothing is
shuffled; a record's parts are read whole, whatever their size.

Rows: two per response, also for repeated ones. A page's null html counts as empty; a null url leaves WARC-Target-URI out; null
page_ids stay. Records that aren't responses, or can't be read, give no derivatives. Other columns are ignored. Empty tables
give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
#: Bytes of a packed file that are unpacked at once.
SLICE = 1 << 14
#: Elements whose text isn't shown, and those that end a line.
HIDDEN = {"script", "style", "noscript", "template"}
BREAKING = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "aside", "pre", "blockquote", "body", "title"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def build(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record; headers without a value are left out, and the length and digest of the block are added."""
    held = [(k, v) for k, v in headers if v is not None]
    held += [("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    lines = [VERSION, *[f"{k}: {' '.join(v.splitlines())}".encode() for k, v in held]]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def _fields(head: bytes) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return found


def parse(record: bytes) -> tuple[dict[str, str], bytes] | None:
    """A record's headers (names in lower case) and block; None if it isn't one."""
    head, gap, rest = record.partition(CRLF + CRLF)
    if not gap or not head.startswith(b"WARC/"):
        return None
    headers = {name.lower(): value for name, value in _fields(head.partition(CRLF)[2])}
    try:
        length = int(headers.get("content-length", ""))
    except ValueError:
        return None
    return (headers, rest[:length]) if len(rest) >= length else None


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of an uncompressed WARC file, each with the two line ends after it. A record whose length isn't a number, or is
    more than there is left, is passed over: reading goes on at the next place that starts like one."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(CRLF + CRLF, at)
        if end < 0:
            return
        headers = {name.lower(): value for name, value in _fields(data[at:end])}
        length = headers.get("content-length", "")
        stop = end + 4 + int(length) if length.isascii() and length.isdigit() else len(data) + 1
        if stop > len(data):
            at += 5
            continue
        yield data[at:stop] + CRLF + CRLF
        at = stop


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file one by one, each unpacked; a broken end gives nothing. Other data is one member as it is.

    A member is fed SLICE bytes at a time from its place in the file, so the rest of the file is never copied.
    """
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while data[at : at + 2] == b"\x1f\x8b":
        unpack, parts, fed = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and fed < len(data):
                parts.append(unpack.decompress(view[fed : fed + SLICE]))
                fed = min(fed + SLICE, len(data))
        except zlib.error:
            return
        if not unpack.eof:
            return
        yield b"".join(parts)
        at = fed - len(unpack.unused_data)


def _unchunked(data: bytes) -> bytes:
    """A body sent in chunks, joined; what isn't chunked as it should be is left as it is from there on."""
    parts, at = [], 0
    while True:
        end = data.find(CRLF, at)
        size = data[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return b"".join([*parts, data[at:]])
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        parts.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def body_text(http: list[tuple[str, str]], payload: bytes) -> str:
    """The text of a response's body: chunks joined, gzip and deflate unpacked, in the charset that its header or its first lines name (UTF-8 otherwise)."""
    headers = {name.lower(): value for name, value in http}
    if "chunked" in headers.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    coding = headers.get("content-encoding", "").strip().lower()
    for window in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            payload = zlib.decompressobj(window).decompress(payload)
            break
        except zlib.error:
            continue
    named = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", headers.get("content-type", "")) or re.search(rb"(?i)<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", payload[:2048])
    charset = named[1] if named else "utf-8"
    try:
        return payload.decode(charset if isinstance(charset, str) else charset.decode("ascii", "replace"), "replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.hidden, self.in_head, self.in_title, self.kept = 0, False, False, 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        # whatever shows text ends a head that isn't closed
        self.in_head = tag == "head" or (self.in_head and (tag == "title" or tag not in BREAKING))
        if tag == "body":
            self.hidden = 0
        if tag == "pre":
            self.kept += 1
        self.in_title = self.in_title or tag == "title"
        if tag in BREAKING:
            self.text.append("\n")
        self.links += [v for k, v in attrs if k in ("href", "src") and v]

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "title":
            self.in_title = False
        if tag == "head":
            self.in_head = False
        if tag == "pre":
            self.kept = max(0, self.kept - 1)
        if tag in BREAKING:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.hidden and not self.in_head:
            self.text.append(data if self.kept else data.replace("\r", " ").replace("\n", " "))


def read_page(html: str) -> tuple[str, str, list[str]]:
    """The shown text (a line for each block and each line of preformatted text, single spaces), the title, and the links in order, each once."""
    page = _Page()
    page.feed(html)
    page.close()
    lines = (" ".join(line.split()) for line in "".join(page.text).split("\n"))
    return "\n".join(line for line in lines if line), " ".join("".join(page.title).split()), list(dict.fromkeys(page.links))


def response_record(page_id, url: str | None, html: str | None, date: str) -> bytes:
    payload = (html or "").encode()
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()]) + CRLF + CRLF + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id(f"response:{page_id}:{url}:{digest(payload)}")),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest(payload)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return build(headers, block)


def derivatives(record: bytes) -> list[dict]:
    """The metadata and the conversion record of a response, with their parts by name."""
    parsed = parse(record)
    if parsed is None or parsed[0].get("warc-type") != "response":
        return []
    headers, block = parsed
    head, _, payload = block.partition(CRLF + CRLF)
    status, _, rest = head.partition(CRLF)
    http = _fields(rest)
    text, title, links = read_page(body_text(http, payload))
    source, source_digest = headers.get("warc-record-id", ""), headers.get("warc-payload-digest") or digest(payload)
    fields = [("source-status", status.decode("utf-8", "replace")), *[(f"source-header-{k.lower()}", v) for k, v in http], ("source-payload-digest", source_digest), ("title", title), *[("outlink", x) for x in links]]
    meta_block = CRLF.join(f"{k}: {' '.join(v.splitlines())}".encode() for k, v in fields) + CRLF
    found = []
    for kind, kind_type, data in (("metadata", "application/warc-fields", meta_block), ("conversion", "text/plain; charset=utf-8", text.encode())):
        own = record_id(f"{kind}:{source}")
        built = build(
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", own),
                ("WARC-Date", headers.get("warc-date")),
                ("WARC-Target-URI", headers.get("warc-target-uri")),
                ("WARC-Refers-To", source),
                ("WARC-Payload-Digest", digest(data) if kind == "conversion" else None),
                ("Content-Type", kind_type),
            ],
            data,
        )
        found.append({"record_type": kind, "record_id": own, "refers_to": source, "target_uri": headers.get("warc-target-uri"), "source_digest": source_digest, "block_digest": digest(data), "content_length": len(data), "n_links": len(links), "record": built})
    return found


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and a response record of every page (page_id, url, html): a stand-in for a capture, so its status, headers and date are made up; read_warc gives real ones."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = T.StructType([rows.schema["page_id"], T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            built = [response_record(*row, date) for row in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(built, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id (null) and record of WARC files, plain or packed (a gzip member for each record, as is usual, or for several). A file
    comes to its task as one value, so it must be under 2 GB; its records leave one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for member in members(data.as_py()):
                    for record in split_records(member):
                        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([record], pa.binary())], names=["page_id", "record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, record binary")


def derive(responses: DataFrame) -> DataFrame:
    """The derived records of every response (page_id, record), with their bytes in `record`."""
    rows = responses.select("page_id", F.col("record").cast("binary").alias("record"))
    kinds = [("record_type", T.StringType()), ("record_id", T.StringType()), ("refers_to", T.StringType()), ("target_uri", T.StringType()), ("source_digest", T.StringType()), ("block_digest", T.StringType()), ("content_length", T.LongType()), ("n_links", T.LongType()), ("record", T.BinaryType())]
    schema = T.StructType([rows.schema["page_id"], *[T.StructField(k, t) for k, t in kinds]])
    arrow = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for row, record in enumerate(batch.column(1)):
                made = derivatives(record.as_py() or b"")
                own += [row] * len(made)
                found += made
            columns = [pa.array([x[k] for x in found], arrow[t]) for k, t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)
