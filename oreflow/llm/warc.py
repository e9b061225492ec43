"""WARC derivatives: response records to linked metadata and plain-text conversion records.

Records follow WARC/1.0.  A derivative names its source in WARC-Refers-To, keeps the source's target
URI and date, and the metadata record carries the source's HTTP headers and digests.  Digests are
SHA-1 in base 32 with the label `sha1:`; those that a source declares are tested before use.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

VERSION = b"WARC/1.0\r\n"
#: The date of records made from tables that have none.
NO_DATE = "1970-01-01T00:00:00Z"

#: What a compressed body may decode to, in bytes; a record of a larger one is rejected.
MAX_BODY = 1 << 28

# Every search below moves on by what it has read, so a page of any shape costs time in proportion to its length.
_RAW = re.compile(r"(?i)<!--|<(script|style|noscript|template|textarea|iframe|svg)(?=[\s/>])|<[!?]")
_CLOSES = {x: re.compile(rf"(?i)</{x}\s*>") for x in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>""")
_BLOCK = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_TITLE = re.compile(r"(?i)<title(?=[\s/>])")
#: References by numbers that html.unescape would not take.
_LONG_NUMBER = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")
_HREF = re.compile(r"""(?i)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: object) -> str:
    """A record id that depends on the names alone, so that repeated tasks give the same one."""
    data = hashlib.sha1("\0".join(map(str, names)).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=data[:16], version=5)}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of headers and block; Content-Length is added, line ends in values become blanks."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"".join([VERSION, *lines, b"\r\n", block, b"\r\n\r\n"])


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError if it is none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or not first.startswith(b"WARC/"):
        raise ValueError("no record")
    headers = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip().lower(), value.strip())
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError("the block is cut short")
    return headers, rest[: int(length)]


def response(url: str, body: bytes, name: object, date: str = NO_DATE) -> bytes:
    """A response record for a page fetched with status 200."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(body), body)
    payload = digest(body)
    return write_record([
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", name, url, payload)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", payload),
    ], block)


def _without_raw(page: str) -> str:
    """page with blanks for comments, declarations and elements whose content is no text.

    An element that is never closed loses its tag alone; only a script or style runs to the end, as in
    HTML, because what follows is its code.  A tag that never ends is text.
    """
    kept, at, endless = [], 0, set()
    while found := _RAW.search(page, at):
        comment = found[0] == "<!--"
        stop = page.find("-->" if comment else ">", found.end())
        if stop < 0 and not comment:
            break
        kept += [page[at : found.start()], " "]
        if comment:
            at = stop + 3 if stop >= 0 else len(page)
            continue
        at, name = stop + 1, (found[1] or "").lower()
        if not name or name in endless or name == "svg" and page[stop - 1] == "/":
            continue
        if close := _CLOSES[name].search(page, at):
            at = close.end()
        elif name in ("script", "style"):
            at = len(page)
        else:
            endless.add(name)
    return "".join([*kept, page[at:]])


def _unescaped(text: str) -> str:
    """text with its character references resolved; numbers beyond Unicode become U+FFFD."""

    def short(found: re.Match) -> str:
        digits = (found[1] or found[2]).lstrip("0")
        return "\ufffd" if len(digits) > 7 else f"&#{'' if found[1] else 'x'}{digits or 0};"

    return html.unescape(_LONG_NUMBER.sub(short, text))


def _title(page: str) -> str:
    """The text of a page's first title element; empty if it is never closed."""
    found = _TITLE.search(page)
    start = page.find(">", found.end()) if found else -1
    close = _CLOSES["title"].search(page, start) if start >= 0 else None
    return " ".join(_unescaped(page[start + 1 : close.start()]).split()) if close else ""


def plain_text(page: str) -> tuple[str, str, list[str]]:
    """Text (a line for each block element with text), title and link targets of a page."""
    links: list[str] = []

    def tag(match: re.Match) -> str:
        name = match[2].lower()
        if name == "a" and not match[1] and (href := _HREF.search(match[3])):
            links.append(_unescaped(href[1] or href[2] or href[3] or "").strip())
        return "\n" if name in _BLOCK else ""

    text = _unescaped(_TAG.sub(tag, _without_raw(page.replace("\n", " "))))
    lines = (_BLANKS.sub(" ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x), _title(page), [x for x in links if x]


def _dechunked(body: bytes) -> bytes:
    """The data of a chunked body; ValueError if it is none, as in archives that keep the header of a body already decoded."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 1024)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or len(size) > 16 or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("no chunk")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + n])
        at += n + 2


def _inflated(body: bytes, window: int) -> bytes:
    """What a gzip or zlib body holds (window: as zlib names it); ValueError beyond MAX_BODY."""
    parts, room = [], MAX_BODY
    while body:
        unpack = zlib.decompressobj(window)
        data = unpack.decompress(body, room + 1)
        room -= len(data)
        if room < 0:
            raise ValueError("the decoded body is too large")
        parts.append(data)
        body = unpack.unused_data  # gzip members may follow each other
    return b"".join(parts)


def decoded_body(body: bytes, transfer: str, encoding: str) -> bytes:
    """A body without its transfer and content encodings; one that is not encoded as declared stays as it is."""
    if "chunked" in transfer.lower():
        try:
            body = _dechunked(body)
        except ValueError:
            pass
    for name in reversed([x.strip().lower() for x in encoding.split(",")]):
        try:
            if name in ("gzip", "x-gzip"):
                body = _inflated(body, 31)
            elif name == "deflate":
                try:
                    body = _inflated(body, 15)
                except zlib.error:
                    body = _inflated(body, -15)
        except zlib.error:
            break
    return body


def _charset(content_type: str) -> str:
    """The declared encoding if Python knows it as one of texts, else UTF-8."""
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    try:
        b"a".decode(found[1], "replace")  # fails for codecs that are none of texts
        return codecs.lookup(found[1]).name
    except (TypeError, LookupError, ValueError):
        return "utf-8"


def _text(body: bytes, content_type: str) -> str:
    try:
        return body.decode(_charset(content_type), "replace")
    except ValueError:  # some codecs refuse to replace
        return body.decode("utf-8", "replace")


def derive(data: bytes) -> list[dict]:
    """The derivatives of one response record; nothing for records of other types.

    ValueError for what is no record, lacks an id, or does not have the digests that it declares.
    """
    headers, block = read_record(data)
    if headers.get("warc-type", "").lower() != "response":
        return []
    source = headers.get("warc-record-id")
    if not source:
        raise ValueError("the source has no id")
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines) if c]
    declared: dict[str, str] = {}
    for k, v in http:
        declared.setdefault(k.lower(), v)
    block_digest, payload_digest = digest(block), digest(body)
    plain = decoded_body(body, declared.get("transfer-encoding", ""), declared.get("content-encoding", ""))
    for name, own in (("warc-block-digest", block_digest), ("warc-payload-digest", payload_digest)):
        if headers.get(name, "").startswith("sha1:") and headers[name] != own:
            # archives differ in whether a payload is digested with its chunks
            if name == "warc-block-digest" or headers[name] != digest(decoded_body(body, declared.get("transfer-encoding", ""), "")):
                raise ValueError(f"{name} does not fit")
    text, title, links = plain_text(_text(plain, declared.get("content-type", "")))
    uri, date = headers.get("warc-target-uri", ""), headers.get("warc-date", NO_DATE)
    fields = [("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("http-status-line", status)]
    fields += [(f"http-header-{k.lower()}", v) for k, v in http] + [("title", title)] * bool(title) + [("outlink", x) for x in links]
    meta = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields).encode()
    out = []
    for kind, mime, content in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own, own_digest = record_id(kind, source), digest(content)
        record = write_record([
            ("WARC-Type", kind),
            ("WARC-Record-ID", own),
            ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", uri),
            ("WARC-Refers-To-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Date", date),
            ("WARC-Block-Digest", own_digest),
            ("Content-Type", mime),
        ], content)
        out.append({
            "record_type": kind, "record_id": own, "refers_to": source, "target_uri": uri, "source_payload_digest": payload_digest,
            "block_digest": own_digest, "content_length": len(content), "record": record, "error": None,
        })
    return out


_SCHEMA = pa.schema([
    ("id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("source_payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("record", pa.binary()), ("error", pa.string()),
])
_DDL = (
    "id long, record_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, "
    "block_digest string, content_length long, record binary, error string"
)


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        ids, urls, pages = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()
        made = [response(u or "", p or b"", i) for i, u, p in zip(ids, urls, pages)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["id", "record"])


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 64):
        rows = []
        for name, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            try:
                rows += [{"id": name} | x for x in derive(data or b"")]
            except ValueError as e:
                rows.append({"id": name, "record_type": "rejected", "error": str(e)})
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id and record: a response record for each page.

    Null urls and pages count as empty; a page of any length is one record.  Repeated rows give the same
    record again, a null id is kept, an empty table gives no rows, other columns are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_responses, "id long, record binary")


def derivatives(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """The metadata and the conversion record of each response record, as columns and whole records.

    Other record types give nothing; what is no sound record gives one row of type `rejected` with
    the reason in error.  Chunked, gzip and deflate bodies are decoded; a charset that names no encoding of
    texts counts as UTF-8.  Empty pages give an empty conversion, pages of any length a whole one.  Repeated
    rows give the same ids again; an empty table gives no rows; other columns are not read.  Ids must be numbers.
    """
    ship(records.sparkSession)
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).alias("record"))
    return rows.mapInArrow(_derived, _DDL)
