"""Metadata and plain-text conversion records derived from web archive responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = """record_type string, record_id string, refers_to string, target_uri string, date string,
content_type string, source_headers array<struct<name:string,value:string>>, source_block_digest string,
source_payload_digest string, block_digest string, content_length long, content binary"""
CRLF = b"\r\n"
# Elements that end a line of text, whose content is no markup, whose content is no text, and that hold links.
BREAKS = frozenset(("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
                    "section table td th title tr ul").split())
RAW = ("script", "style")
SILENT = ("head", "noscript", "template")
LINKED, ADDRESSES = ("a", "link", "img", "script", "iframe", "form"), ("href", "src", "action")
# Character sets that pages are read in; any other name is read as UTF-8.
CHARSETS = frozenset((
    "utf-8 utf8 utf-16 utf-16le utf-16be us-ascii ascii latin1 iso-8859-1 iso-8859-2 iso-8859-3 iso-8859-4 iso-8859-5 iso-8859-6 iso-8859-7 iso-8859-8 "
    "iso-8859-9 iso-8859-10 iso-8859-11 iso-8859-13 iso-8859-14 iso-8859-15 iso-8859-16 windows-1250 windows-1251 windows-1252 windows-1253 windows-1254 "
    "windows-1255 windows-1256 windows-1257 windows-1258 cp1250 cp1251 cp1252 cp874 koi8-r koi8-u shift_jis sjis euc-jp iso-2022-jp gb2312 gbk gb18030 big5 "
    "euc-kr tis-620").split())
#: A compressed body that grows beyond this is no page: it has no text.
MOST_BODY = 1 << 28
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)(?=[\s/>])[^<>\"']*+>")
_TAG_END = re.compile(r"[>\"']")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in (*RAW, "title")}
_ATTRIBUTE = re.compile(r"[\s/]([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def urn(*parts: str | None) -> str:
    """The same parts always give the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join('' if p is None else p for p in parts))}>"


def split_message(content: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header lines, in order, and body of an HTTP message; without a status line all is body."""
    if not content.startswith(b"HTTP/"):
        return [], content
    head, _, body = content.partition(CRLF + CRLF)
    pairs: list[tuple[str, str]] = []
    for line in head.split(CRLF)[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and pairs:  # a folded line goes on with the header before
            pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            pairs.append((name.strip(), value.strip()))
    return pairs, body


def charset_of(headers: list[tuple[str, str]], body: bytes) -> str:
    for place in (next((v for n, v in headers if n.lower() == "content-type"), ""), body[:1024].decode("ascii", "ignore")):
        if (found := _CHARSET.search(place)) and found[1].lower() in CHARSETS:
            return found[1].lower()
    return "utf-8"


def unchunked(body: bytes) -> bytes | None:
    """The chunks of a body joined, up to the empty one; None if it isn't made of chunks."""
    out, at = [], 0
    while at < len(body):
        stop = body.find(CRLF, at, at + 1024)
        try:
            size = int(body[at:stop].split(b";")[0].strip(), 16) if stop >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        if not size:
            break
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 2 + size + 2
    return b"".join(out)


def inflated(body: bytes, how: str) -> bytes | None:
    """A gzip or deflate body; as far as it goes if it breaks off, None if it isn't one or grows beyond MOST_BODY."""
    for bits in (31,) if "gzip" in how else (15, -15):
        unpacker = zlib.decompressobj(bits)
        try:
            made = unpacker.decompress(body, MOST_BODY)
        except zlib.error:
            continue
        return None if unpacker.unconsumed_tail else made
    return None


def entity(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The page that a body carries: chunks joined and compression undone. A body that isn't what its headers say stays."""
    named = {n.lower(): v.lower() for n, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        joined = unchunked(body)
        body = body if joined is None else joined
    how = named.get("content-encoding", "")
    if "gzip" in how or "deflate" in how:
        made = inflated(body, how)
        return b"" if made is None else made
    return body


def unescaped(text: str) -> str:
    """Character references resolved; a number of very many digits is no character, and no reason to fail."""
    if "&" not in text:
        return text
    short = re.sub(r"&#0+(?=[0-9])", "&#", text)
    return html.unescape(re.sub(r"&#[0-9]{8,};?", "\ufffd", short))


def _tag_stop(page: str, at: int) -> int:
    """Place after the > of the tag that opens before ``at``; a > inside a quoted value doesn't end it."""
    searched = at
    while found := _TAG_END.search(page, searched):
        searched = found.end()
        if found[0] == ">":
            return searched
        before = page[max(at, found.start() - 64) : found.start()].rstrip()
        if before.endswith("=") and (close := page.find(found[0], searched)) >= 0:
            searched = close + 1
    return len(page)


class Page:
    """Text, title and links of a page, from one walk over its tags; time grows with the length, whatever the page holds."""

    def __init__(self, page: str) -> None:
        self.pieces: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.title: str | None = None
        at, silent = 0, None
        unclosed: set[str] = set()
        while (opens := page.find("<", at)) >= 0:
            if silent is None and opens > at:
                self.pieces.append(unescaped(page[at:opens]))
            if simple := _SIMPLE.match(page, opens):  # no quotes to heed: most tags
                at, name, closes = simple.end(), simple[2].lower(), bool(simple[1])
            elif page.startswith("<!--", opens):
                stop = page.find("-->", opens + 4)
                at = len(page) if stop < 0 else stop + 3
                continue
            elif page[opens + 1 : opens + 2] not in _OPENERS:
                at = opens + 1
                if silent is None:
                    self.pieces.append("<")
                continue
            else:
                at = _tag_stop(page, opens + 1)
                found = _NAME.match(page, opens + 1, at)
                if not found:
                    continue
                name, closes = found[1].lower(), page[opens + 1] == "/"
            if closes and name == silent or name == "body" and silent == "head":
                silent = None
            if silent is None and name in BREAKS:
                self.pieces.append("\n")
            if closes:
                continue
            if name in LINKED:
                self._link(name, page[opens:at])
            if name in SILENT:
                silent = silent or name
            elif name in _CLOSE and name not in unclosed:
                close = _CLOSE[name].search(page, at)
                if close is None:
                    unclosed.add(name)
                    if name in RAW:
                        at = len(page)
                else:
                    if name == "title" and self.title is None:
                        self.title = " ".join(unescaped(page[at : close.start()]).split())
                    if name in RAW:
                        at = close.start()
        if silent is None:
            self.pieces.append(unescaped(page[at:]))

    def _link(self, name: str, tag: str) -> None:
        for m in _ATTRIBUTE.finditer(tag):
            if m[1].lower() in ADDRESSES:
                address = " ".join(unescaped(m[2] or m[3] or m[4] or "").split())
                if address:
                    self.links.append((f"{name}/{m[1].lower()}", address))
                return

    def text(self) -> str:
        """Visible text, one line for each block of the page, blanks collapsed."""
        lines = (" ".join(line.split()) for line in "".join(self.pieces).split("\n"))
        return "\n".join(line for line in lines if line)


_OPENERS = frozenset("!/?abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def derive(record_id: str | None, target: str | None, date: str | None, content: bytes | None) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of RECORDS."""
    content = bytes(content or b"")
    headers, body = split_message(content)
    block, payload = digest(content), digest(body)
    source = record_id or urn("response", target, date, block)
    carried = entity(headers, body)
    charset = charset_of(headers, carried)
    page = Page(carried.decode(charset, "replace"))
    fields = [("charset-detected", charset)]
    if page.title is not None:
        fields.append(("title", page.title))
    fields += [("outlink", f"{address} {kind}") for kind, address in page.links]
    notes = b"".join(f"{n}: {' '.join(v.split())}\r\n".encode("utf-8", "replace") for n, v in fields)
    text = page.text().encode("utf-8", "replace")
    out = []
    for kind, content_type, raw in (("metadata", "application/warc-fields", notes), ("conversion", "text/plain; charset=utf-8", text)):
        out.append((kind, urn(kind, source), source, target, date, content_type, headers, block, payload, digest(raw), len(raw), raw))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response (record_id, target_uri, date, content as an HTTP message).

    Rows follow RECORDS after the columns of ``responses`` that are neither of these four nor in RECORDS. The
    identifiers follow from the response's own; a response without one gets one from address, date and digest, so
    repeated rows give repeated identifiers. A null or empty content gives empty records; a null address or date stays
    null. An address longer than any limit, or a page of any length, is handled whole, in time that grows with it. Chunked
    and compressed bodies are undone before they are read (digests are those of the bytes as they came); a body that its
    headers misname is read as it is, one that unpacks to over MOST_BODY has no text. Character sets outside CHARSETS are
    read as UTF-8, and bytes that are none as U+FFFD. Rows never meet: no shuffle.
    """
    made = T._parse_datatype_string(RECORDS)
    four = ["record_id", "target_uri", "date", "content"]
    carry = [c for c in responses.columns if c not in four and c not in made.names]
    schema = T.StructType([*(responses.schema[c] for c in carry), *made])
    most = 8 << 20

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, size = [], 0
            kept = frame[carry].astype(object).where(frame[carry].notna(), None).itertuples(index=False, name=None)
            for before, row in zip(kept, frame[four].itertuples(index=False, name=None), strict=True):
                for record in derive(*row):
                    rows.append((*before, *record))
                    size += record[10]
                if size > most:
                    yield pd.DataFrame(rows, columns=schema.names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=schema.names)

    return responses.select(*carry, *(F.col(c).cast("binary" if c == "content" else "string").alias(c) for c in four)).mapInPandas(run, schema)


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages (page_id, url, html)."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Source: pages\r\n\r\n"
    message = F.concat(F.lit(head), F.coalesce(F.col("html").cast("string"), F.lit(""))).cast("binary")
    name = F.sha1(F.concat_ws("\x1f", F.col("page_id").cast("string"), F.col("url"), F.sha1(message)).cast("binary"))
    record = F.concat(F.lit("<urn:uuid:"), *(F.concat(F.substring(name, a, n), F.lit(end)) for a, n, end in
                      ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))))
    return pages.select("page_id", record.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
                        message.alias("content"))


def serialise(record: dict) -> bytes:
    """One WARC/1.1 record. The headers of the source follow as WARC-Source-Header lines; line ends in values are escaped."""
    lines = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"]),
             ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["date"]), ("Content-Type", record["content_type"]),
             ("WARC-Block-Digest", record["block_digest"]), ("WARC-Source-Block-Digest", record["source_block_digest"]),
             ("WARC-Source-Payload-Digest", record["source_payload_digest"]),
             *(("WARC-Source-Header", f"{h['name']}: {h['value']}") for h in record["source_headers"] or []),
             ("Content-Length", str(record["content_length"]))]
    safe = ((n, v.replace("\r", "%0D").replace("\n", "%0A")) for n, v in lines if v is not None)
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in safe)
    return head.encode("utf-8", "replace") + CRLF + bytes(record["content"]) + CRLF + CRLF


def parse(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and content of each record of an uncompressed file."""
    at = 0
    while at < len(raw):
        stop = raw.index(CRLF + CRLF, at)
        headers = [tuple(line.split(": ", 1)) for line in raw[at:stop].decode().split("\r\n")[1:]]
        size = int(next(v for n, v in headers if n == "Content-Length"))
        yield headers, raw[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def serialised(records: DataFrame) -> DataFrame:
    """``records`` with their bytes in a WARC file as column ``record``, replacing a column of this name."""
    plain = records.drop("record")
    schema = T.StructType([*plain.schema, T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [serialise(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return plain.mapInArrow(run, schema)
