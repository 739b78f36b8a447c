"""WARC derivatives: linked metadata and plain-text conversion records of responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm.common import empty_if_null

#: Elements whose content is no text, and tags that end a line.
_HIDDEN = frozenset("script style noscript template".split())
_BLOCK = frozenset(
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer nav title head body blockquote pre hr dd dt main form option".split()
)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _HIDDEN}
_NAME = re.compile(r"\w*")
_TITLE_END = re.compile(r"</title", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
#: Decimal references that are longer than any character's number.
_LONG = re.compile(r"&#0*([0-9]{8,});?")

RECORD = (
    "record_id string, record_type string, refers_to string, refers_to_target_uri string, refers_to_date string, target_uri string, "
    "warc_date string, content_type string, source_headers string, source_payload_digest string, source_block_digest string, "
    "block_digest string, content_length bigint, block string"
)
_NAMES = [part.strip().split(" ")[0] for part in RECORD.split(",")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Page(NamedTuple):
    text: str
    title: str
    language: str
    links: int


def _lines(marked: str) -> str:
    """Entities resolved, blanks squeezed, empty lines out."""
    text = html.unescape(_LONG.sub("\ufffd", marked))
    return "\n".join(line for line in (_BLANKS.sub(" ", line).strip() for line in text.split("\n")) if line)


def read_page(page: str) -> Page:
    """Text, title, language and number of links of a page, in one scan forward from sign to sign, however the page is broken.

    Scripts, styles and comments are left out, block tags end lines, other tags vanish; what is never closed reaches to the end. A tag is < with a letter, /, ! or ?
    and everything to the next >; without one, it is text. The title is the first one that is closed, the language that of the first html tag that names one (its last attribute lang), a link is a tag a with an
    href. What stands in scripts, styles and comments counts for none of these.
    """
    out: list[str] = []
    title = language = None
    titled, links, at = True, 0, 0
    last = page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        at = start
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        lead = page[start + 1 : start + 2]
        closing = lead == "/"
        lead = page[start + 2 : start + 3] if closing else lead
        if start > last or not (lead.isascii() and lead.isalpha() or lead in ("!", "?")) or not lead:
            out.append("<")
            at = start + 1
            if start > last:  # no tag can end any more
                break
            continue
        end = page.index(">", start)
        at = end + 1
        name = _NAME.match(page, start + 1 + closing, end)[0].lower()
        if name in _HIDDEN and not closing:
            found = _ENDS[name].search(page, at)
            out.append(" ")
            at = found.end() if found else len(page)
            continue
        if name in _BLOCK:
            out.append("\n")
        if closing:
            continue
        if name == "title" and title is None and titled:
            found = _TITLE_END.search(page, at)
            titled = found is not None
            title = page[at : found.start()] if found else None
        elif name == "html" and language is None:
            named = _LANG.findall(page, start, end)
            language = named[-1] if named else None
        elif name == "a" and _HREF.search(page, start, end):
            links += 1
    out.append(page[at:])
    heading = read_page(title).text.replace("\n", " ") if title else ""
    return Page(_lines("".join(out)), heading, language or "", links)


def plain_text(page: str) -> str:
    return read_page(page).text


def _child(parent: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{parent}#{kind}')}>"


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (record_id, target_uri, warc_date, http_headers, payload) of pages (page_id, url, html).

    Native columns only. The record id is a UUID of page_id, url and html, so rows that repeat all three share it.
    """
    payload = empty_if_null("html")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), empty_if_null("url"), F.md5(payload)))
    record_id = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string")
    )
    return pages.select(
        "page_id", record_id.alias("record_id"), empty_if_null("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        headers.alias("http_headers"), payload.alias("payload"),
    )


def derive_records(responses: DataFrame) -> DataFrame:
    """Two records for every response: type metadata, then conversion, linked to it and to each other's source.

    Input columns: record_id, target_uri, warc_date, http_headers, payload; any others (but those named as
    in ``RECORD``) are carried along. refers_to, refers_to_target_uri and refers_to_date name the response; source_headers
    are its HTTP headers as they were; source_payload_digest and source_block_digest are base32 SHA-1
    digests of its payload and of headers with payload. The metadata block lists status, title, language,
    links, the sizes before and after and every HTTP header of the source, so that files keep them; the conversion block is the plain text. Record ids are UUIDs of the response's id, so
    a repeated run gives the same. Nulls count as empty; an empty page has an empty conversion. Rows that repeat are
    derived twice. An empty table gives an empty result.
    """
    own = ["record_id", "target_uri", "warc_date", "http_headers", "payload"]
    carried = [c for c in responses.columns if c not in own and c not in _NAMES]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in responses.schema if f.name in carried) + RECORD

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in own]
            take, rows = [], []
            for i, (record_id, uri, date, headers, payload) in enumerate(zip(*columns, strict=True)):
                data, page = payload.encode(), read_page(payload)
                text = page.text
                status = headers.split("\r\n", 1)[0]
                fields = {
                    "http-status": status, "title": page.title, "language": page.language, "links": page.links,
                    "source-bytes": len(data), "text-bytes": len(text.encode()),
                }
                facts = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
                facts += "".join(f"source-header: {line}\r\n" for line in headers.split("\r\n")[1:] if line)
                source = (headers, digest(data), digest(headers.encode() + b"\r\n\r\n" + data))
                for kind, content, block in (("metadata", "application/warc-fields", facts), ("conversion", "text/plain; charset=utf-8", text)):
                    body = block.encode()
                    take.append(i)
                    rows.append((_child(record_id, kind), kind, record_id, uri, date, uri, date, content, *source, digest(body), len(body), block))
            if rows:
                at = pa.array(take)
                made = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in carried), *made], [*carried, *_NAMES])

    filled = [empty_if_null(c).alias(c) for c in own]
    return responses.select(*[F.col(f"`{c}`") for c in carried], *filled).mapInArrow(run, schema)


def record_texts(records: DataFrame) -> DataFrame:
    """Each derivative as the text of a WARC 1.1 record, without the closing blank lines; line ends inside a header become blanks.

    A header whose column is null or empty is left out, a null block counts as empty.
    """
    header = lambda name, column: F.when(F.length(column) > 0, F.concat(F.lit(f"{name}: "), F.regexp_replace(column, "[\r\n]+", " "), F.lit("\r\n"))).otherwise("")
    named = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"), ("WARC-Refers-To-Date", "refers_to_date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"),
        ("WARC-Source-Block-Digest", "source_block_digest"), ("Content-Type", "content_type"),
    ]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(empty_if_null("block")).cast("string"), F.lit("\r\n\r\n"))
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *[header(n, c) for n, c in named], length, empty_if_null("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write derivatives as gzipped WARC files, one for each partition, wherever Spark can write."""
    record_texts(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (path, headers, block) of WARC files, gzipped or plain; one file is read by one task."""

    def run(batches):
        import zlib

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    parts, rest = [], data
                    while rest:
                        member = zlib.decompressobj(31)
                        parts.append(member.decompress(rest))
                        rest = member.unused_data.lstrip(b"\0")
                    data = b"".join(parts)
                at, out = 0, []
                while (at := data.find(b"WARC/", at)) >= 0:
                    end = data.index(b"\r\n\r\n", at)
                    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
                    headers = {k: v for k, v in (line.split(": ", 1) for line in lines if ": " in line)}
                    size = int(headers.get("Content-Length", 0))
                    out.append((list(headers.items()), data[end + 4 : end + 4 + size]))
                    at = end + 4 + size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(out)), pa.array([h for h, _ in out], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in out], pa.binary())],
                    ["path", "headers", "block"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, headers map<string,string>, block binary")
