"""WARC derivatives: metadata and plain-text conversion records made from responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import sliced

# Fixed values of the format: version line, line end, record end, media types.
VERSION = b"WARC/1.1"
LINE, RECORD_END = b"\r\n", b"\r\n\r\n"
HTTP_RESPONSE = "application/http; msgtype=response"
FIELDS = "application/warc-fields"
PLAIN = "text/plain; charset=utf-8"
# Elements whose content is no text, and elements that end a line.
OPENING = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
TO_THE_END = ("script", "style")
BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|"
    r"p|pre|section|table|td|th|title|tr|ul)\b[^>]*>",
    re.I,
)
TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
TITLE, TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title\s*>", re.I)
ANCHOR = re.compile(r"<a\b", re.I)
HREF = re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)

RECORD = (
    "id {id}, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, refers_to_target_uri string, refers_to_date string, "
    "source_payload_digest string, block binary"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """The same identifier for the same record on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(map(str, parts)))}>"


def visible(markup: str) -> str:
    """The markup with a blank for every comment and every element without text.

    An unclosed comment, script or style hides the rest.  One pass: where no end
    of an element is left, none is looked for again.
    """
    parts, at, start, unclosed = [], 0, 0, set()
    while found := OPENING.search(markup, at):
        name = (found[1] or "").lower()
        if name in unclosed:
            at = found.end()
            continue
        if name:
            close = CLOSING[name].search(markup, found.end())
            end = close.end() if close else -1
        else:
            end = markup.find("-->", found.end())
            end = end + 3 if end >= 0 else -1
        if end < 0 and name and name not in TO_THE_END:
            unclosed.add(name)
            at = found.end()
            continue
        parts += [markup[start : found.start()], " "]
        at = start = end if end >= 0 else len(markup)
    return "".join([*parts, markup[start:]])


def _replaced(tags: re.Pattern, by: str, markup: str) -> str:
    """Tags replaced; what follows the last ``>`` holds none and is not searched."""
    end = markup.rfind(">") + 1
    return tags.sub(by, markup[:end]) + markup[end:]


def plain_text(markup: str) -> str:
    """The text of a page: one line for every block with text."""
    text = html.unescape(_replaced(TAG, "", _replaced(BLOCK, "\n", visible(markup))))
    return "\n".join(line for line in (" ".join(part.split()) for part in text.split("\n")) if line)


def title_of(markup: str) -> str | None:
    """Content of the first title that is closed; no title after an unclosed one can be."""
    found = TITLE.search(markup)
    start = markup.find(">", found.end()) + 1 if found else 0
    close = TITLE_END.search(markup, start) if start else None
    return markup[start : close.start()] if close else None


def links_of(markup: str) -> Iterator[str]:
    """Targets of the page's links; an anchor is looked through up to its ``>`` once."""
    at = 0
    while found := ANCHOR.search(markup, at):
        at = markup.find(">", found.end())
        at = len(markup) if at < 0 else at
        start = found.end()
        while name := HREF.search(markup, start, at):
            if value := VALUE.match(markup, name.end()):
                yield next(filter(None, value.groups()), "")
                at = value.end()
                break
            start = name.end()


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Status line, headers (lower-case names, the last of equals) and payload of an HTTP message."""
    head, _, payload = block.partition(RECORD_END)
    first, *rest = head.split(LINE)
    pairs = (line.decode("latin-1").partition(":") for line in rest)
    return first, {name.strip().lower(): value.strip() for name, _, value in pairs if name}, payload


def charset_of(headers: dict[str, str]) -> str:
    """Declared character set; UTF-8 when there is none or it is not known."""
    found = CHARSET.search(headers.get("content-type", ""))
    try:
        return found and "".encode(found[1]).decode() or (found[1] if found else "utf-8")
    except LookupError:
        return "utf-8"


def decoded(payload: bytes, headers: dict[str, str]) -> str:
    return payload.decode(charset_of(headers), "replace")


def responses_from_pages(
    pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Response records of stored pages: ``id`` and the columns of a record.

    A null page is an empty payload, a null url an empty one.  Identifiers are
    made of id, url and payload, so repeated rows name the same record.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def response(key: object, url: str | None, markup: str | None) -> tuple:
        payload, url = (markup or "").encode(), url or ""
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
        block = head.encode() + RECORD_END + payload
        paid = digest(payload)
        return ("response", record_id(key, url, paid), None, url, date, HTTP_RESPONSE, len(block), digest(block), paid, None, None, None, block)

    return rows.mapInArrow(_records(lambda *row: [response(*row)], ["id", "url", "html"]), RECORD.format(id=kind))


def _records(make, columns: list[str]):
    """A batch function that gives every row the records of ``make``, with the row's id."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lists in sliced([batch], columns):
                places, records = [], []
                for row in zip(*lists):
                    made = make(*row)
                    places += [at] * len(made)
                    records += made
                    at += 1
                ids = batch.column("id").take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([r[i] for r in records], kind) for i, kind in enumerate(kinds))], names
                )

    return run


def _derived(uri: str | None, source: str, date: str | None, block: bytes, paid: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = split_http(block or b"")
    markup = decoded(payload, headers)
    paid = paid or digest(payload)
    shown = visible(markup)
    title = title_of(shown)
    fields = [
        ("sourceStatus", status.decode("latin-1")),
        *((f"sourceHeader-{name}", value) for name, value in sorted(headers.items())),
        ("sourcePayloadDigest", paid),
        ("sourceBlockDigest", digest(block or b"")),
        ("charset", charset_of(headers)),
    ]
    if title is not None:
        fields.append(("title", " ".join(html.unescape(_replaced(TAG, "", title)).split())))
    for found in links_of(shown):
        link = html.unescape(found).strip()
        try:
            link = urljoin(uri or "", link)
        except ValueError:
            pass
        fields.append(("outlink", " ".join(link.split())))
    info = b"".join(f"{name}: {value}".encode() + LINE for name, value in fields)
    text = plain_text(markup).encode()
    made = []
    for kind, media, data, own in (("metadata", FIELDS, info, None), ("conversion", PLAIN, text, digest(text))):
        made.append((kind, record_id(source, kind), source, uri, date, media, len(data), digest(data), own, uri, date, paid, data))
    return made


def derivatives(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records.

    ``responses`` has the columns of a record (see ``responses_from_pages`` and
    ``read_warc``); records of other types are left out.  The result has the
    same columns: both records refer to their response (``refers_to``, its URI
    and date), the metadata record holds the source's status line, headers,
    digests, title and links, the conversion record the page's plain text.

    Null blocks count as empty, null URIs and dates stay null.  Repeated rows
    give repeated records with equal identifiers, an empty table an empty
    result.  Pages are converted one at a time and whole.
    """
    kind = responses.schema["id"].dataType.simpleString()
    chosen = responses.filter(F.col("record_type") == "response").select(
        "id", "target_uri", "record_id", "date", "block", "payload_digest"
    )
    run = _records(_derived, ["target_uri", "record_id", "date", "block", "payload_digest"])
    return chosen.mapInArrow(run, RECORD.format(id=kind))


# Header names of the record columns, in the order in which they are written.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "refers_to_target_uri": "WARC-Refers-To-Target-URI",
    "refers_to_date": "WARC-Refers-To-Date",
    "block_digest": "WARC-Block-Digest",
    "payload_digest": "WARC-Payload-Digest",
    "source_payload_digest": "WARC-Source-Payload-Digest",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
}


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Records as WARC files, one per partition; each record is one value of the text sink, so its bytes stay as they are."""
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    fields = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), one_line(F.col(c).cast("string")), F.lit("\r\n"))).otherwise(F.lit(""))
        for c, name in HEADERS.items()
    ]
    head = F.concat(F.lit(VERSION.decode() + "\r\n"), *fields, F.lit("\r\n"))
    value = F.concat(head.cast("binary"), F.coalesce(F.col("block"), F.lit(b""))).cast("string")
    records.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC 1.x files as the columns of a record, ``id`` being the record's identifier.

    Files are split at version lines by the text source.  The pieces of a file
    are then brought together in their order, so that a block that holds version
    lines itself is put together again wherever the source has split the file; a
    task streams through its files and holds one record at a time.  ``damaged``
    marks a block that is shorter than its header says.
    """
    read = spark.read.option("lineSep", "WARC/1.").text(path)
    pieces = (
        read.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        .withColumn("at", F.monotonically_increasing_id())
        .repartition("file").sortWithinPartitions("file", "start", "at").select("file", "piece")
    )
    names = {v.lower(): k for k, v in HEADERS.items()}
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def parsed(piece: bytes) -> tuple[dict[str, str], bytes]:
        head, _, rest = piece.partition(RECORD_END)
        pairs = (line.decode("utf-8", "replace").partition(":") for line in head.split(LINE)[1:])
        return {names[n.strip().lower()]: v.strip() for n, _, v in pairs if n.strip().lower() in names}, rest

    def wanted(fields: dict[str, str]) -> int:
        return int(fields["content_length"]) if fields.get("content_length", "").isdigit() else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, rest, out, last = {}, b"", [], None

        def close() -> None:
            if fields:
                row = {**fields, "id": fields.get("record_id"), "content_length": wanted(fields), "block": rest[: wanted(fields)]}
                out.append({c: row.get(c) for c in columns} | {"damaged": len(rest) < wanted(fields)})

        for batch in batches:
            for files, values in sliced([batch], ["file", "piece"]):
                for file, piece in zip(files, values):
                    if file != last:
                        close()
                        fields, rest, last = {}, b"", file
                    if fields and len(rest) < wanted(fields):
                        rest += b"WARC/1." + piece
                        continue
                    close()
                    fields, rest = parsed(piece)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema(
        [(c, {"content_length": pa.int64(), "block": pa.binary()}.get(c, pa.string())) for c in columns] + [("damaged", pa.bool_())]
    )
    return pieces.mapInArrow(run, RECORD.format(id="string") + ", damaged boolean")
