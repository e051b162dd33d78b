"""WARC derivatives: linked metadata and plain-text conversion records from response records.

A record is a row: ``warc_type``, ``record_id``, ``headers`` (the named fields) and ``block`` (the bytes after them).
Each response gives one metadata record (JSON: the source's headers and digests, HTTP status and headers, title and
outgoing links) and, where its payload is text, one conversion record. Both name the response in WARC-Refers-To, each
other in WARC-Concurrent-To, and repeat the source's digest. Record ids follow from the source's id, so a task that
runs again writes the same records.
"""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "warc_type string, record_id string, headers map<string,string>, block binary"
_RECORD_ARROW = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs

#: What stands in a tag behind its name: a quoted value may hold ``>``, a quote that never closes is a character.
_REST = r"""(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b{_REST}>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(rf"<(?:/?(?:p|div|section|article|header|footer|nav|aside|main|h[1-6]|ul|ol|li|table|tr|td|th|dl|dt|dd|blockquote|pre|form|title|head|body|html)|br|hr)\b{_REST}>", re.I)
_TAG = re.compile(rf"</?[A-Za-z!?]{_REST}>")
_GAP = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(rf"<title\b{_REST}>(.*?)(?:</title|\Z)", re.S | re.I)
_LINK = re.compile(rf"<(a|area|link|img|script|iframe|form|source|video|audio)\b({_REST})>", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_LINKING = ("href", "src", "action")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def plain_text(page: str) -> str:
    """Text that a page shows: no comments, scripts or tags; one line a block element, blanks joined."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _GAP.sub(" ", html.unescape(text))).strip()


def links(page: str, base: str) -> list[dict[str, str]]:
    """Outgoing links in order of appearance, resolved against the page's address: the first linking attribute of a tag."""
    out = []
    for tag, inside in _LINK.findall(_HIDDEN.sub(" ", page)):
        attribute, value = next(((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(inside) if k.lower() in _LINKING), ("", ""))
        if not attribute:
            continue
        target = html.unescape(value).strip()
        try:
            out.append({"path": f"{tag.upper()}@/{attribute}", "url": _join(base, target)})
        except ValueError:  # not an address; kept as it stands
            out.append({"path": f"{tag.upper()}@/{attribute}", "url": target})
    return out


@functools.lru_cache(maxsize=4096)
def _join(base: str, target: str) -> str:
    return urljoin(base, target)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload. A block without an HTTP head is all payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    pairs = [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines) if sep]
    return status, pairs, payload


def derive(headers: dict[str, str], source_id: str, block: bytes) -> list[tuple[str, str, dict[str, str], bytes]]:
    """Derivative records of one response."""
    status, http, payload = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    is_html = "html" in kind.lower() or not kind and b"<" in payload[:1024]
    is_text = is_html or kind.lower().startswith("text/")
    target = headers.get("WARC-Target-URI", "")
    source_digest = headers.get("WARC-Payload-Digest") or digest(payload)
    ids = {k: record_id(f"{source_id}#{k}") for k in ("metadata", "conversion")}
    page, found, title = "", [], None
    if is_text:
        named = _CHARSET.search(kind.encode()) or _CHARSET.search(payload[:2048])
        try:
            page = payload.decode(named[1].decode() if named else "utf-8", "replace")
        except LookupError:
            page = payload.decode("utf-8", "replace")
    if is_html:
        found = links(page, target)
        titled = _TITLE.search(page)
        title = " ".join(html.unescape(_TAG.sub("", titled[1])).split()) if titled else None
    envelope = {
        "source": {"headers": headers, "block_digest": headers.get("WARC-Block-Digest") or digest(block), "payload_digest": source_digest},
        "http": {"status": status, "headers": http},
        "title": title,
        "links": found,
    }
    body = json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()
    rows = [("metadata", body, "application/json")]
    if is_text:
        rows.append(("conversion", (plain_text(page) if is_html else page).encode(), "text/plain; charset=utf-8"))
    out = []
    for name, data, content in rows:
        fields = {
            "WARC-Type": name, "WARC-Record-ID": ids[name], "WARC-Refers-To": source_id, "WARC-Target-URI": target, "WARC-Date": headers.get("WARC-Date", ""),
            "WARC-Refers-To-Payload-Digest": source_digest, "WARC-Block-Digest": digest(data), "Content-Type": content, "Content-Length": str(len(data)),
        }
        if is_text:
            fields["WARC-Concurrent-To"] = ids["conversion" if name == "metadata" else "metadata"]
        out.append((name, ids[name], fields, data))
    return out


def derivatives(records: DataFrame, carry: str | None = None) -> DataFrame:
    """Metadata and conversion records of every response row; other record types give none. No shuffle.

    A null block counts as empty; null headers as none; a response without an id gets one from its block's digest.
    ``carry`` names a long column that each derivative takes over; other columns besides a record's are not read.
    Repeated responses give repeated derivatives with equal ids; an empty table gives an empty one. A page is worked
    on whole, however long; derivatives leave a task in batches of about 8 MB or one record.
    """

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for rid, headers, block, *own in zip(*(batch.column(c) for c in batch.schema.names), strict=True):
                data = block.as_py() or b""
                made = derive(dict(headers.as_py() or ()), rid.as_py() or record_id(digest(data)), data)
                out += [x + tuple(o.as_py() for o in own) for x in made]
                size += sum(len(x[3]) for x in made)
                if size > 8_000_000:
                    yield _batch(out, carry)
                    out, size = [], 0
            yield _batch(out, carry)

    taken = ["record_id", "headers", "block", *([carry] if carry else [])]
    return records.where("warc_type = 'response'").select(*taken).mapInArrow(run, RECORD + (f", `{carry}` long" if carry else ""))


def _batch(rows, carry: str | None = None) -> pa.RecordBatch:
    schema = _RECORD_ARROW.append(pa.field(carry, pa.int64())) if carry else _RECORD_ARROW
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    columns[2] = [list(h.items()) for h in columns[2]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a crawl table (page_id, url, html), by built-in functions; a null page is an empty one."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n"))
    name = F.sha2(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url")), 256)
    dashed: Column = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(name, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    rows = pages.select("page_id", "url", dashed.alias("record_id"), body.alias("body"), F.concat(F.encode(head, "utf-8"), body).alias("block"))
    fields = {"WARC-Type": F.lit("response"), "WARC-Record-ID": F.col("record_id"), "WARC-Target-URI": F.coalesce("url", F.lit("")), "WARC-Date": F.lit(date), "Content-Type": F.lit("application/http; msgtype=response"), "Content-Length": F.length("block").cast("string")}
    return rows.select(F.lit("response").alias("warc_type"), "record_id", F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]).alias("headers"), "block", "page_id")


def serialized(records: DataFrame) -> DataFrame:
    """``records`` with ``warc``: each record as it stands in a WARC file, as one gzip member."""

    def run(headers: pa.Array, blocks: pa.Array) -> pa.Array:
        return pa.array([gzip.compress(_bytes(dict(h.as_py() or ()), b.as_py() or b""), mtime=0) for h, b in zip(headers, blocks, strict=True)], pa.binary())

    return records.withColumn("warc", F.arrow_udf(run, "binary")("headers", "block"))


def _bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A record in its file form; a field whose value has several lines is one that repeats."""
    fields = "".join(f"{k}: {x}\r\n" for k, v in headers.items() for x in (v or "").split("\n"))
    return b"WARC/1.1\r\n" + fields.encode() + b"\r\n" + block + b"\r\n\r\n"


#: The names that the format defines, as it spells them; names in a file differ from them in case at most.
_FIELDS = {
    f.lower(): f
    for f in (
        "WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Concurrent-To", "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-IP-Address", "WARC-Refers-To",
        "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Target-URI", "WARC-Truncated", "WARC-Warcinfo-ID", "WARC-Filename", "WARC-Profile", "WARC-Identified-Payload-Type", "WARC-Segment-Number",
        "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length",
    )
}


def parse(stream: io.BufferedIOBase):
    """Records of an uncompressed WARC stream: (type, id, headers, block).

    A field that repeats has its values on lines of their own; a folded line continues the one before. A file that
    ends early, or a gzip member that is cut, gives what records it has whole.
    """
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            headers: dict[str, str] = {}
            last = ""
            while (line := stream.readline()).strip():
                if line[:1] in b" \t" and last:
                    headers[last] += " " + line.decode("utf-8", "replace").strip()
                    continue
                key, _, value = line.decode("utf-8", "replace").partition(":")
                last = _FIELDS.get(key.strip().lower(), key.strip())
                headers[last] = f"{headers[last]}\n{value.strip()}" if last in headers else value.strip()
            length = int(headers.get("Content-Length", "0").split("\n")[0])
            block = stream.read(length)
            if len(block) < length:
                return
            yield headers.get("WARC-Type"), headers.get("WARC-Record-ID"), headers, block
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def _records(stream) -> Iterator[pa.RecordBatch]:
    head = stream.peek(2)[:2]
    data = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if head == b"\x1f\x8b" else stream
    out, size = [], 0
    for record in parse(data):
        out.append(record)
        size += len(record[3])
        if size > 8_000_000:
            yield _batch(out)
            out, size = [], 0
    yield _batch(out)


#: Bytes of the largest file that is read as one value; a larger one is streamed from its file system.
WHOLE_FILE = 256_000_000


def read_warc(spark: SparkSession, path: str, whole_file: int = WHOLE_FILE) -> DataFrame:
    """Records of ``.warc`` and ``.warc.gz`` files; a file is one task's work, as gzip members have no index.

    Files up to ``whole_file`` bytes come through Spark's reader. Larger ones are opened by their address where they
    are read and streamed, so a task holds one record, whatever the file's size.
    """

    def small(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _records(io.BufferedReader(io.BytesIO(content.as_py())))

    def large(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, inside = fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", name))
                with system.open_input_stream(inside, compression=None) as source:
                    yield from _records(io.BufferedReader(source, 1 << 20))

    files = spark.read.format("binaryFile").load(path)
    few = files.where(F.col("length") <= whole_file).select("content").mapInArrow(small, RECORD)
    names = files.where(F.col("length") > whole_file).select("path")
    return few.unionByName(names.mapInArrow(large, RECORD))


def derivative_report(pages: DataFrame) -> DataFrame:
    """One row a derivative record of ``pages``: its ids, digests, sizes, number of links and text digest."""
    made = derivatives(responses(pages), "page_id")
    field = lambda k: F.col("headers")[k]
    text = F.col("block").cast("string")
    return made.select(
        "page_id", field("WARC-Refers-To").alias("refers_to"), F.col("warc_type").alias("kind"), "record_id", field("WARC-Concurrent-To").alias("concurrent_to"), field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Refers-To-Payload-Digest").alias("source_digest"), field("WARC-Block-Digest").alias("block_digest"), F.length("block").cast("long").alias("content_length"),
        F.when(F.col("warc_type") == "metadata", F.json_array_length(F.get_json_object(text, "$.links"))).cast("long").alias("n_links"), F.sha2("block", 256).alias("block_sha256"),
    )
