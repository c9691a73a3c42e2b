"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record becomes two records that refer to it: `metadata`, with what
its headers and page tell, and `conversion`, with the page's text.  Both carry
the source's target URI, date and the header fields in CARRIED, a
WARC-Refers-To with the source's record id, and SHA-1 digests in Base32; the
metadata block repeats the source's own digests.  Record ids are name-based
on the source id, so a rerun or a retried task writes equal records.

Pages are read in one pass from tag to tag; no pattern scans a stretch of text
twice, so a hostile page costs as much as any other of its size.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import map_arrow

VERSION = b"WARC/1.1"
CARRIED = ("WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type", "WARC-Truncated")
#: WARC-Date, which a record must have, of pages without a known time of capture.
NO_DATE = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"\r\nContent-Length[ \t]*+:[ \t]*+(\d++)", re.I)
_SPACE = uuid.UUID("8c6f0f0a-6c1e-5f43-9a57-3a1d9a1f7b11")

#: Comments, declarations and tags; quantifiers are possessive, so each character is passed once.
_MARKUP = re.compile(r"<(?:!--|([!?])|(/?)([a-z][a-z0-9]*+)((?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))", re.S | re.I)
_SKIPPED = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "noscript", "template")}
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"']*+)))?", re.S)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, kind + chr(10) + name)}>"


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    lines = [VERSION, *(f"{k}: {clean(v)}".encode("utf-8", "surrogatepass") for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> tuple[bytes, list[tuple[str, str]], int]:
    """(first line, fields, where the block starts); continued lines are joined."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of headers")
    first, *lines = data[:end].split(b"\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + text.strip())
        elif ":" in text:
            k, v = text.split(":", 1)
            fields.append((k.strip(), v.strip()))
    return first, fields, end + 4


def get(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def parse_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields and block of one whole record; ValueError says what is wrong."""
    first, fields, at = parse_headers(data)
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC version line")
    length = get(fields, "Content-Length")
    if length is None or not length.isdigit():
        raise ValueError("no Content-Length")
    if len(data) < at + int(length):
        raise ValueError("the block is cut off")
    return fields, data[at : at + int(length)]


def _members(data: bytes) -> Iterator[bytes]:
    """The contents of gzipped members one after the other; what can't be unpacked ends them with None."""
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        try:
            yield z.decompress(view) + z.flush()
        except zlib.error:
            yield None
            return
        if not z.eof:
            yield None
            return
        view = view[len(view) - len(z.unused_data) :] if z.unused_data else view[:0]


def split_records(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(record, error) of each record of an uncompressed file, or of one whose members are gzipped.

    Where no record can be made out the rest of the stretch, up to the next
    version line, is one with an error.
    """
    for part in _members(data) if data[:2] == b"\x1f\x8b" else (data,):
        if part is None:
            yield b"", "a gzip member is broken"
            return
        at = 0
        while at < len(part):
            if not part.startswith(VERSION[:5], at):
                at = (part.find(b"\r\nWARC/", at) + 2 or len(part) + 2) if part[at:].strip() else len(part)
                if at <= len(part) and not part[at:].strip():
                    return
                yield b"", "no WARC version line"
                continue
            end = part.find(b"\r\n\r\n", at)
            length = _LENGTH.search(part, at, end if end >= 0 else at)
            stop = end + 4 + int(length.group(1)) if length else -1
            if end < 0 or length is None or stop > len(part):
                yield b"", "no end of headers" if end < 0 else "no Content-Length" if length is None else "the block is cut off"
                again = part.find(b"\r\nWARC/", at)
                at = again + 2 if again >= 0 else len(part)
                continue
            yield part[at:stop] + b"\r\n\r\n", None
            at = stop + 4


def response_record(url: str, page: str, date: str = NO_DATE, key: object = None) -> bytes:
    """A response record for a page that was kept without its headers; its id follows from key, address and content."""
    body = page.encode("utf-8", "surrogatepass")
    of_body = digest(body)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", f"{key}\n{url}\n{of_body}")),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", of_body),
        ("WARC-Block-Digest", digest(block)),
    ]
    return build_record(headers, block)


def attributes(tag: str) -> dict[str, str]:
    """The attributes of a tag's inside by lower-case name, the first of each."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        out.setdefault(m.group(1).lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def read_page(page: str) -> dict:
    """text, title, language and links of a page.

    text has no scripts, styles or comments, a line for each block, and
    entities resolved.  Comments, scripts and the like that are never closed
    go on to the end; so does a title.
    """
    out, links, at, n = [], [], 0, len(page)
    title = language = None
    while (m := _MARKUP.search(page, at)) is not None:
        out.append(page[at : m.start()])
        name = (m.group(3) or "").lower()
        if not name:
            comment = m.group(1) is None
            end = page.find("-->" if comment else ">", m.end())
            at = n if end < 0 else end + (3 if comment else 1)
            out.append("" if comment else " ")
            continue
        at = m.end()
        if m.group(2):
            out.append("\n" if name in _BLOCKS else "")
            continue
        if name in _SKIPPED:
            closing = _SKIPPED[name].search(page, at)
            at = closing.end() if closing else n
            out.append("\n")
            continue
        out.append("\n" if name in _BLOCKS else "")
        if name == "title" and title is None:
            end = page.find("<", at)
            title = " ".join(html.unescape(page[at : end if end >= 0 else n]).split())
        elif name == "html" and language is None:
            language = attributes(m.group(4)).get("lang") or None
        elif name == "a" and (to := attributes(m.group(4)).get("href")) is not None:
            links.append(" ".join(html.unescape(to).split()))
    out.append(page[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return {"text": "\n".join(x for x in lines if x), "title": title, "language": language, "links": links}


def page_text(page: str) -> str:
    return read_page(page)["text"]


def derive(data: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """(kind, headers, block) of the records made from one response record.

    A record that is no response, or whose HTTP part can't be read, gives a
    metadata record that says so and no conversion.
    """
    fields, block = parse_record(data)
    source = get(fields, "WARC-Record-ID") or record_id("source", digest(data))
    shared = [("WARC-Refers-To", source)]
    shared += [(k, v) for k in ("WARC-Target-URI", "WARC-Date", *CARRIED) if (v := get(fields, k)) is not None]
    told: list[tuple[str, str]] = [("source-type", get(fields, "WARC-Type") or "")]
    told += [("source-" + k.lower(), v) for k in ("WARC-Block-Digest", "WARC-Payload-Digest") if (v := get(fields, k)) is not None]
    out = []
    try:
        if get(fields, "WARC-Type") != "response":
            raise ValueError("not a response")
        status, http, at = parse_headers(block)
        body = block[at:]
        kind = get(http, "Content-Type") or ""
        named = _CHARSET.search(kind) or _CHARSET.search(body[:2048].decode("latin-1"))
        charset = named.group(1).lower() if named else "utf-8"
        try:
            page = body.decode(charset, "replace")
        except LookupError:
            page = body.decode("utf-8", "replace")
        told += [("http-status", status.decode("latin-1")), *((f"http-{k.lower()}", v) for k, v in http)]
        own = digest(body)
        told += [("charset", charset), ("computed-payload-digest", own), ("payload-length", str(len(body)))]
        declared = get(fields, "WARC-Payload-Digest")
        told.append(("payload-digest-matches", "unknown" if declared is None else str(declared == own).lower()))
        read = read_page(page)
        told += [(k, read[k]) for k in ("language", "title") if read[k] is not None]
        told += [("outlink", x) for x in read["links"]]
        text = read["text"].encode("utf-8", "surrogatepass")
        extra = [("Content-Type", "text/plain; charset=utf-8"), ("WARC-Source-Payload-Digest", declared or own)]
        out.append(("conversion", extra, text))
    except ValueError as why:
        told.append(("error", str(why)))
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    lines = "".join(f"{k}: {clean(v)}\r\n" for k, v in told).encode("utf-8", "surrogatepass")
    out.insert(0, ("metadata", [("Content-Type", "application/warc-fields")], lines))
    made = []
    for kind, extra, content in out:
        others = [("WARC-Concurrent-To", record_id(k, source)) for k, _, _ in out if k != kind]
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), *shared, *others, *extra, ("WARC-Block-Digest", digest(content))]
        made.append((kind, headers, content))
    return made


DERIVED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        *(T.StructField(c, T.StringType()) for c in ("record_id", "refers_to", "target_uri", "date", "block_digest", "source_payload_digest", "error")),
        T.StructField("block_length", T.LongType()),
        T.StructField("record", T.BinaryType()),
    ]
)


def _row(data: bytes | None, broken: str | None = None) -> list[dict]:
    if broken is not None:
        return [{"kind": None, "error": broken}]
    if data is None:
        return []
    try:
        made = derive(data)
    except ValueError as why:
        return [{"kind": None, "error": str(why)}]
    out = []
    for kind, headers, block in made:
        # Only a metadata record tells an error, on a line of its own.
        told = block.decode("utf-8", "replace").split("\r\n") if kind == "metadata" and b"error: " in block else ()
        error = next((x[7:] for x in told if x.startswith("error: ")), None)
        out.append(
            {
                "kind": kind,
                "record_id": get(headers, "WARC-Record-ID"),
                "refers_to": get(headers, "WARC-Refers-To"),
                "target_uri": get(headers, "WARC-Target-URI"),
                "date": get(headers, "WARC-Date"),
                "block_digest": get(headers, "WARC-Block-Digest"),
                "source_payload_digest": get(headers, "WARC-Source-Payload-Digest"),
                "error": error,
                "block_length": len(block),
                "record": build_record(headers, block),
            }
        )
    return out


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in DERIVED.fields]
    types = [pa.string()] * 8 + [pa.int64(), pa.binary()]
    for batch in batches:
        records, errors = batch.column("record"), batch.column("broken")
        for lo in range(0, batch.num_rows, 256):
            cut = zip(records.slice(lo, 256).to_pylist(), errors.slice(lo, 256).to_pylist())
            made = [(lo + i, x) for i, (r, e) in enumerate(cut) for x in _row(r, e)]
            at = pa.array([i for i, _ in made], pa.int64())
            yield pa.record_batch([batch.column("key").take(at), *(pa.array([x.get(n) for _, x in made], t) for n, t in zip(names, types))], ["key", *names])


def _respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            cut = batch.slice(lo, 256)
            rows = zip(*(cut.column(c).to_pylist() for c in ("key", "url", "html", "date")))
            made = [None if page is None else response_record(url or "", page, date or NO_DATE, key) for key, url, page, date in rows]
            yield pa.record_batch([cut.column("key"), pa.array(made, pa.binary())], ["key", "record"])


def responses_of(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str | None = None) -> DataFrame:
    """key, record: a response record for each page; null where the page is null.

    date names a column with the times of capture as WARC writes them; without
    it, or where it is null, records carry NO_DATE.  A record's id follows from
    key, address and content; rows equal in all three are one capture.
    """
    when = F.lit(None).cast("string") if date is None else F.col(date)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("html"), when.alias("date"))
    return map_arrow(rows, _respond, T.StructType([rows.schema["key"], T.StructField("record", T.BinaryType())]))


def derive_records(responses: DataFrame) -> DataFrame:
    """key and the columns of DERIVED: a row for each record made from (key, record).

    A null record gives no row; one that is no WARC record gives a row with a
    null kind and the error, and one that brings an error from its file keeps it.  Repeated records give equal rows each; an empty
    table gives none; other columns are ignored.
    """
    broken = F.col("error") if "error" in responses.columns else F.lit(None)
    rows = responses.select("key", "record", broken.cast("string").alias("broken"))
    return map_arrow(rows, _derive, T.StructType([rows.schema["key"], *DERIVED.fields]))


def _files(folder: str):
    from pyspark import TaskContext

    from .training_order import _store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _store(folder)
        name = f"{base}/part-{task.partitionId():05d}.warc.gz"
        temporary = f"{base}/.{task.partitionId():05d}-{task.taskAttemptId()}"
        n = 0
        with store.open_output_stream(temporary) as f:
            for batch in batches:
                for record in batch.column("record").to_pylist():
                    if record is not None:
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        f.write(z.compress(record) + z.flush())
                        n += 1
        store.move(temporary, name)
        yield pa.record_batch([pa.array([name]), pa.array([n])], ["path", "records"])

    return run


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records as gzipped members, a file for each partition; folder is a path that executors share or a URI of a store."""
    from . import scratch
    from .training_order import _store

    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    return scratch.written(map_arrow(records.select("record"), _files(folder), "path string, records bigint"), "warc-files")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            for i, (record, error) in enumerate(split_records(content)):
                yield pa.record_batch([pa.array([f"{path}#{i}"]), pa.array([None if error else record], pa.binary()), pa.array([error], pa.string())], ["key", "record", "error"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """key (path#number), record, error of each record of the WARC files under path.

    A file is one row to Spark, 2 GB at most; what is broken in it becomes a
    row with a null record and the error, and reading goes on behind it.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, _split, "key string, record binary, error string")
