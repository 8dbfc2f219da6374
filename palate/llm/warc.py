"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Records are rows: (record_id, kind, target_uri, date, refers_to, headers, block). A derivative keeps the response's
identifier in WARC-Refers-To, its target and date, the source's HTTP headers (in the metadata block) and its digests;
its own identifier follows from the source's, so a job that runs again writes the same records. ``write`` and ``read``
put records into gzip members of WARC files on storage that all executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.llm.sstable import open_fs

VERSION = b"WARC/1.1"
NAMESPACE = uuid.UUID("8f1f3c52-5a0c-5b43-9d0a-6c7d1c4d2e11")
RECORD_DDL = "record_id string, kind string, target_uri string, date string, refers_to string, headers map<string,string>, block binary"
RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("kind", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("refers_to", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("block", pa.binary()),
    ]
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (names lower-cased, repeated ones joined by commas) and payload of an HTTP response. A
    block that does not begin like one is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return lines[0], headers, payload


OPENS = re.compile(r"<!--|<(script|style|noscript|template|head)\b|<!doctype", re.IGNORECASE)
CLOSES = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "head", "title")}
BREAKS = re.compile(r"(?i)<(?:/?(?:p|div|section|article|header|footer|main|nav|aside|ul|ol|li|table|tr|h[1-6]|blockquote|pre|form|dl|dt|dd|figure)|br|hr)\b[^>]*>")
TAGS = re.compile(r"<[/!?]?[A-Za-z][^>]*>")
TITLE = re.compile(r"(?i)<title\b[^>]*>")
HTML = re.compile(r"(?i)<html\b([^>]*)>")
ANCHOR = re.compile(r"(?i)<a\b([^>]*)>")
LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([A-Za-z-]+)""")
HREF = re.compile(r"""(?i)\bhref\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+))""")
BREAK = re.compile(r"[\r\n]+")
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def visible(page: str) -> str:
    """``page`` with a blank for each comment, document type and element that shows no text. One pass forward: a kind of
    end that does not come any more is not looked for again, and what it should have ended stays."""
    out, at, gone = [], 0, set()
    for m in OPENS.finditer(page):
        if m.start() < at:
            continue
        kind = (m[1] or m[0]).lower()
        if kind in gone:
            continue
        if m[1]:
            close = CLOSES[kind].search(page, m.end())
            end = close.end() if close else -1
        else:
            mark = "-->" if kind == "<!--" else ">"
            end = page.find(mark, m.end())
            end += len(mark) if end >= 0 else 0
        if end < 0:
            gone.add(kind)
            continue
        out += page[at : m.start()], " "
        at = end
    return "".join((*out, page[at:]))


def tags_end(page: str) -> int:
    """Where the last tag ends: no pattern of tags is tried behind, where each would run to the page's end in vain."""
    return page.rfind(">") + 1


def plain_text(page: str) -> str:
    """Visible text of an HTML page: a line for each block, blanks collapsed, character references resolved."""
    shown = visible(page).replace("\n", " ")
    end = tags_end(shown)
    text = TAGS.sub(" ", BREAKS.sub("\n", shown[:end])) + shown[end:]
    lines = (BLANKS.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(page: str) -> str:
    """What stands in the first title element that ends."""
    begin = TITLE.search(page, 0, tags_end(page))
    close = CLOSES["title"].search(page, begin.end()) if begin else None
    return BLANKS.sub(" ", html.unescape(page[begin.end() : close.start()]).replace("\n", " ")).strip() if close else ""


def decode(payload: bytes, content_type: str) -> str:
    m = re.search(r"charset=[\"']?([A-Za-z0-9_.:-]+)", content_type) or re.search(
        r"<meta[^>]*charset=[\"']?([A-Za-z0-9_.:-]+)", payload[:2048].decode("latin-1")
    )
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def derivatives(record_id: str, uri: str | None, date: str | None, block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = split_http(block)
    kind = headers.get("content-type", "")
    page = decode(payload, kind)
    block_digest, payload_digest = digest(block), digest(payload)
    end = tags_end(page)
    lang = next((m[1] for h in HTML.finditer(page, 0, end) if (m := LANG.search(h[1]))), "")
    links = (m for a in ANCHOR.finditer(page, 0, end) if (m := HREF.search(a[1])))
    fields = [
        ("http-status", status),
        *((f"http-{k}", v) for k, v in sorted(headers.items())),
        ("source-block-digest", block_digest),
        ("source-payload-digest", payload_digest),
        ("title", title_of(page)),
        ("lang", lang),
        *(("outlink", html.unescape(next(filter(None, m.groups()), ""))) for m in links),
    ]
    meta = "".join(f"{k}: {BREAK.sub(' ', v)}\r\n" for k, v in fields if v).encode()
    shown = plain_text(page) if "html" in kind or not kind or page.lstrip()[:1] == "<" else page
    text = shown.encode("utf-8", "replace")
    common = {"WARC-Source-Block-Digest": block_digest, "WARC-Source-Payload-Digest": payload_digest}
    out = []
    for name, data, media in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        own = common | {"Content-Type": media, "WARC-Block-Digest": digest(data)}
        out.append((urn(record_id, name), name, uri, date, record_id, own, data))
    return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in RECORD]
    made = [pa.array([list(x.items()) for x in c] if f.name == "headers" else list(c), f.type) for c, f in zip(cols, RECORD, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=RECORD.names)


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response in ``responses`` (record columns): metadata, then conversion.

    Records of other kinds are left out. Nulls: a null block counts as empty, and gives an empty conversion; a null
    identifier gets one made from target, date and block digest; null targets and dates stay null. Repeated responses
    give repeated derivatives with equal identifiers. Extra columns are not read. No responses give no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block = r["block"] or b""
                own = r["record_id"] or urn("response", r["target_uri"] or "", r["date"] or "", digest(block))
                rows += derivatives(own, r["target_uri"], r["date"], block)
            yield batch_of(rows)

    some = responses.where(F.col("kind") == "response").select("record_id", "target_uri", "date", "block")
    return some.mapInArrow(run, RECORD_DDL)


def responses_from_pages(pages: DataFrame, date: str = "2024-01-31T00:00:00Z") -> DataFrame:
    """Response records from raw pages (page_id, url, html): an HTTP block around each page's bytes. Null pages are
    empty ones. The page's id goes into the record's headers as ``page-id``."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    unique = F.sha2(F.concat_ws("\x00", F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))), 256)
    made = F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", *(F.substring(unique, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        F.lit(">"),
    )
    return pages.select(
        made.alias("record_id"),
        F.lit("response").alias("kind"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("refers_to"),
        F.create_map(F.lit("page-id"), F.col("page_id").cast("string")).alias("headers"),
        F.concat(F.encode(head, "UTF-8"), body).alias("block"),
    )


# --- files ----------------------------------------------------------------------------------------


def serialise(r: dict) -> bytes:
    """One record as a gzip member."""
    block = r["block"] or b""
    fields = {"WARC-Type": r["kind"] or "resource", "WARC-Record-ID": r["record_id"], "WARC-Date": r["date"]}
    fields |= {"WARC-Target-URI": r["target_uri"], "WARC-Refers-To": r["refers_to"]} | dict(r["headers"] or {})
    if "WARC-Block-Digest" not in fields:
        fields["WARC-Block-Digest"] = digest(block)
    fields["Content-Length"] = str(len(block))
    head = b"".join(f"{k}: {BREAK.sub(' ', v)}\r\n".encode() for k, v in fields.items() if v is not None)
    return gzip.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(stream) -> Iterator[tuple]:
    """Records of an uncompressed stream, one at a time. Damaged framing raises ValueError."""
    names = {"WARC-Record-ID": 0, "WARC-Type": 1, "WARC-Target-URI": 2, "WARC-Date": 3, "WARC-Refers-To": 4}
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        row: list = [None] * 5
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            if name in names:
                row[names[name]] = value.strip()
            else:
                headers[name] = value.strip()
        size = int(headers.pop("Content-Length", "0"))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield (*row, headers, block)


def write(records: DataFrame, path: str) -> DataFrame:
    """Write ``records`` under ``path``, a file for each partition, and return the manifest in ``path``/manifest:
    (file, bytes, records). A file gets its name only when whole, so a task may run again."""
    ddl = "file string, bytes long, records long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, where = open_fs(path)
        fs.create_dir(where, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.gz"
        temporary = f"{where}/.{name}.{task.taskAttemptId()}"
        size = count = 0
        with fs.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    data = serialise(r)
                    out.write(data)
                    size, count = size + len(data), count + 1
        fs.move(temporary, f"{where}/{name}")
        cols = [pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["file", "bytes", "records"])

    columns = [f.name for f in RECORD]
    records.select(*columns).mapInArrow(run, ddl).write.parquet(f"{path}/manifest")
    return records.sparkSession.read.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files that the manifest under ``path`` names, each file read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{where}/{name}", compression=None) as raw:
                    rows, held = [], 0
                    for row in parse(io.BufferedReader(gzip.GzipFile(fileobj=raw))):
                        rows.append(row)
                        held += len(row[6])
                        if held > 8_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    yield batch_of(rows)

    files = spark.read.parquet(f"{path}/manifest").select("file")
    return files.repartition(max(1, min(4096, files.count())), "file").mapInArrow(run, RECORD_DDL)
