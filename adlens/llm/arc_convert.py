"""Legacy ARC archives to WARC: parse, synthesise, deduplicate, write, read.

An ARC file opens with a version block (``filedesc://``) whose body names the
version and so the fields of every later header line:

    1: URL IP-address Archive-date Content-type Archive-length
    2: URL IP-address Archive-date Content-type Result-code Checksum Location
       Offset Filename Archive-length

The last field is the declared length of the content that follows the line.
Files are gzip with one member per record.  Archives never travel through a
shuffle: files are read twice (digests, then conversion), and only rows of a
few fields per record are grouped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import join_salted, one_each, run_path, save

#: Number of fields after the URL, by version.
FIELDS = {1: 4, 2: 9}
NAMES = {1: "URL IP-address Archive-date Content-type Archive-length",
         2: ("URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
             "Filename Archive-length")}
#: HTTP header with a page's id, and WARC field with the length of the payload a revisit leaves out.
ITEM, LENGTH = "X-Archive-Item", "X-Payload-Length"
CHUNK = 1 << 20


def _create(path: str):
    filesystem, name = pafs.FileSystem.from_uri(path)
    filesystem.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(name, compression=None)


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=4, mtime=0)


def _open(path: str):
    filesystem, name = pafs.FileSystem.from_uri(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=filesystem.open_input_stream(name, compression=None)), CHUNK)


# --- ARC ------------------------------------------------------------------

def arc_header(version: int, url: str, ip: str, date: str, kind: str, content: bytes,
               status: str = "200", offset: int = 0, filename: str = "-") -> bytes:
    """The header line of a record of that version."""
    url = re.sub(r"\s+", "%20", url) or "-"
    if version == 1:
        fields = [url, ip, date, kind, str(len(content))]
    else:
        checksum = base64.b32encode(hashlib.sha1(content).digest()).decode()
        fields = [url, ip, date, kind, status, checksum, "-", str(offset), filename, str(len(content))]
    return (" ".join(fields) + "\n").encode("utf-8", "surrogatepass")


def arc_version_block(version: int, filename: str, date: str) -> bytes:
    body = f"{version} 0 adlens\n{NAMES[version]}\n\n".encode()
    if version == 1:
        line = f"filedesc://{filename} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        line = f"filedesc://{filename} 0.0.0.0 {date} text/plain 200 - - 0 {filename} {len(body)}\n"
    return line.encode() + body


def parse_header(line: bytes, version: int) -> dict | None:
    """Fields of a header line, or None if it is none of that version.  Spaces
    inside a legacy URL are allowed: fields are counted from the right."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    n = FIELDS[version]
    if len(parts) < n + 1 or not parts[-1].isdigit() or not re.fullmatch(r"\d{4,14}", parts[-n + 1]):
        return None
    tail = parts[-n:]
    out = {"url": " ".join(parts[:-n]), "ip": tail[0], "date": tail[1], "kind": tail[2],
           "length": int(tail[-1])}
    if version == 2:
        out |= {"status": tail[3], "checksum": tail[4]}
    return out


def _read_exactly(f, n: int) -> bytes:
    parts = []
    while n:
        got = f.read(min(n, CHUNK))
        if not got:
            break
        parts.append(got)
        n -= len(got)
    return b"".join(parts)


def arc_records(path: str):
    """(position, version, header, content) of every record; the version
    block first.  A line that is no header is skipped, and reading goes on at
    the next line; a content cut short by the end of the file is dropped."""
    with _open(path) as f:
        version, position = 1, 0
        while line := f.readline():
            if not line.strip():
                continue
            first = line.startswith(b"filedesc://")
            head = None
            for v in ((2, 1) if first else (version,)):
                head = head or parse_header(line, v)
            if head is None:
                continue
            content = _read_exactly(f, head["length"])
            if len(content) < head["length"]:
                return
            if first:
                m = re.match(rb"\s*([12])\b", content)
                version = int(m[1]) if m else 1
            yield position, version, head, content
            position += 1


# --- WARC -----------------------------------------------------------------

def warc_date(date: str) -> str:
    """ISO 8601 of a date of 4 to 14 digits; missing parts are their first."""
    full = date + "00000101000000"[len(date):]
    y, mo, d, h, mi, s = full[:4], full[4:6], full[6:8], full[8:10], full[10:12], full[12:14]
    if not ("01" <= mo <= "12" and "01" <= d <= "31" and h <= "23" and mi <= "59" and s <= "60"):
        return f"{y}-01-01T00:00:00Z"
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def record_id(head: dict, payload_digest: str, item: str) -> str:
    """An identifier that any attempt synthesises again."""
    seed = "\0".join((head["url"], head["date"], head["ip"], payload_digest, item))
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(seed.encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}"


def split_http(head: dict, content: bytes) -> tuple[str, bytes, bytes]:
    """(type, protocol headers with their blank line, payload)."""
    if content.startswith(b"HTTP/"):
        at, width = content.find(b"\r\n\r\n"), 4
        if at < 0:
            at, width = content.find(b"\n\n"), 2
        if at >= 0:
            return "response", content[:at + width], content[at + width:]
    return "resource", b"", content


def _item(http: bytes) -> str:
    m = re.search(rb"(?mi)^" + ITEM.encode() + rb":[ \t]*([^\r\n]*)", http)
    return m[1].decode() if m else ""


def warc_record(kind: str, head: dict, rid: str, block: bytes, payload_digest: str,
                extra: list[tuple[str, str]] = ()) -> bytes:
    http = kind in ("response", "revisit")
    mime = ("application/http; msgtype=response" if http else
            "application/warc-fields" if kind == "warcinfo" else head["kind"])
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"),
              ("WARC-Date", warc_date(head["date"])), ("Content-Type", mime),
              ("Content-Length", str(len(block)))]
    if kind != "warcinfo":
        fields += [("WARC-Target-URI", head["url"]),
                   ("WARC-Payload-Digest", f"sha256:{payload_digest}")]
        if head["ip"] != "0.0.0.0":
            fields.append(("WARC-IP-Address", head["ip"]))
    fields.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, *extra]) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def warc_records(path: str):
    """(headers with lower-case names, block) of every record of a WARC file."""
    with _open(path) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record starts with {line[:40]!r}")
            headers = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
                headers[k.strip().lower()] = v.strip()
            block = _read_exactly(f, int(headers["content-length"]))
            yield headers, block


# --- jobs -----------------------------------------------------------------

def _manifest(path: str, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})


def write_arc(df: DataFrame, item_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", date: str = "20200101000000") -> DataFrame:
    """Legacy archives of the pages, one file per task, versions 1 and 2 in
    turn; returns the manifest (path, records).  The content is an HTTP
    response whose header carries the item's id.  Null html is an empty
    payload, a null url is written as "-", a null id leaves its header out."""
    folder = run_path(df.sparkSession, "arc")
    rows = df.select(F.col(item_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col))

    def write(batches):
        from pyspark import TaskContext

        part, out, n, at = TaskContext.get().partitionId(), None, 0, 0
        version, name = 1 + part % 2, f"pages-{part:06d}.arc.gz"
        path = f"{folder}/{uuid.uuid4().hex}-{name}"
        for batch in batches:
            for item, url, html in zip(*(batch.column(i) for i in range(3))):
                if out is None:
                    out = _create(path)
                    data = _member(arc_version_block(version, name, date))
                    out.write(data)
                    at = len(data)
                body = (html.as_py() or "").encode("utf-8", "surrogatepass")
                tag = "" if item.as_py() is None else f"{ITEM}: {item.as_py()}\r\n"
                content = (f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                           f"Content-Length: {len(body)}\r\n{tag}\r\n").encode() + body
                line = arc_header(version, url.as_py() or "-", "0.0.0.0", date, "text/html", content,
                                  offset=at, filename=name)
                data = _member(line + content + b"\n")
                out.write(data)
                at, n = at + len(data), n + 1
        if out is not None:
            out.close()
            yield _manifest(path, n)

    return save(rows.mapInArrow(write, "path string, records long"), "arc-files")


def arc_index(files: DataFrame) -> DataFrame:
    """Per content record: path, position, item, rid, digest, bytes, kind."""
    schema = "path string, position long, item long, rid string, digest string, bytes long, kind string"

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for position, _, head, content in arc_records(path):
                    if head["url"].startswith("filedesc://"):
                        continue
                    kind, http, payload = split_http(head, content)
                    digest, item = hashlib.sha256(payload).hexdigest(), _item(http)
                    rows.append({"path": path, "position": position,
                                 "item": int(item) if item.lstrip("-").isdigit() else None,
                                 "rid": record_id(head, digest, item), "digest": digest,
                                 "bytes": len(payload), "kind": kind})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([("path", pa.string()), ("position", pa.int64()), ("item", pa.int64()),
                       ("rid", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()),
                       ("kind", pa.string())])
    return one_each(files, "path").mapInArrow(read, schema)


def convert_arc(files: DataFrame, least: int = 100) -> DataFrame:
    """Convert ARC files to WARC files; returns the manifest (path, records).

    The version block becomes a warcinfo record, an HTTP content a response,
    any other a resource.  Of responses with equal payloads (SHA-256) of at least
    ``least`` bytes the one with the smallest item (null last; then the smallest record
    id) keeps its payload; the others become revisit records that name it.
    Decisions per file go to the task that converts it as rows sorted by
    position; each file is streamed, so one record is in memory at a time.
    Files of attempts that were lost are not in the manifest.
    """
    spark = files.sparkSession
    index = save(arc_index(files), "arc-index")
    first = index.where((F.col("kind") == "response") & (F.col("bytes") >= least)).groupBy("digest").agg(
        F.min(F.struct(F.col("item").isNull().alias("none"), "item", "rid")).alias("best"),
        F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("best.rid").alias("origin"))
    rows = index.where((F.col("kind") == "response") & (F.col("bytes") >= least)).select(
        "path", "position", "rid", "digest")
    hits = join_salted(rows, first, "digest", ["rid"], "inner").where("rid <> origin").select(
        "path", "position", "origin")
    # a converting task reads its file's name from a marker row and then its revisits
    marks = files.select("path", F.lit(-1).cast("bigint").alias("position"), F.lit(None).cast("string").alias("origin"))
    jobs = marks.unionByName(hits).repartition(max(1, files.count()), "path").sortWithinPartitions("path", "position")
    folder = run_path(spark, "warc")

    def convert(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        todo, held = rows(), None
        held = next(todo, None)
        while held is not None:
            source = held[0]
            held = next(todo, None)
            path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
            out = _create(path)
            for position, version, head, content in arc_records(source):
                if head["url"].startswith("filedesc://"):
                    name = head["url"].removeprefix("filedesc://").rsplit("/", 1)[-1]
                    block = f"software: adlens\r\nisPartOf: {name}\r\nformat: ARC/{version}\r\n".encode()
                    digest = hashlib.sha256(block).hexdigest()
                    data = warc_record("warcinfo", head, record_id(head, digest, ""), block, digest)
                else:
                    kind, http, payload = split_http(head, content)
                    digest = hashlib.sha256(payload).hexdigest()
                    rid = record_id(head, digest, _item(http))
                    extra, block = [], content
                    if held is not None and held[0] == source and held[1] == position:
                        kind, block = "revisit", http
                        extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                 ("WARC-Refers-To", f"<{held[2]}>"), (LENGTH, str(len(payload)))]
                        held = next(todo, None)
                    data = warc_record(kind, head, rid, block, digest, extra)
                out.write(_member(data))
                n += 1
            out.close()
            while held is not None and held[0] == source:
                held = next(todo, None)
            yield _manifest(path, n)

    return save(jobs.mapInArrow(convert, "path string, records long"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """Per response, resource or revisit record of the files: item, rid,
    record_type, payload_bytes, payload_digest (bare), refers_rid.

    The digest of a record with its payload is computed from the payload and
    must equal the header's; a revisit has the full payload's digest and
    length in its header."""
    schema = ("item long, rid string, record_type string, payload_bytes long, payload_digest string, "
              "refers_rid string")
    kinds = pa.schema([("item", pa.int64()), ("rid", pa.string()), ("record_type", pa.string()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("refers_rid", pa.string())])

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for h, block in warc_records(path):
                    kind = h["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http = block if kind == "revisit" else split_http({}, block)[1] if kind == "response" else b""
                    stated, item = h["warc-payload-digest"].removeprefix("sha256:"), _item(http)
                    if kind == "revisit":
                        size = int(h[LENGTH.lower()])
                    else:
                        payload = block[len(http):]
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != stated:
                            raise ValueError(f"{path}: payload of {h['warc-record-id']} differs from its digest")
                    rows.append({"item": int(item) if item.lstrip("-").isdigit() else None,
                                 "rid": h["warc-record-id"].strip("<>"), "record_type": kind,
                                 "payload_bytes": size, "payload_digest": stated,
                                 "refers_rid": h.get("warc-refers-to", "").strip("<>") or None})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return one_each(files, "path").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, item_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", least: int = 100) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; null ids and urls are allowed (see
    ``write_arc``); repeated rows are records of their own, and since equal
    rows get equal record ids, they count as the same record.  An empty table
    gives no file and no row.  Other columns are ignored.
    """
    records = save(read_warc(convert_arc(write_arc(pages, item_col, url_col, html_col), least)), "warc-records")
    origin = records.where("record_type <> 'revisit'").join(
        records.where("refers_rid is not null").select(F.col("refers_rid").alias("rid")).distinct(), "rid",
        "left_semi").groupBy("rid").agg(F.min("item").alias("refers_to"))
    rows = records.withColumnRenamed("rid", "own").withColumnRenamed("refers_rid", "rid")
    with_origin = join_salted(rows.where("rid is not null"), origin, "rid", ["own"], "left")
    out = with_origin.unionByName(rows.where("rid is null").withColumn("refers_to", F.lit(None).cast("bigint")))
    return out.select(F.col("item").alias(item_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
