"""Legacy ARC archives to WARC: header lines by version, declared lengths, synthesised WARC fields.

An ARC file begins with a version block whose first line names the file and whose next
lines give the version and the names of the header's fields; every record is a header line
with those fields, whose last is the length of the content that follows.  The converter
reads each header by the version of its file and takes exactly the declared bytes.  A WARC
record's identifier is a name-based UUID of the ARC file's name and the record's offset, its
date the ARC date, its type follows from the URL, and its digests from the content.

Records with equal payloads of at least ``LEAST_BYTES`` bytes are stored once: the one with
the smallest page id is a response, the others are revisits that refer to it.

Files are gzip members, one a record, and are streamed: a task holds one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import filesystem, fresh_dir, remove_dir, store

LEAST_BYTES = 100
CHUNK = 1 << 20
LEVEL = 1
#: The header fields of the two ARC versions, fixed by the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code",
        "Checksum", "Location", "Offset", "Filename", "Archive-length",
    ],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Namespace of the synthesised record identifiers.
NAMESPACE = uuid.UUID("6f1d3c52-5d0a-5a0e-9c1f-2f6a3f0b7c11")


# -- ARC --------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    version: int
    offset: int
    fields: dict[str, str]
    content: bytes


def member(raw: bytes) -> bytes:
    """One gzip member; equal bytes give equal members."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a stream."""
    at, held = 0, b""
    while True:
        unpack, out, start = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if not held:
                held = stream.read(CHUNK)
                if not held:
                    if out or at != start:
                        raise ValueError("the archive ends within a member")
                    return
            size = len(held)
            out.append(unpack.decompress(held))
            held = unpack.unused_data
            at += size - len(held)
        yield start, b"".join(out)


def arc_line(version: int, fields: dict[str, str]) -> bytes:
    """A header line: the version's fields, none of which but the URL may hold a space."""
    values = [fields.get(k) or "-" for k in ARC_FIELDS[version]]
    values = [re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), v) for v in values]
    return " ".join(values).encode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 Origin\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    return arc_line(version, head | {"Result-code": "200", "Filename": name, "Archive-length": str(len(body))}) + b"\n" + body


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of a gzipped ARC file after its version block."""
    version = 0
    for offset, raw in members(stream):
        line, _, rest = raw.lstrip(b"\n").partition(b"\n")
        text = line.decode("utf-8", "replace")
        if not version:
            version = int(rest.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            continue
        names = ARC_FIELDS[version]
        # the URL is what stands before the last fields, spaces included
        values = text.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC {version} header: {text[:200]!r}")
        fields = dict(zip(names, values))
        length = int(fields["Archive-length"])
        if len(rest) < length:
            raise ValueError(f"an ARC record declares {length} bytes and has {len(rest)}")
        yield ArcRecord(version, offset, fields, rest[:length])


# -- WARC -------------------------------------------------------------------------------------


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message; what has no head is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    at, mark = min(((i, m) for m in (b"\r\n\r\n", b"\n\n") if (i := content.find(m)) >= 0), default=(-1, b""))
    return (content, b"") if at < 0 else (content[: at + len(mark)], content[at + len(mark) :])


def header_value(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def page_of(head: bytes) -> int | None:
    value = header_value(head, b"X-Page-Id")
    return int(value) if value and value.lstrip("-").isdigit() else None


def record_id(arc_name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{arc_name}#{offset}')}>"


def warc_date(arc_date: str) -> str:
    """An ARC date (yyyymmddhhmmss, or a beginning of it) as a WARC date."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    digits += "00000101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(record: ArcRecord, arc_name: str, refers: tuple[int | None, str, int] | None) -> bytes:
    """The WARC record of an ARC record; ``refers`` is the (page, ARC name, offset) it revisits."""
    head, payload = split_http(record.content)
    url, block = record.fields["URL"], record.content
    if refers:
        kind, block = "revisit", head
    else:
        kind = "response" if head or url.startswith(("http://", "https://")) else "resource"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(arc_name, record.offset)),
        ("WARC-Date", warc_date(record.fields["Archive-date"])),
        ("WARC-Target-URI", url),
    ]
    if re.fullmatch(r"[\d.]+|[\da-fA-F:]+", record.fields["IP-address"]):
        headers.append(("WARC-IP-Address", record.fields["IP-address"]))
    headers += [
        ("Content-Type", "application/http; msgtype=response" if head else record.fields["Content-type"]),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if refers:
        page, name, offset = refers
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(name, offset))]
        if page is not None:
            headers.append(("X-Refers-To-Page", str(page)))
    return warc_record(headers, block)


def warcinfo(arc_name: str, version: int) -> bytes:
    body = f"software: graphloom\r\nformat: WARC File Format 1.0\r\nconverted-from: {arc_name} (ARC {version})\r\n".encode()
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(arc_name, -1)), ("Content-Type", "application/warc-fields")], body)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a gzipped WARC file."""
    for _, raw in members(stream):
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        length = int(headers["Content-Length"])
        if len(rest) < length:
            raise ValueError("a WARC record is cut short")
        yield headers, rest[:length]


# -- plans ------------------------------------------------------------------------------------


def _opened(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_stream(path, compression=None)


def _base(uri: str) -> str:
    return uri.rsplit("/", 1)[1]


def _one_each(files: DataFrame, name: str) -> DataFrame:
    """``files`` in ranges of their names, a task each; a hash of the names would give some tasks several and others none."""
    return files.repartitionByRange(max(1, files.count()), name)


def write_arcs(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One gzipped ARC file for each partition, versions 1 and 2 in turn; (arc, records) of each.

    The payload is the html in UTF-8, empty for null; the page id travels in the HTTP head.
    """
    date = "20240101000000"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, uri = 1 + part % 2, f"{out_dir}/pages-{part:06d}.arc.gz"
        done = [0]

        def fill(out) -> None:
            out.write(member(arc_version_block(version, _base(uri), date)))
            for batch in batches:
                for page, url, html in zip(*(batch.column(k) for k in range(3))):
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    if page.is_valid:
                        head += b"X-Page-Id: %d\r\n" % page.as_py()
                    content = head + b"\r\n" + (html.as_buffer().to_pybytes() if html.is_valid else b"")
                    fields = {
                        "URL": url.as_py(), "IP-address": "192.0.2.1", "Archive-date": date, "Content-type": "text/html",
                        "Result-code": "200", "Filename": _base(uri), "Archive-length": str(len(content)),
                    }
                    out.write(member(arc_line(version, fields) + b"\n" + content + b"\n"))
                    done[0] += 1

        store(uri, fill)
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([done[0]])], ["arc", "records"])

    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return cut(source.mapInArrow(run, "arc string, records long"))


def index_arcs(arcs: DataFrame) -> DataFrame:
    """(arc, offset, page, digest, bytes) of every record in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["arc", "offset", "page", "digest", "bytes"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for uri in batch.column("arc").to_pylist():
                rows = []
                with _opened(uri) as stream:
                    for r in read_arc(stream):
                        head, payload = split_http(r.content)
                        rows.append((uri, r.offset, page_of(head), hashlib.sha256(payload).hexdigest(), len(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    dealt = _one_each(arcs, "arc")
    return dealt.mapInArrow(run, "arc string, offset long, page long, digest string, bytes long")


def revisits(index: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``index`` with (to_page, to_arc, to_offset) of the record that each revisit refers to, else null.

    The first of equal payloads is taken by page id, nulls last, then by file and offset; the
    minimum is aggregated before the shuffle and joined to its digest's records.
    """
    rank = F.struct(F.col("page").isNull().alias("none"), F.col("page").alias("to_page"), F.col("arc").alias("to_arc"), F.col("offset").alias("to_offset"))
    firsts = (
        index.where(F.col("bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first.to_page", "first.to_arc", "first.to_offset")
    )
    joined = index.join(firsts, "digest", "left")
    itself = (F.col("arc") == F.col("to_arc")) & (F.col("offset") == F.col("to_offset"))
    keep = F.col("to_arc").isNotNull() & ~itself
    return joined.select("arc", "offset", *[F.when(keep, F.col(c)).alias(c) for c in ("to_page", "to_arc", "to_offset")])


def convert_arcs(plan: DataFrame, out_dir: str, archives: int) -> DataFrame:
    """Converts each of so many ARC files by its records' plan, streaming, a task each; (warc) of each file written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(5))))
        row = next(rows, None)
        while row is not None:
            source = row[0]
            name = _base(source)
            uri = f"{out_dir}/{name.removesuffix('.arc.gz')}.warc.gz"

            def fill(out, source=source, name=name) -> None:
                nonlocal row
                first = True
                with _opened(source) as stream:
                    for record in read_arc(stream):
                        if first:
                            out.write(member(warcinfo(name, record.version)))
                            first = False
                        if row is None or row[:2] != (source, record.offset):
                            raise ValueError(f"{source} has a record at {record.offset} that was not indexed")
                        refers = (row[2], _base(row[3]), row[4]) if row[3] else None
                        out.write(member(convert(record, name, refers)))
                        row = next(rows, None)

            store(uri, fill)
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["warc"])

    dealt = plan.select("arc", "offset", "to_page", "to_arc", "to_offset")
    dealt = dealt.repartitionByRange(max(1, archives), "arc").sortWithinPartitions("arc", "offset")
    return cut(dealt.mapInArrow(run, "warc string"))


def read_warcs(warcs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date, record_id) of each page record.

    A response's payload is measured and digested anew; a mismatch with its header is an error.
    """
    names = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date", "record_id"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("warc").to_pylist():
                rows = []
                with _opened(uri) as stream:
                    for h, block in read_warc(stream):
                        kind = h["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Bytes"])
                        if kind != "revisit" and (digest, size) != (hashlib.sha256(payload).hexdigest(), len(payload)):
                            raise ValueError(f"{uri}: a payload differs from its digest")
                        to = h.get("X-Refers-To-Page")
                        rows.append((page_of(head), size, digest, kind, int(to) if to else None, h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Record-ID"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string"
    return _one_each(warcs, "warc").mapInArrow(run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What the WARC files hold that ``pages`` become by way of ARC files; all files are removed.

    A null html is an empty payload; a null url is written as ``-``; a null page id stays null
    and is last in choosing a response.  Repeated rows are records of their own: the first is
    the response, the rest revisit it.  Other columns are not looked at.
    """
    spark = pages.sparkSession
    arc_dir, warc_dir = fresh_dir(spark, "arc"), fresh_dir(spark, "warc")
    arcs = write_arcs(pages, arc_dir, id_col, url_col, html_col)
    warcs = convert_arcs(revisits(cut(index_arcs(arcs))), warc_dir, arcs.count())
    remove_dir(spark, arc_dir)
    found = cut(read_warcs(warcs, id_col))
    remove_dir(spark, warc_dir)
    return found
