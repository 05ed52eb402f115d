"""WARC archives: a writer with revisit records, and a sequential reader.

Each record is one gzip member. The reader takes an archive as a stream, inflates member by member with zlib, cuts the
record by its Content-Length and verifies both digests while the bytes pass, so it never holds more than one record.

Archives are written by the tasks to the shared folder, under names that no other attempt uses; a table says
which archives belong to the result, so what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .queries import Query
from .workspace import Workspace, small

#: A new archive is begun after so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Payloads from so many bytes on are stored once.
REVISIT_BYTES = 1000
READ_BYTES = 1 << 18

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page"

_READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def name_of(page_id: str | None) -> str:
    """The name of a page's record: the id in ASCII, all signs escaped. Without an id it has no colon, so "" is another one."""
    return NAME if page_id is None else f"{NAME}:{quote(page_id, safe='')}"


def id_of(name: str) -> str | None:
    """The page_id in a record's name."""
    return unquote(name[len(NAME) + 1:]) if name.startswith(NAME + ":") else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """A gzip member with a response record, or a revisit record if another page's id is given.

    A url is written on one line, with control characters escaped; without one the record's name stands for it.
    """
    name = f"<{name_of(page_id)}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_clean(url or name_of(page_id))}", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name_of(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(chunks: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated bytes of each gzip member. Each iterator must be used up before the next one is taken."""
    rest = b""

    def inflate() -> Iterator[bytes]:
        nonlocal rest
        z = zlib.decompressobj(31)
        while not z.eof:
            data = rest or next(chunks, b"")
            if not data:
                raise ValueError("the archive ends inside a record")
            rest = b""
            yield z.decompress(data)
            rest = z.unused_data

    while True:
        rest = rest or next(chunks, b"")
        if not rest:
            return
        yield inflate()


def parse_head(head: bytes, first: bytes) -> dict[str, str]:
    line, *lines = head.decode("utf-8").split("\r\n")
    if not line.startswith(first.decode()):
        raise ValueError(f"not a {first.decode()} header: {line[:80]!r}")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if x)}


def read_record(parts: Iterator[bytes], keep_payload: bool = False) -> dict:
    """One record from its inflated bytes. Lengths and digests that do not fit raise ValueError."""
    def upto(buffer: bytes) -> tuple[bytes, bytes]:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            more = next(parts, None)
            if more is None:
                raise ValueError("a header without an end")
            buffer += more
        return buffer[:end], buffer[end + 4:]

    head, buffer = upto(b"")
    fields = parse_head(head, b"WARC/")
    left = int(fields["content-length"])
    block, payload, size, kept, http = hashlib.sha1(), hashlib.sha1(), 0, [], b""
    in_payload = False
    while True:
        piece, buffer = buffer[:left], buffer[left:]
        left -= len(piece)
        block.update(piece)
        if not in_payload:
            http += piece
            if (end := http.find(b"\r\n\r\n")) >= 0:
                http, piece, in_payload = http[:end], http[end + 4:], True
        if in_payload:
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        if not left:
            break
        buffer = next(parts, None)
        if buffer is None:
            raise ValueError("a record shorter than its Content-Length")
    for more in parts:
        buffer += more
    if buffer != b"\r\n\r\n":
        raise ValueError("a record longer than its Content-Length")
    length = int(parse_head(http, b"HTTP/")["content-length"])
    name = fields["warc-record-id"]
    if "sha1:" + base64.b32encode(block.digest()).decode() != fields["warc-block-digest"]:
        raise ValueError(f"{name}: the block does not have its digest")
    if fields["warc-type"] == "response" and (size != length or "sha1:" + base64.b32encode(payload.digest()).decode() != fields["warc-payload-digest"]):
        raise ValueError(f"{name}: the payload does not have its digest or length")
    page_id, other = (id_of(x[1:-1]) if x else None for x in (name, fields.get("warc-refers-to")))
    found = {"page_id": page_id, "payload_bytes": length, "record_type": fields["warc-type"], "refers_to": other,
             "payload_digest": base64.b32decode(fields["warc-payload-digest"][5:]).hex(), "url": fields["warc-target-uri"]}
    return found | ({"payload": b"".join(kept)} if keep_payload else {})


def read_archive(stream, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an open archive, in their order."""
    for member in members(iter(lambda: stream.read(READ_BYTES), b"")):
        yield read_record(member, keep_payload)


def plan_records(pages: DataFrame, space: Workspace, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: of equal payloads that are long enough, the one with the largest page_id is
    stored and the others refer to it. Only digests and ids are grouped."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    sized = pages.withColumns({"digest": F.sha1(payload), "size": F.octet_length(payload)})
    groups = sized.where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = space.keep(groups.where("n > 1 and top is not null").drop("n"))
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return sized.join(small(groups), ["digest", "size"], "left").select("page_id", "url", "html", F.when(again, F.col("top")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of (page_id, url, html, refers_to) and return (path, records, bytes), one row per archive."""
    texts = planned.select(*(F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html", "refers_to")))

    def work(batches):
        where, root = fs.FileSystem.from_uri(folder)
        out, path, records, size, done = None, "", 0, 0, []
        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        where.create_dir(root, recursive=True)
                        out, path, records, size = where.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                    data = record(page_id, url, (html or "").encode("utf-8"), refers_to)
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        done.append((path, records, size))
            if out is not None:
                out.close()
                done.append((path, records, size))
        finally:
            if out is not None and not out.closed:
                out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    return texts.mapInArrow(work, "path string, records long, bytes long")


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives named in (path); archives are read in parallel, each from its start to its end."""
    n = max(1, archives.count())

    def work(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for found in read_archive(stream, keep_payload):
                        rows.append(found)
                        held += len(found.get("payload", b"")) + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.string()), ("url", pa.string())]
    schema = pa.schema(kinds + [("payload", pa.binary())] * keep_payload)
    return archives.select("path").repartition(n).mapInArrow(work, _READ + ", payload binary" * keep_payload)


def archive_round_trip(pages: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and read the archives back.

    Null html is an empty payload, a null url becomes a name made of the page_id. Rows that share the largest page_id of equal
    payloads are all stored; so are all rows of a group without any page_id. Rows that share a page_id share the name of their records.
    An id of text comes back as it was, empty or with line breaks; a url on one line, see ``record``. Other columns are not written. An empty
    table writes no archive and gives no rows.
    """
    space = Workspace(pages.sparkSession, "warc")
    kind = dict(pages.dtypes)["page_id"]
    pages = pages.select("page_id", "url", "html")
    archives = space.keep(write_archives(plan_records(pages, space), f"{space.folder}/archives"))
    found = read_archives(archives, keep_payload)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


OP2_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) digest from pages),
t as (select *, max(page_id) over (partition by digest, n) top from p)
select page_id, n payload_bytes, digest payload_digest, case when n >= 1000 and page_id <> top then 'revisit' else 'response' end record_type,
       case when n >= 1000 and page_id <> top then top end refers_to
from t
"""

QUERIES = {"op2_warc": Query(op2_warc, OP2_SQL)}
