"""WARC archives: a writer of whole-file gzip streams, a normaliser to one member a record, and a reader by offsets.

Archives that were compressed as one stream cannot be entered in the middle.  The
normaliser inflates such a stream once, in bounded pieces, finds the records by
their Content-Length, writes every record as a gzip member of its own and a sidecar
index (JSON lines: record id, type, offset, length).  Readers then take a record by
a seek to its offset.

Files go through ``pyarrow.fs`` below ``spark.checkpoint.dir``: written under a name
of the attempt's own, moved to their final name when complete, and known to later
steps only from the written manifest, so retried and lost tasks leave at most unread
files.

Defined results: a null html is an empty payload; among equal payloads of at least
``min_bytes`` the smallest page_id is the response (a null id only if all are null,
and one row where an id repeats); a null url is written as ``urn:none``.  Extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 18
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"


def open_fs(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, url: str, sha1: str, size: int, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit has the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'urn:none').split())}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def inflate(source) -> Iterator[bytes]:
    """Records of a gzip file, of one member or many, inflated once in bounded pieces."""
    unzip, held, need = zlib.decompressobj(31), bytearray(), 0
    while raw := source.read(PIECE):
        while raw:
            held += unzip.decompress(raw)
            raw = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            while len(held) >= max(need, 1):
                if not need:
                    end = held.find(b"\r\n\r\n")
                    if end < 0:
                        break
                    lines = bytes(held[:end]).lower().split(b"\r\n")
                    need = end + 4 + next(int(x.split(b":", 1)[1]) for x in lines if x.startswith(b"content-length:")) + 4
                    continue
                yield bytes(held[:need])
                del held[:need]
                need = 0
    if held or need:
        raise ValueError("the archive ends inside a record")


class Output:
    """A file under a temporary name until ``close``."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.fs, path = open_fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.path, self.final, self.size = f"{path}/.{self.name}.tmp", f"{path}/{self.name}", 0
        self.file = self.fs.open_output_stream(self.path, compression=None)

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.file.close()
        self.fs.move(self.path, self.final)
        return self.name


def write_monolithic(folder: str, limit: int = ARCHIVE_BYTES) -> Callable:
    """Rows (name, url, sha1, html, kind, refers_to) to archives of about ``limit`` inflated bytes, one gzip stream each."""

    def run(batches):
        out, zipper, n, size = None, None, 0, 0

        def end():
            out.write(zipper.flush())
            return pa.RecordBatch.from_pydict({"archive": [out.close()], "records": pa.array([n], pa.int64())})

        for batch in batches:
            columns = [batch.column(c) for c in ("name", "url", "sha1", "kind", "refers_to")]
            html = batch.column("html").cast(pa.large_binary() if pa.types.is_large_string(batch.column("html").type) else pa.binary())
            for i in range(batch.num_rows):
                if out is None:
                    out, zipper, n, size = Output(folder, ".warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                name, url, _, kind, to = (c[i].as_py() for c in columns)
                payload = html[i].as_py() or b""
                raw = record(kind, name, url, digest(payload), len(payload), payload, to)
                out.write(zipper.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= limit:
                    yield end()
                    out = None
        if out is not None:
            yield end()

    return run


def normalise(folder: str, target: str) -> Callable:
    """Archives of any gzip layout to one member a record, with a sidecar index; returns the index files' names."""

    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, path = open_fs(folder)
                out, index, n = Output(target, ".warc.gz"), [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for raw in inflate(source):
                        zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = zipper.compress(raw) + zipper.flush()
                        head = parse_head(raw)
                        index.append(json.dumps({"id": head["warc-record-id"], "type": head["warc-type"], "offset": out.size, "length": len(member)}))
                        out.write(member)
                        n += 1
                archive = out.close()
                sidecar = Output(target, ".warc.gz.idx")
                sidecar.write("\n".join(index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [archive], "sidecar": [sidecar.close()], "records": pa.array([n], pa.int64())})

    return run


def parse_head(raw: bytes) -> dict[str, str]:
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in raw[: raw.find(b"\r\n\r\n")].decode().split("\r\n")[1:])}


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The record at an offset of a normalised archive."""
    file.seek(offset)
    return parse(zlib.decompress(file.read(length), 31))


def read_back(folder: str) -> Callable:
    """Every record that the sidecars name, by its offset; a response's digest is computed anew and compared."""

    def run(batches):
        for batch in batches:
            fs, path = open_fs(folder)
            for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{sidecar}") as f:
                    index = [json.loads(x) for x in f.read().decode().split("\n") if x]
                rows: list[tuple] = []
                with fs.open_input_file(f"{path}/{archive}") as file:
                    for entry in index:
                        head, block = read_member(file, entry["offset"], entry["length"])
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        sha1 = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (len(payload) != size or digest(payload) != sha1):
                            raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                        page = head["warc-record-id"].strip("<>").split(":")[2]
                        to = head.get("warc-refers-to")
                        to = to.strip("<>").split(":")[2] if to else "null"
                        rows.append((None if page == "null" else int(page), size, sha1, head["warc-type"], None if to == "null" else int(to)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def round_trip(pages: DataFrame, min_bytes: int = 0, keep_raw: bool = False) -> DataFrame:
    """Write, normalise and read back a record for each page."""
    spark = pages.sparkSession
    folder = C.shared_dir(spark)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("row", F.monotonically_increasing_id()).withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    base = C.scratch(base, "pages")
    # the response of a payload: smallest id, then first row; digests meet here, and payloads only go to their row
    digests = base.where(F.col("size") >= min_bytes).select("row", "page_id", "sha1")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("row").alias("row"))
    first = C.summed(digests, ["sha1"], F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    again = C.scratch(digests.join(first, "sha1").where(F.col("row") != F.col("first.row")).select("row", "first"), "revisits")
    name = lambda page, row: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"))
    rows = base.join(again, "row", "left").select(
        name(F.col("page_id"), F.col("row")).alias("name"), "url", "sha1", "html",
        F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("kind"),
        F.when(F.col("first").isNotNull(), name(F.col("first.page"), F.col("first.row"))).alias("refers_to"),
    )
    raw = C.scratch(rows.mapInArrow(write_monolithic(f"{folder}/raw"), "archive string, records long"), "raw")
    n = max(1, min(raw.count(), spark.sparkContext.defaultParallelism * 4))
    done = C.scratch(raw.select("archive").repartition(n).mapInArrow(normalise(f"{folder}/raw", f"{folder}/warc"), "archive string, sidecar string, records long"), "warc")
    if not keep_raw:
        fs, path = open_fs(f"{folder}/raw")
        if fs.get_file_info(path).type != 0 and raw.count():
            fs.delete_dir(path)
    return done.repartition(n).mapInArrow(read_back(f"{folder}/warc"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_BASE32 = "".join(
    f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31 AS INT), 1)" for g in range(8) for s in (15, 10, 5, 0)
)
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, ''{_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
