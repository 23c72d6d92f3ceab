"""WARC archives with one Zstandard dictionary each.

Every task writes archives of bounded size. It gathers the records of one archive, trains a dictionary on them, puts it
in a leading skippable frame (magic 0x184D2A5D) and compresses each record as a frame of its own, so that a reader can
start at any record. Pages with equal payloads get one response record, the others revisit it.

Archives go to a folder that all executors share, through Arrow's file systems (any URI these open). Names carry the
task attempt, and only archives that a finished task reported are read back: lost executors and retried tasks leave
nothing behind that is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, pick, remove, shared_dir, small_batches

SKIPPABLE_MAGIC = 0x184D2A5D
#: Uncompressed bytes of records after which an archive is closed; bytes of records that train a dictionary, and its size.
ARCHIVE_BYTES, TRAIN_BYTES, DICT_BYTES = 16 << 20, 2 << 20, 32 << 10
#: Long records are sampled in pieces of so many bytes.
PIECE_BYTES = 16 << 10
LEVEL, DATE = 3, "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header alone, with the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F)))))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{b32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers by lower-case name, the stored payload, and the length of the full one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, length


def train(records: list[bytes]):
    """A dictionary from pieces of records, spread evenly over all of them, TRAIN_BYTES in all at most; the pieces themselves
    as raw content where there are too few to train."""
    import zstandard

    every = max(1, -(-sum(map(len, records)) // TRAIN_BYTES))  # one piece of so many
    pieces = (r[lo : lo + PIECE_BYTES] for r in records for lo in range(0, max(1, len(r)), PIECE_BYTES))
    some = [p for i, p in enumerate(pieces) if i % every == 0]
    size = sum(map(len, some))
    if len(some) >= 16:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 16)), some, k=256, d=8, f=18, accel=4, level=LEVEL)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(some)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive: the dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    d = train(records)
    raw = d.as_bytes()
    z = zstandard.ZstdCompressor(level=LEVEL, dict_data=d)
    return b"".join([SKIPPABLE_MAGIC.to_bytes(4, "little"), len(raw).to_bytes(4, "little"), raw, *map(z.compress, records)])


def read_archive(stream) -> Iterator[bytes]:
    """The records of an open archive, one at a time; memory holds a chunk and a record."""
    import zstandard

    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(int.from_bytes(head[4:8], "little"))))
    data = stream.read(1 << 20)
    while data:
        d, out = z.decompressobj(), []
        while not d.eof:
            if not data:
                raise ValueError("an archive ends inside a record")
            out.append(d.decompress(data))
            data = d.unused_data if d.eof else stream.read(1 << 20)
        yield b"".join(out)
        data = data or stream.read(1 << 20)


def with_types(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to. Digests alone are grouped; the pages join their digest's smallest page_id."""
    d = df.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    firsts = cut(d.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    refers = F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return join_counted(d, firsts, "digest", "n", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row into archives under `folder` (a URI that executors and driver share); returns one row
    per archive: path, records, bytes, raw_bytes.

    Null html is an empty payload; null urls have no target header; characters that a header can't hold are percent-encoded
    in the others, and are read back so. Among equal payloads of at least min_bytes that with
    the smallest id is the response; rows that repeat its id and payload are responses too, null ids revisit it (all are
    responses where every id is null). Empty tables write nothing. Further columns are not read.
    """
    small_batches(df.sparkSession)
    d = with_types(pick(df, {"page_id": id_col, "url": url_col, "html": html_col}, {"url": "string", "html": "string"}), min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        t = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = n = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, n
            name = f"part-{t.partitionId():06d}-{t.taskAttemptId()}-{n:06d}.warc.zst"
            raw = archive(held)
            with files.open_output_stream(f"{base}/{name}") as f:
                f.write(raw)
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(raw)], pa.int64()), "raw_bytes": pa.array([size], pa.int64())})
            held, size, n = [], 0, n + 1
            return row

        for b in batches:
            for page, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page, url, html.encode(), first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    return cut(d.mapInArrow(run, "path string, records bigint, bytes bigint, raw_bytes bigint"))


def read_archives(archives: DataFrame, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """The records of the archives listed in column path: page_id, url, record_type, refers_to, payload_bytes and
    payload_digest (both of the full payload), and, if asked, payload (null for revisits). Stored payloads are checked
    against their digests."""
    spark = archives.sparkSession
    small_batches(spark)
    ddl = f"page_id {id_type}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}" + ", payload binary" * payloads
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    schema = pa.schema([pa.field(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                with files.open_input_stream(at) as stream:
                    for raw in read_archive(stream):
                        f, payload, length = parse(raw)
                        digest, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
                        if kind == "response" and (len(payload) != length or b32_sha1(payload) != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        rows.append((f.get("x-page-id"), f.get("warc-target-uri"), length, digest, kind, f.get("x-refers-to-page-id"), *[payload if kind == "response" else None] * payloads))
                        size += len(payload) if payloads else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = archives.select("path").repartition(parts).mapInArrow(run, ddl.replace(f"page_id {id_type}", "page_id string").replace(f"refers_to {id_type}", "refers_to string"))
    return text.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive_folder(df: DataFrame) -> str:
    """A fresh folder for archives under the shared one."""
    return f"{shared_dir(df.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"


def round_trip(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, then read back without payloads; what was read is kept by a checkpoint, and the archives go."""
    folder = archive_folder(df)
    out = cut(read_archives(write_archives(df, folder, min_bytes=min_bytes), df.schema["page_id"].dataType.simpleString(), payloads=False))
    remove(df.sparkSession, folder)
    return out


def oracle_sql() -> str:
    """The contract for DuckDB; base 32 by hand, four digits from five of hexadecimal."""
    value = " + ".join(f"(instr('0123456789abcdef', substr(sha1(h), 5 * j + {k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
    digits = "concat(" + ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> {shift}) & 31 as integer) + 1, 1)" for shift in (15, 10, 5, 0)) + ")"
    return f"""
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first from p group by h),
d as (select h, string_agg({digits}, '' order by j) as digest from (select h, j, cast({value} as bigint) as v from f, range(8) as r(j)) x group by h)
select page_id, cast(strlen(h) as bigint) as payload_bytes, digest as payload_digest, case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from p join f using (h) join d using (h)
"""
