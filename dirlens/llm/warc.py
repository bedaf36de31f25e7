"""WARC records in ZIP packages: written by Spark tasks, read back by byte ranges without extraction.

Writing: each task fills packages of about `package_bytes`: a stored member of gzip records, one gzip member each, and
a stored index (one line per record: URI, date, JSON with offset and length). Packages get names of their own and go to
the shared folder; only those that a finished task tells of count, so a repeated task leaves no doubles.
Reading: the tail of a package gives its end record (ZIP64 too), that the central directory, that the places of stored
members and indexes. Index entries are dealt out by byte range, so one large package is read by many tasks, and
neighbouring records by one read.

Equal payloads of at least `least` bytes: the one of the smallest page_id is a response, the others revisit it.
Nulls: a null html is an empty payload, a null url an empty URI. A null page_id is carried through and is never the
smallest unless all are null (then all are responses). Rows that share the smallest page_id and its payload are
all responses. Very long pages are records like any other, in memory one at a time. An empty table gives no packages
and no rows. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_dir, stored

DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGE = 4 << 20
TASK_BYTES = 128 << 20
_TAIL = 22 + 65535 + 20 + 56


# ---- records ----

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not yet compressed; a revisit if it refers to another page."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = _HTTP + payload if refers_to is None else _HTTP
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Page": "" if page_id is None else str(page_id)}
    if refers_to is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To-Page": str(refers_to), "WARC-Payload-Length": str(len(payload))}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; of a response also the payload, held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length isn't as told")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": int(fields["WARC-Page"]) if fields["WARC-Page"] else None, "payload_digest": digest, "record_type": fields["WARC-Type"], "url": fields["WARC-Target-URI"], "payload": None, "refers_to": None}
    if out["record_type"] == "revisit":
        return out | {"refers_to": int(fields["WARC-Refers-To-Page"]), "payload_bytes": int(fields["WARC-Payload-Length"])}
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload isn't as its digest")
    return out | {"payload": payload, "payload_bytes": len(payload)}


# ---- packages ----

def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def package(records: list[bytes], index: list[str], name: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(f"archive/{name}.warc.gz", b"".join(records))
        z.writestr(f"indexes/{name}.cdxj", "".join(index))
    return out.getvalue()


def members(read_at, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, header offset, stored size) from the central directory; read_at(n, offset) gives bytes."""
    tail_at = max(0, size - _TAIL)
    tail = read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # else the signature stands in a comment
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        rec = read_at(56, end64)
        if rec[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", rec, 32)
    table, found, p = read_at(length, start), [], 0
    for _ in range(count):
        if table[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a central directory entry is broken")
        flags, method = struct.unpack_from("<HH", table, p + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", table, p + 20)
        (header,) = struct.unpack_from("<I", table, p + 42)
        name = table[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        q, end = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= end:
            kind, n = struct.unpack_from("<HH", table, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", table, q + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + n
        found.append((name, method, header, packed))
        p = end + n_note
    return found


def data_offset(read_at, header: int) -> int:
    """Where a member's bytes begin: its local header has lengths of its own."""
    local = read_at(30, header)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("a local header is broken")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return header + 30 + n_name + n_extra


def entries(read_at, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in the package of every record, from the indexes; of an archive without one, by a walk."""
    found = members(read_at, size)
    for name, method, _, _ in found:
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
    begin = {name: (data_offset(read_at, header), n) for name, _, header, n in found}
    for name, (at, n) in begin.items():
        if not (m := re.fullmatch(r"archive/(.+)\.warc\.gz", name)):
            continue
        if index := begin.get(f"indexes/{m[1]}.cdxj"):
            for line in read_at(index[1], index[0]).decode().splitlines():
                told = json.loads(line.split(" ", 2)[2])
                yield at + int(told["offset"]), int(told["length"])
        else:
            yield from _walk(read_at, at, n)


def _walk(read_at, at: int, n: int) -> Iterator[tuple[int, int]]:
    begin, pos, end, unzip = at, at, at + n, zlib.decompressobj(31)
    while pos < end:
        got = read_at(min(1 << 20, end - pos), pos)
        pos += len(got)
        while got:
            unzip.decompress(got)
            if not unzip.eof:
                break
            got = unzip.unused_data
            yield begin, pos - len(got) - begin
            begin, unzip = pos - len(got), zlib.decompressobj(31)


# ---- jobs ----

def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    first = own.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("least_id")).where("n > 1 AND least_id IS NOT NULL")
    first = stored(first.select("digest", "least_id"))  # a table, so that Spark can split a digest with many pages
    return own.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("least_id")), F.col("least_id"))).select("page_id", "url", "payload", "digest", "refers_to")


def write_packages(pages: DataFrame, least: int = 100, package_bytes: int = 32 << 20) -> DataFrame:
    """(path, size, records) of the packages written."""
    folder = shared_dir(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        records: list[bytes] = []
        index: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal records, index, size
            name = uuid.uuid4().hex
            data = package(records, index, name)
            with fs.open_output_stream(f"{where}/{name}.wacz") as out:
                out.write(data)
            told = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.wacz"], "size": [len(data)], "records": [len(records)]})
            records, index, size = [], [], 0
            return told

        for batch in pieces(batches, "payload"):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed = gzip.compress(record(page_id, url, payload, digest, refers_to), 5, mtime=0)
                index.append(f"{re.sub(r'\s', '', url or '') or '-'} {DATE} {json.dumps({'offset': size, 'length': len(packed)})}\n")
                records.append(packed)
                size += len(packed)
                if size >= package_bytes:
                    yield flush()
        if records:
            yield flush()

    return stored(with_revisits(pages, least).mapInArrow(run, "path string, size long, records long"))


def _reader(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_file(path)


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the packages (path, size): page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _reader(path) as f:
                    found = list(entries(f.read_at, size))
                at, n = zip(*found, strict=True) if found else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["path", "at", "n"])

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()} | ({"payload": pa.binary()} if payloads else {})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, opened = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            i = 0
            while i < len(rows):
                path, at, _ = rows[i]
                j, end = i, at
                while j < len(rows) and rows[j][0] == path and rows[j][1] == end and (j == i or end - at < RANGE):
                    end += rows[j][2]
                    j += 1
                if path != opened:
                    if f:
                        f.close()
                    f, opened = _reader(path), path
                data = f.read_at(end - at, at)
                got = [parse(gzip.decompress(data[a - at : a - at + n])) for _, a, n in rows[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in kinds.items()], list(kinds))
                i = j
        if f:
            f.close()

    found = packages.select("path", "size").repartition("path").mapInArrow(index, "path string, at long, n long")
    # as many tasks as the archives' bytes ask for: the rows shuffled here are places alone, which tell little of them
    total = packages.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    dealt = found.withColumn("range", F.floor(F.col("at") / RANGE)).repartition(tasks, "path", "range").sortWithinPartitions("path", "at").select("path", "at", "n")
    return dealt.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads)
