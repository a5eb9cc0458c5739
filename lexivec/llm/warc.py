"""WARC records in ZIP packages, written in parallel and read by ranges.

A package is a ZIP file with two members, both stored (not compressed as members):
``archive/data.warc.gz``, one gzip member per record, and ``indexes/index.cdxj``, a line of JSON per record with its
place.  The reader takes the end of the file, the end-of-central-directory record or its ZIP64 form, the central
directory, the index, and then ranges of the archive member, never a whole package; neighbouring
records are fetched by one range of up to ``RANGE`` bytes.

Of records with equal payloads (SHA-1) of ``revisit_from`` bytes or more the one with the smallest id is a response,
the others are revisits that carry only HTTP headers and refer to it.

Packages go to the shared folder under the name of the task attempt and appear by a rename; the
manifest lists those of successful attempts only, so retried or speculative tasks leave nothing double.

Defined cases: a null payload is empty; a null url has no target; control characters in a url are escaped;
rows that repeat the responding id and payload are all responses; rows with a null id are never referred to unless
all of a payload's are null, and then all are responses; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.bpe import pieces
from lexivec.llm.common import checkpointed, fresh_path, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RANGE = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_references(pages: DataFrame, *, id_column: str, url: str, payload: str, revisit_from: int) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``refers_to``; only digests and ids are grouped, counted before the shuffle."""
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= revisit_from, F.sha1(F.col("html").cast("binary"))))
    groups = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that both sides of the join are plain exchanges: Spark splits the rows of a payload that many pages
    # share, and leaves the pages where they are if the groups are small.
    groups = written(groups.where("n > 1 AND first IS NOT NULL").select("sha", "first"))
    rows = rows.join(groups, "sha", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[\\x00-\\x20\\x7f\\x85\\u2028\\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is None:
        block = http + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A record as a row of ``RECORD``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda name: int(n) if (n := fields[name].removeprefix("<urn:page:").rstrip(">")) else None
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return page("WARC-Record-ID"), fields.get("WARC-Target-URI"), "revisit", page("WARC-Refers-To"), size, told, None
    if digest(payload) != told or len(payload) != size:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return page("WARC-Record-ID"), fields.get("WARC-Target-URI"), "response", None, size, told, payload


class Package:
    """Records gathered for one ZIP file."""

    def __init__(self) -> None:
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        member = gzip.compress(record(page_id, url, payload, refers_to), 4, mtime=0)
        self.index.append(json.dumps({"id": page_id, "offset": self.data.tell(), "length": len(member)}))
        self.data.write(member)

    def bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            z.writestr(ARCHIVE, self.data.getvalue())
            z.writestr(INDEX, "\n".join(self.index))
        return out.getvalue()


def write_packages(rows: DataFrame, folder: str, *, package_bytes: int = 32 << 20) -> DataFrame:
    """Write every row as a record; the manifest: ``path`` and ``records`` of each package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, done = TaskContext.get(), []
        package = Package()

        def close() -> None:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.zip"
            with store.open_output_stream(f"{root}/_{name}") as f:
                f.write(package.bytes())
            store.move(f"{root}/_{name}", f"{root}/{name}")
            done.append((f"{folder}/{name}", len(package.index)))

        for whole in batches:
            for batch in pieces(whole):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    package.add(page_id, url, html.encode(), refers_to)
                    if package.data.tell() >= package_bytes:
                        close()
                        package = Package()
        if package.index:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return checkpointed(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"))


def read_at(f: pa.NativeFile, start: int, size: int) -> bytes:
    f.seek(start)
    return f.read(size)


def directory(f: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Start and size of the data of every stored member, by ranges of the file's end, its directory and the local headers."""
    size = f.size()
    tail = read_at(f, max(0, size - 65_557), 65_557)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HLL", tail, at + 10)
    locator = at - 20
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if locator < 0 or tail[locator : locator + 4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (where,) = struct.unpack_from("<Q", tail, locator + 8)
        end = read_at(f, where, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    data, at, members = read_at(f, start, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, full, n, extra, note = struct.unpack_from("<LLHHH", data, at + 20)
        (local,) = struct.unpack_from("<L", data, at + 42)
        name = data[at + 46 : at + 46 + n].decode()
        fields = data[at + 46 + n : at + 46 + n + extra]
        while len(fields) >= 4:
            kind, wide = struct.unpack_from("<HH", fields)
            if kind == 1:  # the values that didn't fit, in this order
                values = list(struct.unpack_from(f"<{wide // 8}Q", fields, 4))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            fields = fields[4 + wide :]
        if method == 0:
            head = read_at(f, local, 30)
            members[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        at += 46 + n + extra + note
    return members


def read_records(f: pa.NativeFile) -> Iterator[tuple]:
    members = directory(f)
    base, _ = members[ARCHIVE]
    places = [json.loads(line) for line in read_at(f, *members[INDEX]).splitlines()]
    k = 0
    while k < len(places):
        first = places[k]["offset"]
        stop = k + 1
        while stop < len(places) and places[stop]["offset"] + places[stop]["length"] - first <= RANGE:
            stop += 1
        block = read_at(f, base + first, places[stop - 1]["offset"] + places[stop - 1]["length"] - first)
        for p in places[k:stop]:
            yield parse(gzip.decompress(block[p["offset"] - first : p["offset"] - first + p["length"]]))
        k = stop


def read_packages(manifest: DataFrame) -> DataFrame:
    """The records (``RECORD``) of all packages that ``manifest`` lists by ``path``."""
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    rows, held = [], 0
                    for r in read_records(f):
                        rows.append(r)
                        held += len(r[-1] or b"")
                        if held > RANGE or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    # By number, so that tasks stay as many as packages however short the manifest's rows are.
    tasks = max(1, min(manifest.count(), 20_000))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, RECORD)


def archive(pages: DataFrame, *, id_column: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages to packages; returns the manifest."""
    rows = with_references(pages, id_column=id_column, url=url, payload=payload, revisit_from=revisit_from)
    return write_packages(rows, folder or fresh_path(pages.sparkSession, "warc"))
