"""WARC records in ZIP-packaged archives: written by Spark, read by ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures and lengths of its records.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
END_BYTES, TAIL = 22, 1 << 16
DATE = "2024-01-01T00:00:00Z"


# ---- ZIP ----------------------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    crc: int
    at: int  # of its local header


def zip_file(members: list[tuple[str, bytes]], zip64: bool = False, comment: int = 0) -> bytes:
    """A ZIP of stored members.  ``zip64``: sizes, places and the end record in their 64-bit forms, as any reader of large
    archives accepts; used for large ones anyhow.  ``comment``: bytes that the writer appends as archive comment."""
    out, directory, at = [], [], 0
    zip64 = zip64 or sum(len(d) for _, d in members) > 0xF0000000
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", 1, 16, n, n) if zip64 else b""
        short = 0xFFFFFFFF if zip64 else n
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45 if zip64 else 20, 0, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, n, n, at) if zip64 else b""
        directory.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if zip64 else 20, 0, 0, 0, 33, crc, short, short, len(raw), len(more), 0, 0, 0, 0, 0xFFFFFFFF if zip64 else at) + raw + more)
        out += [head, data]
        at += len(head) + n
    where, size, n = at, sum(map(len, directory)), len(members)
    out += directory
    if zip64:
        out.append(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, where))
        out.append(LOCATOR + struct.pack("<IQI", 0, where + size, 1))
        n, size, where = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
    out.append(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, where, comment))
    return b"".join(out)


def directory(read, length: int) -> list[Member]:
    """Members by the central directory.  ``read(at, n)`` returns bytes of the archive of ``length`` bytes."""
    tail_at = max(0, length - TAIL - END_BYTES)
    tail = read(tail_at, length - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + END_BYTES + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(END, 0, end)  # the signature may also occur in a comment
    if end < 0:
        raise ValueError("no end of central directory")
    n, size, where = struct.unpack_from("<H", tail, end + 10)[0], *struct.unpack_from("<II", tail, end + 12)
    if (n == 0xFFFF or 0xFFFFFFFF in (size, where)) and end >= 20 and tail[end - 20:end - 16] == LOCATOR:
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record = read(at, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record where its locator points")
        n, size, where = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = read(where, size), 0, []
    for _ in range(n):
        if raw[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", raw, at + 16)
        start = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46:at + 46 + n_name].decode()
        extra, x = raw[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, size_x = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # 64-bit values, only of fields that say so, in this order
                wide = iter(struct.unpack_from(f"<{size_x // 8}Q", extra, x + 4))
                full, packed, start = (next(wide) if v == 0xFFFFFFFF else v for v in (full, packed, start))
            x += 4 + size_x
        out.append(Member(name, method, full, packed, crc, start))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(read, m: Member) -> int:
    """Where a stored member's bytes begin: behind its local header, whose length only it tells."""
    if m.method != 0 or m.size != m.packed:
        raise ValueError(f"{m.name} is not stored")
    head = read(m.at, 30)
    if head[:4] != LOCAL:
        raise ValueError("broken local header")
    return m.at + 30 + sum(struct.unpack_from("<HH", head, 26))


# ---- WARC ---------------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    n = urn.strip("<>").rpartition(":")[2]
    return int(n) if n else None


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False, name: str = "") -> bytes:
    """One WARC record.  A revisit has the HTTP head with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{name or digest(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, url, type, digest, refers_to, payload (null for a revisit) and payload_bytes of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and said != len(payload):
        raise ValueError("payload is cut")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload),
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload, "payload_bytes": said,
    }


# ---- jobs ---------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, zip64: bool = True) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into ZIP archives of about ``archive_bytes`` of payload.

    Of rows with equal payloads the one with the largest page_id is the response and the others are revisits of it.  Only
    (page_id, digest) takes part in finding them; a digest of a third of all rows is one partial maximum per task, and
    its rows join a single row.  The payloads are shuffled once, by a hash of page_id and digest, to their archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    total = p.agg(F.sum(F.length("payload") + 200), F.count("*")).first()
    archives = max(1, -(-(total[0] or 0) // archive_bytes))
    archive = F.pmod(F.xxhash64("page_id", "sha"), F.lit(archives)).cast("int")
    slim = p.select("page_id", "sha")
    last = slim.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marks = slim.join(last, "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    rows = p.select(archive.alias("archive"), "page_id", "sha", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(0).alias("mark"))
    rows = rows.unionByName(marks.select(archive.alias("archive"), "page_id", "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to", F.lit(1).alias("mark")))

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        known = lambda v: None if pd.isna(v) else int(v)
        marked = {(known(i), s): known(r) for i, s, r in g.loc[g["mark"] == 1, ["page_id", "sha", "refers_to"]].itertuples(index=False)}
        own = g.loc[g["mark"] == 0].sort_values(["page_id", "sha", "url"], na_position="first", kind="stable")
        body, lines, at, seen = [], [], 0, set()
        for i, s, url, data in own[["page_id", "sha", "url", "payload"]].itertuples(index=False):
            i, url = known(i), None if pd.isna(url) else url
            name = base64.b32encode(s).decode()
            revisit = (i, s) in marked or (i, s) in seen  # equal rows: the first is the response
            target = marked.get((i, s), i) if revisit else None
            seen.add((i, s))
            packed = gzip.compress(record(i, url, bytes(data), target, revisit, name), 3, mtime=0)
            lines.append(f"{'' if url is None else json.dumps(url)[1:-1].replace(' ', '%20')} {DATE} " + json.dumps({"page_id": i, "digest": name, "offset": at, "length": len(packed), "filename": DATA}))
            body.append(packed)
            at += len(packed)
        # The text writer ends its only line with a line feed: the archive's comment of one byte.
        done = zip_file([(DATA, b"".join(body)), (INDEX, "\n".join(lines).encode())], zip64, comment=1)
        return pd.DataFrame({"archive": [key[0]], "data": [done]})

    files = rows.groupBy("archive").applyInPandas(build, "archive int, data binary")
    files.select("archive", F.col("data").cast("string").alias("value")).write.partitionBy("archive").option("compression", "none").text(path)


def archive_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all archives; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "length")


def range_reader(uri: str):
    """``read(at, n)`` on a file of any store that pyarrow knows (local and shared folders, HDFS, object stores)."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))
    handle = store.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        return handle.read_at(n, at)

    read.close = handle.close
    return read


def read_index(archives: DataFrame, opener=range_reader) -> DataFrame:
    """(path, start, length) of every record: directory, then the stored index, by ranges."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                read = opener(path)
                members = {m.name: m for m in directory(read, length)}
                data, index = data_start(read, members[DATA]), members[INDEX]
                at = [json.loads(x[x.index("{"):]) for x in read(data_start(read, index), index.size).decode().split("\n") if x]
                read.close()
                yield pd.DataFrame({"path": path, "start": [data + x["offset"] for x in at], "length": [x["length"] for x in at]})

    return archives.mapInPandas(run, "path string, start long, length long")


def read_records(index: DataFrame, payloads: bool = True, opener=range_reader) -> DataFrame:
    """The records at the given ranges; nothing else of the archives is read."""
    columns = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long" + ", payload binary" * payloads
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part in batch.groupby("path", sort=False):
                read, out, held = opener(path), [], 0
                for start, length in zip(part["start"], part["length"]):
                    out.append(parse(gzip.decompress(read(start, length))))
                    held += out[-1]["payload_bytes"]
                    if held > 4 << 20:
                        yield _frame(out, names)
                        out, held = [], 0
                if out:
                    yield _frame(out, names)
                read.close()

    return index.mapInPandas(run, columns)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=names)
    return f.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return what range reads give back, a row per page.

    A null html is an empty payload, a null url is left out, a null page_id is smaller than all others.  Rows equal in
    page_id and payload: one is the response (if that id is the largest), the others are revisits of it.  An empty table gives an empty
    result; other columns are left out.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path, **options)
    from .wavelet import path_has_files

    if not path_has_files(spark, path):
        return spark.createDataFrame([], "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long")
    return read_records(read_index(archive_list(spark, path)), payloads=False)
