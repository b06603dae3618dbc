"""Web archives packaged as ZIP files: written, then read by byte ranges."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_ID = "urn:page:"


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

# -- ZIP directories ----------------------------------------------------------


def _end(f: BinaryIO, size: int) -> tuple[int, int, int]:
    """Offset, length and number of entries of the central directory."""
    span = min(size, 65_557)
    f.seek(size - span)
    tail = f.read(span)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0:
        if len(tail) - at >= 22 and len(tail) - at - 22 >= struct.unpack_from("<H", tail, at + 20)[0]:
            break
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, offset = struct.unpack_from("<HII", tail, at + 10)
    where = size - span + at
    if where >= 20 and (n == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF):
        f.seek(where - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\x06\x07":
            (z,) = struct.unpack_from("<Q", locator, 8)
            f.seek(z)
            record = f.read(56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            n, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, n


def members(f: BinaryIO, size: int) -> dict[str, dict]:
    """Members by name: method, size, packed size, offset of the local header."""
    offset, length, n = _end(f, size)
    f.seek(offset)
    data, at, out = f.read(length), 0, {}
    for _ in range(n):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, plain, k_name, k_extra, k_note = struct.unpack_from("<IIIHHH", data, at + 16)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + k_name].decode("utf-8" if flags & 0x800 else "cp437")
        e, end = at + 46 + k_name, at + 46 + k_name + k_extra
        while e + 4 <= end:
            tag, k = struct.unpack_from("<HH", data, e)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{k // 8}Q", data, e + 4))
                if plain == 0xFFFFFFFF:
                    plain = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if header == 0xFFFFFFFF:
                    header = wide.pop(0)
            e += 4 + k
        out[name] = {"method": method, "size": plain, "packed": packed, "header": header, "crc": crc}
        at = end + k_note
    return out


def data_offset(f: BinaryIO, member: dict) -> int:
    """Where the bytes of a stored member begin."""
    if member["method"] != zipfile.ZIP_STORED:
        raise ValueError("only stored members can be read by ranges")
    f.seek(member["header"])
    local = f.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    k_name, k_extra = struct.unpack_from("<HH", local, 26)
    return member["header"] + 30 + k_name + k_extra


# -- records ------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, refers_url: str | None) -> bytes:
    """One WARC record, in a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    quoted = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {quoted(url)}", "WARC-Date: 2020-01-01T00:00:00Z"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers}>", f"WARC-Refers-To-Target-URI: {quoted(refers_url)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def parse(raw: bytes) -> dict:
    """Fields and payload of one packed record; payload is None in a revisit."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    whole = fields["WARC-Type"] == "response"
    number = lambda x: int(x) if (x := x.removeprefix(f"<{_ID}").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if not whole else None,
        "payload_bytes": len(payload) if whole else said,
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": payload if whole else None,
    }


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = 24 << 20) -> DataFrame:
    """Write a record for each row into ZIP packages below folder (a URI that driver
    and executors share); returns (package, size, records), one row a package.

    Of rows with equal payloads of 100 bytes or more, the one with the smallest id
    becomes a response and the others revisits that refer to it. Payloads meet their
    response by digest; adaptive execution may split a hot digest. A package holds at
    most about most_bytes of packed records, all that a task keeps in memory. Names
    are unique to an attempt: a lost task leaves at worst a file that no row names.
    """
    base = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = base.where(F.octet_length("payload") >= 100).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("f"))
    rows = base.join(first.select("digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"), "first_url"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        held, lines, total = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, lines, total
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(DATA, b"".join(held))
                z.writestr(INDEX, "".join(lines))
            size = store.get_file_info(f"{root}/{name}").size
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([len(held)], pa.int64())], names=["package", "size", "records"])
            held, lines, total = [], [], 0
            return row

        for batch in batches:
            ids, urls, payloads, digests, refers, refers_url = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                args = [c[i].as_py() for c in (ids, urls, payloads, digests, refers, refers_url)]
                packed = record(*args)
                lines.append(json.dumps({"id": args[0], "offset": total, "length": len(packed)}) + "\n")
                held.append(packed)
                total += len(packed)
                if total >= most_bytes:
                    yield close()
        if held:
            yield close()

    return rows.mapInArrow(run, "package string, size bigint, records bigint")


def read_archives(packages: DataFrame, with_payload: bool = False, window: int = 1 << 20) -> DataFrame:
    """Records of packages (package, size): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, and with_payload also payload.

    Each package is opened in place: directories at its end, index, then runs of
    records in ranges of about `window` bytes. Nothing is unpacked to disk.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _filesystem(uri)
                with store.open_input_file(path) as f:
                    found = members(f, size)
                    index, data = found[INDEX], found[DATA]
                    f.seek(data_offset(f, index))
                    entries = [json.loads(x) for x in f.read(index["size"]).splitlines()]
                    start = data_offset(f, data)
                    k = 0
                    while k < len(entries):
                        lo, j = entries[k]["offset"], k + 1
                        while j < len(entries) and entries[j]["offset"] + entries[j]["length"] - lo <= window:
                            j += 1
                        f.seek(start + lo)
                        chunk = f.read(entries[j - 1]["offset"] + entries[j - 1]["length"] - lo)
                        yield batch_of([parse(chunk[e["offset"] - lo : e["offset"] - lo + e["length"]]) for e in entries[k:j]])
                        k = j

    return packages.select("package", "size").mapInArrow(run, schema)


def round_trip(pages: DataFrame, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write the pages' records below the shared folder and read them back.

    One row per input row. Null html is an empty payload, a null url an empty one; a
    null id is larger than any other. Rows that repeat an id and payload are all
    responses. An empty table gives no package and no row. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/wayspark-archives/{uuid.uuid4().hex}"
    packages = stored(write_archives(pages, folder, **columns))
    n = packages.count()
    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism) if n < 10_000 else n // 64)
    return read_archives(packages.repartition(tasks, "package"), with_payload)
