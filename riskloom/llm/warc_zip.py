"""WARC records in ZIP archives: written once, then read by ranges without extraction.

An archive is a ZIP with stored members: ``archive/data.warc.gz`` holds gzip'd WARC/1.1 records one
after another, ``indexes/index.cdxj`` one line per record with its offset and length. The reader
parses the end of central directory (ZIP64 forms included) and the central directory by range
reads, finds the stored ``.warc`` and ``.warc.gz`` members, reads the indexes, and then fetches each
record by its range. A member that no index names is scanned record by record, in bounded pieces.

Which payloads are equal is found on digests alone. Where the repeated digests are few, they are
told to the pages by a measured broadcast, and payloads stay where they lie; else pages are joined
with them by digest, those of common payloads dealt out over several tasks.

Payloads of at least ``min_bytes`` that are equal are stored once: the row with the largest page id
is the response, the others are revisits that refer to it. Archives live in the shared folder and
are opened through pyarrow's file systems; a task lists only what it has finished, so files left
by a lost executor are never read.

Defined results: a null payload is empty; rows with equal payloads that share the largest id are
all responses; a null id stays null and is never referred to unless all equal payloads lack one;
a null url is the empty one; an empty table gives no archive and no rows; other columns are ignored.
An archive without a WARC member, with a compressed one, or whose index names a member that it does
not hold, is an error that names it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, fresh_dir, small, spread_to

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes that a scan reads at once.
PIECE = 1 << 15

#: An archive is closed beyond this many bytes of records.
ARCHIVE_BYTES = 32 << 20


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip'd WARC record. A revisit keeps the HTTP header, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict:
    """Headers, record type, ids and payload of one record that is no longer gzip'd."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    number = lambda k: int(x) if (x := headers.get(k, "").removeprefix("<urn:x-page:").rstrip(">")) else None
    return {"headers": headers, "type": headers["warc-type"], "page_id": number("warc-record-id"), "refers_to": number("warc-refers-to"), "url": headers.get("warc-target-uri"), "payload": payload, "payload_bytes": declared}


def zipped(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP of stored members with the records and their index."""
    out, at, index = io.BytesIO(), 0, []
    for page_id, data in records:
        index.append(json.dumps({"id": page_id, "offset": at, "length": len(data), "filename": DATA}))
        at += len(data)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA, (2024, 1, 1, 0, 0, 0)), b"".join(data for _, data in records))
        z.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "\n".join(index))
    return out.getvalue()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all rows as archives under ``folder``; returns (path, records, bytes) of the finished files, cut from its lineage."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    equal = cut(rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).filter("n > 1"))
    met = rows.join(F.broadcast(equal), "digest", "left") if small(equal) else spread_to(rows, equal, ["digest"], "left")
    typed = met.withColumn("revisit", F.col("n").isNotNull() & (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.zip"
            fs, local = _store(path)
            fs.create_dir(local.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(local) as f:
                f.write(zipped(records))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(records)], pa.int64()), pa.array([held], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, response_id, revisit in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "response_id", "revisit")), strict=True):
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), response_id.as_py(), revisit.as_py())
                records.append((page_id.as_py(), data))
                held += len(data)
                if held >= ARCHIVE_BYTES:
                    yield close()
                    records, held = [], 0
        if records:
            yield close()

    return cut(typed.select("page_id", "url", "payload", "response_id", "revisit").mapInArrow(run, "path string, records long, bytes long"))


def members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Name to (offset of the data, stored length, method) of each member, from the central directory by range reads."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[k + 10 : k + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = at(tail_at + k - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = at(struct.unpack("<Q", locator[8:16])[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    directory, p, found = at(start, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, whole, n, m, c = struct.unpack("<H8xIIHHH", directory[p + 10 : p + 34])
        (local,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name, extra = directory[p + 46 : p + 46 + n].decode(), directory[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            tag, width = struct.unpack("<HH", extra[:4])
            if tag == 1:
                values = list(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                if whole == 0xFFFFFFFF:
                    whole = values.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = values.pop(0)
                if local == 0xFFFFFFFF:
                    local = values.pop(0)
            extra = extra[4 + width :]
        head = at(local, 30)
        found[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed, method)
        p += 46 + n + m + c
    return found


def _scan(f, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member of a range of ``f``, read in pieces."""
    packer, begin, got, data = None, 0, 0, b""
    while data or got < length:
        if not data:
            f.seek(start + got)
            data = f.read(min(PIECE, length - got))
            if not data:
                break
            got += len(data)
        if packer is None:
            packer, begin = zlib.decompressobj(wbits=31), got - len(data)
        packer.decompress(data, 16 * PIECE)
        if packer.eof:
            data, packer = packer.unused_data, None
            yield begin, got - len(data) - begin
        else:
            data = packer.unconsumed_tail
    if packer is not None or got < length:
        raise ValueError("the last record is cut off")


def _scan_plain(f, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of a range of ``f`` that isn't compressed, from the records' own lengths."""
    at = 0
    while at < length:
        head = b""
        while b"\r\n\r\n" not in head:
            f.seek(start + at + len(head))
            more = f.read(min(PIECE, length - at - len(head)))
            if not more:
                raise ValueError("the last record is cut off")
            head += more
        head = head.partition(b"\r\n\r\n")[0]
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield at, len(head) + 8 + size
        at += len(head) + 8 + size


def ranges(f, size: int, path: str) -> list[tuple[int, int]]:
    """Offset and length in the archive of every record: from its indexes, and by a scan of members that they don't name."""
    found = members(f, size)
    kept = {k: v for k, v in found.items() if k.endswith((".warc", ".warc.gz"))}
    if not kept:
        raise ValueError(f"{path} holds no WARC member")
    by_end = {k.rpartition("/")[2]: k for k in kept}
    out, named = [], set()
    for name, (at, n, method) in found.items():
        if not name.endswith((".cdxj", ".cdx")):
            continue
        f.seek(at)
        text = f.read(n)
        for line in (zlib.decompress(text, -15) if method else text).decode().splitlines():
            if "{" not in line:
                continue
            x = json.loads(line[line.index("{") :])
            member = x["filename"] if x["filename"] in kept else by_end.get(x["filename"].rpartition("/")[2])
            if member is None:
                raise ValueError(f"the index of {path} names {x['filename']}, which it does not hold")
            named.add(member)
            out.append((kept[member][0] + int(x["offset"]), int(x["length"])))
    for name, (start, length, method) in kept.items():
        if method:
            raise ValueError(f"{name} in {path} is not stored")
        if name not in named:
            out += [(start + o, n) for o, n in (_scan if name.endswith(".gz") else _scan_plain)(f, start, length)]
    return out


def locate(paths: DataFrame) -> DataFrame:
    """(path, offset, length) of every record, from the archives' directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = _store(path)
                with fs.open_input_file(local) as f:
                    found = ranges(f, fs.get_file_info(local).size, path)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([o for o, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["path", "offset", "length"])

    return paths.select("path").mapInArrow(run, "path string, offset long, length long")


def read_records(places: DataFrame, payloads: bool = True) -> DataFrame:
    """Range-read records: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, with ``payloads``, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            rows = []
            for p, offset, length in zip(*(batch.column(k).to_pylist() for k in ("path", "offset", "length")), strict=True):
                if p != path:
                    if f:
                        f.close()
                    fs, local = _store(p)
                    path, f = p, fs.open_input_file(local)
                f.seek(offset)
                raw = f.read(length)
                x = parse(zlib.decompress(raw, wbits=31) if raw[:2] == b"\x1f\x8b" else raw)
                declared = x["headers"].get("warc-payload-digest", "").removeprefix("sha1:")
                digest = declared if x["type"] == "revisit" else base32_sha1(x["payload"])
                if digest != declared:
                    raise ValueError(f"payload of record {x['page_id']} in {p} doesn't match its digest")
                row = (x["page_id"], x["url"], x["type"], x["refers_to"], x["payload_bytes"], digest)
                rows.append((*row, x["payload"]) if payloads else row)
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=False)], names=names)
        if f:
            f.close()

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    return places.mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, range_bytes: int = 1 << 20, task_bytes: int = 64 << 20, **names) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back by its range.

    Records are read by ranges of ``range_bytes``, dealt over a fixed number of tasks: at least one
    for each core, and more as the archives grow beyond ``task_bytes`` a task.
    """
    written = write_archives(pages, fresh_dir(pages.sparkSession, "warc"), min_bytes=min_bytes, **names)
    files, size = written.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = pages.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // task_bytes), min(cores, -(-size // range_bytes)))
    spread = locate(written.repartition(max(1, min(files, tasks)), "path"))
    return read_records(spread.repartition(tasks, "path", F.floor(F.col("offset") / range_bytes)).sortWithinPartitions("path", "offset"), payloads=False)
