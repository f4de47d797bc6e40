"""WARC archives in Zstandard: one record per frame, a dictionary in the leading skippable frame.

Writing: rows are digested (SHA-1), one aggregate finds the smallest id of each payload, and a join says of each row
whether it is a response or revisits that one. Each task then writes archives of bounded size to a folder that
all executors share, under a name that only a whole file gets; a task that runs again replaces its files. A
dictionary is trained on the first records of the archive.

Reading: Spark lists the archives and hands whole ones (bounded by the writer) to tasks. A reader loads the dictionary,
decodes frame by frame, and checks version line, headers, lengths and digests; a fault becomes a row with ``fault`` set
instead of an exception. Revisits get length and digest of the payload from the record they refer to, by a join.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outskirt.llm.shared import rows_of, stored

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")

#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Records and bytes that a dictionary is trained on, and its size.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 256, 4 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes of a frame that are looked at first.
FIRST_READ = 4096


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record with its headers and the two empty lines behind it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    lines = b"".join(f"{name}: {value}\r\n".encode() for name, value in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + payload + b"\r\n\r\n"


class Headers(dict):
    """Header fields; names are compared without case."""

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(name.lower(), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: str) -> bool:
        return super().__contains__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def payload_of(headers: Headers, block: bytes) -> bytes:
    """What a payload digest is of: of an HTTP message the part behind its header lines, else the block."""
    if headers.get("Content-Type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and block of one record. ValueError names the fault. Digests by other algorithms than SHA-1 are not checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0].upper() not in VERSIONS:
        raise ValueError("version line")
    headers = Headers()
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line")
        headers[name.decode(errors="replace").strip()] = value.strip().decode(errors="replace")
    for name in REQUIRED:
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["Content-Length"].isdigit():
        raise ValueError("Content-Length")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    block = rest[:n]
    checks = {"WARC-Block-Digest": block}
    if headers["WARC-Type"] != "revisit":
        checks["WARC-Payload-Digest"] = payload_of(headers, block)
    for name, content in checks.items():
        algorithm, _, digest = headers.get(name, "").partition(":")
        if algorithm.lower() == "sha1" and digest.upper() != base32_sha1(content):
            raise ValueError(name)
    return headers, block


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or none where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes]) -> bytes:
    """The dictionary in its skippable frame, if there is one, and a frame per record."""
    used, size = [], 0
    for data in records[:TRAIN_RECORDS]:
        if size + len(data) <= TRAIN_BYTES:
            used.append(data)
            size += len(data)
    dictionary = train(used) if len(used) >= 16 else b""
    out, made = io.BytesIO(), None
    if dictionary:
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        made = zstandard.ZstdCompressionDict(dictionary)
    pack = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True, write_content_size=True)
    for data in records:
        out.write(pack.compress(data))
    return out.getvalue()


def frames(data: bytes):
    """(offset, uncompressed record or None, fault) of each frame. After a broken frame nothing more can be found."""
    at, made = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        n = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + n]
        if len(raw) < n:
            yield 0, None, "dictionary length"
            return
        try:
            if raw[:4] == struct.pack("<I", ZSTD_MAGIC):  # a dictionary may be compressed itself
                one = zstandard.ZstdDecompressor().decompressobj()
                raw = one.decompress(raw)
                if not one.eof:
                    yield 0, None, "dictionary cut off"
                    return
            made, at = zstandard.ZstdCompressionDict(raw), 8 + n
        except zstandard.ZstdError as e:
            yield 0, None, f"dictionary: {e}"
            return
    unpack, view = zstandard.ZstdDecompressor(dict_data=made), memoryview(data)
    while at < len(data):
        one, parts, end, step = unpack.decompressobj(), [], at, FIRST_READ
        try:
            # Handed over in growing parts: what lies behind the frame is copied once at most.
            while not one.eof and end < len(data):
                parts.append(one.decompress(view[end : end + step]))
                end, step = min(end + step, len(data)), 2 * step
        except zstandard.ZstdError as e:
            yield at, None, f"frame: {e}"
            return
        if not one.eof:
            yield at, None, "frame cut off"
            return
        yield at, b"".join(parts), None
        at = end - len(one.unused_data)


def _write(folder: str, id_name: str):
    """Batches of (id, url, payload or null, digest, refers_to or null) to archives; a row per archive."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        store.create_dir(root, recursive=True)
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            data = archive(held)
            name = f"{root}/part-{part:06d}-{count:04d}.warc.zst"
            hidden = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as file:
                file.write(data)
            store.move(hidden, name)
            return rows_of({"path": [name], "records": [len(held)], "bytes": [len(data)]}, schema)

        for batch in batches:
            for row, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                kind = "revisit" if refers_to.is_valid else "response"
                name = lambda value: f"urn:{id_name}:{'' if value is None else value}"
                body = (payload.as_py() or "").encode() if kind == "response" else b""
                digest32 = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                to = name(refers_to.as_py()) if kind == "revisit" else None
                held.append(record(kind, name(row.as_py()), url.as_py(), body, digest32, to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, count = [], 0, count + 1
        if held:
            yield flush()

    return run, "path string, records long, bytes long"


def write(pages: DataFrame, folder: str, id_column: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """A WARC record for each row of ``pages`` in archives below ``folder``; returns (path, records, bytes) of each archive.

    The payload is the column's text in UTF-8, null like empty. Of records with equal payloads of at least ``min_bytes``
    bytes, that with the smallest id is the response and the others revisit it; smaller payloads all are
    responses. Repeated rows with the smallest id all are responses; a null id counts as larger than all others and revisits
    if any other id has the payload (a payload of null ids only: all are responses). No rows write no archive."""
    body = F.coalesce(F.col(payload), F.lit(""))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_column).alias("id"), url.alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    # Stored, so that Spark can split the join at a payload with many copies.
    first = stored(first, f"{folder}-plan", "first")
    revisits = (F.octet_length("body") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    refers_to = F.when(revisits, F.col("first"))
    planned = rows.join(first, "digest").select(
        "id", "url", F.when(refers_to.isNull(), F.col("body")).alias("body"), "digest", refers_to.alias("refers_to")
    )
    # Sorted, so that a task that runs again makes the same archives and replaces all of its files.
    planned = planned.sortWithinPartitions("id", "digest")
    run, schema = _write(folder, id_column)
    return stored(planned.mapInArrow(run, schema), f"{folder}-plan", "archives")


def _read(payloads: bool):
    schema = pa.schema(
        [("path", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]
        + [("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string())]
        + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fault", pa.string())]
    )

    def row(path, at, text, fault):
        if fault is None:
            try:
                h, block = parse(text)
                bare = lambda name: h[name].strip("<>") if name in h else None
                payload = payload_of(h, block)
                digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or base32_sha1(payload)
                kept = payload if payloads else None
                made = (bare("WARC-Record-ID"), h["WARC-Type"], h.get("WARC-Target-URI"), bare("WARC-Refers-To"))
                return (path, at, *made, digest, len(payload), kept, None)
            except ValueError as e:
                fault = str(e)
        return (path, at, None, None, None, None, None, None, None, fault)

    def run(batches):
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                path, held, size = path.as_py(), [], 0
                for at, text, fault in frames(content.as_py()):
                    held.append(row(path, at, text, fault))
                    size += len(text or b"") if payloads else 256
                    if size >= 4 << 20:
                        yield rows_of(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema)
                        held, size = [], 0
                if held:
                    yield rows_of(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema)

    kinds = "path string, at long, record_id string, record_type string, target_uri string, refers_to string, "
    return run, kinds + "payload_digest string, payload_bytes long, payload binary, fault string"


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives below ``folder``, or per fault: path, at (offset of the frame), record_id,
    record_type, target_uri, refers_to, payload_digest, payload_bytes, payload (on demand; of an HTTP message its body), fault."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(*_read(payloads))


def resolved(records: DataFrame, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """``records`` with ``payload_bytes`` of a revisit taken from the response it refers to.

    A faulty record raises ValueError, as does another number of records than ``archives`` (what :func:`write` returned) has."""
    whole = stored(records, folder, "records")
    seen = whole.agg(F.count("*").alias("n"), F.max(F.when(F.col("fault").isNotNull(), F.concat_ws(" ", "path", "at", "fault"))).alias("fault")).first()
    if seen["fault"]:
        raise ValueError(f"faulty archive: {seen['fault']}")
    if archives is not None and seen["n"] != (wanted := archives.agg(F.sum("records")).first()[0] or 0):
        raise ValueError(f"{seen['n']} records read of {wanted}")
    responses = whole.where("record_type = 'response'").groupBy("record_id")
    responses = responses.agg(F.max("payload_bytes").alias("full_bytes"))
    # Stored, so that Spark can split the join at a response with many revisits.
    responses = stored(responses.withColumnRenamed("record_id", "refers_to"), folder, "responses")
    revisits = whole.where("record_type = 'revisit'").drop("payload_bytes").join(responses, "refers_to", "left")
    revisits = revisits.withColumnRenamed("full_bytes", "payload_bytes")
    return whole.where("record_type <> 'revisit'").unionByName(revisits)
