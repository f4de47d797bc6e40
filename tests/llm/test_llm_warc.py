import base64
import hashlib
import pathlib
import struct
import time

import pytest
import zstandard
from outskirt.llm import warc
from outskirt.llm.shared import shared_folder

PAGES = [(5, "<p>same</p>"), (3, "<p>same</p>"), (9, "<p>same</p>"), (1, None), (2, ""), (7, "é" * 10), (8, "x" * 400_000)]
PAGES += [(100 + i, f"<html><body>page {i} {'word ' * (i % 9)}</body></html>") for i in range(300)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(i, f"http://a/{i}", h, "x") for i, h in rows], "page_id long, url string, html string, body string")


@pytest.mark.parametrize("min_bytes, archive_bytes", [(0, 64 << 20), (11, 1 << 16), (12, 1 << 12)])
def test_round_trip(spark, monkeypatch, min_bytes, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    folder = shared_folder(spark)
    made = warc.write(pages(spark), f"{folder}/a", min_bytes=min_bytes).collect()
    found = warc.read(spark, f"{folder}/a", payloads=True)
    assert sum(r.records for r in made) == len(PAGES) and found.where("fault is not null").count() == 0
    payloads = {r.record_id.rpartition(":")[2]: bytes(r.payload) for r in found.collect() if r.record_type == "response"}
    first = {}
    for i, h in PAGES:
        h = (h or "").encode()
        first[h] = min(i, first.get(h, i))
    for r in warc.resolved(found, folder).collect():
        i = int(r.record_id.rpartition(":")[2])
        body = (dict(PAGES)[i] or "").encode()
        revisit = len(body) >= min_bytes and first[body] != i
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (f"urn:page_id:{first[body]}" if revisit else None)
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert revisit or payloads[str(i)] == body


def test_odd_rows(spark):
    folder = shared_folder(spark)
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b")]
    warc.write(pages(spark, rows), f"{folder}/a")
    kinds = sorted((r.record_id, r.record_type) for r in warc.resolved(warc.read(spark, f"{folder}/a"), folder).collect())
    one, two, none = "urn:page_id:1", "urn:page_id:2", "urn:page_id:"
    assert kinds == [(none, "response"), (none, "response"), (none, "revisit"), (one, "response"), (one, "response"), (two, "revisit")]
    assert warc.write(pages(spark, []), f"{folder}/b").count() == 0


def test_dictionary_is_read_from_the_leading_frame():
    records = [warc.record("response", f"urn:x:{i}", None, f"payload {i} {'text ' * 20}".encode(), "D", None) for i in range(200)]
    data = warc.archive(records)
    magic, n = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and [t for _, t, _ in warc.frames(data)] == records
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + n])  # the dictionary may be compressed
    assert [t for _, t, _ in warc.frames(struct.pack("<II", magic, len(packed)) + packed + data[8 + n :])] == records
    plain = zstandard.ZstdDecompressor()
    with pytest.raises(zstandard.ZstdError):
        plain.decompress(data[8 + n :])


def test_faults_are_named():
    good = warc.record("response", "urn:x:1", "u", b"abc", warc.base32_sha1(b"abc"), None)
    assert warc.parse(good)[1] == b"abc"
    bad = {
        "version line": good.replace(b"WARC/1.1", b"WARC/9"),
        "record length": good[:-1],
        "no WARC-Date": good.replace(b"WARC-Date", b"X-Date"),
        "Content-Length": good.replace(b"Content-Length: 3", b"Content-Length: x"),
        "WARC-Block-Digest": good.replace(b"abc", b"abd"),
        "header line": good.replace(b"WARC-Type:", b"WARC-Type"),
    }
    for fault, data in bad.items():
        with pytest.raises(ValueError, match=fault):
            warc.parse(data)
    data = warc.archive([good])
    assert [f for _, _, f in warc.frames(data[:-3])][-1] is not None
    assert list(warc.frames(struct.pack("<II", warc.DICTIONARY_FRAME, 99) + b"x")) == [(0, None, "dictionary length")]


def foreign(name=str.lower, version="WARC/1.0", body=b"<p>hello</p>"):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2020-01-01T00:00:00Z")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(body))]
    fields += [("WARC-Block-Digest", "sha1:" + warc.base32_sha1(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{name(k)}: {v}\r\n" for k, v in fields)
    return f"{version}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("name", [str.lower, str.upper, str])
def test_archives_of_others(spark, name):
    folder = shared_folder(spark).removeprefix("file://")
    pathlib.Path(folder).mkdir(parents=True)
    records = [foreign(name), foreign(name, "WARC/1.1", b"x" * 50_000)]
    (pathlib.Path(folder) / "a.warc.zst").write_bytes(b"".join(zstandard.ZstdCompressor(write_content_size=False).compress(r) for r in records))
    got = warc.read(spark, f"file://{folder}", payloads=True).orderBy("at").collect()
    assert [r.fault for r in got] == [None, None] and [r.payload_bytes for r in got] == [12, 50_000]
    assert bytes(got[0].payload) == b"<p>hello</p>" and got[0].payload_digest == warc.base32_sha1(b"<p>hello</p>")
    with pytest.raises(ValueError, match="WARC-Payload-Digest"):
        warc.parse(foreign().replace(b"hello", b"hallo").replace(b"warc-block-digest: sha1", b"warc-block-digest: md5"))


def test_broken_dictionaries_are_faults():
    packer = zstandard.ZstdCompressor().compressobj()  # no content size
    packed = packer.compress(b"word " * 400) + packer.flush()
    good = zstandard.ZstdCompressor().compress(warc.record("response", "urn:x:1", "u", b"abc", "D", None))
    for raw, faults in ((packed, 0), (packed[:-5], 1), (struct.pack("<I", warc.ZSTD_MAGIC) + b"junk", 1)):
        found = list(warc.frames(struct.pack("<II", warc.DICTIONARY_FRAME, len(raw)) + raw + good))
        assert sum(f is not None for _, _, f in found) == faults


def test_reading_is_linear_and_losses_are_raised(spark):
    data = warc.archive([warc.record("response", f"urn:x:{i}", None, f"page {i} {i * 7919}".encode(), "D", None) for i in range(16_000)])
    began = time.time()
    assert sum(1 for _ in warc.frames(data)) == 16_000 and time.time() - began < 2
    folder = shared_folder(spark)
    archives = warc.write(pages(spark), f"{folder}/a")
    path = pathlib.Path(next(r.path for r in archives.collect() if r.records > 1))
    assert warc.resolved(warc.read(spark, f"{folder}/a"), f"{folder}/1", archives).count() == len(PAGES)
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(ValueError, match="faulty archive"):
        warc.resolved(warc.read(spark, f"{folder}/a"), f"{folder}/2", archives)
    path.unlink()
    with pytest.raises(ValueError, match="records read"):
        warc.resolved(warc.read(spark, f"{folder}/a"), f"{folder}/3", archives)
