import hashlib
import os
import struct

import pytest
import zstandard

from vitaloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record string")


def test_round_trip(spark):
    same, small = "é" * 80, "short"
    rows = [
        (5, "http://a", same, "x"), (3, "http://b", same, "x"), (9, None, same, "x"),
        (1, "http://c", small, "x"), (2, "http://d", small, "x"), (4, "http://e", None, "x"),
        (6, "http://f\r\nEvil: 1", "", "x"), (7, "http://g", "y" * 3_000_000, "x"),
        (8, "http://h", "a\r\n\r\nb" * 50, "x"), (8, "http://h", "a\r\n\r\nb" * 50, "x"),
        (None, "http://i", same, "x"),
    ]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows) and not [r.error for r in got if r.error]
    want = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        first = {same: 3}.get(html)
        refers = first if first not in (None, page_id) and page_id is not None else None
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers))
    keys = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(keys, key=repr) == sorted(want, key=repr)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")


def test_archives_have_a_dictionary_and_a_frame_a_record(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/many"
    rows = [(i, f"http://p/{i}", f"<html>page {i} " + "body " * 60, "x") for i in range(400)]
    made = warc.write_archives(pages(spark, rows), folder)
    names = [n for n in os.listdir(tmp_path / "many") if n.endswith(".warc.zst")]
    assert made == len(names) and not [n for n in os.listdir(tmp_path / "many") if n.endswith(".open")]
    total = 0
    for name in names:
        data = (tmp_path / "many" / name).read_bytes()
        mark, size = struct.unpack_from("<II", data)
        assert mark == 0x184D2A5D and data[8:12] == b"\x28\xb5\x2f\xfd"
        assert len(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])) > 0
        total += sum(1 for d, e in warc.frames(data) if e is None)
    assert total == 400
    assert warc.read_archives(spark, folder).count() == 400


def sound() -> bytes:
    payload = b"<html>" + b"x" * 200
    return warc.record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), None)


def archive(*records: bytes, dictionary: bytes = b"some raw text to start with") -> bytes:
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return warc.archive_head(dictionary) + b"".join(packer.compress(r) for r in records)


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
        (lambda r: r.replace(b"WARC-Date: ", b"Other: "), "warc-date"),
        (lambda r: r.replace(b"Content-Type: application", b"no colon here application"), "header line"),
        (lambda r: r.replace(b"xxxx", b"yyyy", 1), "block"),
        (lambda r: r[:-4], "Content-Length"),
        (lambda r: r + b"more", "Content-Length"),
        (lambda r: b"", "version"),
    ],
)
def test_records_that_do_not_hold(change, error):
    found = warc.parsed(change(sound()))
    assert error in found["error"]
    assert "error" not in warc.parsed(sound())


def test_broken_frames(spark, tmp_path):
    good = archive(sound(), sound(), sound())
    cut = good[:-3]
    plain = zstandard.ZstdCompressor().compress(sound())
    first = len(archive())
    second = good.find(b"\x28\xb5\x2f\xfd", first + 4)
    broken = bytearray(good)
    broken[second + 20 : second + 30] = b"\0" * 10
    for name, data in (("good", good), ("cut", cut), ("plain", plain), ("broken", bytes(broken)), ("empty", b""), ("text", b"no archive at all")):
        (tmp_path / f"{name}.warc.zst").write_bytes(data)
    (tmp_path / "other.txt").write_bytes(b"not read")
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(os.path.basename(r.archive).split(".")[0], []).append(r.error)
    assert by["good"] == [None] * 3 and by["plain"] == [None]
    assert by["cut"].count(None) == 2 and any(by["cut"])
    assert by["broken"].count(None) >= 1 and any(by["broken"])
    assert "empty" not in by and any(by["text"])


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_frames_of_any_size_are_cut_at_their_ends():
    """Frames shorter and longer than a chunk, and at its borders; reading is linear."""
    import random

    import zstandard

    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (1, 100, warc._CHUNK - 1, warc._CHUNK, warc._CHUNK + 1, 5 * warc._CHUNK, 0, 7)]
    content = b"".join(zstandard.ZstdCompressor(level=1).compress(p) for p in parts)
    assert [d for d, e in warc.frames(content) if e is None] == parts
    cut = list(warc.frames(content[:-3]))
    assert [d for d, _ in cut[:-1]] == parts[:-1] and cut[-1] == (None, "the last frame is cut short")
