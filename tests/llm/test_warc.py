import hashlib
import io
import json
import struct
from collections import Counter
from pathlib import Path

import pytest
import zstandard

from loomspark.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, row long, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 3, "x") for i, u, h in rows], SCHEMA)


def odd_rows():
    long = "<p>" + "lorem ipsum " * 200
    return [(1, "http://a.b/c?d=é f\r\nX: y", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", long), (7, "u", long + "ünï😀"), (7, "u", long + "ünï😀"), (8, "u", "z" * 999), (9, "u", "z" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u", "q" * 3_000_000)]


def by_hand(rows):
    best = {}
    for k, (i, _, h) in enumerate(rows):
        best[h or ""] = max(best.get(h or "", (False, 0, -1)), (i is not None, i or 0, k))
    out = []
    for k, (i, _, h) in enumerate(rows):
        data, top = (h or "").encode(), best[h or ""]
        again = len(data) >= 1000 and top[2] != k
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[1] if again else None))
    return Counter(out)


def read_back(spark, df, path, **options):
    rows, _ = warc.captures(df)
    warc.write_archives(rows, path, **options)
    return warc.resolved(warc.read_archives(spark, path), "long")


def test_odd_pages_come_back(spark, tmp_path):
    df = pages(spark, odd_rows()).coalesce(1)
    out = read_back(spark, df, str(tmp_path / "a"))
    assert Counter(tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == by_hand(odd_rows())
    assert read_back(spark, df.limit(0), str(tmp_path / "none")).collect() == []


def test_archives_are_frames_behind_a_dictionary(spark, tmp_path):
    """Decoded here with nothing of the reader: the skippable frame, then one frame a record."""
    rows = [(i, f"http://x/{i}", f"<html><head><title>Page {i}</title></head><body>{'<p class=body>text of it</p>' * (5 + i % 9)} {i * 7919}</body></html>") for i in range(400)]
    path = tmp_path / "a"
    read_back(spark, pages(spark, rows).coalesce(2), f"file://{path}", train_bytes=20_000, archive_bytes=20_000)
    names = [n for n, _, _ in json.loads((path / warc.MANIFEST).read_text())]
    seen, sizes = {}, 0
    assert len(names) > 2
    for name in names:
        data = (path / name).read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert 0x184D2A50 <= magic <= 0x184D2A5F
        own, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
        while at < len(data):
            decoder = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
            text = decoder.decompress(data[at:])
            at = len(data) - len(decoder.unused_data)
            head, block = text.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block) - 4
            seen[int(fields["WARC-Page-ID"])] = (fields["WARC-Type"], block[:-4].partition(b"\r\n\r\n")[2].decode())
            sizes += 1
    assert sizes == 400 and all(seen[i] == ("response", h) for i, _, h in rows)
    plain = sum(len(zstandard.compress(h.encode())) for _, _, h in rows)
    assert sum((path / n).stat().st_size for n in names) < 2 * plain


def test_what_was_not_committed_is_not_read(spark, tmp_path):
    path = tmp_path / "a"
    df = pages(spark, [(1, "u", "one"), (2, "u", "two")])
    read_back(spark, df, str(path))
    stray = next(path.glob("*.warc.zst"))
    (path / "lost-attempt.warc.zst").write_bytes(stray.read_bytes())
    assert warc.read_archives(spark, str(path)).count() == 2
    read_back(spark, df, str(path))  # a second write appends
    assert warc.read_archives(spark, str(path)).count() == 4


def test_damage_is_told(spark, tmp_path):
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.records(io.BytesIO(b"12345678" * 4)))
    of = {"record_id": "urn:a", "record_type": "response", "page_id": "1", "target_uri": None, "refers_to": None, "payload_digest": hashlib.sha1(b"xyz").hexdigest(), "payload_bytes": 3, "payload": b"xyz"}
    data, own = warc.record(of, "2020-01-01T00:00:00Z"), zstandard.ZstdCompressionDict(b"words " * 50)
    head = struct.pack("<II", warc.SKIPPABLE, len(own.as_bytes())) + own.as_bytes()
    archive = lambda x: io.BytesIO(head + zstandard.ZstdCompressor(dict_data=own).compress(x))
    assert [b[-3:] for _, b in warc.records(archive(data))] == [b"xyz"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(archive(data[:-5])))
    name = "x.warc.zst"
    (tmp_path / name).write_bytes(archive(data.replace(b"xyz", b"xyy")).read())
    (tmp_path / warc.MANIFEST).write_text(json.dumps([[name, 1, 1]]))
    with pytest.raises(ValueError, match="digest"):
        list(warc.WarcReader({"path": str(tmp_path)}).read(warc.ArchiveFile(name)))


def test_null_ids_read_as_they_are(spark, tmp_path):
    out = warc.read_archives(spark, str(Path(tmp_path) / "nothing"))
    assert out.count() == 0 and out.columns == warc.SCHEMA.names
