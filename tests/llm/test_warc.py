import base64
import hashlib
import struct

import pytest
import zstandard

from quillmark.llm import warc

ROWS = [
    (1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "http://b/\r\nX: y", "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000),
    (6, "u", "line\r\n\r\nline"), (6, "u", "line\r\n\r\nline"), (None, "u", "<p>é</p>"), (None, "u", "lonely"), (8, "u", "small"), (9, "u", "small"),
]


def brute(rows, least=0):
    found = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        to = max(same, default=None) if len(data) >= least else None
        if to is None or page == to or sum((h or "") == (html or "") for _, _, h in rows) == 1:
            found.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response", None))
        else:
            found.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit", to))
    return sorted(found, key=repr)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, first string")
    index = warc.write_archives(pages, f"file://{tmp_path}", min_bytes=least, frame_bytes=200, bundle_bytes=250)
    got = warc.read_records(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS, least)
    texts = {(r.page_id, r.payload.decode()) for r in got if r.record_type == "response"}
    assert texts <= {(p, h or "") for p, _, h in ROWS} and (5, "x" * 300_000) in texts
    assert index.select("bundle").distinct().count() > 1


def test_bundle_is_seekable(tmp_path):
    writer = warc.BundleWriter(f"file://{tmp_path}/a/b.warc.zst", frame_bytes=100)
    records = [warc.warc_record(i, "u", b"p%d" % i, "D", 2, None, False) for i in range(5)]
    for i, record in enumerate(records):
        writer.add(i, record)
    rows = writer.close()
    data = (tmp_path / "a/b.warc.zst").read_bytes()
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    for page, _, path, frame, frame_at, frame_bytes, at, n in rows:
        plain = zstandard.ZstdDecompressor().decompress(data[frame_at : frame_at + frame_bytes])
        assert plain[at : at + n] == records[page] == warc.BundleReader(path).frame(frame)[at : at + n]
    # any reader of concatenated frames gets all records, skipping the seek table
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(records)
    with pytest.raises(ValueError):
        warc.parse_record(records[0][:-1])


def test_empty_table(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}")
    assert warc.read_records(index).count() == 0
