import hashlib
import io
from collections import Counter

import pytest
import zstandard

from wortnetz.llm import warc


@pytest.fixture
def pages(spark):
    big = "<p>" + "é" * 2000
    rows = [(k, f"http://x/{k}", f"<html>{k}</html>" * (k * 7 % 200), "c") for k in range(60)]
    rows += [(100 + k, "http://a b\r\nX: y", big, "c") for k in range(20)] + [(200, None, None, None), (None, "u", big, "c"), (None, "u", "n" * 3000, "c"), (None, "u", "n" * 3000, "c"), (201, "u", "same", "c"), (202, "u", "same", "c"), (203, "u", "x" * 200_000, "c"), (119, "again", big, "c")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(6)


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["html"] or "", []).append(r["page_id"])
    out = Counter()
    for r in rows:
        data, ids = (r["html"] or "").encode(), [i for i in by[r["html"] or ""] if i is not None]
        again = len(data) >= 1000 and ids and r["page_id"] != max(ids)
        out[r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(ids) if again else None] += 1
    return out


def test_archives_against_brute_force(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 20_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1_000)
    index = warc.write_archives(pages, str(tmp_path))
    got = Counter(tuple(r) for r in warc.read_archives(index, str(tmp_path)).collect())
    assert got == brute(pages.collect())
    assert index.select("bundle").distinct().count() > 1


def test_bundles_are_plain_zstandard_files(spark, pages, tmp_path):
    index = warc.write_archives(pages, str(tmp_path)).collect()
    for bundle in {r["bundle"] for r in index}:
        raw = (tmp_path / bundle).read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        frames = warc.read_seek_table(io.BytesIO(raw), len(raw))
        assert sum(f[2] for f in frames) == len(whole)
        before = 0
        for k, (at, size, plain) in enumerate(frames):
            data = zstandard.ZstdDecompressor().decompress(raw[at : at + size])
            assert data == whole[before : before + plain]
            before += plain
            for r in (r for r in index if r["bundle"] == bundle and r["frame"] == k):
                assert data[r["start"] : r["start"] + r["size"]].startswith(b"WARC/1.1\r\n") and data[: r["start"] + r["size"]].endswith(b"\r\n\r\n")
                assert warc.read_record(*warc.parse(memoryview(data), r["start"]))["page_id"] == r["page_id"]


def test_a_damaged_payload_is_an_error():
    data = warc.record("response", "u", b"abc", hashlib.sha1(b"abd").hexdigest(), 3, 1, None)
    with pytest.raises(ValueError):
        warc.read_record(*warc.parse(memoryview(data), 0))


def test_no_pages(spark, pages, tmp_path):
    none = pages.where("page_id < -5")
    assert warc.read_archives(warc.write_archives(none, str(tmp_path)), str(tmp_path)).count() == 0
