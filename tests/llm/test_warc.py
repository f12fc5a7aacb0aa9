import gzip
import hashlib
from pathlib import Path

import pytest

from millpond.llm import warc

PAGES = "page_id long, url string, html string, digest string, payload string, refers_to long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 5) for r in rows], PAGES)


def expected(rows):
    best = {}
    for i, _, html in rows:
        html = html or ""
        if len(html.encode()) >= 1000 and i is not None:
            best[html] = max(best.get(html, i), i)
    out = []
    for i, _, html in rows:
        html = html or ""
        to = best.get(html)
        revisit = to is not None and to != i
        out.append((i, len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/1", "<p>" + "é" * 600), (2, "http://a/2", "<p>" + "é" * 600), (3, None, "<p>" + "é" * 600), (3, "http://a/3", "<p>" + "é" * 600),
    (4, "http://a/4?q=%41 b\r\nc", "small"), (5, "", "small"), (6, "http://a/6", None), (7, "http://a/7", ""), (None, "http://a/n", "<p>" + "é" * 600),
    (None, "http://b", "z" * 2000), (None, "http://c", "z" * 2000), (8, "http://a/8", "\r\n\r\nWARC/1.1\r\n" * 100), (9, "http://a/9", "x" * 300_000),
]


def test_every_page_comes_back(spark):
    got = warc.archive_and_read(spark, pages(spark, ROWS))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(ROWS)
    assert warc.archive_and_read(spark, pages(spark, [])).collect() == []


def test_index_points_at_whole_records_and_reads_are_joined(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "archives")
    index = warc.write(warc.decide(pages(spark, ROWS)).coalesce(1), folder, archive_bytes=500)
    rows = index.collect()
    assert len(rows) == len(ROWS) and len({r.file for r in rows}) > 1
    for r in rows:
        raw = (Path(folder) / r.file).read_bytes()
        record = gzip.decompress(raw[r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"sha1:{r.digest}".encode() in record
        assert gzip.decompress(raw)  # the file as a whole is a valid series of members
    # A selection, with no gap allowed and with everything joined, gives the same records.
    chosen = index.where("page_id % 2 = 0")
    apart = sorted(map(repr, warc.read(chosen, folder, gap=-1).collect()))
    assert apart == sorted(map(repr, warc.read(chosen, folder, gap=1 << 30).collect()))
    assert len(apart) == 4
    urls = {r.page_id: (r.url, r.payload) for r in warc.read(index, folder).collect()}
    assert urls[4] == ("http://a/4?q=%41 b\r\nc", b"small")
    assert urls[9][1] == b"x" * 300_000


def test_damage_is_reported(spark, tmp_path):
    folder = str(tmp_path / "archives")
    index = warc.write(warc.decide(pages(spark, [(1, "u", "a" * 50)])), folder)
    wrong = index.withColumn("digest", index.digest.substr(1, 3))
    with pytest.raises(Exception, match="differs"):
        warc.read(wrong, folder).collect()
