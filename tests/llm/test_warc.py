import gzip
import hashlib

import pytest

from skein.llm import warc


def pages(spark):
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2 b\r\nX: y", big), (7, None, big), (7, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (8, "u", other), (9, "u", other), (None, "u", other), (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 100), (11, "u", "long " * 200_000)]
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, digest string, size int")


def test_round_trip(spark):
    df = pages(spark)
    want = []
    rows = df.collect()
    for r in rows:
        b = (r.html or "").encode()
        first = max((x.page_id for x in rows if x.html == r.html and x.page_id is not None), default=None)
        revisit = len(b) >= 1000 and r.page_id != first
        want.append((r.page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert warc.round_trip(pages(spark).filter("false")).count() == 0


def test_streams():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    whole = gzip.compress(record * 3)
    members = gzip.compress(record) * 3
    for data in (whole, members, members + b"\0" * 9, members + b"\0" * 9 + gzip.compress(b"")):
        for step in (1, 7, 10**6):
            assert [r for _, r in warc.records(warc.inflated(data[k : k + step] for k in range(0, len(data), step)))] == [record] * 3
        assert [r for _, r in warc.records(warc.inflated(warc.pieces(data)))] == [record] * 3
    for data in (whole[:-20], gzip.compress(record[:-9]), gzip.compress(b"no record")):
        with pytest.raises((warc.Broken, OSError)):
            list(warc.records(warc.inflated(warc.pieces(data))))


def test_what_a_lost_attempt_left_is_not_read(spark, tmp_path):
    raw, clean = f"file://{tmp_path}/raw", f"file://{tmp_path}/clean"
    warc.write(pages(spark), raw)
    warc.normalise(spark, raw, clean).collect()
    archives = warc.spool(warc.normalise(spark, raw, clean), "normalised")
    rows = warc.read(archives, clean).collect()
    assert len(rows) == pages(spark).count() == sum(r.records for r in archives.collect())
    assert len({(r.archive, r.offset) for r in rows}) == len(rows)
