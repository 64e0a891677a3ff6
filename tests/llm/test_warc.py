"""Archives: exact round trips."""

import hashlib

from streamlens.llm import warc
from streamlens.llm.common import shared_path


def brute(rows):
    """Of equal payloads of at least 1000 bytes the largest page_id responds."""
    body = [(p, (h or "").encode()) for p, h in rows]
    top = {}
    for p, b in body:
        if len(b) >= 1000 and p is not None:
            top[b] = max(top.get(b, p), p)
    out = []
    for p, b in body:
        again = b in top and p != top[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    return sorted(out, key=repr)


def round_trip(spark, df):
    path = shared_path(spark, "warc-test")
    warc.write_archives(df, path, records_per_file=7)
    return path, warc.resolved_payloads(warc.read_archives(spark, path))


def test_round_trip(spark):
    big, nasty = "ä" * 700, ("x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40)
    rows = [(i, f"http://h/{i}", big) for i in range(20)] + [(i, f"http://h/{i}\r\nEvil: 1", nasty) for i in (50, 40, 45)]
    rows += [(100, "u", "small"), (101, "u", "small"), (102, None, None), (103, "u", ""), (None, "u", big), (None, None, "y" * 2000), (19, "again", big),
             (104, "u", "z" * 999), (105, "u", "z" * 999), (106, "u", "z" * 1000), (107, "u", "z" * 1000), (108, "u", "long " * 200_000)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    path, got = round_trip(spark, df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(p, h) for p, _, h in rows])
    archive = warc.read_archives(spark, path)
    payloads = {(r.page_id, bytes(r.payload)) for r in archive.where("record_type = 'response'").collect()}
    assert (50, nasty.encode()) in payloads and (19, big.encode()) in payloads
    urls = {r.page_id: r.url for r in archive.collect()}
    assert urls[102] is None and urls[40] == "http://h/40%0D%0AEvil: 1"
    ids = [r.record_id for r in archive.where("page_id is not null and page_id <> 19").collect()]
    assert len(ids) == len(set(ids))


def test_files_are_warc(spark):
    path = shared_path(spark, "warc-file")
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "p" * 1200), (2, "http://b/", "p" * 1200)], "page_id long, url string, html string"), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    found = {h["X-Page-ID"]: (h, b) for h, b in warc.records(data)}
    head, block = found["1"]
    assert head["WARC-Type"] == "revisit" and head["WARC-Refers-To"] == found["2"][0]["WARC-Record-ID"]
    assert head["WARC-Refers-To-Target-URI"] == "http://b/" and head["WARC-Profile"] == warc.PROFILE
    assert block.endswith(b"Content-Length: 1200\r\n\r\n") and found["2"][1].endswith(b"p" * 1200)


def test_no_pages(spark):
    _, got = round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.collect() == []
