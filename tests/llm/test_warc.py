import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from cohortspan.llm import common, warc

SCHEMA = "page_id long, url string, html string, name string, key string, salt string, later string, n string"
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(3)


def brute(rows, least=0):
    """One response for each payload, of the smallest page_id."""
    heads, out = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        body = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = len(body) >= least and body in heads
        out.append((page_id, len(body), sha, "revisit" if again else "response", heads[body] if again else None))
        if not again:
            heads[body] = page_id
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


PAGES = [
    (5, "http://www.Example.org:80/a/b?q=1", "<p>one</p>"), (3, "https://user@www.example.org/a/b?q=1", "<p>one</p>"), (4, None, "<p>one</p>"),
    (9, "http://x.example.net/", None), (8, "http://x.example.net/", ""), (7, "no url, with spaces\r\nand lines", "é😀 \r\n\r\n text"), (None, "http://b.example/ü", "é😀"),
    (None, None, None), (6, "", "same"), (6, "", "same"), (6, "", "same"), (2**60, "http://x.example.net", "z" * 3_000_000), (1, "http://x.example.net/%C3%BC", "z" * 3_000_000),
]


@pytest.mark.parametrize("least", [0, 4, 11])
def test_odd_rows(spark, least):
    assert rows_of(warc.round_trip(table(spark, PAGES), least=least)) == brute(PAGES, least)


def test_empty(spark):
    assert rows_of(warc.round_trip(table(spark, []))) == []


def test_keys(spark):
    urls = [u for _, u, _ in PAGES] + ["HTTP://A.b.C", "ftp://h.org?x", "http://h.org#y"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url"))).collect()]
    assert got == [
        "org,example,www)/a/b?q=1", "org,example,www)/a/b?q=1", "", "net,example,x)/", "net,example,x)/", "no url, with spaces\r\nand lines", "example,b)/ü", "", "", "", "",
        "net,example,x)", "net,example,x)/%C3%BC", "c,b,a)", "org,h)?x", "org,h)#y",
    ]


def test_hot_payload_and_hot_key(spark, monkeypatch):
    """A third of all pages share a payload, another third a URL; both are cut up."""
    monkeypatch.setattr(warc, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = random.Random(5)
    rows = [(i, f"http://h{i % 7}.example/{i}", "the same") for i in range(10, 300)] + [(i, "http://one.example/", f"page {i}") for i in range(300, 600)]
    rows += [(i, f"http://h{rng.randrange(5)}.example/{i % 50}", f"page {rng.randrange(900)}") for i in range(600, 900)]
    rows += [(10, "http://h3.example/10", "the same")] * 30 + [(None, None, "nobody's")] * 40
    rng.shuffle(rows)
    pages = table(spark, rows)
    assert rows_of(warc.round_trip(pages)) == brute(rows)


def test_files(spark, tmp_path):
    """What is written is plain WARC, and a lookup finds all captures of a key and reads only ranges."""
    rows = [(i, f"http://h{i % 13}.example/{i % 40}", f"page {i % 90} " * 20) for i in range(400)]
    archive = warc.write(table(spark, rows), f"file:{tmp_path}/deep/folder", block=16)
    names = sorted(os.listdir(tmp_path / "deep/folder"))
    bodies = b"".join((tmp_path / "deep/folder" / n).read_bytes() for n in names if n.endswith(".warc.gz"))
    plain = gzip.GzipFile(fileobj=io.BytesIO(bodies)).read()
    assert plain.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == 90 and plain.count(b"WARC/1.1\r\nWARC-Type: revisit\r\n") == 310
    assert [f[0] for f in archive.files] and all(f[1] <= f[2] for f in archive.files)
    blocks = sum(len(warc._Directory(f"{archive.folder}/{f[0]}", *f[3:]).blocks) for f in archive.files)
    assert blocks >= 400 / 16
    asked = spark.createDataFrame([("example,h1)/1",), ("example,h12)/25",), ("example,h1)/2",), ("",), ("zzz",), ("example,h1)/1",)], "key string")
    got = warc.records(archive, warc.captures(archive, asked), payload=True).collect()
    assert sorted(r["page_id"] for r in got) == [i for i in range(400) if (i % 13, i % 40) in {(1, 1), (12, 25), (1, 2)}]
    assert {r["url"] for r in got} == {f"http://h{r['page_id'] % 13}.example/{r['page_id'] % 40}" for r in got}
    for r in got:
        assert bytes(r["payload"]) == (f"page {r['page_id'] % 90} " * 20).encode() if r["record_type"] == "response" else r["payload"] == b""


def test_a_changed_record_is_noticed():
    member = warc.record("response", "<urn:uuid:1>", b"body", 3, "http://a/", warc.digest(b"body"), "2000-01-01T00:00:00Z")
    fields, body = warc.parse(member)
    assert body == b"body" and fields["x-page-id"] == "3" and fields["warc-target-uri"] == "http://a/"
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert rows_of(warc.round_trip(pages)) == brute(rows)
