"""Archives and URL filters, with damaged files, odd payloads and aliases."""

import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from caseloom.llm import warc
from caseloom.llm.urls import alias_edges, filter_urls, host_of, path_of

PAGES = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a/", "same"), (5, "http://b/\r\nx%0A", "same"), (3, None, "same"), (2, "http://c", None), (9, "http://d", ""),
    (7, "http://é", "ünï\r\n\r\nWARC/1.1 \x1f" * 50), (8, "x", "long " * 60_000), (None, "n", "same"), (None, "m", "only null"), (5, "http://b/", "same"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, _, html in rows:
        to = last.get(html or "")
        to = None if to is None or i == to else to
        out.append((str(i), len((html or "").encode()), digest(html), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [100, 1 << 24])
def test_round_trip_by_ranges(spark, tmp_path, range_bytes):
    pages = spark.createDataFrame(ROWS, PAGES).withColumn("payload", F.lit("clash")).repartition(3)
    manifest = warc.write_warc(warc.mark_revisits(pages), f"file://{tmp_path}/w", file_bytes=600)
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS) and manifest.count() >= 3
    records = warc.read_warc(manifest, range_bytes).cache()
    found = warc.resolve_revisits(records).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == expected(ROWS)
    urls = {(r.page_id, r.url) for r in records.collect()}
    assert urls == {(i, u) for i, u, _ in ROWS}
    payloads = {bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert payloads == {html or "" for _, _, html in ROWS}
    listed = warc.spark_manifest(spark, f"file://{tmp_path}/w")
    assert listed.agg(F.sum("bytes")).first()[0] == manifest.agg(F.sum("bytes")).first()[0]


def test_files_are_plain_warc(spark, tmp_path):
    path = warc.write_warc(warc.mark_revisits(spark.createDataFrame(ROWS[:3], PAGES).coalesce(1)), f"{tmp_path}/w").first().path
    text = gzip.open(path).read().decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.count("WARC-Type: revisit") == 2
    assert text.count("WARC-Refers-To: <urn:page:5>") == 2 and f"WARC-Payload-Digest: sha1:{digest('same')}" in text


def test_short_payloads_are_always_responses(spark):
    found = warc.archive_round_trip(spark.createDataFrame(ROWS[:3], PAGES), min_bytes=5).collect()
    assert {r.record_type for r in found} == {"response"}


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_false_magic_and_damage_are_skipped(tmp_path):
    good = [warc.record(i, "u", f"payload {i}".encode() * 9, digest("x"), None, "2024-01-01T00:00:00Z", 4) for i in range(3)]
    other = zlib.compressobj(9, zlib.DEFLATED, 31)
    other = other.compress(b"not an archive record") + other.flush()
    data = b"junk" + warc.MAGIC + good[0] + warc.MAGIC * 2 + other + good[1][:40] + good[2] + warc.MAGIC[:2]
    (tmp_path / "f").write_bytes(data)
    for step in (7, 50, len(data)):
        found = []
        for start in range(0, len(data), step):
            with warc.fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as file:
                found += [(at, fields["warc-record-id"]) for at, fields in warc.scan_range(file, start, min(len(data), start + step))]
        assert [name for _, name in found] == ["<urn:page:0>", "<urn:page:2>"]
        assert [data[at:at + 3] for at, _ in found] == [warc.MAGIC] * 2


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def canonical(url):
    return f"<html><head><LINK data-x=1 rel='canonical' href='{url}'></head></html>"


def test_rules_hosts_and_aliases(spark):
    rows = [
        (1, "https://Sub.Example.COM/en/x?q=1", None), (2, "https://www.example.com/en/", ""), (3, "http://x.net/es/1", ""), (4, "http://x.net/ES/1", ""),
        (5, "http://notexample.com/en/", ""), (6, "http://x.org/1", canonical("http://x.net/fr/9")), (7, "http://y.org/", canonical("http://x.org/1#top")),
        (8, "http://www.example.com/en/2", canonical("http://x.net/fr/9")), (9, None, canonical("http://x.net/fr/9")), (10, "no scheme", ""), (11, "", ""),
        (12, "http://x.org/1", None), (13, "ftp://net", ""), (14, "http://net/es/", ""), (15, "http://z.org/a/b", "<meta content='0; URL=../c' http-equiv=refresh>"),
        (16, "http://v.org/old", '<meta http-equiv="refresh" content="5;url=//x.net/es/7?a=1&amp;b=2">'), (17, "http://u.org/p/q", canonical("/r")),
        (18, "http://u.org/r", canonical("http://v.org/old")), (19, "http://h.org?x=http://x.net/es/", ""), (6, "http://x.org/1", ""),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumn("rule", F.lit("clash"))
    found = filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert len(found) == len(rows)
    verdicts = {r.page_id: (r.rule, r.verdict) for r in found}
    assert verdicts == {
        1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: ("com/", "allow"),
        6: (None, "block"), 7: (None, "block"), 8: ("www.example.com/en/", "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"),
        12: (None, "block"), 13: (None, "allow"), 14: ("net/es/", "block"), 15: (None, "allow"), 16: (None, "block"), 17: (None, "block"), 18: (None, "block"),
        19: (None, "allow"),
    }


def test_hosts_and_paths(spark):
    urls = ["HTTP://A.b:80/X?y#z", "a://?q", "x", None, "a://b#/c", "a://b/c://d", "://É/", "a://h/p\n/q?"]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")), path_of(F.col("u"))).collect()
    assert [tuple(r) for r in found] == [("a.b:80", "/X"), ("", ""), ("", ""), ("", ""), ("b", ""), ("b", "/c://d"), ("É", "/"), ("h", "/p\n/q")]


def test_no_pages_or_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert filter_urls(spark.createDataFrame([], PAGES), rules).count() == 0
    only = filter_urls(spark.createDataFrame([(1, "http://a.net/es/", None)], PAGES), rules).first()
    assert (only.rule, only.verdict) == (None, "allow")
    assert alias_edges(spark.createDataFrame([(1, "http://a/", canonical("http://A/"))], PAGES)).count() == 0
