"""ARC parsing, conversion and reading back."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc as W

BODY = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>a b</p>"


def _arc(version, *records):
    return W.arc_filedesc(version, "old", "19990101000000") + b"".join(records)


def _v1(url, date, mime, block):
    return f"{url} 1.2.3.4 {date} {mime} {len(block)}\n".encode() + block + b"\n"


@pytest.mark.parametrize("packed", [False, True])
def test_versions_are_parsed_by_their_own_fields(packed):
    for version in (1, 2):
        data = _arc(version, W.arc_record(version, "http://a/x?y=1 2", "20010203040506", "text/html", BODY, "old.arc", 99),
                    W.arc_record(version, "dns:a", "2001", "text/dns", b"1.2.3.4\n\nhttp://b 0 0 x 3\n", "old.arc", 9))
        got = list(W.arc_records(gzip.compress(data) if packed else data))
        assert [r["URL"] for r in got] == ["filedesc://old.arc", "http://a/x?y=1 2", "dns:a"]
        assert [r["block"] for r in got[1:]] == [BODY, b"1.2.3.4\n\nhttp://b 0 0 x 3\n"]  # lengths decide, not lines
        assert {r["version"] for r in got} == {version} and not any(r["cut"] or r["damaged"] for r in got)
        if version == 2:
            assert got[1]["Checksum"] == hashlib.md5(BODY).hexdigest() and got[1]["Result-code"] == "200"


def test_cut_and_damaged_archives_lose_nothing():
    whole = _arc(1, _v1("http://a/", "20010203040506", "text/html", BODY))
    got = list(W.arc_records(whole[:-10]))
    assert got[-1]["cut"] and BODY.startswith(got[-1]["block"]) and len(got) == 2
    got = list(W.arc_records(whole + b"no header line\nrest"))
    assert got[-1]["damaged"] and got[-1]["block"] == b"no header line\nrest"
    assert [r["damaged"] for r in W.arc_records(b"http://a/ 1.2.3.4 2001 text/html 3\nabc\n")] == [True]
    assert list(W.arc_records(b"")) == []


def test_timestamps():
    assert W.timestamp("20010203040506") == "2001-02-03T04:05:06Z"
    assert W.timestamp("200102") == "2001-02-01T00:00:00Z"
    assert W.timestamp("never") == W.timestamp("") == "1970-01-01T00:00:00Z"


def test_conversion_of_old_files(spark):
    arc = _arc(1, _v1("http://a/1", "20010203040506", "text/html", BODY), _v1("http://a/2", "20020203040506", "text/html", BODY),
               _v1("ftp://a/3", "20030203040506", "text/plain", b"plain"))
    table = spark.createDataFrame([("1", arc), ("2", arc[:-3]), ("3", b"junk")], "path string, content binary").coalesce(1)
    out = [bytes(r["archive"]) for r in W.convert(table).collect()]
    records = [r for data in out for r in W.warc_records(data)]
    kinds = sorted(f["warc-type"] for f, _ in records)
    # the cut plain record and the junk are kept
    assert kinds == ["metadata", "resource", "resource", "response", "revisit", "revisit", "revisit", "warcinfo", "warcinfo"]
    first = next(f for f, _ in records if f["warc-type"] == "response")
    for fields, block in records:
        assert fields["warc-block-digest"] == "sha1:" + W.base32_sha1(block)
        if fields["warc-type"] == "revisit":
            assert fields["warc-refers-to"] == first["warc-record-id"] and b"<p>" not in block
            assert fields["warc-payload-digest"] == first["warc-payload-digest"] == "sha1:" + W.base32_sha1(b"<p>a b</p>")
    assert any(f.get("warc-truncated") == "length" for f, _ in records)
    assert len({f["warc-record-id"] for f, _ in records}) == len(records) and first["warc-date"] == "2001-02-03T04:05:06Z"


PAGES = [(5, "http://a/", "<p>x</p>"), (3, "http://b/ c\n", "<p>x</p>"), (9, None, "<p>x</p>"), (4, "", ""), (2, "http://é/", None),
         (7, "http://c/", "é" * 300_000), (8, "http://d/", "\r\n\r\nWARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"), (6, "u", "<p>x</p>"),
         (6, "u", "<p>x</p>"), (None, "v", "<p>x</p>"), (None, "v", "only here")]


def _pages(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.select("*", *[F.lit("x").alias(c) for c in ("archive", "kind", "payload", "first", "item", "record_type")])


@pytest.mark.parametrize("chunk", [1, W.CHUNK_BYTES])
@pytest.mark.parametrize("least", [0, 8, 9])
def test_pages_written_and_read_back(spark, chunk, least):
    got = W.archived_pages(_pages(spark, PAGES).repartition(3), least, chunk).collect()
    assert len(got) == len(PAGES) and all(r["intact"] for r in got)
    want, firsts = [], {}
    for page, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        body = (html or "").encode()
        first = firsts.setdefault(body, (page,)) if len(body) >= least else None
        again = len(body) >= least and sum(w[5] == body for w in want) > 0
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response",
                     first[0] if again else None, body))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, (w[:5] for w in want)))


def test_no_pages(spark):
    assert W.archived_pages(_pages(spark, [])).collect() == []


def test_hot_payloads_do_not_depend_on_the_way_of_the_join(spark):
    from tessera.llm.common import join_firsts
    rows = spark.range(400).select((F.col("id") % 3 * F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id"))).cast("string").alias("k"), "id")
    firsts = rows.groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    few, many = (sorted(tuple(r) for r in join_firsts(rows, firsts, "k", "n", m).select("id", F.coalesce("least", F.lit(-1))).collect())
                 for m in (1000, 2))
    assert few == many and len(few) == 400
