import gzip
import hashlib
from collections import Counter

import duckdb
import pytest

from tersus.llm import warc
from tersus.llm.common import mounted
from tersus.llm.suite import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, least=1000):
    """(page_id, bytes, digest, type, refers_to), for distinct ids."""
    largest = {}
    for i, html in rows:
        body = (html or "").encode()
        if i is not None:
            largest[body] = max(i, largest.get(body, i))
    out = []
    for i, html in rows:
        body = (html or "").encode()
        again = len(body) >= least and body in largest and i != largest[body]
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", largest[body] if again else None))
    return Counter(out)


def got(df):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


LONG = "<p>ü</p>\r\n\r\nWARC/1.1\r\n" * 100
PAGES = [(1, "http://a/1", LONG), (5, "http://a/5", LONG), (3, None, LONG), (2, "http://b\r\nX: y", None), (4, "", ""), (None, "n", LONG),
         (6, "é", "x" * 999), (7, "é", "x" * 999), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "v", "é" * 500), (11, "w", "é" * 499 + "e"),
         (12, "w", "é" * 500)]


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip_equals_plain_version(spark, parts):
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, key int")
    want = plain([(i, h) for i, _, h in PAGES])
    assert got(warc.archive_round_trip(df.repartition(parts))) == want


def test_one_hot_payload(spark):
    rows = [(i, "u", "z" * 2000 if i % 3 else "q" * (1000 + i)) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    assert got(warc.archive_round_trip(df)) == plain([(i, h) for i, _, h in rows])


def test_repeated_ids_leave_one_response(spark):
    df = spark.createDataFrame([(1, "u", "z" * 2000)] * 3 + [(None, "u", "n" * 2000)] * 2, "page_id long, url string, html string")
    rows = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(df).collect())
    assert rows == {(1, 2000, "response", None): 1, (1, 2000, "revisit", 1): 2, (None, 2000, "response", None): 1, (None, 2000, "revisit", None): 1}


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archives_are_deduplicated_and_have_fresh_headers(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    first = warc.write_archives(df, "page_id", "url", "html", file_bytes=400)
    assert first.count() > 3 and {r["records"] for r in first.collect()} != {len(PAGES)}
    second = warc.deduplicate_archives(first)

    def all_records(manifest):
        return [x for r in manifest.collect() for x in warc.records(mounted(r["path"]))]
    before, after = all_records(first), all_records(second)
    ids = {h["warc-record-id"] for h, _ in before}
    assert not ids & {h["warc-record-id"] for h, _ in after}
    assert Counter(b for h, b in after if h["warc-type"] == "response" and len(b) > 1100).most_common(1)[0][1] == 1
    by_id = {h["warc-record-id"]: (h, b) for h, b in after}
    for h, block in after:
        assert int(h["content-length"]) == len(block)
        if h["warc-type"] != "warcinfo":
            assert h["warc-block-digest"] == warc.payload_digest(block)
        if h["warc-type"] == "revisit":
            to, original = by_id[h["warc-refers-to"]]
            assert to["warc-payload-digest"] == h["warc-payload-digest"] == warc.payload_digest(warc.http_parts(to, original)[1])
            assert to["warc-type"] == "response" and block.endswith(b"\r\n\r\n") and h["warc-profile"] == warc.SAME_PAYLOAD


def test_revisits_of_given_archives_are_resolved_again(spark, tmp_path):
    """The original of an old revisit may itself become a revisit of a later one, or be missing."""
    page = b"p" * 1500
    digest, gone = warc.payload_digest(page), warc.payload_digest(b"gone")
    http = warc.http_headers(len(page))
    first = tmp_path / "a.warc.gz"
    first.write_bytes(warc.warcinfo("2020-01-01T00:00:00Z") + warc.response("<urn:a>", "2020-01-01T00:00:00Z", "http://a", 1, http, page)
                      + warc.revisit("<urn:b>", "2021-01-01T00:00:00Z", "http://b", 2, http, digest, "<urn:a>", "http://a", None)
                      + warc.revisit("<urn:c>", "2021-01-01T00:00:00Z", "http://c", 3, http, gone, "<urn:x>", "http://x", None))
    second = tmp_path / "b.warc"  # not compressed
    second.write_bytes(gzip.decompress(warc.response("<urn:d>", "2022-01-01T00:00:00Z", "http://d", 9, http, page)))
    empty = tmp_path / "c.warc.gz"
    empty.write_bytes(b"")
    manifest = warc.existing_archives(spark, [str(first), str(second), str(empty)])
    out = {r["key"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_resolved(warc.deduplicate_archives(manifest)).collect()}
    assert out == {9: ("response", None, 1500), 1: ("revisit", 9, 1500), 2: ("revisit", 9, 1500), 3: ("revisit", None, None)}


def test_broken_archives_are_refused(tmp_path):
    whole = warc.response("<urn:a>", "2020-01-01T00:00:00Z", "http://a", 1, warc.http_headers(3), b"abc")
    for name, data in (("cut", whole[:-9]), ("no-record", gzip.compress(b"hello\r\n\r\n")), ("short", gzip.compress(gzip.decompress(whole)[:-9]))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            list(warc.records(str(tmp_path / name)))


def test_payload_that_does_not_fit_its_digest(spark, tmp_path):
    wrong = gzip.decompress(warc.response("<urn:a>", "2020-01-01T00:00:00Z", "http://a", 1, warc.http_headers(3), b"abc")).replace(b"abc", b"abd")
    (tmp_path / "x.warc").write_bytes(wrong)
    with pytest.raises(Exception, match="payload of its digest"):
        warc.read_headers(warc.existing_archives(spark, [str(tmp_path / "x.warc")])).collect()


def test_very_long_page(spark):
    rows = [(1, "u", "long " * 3_000_000), (2, "u", "long " * 3_000_000)]
    assert got(warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))) == plain([(i, h) for i, _, h in rows])


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + ORACLE["op13_warc_revisits"] + ")").fetchall()
    assert got(QUERIES["op13_warc_revisits"](spark, SF)) == Counter(want)
