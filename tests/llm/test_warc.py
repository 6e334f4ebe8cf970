import gzip
import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import warc as W
from millrace.llm.queries import OP8_SQL

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    big = ["é" * 700, "x" * 1000, "y" * 999]
    made = [(i, f"https://h{rng.randrange(5)}.example.org:8080/p{rng.randrange(9)}?q={i % 3}", rng.choice([*big, f"page {i} " * 200])) for i in range(300)]
    return made + [(400, None, None), (401, "", ""), (402, "not a url\n", "z" * 2000), (None, "http://a.b/", "n" * 1500), (404, "no host\tpath", "t" * 1500), (405, "http://t.example/a\tb", "t" * 1500), (406, "other", "t" * 1500), (403, "http://[bad", "r\r\n\r\nWARC/1.1\r\n" * 200), made[5], (-7, "http://h.example/", "x" * 1000)]


def wanted(rows):
    best = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        target = best.get(data)
        revisit = target is not None and target != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return out


def test_report(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit(1)).withColumn("_salt", F.lit(2))
    found = [tuple(r) for r in W.archive_report(df).collect()]
    assert sorted(found, key=str) == sorted(wanted(rows), key=str)
    assert W.archive_report(df.where("false")).collect() == []


def test_a_tab_in_the_url_of_a_response(spark):
    rows = [(2, "no host\tpath", "t" * 1500), (1, "a", "t" * 1500), (4, "http://t.example/a\tb\r\n", "u" * 1500), (3, "\t", "u" * 1500)]
    assert sorted(map(tuple, W.archive_report(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(wanted(rows))


def test_one_page_and_url_with_two_payloads(spark):
    """Against the SQL twin. The captures of one page differ by payload, and their lines fill several index blocks."""
    a, b = "A" * 1500, "B" * 2000
    rows = [(5, "u", a), (5, "u", b), (3, "v", b), (2, "v", a), (2, "v", b), (5, "w", a)] + [(9, "x", f"{i} " * 900) for i in range(40)] + [(8, "x", f"{i} " * 900) for i in range(40)] + [(9, "x", "7 " * 900)] * 30
    rows += [(9, "y", "1 " * 900), (7, "x", "7 " * 900)]
    found = sorted(map(tuple, W.archive_report(spark.createDataFrame(rows, SCHEMA)).collect()))
    pages = pa.table(dict(zip(("page_id", "url", "html"), map(list, zip(*rows)))))  # noqa: F841  the twin's table
    assert found == sorted(duckdb.sql(OP8_SQL).fetchall()) == sorted(wanted(rows))
    archive = W.write_archive(spark.createDataFrame(rows, SCHEMA), block_lines=4)
    manifest = archive.manifest.collect()
    assert len({m.capture_key for m in manifest}) == len({(m.page_id, m.url, m.payload_digest) for m in manifest}) == len(set(rows))
    held = W.lookup(archive, archive.manifest.where("record_type = 'response'").select("capture_key").distinct()).collect()
    digests = {m.capture_key: m.payload_digest for m in manifest}
    assert held and all(hashlib.sha1(r.payload).hexdigest() == digests[r.capture_key] for r in held)


def test_a_changed_payload_is_noticed():
    data = W.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert W.checked(*W.parse_record(data)) == b"payload"
    with pytest.raises(ValueError, match="digest"):
        W.checked(*W.parse_record(data.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")))


def test_files_and_lookups(spark, rows):
    archive = W.write_archive(spark.createDataFrame(rows, SCHEMA), block_lines=7, file_bytes=20_000)
    manifest = archive.manifest.collect()
    assert len(manifest) == len(rows) and len({m.file for m in manifest}) > 4
    for m in manifest[:40]:
        head, payload = W.parse_record(gzip.decompress(W.read_range(m.file, m.offset, m.length)))
        assert head["WARC-Type"] == m.record_type and head["WARC-Target-URI"] == m.url
        assert m.record_type == "revisit" or hashlib.sha1(payload).hexdigest() == m.payload_digest
    data = b"".join(W.read_range(manifest[0].file, 0, 1 << 30) for _ in range(1))
    assert gzip.decompress(data).count(b"WARC-Record-ID: ") == sum(m.file == manifest[0].file for m in manifest)
    keys = spark.createDataFrame([(m.capture_key,) for m in manifest] + [("zzz",), ("",), (None,), (manifest[0].capture_key + "x",)], "capture_key string")
    found = W.lookup(archive, keys.distinct()).collect()
    assert {r.capture_key for r in found} == {m.capture_key for m in manifest}
    places = {(m.capture_key, m.file, m.offset) for m in manifest}
    assert all((r.capture_key, r.file, r.offset) in places for r in found)
    parts = archive.parts.collect()
    assert sum(p.captures for p in parts) == len(rows) and all(p.first_key <= p.last_key for p in parts)


@pytest.mark.parametrize(
    "url,key",
    [
        ("https://www.Example.com/a?b=1", "com,example,www)/a?b=1"), ("http://x.org:81", "org,x:81)/"), ("nothing", "nothing"), ("http://[bad", "http://[bad"),
    ],
)
def test_reversed_host(url, key):
    assert W.reversed_host(url) == key
