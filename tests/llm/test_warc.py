import base64
import hashlib

import pytest
from pyspark.errors import PySparkException

from seamline.llm.warc import Archive, read_archives, with_originals, write_archives

SCHEMA = "page_id bigint, url string, html string, digest string, original int"
PAGES = [
    (1, "http://a.example/x", "<p>same</p>"),
    (2, "http://b.example/ü?q=1#f", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (4, "http://c.example/\r\nX: 1", None),
    (5, "http://c.example/", ""),
    (6, "http://d.example/", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 3),
    (7, "http://e.example/", "long " * 40_000),
    (None, "http://f.example/", "<p>same</p>"),
    (None, "http://g.example/", "<p>without a page</p>"),
    (None, "http://g.example/", "<p>without a page</p>"),
    (8, "http://h.example/", "\x00 \n\n"),
]


def expected(least):
    out = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        twins = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        original = max(twins, default=None)
        revisit = len(payload) >= least and original is not None and page != original
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = ("revisit", original) if revisit else ("response", None)
        out.append((page, len(payload), digest, *kind))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], SCHEMA).repartition(3)
    path = str(tmp_path / "archive")
    write_archives(pages, path, Archive(least=least, records=2))
    records = read_archives(spark, path)
    found = with_originals(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect()), key=repr) == expected(least)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in records.where("payload IS NOT NULL").collect()}
    assert all(payloads[p] == (h or "").encode() for p, _, h in PAGES if p in payloads and p is not None)
    assert records.where("payload IS NULL").count() == sum(k == "revisit" for *_, k, _ in expected(least))


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert read_archives(spark, str(tmp_path / "none")).collect() == []


def test_a_damaged_archive_is_noticed(spark, tmp_path):
    import glob
    import gzip

    page = spark.createDataFrame([(1, "u", "payload", "d", 1)], SCHEMA).coalesce(1)
    write_archives(page, str(tmp_path / "a"))
    (part,) = glob.glob(str(tmp_path / "a" / "*.gz"))
    with open(part, "rb") as file:
        data = gzip.decompress(file.read())
    damaged = tmp_path / "damaged"
    damaged.mkdir()
    (damaged / "part.gz").write_bytes(gzip.compress(data.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload")))
    with pytest.raises(PySparkException, match="does not fit its header"):
        read_archives(spark, str(damaged)).collect()
