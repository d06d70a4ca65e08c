"""Operator 7: exact round trips, pushed predicates, skipped payloads."""

import base64
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from postworks.llm import warc

ROWS = [(3, "http://a/3", "same"), (1, "http://a/1\r\nX: y", "same"), (2, None, "other ünï"), (4, "", None), (5, "http://a/5", ""), (None, "http://a/n", "same"), (1, "http://a/1\r\nX: y", "same"), (6, "http://a/6", "<p>\r\n\r\n</p>" * 20000)]


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.fixture
def archive(spark, tmp_path):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)
    return warc.write_archive(warc.to_records(df, "page_id", "url", "html"), f"file://{tmp_path}/w", file_bytes=300)


def test_round_trip(spark, archive):
    found = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read_archive(spark, archive, verify=True).collect()), key=repr)
    name = lambda i: f"urn:row:{'null' if i is None else i}"
    first = {"same": 1, "other ünï": 2, "": 4, ROWS[-1][2]: 6}
    expected = []
    for i, _, t in ROWS:
        t = t or ""
        again = i is not None and first[t] < i
        expected.append((name(i), "revisit" if again else "response", name(first[t]) if again else None, len(t.encode()), sha(t), None if again else t))
    assert found == sorted(expected, key=repr)


def test_uris_and_small_payloads(spark, archive, tmp_path):
    uris = {r.record_id: r.target_uri for r in warc.read_archive(spark, archive).collect()}
    assert uris["urn:row:1"] == "http://a/1%0D%0AX:%20y" and uris["urn:row:2"] is None and uris["urn:row:4"] is None
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert warc.to_records(df, "page_id", "url", "html", min_bytes=3).where("record_type = 'revisit'").count() == 0


def test_predicates_are_pushed_and_payloads_skipped(spark, archive):
    df = warc.read_archive(spark, archive, payload=False).where((F.col("record_type") == "revisit") & F.col("record_id").startswith("urn:row:"))
    assert sorted(r.record_id for r in df.collect()) == ["urn:row:3", "urn:row:5"]
    reader = warc.WarcReader(archive, {"payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    other = GreaterThan(("payload_bytes",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), other])) == [other]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["record_id"] for r in rows} == {"urn:row:3", "urn:row:5"} and all(r["payload"] is None for r in rows)


def test_other_files(spark, tmp_path):
    record = warc.record("response", "urn:a", "http://x/", "2024-01-01T00:00:00Z", None, b"body", warc.digest(b"body"), 4)
    import gzip

    (tmp_path / "plain.warc").write_bytes(record * 3)
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(record) * 2)
    found = warc.read_archive(spark, f"file://{tmp_path}", verify=True).collect()
    assert [bytes(r.payload) for r in found] == [b"body"] * 5 and len({(r.file, r.offset) for r in found}) == 5


def test_broken_payload_is_told(spark, tmp_path):
    record = warc.record("response", "urn:a", None, "d", None, b"body", warc.digest(b"other"), 4)
    (tmp_path / "x.warc").write_bytes(record)
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, f"file://{tmp_path}", verify=True).collect()


def test_files_of_lost_attempts_are_not_read(spark, archive):
    path = archive.removeprefix("file://")
    n = warc.read_archive(spark, archive).count()
    with open(os.path.join(path, "part-lost.warc.gz"), "wb") as f:
        f.write(b"junk")
    assert warc.read_archive(spark, archive).count() == n


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc.write_archive(warc.to_records(df, "page_id", "url", "html"), f"file://{tmp_path}/w")
    assert warc.read_archive(spark, path).count() == 0


def test_files_are_split_where_records_begin(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * (i % 7)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archive(warc.to_records(df, "page_id", "url", "html", min_bytes=1), f"file://{tmp_path}/w", file_bytes=20_000, split_bytes=500)
    parts = {}
    for size in (1, 400, 1100, 3000, 1 << 30):
        reader = warc.WarcReader(path, {"partition_bytes": str(size)})
        planned = reader.partitions()
        parts[size] = len(planned)
        ids = [r["record_id"] for p in planned for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(ids) == sorted(f"urn:row:{i}" for i in range(60))
    assert parts[1] > 20 and parts[1] >= parts[400] >= parts[1100] > parts[3000] > parts[1 << 30] == 1
