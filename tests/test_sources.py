"""Scans and sinks on small files."""

import hashlib
from datetime import date

import pytest

from opsloom.operators.traces import verify_digests
from opsloom.sources import scan, sinks


def test_flow_record_nulls_and_times(spark, tmp_path):
    fields = ["5", "1", "eni-1", "10.0.0.1", "10.0.0.2", "443", "5432", "6", "3", "180", "1700000000", "1700000060", "REJECT", "OK"] + ["-"] * 15
    (tmp_path / "a.log").write_text(" ".join(fields) + "\n")
    row = scan.scan_flow_logs(spark, str(tmp_path)).first()
    assert (row["bytes"], row["vpc_id"], str(row["start"]), str(row["date"])) == (180, None, "2023-11-14 22:13:20", "2023-11-14")


def test_cdn_records_skip_comments(spark, tmp_path):
    line = "\t".join(["2024-01-01", "00:00:01", "FRA", "512", "1.2.3.4", "GET", "h", "/a", "200", "-", "agent", "-", "Hit", "id1"])
    (tmp_path / "a.log").write_text("#Version: 1.0\n#Fields: date\n" + line + "\n")
    row = scan.scan_cdn_logs(spark, str(tmp_path)).first()
    assert (row["sc_bytes"], row["sc_status"], row["cs_uri_query"], row["x_edge_result_type"]) == (512, 200, None, "Hit")


def test_access_lines(spark):
    lines = ['203.0.113.42 - - [18/Jul/2026:10:30:15 +0000] "GET /api/users HTTP/1.1" 200 1234 "https://example.com" "Mozilla/5.0"',
             '1.1.1.1 - bob [18/Jul/2026:10:30:15 +0200] "POST /x HTTP/1.1" 502 - "-" "-" rt=2.500 urt=- cs=MISS', "broken", None]
    good, bad = scan.parse_access_log(spark.createDataFrame([(x,) for x in lines], "line string"))
    a, b = good.orderBy("status").collect()
    assert (a["client"], a["path"], a["bytes"], a["referer"], a["rt"]) == ("203.0.113.42", "/api/users", 1234, "https://example.com", None)
    assert (b["user"], b["status"], b["bytes"], b["rt"], b["urt"], b["cache"], b["agent"]) == ("bob", 502, 0, 2.5, None, "MISS", "-")
    assert b["ts"].hour == 8
    assert bad.count() == 2


def test_projection_skips_missing_folders(spark, tmp_path):
    (tmp_path / "1" / "r1" / "2026" / "01" / "02").mkdir(parents=True)
    fields = ["5", "1", "eni-1", "a", "b", "1", "2", "6", "3", "180", "1700000000", "1700000060", "ACCEPT", "OK"] + ["-"] * 15
    (tmp_path / "1" / "r1" / "2026" / "01" / "02" / "x.log").write_text(" ".join(fields) + "\n")
    template = f"{tmp_path}/${{acc}}/${{zone}}/${{day}}"
    found = scan.scan_projected(spark, template, {"acc": ["1", "2"], "zone": ["r1", "r2"]}, (date(2026, 1, 1), date(2026, 1, 3)))
    row = found.first()
    assert (found.count(), row["acc"], row["zone"], row["day"]) == (1, "1", "r1", "2026/01/02")
    none = scan.scan_projected(spark, template, {"acc": ["7"], "zone": ["r1"]}, (date(2026, 1, 1), date(2026, 1, 3)))
    assert none.count() == 0 and set(found.columns) == set(none.columns)


def test_file_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    found = scan.scan_files(spark, str(tmp_path), "*.bin").withColumnRenamed("name", "key")
    listed = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", "0"), ("c.bin", "1")], "key string, digest string")
    states = {r["key"]: r["state"] for r in verify_digests(found, listed, "key").collect()}
    assert states == {"a.bin": "match", "b.bin": "mismatch", "c.bin": "missing file"}


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        sinks.partition_value("circle", "x")


def test_avro_needs_its_connector(spark):
    df = spark.createDataFrame([(bytearray(b"\x02"),)], "body binary")
    with pytest.raises(Exception):
        scan.decode(df, "body", "avro", '{"type": "int"}').collect()
    with pytest.raises(ValueError):
        scan.decode(df, "body", "xml", "")


def test_enum_product():
    assert scan.enum_product({"a": ["1", "2"], "b": ["x"]}) == [{"a": "1", "b": "x"}, {"a": "2", "b": "x"}]
