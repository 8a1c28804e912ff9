"""Functions that no query reaches."""

import datetime

from pyspark.sql import functions as F

from lurewatch.functions import text as T
from lurewatch.operators import enrich, findings
from lurewatch.sources import messages


def test_feeds_of_addresses_and_scans(spark):
    raw = spark.createDataFrame([("1.2.3.4", '{"data": {"abuseConfidenceScore": 90, "totalReports": 3, "countryCode": "XX", "isp": "I", "isTor": true}}'), ("5.6.7.8", None), ("9.9.9.9", "no json")], "indicator string, body string")
    got = {r["indicator"]: r for r in enrich.read_reputation(raw, "ip_abuse").collect()}
    a = got["1.2.3.4"]
    assert (a["found"], a["abuse_confidence_score"], a["total_reports"], a["country_code"], a["isp"], a["is_tor"]) == (True, 90, 3, "XX", "I", True)
    assert not got["5.6.7.8"]["found"] and got["9.9.9.9"]["abuse_confidence_score"] is None
    scans = spark.createDataFrame([("u", '{"verdicts": {"overall": {"malicious": true, "score": 7, "categories": ["phishing"]}}, "page": {"url": "https://f.example/", "domain": "f.example"}}'), ("v", "{}")], "indicator string, body string")
    got = {r["indicator"]: r for r in enrich.read_reputation(scans, "url_scan").collect()}
    assert (got["u"]["malicious"], got["u"]["score"], got["u"]["categories"], got["u"]["final_domain"]) == (True, 7, ["phishing"], "f.example")
    assert (got["v"]["found"], got["v"]["malicious"], got["v"]["score"], got["v"]["categories"], got["v"]["final_url"]) == (True, False, 0, [], None)


def test_finding_by_id(spark):
    df = spark.createDataFrame([(1, '["a", "b"]', '{"urls": "x"}'), (2, "[]", "{}")], "id long, key_indicators string, enrichment string")
    r = findings.finding_by_id(df, 1).collect()
    assert len(r) == 1 and r[0]["key_indicators"] == ["a", "b"] and r[0]["enrichment"] == {"urls": "x"} and findings.finding_by_id(df, 3).count() == 0


def test_failures(spark):
    df = spark.createDataFrame([("gmail", "1", None), ("yahoo", "2", "away")], "source string, message_id string, error string")
    assert [tuple(r) for r in findings.failures(df).collect()] == [("yahoo", "2", "away")]


def test_no_indicator_at_all(spark):
    df = spark.createDataFrame([("nothing here", "A <a@b.example>"), ("see http://x.example/", "a@b.example"), (None, None)], "body string, sender string")
    assert [r["e"] for r in df.select(T.is_empty(T.extract_iocs(F.coalesce("body", F.lit("")), F.col("sender"))).alias("e")).collect()] == [True, False, True]


def test_attachments_from_folders(spark, tmp_path):
    for mail, name, data in (("m1", "0_a.txt", b"one"), ("m1", "1_b c.bin", b"\x00\x01"), ("m2", "0_.x", b"q"), ("m2", "unnumbered", b"z")):
        (tmp_path / mail).mkdir(exist_ok=True)
        (tmp_path / mail / name).write_bytes(data)
    got = {(r["email_id"], r["att_idx"]): (r["filename"], r["size"], bytes(r["data"])) for r in messages.read_attachments(spark, str(tmp_path)).collect()}
    assert got[("m1", 0)] == ("a.txt", 3, b"one") and got[("m1", 1)][1:] == (2, b"\x00\x01") and got[("m2", 0)] == (".x", 1, b"q") and len(got) == 3


def test_logs_of_one_document_each_come_back_in_the_order_of_their_names(spark, tmp_path):
    for name, body in (("20240102T000000Z_gmail_b.json", '{\n "source": "gmail", "email_id": "b", "verdict": "malicious"\n}'), ("20240101T000000Z_yahoo_a.json", '{"source": "yahoo", "email_id": "a"}'), ("20240103T000000Z_gmail_c.json", '{"email_id": "c", "key_indicators": ["x"]}')):
        (tmp_path / name).write_text(body)
    got = [(r["position"], r["log"], r["source"], r["email_id"], r["verdict"], r["key_indicators"]) for r in messages.import_result_logs(spark, str(tmp_path), whole_files=True).orderBy("position").collect()]
    assert got == [(1, "20240101T000000Z_yahoo_a", "yahoo", "a", "unknown", "[]"), (2, "20240102T000000Z_gmail_b", "gmail", "b", "malicious", "[]"), (3, "20240103T000000Z_gmail_c", "gmail", "c", "unknown", '["x"]')]


def test_logs_written_are_named_by_time_source_and_id(spark, tmp_path):
    df = spark.createDataFrame([("gmail", "1", datetime.datetime(2024, 1, 2, 3, 4, 5)), ("yahoo", "2", None)], "source string, email_id string, processed_at timestamp")
    messages.write_result_logs(df, f"{tmp_path}/logs")
    got = {r["email_id"]: (r["log"], r["source"]) for r in messages.import_result_logs(spark, f"{tmp_path}/logs").collect()}
    assert got["1"] == ("20240102T030405Z_gmail_1", "gmail") and got["2"][0].endswith("_yahoo_2")
