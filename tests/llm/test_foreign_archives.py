"""Archives of other writers: other record types, base-32 digests, revisits by record id or by URI and date."""

import base64
import gzip
import hashlib

import pytest

from loomshed.llm import warc

BODY = b"<p>" + b"x" * 1200


def b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, block: bytes, version: str = "1.0", **headers: str) -> bytes:
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length:{len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(body: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body


RECORDS = [
    record("warcinfo", b"software: other\r\n", WARC_Record_ID="<urn:0>"),
    record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:1>"),
    record("response", http(BODY), WARC_Record_ID="<urn:2>", WARC_Target_URI="http://a/", WARC_Date="2020", WARC_Payload_Digest=b32(BODY)),
    record("response", http(b"other"), version="1.1", warc_record_id="<urn:3>", warc_target_uri="http://b/", warc_date="2021"),
    record("revisit", http(b""), WARC_Record_ID="<urn:4>", WARC_Refers_To="<urn:2>", WARC_Payload_Digest=b32(BODY)),
    record("revisit", b"", WARC_Record_ID="<urn:5>", WARC_Refers_To_Target_URI="http://b/", WARC_Refers_To_Date="2021"),
    record("revisit", b"", WARC_Record_ID="<urn:6>", WARC_Refers_To="<urn:gone>", WARC_Payload_Digest=b32(BODY)),
    record("revisit", b"", WARC_Record_ID="<urn:7>", WARC_Refers_To="<urn:3>", WARC_Payload_Digest=b32(BODY)),
    record("resource", b"plain\r\n\r\nblock", WARC_Record_ID="<urn:8>"),
    record("metadata", b"via: x", WARC_Record_ID="<urn:9>"),
]


def test_records_of_other_writers(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS[:5]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(RECORDS[5:])))
    found = warc.read_archives(spark, str(tmp_path), payloads=True)
    got = {r.record_id: r for r in warc.resolve(found).collect()}
    assert got.keys() == {f"<urn:{i}>" for i in (2, 3, 4, 5, 6, 7, 8)}
    sha = {n: hashlib.sha1(b).hexdigest() for n, b in ((2, BODY), (3, b"other"))}
    told = {i: (got[f"<urn:{i}>"].record_type, got[f"<urn:{i}>"].payload_bytes, got[f"<urn:{i}>"].payload_digest) for i in range(2, 9)}
    assert told[2] == ("response", len(BODY), sha[2]) and told[3] == ("response", 5, sha[3])
    assert told[4] == ("revisit", len(BODY), sha[2]) and told[5] == ("revisit", 5, sha[3])
    assert told[6] == ("revisit", None, sha[2]) and told[7] == ("revisit", None, sha[2])
    assert got["<urn:8>"].payload == b"plain\r\n\r\nblock" and got["<urn:8>"].record_type == "response"
    assert all(r.page_id is None for r in got.values())


def test_a_payload_that_belies_its_digest_raises(spark, tmp_path):
    bad = record("response", http(b"changed"), WARC_Record_ID="<urn:1>", WARC_Payload_Digest=b32(BODY))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(bad))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_digests_in_every_form():
    sha = hashlib.sha1(BODY).hexdigest()
    assert warc.sha1_of(f"sha1:{sha.upper()}") == warc.sha1_of(b32(BODY)) == warc.sha1_of(b32(BODY).replace("sha1", "SHA1").lower()) == sha
    assert warc.sha1_of("md5:00") is None and warc.sha1_of(None) is None
