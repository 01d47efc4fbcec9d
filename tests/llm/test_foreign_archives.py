"""Archives of other writers: other digests, folded headers, several records in a member, odd lengths."""

import base64
import gzip
import hashlib
import io

import pyarrow as pa
import pytest

from loomwise.llm import warc


def salvage(data, payloads=True):
    return list(warc.salvage(pa.PythonFile(io.BytesIO(data), "r"), payloads))


def record(block=b"HTTP/1.1 200 OK\r\n\r\nhello", **fields):
    return warc.record_bytes("response", {"Content-Type": "application/http", "WARC-Record-ID": "<a>"} | {k.replace("_", "-"): v for k, v in fields.items()}, block)


SHA1 = hashlib.sha1(b"hello")


@pytest.mark.parametrize(
    "said",
    ["sha1:" + SHA1.hexdigest(), "SHA1:" + SHA1.hexdigest().upper(), "sha1:" + base64.b32encode(SHA1.digest()).decode().lower(), "sha256:" + "0" * 64, "md5:xyz", "nonsense", ""],
)
def test_digests_of_any_form(spark, tmp_path, said):
    data = record(WARC_Payload_Digest=said, X_Payload_Length="many")
    assert [g[0] for g in salvage(data)] == ["record"]
    (tmp_path / "a.warc").write_bytes(data)
    r = warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc"),)], "path string")).first()
    assert (r["gap"], r["payload_digest"], r["payload_bytes"], bytes(r["payload"])) == (None, SHA1.hexdigest(), 5, b"hello")


def test_a_wrong_digest_is_damage():
    assert [g[0] for g in salvage(record(WARC_Payload_Digest="sha1:" + "0" * 40))] == ["gap"]


def test_folded_lines_and_several_records_in_a_member():
    folded = record(WARC_Target_URI="http://a/\r\n  long\r\n\tway")
    got = salvage(gzip.compress(folded + record()) + record())
    assert [g[0] for g in got] == ["record"] * 3 and got[0][1:3] == got[1][1:3]
    assert got[0][3]["warc-target-uri"] == "http://a/ long way"


def test_records_of_any_length_without_their_payloads():
    big = bytes(range(256)) * 20_000
    data = gzip.compress(record(b"HTTP/1.1 200 OK\r\n\r\n" + big)) + record()
    (kind, at, length, _, size, sha1, payload), last = salvage(data, payloads=False)
    assert (kind, at, size, sha1, payload) == ("record", 0, len(big), hashlib.sha1(big).hexdigest(), None)
    assert last[0] == "record" and length == last[1]
    assert salvage(data)[0][6] == big
    zeros = gzip.compress(record(b"HTTP/1.1 200 OK\r\n\r\n" + bytes(30_000_000)))
    assert [g[0] for g in salvage(zeros, payloads=False)] == ["record"]
    assert [g[0] for g in salvage(zeros[:-9], payloads=False)] == ["record", "gap"]  # the record is whole, its member isn't
    assert [g[0] for g in salvage(zeros[: len(zeros) // 2], payloads=False)] == ["gap"]
