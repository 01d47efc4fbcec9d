"""Records that a salvage reader finds inside a damaged member, headers of other forms, and long urls."""

import gzip
import io

import pyarrow as pa
import pytest

from loomwise.llm import warc
from loomwise.session import scratch_path


def salvage(data, payloads=True):
    return list(warc.salvage(pa.PythonFile(io.BytesIO(data), "r"), payloads))


def pages(n, size=300):
    return [warc._page_records(k, f"http://{k}/", f"page {k} " * size, None)[0] for k in range(n)]


def ids(got):
    return [g[3]["warc-record-id"].strip("<>").rpartition(":")[2] for g in got if g[0] == "record"]


def test_a_member_with_one_bad_record_gives_the_others():
    rec = pages(6)
    bad = [r if k != 2 else r.replace(b"page 2 page", b"page X page", 1) for k, r in enumerate(rec)]
    data = gzip.compress(b"".join(bad))
    got = salvage(data + rec[0])
    assert ids(got) == ["0", "1", "3", "4", "5", "0"]
    assert [(g[0], g[3]) for g in got if g[0] == "gap"] == [("gap", "block digest differs")]
    assert {(g[1], g[2]) for g in got} == {(0, len(data)), (len(data), len(rec[0]))}


@pytest.mark.parametrize("hurt", [lambda r: r.replace(b"Content-Length: ", b"Content-Length: 9", 1), lambda r: r.replace(b"Content-Length: ", b"Content-Length: -", 1), lambda r: b"?" + r[1:], lambda r: r.replace(b"\r\n\r\n", b"\r\n", 1)])
def test_a_record_without_a_known_end_is_left_at_the_next_version_line(hurt):
    rec = pages(5)
    got = salvage(gzip.compress(rec[0] + hurt(rec[1]) + rec[2] + rec[3]) + gzip.compress(rec[4]))
    assert ids(got) == ["0", "2", "3", "4"] and any(g[0] == "gap" for g in got)


def test_a_member_that_is_cut_short_gives_what_came_before():
    rec = [warc._page_records(k, "u", "".join(chr(33 + (j * j * (k + 7)) % 90) for j in range(40_000)), None)[0] for k in range(4)]
    data = gzip.compress(b"".join(rec))
    got = salvage(data[: len(data) * 7 // 10])
    assert ids(got)[:2] == ["0", "1"] and got[-1][0] == "gap" and len(got) < 5
    last = gzip.compress(rec[3])
    assert ids(salvage(data[: len(data) * 7 // 10] + last))[-1] == "3"


def test_a_long_member_is_not_held(monkeypatch):
    monkeypatch.setattr(warc, "HELD", 5000)
    rec = pages(30)
    data = gzip.compress(b"".join(rec))
    for payloads in (True, False):
        got = salvage(data + data, payloads)
        assert len(got) == 60 and {(g[1], g[2]) for g in got} == {(0, len(data)), (len(data), len(data))}


def test_headers_without_carriage_returns():
    rec = pages(3)
    plain = lambda r: r.partition(b"\r\n\r\n")[0].replace(b"\r\n", b"\n") + b"\n\n" + r.partition(b"\r\n\r\n")[2]
    short = plain(rec[1])[:-4] + b"\n\n"
    assert ids(salvage(plain(rec[0]) + short + rec[2])) == ["0", "1", "2"]
    assert ids(salvage(gzip.compress(plain(rec[0]) + short) + gzip.compress(rec[2]))) == ["0", "1", "2"]


def test_no_page_is_lost_for_its_url(spark):
    """A url of 3 MB, of the longest that a header holds, and with signs that are encoded."""
    urls = ["http://a/" + "x" * 3_000_000, "http://b/" + "y" * (warc.URI - 9), "http://c/ \r\n\x00" + "z" * warc.URI, None, "short"]
    rows = [(k, u, "payload " * 200) for k, u in enumerate(urls)]
    found = warc.read_archives(warc.write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), scratch_path(spark, "warc")))
    got = found.where("gap IS NULL").collect()
    assert sorted(r["record_id"] for r in got if r["type"] in ("response", "revisit")) == [f"<urn:x-page:{k}>" for k in range(5)]
    long = {r["record_id"]: bytes(r["payload"]).decode() for r in got if r["type"] == "metadata"}
    assert long["<urn:x-url:0>"] == urls[0] and set(long) == {"<urn:x-url:0>", "<urn:x-url:2>"}
    assert found.where("gap IS NOT NULL").count() == 0
