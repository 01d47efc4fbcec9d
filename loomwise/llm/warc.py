"""WARC archives: a distributed writer with revisit records, and a salvage reader.

Each task writes one archive of gzip members, a member for each record, under a
temporary name that is renamed when it is whole, so that a repeated task leaves
the same file. Of equal payloads (SHA-256 and length) of at least ``min_bytes``
the largest page_id becomes a response, the others are revisits that refer to it.

The reader works on any mix of gzip members and plain records; a member may hold
several records, header lines may be folded and end without a carriage return. A
record whose version line, length, end or digests are wrong is quarantined: the
reader goes on at its end, or where that is not known at the next valid member or
version line, inside the member too, and logs the gap of bytes with the reason. Of
a member that ceases to decompress the records before that are given. Digests are SHA-1 in base32
or hex of either case; those of other algorithms are not verified. It reads in
chunks, and a record's digests are taken as its bytes pass, so that without
``payloads`` a record of any length needs no more memory than a chunk.

Defined results. A null html is an empty payload. A null page_id sorts lowest.
Rows that repeat the largest page_id with the same payload are all responses.
An empty table gives no archives and no rows; an archive that is all damage
gives gaps only. Control characters in a URL are percent-encoded. A URL of more
than 64 KiB is the block of a metadata record before its page's, which names it by
its SHA-1, as readers bound their headers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwise.llm.common import written
from loomwise.session import scratch_path

MIN_BYTES = 1000
CHUNK = 1 << 18
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: A record's header is at most so long, and a url in one of the writer's.
HEADER, URI = 1 << 20, 1 << 16
#: Bytes of a member's records that the reader holds before it looks for the member's end.
HELD = 1 << 24
BLANK = re.compile(rb"\r?\n\r?\n")
VERSION_LINE = re.compile(rb"WARC/1\.\d\r?\n[A-Za-z-]+:")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open_fs(uri: str):
    """The file system and path of a folder that all machines share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record, not compressed."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}"] + [f"{k}: {v}" for k, v in fields.items()]
    head += [f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _page_records(page_id, url, html, refers) -> list[bytes]:
    """A page's record, after one with its url if that is too long for a header."""
    payload = (html or "").encode("utf-8")
    http = HTTP.format(len(payload)).encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-none")
    name = "null" if page_id is None else str(page_id)
    before = []
    if len(uri.encode("utf-8")) > URI:  # readers bound their headers: the url becomes the block of a record of its own
        block = uri.encode("utf-8")
        uri = f"urn:sha1:{hashlib.sha1(block).hexdigest()}"
        before = [record_bytes("metadata", {"WARC-Record-ID": f"<urn:x-url:{name}>", "WARC-Target-URI": uri, "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "text/uri-list"}, block)]
    fields = {
        "WARC-Record-ID": f"<urn:x-page:{name}>",
        "WARC-Target-URI": uri,
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Payload-Digest": _sha1(payload),
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if refers is None:
        return [*before, record_bytes("response", fields, http + payload)]
    return [*before, record_bytes("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers}>"}, http)]


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives into ``folder``; a row for each archive: path, records, bytes."""
    pages = pages.select("page_id", "url", "html")
    low = F.lit(-(2**63))
    html = F.coalesce("html", F.lit(""))
    page = F.coalesce(F.col("page_id").cast("long"), low)
    sized = pages.select(page.alias("p"), F.sha2(html, 256).alias("d"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    first = sized.groupBy("d").agg(F.max("p").alias("first"), F.min("p").alias("least")).where("first <> least")
    again = written(spark, sized.join(first, "d").where("p <> first").select(F.col("p").alias("a_p"), F.col("d").alias("a_d"), "first").distinct(), "revisits")
    rows = pages.join(again, (page == again.a_p) & (F.sha2(html, 256) == again.a_d), "left").select(F.col("page_id").cast("long"), "url", "html", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, root = _open_fs(folder)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        temp, count, out = f"{name}.{task.taskAttemptId()}.tmp", 0, None
        for b in batches:
            for page_id, url, html, refers in zip(b["page_id"].astype(object), b["url"], b["html"], b["first"].astype(object), strict=True):
                if out is None:
                    fs.create_dir(root)
                    out = fs.open_output_stream(temp, compression=None)
                    out.write(member(record_bytes("warcinfo", {"WARC-Record-ID": f"<urn:x-archive:{task.partitionId()}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                known = lambda v: None if v is None or v != v else int(v)
                out.write(b"".join(map(member, _page_records(known(page_id), url, html, known(refers)))))
                count += 1
        if out is not None:
            out.close()
            fs.move(temp, name)
            yield pd.DataFrame({"path": [name], "records": [count], "bytes": [fs.get_file_info(name).size]})

    return written(spark, _exact_ids(rows).mapInPandas(run, "path string, records long, bytes long"), "archives")


def _exact_ids(rows: DataFrame) -> DataFrame:
    """Ids as text: pandas would make a column of longs with nulls floats."""
    return rows.select(F.col("page_id").cast("string"), "url", "html", F.col("first").cast("string"))


class _Bytes:
    """Random access to a file in chunks."""

    def __init__(self, f):
        self.f, self.size = f, f.size()

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(min(n, max(0, self.size - at)))

    def find(self, at: int) -> int:
        """Where the next gzip magic or version line begins, or the end of the file."""
        keep = 8
        while at < self.size:
            data = self.read(at, CHUNK)
            spots = [m.start() for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", data)]
            for s in spots:
                if self.looks_valid(at + s):
                    return at + s
            if at + len(data) >= self.size:
                break
            at += len(data) - keep
        return self.size

    def looks_valid(self, at: int) -> bool:
        head = self.read(at, 4096)
        if head.startswith(MAGIC):
            try:
                return zlib.decompressobj(31).decompress(head, 16).startswith(VERSION)
            except zlib.error:
                return False
        # a field follows a version line
        return bool(re.match(rb"WARC/1\.\d\r?\n[A-Za-z-]+:", head))


class Damaged(Exception):
    """A record or member that fails a check; ``whole``: a record that is read to its end all the same."""

    def __init__(self, reason: str, whole: bool = False):
        super().__init__(reason)
        self.reason, self.whole = reason, whole


class _Window:
    """The bytes of a member as they are inflated, or of the file itself, read forward."""

    def __init__(self, src: _Bytes, at: int, packed: bool):
        self.src, self.at, self.held, self.taken = src, at, b"", 0
        self.z = zlib.decompressobj(31) if packed else None
        self.over = False

    def _more(self) -> None:
        data = self.src.read(self.at, CHUNK)
        if self.z is None:
            self.at += len(data)
            self.over = not data
        else:
            try:
                out = self.z.decompress(data, 4 * CHUNK)
            except zlib.error:
                raise Damaged("member does not decompress") from None
            if not data and not out and not self.z.eof:
                raise Damaged("member is cut short")
            # what the limit left over is read again
            self.at += len(data) - len(self.z.unused_data if self.z.eof else self.z.unconsumed_tail)
            data = out
            self.over = self.z.eof
        self.held += data

    def _drop(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        self.taken += len(out)
        return out

    def end(self) -> int:
        """Where the bytes not yet taken begin, or, of a member, where it ends."""
        return self.at if self.z else self.at - len(self.held)

    def empty(self) -> bool:
        while not self.held and not self.over:
            self._more()
        return not self.held

    def header(self, most: int) -> bytes:
        """The bytes before a blank line, which is taken as well."""
        seen = 0
        while not (found := BLANK.search(self.held, max(0, seen - 3))):
            seen = len(self.held)
            if self.over or seen > most:
                raise Damaged("header does not end")
            self._more()
        out = self._drop(found.end())
        return out[: found.start()]

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if self.empty():
                raise Damaged("length differs")
            piece = self._drop(n)
            n -= len(piece)
            yield piece

    def starts(self, mark: bytes) -> bool:
        """Whether the next bytes are a mark, which is taken then."""
        while len(self.held) < len(mark) and not self.over:
            self._more()
        found = self.held.startswith(mark)
        if found:
            self._drop(len(mark))
        return found

    def to_version(self) -> None:
        """Drop what comes before the next version line, or all there is."""
        while not (found := VERSION_LINE.search(self.held)):
            if self.over:
                self._drop(len(self.held))
                return
            self._drop(len(self.held) - 256)
            self._more()
        self._drop(found.start())

    def rest(self) -> None:
        """Read to the end and keep nothing."""
        while not self.over:
            self._drop(len(self.held))
            self._more()
        self._drop(len(self.held))


def _fields(head: bytes) -> dict[str, str]:
    lines = re.split(r"\r?\n", re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace"))
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise Damaged("no version line")
    out: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise Damaged("bad header line")
        out[k.strip().lower()] = v.strip()
    if not re.fullmatch(r"[0-9]+", out.get("content-length", "")):
        raise Damaged("no length")
    return out


def sha1_of(said: str) -> str | None:
    """The hex form of a SHA-1 digest field in base32 or hex; null for another algorithm or form."""
    kind, _, value = said.partition(":")
    if kind.strip().lower().replace("-", "") != "sha1":
        return None
    value = value.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    if re.fullmatch(r"[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return None


def _record(src: _Window, payloads: bool) -> tuple[dict[str, str], int, str, bytes | None]:
    """The next record's fields, payload size and SHA-1, and payload if wanted, after its digests are verified."""
    fields = _fields(src.header(HEADER))
    of_block, of_payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
    http = b"" if fields.get("content-type", "").startswith("application/http") else None
    for piece in src.take(int(fields["content-length"])):
        of_block.update(piece)
        if http is not None:  # still in the header of the response
            http += piece
            blank = BLANK.search(http)
            piece = http[blank.end() :] if blank else b""
            if not blank:
                if len(http) > HEADER:
                    raise Damaged("the response's header does not end")
                continue
            http = None
        of_payload.update(piece)
        size += len(piece)
        if payloads:
            kept.append(piece)
    if not src.starts(b"\r\n\r\n") and not src.starts(b"\n\n"):
        raise Damaged("length differs")
    said = sha1_of(fields.get("warc-block-digest", ""))
    if said and said != of_block.hexdigest():
        raise Damaged("block digest differs", True)
    said = sha1_of(fields.get("warc-payload-digest", ""))
    if fields.get("warc-type") == "response" and said and said != of_payload.hexdigest():
        raise Damaged("payload digest differs", True)
    return fields, size, of_payload.hexdigest(), b"".join(kept) if payloads else None


class _Member:
    """What a member holds: its verified records, and the reasons why others are not given."""

    def __init__(self, src: _Bytes, at: int, payloads: bool):
        self.src, self.at, self.payloads, self.end = src, at, payloads, None

    def items(self) -> Iterator[tuple]:
        """("record", ...) and ("gap", reason); after the last one ``end`` is where the member ends, or null if nobody knows."""
        window = _Window(self.src, self.at, True)
        begin = 0
        while True:
            try:
                if window.empty():
                    break
                begin = window.taken
                yield "record", *_record(window, self.payloads)
            except Damaged as e:
                yield "gap", e.reason
                if "member" in e.reason:  # nothing after this can be inflated
                    return
                try:
                    if not e.whole:  # its length can't be trusted, so the next record is looked for from its first bytes on
                        window = _Window(self.src, self.at, True)
                        for _ in window.take(begin + 1):
                            pass
                    window.to_version()
                except Damaged as broken:
                    yield "gap", broken.reason
                    return
        self.end = window.end()


def _end_of(src: _Bytes, at: int) -> int:
    """Where a member ends, or what comes after it begins if it is broken."""
    window = _Window(src, at, True)
    try:
        window.rest()
    except Damaged:
        return src.find(at + 1)
    return window.end()


def salvage(f, payloads: bool = True) -> Iterator[tuple]:
    """("record", offset, length, fields, size, sha1, payload) and ("gap", offset, length, reason), in order.

    Offsets and lengths tile the file. All records of one member, and the reasons
    for those of it that fail, share its offset and length. A few records are held
    until the end of their member is known; for more, it is looked for first.
    """
    src, at = _Bytes(f), 0
    while at < src.size:
        start = src.read(at, 8)
        if start.startswith(MAGIC):
            member, held, size, end = _Member(src, at, payloads), [], 0, None
            for kind, *what in member.items():
                if end is not None:
                    yield kind, at, end - at, *what
                    continue
                held.append((kind, *what))
                size += 1024 + len(what[-1] or b"") if kind == "record" else 1024
                if size > HELD:
                    end = _end_of(src, at)
                    yield from ((k, at, end - at, *w) for k, *w in held)
                    held = []
            if end is None:
                end = member.end or src.find(at + 1)
                yield from ((k, at, end - at, *w) for k, *w in held)
        else:
            window = _Window(src, at, False)
            try:
                if not start.startswith(VERSION):
                    raise Damaged("neither a member nor a version line")
                record = _record(window, payloads)
                end = window.end()
                yield "record", at, end - at, *record
            except Damaged as e:
                end = window.end() if e.whole else src.find(at + 1)
                yield "gap", at, end - at, e.reason
        at = end


RECORD = "archive string, offset long, length long, gap string, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of archives (path): a row each; ``gap`` is the reason, null for records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for b in batches:
            for path in b["path"]:
                fs, name = _open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for got in salvage(f, payloads):
                        if got[0] == "gap":
                            rows.append((path, *got[1:3], got[3], *[None] * 7))
                        else:
                            fields, size, sha1, payload = got[3:]
                            length = fields.get("x-payload-length", "")
                            of = [fields.get(k) for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to")]
                            # a revisit names the digest and size of the payload that it leaves out
                            digest = sha1_of(fields.get("warc-payload-digest", "")) or (sha1 if of[0] != "revisit" else None)
                            rows.append((path, *got[1:3], None, *of, digest, int(length) if re.fullmatch(r"[0-9]{1,18}", length) else size, payload))
                            held += len(payload or b"")
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    # one row for each archive: a stated number of tasks, as Spark would join such small partitions into one
    return archives.select("path").repartition(max(1, archives.count())).mapInPandas(run, RECORD)


def op7_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = write_archives(spark, pages, scratch_path(spark, "warc"))
    page_of = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-page:(.*)>$', 1) AS bigint)")
    return (
        read_archives(archives, payloads=False)
        .where("type IN ('response', 'revisit')")
        .select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"))
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN b USING (h)
"""
