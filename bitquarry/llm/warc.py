"""WARC archives: a deduplicating writer and a salvage reader.

Archives are bytes: rows (segment, content), each a run of gzip members with a
record in each.  They are written by Spark as a table, so any store that Spark
reaches can hold them; ``spark.read.format("binaryFile")`` gives the same two
columns for archives that others wrote.

The reader trusts nothing.  A member must inflate and pass its checksum, a
record must start with a version line, have a length, all its bytes and the
digests that its headers state.  After a failed check it searches for the next
member or version line that passes, goes on from there, and reports the bytes
in between as a quarantined gap with offset, length and reason.  Its time is
linear in an archive's bytes, apart from members that inflate far before they
fail; a gap's candidates are each tried once.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.llm.tables import checked, cut

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_HEADER_END = re.compile(rb"\r?\n\r?\n")
_ID = "urn:page:"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; line ends in values become spaces."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(str(v).splitlines())}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without payload where refers_to is given."""
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        return record_bytes([*headers, ("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record_bytes([*headers, ("WARC-Block-Digest", f"sha256:{sha256(block)}"), ("Content-Type", "application/http;msgtype=response")], block)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at a position; ValueError says which check failed."""
    if not (v := _VERSION.match(data, at)):
        raise ValueError("no version line")
    if not (end := _HEADER_END.search(data, v.end() - 1)):
        raise ValueError("headers without end")
    headers = {}
    for line in data[v.end() : end.start()].decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("no content length")
    begin, stop = end.end(), end.end() + int(length)
    if stop > len(data):
        raise ValueError("block cut short")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("no end of record after the block")
    block = data[begin:stop]
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", payload := _payload(headers, block))):
        algorithm, colon, stated = headers.get(name, "").partition(":")
        if colon and algorithm == "sha256" and not (part is payload and headers.get("warc-type") == "revisit") and sha256(part) != stated:
            raise ValueError(f"{name} differs")
    return headers, payload, stop + 4


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    end = _HEADER_END.search(block)
    return block[end.end() :] if end else b""


def read_stream(data: bytes, base: int = 0) -> Iterator[tuple]:
    """Records and gaps of uncompressed bytes: (offset, length, headers, payload) or (offset, length, None, reason)."""
    at = 0
    while at < len(data):
        try:
            headers, payload, end = parse_record(data, at)
        except ValueError as e:
            begin, reason = at, str(e)
            while True:
                v = _VERSION.search(data, at + 1)
                at = v.start() if v else len(data)
                try:
                    if v:
                        parse_record(data, at)
                    break
                except ValueError:
                    continue
            yield base + begin, at - begin, None, reason
            continue
        yield base + at, end - at, headers, payload
        at = end


class Damaged(ValueError):
    """A failed gzip member; content is what it gave before the damage."""

    def __init__(self, reason: str, content: bytes = b""):
        super().__init__(reason)
        self.content = content


def inflate(data: bytes, at: int, chunk: int = 1 << 16, most: int = 1 << 31) -> tuple[bytes, int]:
    """(content, end) of the gzip member at a position; Damaged if it fails a check or has over ``most`` bytes.

    It is fed chunk by chunk, so what follows the member is never copied; a
    damaged chunk is fed again in small pieces for what it holds before the damage.
    """
    z, view = zlib.decompressobj(31), memoryview(data)
    out, size = [], 0
    while not z.eof:
        if at >= len(data):
            raise Damaged("gzip: member cut short", b"".join(out))
        part = view[at : at + chunk]
        before = z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            for step in (256, 1):
                with contextlib.suppress(zlib.error):
                    while part:
                        again = before.copy()
                        out.append(before.decompress(part[:step]))
                        part = part[step:]
                before = again
            raise Damaged(f"gzip: {e}", b"".join(out)) from None
        at += len(part)
        size += len(out[-1])
        if size > most:
            raise Damaged("gzip: member too large", b"".join(out))
    return b"".join(out), at - len(z.unused_data)


def _proved(headers: dict[str, str]) -> bool:
    """Whether the record's digests, which parse_record has compared, cover its block."""
    return headers.get("warc-block-digest", "").startswith("sha256:") or headers.get("warc-payload-digest", "").startswith("sha256:") and headers.get("warc-type") != "revisit"


def _starts(data: bytes, at: int) -> Iterator[int]:
    """Places from a position on where a member or a version line may begin, in order; each kind is searched once."""
    magic, version = data.find(_MAGIC, at), _VERSION.search(data, at)
    while magic >= 0 or version:
        if magic >= 0 and (not version or magic < version.start()):
            yield magic
            magic = data.find(_MAGIC, magic + 1)
        else:
            yield version.start()
            version = _VERSION.search(data, version.start() + 1)


def _read_at(data: bytes, at: int) -> tuple[list[tuple], int]:
    """(records and inner gaps, end) of the member or plain record at a position; Damaged or ValueError if it fails."""
    if data[at : at + 3] != _MAGIC:
        headers, payload, end = parse_record(data, at)
        return [(headers, payload)], end
    content, end = inflate(data, at)
    return [(headers, payload) for _, _, headers, payload in read_stream(content)], end


def read_archive(data: bytes) -> Iterator[tuple]:
    """Records and gaps of an archive of gzip members, plain records or both.

    Yields (offset, length, headers, payload), or (offset, length, None, reason)
    for a gap.  Offsets and lengths are in the archive as stored; of records that
    share a member, all have that member's place.  After a failed check the
    nearest later member or version line that passes is taken.  Records that a
    damaged member gave before its damage are kept if their digests prove them;
    they have the place of the gap that follows.
    """
    at = 0
    while at < len(data):
        try:
            found, end = _read_at(data, at)
        except ValueError as e:
            saved = e.content if isinstance(e, Damaged) else b""
            begin, reason, at, found = at, str(e), len(data), []
            kept = [(headers, payload) for _, _, headers, payload in read_stream(saved) if headers is not None and _proved(headers)]
            for start in _starts(data, begin + 1):
                try:
                    found, end = _read_at(data, start)
                except ValueError:
                    continue
                # A member that stores its bytes as they are shows the same records again.
                if found and found[0] in kept:
                    found = []
                    continue
                at = start
                break
            for headers, payload in kept:
                yield begin, at - begin, headers, payload
            yield begin, at - begin, None, reason
            if at == len(data):
                return
        for headers, payload in found:
            yield at, end - at, headers, payload
        at = end


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each page.

    Null payloads are empty; those under ``least_bytes`` never refer.  Rows that
    repeat the smallest id of their payload are all responses; a null id is the
    smallest only where the payload has no other, and then all are responses.
    An empty table gives no rows; other columns play no part.

    Digests are grouped with partial aggregation.  Those of two or more pages are
    written and joined back: broadcast if they are few (``checked``), else by a
    shuffle in which Spark splits a hot digest's rows.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = cut(p.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("shared"), "first_id"))
    return p.join(checked(shared), p.digest == shared.shared, "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archives(planned: DataFrame, segment_bytes: int = 2_000_000, level: int = 3) -> DataFrame:
    """Rows of plan_revisits as archives (segment, content): gzip members, a warcinfo record first, about segment_bytes each."""
    schema = pa.schema([("segment", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []

        def out() -> pa.RecordBatch:
            name = f"part-{part:06d}-{made:05d}.warc.gz"
            info = member(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:segment:{name}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n"), level)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([info + b"".join(parts)], pa.binary())], schema=schema)

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(member(page_record(*row), level))
                size += len(parts[-1])
                if size >= segment_bytes:
                    yield out()
                    parts, size, made = [], 0, made + 1
        if parts:
            yield out()

    return planned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "segment string, content binary")


_READ = "segment string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, gap_reason string"


def read_archives(archives: DataFrame, name_col: str = "segment", content_col: str = "content", with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record, and one for each quarantined gap (record_type null, gap_reason says why).

    payload_bytes and payload_digest are of the payload as read; a revisit has
    those that it states.  Empty or null archives give no rows.
    """
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip((x.split()[0] for x in _READ.split(", ")), types)))

    def of(name: str, item: tuple) -> tuple:
        offset, length, h, x = item
        if h is None:
            return name, offset, length, None, None, None, None, None, None, None, x
        ids = [h[k].strip("<>") if k in h else None for k in ("warc-record-id", "warc-refers-to")]
        if h.get("warc-type") == "revisit":
            n = h.get("x-payload-length", "")
            facts = int(n) if n.isdigit() else None, h.get("warc-payload-digest", "").removeprefix("sha256:")
        else:
            facts = len(x), sha256(x)
        return name, offset, length, h.get("warc-type"), ids[0], h.get("warc-target-uri"), ids[1], *facts, x if with_payload else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows, size = [], 0
                for x in read_archive(content or b""):
                    rows.append(of(name, x))
                    size += len(rows[-1][9] or b"") + 200
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    return archives.select(F.col(name_col).alias("segment"), F.col(content_col).alias("content")).mapInArrow(run, _READ)


def page_rows(records: DataFrame) -> DataFrame:
    """The page records as rows (page_id, payload_bytes, payload_digest, record_type, refers_to, segment, offset)."""
    number = lambda c: F.when(F.length(c) > len(_ID), F.substring(c, len(_ID) + 1, 20)).cast("long")
    return records.where(F.col("record_type").isin("response", "revisit")).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "segment", "offset")
