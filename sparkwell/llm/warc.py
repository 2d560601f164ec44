"""WARC archives: a writer of gzip members, and a reader that salvages what lies behind damage.

The reader takes bytes of any archive, gzip members or plain.  It checks each record: version line, headers, length,
trailer, and the SHA-256 of block and payload where the headers carry one.  After a failed check it searches for the
next member (or version line) that passes, goes on there, and logs the bytes between as a quarantined gap.

Archives are rows of a table in the shared folder: (archive, part, content), a few MB to a part, each part whole members.
A record whose payload of LEAST_REVISIT bytes or more equals that of a page with a smaller id is a revisit: headers
only, the HTTP header with the payload's length included.

Defined cases: a null html is an empty payload; a null url is an empty target; a null page_id is written without a
page number and comes back null (it never becomes what others refer to; where no page of a payload has a number, all are responses); pages with
the same id and payload are each a record, response if their id is the smallest; a page of any length is one record, in a
part of its own if need be; an empty table gives no records; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import frequent, slices, table, written

LEAST_REVISIT, LEVEL, PART_BYTES = 100, 1, 4 << 20
#: Digests of repeated payloads that are broadcast, some 100 bytes each: all if they are no more, or else the most frequent.
HOT = 200_000
#: Bytes that are inflated at a time.
STEP = 1 << 16
VERSION, GZIP = b"WARC/1.1\r\n", b"\x1f\x8b\x08"
#: Archives of the same pages are the same bytes.
DATE = b"2024-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(number: bytes, url: bytes, payload: bytes, digest: bytes, refers_to: bytes | None) -> bytes:
    """One record; refers_to: the number of the page whose response has this payload, None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        VERSION, b"WARC-Type: ", b"response" if refers_to is None else b"revisit", b"\r\nWARC-Record-ID: <urn:page:", number, b">\r\nWARC-Date: ", DATE,
        b"\r\nWARC-Target-URI: ", re.sub(rb"[\x00-\x20\x7f]", b"%20", url), b"\r\nWARC-Payload-Digest: sha256:", digest,
        b"\r\nWARC-Block-Digest: sha256:", hashlib.sha256(block).hexdigest().encode(),
    ]
    if refers_to is not None:
        head += [b"\r\nWARC-Profile: ", PROFILE, b"\r\nWARC-Refers-To: <urn:page:", refers_to, b">"]
    head += [b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"]
    return b"".join(head)


def member(data: bytes, level: int = LEVEL) -> bytes:
    """data as one gzip member without a time stamp."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at data[at:] and where it ends; Damaged if any check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Damaged("version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        head[name.strip().lower()] = value.strip()
    try:
        length = int(head[b"content-length"])
    except (KeyError, ValueError):
        raise Damaged("content length") from None
    start, stop = end + 4, end + 4 + length
    if length < 0 or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("trailer")
    block = data[start:stop]
    kind = head.get(b"warc-type", b"")
    if (want := head.get(b"warc-block-digest", b"")).startswith(b"sha256:") and hashlib.sha256(block).hexdigest().encode() != want[7:]:
        raise Damaged("block digest")
    http, _, payload = block.partition(b"\r\n\r\n") if head.get(b"content-type", b"").startswith(b"application/http") else (b"", b"", block)
    digest = hashlib.sha256(payload).hexdigest()
    if kind == b"response" and (want := head.get(b"warc-payload-digest", b"")).startswith(b"sha256:") and digest.encode() != want[7:]:
        raise Damaged("payload digest")
    return {"head": head, "type": kind.decode("latin-1"), "http": http, "payload": payload, "digest": digest}, stop + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at data[at:] holds, and where it ends."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    while not z.eof:
        some = view[at : at + STEP]
        if not some:
            raise Damaged("member is cut short")
        out.append(z.decompress(some))
        at += len(some)
    return b"".join(out), at - len(z.unused_data)


def read(data: bytes) -> tuple[list[tuple[int, dict]], list[tuple[int, int, str]]]:
    """(offset, record) of every record that passes, and (start, end, why) of the bytes between."""
    records, gaps, at, bad, why = [], [], 0, None, ""

    def good(start: int):
        nonlocal bad
        if bad is not None:
            gaps.append((bad, start, why))
            bad = None

    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                plain, end = inflate(data, at)
                found, k = [], 0
                while k < len(plain):
                    one, k = parse(plain, k)
                    found.append((at, one))
                good(at)
                records += found
                at = end
            else:
                one, end = parse(data, at)
                good(at)
                records.append((at, one))
                at = end
        except (Damaged, zlib.error) as e:
            if bad is None:
                bad, why = at, str(e)
            at = min((k for k in (data.find(GZIP, at + 1), data.find(b"WARC/1.", at + 1)) if k >= 0), default=len(data))
    good(len(data))
    return records, gaps


def with_targets(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = HOT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for what will be a response.

    Only digests and ids are shuffled to find repeated payloads.  Those that repeat meet their pages in place; where there
    are more than `most`, the most frequent do, and pages of the others by a shuffle join, of which none is hot then.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    long = rows.where(F.octet_length("html") >= LEAST_REVISIT).select("digest", "page_id")
    many = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    many = written(many.select(F.col("digest").alias("d"), "first", "n"), "digests")
    same = F.col("digest") == F.col("d")
    if many.count() <= most:
        joined = rows.join(F.broadcast(many), same, "left")
    else:
        hot = F.broadcast(frequent(many, "n", most))
        rest = many.join(hot.select("d"), "d", "left_anti").select("d", "first", "n")
        joined = rows.join(hot, same).unionByName(rows.join(hot.select("d"), same, "left_anti").join(rest, same, "left"))
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def archives(rows: DataFrame) -> DataFrame:
    """(archive, part, content): the records of rows as in with_targets, an archive for each task."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        number, held, size = 0, [], 0

        def part():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["archive", "part", "content"])

        for batch in batches:
            for some in slices(batch, 2):
                for page, url, html, digest, target in zip(*(c.to_pylist() for c in some.columns)):
                    m = member(record(b"" if page is None else b"%d" % page, url.encode(), html.encode(), digest.encode(), None if target is None else b"%d" % target))
                    held.append(m)
                    size += len(m)
                    if size >= PART_BYTES:
                        yield part()
                        number, held, size = number + 1, [], 0
        if held:
            yield part()

    return rows.mapInArrow(run, "archive string, part int, content binary")


def page_number(uri: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", uri or b"")
    return int(found[1]) if found else None


def records_of(stored: DataFrame) -> DataFrame:
    """What the archives hold, by the salvage reader.

    A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, part, offset; and
    for each quarantined gap a row of record_type "gap" with offset and gap_bytes.
    """

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "part", "offset", "gap_bytes"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            for archive, part, content in zip(*(c.to_pylist() for c in batch.columns)):
                found, gaps = read(content)
                rows = []
                for offset, r in found:
                    head = r["head"]
                    if r["type"] == "revisit":
                        length = re.search(rb"(?im)^content-length:\s*(\d+)", r["http"])
                        n, digest = int(length[1]) if length else None, head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
                    else:
                        n, digest = len(r["payload"]), r["digest"]
                    rows.append((page_number(head.get(b"warc-record-id")), n, digest, r["type"], page_number(head.get(b"warc-refers-to")), head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), archive, part, offset, None))
                rows += [(None, None, None, "gap", None, None, archive, part, a, b - a) for a, b, _ in gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return stored.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, part int, offset long, gap_bytes long")


def quarantined(found: DataFrame) -> DataFrame:
    """The log of gaps in records_of's rows: (archive, part, offset, gap_bytes), a table in the shared folder."""
    gaps = written(found.where("record_type = 'gap'").select("archive", "part", "offset", "gap_bytes"), "quarantine")
    n, size = gaps.agg(F.count("*"), F.coalesce(F.sum("gap_bytes"), F.lit(0))).first()
    if n:
        logging.getLogger(__name__).warning("%d gaps of %d bytes in all are quarantined: %s", n, size, gaps.inputFiles()[0].rpartition("/")[0])
    return gaps


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through archives and back, each with its record's type and what it refers to; gaps are logged."""
    stored = written(archives(with_targets(table(spark, sf_dir, "pages"))), "archives")
    found = written(records_of(stored), "records")
    quarantined(found)
    return found.where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {LEAST_REVISIT} AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_REVISIT} AND page_id <> f THEN f END AS refers_to
FROM m
"""
