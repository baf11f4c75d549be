"""WARC archives: a writer that replaces repeated payloads by revisits, and a salvage reader.

Writing. Each page becomes a gzip member of its own: a response record with HTTP head and
payload, or, where a page with a larger id has the same payload, a revisit record with the
head alone. Spark's text sink writes the members, so that archives go to any store Spark
knows. The sink puts a separator behind every row; as the last byte of a member, the highest
one of its length, is 0 up to 16 MB, that byte is the separator. Behind a longer member
goes an empty one, which ends in 0 too.

Reading. Each archive is walked from its first byte. What stands there has to pass all
checks: a gzip member its checksum, a record its version line, header lines, length, closing
breaks and digests. Where one fails, the bytes from there on are searched for the next place
at which a member or a plain version line begins a record that passes, later records are
recovered, and the bytes passed over are reported as a gap with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, shared_folder
from .common import arrow_map, bit_filter, holds

SHARED_FROM = 1000              # bytes from which an equal payload is stored once
ARCHIVE = 32 << 20              # bytes of payload in an archive, as an average over archives
HOT = 1000                      # a payload that more than one of HOT rows has is joined by broadcast
LEVEL = 3                       # of compression
HEAD = 1 << 16                  # bytes of header lines a record may have
HANDED_ON = 8 << 20             # bytes of payload the reader holds before it hands them on

# fixed values of the format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"   # pages don't tell when they were fetched
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
BREAKS = b"\r\n\r\n"
EMPTY_MEMBER = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()

EVENTS = ("archive string, offset long, length long, reason string, record_type string, record_id string, "
          "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


# ---- writing -------------------------------------------------------------------------

def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, holder: int | None) -> bytes:
    """A record; a revisit where ``holder`` names the page whose record has the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if holder is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if holder is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}",
             f"WARC-Date: {DATE}"]
    if url is not None:
        # a line break or blank in an address must not end the line
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    if holder is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(holder)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}",
              f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + BREAKS + block + BREAKS


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out.endswith(b"\0") else out + EMPTY_MEMBER


def _records(c: dict) -> dict:
    return {"member": [member(record(i, u, p, h))[:-1] for i, u, p, h in zip(c["page_id"], c["url"], c["payload"], c["holder"])]}


def with_holders(pages: DataFrame) -> tuple[DataFrame, float]:
    """(page_id, url, payload, holder), and the mean bytes of a payload.

    holder: the page whose record has the payload, null where that is the page itself. Only rows
    whose payload may be a shared one, as a bit filter tells, are shuffled; payloads that
    more than one row of HOT has are at most HOT and are broadcast.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= SHARED_FROM, F.unhex(F.sha1("payload"))))
    groups = rows.filter("digest is not null").groupBy("digest").agg(
        F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1 and holder is not null")
    groups = materialize(groups.withColumn("key", F.xxhash64("digest")), "shared-payloads")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.octet_length("payload")), F.lit(0.0)).alias("mean")).first()
    bits = pages.sparkSession.sparkContext.broadcast(bit_filter(groups, "key"))

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(holds(bits.value, keys.to_numpy()))

    hot = groups.filter(F.col("n") * HOT > size.n).select("digest", "holder")
    cold = groups.filter(F.col("n") * HOT <= size.n).select("digest", "holder")
    marked = rows.withColumn("may", F.when(F.col("digest").isNotNull(), may(F.xxhash64("digest"))).otherwise(False))
    marked = marked.join(F.broadcast(hot), "digest", "left")
    ready = marked.filter("not may or holder is not null")
    asked = marked.filter("may and holder is null").drop("holder").join(cold, "digest", "left")
    out = ready.select("page_id", "url", "payload", "holder").unionByName(asked.select("page_id", "url", "payload", "holder"))
    own = F.col("page_id").eqNullSafe(F.col("holder"))
    return out.withColumn("holder", F.when(~own, F.col("holder"))), size.mean


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as archives in the new folder ``path``.

    Of rows with equal payloads (UTF-8 of html) of at least SHARED_FROM bytes, those with the largest
    page_id are responses and the others revisit them; repeated rows of that page_id are all
    responses. Smaller payloads are responses. Rows with a null page_id revisit a page that has
    one; among themselves all are responses. Null html is an empty payload, a null url leaves
    out its line. Further columns are ignored. Empty table: no records. A file holds as
    many records as make ARCHIVE bytes of payload on average, and at least one.
    """
    rows, mean = with_holders(pages)
    made = arrow_map(rows, _records, "member binary").select(F.col("member").cast("string").alias("value"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, int(ARCHIVE / max(mean, 1)))).text(path)


# ---- reading -------------------------------------------------------------------------

class Damaged(Exception):
    """What stands at a place fails a check."""


def _digest_hex(value: bytes) -> str | None:
    """Hex of a sha1 header in base 32 or 16; None for other kinds of digest."""
    kind, _, text = value.decode("latin-1").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return base64.b32decode(text.upper()).hex() if len(text) == 32 else bytes.fromhex(text).hex()
    except ValueError:
        raise Damaged("digest header") from None


def _header(lines: bytes) -> dict[bytes, bytes]:
    out: dict[bytes, bytes] = {}
    last = None
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last is not None:      # a line that goes on
            out[last] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _urn(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace").strip("<>")


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the place behind it; raises Damaged where a check fails."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("version line")
    end = data.find(BREAKS, version.end(), version.end() + HEAD)
    if end < 0:
        raise Damaged("header end")
    head = _header(data[version.end():end])
    size = head.get(b"content-length", b"")
    if not size.isdigit() or b"warc-type" not in head:
        raise Damaged("header fields")
    start = end + 4
    stop = start + int(size)
    if stop + 4 > len(data):
        raise Damaged("truncated")
    if data[stop:stop + 4] != BREAKS:
        raise Damaged("length")
    block = data[start:stop]
    said = _digest_hex(head.get(b"warc-block-digest", b""))
    if said is not None and hashlib.sha1(block).hexdigest() != said:
        raise Damaged("block digest")
    kind = head[b"warc-type"].decode("latin-1").lower()
    payload, length = block, len(block)
    if head.get(b"content-type", b"").lower().startswith(b"application/http"):
        split = block.find(BREAKS)
        if split < 0:
            raise Damaged("HTTP head")
        payload = block[split + 4:]
        http = _header(block[:split].partition(b"\r\n")[2]) if b"\r\n" in block[:split] else {}
        length = len(payload)
        if kind == "revisit":
            size = http.get(b"content-length", b"")
            length, payload = int(size) if size.isdigit() else None, None
    said = _digest_hex(head.get(b"warc-payload-digest", b""))
    if payload is not None and kind != "revisit" and said is not None and hashlib.sha1(payload).hexdigest() != said:
        raise Damaged("payload digest")
    return {"record_type": kind, "record_id": _urn(head.get(b"warc-record-id")), "target_uri": _urn(head.get(b"warc-target-uri")),
            "refers_to": _urn(head.get(b"warc-refers-to")), "payload_digest": said, "payload_bytes": length, "payload": payload}, stop + 4


def parse_member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds and the place behind it."""
    z, out, to, step = zlib.decompressobj(31), [], at, 1 << 12
    view = memoryview(data)
    begin = b""
    try:
        while not z.eof:
            if to >= len(data):
                raise Damaged("truncated")
            out.append(z.decompress(view[to:to + step]))        # what lies behind the member is copied: small steps
            to = min(to + step, len(data))
            step = min(2 * step, 1 << 20)
            if len(begin) < 5:
                begin = (begin + out[-1])[:5]
                if not b"WARC/".startswith(begin):
                    raise Damaged("version line")
    except zlib.error:
        raise Damaged("gzip member") from None
    return b"".join(out), to - len(z.unused_data)


def _unit(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the member or plain record at ``at``, and the place behind."""
    if data.startswith(MAGIC, at):
        held, end = parse_member(data, at)
        records, inner = [], 0
        while inner < len(held):
            got, inner = parse_record(held, inner)
            records.append(got)
        return records, end
    got, end = parse_record(data, at)
    return [got], end


def _beginnings(data: bytes, at: int) -> Iterator[int]:
    """Places from ``at`` on at which a member or a version line may begin, in order."""
    gz, line = data.find(MAGIC, at), data.find(b"WARC/1.", at)
    while gz >= 0 or line >= 0:
        if line < 0 or 0 <= gz < line:
            yield gz
            gz = data.find(MAGIC, gz + 1)
        else:
            yield line
            line = data.find(b"WARC/1.", line + 1)


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order, with offset and length, and gaps (with a reason instead of a type)."""
    at = 0
    while at < len(data):
        try:
            records, end = _unit(data, at)
        except Damaged as broken:
            reason, records, to = str(broken), [], len(data)
            for place in _beginnings(data, at + 1):
                try:
                    records, end = _unit(data, place)
                    if records:
                        to = place
                        break
                except Damaged:
                    pass
            yield {"offset": at, "length": to - at, "reason": reason}
            if not records:
                return
            at = to
        for r in records:
            yield r | {"offset": at, "length": end - at}
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record and each gap of the archives under ``path`` (columns EVENTS).

    Records have a record_type and no reason, gaps a reason and no type; offset and length count the archive's
    bytes, for a record those of its member. Archives may be plain or compressed by record, also mixed.
    A task holds one batch of archives at a time; the writer bounds their size. An archive
    that is empty, or a folder without one, gives no rows. Where a record is damaged, a whole
    record inside its payload can't be told from one of the archive, and is recovered as such.
    """
    names = [f.split()[0] for f in EVENTS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in EVENTS.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                archive, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for r in salvage(data):
                    rows.append(r | {"archive": archive})
                    size += len(r.get("payload") or b"") + 500
                    if size >= HANDED_ON:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)
        pa.default_memory_pool().release_unused()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, EVENTS)


def records(events: DataFrame) -> DataFrame:
    return events.filter("reason is null").drop("reason")


def gaps(events: DataFrame) -> DataFrame:
    """The quarantined bytes: archive, offset, length, reason."""
    return events.filter("reason is not null").select("archive", "offset", "length", "reason")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into a new folder of the shared one and read the archives back."""
    spark = pages.sparkSession
    path = "/".join([shared_folder(spark), "codestrata", spark.sparkContext.applicationId, f"warc-{uuid.uuid4().hex[:12]}"])
    write_archives(pages, path)
    return read_archives(spark, path)


def page_rows(events: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records read.

    Size and digest of a response are taken from its payload, those of a revisit from its heads.
    """
    number = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(-?[0-9]*)$", 1), F.lit("")).cast("long")
    whole = F.col("payload").isNotNull()
    return records(events).select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"))
