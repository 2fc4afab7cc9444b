"""WARC writing and segment reassembly.

Writing.  Each page becomes a ``response`` record whose HTTP block carries the
payload in chunked transfer framing; a block above ``SEGMENT_BYTES`` is split into
a first segment and ``continuation`` records.  Of pages with equal payloads of at
least ``REVISIT_BYTES`` bytes only the one with the largest id is written in full,
the others as ``revisit`` records that name its payload digest.  Archives are
gzipped text files written by Spark's own writer, one per task, in the shared
folder, so any store that Spark reaches will do.

Reading.  Files are split at the version line and parsed as a stream, one record
in memory at a time.  A record ends, but for line breaks, where its Content-Length
says; a piece that is shorter was cut at a version line inside the block and is
joined with the next ones.  Where no version line comes at that place, the length is
wrong: the piece alone is given as a ``damaged`` record, and reading goes on with the
next piece, so nothing behind it is lost.  The same holds for what is open at the end
of a file, for a header without an end or length, and beyond ``HELD_BYTES``.  Files
should be compressed (a task reads one as a whole); in others a record that holds
version lines and lies across a split is damaged.  Segments are grouped by their
origin id, ordered by number, checked against the total length, and the chunked
framing is decoded.  Revisits are resolved by payload digest.

Defined results: null html is an empty payload; a null page id is kept (it owns a
group only if the whole group has none, and then all its rows are responses);
rows that repeat the owner's id and payload are all responses; a record with a
damaged part, missing or wrong segments, framing or digest has ``complete`` false; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmsman.session import sf_path

from .registry import register
from .shared import bounded_batches, run_folder, small_side, written

SEGMENT_BYTES = 4096
CHUNK_BYTES = 1024
REVISIT_BYTES = 1000
HELD_BYTES = 256 << 20  # of a record that is put together from pieces
_VERSION = b"WARC/1.1\r\n"
_DATE = "2000-01-01T00:00:00Z"  # fixed, so that reruns write equal archives but for the record ids


# --- records -----------------------------------------------------------------

def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the line break that the writer adds after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return _VERSION + head.encode() + b"\r\n" + block + b"\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i: i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(;.*)?", body[at:end]) if end >= 0 else None
        if size is None:
            return None
        n, at = int(size[1], 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n: at + n + 2] != b"\r\n":
            return None
        out.append(body[at: at + n])
        at += n + 2


def page_records(page_id, url, payload: bytes, digest: str, revisit: bool, segment: int = SEGMENT_BYTES):
    """The WARC records of one page."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Date", _DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    common += [("WARC-Target-URI", re.sub(r"[\x00-\x20]", "", url))] if url else []
    common += [("X-Page-Id", str(page_id))] if page_id is not None else []
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, profile], head)
        return
    block = head + chunked(payload)
    parts = [block[i: i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", "1")], parts[0])
    for number, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE),
                      ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number)), *total], part)


# --- writing -----------------------------------------------------------------

def _write_task(batches):
    for batch in batches:
        out, size = [], 0
        for page_id, url, payload, digest, revisit in zip(*(c for c in batch.columns)):
            for made in page_records(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), revisit.as_py()):
                out.append(made)
                size += len(made)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str) -> None:
    """Archives of (page_id, url, html) below ``path``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = written(rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
                       .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "owner"), "warc")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    (rows.join(small_side(repeated), "digest", "left").select("page_id", "url", "payload", "digest", revisit.alias("revisit"))
     .mapInArrow(_write_task, "value binary").select(F.col("value").cast("string"))
     .write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\r\n").text(path))


# --- reading -----------------------------------------------------------------

_RECORD = pa.schema([("type", pa.string()), ("id", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()),
                     ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("damaged", pa.bool_())])
_RECORD_SQL = "type string, id string, page_id long, digest string, origin string, segment long, total long, block binary, damaged boolean"


def header(raw: bytes) -> tuple[dict[str, str], int, int | None]:
    """(fields, where the block starts, where it ends or None) of a record after its
    version line."""
    end = raw.find(b"\r\n\r\n")
    fields = {}
    for line in raw[: end if end >= 0 else len(raw)].decode("utf-8", "replace").split("\r\n"):
        key, _, value = line.partition(":")
        fields.setdefault(key.strip().lower(), value.strip())
    start = end + 4 if end >= 0 else len(raw)
    known = end >= 0 and re.fullmatch("[0-9]{1,18}", fields.get("content-length", ""))
    return fields, start, start + int(fields["content-length"]) if known else None


def parse(raw: bytes) -> tuple | None:
    """A record after its version line as a row of ``_RECORD``; None while its
    block is not all there."""
    fields, start, stop = header(raw)
    return None if stop is None or len(raw) < stop else _row(fields, raw[start: stop], len(raw.rstrip(b"\r\n")) > stop)


def _row(fields: dict[str, str], block: bytes, damaged: bool) -> tuple:
    def number(key):
        return int(fields[key]) if re.fullmatch(r"-?[0-9]{1,18}", fields.get(key, "")) else None

    digest = fields.get("warc-payload-digest", "")
    digest = base64.b32decode(digest[5:]).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", digest) else None
    return (fields.get("warc-type"), fields.get("warc-record-id"), number("x-page-id"), digest, fields.get("warc-segment-origin-id"),
            number("warc-segment-number"), number("warc-segment-total-length"), block, damaged)


class _Reader:
    """The records of one file from its pieces, in order."""

    def __init__(self):
        self.pieces: list[bytes] = []  # of the record that is open
        self.size = 0

    def take(self, piece: bytes) -> list[tuple]:
        """The records that are finished once ``piece`` has come."""
        if not self.pieces:
            self.fields, self.start, self.stop = header(piece)
        self.size += len(piece) + (len(_VERSION) if self.pieces else 0)
        self.pieces.append(piece)
        if self.stop is None or self.size > HELD_BYTES + self.start and len(self.pieces) > 1:
            return self.give_up()
        if self.size < self.stop:
            return []
        raw = _VERSION.join(self.pieces)
        if raw[self.stop:].strip(b"\r\n"):  # no version line where the block should end
            return self.give_up()
        made, self.pieces, self.size = _row(self.fields, raw[self.start: self.stop], False), [], 0
        return [made]

    def give_up(self) -> list[tuple]:
        """The open record's first piece as a damaged record, and what the other
        pieces hold by themselves."""
        if not self.pieces:
            return []
        first, *others = self.pieces
        block = first[self.start:] if self.stop is None else first[self.start: self.stop]
        out, self.pieces, self.size = [_row(self.fields, block, True)], [], 0
        for piece in others:
            out += self.take(piece)
        return out

    def end(self) -> list[tuple]:
        out = []
        while self.pieces:
            out += self.give_up()
        return out


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def _read_task(batches):
    name, reader, out, size = None, _Reader(), [], 0
    for batch in batches:
        for file, piece in zip(batch.column(0), batch.column(1)):
            file, piece = file.as_py(), piece.as_py()
            if file != name:
                out += reader.end()
                name, reader = file, _Reader()
                if not piece.strip():
                    continue  # in front of the first version line
            out += reader.take(piece)
            size += len(piece)
            if size > 8 << 20 and out:
                yield _rows(out)
                out, size = [], 0
    out += reader.end()
    if out:
        yield _rows(out)


def read(spark, path: str) -> DataFrame:
    """All records of the archives below ``path``, damaged ones too."""
    bounded_batches(spark)
    pieces = spark.read.option("lineSep", _VERSION.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_read_task, _RECORD_SQL)


def _decode_task(batches):
    for batch in batches:
        done = []
        for parts, digest in zip(batch.column(batch.schema.names.index("parts")).to_pylist(), batch.column(batch.schema.names.index("digest")).to_pylist()):
            parts = sorted(parts, key=lambda p: p["segment"])
            block = b"".join(p["block"] for p in parts)
            whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
            head, _, body = block.partition(b"\r\n\r\n")
            payload = unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body
            whole = whole and not any(p["damaged"] for p in parts) and payload is not None and (digest is None or hashlib.sha1(payload).hexdigest() == digest)
            done.append((payload if payload is not None else b"", whole))
        keep = [i for i, n in enumerate(batch.schema.names) if n != "parts"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])],
                                         names=[*[batch.schema.names[i] for i in keep], "payload", "complete"])


def reassemble(records: DataFrame) -> DataFrame:
    """(type, id, page_id, digest, payload, complete) of every response.  Only
    segmented records are shuffled; a group is one record."""
    part = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"),
                    F.when(F.col("segment").isNull(), F.octet_length("block")).otherwise(F.col("total")).cast("long").alias("total"), "block", "damaged")
    single = records.where("type = 'response' and segment is null").select("type", "id", "page_id", "digest", F.array(part).alias("parts"))
    segments = records.where("segment is not null").select(F.coalesce("origin", "id").alias("id"), "type", "page_id", "digest", part.alias("part"))
    first = F.col("type") == "response"
    grouped = segments.groupBy("id").agg(
        F.max(F.when(first, F.col("type"))).alias("type"), F.max(F.when(first, F.col("page_id"))).alias("page_id"),
        F.max(F.when(first, F.col("digest"))).alias("digest"), F.collect_list("part").alias("parts"))
    both = single.unionByName(grouped.select(*single.columns))
    return both.mapInArrow(_decode_task, "type string, id string, page_id long, digest string, payload binary, complete boolean")


@register("op1_warc_reassembly", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to, true AS complete
FROM o
""")
def op1(spark, sf_dir):
    path = run_folder(spark, "warc")
    write(spark.read.parquet(sf_path(sf_dir, "pages")), path)
    records = read(spark, path)
    full = written(reassemble(records).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "complete"), "warc")
    owners = full.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("complete").alias("complete"))
    again = records.where("type = 'revisit'").select("page_id", F.col("digest").alias("payload_digest"))
    owners = written(owners.join(again.select("payload_digest").distinct(), "payload_digest", "left_semi"), "warc")
    revisits = again.join(small_side(owners), "payload_digest", "left")
    shape = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (full.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(*shape, "complete")
            .unionByName(revisits.withColumn("record_type", F.lit("revisit")).select(*shape, F.coalesce("complete", F.lit(False)).alias("complete"))))
