"""WARC archives: a writer with revisit records, and a splittable reader.

Writing.  Every row becomes one record, a gzip member of its own.  Of rows with equal payloads (by SHA-1) the one with the
smallest id is a response, the others are revisits that name it and carry no payload.  A task writes files of about
``file_bytes`` under names of its own and reports them in a stored manifest; files that the manifest does not name
(of failed attempts) do not exist for readers.

Reading.  A file is cut into byte ranges, one row each, which are dealt out to tasks.  A task looks in its range for the gzip magic
and tries a candidate by decoding it: only a member that begins with a WARC version line and a parsable header is a
record.  It owns the records that start inside its range, reads the last one past the range's end, and takes the
members that follow directly without a search.  If what follows an accepted member is neither another one nor the
end of the file, the candidate was bytes inside a payload: it is dropped and the search goes on behind its first byte.

Cases: a null payload is an empty one; rows of equal id and payload are all responses if the id is the smallest; a null id is
written as empty and read as null, and refers to nothing and is referred to only if all rows of its payload have none; a null URL is empty; very
long payloads are one record each; an empty table writes no file and reads as no rows; other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlocus.llm.store import fresh_folder, stored
from gridlocus.llm.textual import parts_of
from gridlocus.llm.token_codes import open_place

FILE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
ID = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """A response or revisit record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", "WARC-Type: " + ("revisit" if is_revisit else "response"), f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def write_warc(df: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row and return the stored manifest (path, n_bytes, n_records).  Payloads of under
    ``least_bytes`` bytes are always responses."""
    spark = df.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    digests = rows.select("id", F.sha1("body").alias("sha"), F.length("body").alias("size")).where(F.col("size") >= least_bytes)
    firsts = digests.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1").select("sha", "first")
    plan = rows.withColumn("sha", F.sha1("body")).join(firsts, "sha", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_place(folder)
        part = TaskContext.get().partitionId()
        held, size, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            name = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex[:8]}.warc.gz"
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(b"".join(held))
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([len(held)])], ["path", "n_bytes", "n_records"])
            held, size, number = [], 0, number + 1
            return row

        for piece in parts_of(batches, "body"):
            for page_id, link, payload, first in zip(*(piece.column(c).to_pylist() for c in ("id", "url", "body", "first"))):
                revisit = first is not None and first != page_id and len(payload) >= least_bytes
                held.append(record(page_id, link, payload, payload_digest(payload), first if revisit else None, revisit))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return stored(plan.select("id", "url", "body", "first").mapInArrow(run, "path string, n_bytes long, n_records long"), "warc-manifest")


class Source:
    """Bytes of a file by position, read in steps."""

    def __init__(self, file, step: int = 1 << 18):
        self.file, self.size, self.step = file, file.size(), step
        self.at, self.data = 0, b""

    def get(self, start: int, length: int) -> bytes:
        """At most ``length`` bytes from ``start``."""
        if not (self.at <= start and start + length <= self.at + len(self.data)):
            self.at, self.data = start, self.file.read_at(min(max(length, self.step), max(0, self.size - start)), start)
        return self.data[start - self.at : start - self.at + length]


def member(source: Source, start: int) -> tuple[dict[str, str], bytes, int] | None:
    """(header, block, position after it) of the record whose gzip member begins here, or None."""
    unpack = zlib.decompressobj(31)
    out, at, checked = [], start, False
    try:
        while not unpack.eof:
            piece = source.get(at, 1 << 16)
            if not piece:
                return None
            out.append(unpack.decompress(piece))
            at += len(piece)
            if not checked and sum(map(len, out)) >= 5:
                if not b"".join(out).startswith(b"WARC/"):
                    return None
                checked = True
    except zlib.error:
        return None
    raw = b"".join(out)
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    fields = {name.lower(): value.strip() for name, colon, value in (x.partition(":") for x in lines[1:]) if colon}
    length = fields.get("content-length", "")
    if not raw.startswith(b"WARC/") or not gap or not length.isdigit() or len(rest) < int(length):
        return None
    return fields, rest[: int(length)], at - len(unpack.unused_data)


def records_in(source: Source, start: int, stop: int, at_once: int = 8 << 20) -> Iterator[list[tuple[dict[str, str], bytes]]]:
    """Lists of the records that begin in [start, stop)."""
    at = start
    while at < stop:
        piece = source.get(at, min(1 << 16, stop - at + len(MAGIC) - 1))
        found = piece.find(MAGIC)
        if found < 0:
            at += max(1, len(piece) - len(MAGIC) + 1)
            continue
        first = at = at + found
        if at >= stop:
            return
        held, size, sure, given = [], 0, False, False
        while at < stop and (got := member(source, at)):
            held.append(got[:2])
            size += len(got[1])
            at = got[2]
            if size >= at_once and sure:
                yield held
                held, size, given = [], 0, True
            sure = sure or len(held) > 2
        if held and (at >= source.size or at >= stop and (source.get(at, len(MAGIC)) == MAGIC or at == source.size)):
            yield held
        elif given or held and sure:  # the end, or a broken member after good ones: go on behind it
            if held:
                yield held
            at += 1
        else:
            at = first + 1


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(record_id, record_type, url, payload_bytes, payload_digest, refers_to, payload) of every record in the files.  Size
    and digest of a response are taken from its payload; a revisit has those of its header, and no payload."""
    files = manifest.select("path", "n_bytes")
    splits = files.select("path", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(split_bytes))).alias("start"), "n_bytes")
    splits = splits.select("path", "start", F.least("n_bytes", F.col("start") + split_bytes).alias("stop"))
    n = max(1, splits.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                system, place = open_place(path)
                with system.open_input_file(place) as file:
                    for held in records_in(Source(file), start, stop):
                        rows = [[] for _ in range(7)]
                        for fields, block in held:
                            head, _, payload = block.partition(b"\r\n\r\n")
                            kind = fields.get("warc-type", "")
                            if kind == "response":
                                size, digest = len(payload), payload_digest(payload)
                            else:
                                sizes = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                                size, digest, payload = int(sizes[0]) if sizes else None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
                            for values, x in zip(rows, (fields.get("warc-record-id", "").strip("<>"), kind, fields.get("warc-target-uri", ""), size, digest, fields.get("warc-refers-to", "").strip("<>") or None, payload)):
                                values.append(x)
                        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"])

    schema = "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    return splits.repartition(min(n, 20_000), "path", "start").mapInArrow(run, schema)


def page_number(column: str):
    """The id in a record id that ``write_warc`` made."""
    return F.expr(f"try_cast(substring({column}, {len(ID) + 1}) as long)")
