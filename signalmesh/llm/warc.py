"""WARC archives: a deduplicating writer and a salvage reader.

Writing: each page is a gzip member of its own (or a plain record). Payload digests are compared as narrow
(id, digest) rows, combined before they shuffle; of equal payloads of `min_bytes` or more, the largest id keeps the payload
as a response, and the others become revisit records that refer to it. Tasks write archives of about
`roll_bytes` into the shared folder under names of their own, so that a retried task never touches another's
file; the manifest, settled as Parquet, names the files that count.

Reading: every member is checked (gzip CRC, version line, Content-Length, end marks, digests). After a failed check the
reader searches for the next member or version line that passes all checks, resumes there, and reports the
bytes between as a quarantined gap with the reason. A gzip member may hold several records; damage inside it loses only what
lies up to its next valid version line. Digests are accepted in base32 or hexadecimal of either case; one that is neither fails the block's check, and is no
claim about a payload. Archives are read in windows of `CHUNK` bytes; memory is bounded by the largest single record or member, at most `MAX_MEMBER`.

Defined cases: a null payload is empty; a null URL is left out; rows that share the largest id of their payload are
all responses; a null id counts as the smallest; a very long payload is one record; only the id, the URL and the payload are read, so other
columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_store, settle, shared_dir

CHUNK = 1 << 18
#: Bytes that one gzip member may inflate to; a larger one is quarantined with that reason.
MAX_MEMBER = 1 << 30
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "path string, start long, stop long, kind string, reason string, record_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"
_ENDS = {"\r": "%0D", "\n": "%0A"}


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """The bytes of a response, or of a revisit whose block holds only the HTTP head."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[\r\n]", lambda m: _ENDS[m[0]], url))
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def digest_bytes(value: str | None) -> bytes | None:
    """The SHA-1 that a digest header names, in base32 or hexadecimal of either case; None for another algorithm or no header; raises Damaged."""
    if value is None or not value.lower().startswith("sha1:"):
        return None
    text = value[5:].strip()
    try:
        raw = bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())
    except ValueError:
        raw = b""
    if len(raw) != 20:
        raise Damaged("digest header")
    return raw


class Damaged(Exception):
    """A check that failed, with its name."""


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers in lower case, block, length of the record) of a record at the start of `raw`; raises Damaged."""
    if not raw.startswith(VERSION):
        raise Damaged("version line")
    stop = raw.find(b"\r\n\r\n")
    if stop < 0:
        raise Damaged("headers")
    try:
        pairs = [x.split(":", 1) for x in raw[:stop].decode().split("\r\n")[1:]]
        head = {k.strip().lower(): v.strip() for k, v in pairs}
        size = int(head["content-length"])
    except (ValueError, KeyError):
        raise Damaged("headers") from None
    end = stop + 4 + size
    if size < 0 or raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length")
    block = raw[stop + 4 : end]
    if (told := digest_bytes(head.get("warc-block-digest"))) is not None and told != hashlib.sha1(block).digest():
        raise Damaged("block digest")
    return head, block, end + 4


class Source:
    """Windows of a file that grow on demand and are dropped once passed."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if start < self.at or start + n > self.at + len(self.data):
            want = min(max(n, CHUNK), self.size - start)
            self.file.seek(start)
            self.at, self.data = start, self.file.read(want)
        return self.data[start - self.at : start - self.at + n]


def _member_at(source: Source, at: int) -> tuple[bytes, int]:
    z, out, pos, size = zlib.decompressobj(31), [], at, 0
    while not z.eof:
        part = z.unconsumed_tail or source.read(pos, CHUNK)
        if not part:
            raise Damaged("truncated member")
        fresh = not z.unconsumed_tail
        try:
            got = z.decompress(part, CHUNK)
        except zlib.error:
            raise Damaged("gzip member") from None
        if got and not out and not got.startswith(VERSION[: len(got)]):
            raise Damaged("version line")
        out.append(got)
        size += len(got)
        if size > MAX_MEMBER:
            raise Damaged("member too large")
        pos += len(part) if fresh else 0
    return b"".join(out), pos - len(z.unused_data)


def _member_records(raw: bytes) -> list[tuple[str | None, dict[str, str], bytes]]:
    """(reason, headers, block) of the records of a member's content; what lies between valid ones has a reason. Raises Damaged where none is valid."""
    out, at, reason = [], 0, None
    while at < len(raw):
        try:
            head, block, used = parse(raw[at:] if at else raw)
        except Damaged as e:
            first, reason = reason is None, str(e)
            if first:
                out.append((reason, {}, b""))
            at = raw.find(VERSION, at + 1)
            if at < 0:
                break
            continue
        out.append((None, head, block))
        at, reason = at + used, None
    if all(r for r, _, _ in out):
        raise Damaged(out[0][0] if out else "version line")
    return out


def _records_at(source: Source, at: int) -> tuple[list[tuple[str | None, dict[str, str], bytes]], int]:
    """The checked records of the member, or the plain record, at an offset and where they stop; raises Damaged."""
    if source.read(at, 3) == GZIP:
        raw, stop = _member_at(source, at)
        return _member_records(raw), stop
    n, raw = 8192, source.read(at, 8192)
    if not raw.startswith(VERSION):
        raise Damaged("version line")
    while (stop := raw.find(b"\r\n\r\n")) < 0 and n < 1 << 20 and at + n < source.size:
        n *= 2
        raw = source.read(at, n)
    size = re.search(rb"\r\ncontent-length: *(\d{1,15})\r\n", raw[: stop + 2], re.I) if stop > 0 else None
    if not size:
        raise Damaged("headers")
    if at + stop + 8 + int(size[1]) > source.size:
        raise Damaged("truncated record")
    head, block, used = parse(source.read(at, stop + 8 + int(size[1])))
    return [(None, head, block)], at + used


def _next_candidate(source: Source, at: int) -> int:
    while at < source.size:
        part = source.read(at, CHUNK)
        found = [x for x in (part.find(GZIP), part.find(VERSION)) if x >= 0]
        if found:
            return at + min(found)
        if at + len(part) >= source.size:
            break
        at += len(part) - len(VERSION) + 1
    return source.size


def salvage(file, size: int) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(start, stop, reason, headers, block) of each record, and of each gap, which has a reason; the records of one gzip member share its offsets."""
    source, at = Source(file, size), 0
    while at < size:
        try:
            found, stop = _records_at(source, at)
            for why, head, block in found:
                yield at, stop, why, head, block
            at = stop
            continue
        except Damaged as e:
            reason, gap = str(e), at
        while True:
            at = _next_candidate(source, at + 1)
            if at >= size:
                break
            try:
                _records_at(source, at)
                break
            except Damaged:
                pass
        yield gap, min(at, size), reason, {}, b""


def _named(uri: str | None) -> str | None:
    return uri.strip("<>").removeprefix("urn:x-page:") if uri else None


def claimed(digest: str | None) -> bytes | None:
    """As `digest_bytes`; a header that holds no SHA-1 claims none, as the block's own checks have passed."""
    try:
        return digest_bytes(digest)
    except Damaged:
        return None


def read(manifest: DataFrame) -> DataFrame:
    """RECORDS rows of the archives whose `path` a frame names: kind `record`, or `gap` with its reason.

    A response's payload is what follows the HTTP head, and its digest is recomputed; one that contradicts the header
    is quarantined as a gap. A revisit's length and digest come from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")])
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            store, local = open_store(path)
            rows, held = [], 0
            with store.open_input_file(local) as file:
                for start, stop, reason, head, block in salvage(file, file.size()):
                    row = dict.fromkeys(names) | {"path": path, "start": start, "stop": stop, "kind": "gap" if reason else "record", "reason": reason}
                    if not reason:
                        kind, payload, digest = head.get("warc-type"), block, head.get("warc-payload-digest")
                        if "application/http" in head.get("content-type", ""):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            length = re.search(rb"content-length: *(\d+)", http, re.I)
                            row["payload_bytes"] = int(length[1]) if length and kind == "revisit" else len(payload)
                        else:
                            row["payload_bytes"] = len(payload)
                        if kind == "revisit":
                            payload = None
                            row["payload_digest"] = told.hex() if (told := claimed(digest)) else None
                        else:
                            if (told := claimed(digest)) is not None and told != hashlib.sha1(payload).digest():
                                row |= {"kind": "gap", "reason": "payload digest", "payload_bytes": None}
                                rows.append(row)
                                continue
                            row["payload_digest"] = hashlib.sha1(payload).hexdigest()
                        row |= {"record_id": _named(head.get("warc-record-id")), "record_type": kind, "url": head.get("warc-target-uri"), "payload": payload, "refers_to": _named(head.get("warc-refers-to"))}
                    rows.append(row)
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path").mapInArrow(run, RECORDS)


def read_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """Salvage every archive that a path or glob names; only the listing goes through Spark's file source."""
    return read(spark.read.format("binaryFile").load(pattern).select("path"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000,
          roll_bytes: int = 32 << 20, compressed: bool = True) -> DataFrame:
    """Write the archives below a shared folder URI; returns the settled manifest."""
    low = F.lit(-(2**63)).cast("long")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")) if payload_col else F.lit(b"")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload"), "key": F.coalesce("id", low)})
    narrow = own.where(F.col("size") >= min_bytes).select("key", "digest")
    repeated = settle(narrow.groupBy("digest").agg(F.max("key").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep"), folder, "repeated")
    revisits = settle(narrow.join(repeated, "digest").where("key < keep").distinct(), folder, "revisits")
    joined = own.join(revisits, ["key", "digest"], "left").select("id", "url", "payload", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = open_store(f"{folder}/archives")
        store.create_dir(base, recursive=True)
        done, file, count, size, path = [], None, 0, 0, ""

        def close():
            nonlocal file
            if file is not None:
                file.close()
                done.append((f"{folder}/archives/{path}", count, size))
                file = None

        for batch in batches:
            for i, url, body, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None:
                    path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc" + ".gz" * compressed
                    file, count, size = store.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                raw = record(i, url, body, keep)
                raw = member(raw) if compressed else raw
                file.write(raw)
                count, size = count + 1, size + len(raw)
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "n_records": pa.array([d[1] for d in done], pa.int64()), "n_bytes": pa.array([d[2] for d in done], pa.int64())})

    return settle(joined.mapInArrow(run, MANIFEST), folder, "manifest")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write and read back: RECORDS rows."""
    spark = pages.sparkSession
    manifest = write(pages, shared_dir(spark), **options)
    return read(manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path"))
