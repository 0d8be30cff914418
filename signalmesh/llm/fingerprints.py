"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks boundaries; chunking is normalised: after `min_size` bytes a strict mask
holds up to `normal` bytes, a lenient one beyond, and `max_size` ends a chunk at the latest. As boundaries depend on
nearby bytes only, an edit changes the chunks around it and the rest realign. A fingerprint lists the distinct
64-bit chunk digests with their lengths; containment is the share of a document's chunk bytes whose digests
the other one has.

Hashes of all positions come from five vectorised doubling steps. Defined cases: an empty text has the empty
fingerprint; it is contained in everything (1), and contains only empty texts.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_or_empty

GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
MIN_SIZE, NORMAL, MAX_SIZE = 32, 128, 512
STRICT, LENIENT = np.uint32(0xFF800000), np.uint32(0xF8000000)  # 9 and 5 bits of the oldest bytes' influence


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one its length."""
    n = len(raw)
    if n <= MIN_SIZE:
        return [n] if n else []
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for k in range(5):
        d = 1 << k
        nxt = h.copy()
        nxt[d:] += h[:-d] << np.uint32(d)
        h = nxt
    lenient = np.flatnonzero((h & LENIENT) == 0) + 1
    strict = lenient[(h[lenient - 1] & STRICT) == 0].tolist()
    lenient = lenient.tolist()
    out, start = [], 0
    while n - start > MIN_SIZE:
        i = bisect.bisect_left(strict, start + MIN_SIZE)
        if i < len(strict) and strict[i] <= start + NORMAL:
            end = strict[i]
        else:
            i = bisect.bisect_right(lenient, start + NORMAL)
            end = min(lenient[i] if i < len(lenient) else n, start + MAX_SIZE, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(raw: bytes) -> dict[int, int]:
    """Distinct chunk digests of a text with their lengths."""
    out, start, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in boundaries(raw):
        out[digest(raw[start:end])] = end - start
        start = end
    return out


def as_text(own: dict[int, int]) -> str:
    return ",".join(f"{k:016x}:{v}" for k, v in sorted(own.items()))


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    total = sum(own.values())
    return sum(v for k, v in own.items() if k in other) / total if total else 1.0


def edited_text(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(chunks(t.encode())) for t in batch.column(1).to_pylist()], pa.string())], [id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, fingerprint string")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each row, of its edited text and of the next row in descending id order (circular).

    Ids are cut into ranges by approximate quantiles; each range is sorted in one task, and the row
    that follows its last one, the head of the next range, is sent along as a copy. Heads are found by an
    aggregate over ids alone, so texts shuffle once. Rows that share an id are ordered by text; null ids come
    last. With one row only, the next document is the row itself.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in own.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    low = F.lit(-(2**63)).cast("long")
    # range 0 holds the largest ids; a null id sorts below all
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.coalesce(F.col("id"), low))) if cuts else F.lit(0)
    heads = own.select(part.alias("p"), F.struct(F.col("id").isNotNull().alias("k"), "id").alias("o")).groupBy("p").agg(F.max("o")["id"].alias("head")).orderBy("p").collect()
    if not heads:
        return spark.createDataFrame([], SCHEMA).withColumnRenamed("id", id_col)
    previous = [heads[-1]["p"], *(r["p"] for r in heads[:-1])]
    copies = F.broadcast(spark.createDataFrame([(r["head"], p) for r, p in zip(heads, previous, strict=True)], "head long, copy_to int"))  # a row for each range
    dealt = own.withColumn("p", part).join(copies, F.col("id").eqNullSafe(F.col("head")), "left")
    targets = F.array(F.struct(F.col("p").alias("p"), F.lit(False).alias("copy")), F.struct(F.col("copy_to").alias("p"), F.lit(True).alias("copy")))
    dealt = dealt.select("id", "text", F.explode(F.filter(targets, lambda s: s["p"].isNotNull())).alias("s")).select("id", "text", "s.p", "s.copy")
    placed = dealt.repartition(parts, "p").sortWithinPartitions("p", "copy", F.desc_nulls_last("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row(one, other_text: str, other: dict[int, int]):
            i, text, marks = one
            edited = edited_text(text, other_text)
            edge = chunks(edited.encode())
            return i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(marks), as_text(edge), containment(marks, edge), containment(marks, other)

        at = None
        done = False
        for batch in batches:
            out = []
            for i, text, p, copied in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != at:
                    held, at, done = None, p, False
                if done:  # further rows that share the id of the head
                    continue
                marks = chunks(text.encode())
                if held is not None:
                    out.append(row(held, text, marks))
                held = None if copied else (i, text, marks)
                done = copied
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], NAMES)

    return placed.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
