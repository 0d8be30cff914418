"""Line deduplication with two Bloom filters and exact confirmation of suspects.

1. Each task sets the bits of its (document, line key) pairs in a once-seen filter, and in a twice-seen
   filter those that were set before; segments of both meet in a reduction where a bit that two tasks have set
   counts as twice seen. No repeated key is missed; a false alarm only costs a shuffled digest.
2. Only keys that hit the twice-seen filter shuffle, as SHA-256 digests with their document, combined before the
   shuffle; they are counted exactly, and the document that keeps the line is chosen.
3. Repeated keys return to the texts: as a broadcast where their measured count is at most
   `broadcast_keys`, else by a join on the document.

Filters hold `bits_per_line` bits a line up to `max_filter_bits` (a fixed bound of what is broadcast). Beyond it
they fill up, more keys shuffle, and the result stays the same.

Defined cases: null or empty text is one empty line; a null id counts as the smallest id; rows that repeat an
id are one document; short keys are never dropped; ties cannot occur as the largest id is unique; a very long text is one row, split whole in
memory; a kept column whose name is taken comes back as keep_<name>.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, shared_dir, slices, small_batches, text_or_empty

BLANKS = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 19


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The comparison key of a line, or None where it has too few code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64(bits - 1)
    return np.concatenate([hashes & mask, (hashes >> np.uint64(32)) & mask]).astype(np.int64)


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for x in text.split(b"\n") if (k := line_key(x, min_chars)) is not None}


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The bytes of the twice-seen filter of `bits` bits over all documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)  # packed, the highest bit first
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                at = np.unique(_positions(_hashes(_keys(text, min_chars)), bits))
                place, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
                np.bitwise_or.at(twice, place, once[place] & bit)
                np.bitwise_or.at(once, place, bit)
        for k in range(0, bits, SEGMENT):
            if once[k // 8 : (k + SEGMENT) // 8].any():
                both = [zlib.compress(x[k // 8 : (k + SEGMENT) // 8].tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k // SEGMENT], pa.int32()), "once": [both[0]], "twice": [both[1]]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                one, two = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
                if row["segment"] not in state:
                    state[row["segment"]] = [one.copy(), two.copy()]
                else:
                    held = state[row["segment"]]
                    held[1] |= two | held[0] & one
                    held[0] |= one
        for k, (_, two) in state.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "twice": [zlib.compress(two.tobytes(), 1)]})

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(build, "segment int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.repartition("segment").mapInArrow(merge, "segment int, twice binary").toLocalIterator():
        piece = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        out[row["segment"] * SEGMENT // 8 :][: len(piece)] = piece
    return out


def _suspected(keys: list[bytes], bits_of: np.ndarray) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    at = _positions(_hashes(keys), len(bits_of) * 8)
    hit = bits_of[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
    return (hit[: len(keys)] & hit[len(keys) :]).astype(bool)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
                bits_per_line: int = 16, max_filter_bits: int = 1 << 28, broadcast_keys: int = 500_000, keep: list[str] | None = None) -> DataFrame:
    """id, text (kept lines joined by newline), n_lines, n_dropped and the columns named in `keep` for each row; one whose name is taken comes back as keep_<name>."""
    spark = docs.sparkSession
    taken = {id_col, text_col, "n_lines", "n_dropped"}
    small_batches(spark)
    low = -(2**63)
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep or []))
    carried = [f"keep_{c}" for c in keep or []]
    stats = own.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("lines")).first()
    bits = min(max_filter_bits, max(SEGMENT, 1 << max(1, (stats["lines"] or 0) * bits_per_line - 1).bit_length()))
    sc = spark.sparkContext
    seen = sc.broadcast(twice_filter(own, min_chars, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, digests = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = list(_keys(text, min_chars))
                for k in np.flatnonzero(_suspected(keys, seen.value)):
                    ids.append(low if i is None else i)
                    digests.append(hashlib.sha256(keys[k]).digest())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary())})

    uri = shared_dir(spark)
    raw = own.select("id", F.col("text").cast("binary").alias("text"), *carried)
    pairs = settle(raw.select("id", "text").mapInArrow(suspects, "id long, digest binary"), uri, "suspects").distinct()
    repeated = settle(pairs.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("digest", "keep"), uri, "repeated")

    def apply(lookup):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out: dict[str, list] = {"id": [], "text": [], "n_lines": [], "n_dropped": []}
                extra = batch.column("drops").to_pylist() if lookup is None else [None] * batch.num_rows
                for i, text, drops in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), extra, strict=True):
                    lines = text.split(b"\n")
                    drops = set(drops or ())
                    keys = [line_key(x, min_chars) for x in lines]
                    named = [j for j, k in enumerate(keys) if k is not None]
                    gone = set()
                    for j in (named[k] for k in np.flatnonzero(_suspected([keys[j] for j in named], seen.value))):
                        digest = hashlib.sha256(keys[j]).digest()
                        if digest in drops if lookup is None else lookup.value.get(digest, i) != (low if i is None else i) and digest in lookup.value:
                            gone.add(j)
                    out["id"].append(i)
                    out["text"].append(b"\n".join(x for j, x in enumerate(lines) if j not in gone).decode())
                    out["n_lines"].append(len(lines))
                    out["n_dropped"].append(len(gone))
                columns = {"id": pa.array(out["id"], pa.int64()), "text": pa.array(out["text"], pa.string()), "n_lines": pa.array(out["n_lines"], pa.int64()), "n_dropped": pa.array(out["n_dropped"], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | {c: batch.column(c) for c in carried})

        return run

    schema = ", ".join(["id long, text string, n_lines long, n_dropped long", *(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in carried)])
    if repeated.count() <= broadcast_keys:
        lookup = sc.broadcast({bytes(r["digest"]): r["keep"] for r in repeated.toLocalIterator()})
        out = raw.mapInArrow(apply(lookup), schema)
        discard(spark, uri)
    else:
        drops = pairs.join(repeated, "digest").where(F.col("id") < F.col("keep")).groupBy("id").agg(F.collect_list("digest").alias("drops"))
        keyed = raw.withColumn("key", F.coalesce("id", F.lit(low)))
        out = settle(keyed.join(drops.withColumnRenamed("id", "key"), "key", "left").select("id", "text", *carried, "drops").mapInArrow(apply(None), schema), shared_dir(spark), "lines")
        discard(spark, uri)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped", *(F.col(c).alias(c if c.removeprefix("keep_") in taken else c.removeprefix("keep_")) for c in carried))
