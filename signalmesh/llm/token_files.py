"""Token files: length-delimited binary records with masked checksums, and an offset index.

A record is [length: u64][masked CRC of the length: u32][body][masked CRC of the body: u32], little-endian; the mask is
the usual rotation by 15 bits plus a constant, over zlib's CRC-32. A body holds the document id, a flag for a null id,
the number of ids, and the ids (unsigned 16 or 32 bit, as the vocabulary needs). A shard's index is a separate file
of framed entries: the offset and token count of every record, so that shuffled reads seek straight to any record.

Documents are range-partitioned and sorted by id; each task writes a shard under a name of its own in the shared
folder. The manifest, settled as Parquet, names the shards that count, so retried tasks leave only unused
files. Starts are a prefix sum over the manifest (a row for each shard) plus the record's place in its shard.

Encoding is the library's own, special tokens in the text included. Under a byte-level tokenizer a text falls apart exactly before any blank or newline
that something other than white space follows (the tokenizer's own split never reaches across), so steps of a task's texts are cut there as bytes; equal
pieces are numbered by Arrow, those not in a bounded cache are encoded by the library, many in a call, and the ids are gathered in numpy. The pieces of
one call are told apart by the bytes that its ids stand for. Under any other tokenizer texts go to the library whole.

Defined cases: null and empty texts hold the end id only; null ids come first; rows that share an id are ordered by text; a very long text is one
record, encoded whole; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, keep_only, open_store, settle, shared_dir, small_batches, steps, text_or_empty

#: Pieces, and bytes of their text, that a worker's cache holds from one step to the next, at most; beyond either, those used most stay, half as many.
CACHE_PIECES, CACHE_BYTES = 600_000, 32 << 20
#: Bytes of the longest piece that then stays.
KEPT_BYTES = 256
#: Bytes of text that a step takes, and one call of the library, a longer single text aside.
STEP_BYTES, CALL_BYTES = 8 << 20, 1 << 18
#: Pieces in one text for the library; pieces whose ids are gathered at once.
CALL_PIECES, GATHER_PIECES = 256, 1 << 19
#: Marks that end a word in one piece of their own, behind ASCII letters and digits and those of U+00C0 to U+00FF.
MARKS = np.isin(np.arange(256), list(b".,;:!?"))
ALNUM = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
#: Bytes that begin no white space: what is ASCII and visible, and all lead bytes but those of U+0080 to U+00BF and U+1000 to U+3FFF.
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = VISIBLE[0xC3:0xF5] = True
VISIBLE[0xE1:0xE4] = False
MANIFEST = "shard long, path string, n_records long, n_tokens long"
HEAD = "<qBI"


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), body, struct.pack("<I", masked(zlib.crc32(body)))))


def unframe(raw: bytes, at: int = 0) -> tuple[bytes, int]:
    """(body, offset behind) of the record at an offset; a failed checksum raises ValueError."""
    size, crc = raw[at : at + 8], raw[at + 8 : at + 12]
    if len(crc) < 4 or struct.unpack("<I", crc)[0] != masked(zlib.crc32(size)):
        raise ValueError(f"length checksum at {at}")
    n = struct.unpack("<Q", size)[0]
    body, crc = raw[at + 12 : at + 12 + n], raw[at + 12 + n : at + 16 + n]
    if len(crc) < 4 or struct.unpack("<I", crc)[0] != masked(zlib.crc32(body)):
        raise ValueError(f"body checksum at {at}")
    return body, at + 16 + n


def is_plain(text: str) -> bool:
    """Whether a text has only single blanks and newlines between its words, and no other white space or control."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n") and text.replace("\n", "").isprintable()


class Encoder:
    """Texts to packed ids. Pieces keep the ids that the library gave them for as long as they are among those used most."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.size = array(self.code).itemsize
        told = json.loads(self.tokenizer.to_str())
        before = told.get("pre_tokenizer") or {}
        added = self.tokenizer.get_added_tokens_decoder()
        loose = any(t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for t in added.values())
        whole = told.get("normalizer") or told.get("truncation") or told.get("padding")
        self.splits = not whole and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not loose
        self.follows, self.marks = VISIBLE.copy(), MARKS.copy()
        for t in added.values():  # white space before an added token is split as at an end, and a token is never cut
            self.follows[list(t.content.encode()[:1])] = False
            self.marks[list(t.content.encode()[-1:])] = False
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of text that each id stands for.
        self.wide = np.zeros(1 + max(vocabulary.values(), default=0), np.int64)
        for token, i in vocabulary.items():
            self.wide[i] = len(added[i].content.encode()) if i in added else len(token)
        self.forget()

    def forget(self) -> None:
        """Empty the cache: pieces, and of each the place and number of its ids in the pool, and how much it was used."""
        self.known = pa.array([], pa.large_binary())
        self.start, self.n, self.use = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.pool = np.zeros(0, self.code)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.code) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces of rows of UTF-8 begin, and the end."""
        edge = np.zeros(len(data) + 1, bool)
        edge[: len(data) - 1] = ((data[:-1] == 32) | (data[:-1] == 10)) & self.follows[data[1:]]
        edge[at[1:][at[1:] > at[:-1]] - 1] = False  # the next row follows nothing
        edge[at] = True
        mark = np.flatnonzero(self.marks[data] & edge[1:])
        mark = mark[mark >= 2]
        last = data[mark - 1]
        edge[mark[ALNUM[last] | (data[mark - 2] == 0xC3) & (last != 0x97) & (last != 0xB7)]] = True
        return np.flatnonzero(edge)

    def fresh(self, pieces: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids, one piece behind the other, and their number in each of distinct pieces."""
        data, at = buffers(pieces)
        raw, at = data[at[0] : at[-1]].tobytes(), at - at[0]
        data = np.frombuffer(raw, np.uint8)
        long = np.flatnonzero(at[1:] - at[:-1] > 1)
        leads = np.zeros(len(pieces), bool)  # of those, any number may stand behind each other and be split as alone
        leads[long] = ((data[at[long]] == 32) | (data[at[long]] == 10)) & self.follows[data[at[long] + 1]]
        runs = np.flatnonzero(~leads | np.r_[True, ~leads[:-1]])  # any other piece is a run of its own
        runs = np.unique(np.r_[np.arange(0, len(pieces), CALL_PIECES), runs, len(pieces)])
        cut = at[runs].tolist()
        got = [x for lo, hi in steps(at[runs], CALL_BYTES) for x in self.ids([raw[a:b].decode() for a, b in zip(cut[lo:hi], cut[lo + 1 : hi + 1], strict=True)])]
        ends = np.cumsum(self.wide[np.concatenate(got)])
        last = np.searchsorted(ends, at[1:])
        if len(ends) and last[-1] == len(ends) - 1 and (ends[last] == at[1:]).all():
            return got, np.diff(last, prepend=-1)
        got = [x for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for x in self.ids([raw[a:b].decode()])]  # ids that do not tell their bytes
        return got, np.array([len(x) for x in got], np.int64)

    def numbered(self, pieces: pa.Array) -> np.ndarray:
        """Each piece's number in the cache, which takes in those that it lacks."""
        have = len(self.known)
        coded = pa.concat_arrays([self.known, pieces]).dictionary_encode()
        own = coded.indices.to_numpy()[have:]
        if len(coded.dictionary) > have:
            got, n = self.fresh(coded.dictionary[have:])
            self.start = np.r_[self.start, len(self.pool) + np.cumsum(n) - n]
            self.n = np.r_[self.n, n]
            self.pool = np.concatenate([self.pool, *got])
            self.known = coded.dictionary
        return own

    def gather(self, own: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces, one behind the other."""
        n = self.n[own]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.start[own] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def age(self, own: np.ndarray) -> None:
        """Count what a step used, and let go of the pieces used least if the cache holds too much."""
        self.use = np.r_[self.use / 2, np.zeros(len(self.known) - len(self.use))] + np.bincount(own, minlength=len(self.known))
        _, at = buffers(self.known)
        if len(self.known) > CACHE_PIECES or at[-1] - at[0] > CACHE_BYTES:
            size = np.diff(at)
            short = np.flatnonzero(size <= KEPT_BYTES)
            first = short[np.argsort(-self.use[short], kind="stable")][: CACHE_PIECES // 2]
            kept = np.sort(first[np.cumsum(size[first]) <= CACHE_BYTES // 2])
            self.pool = self.gather(kept)
            self.known, self.n, self.use = self.known.take(pa.array(kept)), self.n[kept], self.use[kept]
            self.start = np.cumsum(self.n) - self.n

    def encode_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin in them, and the end); nulls are empty."""
        if not self.splits:
            got = [x for t in texts.to_pylist() for x in self.ids([t or ""])]
            return np.concatenate([np.zeros(0, self.code), *got]), np.cumsum([0, *map(len, got)])
        data, at = buffers(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        if not len(data):
            return np.zeros(0, self.code), np.zeros(len(at), np.int64)
        begin = self.cuts(data, at)
        own = self.numbered(pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]))
        out = np.concatenate([self.gather(own[k : k + GATHER_PIECES]) for k in range(0, len(own), GATHER_PIECES)])
        rows = np.r_[0, np.cumsum(self.n[own])][np.searchsorted(begin, at)]
        self.age(own)
        return out, rows

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encode_rows(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder, with its caches, for all tasks that a worker process runs."""
    return Encoder(path)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, as many joined as hold STEP_BYTES."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > STEP_BYTES:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write shards and indexes below a shared folder URI; returns the settled manifest."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    placed = own.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("token_files", encoder_of.cache_clear)
        task, encoder = TaskContext.get(), None
        store, base = open_store(f"{folder}/shards")
        name, file, index, at, total = "", None, [], 0, 0
        for batch in gathered(batches):
            if encoder is None:
                encoder = encoder_of(tokenizer)
                end = array(encoder.code, [end_id]).tobytes()
                store.create_dir(base, recursive=True)
                name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                file = store.open_output_stream(f"{base}/{name}.bin", compression=None)
            ids, edges = encoder.encode_rows(batch.column(1))
            edges = edges.tolist()
            for i, lo, hi in zip(batch.column(0).to_pylist(), edges[:-1], edges[1:], strict=True):
                n = hi - lo + 1
                raw = frame(b"".join((struct.pack(HEAD, i or 0, (i is None) | encoder.size << 1, n), ids[lo:hi].tobytes(), end)))
                file.write(raw)
                index.append((at, n))
                at, total = at + len(raw), total + n
        if file is not None:
            file.close()
            with store.open_output_stream(f"{base}/{name}.idx", compression=None) as f:
                f.write(frame(np.array(index, "<u8").tobytes()))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "path": [f"{folder}/shards/{name}"], "n_records": pa.array([len(index)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    return settle(placed.mapInArrow(run, MANIFEST), folder, "manifest")


def read_index(path: str) -> np.ndarray:
    """(offset, token count) of each record of a shard."""
    store, local = open_store(f"{path}.idx")
    with store.open_input_stream(local, compression=None) as f:
        return np.frombuffer(unframe(f.read())[0], "<u8").reshape(-1, 2)


def read_record(file, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """(document id, ids) of the record of a shard at an offset, `size` bytes long."""
    file.seek(offset)
    body, _ = unframe(file.read(size))
    i, flags, n = struct.unpack_from(HEAD, body)
    return None if flags & 1 else i, np.frombuffer(body, f"<u{flags >> 1}", n, struct.calcsize(HEAD))


def read(manifest: DataFrame) -> DataFrame:
    """id, start, n_tokens, ids (array<int>) of every record of the shards, through their indexes."""
    return _read(manifest, "ids array<int>", lambda ids: ids.astype(np.int32), pa.list_(pa.int32()))


def read_digests(manifest: DataFrame) -> DataFrame:
    """id, start, n_tokens and ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return _read(manifest, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(manifest: DataFrame, column: str, of, kind: pa.DataType) -> DataFrame:
    base = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each shard
    based = manifest.withColumn("base", F.coalesce(base, F.lit(0).cast("long"))).select("path", "base")
    spread = based.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start in (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            store, local = open_store(f"{path}.bin")
            index = read_index(path)
            with store.open_input_file(local) as file:
                ends = np.append(index[1:, 0], file.size())
                for k in range(0, len(index), 512):
                    rows = []
                    for (at, n), stop in zip(index[k : k + 512].tolist(), ends[k : k + 512].tolist(), strict=True):
                        i, ids = read_record(file, at, int(stop) - at)
                        if len(ids) != n:
                            raise ValueError(f"{path}: the index has {n} ids at {at}, the record {len(ids)}")
                        rows.append((i, start, n, of(ids)))
                        start += n
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)], ["id", "start", "n_tokens", column.split()[0]])

    return spread.mapInArrow(run, f"id long, start long, n_tokens long, {column}")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write and read back the digests of every record."""
    return read_digests(write(docs, shared_dir(docs.sparkSession), tokenizer, **options))
