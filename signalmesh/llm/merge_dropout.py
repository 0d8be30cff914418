"""SentencePiece encoding with seeded merge-dropout, and decoding.

Works on the merge-type (BPE) model files of the SentencePiece library, whose vocabulary and scores it reads. A text becomes blank-led
units, as no piece holds another character before a blank; each unit is merged by an agenda: the candidate of the best score,
the leftmost on ties, is taken off, and a keyed hash of (seed, document id, position of the unit among the document's units, place in the
unit, piece) skips it with probability `dropout`. Thus every occurrence of a word is varied on its own, and a document's
segmentation never depends on the run, task or order. At dropout 0 the result is the library's own.

What is cached of a unit that recurs is its merges without dropout. An occurrence that skips none of them has the cached ids; the others are
merged together, one agenda step of all of them at a time in numpy; units of more than `WIDE` characters have a heap of
their own and are not cached. Both take the same candidates.

Characters outside the vocabulary become byte pieces; so does a literal U+2581, which the library would confuse
with a blank. Decoding joins the pieces' bytes and drops the leading blank that encoding put there: it is lossless.

Defined cases: null and empty texts have no ids and decode to the empty text; null ids are one id; repeated rows
with equal ids have equal ids.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, mix64, small_batches, text_or_empty

BLANK_MARK = "▁"
UNITS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
#: Units that one generation of the cache holds; there are two generations.
CACHE_UNITS = 160_000
#: Occurrences whose candidates are hashed together.
HASHED = 1 << 16
#: Characters up to which units are merged in numpy, and units of one step.
WIDE, STEP_UNITS = 48, 4096
_MASK = 2**64 - 1
_PLACE, _PIECE, _LAST = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def units_of(text: str) -> list[str]:
    """The units of a text behind a blank; those of an empty text are none."""
    if not text:
        return []
    text = " " + text
    if "  " in text or "\0" in text:
        return UNITS.findall(text)
    return list(filter(None, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


def candidate(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) * np.uint64(_PLACE) + piece.astype(np.uint64) * np.uint64(_PIECE)


def skipped(keys: np.ndarray, candidates: np.ndarray, threshold: int) -> np.ndarray:
    return (keys ^ candidates) * np.uint64(_LAST) >> np.uint64(32) < threshold


class Model:
    """Pieces, scores and byte pieces of a model file, and the caches of one worker process."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.merges: dict[str, tuple[float, int]] = {}
        parts: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        for i in ids:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                parts.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                parts.append(b"")
            else:
                self.merges[piece] = (-sp.get_score(i), i)
                parts.append(piece.replace(BLANK_MARK, " ").encode())
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte fallback, so it cannot decode every text")
        if any("\n" in p or BLANK_MARK in p.lstrip(BLANK_MARK) for p in self.merges):
            raise ValueError("a piece of the model spans units")
        self.code = "H" if len(parts) <= 1 << 16 else "I"
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.cache = UnitCache(self)
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, (_, i) in self.merges.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.of_char[ord(" ")], self.of_char[ord(BLANK_MARK)] = self.of_char[ord(BLANK_MARK)], -1
        pairs = [(self.merges[p[:k]][1], self.merges[p[k:]][1], cost, i) for p, (cost, i) in self.merges.items() for k in range(1, len(p)) if p[:k] in self.merges and p[k:] in self.merges]
        a, b, cost, made = (np.array(x) for x in zip(*pairs, strict=True))
        self.count = len(parts)
        key = a.astype(np.int64) * self.count + b
        order = np.argsort(key)
        self.pair_key, self.pair_cost, self.pair_made = key[order], cost[order].astype(np.float32), made[order].astype(np.int32)
        bits = 21
        slot = self._slot(self.pair_key, bits)
        self.pair_bits, self.pair_first = bits, np.searchsorted(slot[by := np.argsort(slot, kind="stable")], np.arange((1 << bits) + 1)).astype(np.int32)
        self.pair_key, self.pair_cost, self.pair_made = (x[by] for x in (self.pair_key, self.pair_cost, self.pair_made))
        self.pair_chain = int(np.diff(self.pair_first).max())

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(_PLACE) >> np.uint64(64 - bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, piece) of merging neighbours; infinite cost where no piece is their join or one is negative."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.count + b, 0)
        slot = self._slot(key, self.pair_bits)
        first, last = self.pair_first[slot], self.pair_first[slot + 1]
        cost, made = np.full(a.shape, np.inf, np.float32), np.zeros(a.shape, np.int32)
        for k in range(self.pair_chain):
            at = np.minimum(first + k, len(self.pair_key) - 1)
            hit = (first + k < last) & (self.pair_key[at] == key)
            cost[hit], made[hit] = self.pair_cost[at[hit]], self.pair_made[at[hit]]
        cost[(a < 0) | (b < 0)] = np.inf
        return cost, made

    def candidates(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, keys: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """`pairs`, of infinite cost where the keyed hash skips them."""
        cost, made = self.pairs(a, b)
        if threshold:
            cost[skipped(keys, candidate(place, made), threshold)] = np.inf
        return cost, made

    def segment_all(self, units: list[str], keys: np.ndarray | int, threshold: int, trails: list[bytes] | None = None) -> list[bytes]:
        """Packed ids of many units, each under its key or all under one; `trails` takes the hashed candidates each merged (numpy units only)."""
        out: list[bytes] = [b""] * len(units)
        all_keys = np.broadcast_to(np.asarray(keys, np.uint64), len(units))
        size = np.array([len(u) for u in units], np.int64)
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), STEP_UNITS):
            step = order[lo : lo + STEP_UNITS]
            chars = np.frombuffer("".join([units[k] for k in step]).encode("utf-32-le"), np.uint32)
            n = size[step]
            start = np.cumsum(n) - n
            keys = all_keys[step]
            few = n <= WIDE
            for k in np.flatnonzero(~few).tolist():
                out[step[k]] = array(self.code, self.segment(units[step[k]], int(keys[k]), threshold)).tobytes()
            if not few.any():
                continue
            n, keys, rows = n[few], keys[few], step[few]
            width = int(n.max())
            cell = np.arange(width)
            inside = cell < n[:, None]
            cp = chars[np.where(inside, start[few][:, None] + cell, 0)].astype(np.int32)
            known = self.of_char[cp]
            sym = np.where(inside, np.where(known >= 0, known, -2 - cp), -1)
            done = np.empty((len(rows), width), np.int32)
            place = np.broadcast_to(cell, sym.shape).copy()
            live = np.arange(len(rows))
            steps: list[tuple[np.ndarray, np.ndarray]] = []
            cost, made = self.candidates(sym[:, :-1], sym[:, 1:], place[:, :-1], keys[:, None], threshold)
            while len(live) and sym.shape[1] > 1:
                best = cost.argmin(1)
                going = np.isfinite(cost[np.arange(len(live)), best])
                if not going.all():
                    over = ~going
                    done[live[over], : sym.shape[1]] = sym[over]
                    done[live[over], sym.shape[1] :] = -1
                    live, sym, place, keys, best, cost, made = (x[going] for x in (live, sym, place, keys, best, cost, made))
                line = np.arange(len(live))
                if trails is not None:
                    steps.append((live, candidate(place[line, best], made[line, best])))
                sym[line, best] = made[line, best]
                from_ = np.arange(sym.shape[1] - 1)
                from_ = from_ + (from_ > best[:, None])
                sym, place = np.take_along_axis(sym, from_, 1), np.take_along_axis(place, from_, 1)
                cost, made = np.take_along_axis(cost, from_[:, :-1], 1), np.take_along_axis(made, from_[:, :-1], 1)
                for cells in (best - 1, best):  # only the merged symbol's own pairs are new
                    near = np.flatnonzero((cells >= 0) & (cells < cost.shape[1]))
                    c = cells[near]
                    cost[near, c], made[near, c] = self.candidates(sym[near, c], sym[near, c + 1], place[near, c], keys[near], threshold)
            done[live, : sym.shape[1]] = sym
            done[live, sym.shape[1] :] = -1
            count = (done != -1).sum(1)
            if steps:
                of = np.concatenate([r for r, _ in steps])
                taken = np.concatenate([c for _, c in steps])[np.argsort(of, kind="stable")].tobytes()
                at = 0
                for k, end in zip(rows.tolist(), (np.cumsum(np.bincount(of, minlength=len(rows))) * 8).tolist(), strict=True):
                    trails[k] = taken[at:end]
                    at = end
            packed = done[done != -1].astype(np.dtype(self.code)).tobytes()
            wide = np.dtype(self.code).itemsize
            ends = (np.cumsum(count) * wide).tolist()
            at = 0
            for k, end in zip(rows.tolist(), ends, strict=True):
                out[k] = packed[at:end]
                at = end
            for k in np.flatnonzero((done < -1).any(1)).tolist():
                ids: list[int] = []
                for x in done[k][: count[k]].tolist():
                    ids += [x] if x >= 0 else [self.byte_ids[c] for c in chr(-2 - x).encode()]
                out[rows[k]] = array(self.code, ids).tobytes()
        return out

    def symbols(self, unit: str) -> list[str | None]:
        """The unit's characters as pieces; None for one that has only byte pieces."""
        return [BLANK_MARK if c == " " else c if c != BLANK_MARK and c in self.merges else None for c in unit]

    def segment(self, unit: str, key: int, threshold: int) -> list[int]:
        """Piece ids of a unit; candidates whose keyed hash is below the threshold are skipped."""
        sym, merges = self.symbols(unit), self.merges
        n = len(sym)
        agenda = [(found[0], i, i + 1, found[1]) for i in range(n - 1) if (a := sym[i]) is not None and (b := sym[i + 1]) is not None and (found := merges.get(a + b))]
        if agenda:
            heapify(agenda)
            size = [len(s) if s is not None else 1 for s in sym]
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            while agenda:
                _, i, j, piece = heappop(agenda)
                a, b = sym[i], sym[j] if j < n else None
                if a is None or b is None or not size[i] or not size[j] or right[i] != j or (found := merges.get(a + b)) is None or found[1] != piece:
                    continue
                if threshold and ((key ^ (i * _PLACE + piece * _PIECE) & _MASK) * _LAST & _MASK) >> 32 < threshold:
                    continue
                sym[i], size[i], size[j] = a + b, 1, 0
                k = right[j]
                right[i] = k
                if k < n:
                    left[k] = i
                    if (c := sym[k]) is not None and (found := merges.get(a + b + c)):
                        heappush(agenda, (found[0], i, k, found[1]))
                h = left[i]
                if h >= 0 and (c := sym[h]) is not None and (found := merges.get(c + a + b)):
                    heappush(agenda, (found[0], h, i, found[1]))
            at = [i for i in range(n) if size[i]]
        else:
            at = range(n)
        out: list[int] = []
        for i in at:
            if sym[i] is None:
                out += [self.byte_ids[x] for x in unit[i].encode()]
            else:
                out.append(merges[sym[i]][1])
        return out

    def encode_all(self, texts: list[str], docs: list[int | None], seed: int = 0, dropout: float = 0.0) -> list[bytes]:
        """Packed ids of each text, varied by its document's id."""
        threshold = int(dropout * 2**32)
        number: defaultdict[str, int] = defaultdict(count().__next__)
        at = [np.fromiter(map(number.__getitem__, units_of(t)), np.int64) for t in texts]
        units = list(number)
        size = np.array([len(x) for x in at], np.int64)
        ends = np.cumsum(size)
        own = np.concatenate(at) if at else np.zeros(0, np.int64)
        again = (np.bincount(own, minlength=len(units)) > 1).tolist()
        held = self.cache.learn(units, again)
        known = [held.get(u, (None, b"")) for u in units]
        ids, trails = [x for x, _ in known], [x for _, x in known]
        alone = np.array([x is None for x in ids], bool)
        trail = np.frombuffer(b"".join(trails), np.uint64)
        length = np.array([len(x) // 8 for x in trails], np.int64)
        first = np.cumsum(length) - length
        base = np.repeat(np.array([doc_key(i, seed) for i in docs], np.uint64), size)
        keys = mix64(base + (np.arange(len(own)) - np.repeat(ends - size, size)).astype(np.uint64) * np.uint64(_PLACE))
        varied = alone[own]
        for lo in range(0, len(own) if threshold else 0, HASHED):
            unit = own[lo : lo + HASHED]
            n = length[unit]
            owner = np.repeat(np.arange(len(unit)), n)
            of = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - first[unit], n)
            varied[lo + owner[skipped(keys[lo + owner], trail[of], threshold)]] = True
        parts = [ids[k] for k in own.tolist()]
        where = np.flatnonzero(varied)
        for k, found in zip(where.tolist(), self.segment_all([units[k] for k in own[where].tolist()], keys[where], threshold), strict=True):
            parts[k] = found
        return [b"".join(parts[end - n : end]) for n, end in zip(size.tolist(), ends.tolist(), strict=True)]

    def encode(self, text: str, seed: int = 0, doc_id: int | None = None, dropout: float = 0.0) -> bytes:
        """Packed ids of a text."""
        return self.encode_all([text], [doc_id], seed, dropout)[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that ids stand for, without the leading blank."""
        if not len(ids):
            return b""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.starts[ids] - end + size, size)
        return self.pool[at][1:].tobytes()


class UnitCache:
    """Packed ids and merges of units without dropout. A full generation replaces the one before, whose units return as they recur."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.now: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}

    def learn(self, units: list[str], again: list[bool]) -> dict[str, tuple[bytes, bytes]]:
        """The cache, which now holds every unit that it knew or that occurs again, but no wide one."""
        if len(self.now) + len(units) > CACHE_UNITS:
            self.before, self.now = self.now, {}
        missing = []
        for u, more in zip(units, again, strict=True):
            if u in self.now:
                continue
            if (found := self.before.get(u)) is not None:
                self.now[u] = found
            elif more and len(u) <= WIDE:
                missing.append(u)
        trails = [b""] * len(missing)
        ids = self.model.segment_all(missing, 0, 0, trails)
        self.now.update(zip(missing, zip(ids, trails, strict=True), strict=True))
        return self.now


@lru_cache(maxsize=1)
def model_of(path: str) -> Model:
    """One model, with its caches, for all tasks that a worker process runs."""
    return Model(path)


def doc_key(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh3_64_intdigest("" if doc_id is None else str(doc_id), seed=seed & _MASK)


def _mapped(docs: DataFrame, model: str, id_col: str, text_col: str, seed: int, dropout: float, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("merge_dropout", model_of.cache_clear)
        own = model_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                packed = own.encode_all(texts, ids, seed, dropout)
                rows = [(i, *row(own, text, p)) for i, text, p in zip(ids, texts, packed, strict=True)]
                kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
                names = [c.split() for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n[1]]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], [n[0] for n in names])

    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, dropout: float = 0.1) -> DataFrame:
    """id and ids (array<int>) of each row."""
    return _mapped(docs, model, id_col, text_col, seed, dropout, "id long, ids array<int>", lambda own, text, ids: (np.frombuffer(ids, own.code).astype(np.int32),))


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, dropout: float = 0.1) -> DataFrame:
    """id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 and lossless."""

    def row(own: Model, text: str, packed: bytes):
        ids = np.frombuffer(packed, own.code)
        raw = own.decode(ids)
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(raw).hexdigest(), raw == text.encode()

    return _mapped(docs, model, id_col, text_col, seed, dropout, "id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean", row)


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("merge_dropout", model_of.cache_clear)
        own = model_of(model)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(F.col(id_col).cast("long").alias(id_col), ids_col).mapInArrow(run, f"`{id_col}` long, text string")
