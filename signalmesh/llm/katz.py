"""Katz backoff language model: Good-Turing discounted n-grams of order 2 or 3, exactly normalised, in stored tables.

P(w|h) = d(c(h,w)) c(h,w) / c(h) where the training text has (h,w), else alpha(h) P(w|h'), h' without the oldest word of h; a
context without training has alpha 1. d follows Good-Turing up to count 5, on the counts of counts of its order or, where
those give no proper discount, on a power law fitted to them (absolute discounting by one half where that fails too); larger counts lose
`EPSILON` of a count, so that every context keeps mass. P1 is discounted alike, and what it loses belongs to unknown words as
one class. alpha(h) = (1 - sum of P(w|h) over seen w) / (1 - sum of P(w|h') over the same w): each context adds up to one.

`fit` stores a model as Parquet: `unigrams` (word hash, count), for each order k `ngrams-k` (one row a part: contexts, their words and
counts, packed) and `backoff-k` (context, log10 alpha), `top` (the most frequent n-grams with their probabilities) and `meta`.
`Model.score` rates any texts with it, `Model.load` opens it again. N-grams are dealt to parts by context, a frequent context by context
and word; they are counted within a task before they travel, so a frequent pair costs a row a task. Scoring answers the `top` n-grams (a
bounded broadcast, which changes no result) where the text is read; the others go to their part, are looked up, and unless seen ask for
alpha in `backoff-k` and go on to the next lower order. Words travel as ranks where they are among the `CODES` most frequent ones (a fixed
bound of what is broadcast; it changes no result), else as 63-bit hashes.

Defined cases: null and empty texts consist of the end token; a null id belongs to the held-out fold; equal rows (id and text)
have equal scores; very long texts are read whole, one at a time; other columns are not read, so their names cannot clash;
ties of counts share a fate in every table; with no training row every token is unknown: P1 is then 1, and the score 0.
"""

from __future__ import annotations

import gc
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, buffers, discard, keep_only, mix64, settle, shared_dir, small_batches, steps, text_or_empty, words

K, EPSILON = 5, 1e-3
#: Ranks are below CODES, which itself stands for the place before a text; RARE marks a word that travels as its hash.
CODES, RARE = (1 << 20) - 1, 1 << 20
TOP = np.uint64(1 << 63)
END = np.uint64(0x93198A2E03707344)
_PAIR, _SALT = np.uint64(0x9FB21C651E98DF25), np.uint64(0x243F6A8885A308D3)
SMOOTH = 0.1
#: Tokens that a task holds before it deals them to parts.
FLUSH = 700_000


def discounts(n: list[int]) -> list[float]:
    """d(1..K) from the counts of counts n(1..K+1)."""
    if all(n):
        tail = (K + 1) * n[K] / n[0]
        out = [((r + 1) * n[r] / (n[r - 1] * r) - tail) / (1 - tail) if tail != 1 else 0.0 for r in range(1, K + 1)]
        if all(0 < d < 1 for d in out):
            return out
        x, y = np.log(np.arange(1, K + 2)), np.log(n)
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        if slope < -1:  # counts of counts smoothed as a power of the count
            return [((r + 1) / r) ** (slope + 1) for r in range(1, K + 1)]
    return [1 - 0.5 / r for r in range(1, K + 1)]


def kept_count(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Discounted counts; 0 stays 0."""
    table = np.array([0.0, *(r * x for r, x in enumerate(d, 1))])
    return np.where(c <= K, table[np.minimum(c, K)], c - EPSILON)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, row) of the tokens of a step; each row ends with END."""
    _, _, row, h = words(data, at, BLANK)
    rows = len(at) - 1
    out = np.full(len(h) + rows, END)
    out[np.arange(len(h)) + row] = h | TOP
    return out, np.repeat(np.arange(rows), np.bincount(row, minlength=rows) + 1)


def contexts(ids: np.ndarray, row: np.ndarray, order: int) -> list[np.ndarray]:
    """Context of each token for the orders from `order` down to 2; before a row stands the word CODES."""
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
    out: list[np.ndarray] = []
    for back in range(1, order):
        word = np.full(len(ids), CODES, np.uint64)
        has = np.flatnonzero(place >= back)
        word[has] = ids[has - back]
        out.insert(0, word if back == 1 else longer(out[0], word))
    return out


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A context with one more word on its left."""
    return mix64(context * _PAIR + mix64(word)) | TOP


def gram(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(context * _PAIR + mix64(token ^ _SALT))


def _find(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether found) of x in ascending names."""
    if not len(names):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return at, names[at] == x


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _types(schema: str) -> dict[str, pa.DataType]:
    by_name = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return {c.split()[0]: by_name[c.split()[1]] for c in schema.split(", ")}


def _batches(arrays: dict, types: dict, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(arrays.values())))
    for k in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(arrays[c][k : k + size], t) if c in arrays else pa.nulls(min(size, n - k), t) for c, t in types.items()], list(types))


PACKED = "part int, kind int, rows int, heads int, body binary, odd binary, owners binary"
TABLE = PACKED + ", stats array<long>, spread array<long>, hot array<long>, hot_counts array<long>"
FLAT = "kind int, x long, y long, n long, v double, u double, k long, h long"
MIXED = FLAT + ", " + PACKED.replace("kind int, ", "")
GRAMS, ASKS, DOCS, DOC, PARTIAL, UNSEEN, ASK_UNSEEN, ASK_BASE, CONTEXT, ASK_SEEN, FREQUENT = range(11)


def _flat(types: dict, kind: int, **arrays) -> Iterator[pa.RecordBatch]:
    arrays = {k: np.asanyarray(v) for k, v in arrays.items()}  # a mask stays
    n = len(next(iter(arrays.values())))
    yield from _batches({"kind": np.full(n, kind, np.int32)} | {k: v.view(np.int64) if v.dtype == np.uint64 else v for k, v in arrays.items()}, types)


def unigrams(own: DataFrame) -> DataFrame:
    """(word hash, count) of the tokens of `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h)
            h, c = h[order], np.concatenate([x[1] for x in held])[order]
            head = _heads(h)
            yield from _batches({"w": h[head].view(np.int64), "c": np.add.reduceat(c, head)}, {"w": pa.int64(), "c": pa.int64()})

        for batch in batches:
            data, at = buffers(batch.column(0))
            for lo, hi in steps(at):
                h, c = np.unique(tokens(data, at[lo : hi + 1])[0], return_counts=True)
                held.append((h, c))
                size += len(h)
                if size > 2_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return own.select("text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Book:
    """What executors hold of the unigrams: the most frequent words, ranked by count."""

    def __init__(self, word: np.ndarray, count: np.ndarray, p1: np.ndarray) -> None:
        rank = np.lexsort((word, -count))
        self.count, self.p1, word = count[rank], p1[rank], word[rank]
        self.log_p1 = np.log10(self.p1)
        order = np.argsort(word)
        self.word, self.rank = word[order], order.astype(np.uint64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ranks of the words held, hashes of others."""
        at, found = _find(self.word, h)
        return np.where(found, self.rank[at], h) if len(self.word) else h


class Level:
    """How the n-grams of one order are dealt to parts; `hot` are the contexts of at least `share` tokens, with their counts."""

    def __init__(self, parts: int, share: int, hot: np.ndarray, counts: np.ndarray, d: list[float] | None = None) -> None:
        order = np.argsort(hot)
        self.parts, self.share, self.hot, self.counts, self.d = parts, share, hot[order], counts[order], d

    def totals(self, context: np.ndarray) -> np.ndarray:
        """Counts of hot contexts, 0 for others."""
        at, found = _find(self.hot, context)
        return np.where(found, self.counts[at], 0) if len(self.hot) else np.zeros(len(context), np.int64)

    def part(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        split = (self.totals(context) // self.share + 1).astype(np.uint64)
        return ((mix64(context) % np.uint64(self.parts) + mix64(token ^ _SALT) % split) % np.uint64(self.parts)).astype(np.int64)


# ------------------------------------------------------------------ packed n-grams
def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of the numbers, byte by byte of significance, which packs better."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _blob(part: int, kind: int, heads: list[np.ndarray], run: np.ndarray, token: np.ndarray, extra: np.ndarray, owners: bytes = b"") -> dict:
    """Runs of tokens under contexts (`heads`: the context and its shorter ones), with a number for each token."""
    ids = [*heads, token]
    body = b"".join([*(_planes(np.minimum(c, np.uint64(RARE)), 3) for c in ids), _planes(run, 4), _planes(extra, 8)])
    odd = b"".join(c[c >= RARE].tobytes() for c in ids)
    return {"part": [part], "kind": [kind], "rows": [len(token)], "heads": [len(run)], "body": [pa.compress(body, "zstd", asbytes=True)], "odd": [odd], "owners": [owners]}


def _unblob(rows: int, heads: int, body: bytes, odd: bytes, cols: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(pa.decompress(body, 3 * (cols * heads + rows) + 4 * heads + 8 * rows, "zstd", asbytes=True), np.uint8)
    whole, at, used = np.frombuffer(odd, np.uint64), 0, 0

    def take(n: int, width: int) -> np.ndarray:
        nonlocal at
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = data[at : at + n * width].reshape(width, n).T
        at += n * width
        return out.view("<u8").ravel()

    ids = [take(n, 3) for n in [heads] * cols + [rows]]
    for c in ids:
        rare = np.flatnonzero(c >= RARE)
        c[rare] = whole[used : used + len(rare)]
        used += len(rare)
    return ids[:-1], take(heads, 4).astype(np.int64), ids[-1], take(rows, 8).astype(np.int64)


def _dealt(level: Level, types: dict, kind: int, chain: list[np.ndarray], token: np.ndarray, owner: np.ndarray | None = None, names: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows by part: distinct n-grams with counts or, with owners, all of them with their owner's place in `names`."""
    if not len(token):
        return
    part, context = level.part(chain[0], token), chain[0]
    room = 43 - int(level.parts).bit_length()
    slot = np.where(context < RARE, context, np.uint64(RARE) | (context & np.uint64(RARE - 1)))
    order = np.argsort(part.astype(np.uint64) << np.uint64(room + 21) | slot << np.uint64(room) | mix64(token ^ _SALT) >> np.uint64(64 - room))
    chain, token, part = [c[order] for c in chain], token[order], part[order]
    if owner is None:  # equal neighbours become one; a duplicate elsewhere is merged in its part
        head = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (chain[0][1:] != chain[0][:-1])]))
        extra = np.diff(np.append(head, len(token)))
        chain, token, part = [c[head] for c in chain], token[head], part[head]
    else:
        extra = owner[order]
    edge = np.append(_heads(part), len(part))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        first = _heads(chain[0][lo:hi])
        run, number, owners = np.diff(np.append(first, hi - lo)), extra[lo:hi], b""
        if owner is not None:
            used, number = np.unique(number, return_inverse=True)
            owners = names[used].tobytes()
        yield from _batches(_blob(int(part[lo]), kind, [c[lo:hi][first] for c in chain], run, token[lo:hi], number, owners), types)


class Grams:
    """The counts of one part: contexts ascending, tokens ascending within each, with probabilities where the level has discounts."""

    def __init__(self, row: tuple | None, cols: int, level: Level) -> None:
        none = np.zeros(0, np.uint64)
        heads, run, self.token, self.count = _unblob(*row, cols) if row else ([none] * cols, none.astype(np.int64), none, none.astype(np.int64))
        self.names, self.shorter = heads[0], heads[1:]
        self.context = np.repeat(np.arange(len(run)), run)
        hot = level.totals(self.names)
        self.total = np.where(hot > 0, hot, np.bincount(self.context, self.count, len(run)).astype(np.int64))
        self.words = np.unique(self.token[self.token >= RARE])
        self.key = self._keys(self.context, self.token)[0]
        if level.d:
            self.kept = kept_count(self.count, level.d)
            self.p = self.kept / self.total[self.context]

    def _keys(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one number for context and token, whether it can be here)."""
        rare = np.flatnonzero(token >= RARE)
        at, found = _find(self.words, token[rare])
        code, can = token.copy(), np.ones(len(token), bool)
        code[rare], can[rare] = at.astype(np.uint64) + np.uint64(RARE), found
        return context.astype(np.uint64) << np.uint64((RARE + len(self.words)).bit_length()) | code, can

    def find(self, context: np.ndarray, run: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, whether found, whether its context is here) of tokens under runs of contexts."""
        at, here = (np.repeat(x, run) for x in _find(self.names, context))
        key, can = self._keys(at, token)
        at, found = _find(self.key, key)
        return at, found & can & here, here


def _by_part(each):
    """Apply each(part, rows) to all rows of a part, a list of (kind, rows, heads, body, odd, owners); parts arrive in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        at, held = None, []
        for batch in batches:
            for part, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at and held:
                    yield from each(at, held)
                    held = []
                at = part
                held.append(tuple(fields))
        if held:
            yield from each(at, held)

    return run


# ------------------------------------------------------------------ training
def _counted(codes, levels, k: int):
    """Packed counts of the n-grams of order k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        book, level, types = codes.value, levels.value, _types(PACKED)
        held: list[tuple] = []
        size = 0

        def flush():
            chain = [np.concatenate([h[0][j] for h in held]) for j in range(k - 1)]
            yield from _dealt(level, types, GRAMS, chain, np.concatenate([h[1] for h in held]))

        for batch in batches:
            data, at = buffers(batch.column(0))
            for lo, hi in steps(at):
                h, row = tokens(data, at[lo : hi + 1])
                ids = book.ids(h)
                held.append((contexts(ids, row, k), ids))
                size += len(ids)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _tables(levels, k: int):
    """One row a part: its n-grams with their counts, counts of counts, and those that are hot contexts of the next order."""

    def each(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        found = [_unblob(*r[1:5], k - 1) for r in rows]
        heads = [np.concatenate([f[0][j] for f in found]) for j in range(k - 1)]
        run, token, count = (np.concatenate([f[j] for f in found]) for j in (1, 2, 3))
        del found
        names, first, of = np.unique(heads[0], return_index=True, return_inverse=True)
        context = np.repeat(of, run)
        rare = np.flatnonzero(token >= RARE)
        odd, place = np.unique(token[rare], return_inverse=True)
        code = token.copy()
        code[rare] = place.astype(np.uint64) + np.uint64(RARE)
        key = context.astype(np.uint64) << np.uint64((RARE + len(odd)).bit_length()) | code
        order = np.argsort(key)
        key = key[order]
        head = _heads(key)
        count, order = np.add.reduceat(count[order], head), order[head]
        context, token = context[order], token[order]
        row = _blob(part, GRAMS, [names, *(h[first] for h in heads[1:])], np.bincount(context, minlength=len(names)), token, count)
        often = np.flatnonzero(count >= level.share) if k == 2 else np.zeros(0, np.int64)
        row["stats"] = [np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2].tolist()]
        row["spread"] = [np.bincount(_bucket(count), minlength=256).tolist()]
        row["hot"], row["hot_counts"] = [longer(token[often], names[context[often]]).view(np.int64).tolist()], [count[often].tolist()]
        yield from _batches(row, _types(TABLE))

    return _by_part(each)


def _bucket(count: np.ndarray) -> np.ndarray:
    return (4 * np.log2(count)).astype(np.int64)


def _weighed(codes, levels, k: int, least: int, below):
    """Contexts with lost and lower mass, the most frequent n-grams, and what asks for lower probabilities."""

    def each(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        book, level = codes.value, levels.value
        types = _types(MIXED)
        for row in rows:
            g = Grams(row[1:5], k - 1, level)
            n = len(g.names)
            low = np.zeros(n)
            if k == 2:
                rare = g.token >= RARE
                low = np.bincount(g.context[~rare], book.p1[g.token[~rare].astype(np.int64)], n) if len(book.p1) else low
                yield from _flat(types, ASK_SEEN, x=g.token[rare], y=g.names[g.context[rare]], n=np.ones(int(rare.sum()), np.int64))
            else:
                yield from _dealt(below.value, types, ASKS, [s[g.context] for s in g.shorter], g.token, g.context, g.names.view(np.int64))
            yield from _flat(types, CONTEXT, x=g.names, n=g.total, v=low, u=np.bincount(g.context, g.count - g.kept, n))
            often = np.flatnonzero(_bucket(g.count) >= least)
            yield from _flat(types, FREQUENT, x=gram(g.names[g.context[often]], g.token[often]), v=np.log10(g.p[often]))

    return _by_part(each)


# ------------------------------------------------------------------ scoring
def _asked(codes, levels, order: int, frequent, shift: float):
    """Documents with the sums of what is known here, and the other n-grams for their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        book, level, (often, log_p) = codes.value, levels.value, frequent.value
        types = _types(PACKED)
        base = np.log10(book.count + SMOOTH) - shift
        held: list[tuple] = []
        size = docs = 0

        def flush():
            chain = [np.concatenate([h[0][j] for h in held]) for j in range(order - 1)]
            yield from _dealt(level, types, ASKS, chain, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))

        for batch in batches:
            data, at = buffers(batch.column(1))
            key, held_out = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for lo, hi in steps(at):
                h, row = tokens(data, at[lo : hi + 1])
                ids, n = book.ids(h), hi - lo
                chain, own = contexts(ids, row, order), batch.column(0).slice(lo, n)
                known = ids < CODES
                place, here = _find(often, gram(chain[0], ids))
                fields = [
                    key[lo:hi].astype(np.int64), own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), own.is_null().to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(row, minlength=n),
                    np.bincount(row[known], base[ids[known].astype(np.int64)], n), np.bincount(row[here], log_p[place[here]], n), np.bincount(row[known], minlength=n), held_out[lo:hi].astype(np.int64),
                ]
                part = int(mix64(key[lo : lo + 1].astype(np.int64).view(np.uint64))[0] % np.uint64(level.parts))
                yield from _batches({"part": [part], "kind": [DOCS], "rows": [n], "heads": [0], "body": [b"".join(f.tobytes() for f in fields)], "odd": [ids[~known].tobytes()], "owners": [row[~known].astype(np.int64).tobytes()]}, types)
                held.append(([c[~here] for c in chain], ids[~here], row[~here] + docs, key[lo:hi].astype(np.int64)))
                size, docs = size + int((~here).sum()), docs + n
                if size > FLUSH or docs > FLUSH:
                    yield from flush()
                    held, size, docs = [], 0, 0
        if held:
            yield from flush()

    return run


def _answered(codes, levels, k: int, below, summed: bool = False):
    """Owners' sums of log10 P over the n-grams seen in a part (`summed`: of P); of the others, what asks for alpha and the next order."""

    def each(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        book, level = codes.value, levels.value
        types = _types(FLAT if k == 2 else MIXED)
        g = Grams(next((r[1:5] for r in rows if r[0] == GRAMS), None), k - 1, level)
        log_p = g.p if summed else np.log10(g.p)
        for _, n, _, body, odd, owners in (r for r in rows if r[0] == DOCS):
            key, own, empty, size, base, here, known, held = (np.frombuffer(body, np.float64 if j in (4, 5) else np.int64, n, 8 * n * j) for j in range(8))
            yield from _flat(types, DOC, x=key, y=np.ma.array(own, mask=empty != 0), n=size, v=base, u=here, k=known, h=held)
            asks = np.frombuffer(owners, np.int64)
            yield from _flat(types, ASK_BASE, x=np.frombuffer(odd, np.uint64), y=key[asks], n=np.ones(len(asks), np.int64))
        asks = [(_unblob(*r[1:5], k - 1), np.frombuffer(r[5], np.int64)) for r in rows if r[0] == ASKS]
        if not asks:
            return
        heads = [np.concatenate([a[0][0][j] for a in asks]) for j in range(k - 1)]
        run, token = (np.concatenate([a[0][j] for a in asks]) for j in (1, 2))
        base = np.cumsum([0, *(len(a[1]) for a in asks)])
        keys, same = np.unique(np.concatenate([a[1] for a in asks]), return_inverse=True)
        who = same[np.concatenate([a[0][3] + b for a, b in zip(asks, base[:-1], strict=True)])]
        del asks
        at, found, here = g.find(heads[0], run, token)
        value = np.zeros(len(token))
        value[found] = log_p[at[found]]
        if not summed:
            context = np.repeat(heads[0], run)
            backed = ~found & (here | np.repeat(level.totals(heads[0]) > 0, run))
            yield from _flat(types, UNSEEN, x=keys[who[backed]], y=context[backed], n=np.ones(int(backed.sum()), np.int64))
            if k == 2:
                rare = token >= RARE
                coded, other = np.flatnonzero(~found & ~rare), ~found & rare
                value[coded] = book.log_p1[token[coded].astype(np.int64)]
                yield from _flat(types, ASK_UNSEEN, x=token[other], y=keys[who[other]], n=np.ones(int(other.sum()), np.int64))
            else:
                yield from _dealt(below.value, types, ASKS, [np.repeat(h, run)[~found] for h in heads[1:]], token[~found], who[~found], keys)
        yield from _flat(types, PARTIAL, x=keys, v=np.bincount(who, value, len(keys)))

    return _by_part(each)


def _release(spark: SparkSession) -> None:
    """Let the driver's JVM notice frames that are gone, so that Spark deletes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def _of(df: DataFrame, *kinds: int) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


class Model:
    """A fitted model: its folder, and the numbers that the driver holds."""

    def __init__(self, spark: SparkSession, uri: str, meta: dict) -> None:
        self.spark, self.uri, self.meta, self.order = spark, uri, meta, meta["order"]
        often = self.table("unigrams").where(F.col("c") >= meta["least"]).toArrow()
        count = often["c"].to_numpy().astype(np.int64)
        self.book = Book(often["w"].to_numpy().view(np.uint64), count, kept_count(count, meta["d1"]) / meta["mass"])
        self.codes = spark.sparkContext.broadcast(self.book)
        self.levels: dict = {}

    @classmethod
    def load(cls, spark: SparkSession, uri: str) -> Model:
        """Open the tables that `fit` stored below `uri`."""
        model = cls(spark, uri, json.loads(spark.read.parquet(f"{uri}/meta").first()["meta"]))
        for k, d in model.meta["d"].items():
            model.set_level(int(k), d)
        return model

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.uri}/{name}")

    def set_level(self, k: int, d: list[float] | None = None) -> None:
        """Broadcast how order k is dealt; hot contexts are at most 2^19 words or pairs."""
        m = self.meta
        if k == 2:
            often = np.flatnonzero(self.book.count >= m["share"])
            hot, counts = often.astype(np.uint64), self.book.count[often]
            start = np.uint64(CODES)
        else:
            rows = self.table("ngrams-2").select("hot", "hot_counts").where(F.size("hot") > 0).collect()
            hot = np.array([x for r in rows for x in r["hot"]], np.int64).view(np.uint64)
            counts = np.array([x for r in rows for x in r["hot_counts"]], np.int64)
            start = longer(np.array([CODES], np.uint64), np.array([CODES], np.uint64))[0]
        if m["begins"] >= m["share"]:
            hot, counts = np.append(hot, start), np.append(counts, m["begins"])
        self.levels[k] = self.spark.sparkContext.broadcast(Level(m["parts"], m["share"], hot, counts, d))

    def p1(self, count: Column) -> Column:
        """P1 of a word by its count."""
        low = F.lit(self.meta["unknown"])
        for r, d in enumerate(self.meta["d1"], 1):
            low = F.when(count == r, F.lit(r * d)).otherwise(low)
        return F.when(count > K, count - EPSILON).otherwise(low) / self.meta["mass"]

    def answers(self, k: int, asks: DataFrame, summed: bool = False) -> DataFrame:
        """What the parts of order k say to packed rows."""
        cols = list(_types(PACKED))
        rows = asks.select(cols).unionByName(self.table(f"ngrams-{k}").select(cols))
        dealt = rows.repartition(self.meta["parts"], "part").sortWithinPartitions("part", "kind")
        return dealt.mapInArrow(_answered(self.codes, self.levels[k], k, self.levels.get(k - 1), summed), FLAT if k == 2 else MIXED)

    def score(self, docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
        spark, m = self.spark, self.meta
        small_batches(spark)
        uri, out_uri = shared_dir(spark), shared_dir(spark)
        text, held_out = text_or_empty(text_col), F.lit(True) if held_out is None else held_out
        own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), held_out.alias("held_out"))
        top = self.table("top").toArrow()  # bounded by `cached`
        key, log_p = top["x"].to_numpy().view(np.uint64), top["v"].to_numpy()
        order = np.argsort(key)
        frequent = spark.sparkContext.broadcast((key[order], log_p[order]))
        shift = math.log10(m["tokens"] + SMOOTH * (m["vocabulary"] + 1))
        asks = own.mapInArrow(_asked(self.codes, self.levels[self.order], self.order, frequent, shift), PACKED)
        found = None
        backed = []
        for k in range(self.order, 1, -1):
            said = settle(self.answers(k, asks), uri, f"found-{k}")
            _release(spark)
            backed.append(_of(said, UNSEEN).groupBy("x", "y").agg(F.sum("n").alias("n")).join(self.table(f"backoff-{k}").withColumnRenamed("x", "y"), "y").select("x", (F.col("n") * F.col("alpha")).alias("score")))
            asks, flat = (_of(said, ASKS) if k > 2 else None), said.select(*_types(FLAT)).where(~F.col("kind").isin(ASKS))
            found = flat if found is None else found.unionByName(flat)
        c = F.coalesce(F.col("c"), F.lit(0))
        asked = _of(found, ASK_BASE, ASK_UNSEEN).select("kind", F.col("x").alias("w"), F.col("y").alias("x"), "n").groupBy("kind", "w", "x").agg(F.sum("n").alias("n"))
        asked, plain = asked.join(self.table("unigrams"), "w", "left"), F.col("kind") == ASK_BASE
        said = asked.select("x", F.when(~plain, F.col("n") * F.log10(self.p1(c))).alias("score"), F.when(plain, F.col("n") * (F.log10(c + SMOOTH) - shift)).alias("base"), F.when(plain & (c > 0), F.col("n")).alias("known"))
        for frame in (_of(found, PARTIAL).select("x", F.col("v").alias("score")), *backed):
            said = said.unionByName(frame, allowMissingColumns=True)
        sums = said.groupBy("x").agg(*(F.sum(s).alias(f"all_{s}") for s in ("score", "base", "known")))
        rows = _of(found, DOC)
        sums = rows.groupBy("x").agg(F.count("*").alias("times")).join(sums, "x", "left")  # equal rows share a key
        each = lambda name: F.coalesce(F.col(f"all_{name}") / F.col("times"), F.lit(0.0))
        out = rows.join(sums, "x").select(
            F.col("y").alias(id_col), (F.col("h") != 0).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("k") + F.round(each("known"))).cast("long").alias("n_known"), F.lit(m["tokens"]).cast("long").alias("train_tokens"),
            (F.col("v") + each("base")).alias("base_score"), (F.col("u") + each("score")).alias("score"))
        out = settle(out, out_uri, "scores")
        discard(spark, uri)
        _release(spark)
        return out


def fit(docs: DataFrame, order: int = 2, text_col: str = "text", part_tokens: int = 2_000_000, cached: int = 1 << 18, uri: str | None = None) -> Model:
    """Learn from every row and store the model; `part_tokens` sizes parts and `cached` bounds the broadcast n-grams, neither changes a result."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    uri = uri or shared_dir(spark)
    own = docs.select(text_or_empty(text_col).alias("text"))
    table = settle(unigrams(own), uri, "unigrams")
    spread = table.groupBy("c").agg(F.count("*").alias("n")).orderBy("c").toArrow()  # counts of counts, a row for each distinct count
    counts, types = spread["c"].to_numpy(), spread["n"].to_numpy()
    total = int((counts * types).sum())
    of = dict(zip(counts.tolist(), types.tolist(), strict=True))
    d1 = discounts([of.get(r, 0) for r in range(1, K + 2)])
    kept = float((kept_count(counts, d1) * types).sum()) if len(counts) else 0.0
    unknown = max(total - kept, 0.5)
    left = np.cumsum(types[::-1])[::-1]
    least = int(counts[np.flatnonzero(left < CODES)[0]]) if len(counts) and (left < CODES).any() else 1 << 62
    meta = {
        "order": order, "tokens": total, "vocabulary": int(types.sum()), "d1": d1, "unknown": unknown, "mass": kept + unknown, "least": least, "d": {},
        "begins": int(table.where(F.col("w") == int(END.view(np.int64))).agg(F.max("c")).first()[0] or 0), "parts": max(6, -(-total // part_tokens)), "share": max(part_tokens // 4, total >> 19, 1),
    }
    model = Model(spark, uri, meta)
    parts = meta["parts"]
    for k in range(2, order + 1):
        model.set_level(k)
        dealt = own.mapInArrow(_counted(model.codes, model.levels[k], k), PACKED).repartition(parts, "part").sortWithinPartitions("part")
        grams = settle(dealt.mapInArrow(_tables(model.levels[k], k), TABLE), uri, f"ngrams-{k}")
        del dealt
        _release(spark)
        sums = [np.array([r[0] for r in grams.select(c).collect()] or [[0] * n]).sum(0) for c, n in (("stats", K + 1), ("spread", 256))]
        meta["d"][k] = discounts(sums[0].tolist())
        model.set_level(k, meta["d"][k])
        held = np.cumsum(sums[1][::-1])[::-1]
        first = int((held > cached).sum()) if k == order else 1 << 30
        weighed = settle(grams.select(*_types(PACKED)).mapInArrow(_weighed(model.codes, model.levels[k], k, first, model.levels.get(k - 1)), MIXED), uri, f"weighed-{k}")
        if k == 2:
            c = F.col("c")
            rest = _of(weighed, ASK_SEEN).select(F.col("x").alias("w"), F.col("y").alias("x")).join(table, "w").groupBy("x").agg(F.sum(model.p1(c)).alias("rest"))
            floor = unknown / meta["mass"]
        else:
            rest = _of(model.answers(k - 1, _of(weighed, ASKS), summed=True), PARTIAL).groupBy("x").agg(F.sum("v").alias("rest"))
            floor = 1e-15
        sums = _of(weighed, CONTEXT).groupBy("x").agg(F.max("n").alias("c"), F.sum("v").alias("low"), F.sum("u").alias("lost")).join(rest, "x", "left")
        free = F.greatest(1 - F.col("low") - F.coalesce("rest", F.lit(0.0)), F.lit(floor))
        settle(sums.select("x", F.log10(F.col("lost") / F.col("c") / free).alias("alpha")), uri, f"backoff-{k}")
        if k == order:
            settle(_of(weighed, FREQUENT).select("x", "v"), uri, "top")
        del rest, sums, weighed
        discard(spark, f"{uri}/weighed-{k}")
        _release(spark)
    settle(spark.createDataFrame([(json.dumps(meta),)], "meta string"), uri, "meta")
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Every row rated by a model of the rows that are not `held_out`; `settings` are those of `fit`."""
    learned = docs.where(~held_out)
    model = fit(learned, text_col=text_col, **settings)
    out = model.score(docs, held_out, id_col, text_col)
    discard(docs.sparkSession, model.uri)
    return out
