"""Exact n-gram Jaccard join by universe partitions and the pigeonhole principle.

Two shingle sets x, y with |y| <= |x| and Jaccard >= t differ in at most H = (1-t)/(1+t) (|x|+|y|) elements. Sizes are
cut into bands; each band hashes the universe into m segments, and every set is indexed in its own band: one signature
for each segment that it fills, and for some segments also its one-deletion neighbourhood. A set probes its own band
and those below that hold sizes of at least t |x|. Its allocation spends H + 1 units where they are cheapest: one unit for a
segment's exact signature, largest (most selective) segments first, empty ones never; two units for a segment with
one-deletion neighbours, if exact ones don't suffice. By the pigeonhole principle some unit then meets y. For a set for which even
that doesn't suffice, its least elements are joined with those of all sets (two sets that link share one of their
(1-t) n + 1 least elements), at any number of such sets.

Signatures travel as packed arrays of 17 bytes a row, one block for each part and flush, and are grouped in vectorised reductions. Only rows go on that
have a partner under their signature: an indexed row needs a probing one of a fitting larger or equal size, a probing row an indexed one of a
fitting smaller or equal size. Sets, not documents, are the nodes: copies collapse to one node before anything is paired.

The rows of a signature are dealt into cells of about `cell_rows` rows at most, so that a hot signature spreads over many tasks. In the first turn cells of
`small` rows or fewer pair all their rows, larger ones pair each row with the cell's first (a star), and the first rows of a hot signature's cells
meet the least of them. Verified links merge components; only signatures that still span several components take part in further turns, where
pivots, chosen by hash and more each turn, meet the rows of their cell, and those of a hot signature a copy of theirs in every other cell, until every row is
a pivot. There, and before any text is read, parity sketches (1024 buckets of the universe, one bit each: the parity of a set's elements there) refute
pairs that differ in more than H bits: that count never exceeds the sets' true difference, so such a pair cannot link. No pair within a signature is lost: it
is verified, its sketches refute it, or both ends are already connected. Verification compares the whole word 5-grams of both texts.

Nodes are named by 64 bits of a BLAKE2 digest of their hashed set. Defined cases: A-Z fold; fewer words than `size` make one
shingle of the whole sequence; a text without words is empty, linked with nothing, its own component; rows that
repeat an id are separate rows whose component is named by the smallest id; a null id never names one unless alone; a very long text is one
set, read whole, in a vectorised step of its own; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, buffers, discard, keep_only, mix64, rolled, settle, shared_dir, small_batches, steps, text_or_empty, words

INDEX, EXACT, SPENT = range(3)
_SEG, _BAND, _WEIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
#: Of a signature, the bits that travel within its part; equal ones by chance only cost a comparison.
_NARROW = np.uint64((1 << 40) - 1)
#: The most signatures that a mark lets a set skip, fewer than it may.
_SPARE = (1 << 10) - 1
#: 64-bit words of a parity sketch.
SKETCH = 16
_BUCKET = np.uint64(0x589965CC75374CC3)


@dataclass(frozen=True)
class Bands:
    """Size bands: their largest sizes, segment counts and number of segments with one-deletion neighbours.

    Bands up to `all_to` have such neighbours in every segment, larger ones in `some`; `share` scales the segment counts.
    """

    percent: int = 80
    ratio: float = 1.6
    all_to: int = 64
    some: int = 4
    share: float = 1.0

    def tables(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tops = [1]
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, int(tops[-1] * self.ratio)))
        top = np.array(tops, np.int64)
        most = self.differences(top + top * 100 // self.percent) + 1
        return top, np.maximum(1, ((most + np.maximum(2, most // 8)) * self.share).astype(np.int64)), np.where(top <= self.all_to, 1 << 30, self.some)

    def differences(self, total: np.ndarray) -> np.ndarray:
        return total * (100 - self.percent) // (100 + self.percent)


def step_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row bounds, hashed shingles): the sorted distinct shingles of each row of a step."""
    _, _, row, h = words(data, at, BLANK)
    rows = len(at) - 1
    count = np.bincount(row, minlength=rows)
    s, r = rolled(h, size), row[: max(0, len(h) - size + 1)]
    whole = r == row[size - 1 :] if len(s) else np.zeros(0, bool)
    s, r = s[whole], r[whole]
    first = np.cumsum(count) - count
    for k in np.flatnonzero((count > 0) & (count < size)).tolist():
        s = np.append(s, rolled(h[first[k] : first[k] + count[k]], int(count[k])) ^ np.uint64(count[k]))
        r = np.append(r, k)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    return np.searchsorted(r, np.arange(rows + 1)), s


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(bound: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Parity sketches, one row of SKETCH words for each set: two differ in at most as many bits as their sets in elements."""
    out = np.zeros((len(bound) - 1) * SKETCH, np.uint64)
    bit = mix64(s ^ _BUCKET) % np.uint64(64 * SKETCH)
    row = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    np.bitwise_xor.at(out, row * SKETCH + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(-1, SKETCH)


def signatures(bound: np.ndarray, s: np.ndarray, bands: Bands):
    """(signature, row, mark) arrays of the sets of a step, and the rows whose allocation falls short.

    A mark holds the number of signatures that the set may skip in this band, how many bands down it is, and the kind: INDEX (a
    one-deletion neighbour, only indexed), EXACT, or SPENT (a one-deletion neighbour that is also probed).
    """
    n = np.diff(bound)
    top, parts, special = bands.tables(int(max(n, default=1)) * 2)
    own = np.searchsorted(top, n)
    least = np.searchsorted(top, -(-n * bands.percent // 100))
    row_of = np.repeat(np.arange(len(n)), n)
    weight = mix64(s ^ _WEIGHT)
    place = mix64(s ^ _SEG)
    out, short = [], np.zeros(len(n), bool)
    for down in range(int((own - least).max(initial=0)) + 1):
        chosen = (n > 0) & (own - down >= least)
        element = chosen[row_of]
        r, w = row_of[element], weight[element]
        if not len(r):
            continue
        band = own - down
        seg = (place[element] % parts[band][r].astype(np.uint64)).astype(np.int64)
        key = r * int(parts.max()) + seg
        order = np.argsort(key, kind="stable")
        key, w, r, seg = key[order], w[order], r[order], seg[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(key)))
        total = np.add.reduceat(w, head)
        gr, gs = r[head], seg[head]
        salt = gs.astype(np.uint64) * _SEG + band[gr].astype(np.uint64) * _BAND
        need = bands.differences(n + np.minimum(n, top[band])) + 1
        filled = np.bincount(gr, minlength=len(n))
        spare = np.maximum(0, filled - need)
        missing = np.where(chosen, np.maximum(0, need - filled), 0)
        can = (gs < special[band][gr]) & (size > 1)
        usable = np.bincount(gr[can], minlength=len(n))
        short |= missing > usable
        order2 = np.flatnonzero(can)  # rows ascend, so each row's usable segments are counted from its first
        rank2 = np.full(len(gr), 1 << 40)
        rank2[order2] = np.arange(len(order2)) - (np.cumsum(usable) - usable)[gr[order2]]
        spent = rank2 < missing[gr]
        group = np.repeat(np.arange(len(head)), size)
        near = (can if down == 0 else spent)[group]
        out.append((mix64(total + salt), gr, (np.minimum(spare, _SPARE)[gr] << 6 | down << 2 | EXACT).astype(np.uint16)))
        out.append((mix64(total[group] - w + salt[group])[near], r[near], (down << 2 | np.where(spent[group][near], SPENT, INDEX)).astype(np.uint16)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16), short
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), short)


def partnered(sig: np.ndarray, n: np.ndarray, mark: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asks, asked, cost) of rows sorted by signature: whether a row may probe, or be probed by, one of fitting size; rows of its signature."""
    group = np.cumsum(np.concatenate([[0], sig[1:] != sig[:-1]])).astype(np.int64) if len(sig) else np.zeros(0, np.int64)
    probe, index, n = mark & 3 != INDEX, mark >> 2 & 15 == 0, n.astype(np.int64)
    key = group << 32 | n
    order = np.argsort(key, kind="stable")
    at = key[order]
    probes, indexed = (np.concatenate([[0], np.cumsum(x[order])]) for x in (probe, index))
    first, behind = np.searchsorted(at, key), np.searchsorted(at, key, "right")
    largest, least = np.minimum(n * 100 // percent, (1 << 32) - 1), -(-n * percent // 100)
    asked = index & (probes[np.searchsorted(at, group << 32 | largest, "right")] - probes[first] > probe)
    asks = probe & (indexed[behind] - indexed[np.searchsorted(at, group << 32 | least)] > index)
    return asks, asked, np.bincount(group[asks | asked], minlength=int(group[-1]) + 1 if len(group) else 0)[group]


def allocated(met: DataFrame) -> DataFrame:
    """(sig, node, n, cost, probe, index): each set skips as many of its most shared signatures as it may."""
    kind, down = F.col("mark").bitwiseAND(3), F.shiftright("mark", 3).bitwiseAND(15)
    dear = F.row_number().over(Window.partitionBy("node", kind, down).orderBy(F.desc("cost"), "sig"))
    probe = (kind == SPENT) | (kind == EXACT) & (dear > F.shiftright("mark", 7))
    return met.select("sig", "node", "n", "cost", probe.alias("probe"), (F.col("mark").bitwiseAND(4) != 0).alias("index")).where("probe or index")


def _by_cell(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, first row of each cell) of whole cells, about `rows` rows at a time; batches are sorted by their first two columns, signature and cell."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False).astype(bool if pa.types.is_boolean(c.type) else np.int64) for c in batch.columns])
            size += batch.num_rows
        if size > rows:
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            head = np.flatnonzero(np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]))
            held, size = [[c[head[-1] :] for c in x]], len(x[0]) - int(head[-1])  # the last cell may go on in the next batch
            if len(head) > 1:
                yield [c[: head[-1]] for c in x], head[:-1]
    if size:
        x = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield x, np.flatnonzero(np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]))


def _fit(n, probe, index, n2, probe2, index2, percent: int):
    """Whether the larger set probes, the smaller is indexed, and their sizes allow a link."""
    return ((n >= n2) & probe & index2 | (n2 >= n) & probe2 & index) & (100 * np.minimum(n, n2) >= percent * np.maximum(n, n2))


def cells(group: DataFrame, percent: int, cell_rows: int, small: int) -> DataFrame:
    """The first turn: (a, b) of all pairs of small cells and of each larger one's star, and with b null the rows of cells that this leaves open."""
    names, kinds = ["a", "b", "sig", "cell", "n", "probe", "index", "cost", "head"], [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for (sig, cell, node, n, probe, index, cost), head in _by_cell(batches, 50_000):
            size = np.diff(np.append(head, len(sig)))
            top, few, at = np.repeat(head, size), np.repeat(size <= small, size), np.arange(len(sig))
            rest = at[~few & (at != top)]
            found = [(top[rest], rest)] + [(i - d, i) for d in range(1, small) for i in [at[few & (at - top >= d)]]]
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            good = (node[i] != node[j]) & _fit(n[i], probe[i], index[i], n[j], probe[j], index[j], percent)
            a, b = node[i[good]], node[j[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *(pa.nulls(len(a), t) for t in kinds[2:])], names)
            x = np.flatnonzero(np.repeat((size > small) & np.logical_or.reduceat(probe, head) | (cost[head] > cell_rows), size))
            values = (node[x], None, sig[x], cell[x], n[x].astype(np.int32), probe[x], index[x], cost[x], (x == top[x]) & (cost[x] > cell_rows))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), t) if v is None else pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

    return group.mapInArrow(run, "a long, b long, sig long, cell long, n int, probe boolean, index boolean, cost long, head boolean")


def pivoted(group: DataFrame, take: int, percent: int, cell_rows: int) -> DataFrame:
    """(a, b) of rows with about `take` pivots of their signature, where labels differ and the sketches don't refute the pair."""
    chosen = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) * F.col("cost") < take * (1 << 30)
    own = group.select("sig", "cell", "node", "n", "probe", "index", "label", chosen.alias("pivot"), F.lit(False).alias("copy"), *(f"b{k}" for k in range(SKETCH)))
    hot = group.where(chosen & (F.col("cost") > cell_rows)).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("cost") / cell_rows) - 1))).where("to <> cell")
    copies = hot.select("sig", F.col("to").alias("cell"), "node", "n", "probe", "index", "label", F.lit(True).alias("pivot"), F.lit(True).alias("copy"), *(f"b{k}" for k in range(SKETCH)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for (_, _, node, n, probe, index, label, pivot, copied, *bits), head in _by_cell(batches, 20_000):
            bits = np.stack(bits, 1).view(np.uint64)
            for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(node)], strict=True):
                j = lo + np.flatnonzero(~copied[lo:hi])
                ps = lo + np.flatnonzero(pivot[lo:hi])
                step = max(1, (1 << 18) // max(1, len(j)))
                for k in range(0, len(ps), step):
                    i = ps[k : k + step, None]
                    x, y = np.nonzero((label[i] != label[j]) & _fit(n[i], probe[i], index[i], n[j], probe[j], index[j], percent))
                    a, b = i[x, 0], j[y]
                    for z in range(0, len(a), 1 << 16):
                        a_, b_ = a[z : z + (1 << 16)], b[z : z + (1 << 16)]
                        apart = np.bitwise_count(bits[a_] ^ bits[b_]).sum(1, dtype=np.int64)
                        near = (100 + percent) * apart <= (100 - percent) * (n[a_] + n[b_])
                        if near.any():
                            one, two = node[a_[near]], node[b_[near]]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return own.union(copies).repartition("sig", "cell").sortWithinPartitions("sig", "cell").mapInArrow(run, "a long, b long").distinct()


def hub_pairs(heads: DataFrame, percent: int) -> DataFrame:
    """(a, b): the first rows of a hot signature's cells, each with the least of them."""
    hub = heads.groupBy("sig").agg(F.min(F.struct("a", "n", "probe", "index")).alias("hub"))
    both = heads.join(hub, "sig").where("a <> hub.a")
    up = (F.col("n") >= F.col("hub.n")) & F.col("probe") & F.col("hub.index") | (F.col("n") <= F.col("hub.n")) & F.col("hub.probe") & F.col("index")
    return both.where(up & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))).select(F.col("hub.a").alias("a"), F.col("a").alias("b"))


def components(edges: DataFrame, uri: str, name: str) -> DataFrame:
    """(node, label): the smallest node of each node's component, by alternating large and small stars."""
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), uri, f"{name}-0")
    before = None
    for k in range(1, 100):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = settle(small.where("a <> b").distinct(), uri, f"{name}-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def shingle_set(text: str, size: int) -> set[tuple[bytes, ...]]:
    own = text.encode().lower().split()
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} if own else set()


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        keep_only()
        for batch in batches:
            good = []
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                for a, one, two in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if a != last:
                        last, kept = a, shingle_set(zlib.decompress(one).decode(), size)
                    other = shingle_set(zlib.decompress(two).decode(), size)
                    shared = len(kept & other)
                    good.append(100 * shared >= percent * (len(kept) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = texts.select("node", "text").join(ends, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    first = pairs.join(own.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    return first.join(own.select(F.col("node").alias("a"), F.col("text").alias("own")), "a").select("a", "b", "own", "other").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                    part_rows: int = 300_000, broadcast_ids: int = 2_000_000, pivots: int = 16, cell_rows: int = 4096, small: int = 8, bands: Bands | None = None) -> DataFrame:
    """id, n_shingles, component_id (smallest id of the rows connected by links) for each row."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    uri, bands = shared_dir(spark), bands or Bands(percent)
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            data, at = buffers(batch.column(1))
            for lo, hi in steps(at):
                bound, s = step_sets(data, at[lo : hi + 1], size)
                nodes = [node_of(s[a:b]) if b > a else None for a, b in zip(bound[:-1], bound[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bound), pa.int64()), pa.array(nodes, pa.int64())], ["id", "n", "node"])

    rows = settle(own.mapInArrow(name, "id long, n long, node long"), uri, "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(4, int(total * 0.45 / part_rows))

    packed_names = ["part", "sig", "node", "n", "mark", "short"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        seen: set[int] = set()
        kept: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, node, n, mark = (np.concatenate([k[c] for k in kept]) for c in range(4))
            part = (sig % np.uint64(parts)).astype(np.int64)
            low = sig // np.uint64(parts) & _NARROW
            order = np.lexsort((low, part))
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                mine = order[cut[p] : cut[p + 1]]
                sizes = n[mine].astype(np.uint16 if n[mine].max() < 1 << 16 else np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (low[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], node[mine], sizes, mark[mine])), pa.nulls(1, pa.int64())], packed_names)

        for batch in batches:
            data, at = buffers(batch.column(1))
            for lo, hi in steps(at):
                bound, s = step_sets(data, at[lo : hi + 1], size)
                fresh, nodes = [], []
                for k in range(hi - lo):  # copies that the task has met before add nothing
                    if bound[k + 1] > bound[k] and (x := node_of(s[bound[k] : bound[k + 1]])) not in seen:
                        seen.add(x)
                        fresh.append(k)
                        nodes.append(x)
                if not fresh:
                    continue
                s = np.concatenate([s[bound[k] : bound[k + 1]] for k in fresh])
                count = np.diff(bound)[fresh]
                sig, who, mark, short = signatures(np.concatenate([[0], np.cumsum(count)]), s, bands)
                if short.any():
                    lone = pa.array([nodes[k] for k in np.flatnonzero(short).tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lone), -1, np.int32)), *(pa.nulls(len(lone), pa.binary()) for _ in range(4)), lone], packed_names)
                kept.append((sig, np.array(nodes, np.int64)[who], count[who], mark))
                held += len(sig)
                if held >= 400_000:
                    yield from flush()
                    kept, held = [], 0
        if kept:
            yield from flush()

    met_names, met_kinds = ["sig", "node", "n", "mark", "cost"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        keep_only()

        def groups() -> Iterator[pa.RecordBatch]:
            sig, node, n, mark = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((mark, node, sig))
            sig, node, n, mark = sig[order], node[order], n[order], mark[order]
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]) | (mark[1:] != mark[:-1])])
            sig, node, n, mark = sig[new], node[new], n[new], mark[new]
            asks, asked, cost = partnered(sig, n, mark, percent)
            keep = np.flatnonzero(asks | asked)
            for k in range(0, len(keep), 100_000):
                x = keep[k : k + 100_000]
                kind = np.where(asks[x], mark[x] & 3, INDEX)
                told = kind | asked[x].astype(np.int64) << 2 | (mark[x].astype(np.int64) >> 2 & 15) << 3 | np.where(kind == EXACT, mark[x] >> 6, 0).astype(np.int64) << 7
                values = (sig[x].view(np.int64), node[x], n[x].astype(np.int32), told.astype(np.int32), cost[x])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, met_kinds, strict=True)], met_names)

        for batch in batches:
            for part, sig, node, n, mark, short in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if short is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([short if c == "node" else None], t) for c, t in zip(met_names, met_kinds, strict=True)], met_names)
                    continue
                if part != at and held:
                    yield from groups()
                    held = []
                at = part
                low = np.zeros((len(mark) // 2, 8), np.uint8)
                low[:, :5] = np.frombuffer(sig, np.uint8).reshape(-1, 5)
                held.append((low.view("<u8")[:, 0] * np.uint64(parts) + np.uint64(part), np.frombuffer(node, np.int64), np.frombuffer(n, np.uint16 if len(n) == len(mark) else np.uint32).astype(np.uint32), np.frombuffer(mark, np.uint16)))
        if held:
            yield from groups()

    packed = own.mapInArrow(sign, "part int, sig binary, node binary, n binary, mark binary, short long")
    met = settle(packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "sig long, node long, n int, mark int, cost long"), uri, "met")
    names = settle(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first")), uri, "names")
    short = met.where("sig is null").select("node").distinct()
    extra = None if met.where("sig is null").isEmpty() else settle(_least_elements(own, short, size, percent), uri, "short")

    group = settle(allocated(met.where("sig is not null")), uri, "allocated")
    discard(spark, f"{uri}/met")
    cell = F.when(F.col("cost") > cell_rows, F.pmod(F.xxhash64("node"), F.ceil(F.col("cost") / cell_rows))).otherwise(F.lit(0).cast("long"))
    placed = group.withColumn("cell", cell).select("sig", "cell", "node", "n", "probe", "index", "cost").repartition("sig", "cell").sortWithinPartitions("sig", "cell", "node")
    found = settle(cells(placed, percent, cell_rows, small), uri, "cells")
    discard(spark, f"{uri}/allocated")
    heads = found.where("head").select("sig", "a", "n", "probe", "index")
    pairs = found.where("b is not null").select("a", "b").union(hub_pairs(heads, percent))
    pairs = settle((pairs if extra is None else pairs.union(extra)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), uri, "met-pairs")
    group = found.where("b is null").withColumnRenamed("a", "node").drop("b", "head")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(group.select("node")).distinct()
    texts = settle(_texts(own, needed.join(names, "node").select("node", "first"), size, broadcast_ids, uri), uri, "texts")
    words_ = [f"b{k}" for k in range(SKETCH)]
    bits = settle(texts.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")).select("node", "n", *[F.col("bits")[k].alias(w) for k, w in enumerate(words_)]), uri, "bits")
    of_a = bits.select(F.col("node").alias("a"), F.col("n").alias("na"), *(F.col(w).alias(f"p{w}") for w in words_))
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"p{w}"))) for w in words_), F.lit(0))
    close = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("na"))
    pairs = settle(pairs.join(of_a, "a").join(bits.withColumnRenamed("node", "b"), "b").where(close).select("a", "b"), uri, "pairs-0")
    discard(spark, f"{uri}/met-pairs")
    tried, take, labels, turn = pairs, 1, None, 0
    while True:
        new = None if pairs.isEmpty() else settle(_verify(pairs, texts, size, percent), uri, f"edges-{turn}")
        if new is not None and not new.isEmpty() or labels is None:
            linked = [e for e in (None if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")), new) if e is not None]
            labels = settle(components(reduce(DataFrame.union, linked) if linked else spark.createDataFrame([], "a long, b long"), uri, f"star-{turn}"), uri, f"labels-{turn}")
        left = group.where(F.col("cost") > take).drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = left.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("probe").alias("any")).where("lo <> hi and any").select("sig")
        still = left.join(open_, "sig", "left_semi")
        before, group = f"{uri}/group-{turn - 1}" if turn else f"{uri}/cells", settle(still if turn else still.join(bits.drop("n"), "node"), uri, f"group-{turn}")
        discard(spark, before)
        if group.isEmpty():
            break
        take, turn = take * pivots, turn + 1
        pairs = settle(pivoted(group, take, percent, cell_rows).join(tried, ["a", "b"], "left_anti"), uri, f"pairs-{turn}")
        tried = tried.union(pairs)
    named = labels.join(names, "node").groupBy("label").agg(F.min("first").alias("component"))
    linked = settle(labels.join(named, "label").select("node", "component"), uri, "components")
    alone = names.join(linked, "node", "left").select("node", F.coalesce("component", "first").alias("component"))
    of = settle(alone, uri, "nodes")
    out = settle(rows.join(of, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")), shared_dir(spark), "joined")
    discard(spark, uri)
    return out


def _texts(own: DataFrame, needed: DataFrame, size: int, broadcast_ids: int, uri: str) -> DataFrame:
    """node, size, compressed text and sketch of the rows with the smallest id of each needed node; ids travel as a broadcast up to a bound, else by a join."""
    needed = settle(needed, uri, "needed")
    spark = own.sparkSession
    if needed.count() <= broadcast_ids:
        ids = spark.sparkContext.broadcast(np.sort(np.array([r["first"] for r in needed.where("first is not null").select("first").toLocalIterator()], np.int64)))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i = batch.column(0).to_numpy(zero_copy_only=False)
                keep = np.isin(i, ids.value) if batch.column(0).null_count == 0 else np.array([x is None or x in ids.value for x in batch.column(0).to_pylist()])
                yield batch.filter(pa.array(keep))

        some = own.mapInArrow(pick, "id long, text string")
    else:
        some = own.join(needed.select("first").distinct(), F.col("id").eqNullSafe(F.col("first")), "left_semi")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            data, at = buffers(batch.column(1))
            for lo, hi in steps(at):
                bound, s = step_sets(data, at[lo : hi + 1], size)
                nodes = [node_of(s[a:b]) if b > a else None for a, b in zip(bound[:-1], bound[1:], strict=True)]
                bits = pa.FixedSizeListArray.from_arrays(pa.array(sketches(bound, s).view(np.int64).ravel()), SKETCH).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.diff(bound), pa.int64()), pa.array([zlib.compress(t.encode(), 1) for t in batch.column(1).slice(lo, hi - lo).to_pylist()], pa.binary()), bits], ["node", "n", "text", "bits"])

    return some.mapInArrow(name, "node long, n long, text binary, bits array<long>").where("node is not null")


def _least_elements(own: DataFrame, short: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the sets that no allocation covers, with every set of fitting size that shares one of the least elements of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            data, at = buffers(batch.column(1))
            for lo, hi in steps(at):
                bound, s = step_sets(data, at[lo : hi + 1], size)
                n = np.diff(bound)
                few = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
                row = np.repeat(np.arange(hi - lo), few)
                place = np.arange(len(row)) - np.repeat(np.cumsum(few) - few, few) + bound[:-1][row]
                nodes = np.array([node_of(s[a:b]) if b > a else 0 for a, b in zip(bound[:-1], bound[1:], strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[row]), pa.array(n[row]), pa.array(s[place].view(np.int64))], ["node", "n", "element"])

    least = own.mapInArrow(run, "node long, n long, element long").distinct()
    mine = least.join(short, "node", "left_semi").select(F.col("node").alias("a"), F.col("n").alias("na"), "element")
    fits = (F.col("a") != F.col("node")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na"))
    return least.join(mine, "element").where(fits).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
