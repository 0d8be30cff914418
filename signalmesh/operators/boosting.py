"""Depth-three boosted trees of squared loss, fitted in one job whose tasks add up their histograms.

Every task keeps its rows as bin numbers (256 quantile bins a feature) and residuals; what does not fit its memory lies in files
of its own temp folder. The tasks of the barrier stage form a binary tree: for each level of each tree the histograms are summed towards task 0, which
picks the splits and sends them back. Gradients are whole numbers of 22 bits, so that every sum is exact and the fitted
trees depend neither on how rows are dealt out nor on their order.
"""

from __future__ import annotations

import math
import os
import pickle
import secrets
import socket
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, DEPTH = 256, 3
#: The booster's settings (fixed values).
ETA, L2, ROW_SHARE, COLUMN_SHARE = 0.03, 5.0, 0.7, 0.8
#: Rows of a task at least, rows handled at once, and bytes that a task holds in memory.
TASK_ROWS, BLOCK, HELD = 1 << 16, 1 << 15, 192 << 20
#: A row's weight is UNIT + its gradient, so one sum over a block holds its count and its gradients; both stay exact below 2^53.
LIMIT, UNIT = float(2**21 - 1), float(2**37)
#: Values are told apart by sign, exponent and ten binary digits.
_SHIFT = np.uint64(42)
_TOP = np.uint64(1 << 63)
#: Seconds without a word from another task after which a task gives up.
SILENCE = 3600


@dataclass
class Trees:
    """Full trees of depth three, nodes in heap order: right where not x <= threshold. The mean is part of the first tree's leaves."""

    feature: np.ndarray  # trees x 7
    threshold: np.ndarray  # trees x 7
    leaf: np.ndarray  # trees x 8

    def __len__(self) -> int:
        return len(self.leaf)

    def prefix_sums(self, x: np.ndarray, counts) -> dict[int, np.ndarray]:
        """Sums of the first n trees for each n of counts; x holds a feature in each row."""
        total, out = np.zeros(x.shape[1]), {}
        for k in range(max(counts)):
            f, t = self.feature[k], self.threshold[k]
            total = total + self.leaf[k].take(_leaves([~(x[f[j]] <= t[j]) for j in range(7)]))
            if k + 1 in counts:
                out[k + 1] = total
        return out

    def mllib(self, n_features: int):
        """The same trees as MLlib's model, for scoring; its nodes carry no statistics."""
        from pyspark import SparkContext
        from pyspark.ml.regression import GBTRegressionModel

        sc = SparkContext.getOrCreate()
        tree = sc._jvm.org.apache.spark.ml.tree
        regression = sc._jvm.org.apache.spark.ml.regression

        def node(k: int, at: int):
            if at >= 7:
                return tree.LeafNode(float(self.leaf[k, at - 7]), 0.0, None)
            split = tree.ContinuousSplit(int(self.feature[k, at]), float(self.threshold[k, at]))
            return tree.InternalNode(0.0, 0.0, 0.0, node(k, 2 * at + 1), node(k, 2 * at + 2), split, None)

        made = sc._gateway.new_array(regression.DecisionTreeRegressionModel, len(self))
        weights = sc._gateway.new_array(sc._jvm.double, len(self))
        for k in range(len(self)):
            made[k], weights[k] = regression.DecisionTreeRegressionModel(f"tree_{k}", node(k, 0), n_features), 1.0
        model = GBTRegressionModel(regression.GBTRegressionModel(f"trees_{secrets.token_hex(6)}", made, weights))
        return model.setFeaturesCol("_x")

    def transform(self, df: DataFrame) -> DataFrame:
        """MLlib's own scoring of the vectors in `_x`."""
        return self.mllib(int(self.feature.max(initial=0)) + 1).transform(df)


def _leaves(right: list[np.ndarray]) -> np.ndarray:
    """Leaf numbers from the answers of the seven inner nodes."""
    a = right[0]
    b = np.where(a, right[2], right[1])
    c = np.where(a, np.where(b, right[6], right[5]), np.where(b, right[4], right[3]))
    return (a.view(np.uint8) << 2) | (b.view(np.uint8) << 1) | c.view(np.uint8)


def _keys(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of the values; NaN is the last."""
    bits = (x + 0.0).view(np.uint64)
    key = (np.where(bits & _TOP, ~bits, bits | _TOP) >> _SHIFT).astype(np.uint32)
    key[np.isnan(x)] = np.iinfo(np.uint32).max
    return key


def _highest(key: int) -> float:
    """The largest value of a key."""
    u = np.array([((int(key) + 1) << int(_SHIFT)) - 1], np.uint64)
    top = float(np.where(u & _TOP, u ^ _TOP, ~u).view(float)[0])
    return math.inf if math.isnan(top) else top  # the key of infinity also has patterns of NaN


def _bounds(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The last key of each of at most BINS bins of about equal counts; few values have a bin each."""
    if len(keys) <= BINS:
        return keys
    before = counts.cumsum() - counts
    place = before * BINS // counts.sum()
    return keys[np.append(np.flatnonzero(np.diff(place)), len(keys) - 1)]


class _Alone:
    """The only task of a fit."""

    rank = 0

    def total(self, x, merge):
        return x

    def share(self, x):
        return x

    def close(self) -> None:
        pass


class _Peers(_Alone):
    """The tasks of a barrier stage as a binary tree of connections."""

    def __init__(self, context) -> None:
        self.rank, hosts = context.partitionId(), [t.address.rsplit(":", 1)[0] for t in context.getTaskInfos()]
        with socket.create_server((hosts[self.rank], 0), backlog=8) as server:
            server.settimeout(SILENCE)
            told = [m.split() for m in context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}")]
            word = told[0][1].encode()
            self.parent, self.children = None, []
            if self.rank:
                up = (self.rank - 1) // 2
                self.parent = self._tuned(socket.create_connection((hosts[up], int(told[up][0])), SILENCE))
                self.parent.sendall(word + struct.pack("<q", self.rank))
            waiting = {k for k in (2 * self.rank + 1, 2 * self.rank + 2) if k < len(hosts)}
            while waiting:
                link = self._tuned(server.accept()[0])
                hello = self._read(link, len(word) + 8)
                k = struct.unpack("<q", hello[-8:])[0]
                if secrets.compare_digest(hello[:-8], word) and k in waiting:
                    waiting.discard(k)
                    self.children.append((k, link))
                else:
                    link.close()
            self.children = [link for _, link in sorted(self.children, key=lambda c: c[0])]

    @staticmethod
    def _tuned(link: socket.socket) -> socket.socket:
        link.settimeout(SILENCE)
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        link.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
        return link

    @staticmethod
    def _read(link: socket.socket, n: int) -> bytearray:
        out = bytearray(n)
        view = memoryview(out)
        while n:
            got = link.recv_into(view[-n:])
            if not got:
                raise ConnectionError("another task of the fit has ended")
            n -= got
        return out

    def _get(self, link: socket.socket):
        return pickle.loads(self._read(link, struct.unpack("<q", self._read(link, 8))[0]))

    @staticmethod
    def _put(link: socket.socket, x) -> None:
        data = pickle.dumps(x, pickle.HIGHEST_PROTOCOL)
        link.sendall(struct.pack("<q", len(data)) + data)

    def total(self, x, merge):
        """All tasks' values merged, at task 0 only."""
        for link in self.children:
            x = merge(x, self._get(link))
        if self.parent is not None:
            self._put(self.parent, x)
        return x

    def share(self, x):
        """Task 0's value, at every task."""
        if self.parent is not None:
            x = self._get(self.parent)
        for link in self.children:
            self._put(link, x)
        return x

    def close(self) -> None:
        for link in (self.parent, *self.children):
            if link is not None:
                link.close()


class _Blocks:
    """Blocks of equally named arrays, in memory up to HELD bytes, else in a file each."""

    def __init__(self) -> None:
        self.kept: list[dict | str] = []
        self.folder, self.held = None, 0

    def add(self, **arrays: np.ndarray) -> None:
        size = sum(a.nbytes for a in arrays.values())
        if self.held + size <= HELD:
            self.held += size
            self.kept.append(arrays)
            return
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="boosting-")
        self.kept.append(os.path.join(self.folder.name, str(len(self.kept))))
        self.put(len(self.kept) - 1, arrays)

    def get(self, k: int) -> dict:
        if isinstance(self.kept[k], dict):
            return self.kept[k]
        with open(self.kept[k], "rb") as file:
            return pickle.load(file)

    def put(self, k: int, arrays: dict) -> None:
        if isinstance(self.kept[k], dict):
            self.kept[k] = arrays
            return
        with open(self.kept[k], "wb") as file:
            pickle.dump(arrays, file, pickle.HIGHEST_PROTOCOL)

    def __len__(self) -> int:
        return len(self.kept)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def _read_rows(batches: Iterator[pa.RecordBatch], p: int) -> _Blocks:
    """Keys of the features, the target and the row's hash."""
    out, parts, have = _Blocks(), [], 0

    def column(batch: pa.RecordBatch, k: int) -> np.ndarray:
        return batch.column(k).to_numpy(zero_copy_only=False)

    def flush() -> None:
        x, y, h = (np.concatenate(a, -1) for a in zip(*parts, strict=True))
        for k in range(0, len(y), BLOCK):
            at = slice(k, k + BLOCK)
            out.add(x=x[:, at].copy(), y=y[at].copy(), h=h[at].copy())

    for batch in batches:
        x = np.stack([_keys(column(batch, k)) for k in range(p)]) if batch.num_rows else np.zeros((p, 0), np.uint32)
        parts.append((x, column(batch, p).astype(float), column(batch, p + 1).astype(np.int64).astype(np.uint32)))
        have += batch.num_rows
        if have >= BLOCK:
            flush()
            parts, have = [], 0
    if have:
        flush()
    return out


def _counted(a: list, b: list) -> list:
    """Counts by key of two parts, added up."""
    out = []
    for (ka, ca), (kb, cb) in zip(a, b, strict=True):
        keys = np.union1d(ka, kb)
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, ka)] += ca
        counts[np.searchsorted(keys, kb)] += cb
        out.append((keys, counts))
    return out


def _binned(blocks: _Blocks, peers, p: int, n: int) -> tuple[list[np.ndarray], float, float]:
    """Keys become bin numbers and targets residuals of their mean: (last keys of the bins, mean, bound of the residuals)."""
    cells, top = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * p, 0.0
    for k in range(len(blocks)):
        b = blocks.get(k)
        cells = _counted(cells, [np.unique(row, return_counts=True) for row in b["x"]])
        top = max(top, float(np.abs(b["y"]).max()))
    cells, top = peers.total((cells, top), lambda a, b: (_counted(a[0], b[0]), max(a[1], b[1])))
    bounds, top = peers.share(([_bounds(*c) for c in cells], top) if peers.rank == 0 else None)
    scale = 2.0 ** (52 - max(n, 1).bit_length()) / (top or 1.0)  # the sum of all rows is exact
    total = peers.total(sum(float(np.rint(blocks.get(k)["y"] * scale).sum()) for k in range(len(blocks))), lambda a, b: a + b)
    mean = peers.share(total / scale / max(n, 1))
    for k in range(len(blocks)):
        b = blocks.get(k)
        bins = np.stack([np.searchsorted(c, row) for c, row in zip(bounds, b["x"], strict=True)]).astype(np.uint8)
        blocks.put(k, {"x": bins, "r": b["y"] - mean, "h": b["h"]})
    return bounds, mean, top + abs(mean)


def _answers(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, nodes: range) -> list[np.ndarray]:
    return [x[feature[j]] > cut[j] for j in nodes]


def _histogram(b: dict, w: np.ndarray, chosen: np.ndarray, depth: int, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(2, nodes, features, BINS): counts and gradients of the level's nodes."""
    x, nodes = b["x"], 1 << depth
    base = None
    if depth:
        right = _answers(x, feature, cut, range(nodes - 1))
        node = right[0].astype(np.int64)
        if depth == 2:
            node = 2 * node + np.where(right[0], right[2], right[1])
        base = node * BINS
    packed = np.stack([np.bincount(x[f] if base is None else base + x[f], w, nodes * BINS) for f in chosen])
    counts = np.rint(packed / UNIT)
    return np.stack([counts, packed - counts * UNIT]).reshape(2, len(chosen), nodes, BINS).swapaxes(1, 2)


def _splits(total: np.ndarray, chosen: np.ndarray, scale: float, min_rows: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, leaf values of both sides) of each node; cut BINS leaves a node whole."""
    h, g = total[0], total[1] / scale
    h_all, g_all = h[:, :1].sum(2, keepdims=True), g[:, :1].sum(2, keepdims=True)
    left_h, left_g = h.cumsum(2)[:, :, :-1], g.cumsum(2)[:, :, :-1]
    right_h, right_g = h_all - left_h, g_all - left_g
    gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - g_all**2 / (h_all + L2)
    gain[(left_h < min_rows) | (right_h < min_rows) | (left_h == 0) | (right_h == 0)] = -np.inf
    n = len(gain)
    best = gain.reshape(n, -1).argmax(1)
    j, cut = np.divmod(best, BINS - 1)
    at = np.arange(n)
    good = gain[at, j, cut] > 0
    whole = (ETA * g_all / (h_all + L2)).reshape(n)
    sides = ETA * np.stack([left_g[at, j, cut] / (left_h[at, j, cut] + L2), right_g[at, j, cut] / (right_h[at, j, cut] + L2)], 1)
    return np.where(good, chosen[j], 0), np.where(good, cut, BINS), np.where(good[:, None], sides, whole[:, None])


def _grow(blocks: _Blocks, peers, bounds: list[np.ndarray], mean: float, bound: float, n_trees: int, min_rows: float, seed: int) -> Iterator[tuple]:
    """(features, thresholds, leaves) of one tree after another; the residuals of the blocks follow."""
    p = len(bounds)
    share = np.uint32(int(ROW_SHARE * 2**32))
    width = max(1, int(COLUMN_SHARE * p))
    for k in range(n_trees):
        rng = np.random.default_rng([seed, k])
        factor, shift = (rng.integers(0, 2**32, 2, np.uint32) | np.array([1, 0], np.uint32)).astype(np.uint32)
        chosen = np.sort(rng.permutation(p)[:width])
        scale = LIMIT / bound if bound > 0 else 1.0
        feature, cut = np.zeros(7, int), np.full(7, BINS)
        weights: dict[int, np.ndarray] = {}
        for depth in range(DEPTH):
            total = np.zeros((2, 1 << depth, width, BINS))
            for i in range(len(blocks)):
                b = blocks.get(i)
                w = weights.get(i)
                if w is None:
                    w = (np.rint(b["r"] * scale) + UNIT) * (b["h"] * factor + shift < share)
                    if isinstance(blocks.kept[i], dict):
                        weights[i] = w
                total += _histogram(b, w, chosen, depth, feature, cut)
            total = peers.total(total, np.add)
            f, c, sides = peers.share(_splits(total, chosen, scale, min_rows) if peers.rank == 0 else None)
            at = slice((1 << depth) - 1, (2 << depth) - 1)
            feature[at], cut[at] = f, c
        leaf = sides.reshape(8)
        for i in range(len(blocks)):
            b = blocks.get(i)
            b["r"] = b["r"] - leaf.take(_leaves(_answers(b["x"], feature, cut, range(7))))
            blocks.put(i, b)
        bound += float(np.abs(leaf).max())
        threshold = np.array([math.inf if c == BINS else _highest(bounds[f][c]) for f, c in zip(feature, cut, strict=True)])
        yield feature, threshold, leaf + (mean if k == 0 else 0.0)


def _slots(spark) -> int:
    """Tasks that can run at once, as the barrier stage counts them."""
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def _fit_task(p: int, n: int, tasks: int, n_trees: int, min_rows: float, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        blocks = _read_rows(batches, p)
        peers = _Alone() if tasks == 1 else _Peers(BarrierTaskContext.get())
        try:
            bounds, mean, bound = _binned(blocks, peers, p, n)
            for k, (f, t, leaf) in enumerate(_grow(blocks, peers, bounds, mean, bound, n_trees, min_rows, seed)):
                if peers.rank == 0:
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "f": pa.array([f.tolist()], pa.list_(pa.int32())), "t": pa.array([t.tolist()], pa.list_(pa.float64())), "leaf": pa.array([leaf.tolist()], pa.list_(pa.float64()))})
        finally:
            peers.close()
            blocks.close()

    return run


def fit_trees(rows: DataFrame, features: list[str], n_trees: int, min_rows: float = 1000, seed: int = 0, tasks: int | None = None) -> Trees:
    """Trees on the rows' features and target, row and column shares drawn anew for each; (date, identifier) draws the rows.

    One task for each TASK_ROWS rows, at most as many as can run at once. More than one is a barrier stage, which Spark does
    not allow with dynamic allocation.
    """
    n = rows.count()
    if not n:
        return Trees(np.zeros((n_trees, 7), int), np.full((n_trees, 7), np.inf), np.zeros((n_trees, 8)))
    if tasks is None:
        tasks = max(1, min(-(-n // TASK_ROWS), _slots(rows.sparkSession)))
    cols = [F.col(c).cast("double").alias(c) for c in (*features, "target")]
    dealt = rows.select(*cols, F.xxhash64("date", "identifier").alias("_h")).repartition(tasks)
    run = _fit_task(len(features), n, tasks, n_trees, min_rows, seed)
    out = sorted(dealt.mapInArrow(run, "k int, f array<int>, t array<double>, leaf array<double>", barrier=tasks > 1).collect(), key=lambda r: r["k"])
    return Trees(np.array([r["f"] for r in out], int).reshape(-1, 7), np.array([r["t"] for r in out], float).reshape(-1, 7), np.array([r["leaf"] for r in out], float).reshape(-1, 8))
