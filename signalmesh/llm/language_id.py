"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over fixed-length windows, and a softmax
layer names the language. A text is cut into windows of `window` bytes that overlap by the widest filter less one,
so that all of it is read; the text's scores are the length-weighted mean of its windows' log probabilities, renormalised.

Training uses of each language the `sample_per_lang` labelled rows with the smallest hashes of id and text, fewer where there are so many languages that
this would exceed `sample_rows` rows in all (one row of each at least): a documented bound on the labelled rows of the fitted sample. All windows of
those rows' whole texts are learned from, and every language that has a row can be predicted. Prediction reads every byte of every text.
The sample is drawn by a hash threshold for each language that follows from its count of distinct rows, so that only a little more than the sample is ever ranked; rows that repeat id and text are learned from once.

Defined cases: a null text or one without a letter is `und` with score 0; null labels are not learned from; with no
labelled row at all every text is `und`; ties go to the first language in sorted order; a very long text is read whole in windows; repeated rows are
predicted alike, row by row; a kept column called lang_pred or score comes back as keep_<name>, any other under its own name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import buffers, slices, small_batches, steps

WIDTHS = (2, 3, 4)


@dataclass
class ByteConvNet:
    langs: list[str]
    embed: np.ndarray  # (256, d)
    filters: list[np.ndarray]  # (width * d, f) for each width
    bias: np.ndarray  # (sum of f)
    out: np.ndarray  # (sum of f, langs)
    out_bias: np.ndarray
    window: int

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(n, window, 4 d): each position's embedding and its next ones; beyond the window zeros."""
        e = self.embed[x]
        n, w, d = e.shape
        out = np.zeros((n, w, max(WIDTHS) * d), np.float32)
        for k in range(max(WIDTHS)):
            out[:, : w - k, k * d : (k + 1) * d] = e[:, k:]
        return out

    def kernel(self) -> np.ndarray:
        """All filters as one matrix, narrow ones padded with zeros."""
        rows = max(WIDTHS) * self.embed.shape[1]
        return np.concatenate([np.pad(f, ((0, rows - len(f)), (0, 0))) for f in self.filters], 1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        a = self.columns(x).reshape(-1, max(WIDTHS) * self.embed.shape[1]) @ self.kernel()
        pooled = np.maximum(a.reshape(len(x), x.shape[1], -1).max(1) + self.bias, 0)
        z = pooled @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows_of(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row, length) of the overlapping windows of each row; short ends are padded with byte 0."""
    step = window - max(WIDTHS) + 1
    size = np.diff(at)
    count = np.where(size > 0, np.maximum(1, -(-(size - max(WIDTHS) + 1) // step)), 0)
    row = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = at[:-1][row] + k * step
    length = np.minimum(window, at[1:][row] - first)
    index = first[:, None] + np.arange(window)
    inside = np.arange(window) < length[:, None]
    x = np.where(inside, data[np.minimum(index, len(data) - 1)], 0) if len(row) else np.zeros((0, window), np.uint8)
    return x.astype(np.uint8), row, length


def fit(texts: list[bytes], langs: list[str], window: int = 256, dim: int = 8, each: int = 8, epochs: int = 6,
        seed: int = 7) -> ByteConvNet:
    """Train by Adam on cross entropy over the windows of labelled texts; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, row, _ = windows_of(data, at, window)
    place = {v: k for k, v in enumerate(names)}
    y = np.array([place[v] for v in langs])[row] if len(row) else np.zeros(0, int)
    order = rng.permutation(len(x))
    x, y = x[order], y[order]
    shape = [(256, dim), *((w * dim, each) for w in WIDTHS), (each * len(WIDTHS), len(names))]
    p = [rng.normal(0, s, z).astype(np.float32) for s, z in zip([1.0, *(1 / np.sqrt(w * dim) for w in WIDTHS), 0.3], shape, strict=True)]
    p += [np.zeros(each * len(WIDTHS), np.float32), np.zeros(len(names), np.float32)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for lo in range(0, len(x), 64):
            xb, yb, t = x[order2 := slice(lo, lo + 64)], y[order2], t + 1
            net = ByteConvNet(names, p[0], p[1:4], p[5], p[4], p[6], window)
            col, kernel = net.columns(xb), net.kernel()
            a = col @ kernel
            top = a.argmax(1)
            pre = np.take_along_axis(a, top[:, None], 1)[:, 0] + p[5]
            h = np.maximum(pre, 0)
            z = h @ p[4] + p[6]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(yb)), yb] -= 1
            q /= len(yb)
            dh = (q @ p[4].T) * (pre > 0)
            best = np.take_along_axis(col, top.reshape(len(xb), -1, 1), 1)  # the window column that each filter kept
            dk = np.einsum("nf,nfc->cf", dh, best)
            dcol = dh[:, :, None] * kernel.T[None]
            de = np.zeros_like(p[0])
            for j in range(max(WIDTHS)):
                place = np.minimum(top + j, window - 1)
                np.add.at(de, xb[np.arange(len(xb))[:, None], place], dcol[:, :, j * dim : (j + 1) * dim] * (top + j < window)[:, :, None])
            grads = [de, *(dk[: w * dim, k * each : (k + 1) * each] for k, w in enumerate(WIDTHS)), h.T @ q, dh.sum(0), q.sum(0)]
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        order3 = rng.permutation(len(x))
        x, y = x[order3], y[order3]
    return ByteConvNet(names, p[0], p[1:4], p[5], p[4], p[6], window)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_per_lang: int, sample_rows: int) -> list:
    """The bounded labelled sample: of each language, the rows whose id and text have the smallest hashes, equal rows once."""
    text = F.col(text_col).cast("string")
    labelled = docs.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(text.cast("binary").alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"))
    counts = labelled.groupBy("l").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect()  # a row for each language
    if not counts:
        return []
    each = max(1, min(sample_per_lang, sample_rows // len(counts)))
    most = each + 6 * int(each**0.5) + 12  # so many are expected below the threshold, `each` practically always
    limits = [(r["l"], max(r["least"], min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, most / max(1, r["n"])))))) for r in counts]
    near = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(limits, "l string, most long")), "l").where("h <= most").groupBy("l", "h").agg(F.min("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    return near.withColumn("r", rank).where(F.col("r") <= each).select("t", "l", "h").orderBy("l", "h", "t").collect()


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample_per_lang: int = 400, sample_rows: int = 100_000, keep: list[str] | None = None, **fitting) -> DataFrame:
    """The rows of `docs` (id, text and the columns named in `keep`) with lang_pred and score, learned from `train`."""
    small_batches(docs.sparkSession)
    rows = training_rows(train, id_col, text_col, lang_col, sample_per_lang, sample_rows)
    net = docs.sparkSession.sparkContext.broadcast(fit([bytes(r["t"]) for r in rows], [r["l"] for r in rows], **fitting) if rows else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = buffers(batch.column(0))
            pred, score = [], []
            for lo, hi in steps(at, 1 << 18):
                if net.value is None or at[hi] == at[lo]:
                    pred += ["und"] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                total, weight = np.zeros((hi - lo, len(net.value.langs))), np.zeros(hi - lo)
                x, row, length = windows_of(data, at[lo : hi + 1], net.value.window)
                for k in range(0, len(x), 512):
                    part = slice(k, k + 512)
                    np.add.at(total, row[part], net.value.log_probabilities(x[part]) * length[part, None])
                np.add.at(weight, row, length)
                z = total / np.maximum(weight, 1)[:, None]
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                pred += [net.value.langs[i] for i in q.argmax(1)]
                score += q.max(1).tolist()
            blank = np.array([v is not True for v in batch.column(1).to_pylist()], bool)
            pred = ["und" if b else v for v, b in zip(pred, blank, strict=True)]
            score = [0.0 if b else float(v) for v, b in zip(score, blank, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 2) for k in range(len(kept))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names)

    kept = list(dict.fromkeys([id_col, *(keep or [])]))
    names = [*(f"keep_{k}" for k in range(len(kept))), "lang_pred", "score"]
    text = F.col(text_col).cast("string")
    source = docs.select(text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"), *(F.col(c).alias(n) for c, n in zip(kept, names, strict=False)))
    schema = StructType(source.schema.fields[2:]).add("lang_pred", "string").add("score", "double")
    told = source.mapInArrow(run, schema)
    return told.select(*(F.col(n).alias(f"keep_{c}" if c in ("lang_pred", "score") else c) for c, n in zip(kept, names, strict=False)), "lang_pred", "score")
