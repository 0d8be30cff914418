"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against every token window.

Words are A-Z-folded runs of digits, ASCII letters and bytes above 0x7F. Every 13 consecutive words of a
benchmark item are a window; a shorter item is one window of its own length. All windows of a document are hashed
in vectorised steps, looked up in the sorted hash set, and each hit is verified word by word.

The benchmark is read in blocks of at most `block_bytes` bytes as they are held: its words once, and 24 bytes for each word at most (hash, item and place of the
window that begins there, bounds of the word). That is the bound of what is broadcast and of what each worker holds; a larger
benchmark takes further passes over the documents, whose spans and items add up. A single item larger than that is a block of its own.

Defined cases: null or empty texts have no words and no hits; items without words have no windows; items that
repeat an id count once; repeated documents are judged row by row; windows that several items hold name all of them; a very long text is scanned
whole, in a vectorised step of its own; a kept column whose name is taken comes back as keep_<name>.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, buffers, rolled, settle, shared_dir, steps, text_or_empty, words

#: Columns of a scan; a kept column of such a name stays under keep_<name>.
NAMES = ("id", "text", "n_words", "hits", "spans", "items", "n_hit", "n_items", "contaminated")
_FOLD = bytes(32 if NOT_ALNUM[b] else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class WindowSet:
    """Windows by length: sorted hashes and, beside each, the item and the word where it begins. Words are kept once, folded, joined by blanks."""

    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    names: list[str]
    text: bytes
    start: np.ndarray  # of each word in `text`
    end: np.ndarray
    first: np.ndarray  # number of each item's first word

    def items_at(self, n: int, h: int, own: bytes) -> set[str]:
        """The items that hold a window of n words, by its hash and words."""
        hashes, item, word = self.windows[n]
        lo, hi = np.searchsorted(hashes, np.array([h, h], np.uint64), "left")[0], np.searchsorted(hashes, np.uint64(h), "right")
        out = set()
        for i, w in zip(item[lo:hi].tolist(), word[lo:hi].tolist(), strict=True):
            k = int(self.first[i]) + w
            if self.names[i] not in out and self.text[self.start[k] : self.end[k + n - 1]] == own:
                out.add(self.names[i])
        return out


def window_set(items: list[tuple[object, str | None]], size: int) -> WindowSet:
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    texts = [b" ".join(item_words(t)) for _, t in items]
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at[-1] = len(joined)
    start, end, row, h = words(joined, at, NOT_ALNUM)
    first = np.searchsorted(row, np.arange(len(items) + 1))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            n = min(size, b - a)
            x = rolled(h[a:b], n)
            found.setdefault(n, []).append((x, np.full(len(x), i, np.int32), np.arange(len(x), dtype=np.int32)))
    windows = {}
    for n, parts in found.items():
        hashes, item, word = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        windows[n] = hashes[order], item[order], word[order]
    return WindowSet(windows, ["null" if i is None else str(i) for i, _ in items], joined.tobytes(), start.astype(np.int32), end.astype(np.int32), first[:-1].astype(np.int32))


def _scan(data: np.ndarray, at: np.ndarray, model: WindowSet):
    """Word starts, ends and row bounds of a step, covered words, and the items of each row with hits."""
    start, end, row, h = words(data, at, NOT_ALNUM)
    covered = np.zeros(len(start) + 1, np.int64)
    items: dict[int, set[str]] = {}
    told: dict[tuple[int, bytes], set[str]] = {}
    for n, (known, _, _) in model.windows.items():
        seen = rolled(h, n)
        if not len(seen):
            continue
        place = np.minimum(np.searchsorted(known, seen), len(known) - 1)
        hit = (known[place] == seen) & (row[: len(seen)] == row[n - 1 :])
        for i in np.flatnonzero(hit).tolist():
            own = b" ".join(data[at[0] + start[j] : at[0] + end[j]].tobytes().translate(_FOLD) for j in range(i, i + n))
            if (n, own) not in told:
                told[n, own] = model.items_at(n, int(seen[i]), own)
            if told[n, own]:
                covered[i] += 1
                covered[i + n] -= 1
                items.setdefault(int(row[i]), set()).update(told[n, own])
    return start, end, row, np.cumsum(covered[:-1]) > 0, items


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         size: int = 13, block_bytes: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """id, text, n_words, hits (word indexes), spans (byte start and end of each hit run), items and `keep` for each row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep or []))
    carried = [f"keep_{c}" for c in keep or []]
    schema = ", ".join(["id long, text string, n_words long, hits array<int>, spans array<int>, items array<string>", *(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carried)])

    def over(model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = buffers(batch.column(1))
                before = [batch.column(c).to_pylist() for c in ("hits", "items")] if "hits" in batch.schema.names else None
                for lo, hi in steps(at):
                    start, end, row, covered, items = _scan(data, at[lo : hi + 1], model.value)
                    bound = np.searchsorted(row, np.arange(hi - lo + 1))
                    hits, spans, named = [], [], []
                    for k in range(hi - lo):
                        a, b = bound[k], bound[k + 1]
                        on = covered[a:b]
                        ids = items.get(k, set())
                        if before is not None:
                            on = on.copy()
                            on[np.array(before[0][lo + k] or [], np.int64)] = True
                            ids = ids | set(before[1][lo + k] or ())
                        if not on.any():
                            hits.append([]), spans.append([]), named.append([])
                            continue
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
                        first = at[lo + k] - at[lo]
                        hits.append(np.flatnonzero(on))
                        spans.append(np.stack([start[a + edge[::2]] - first, end[a + edge[1::2] - 1] - first], 1).ravel())
                        named.append(sorted(ids))
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bound), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int32())), pa.array(named, pa.list_(pa.string())), *(part.column(c) for c in carried)], ["id", "text", "n_words", "hits", "spans", "items", *carried])

        return run

    out, held, taken = source, 0, []
    for r in benchmark.select(F.col(item_col).alias("i"), F.col("text").alias("t")).toLocalIterator():
        own = item_words(r["t"])
        cost = sum(map(len, own)) + 25 * len(own)
        if taken and held + cost > block_bytes:
            out = settle(out.mapInArrow(over(spark.sparkContext.broadcast(window_set(taken, size))), schema), shared_dir(spark), "block").select("id", "text", "hits", "items", *carried)
            held, taken = 0, []
        taken.append((r["i"], r["t"]))
        held += cost
    out = out.mapInArrow(over(spark.sparkContext.broadcast(window_set(taken, size))), schema)
    return out.withColumnsRenamed({c: c.removeprefix("keep_") for c in carried if c.removeprefix("keep_") not in NAMES})


def judged(scanned: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (a twentieth of the words or more lies in benchmark windows)."""
    n_hit = F.size("hits").cast("long")
    return scanned.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words"))})


def without_spans(text: str, spans: str) -> Column:
    """Texts without the byte ranges of their hit runs."""

    def cut(t: str, s) -> str:
        if not len(s):
            return t
        raw, out, last = t.encode(), [], 0
        for a, b in zip(s[::2], s[1::2], strict=True):
            out.append(raw[last:a])
            last = b
        return b"".join([*out, raw[last:]]).decode()

    def each(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([cut(*x) for x in zip(t, s, strict=True)], dtype=object)

    return F.pandas_udf(each, "string")(text, spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id and text: without contaminated documents (mode document), or with the hit runs cut out (mode span)."""
    found = judged(scan(docs, benchmark, id_col, text_col, **options))
    out = found.where(~F.col("contaminated")) if mode == "document" else found.withColumn("text", without_spans("text", "spans"))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col))


def items_digest(col: str = "items"):
    return F.sha2(F.array_join(F.array_sort(col), ","), 256)


__all__ = ["WindowSet", "decontaminate", "items_digest", "judged", "scan", "window_set"]
