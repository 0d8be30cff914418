"""Boosted trees against a plain implementation, and the number of jobs of a fit."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalmesh.operators import boosting, trees
from signalmesh.plans.panel import SignalPanel
from signalmesh.sources.panels import synthetic


@pytest.fixture(scope="module")
def panel(spark):
    return SignalPanel.of(synthetic(spark, 60, 40, (4, 3, 1), (0.05, 0.05, 0.05), 0.5, seed=1).persist())


def plain(x: np.ndarray, y: np.ndarray, h: np.ndarray, n_trees: int, min_rows: int, seed: int = 0) -> np.ndarray:
    """(trees, rows) predictions of every prefix, by trying every value of every drawn feature at every node."""
    out, pred = [], np.full(len(y), y.mean())
    for k in range(n_trees):
        rng = np.random.default_rng([seed, k])
        a, b = (int(v) for v in rng.integers(0, 2**32, 2, np.uint32))
        drawn = np.array([(int(v) * (a | 1) + b) % 2**32 < int(0.7 * 2**32) for v in h])
        columns = sorted(rng.permutation(x.shape[1])[: int(0.8 * x.shape[1])])
        r, step = y - pred, np.zeros(len(y))

        def split(rows: np.ndarray, depth: int, drawn=drawn, columns=columns, r=r, step=step) -> None:
            inside = rows & drawn
            g, n = r[inside].sum(), inside.sum()
            best = (0.0, None)
            for f in columns if depth < 3 else []:
                for t in np.unique(x[inside, f])[:-1]:
                    left = inside & (x[:, f] <= t)
                    gl, nl = r[left].sum(), left.sum()
                    gain = gl**2 / (nl + 5) + (g - gl) ** 2 / (n - nl + 5) - g**2 / (n + 5)
                    if min(nl, n - nl) >= min_rows and gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, t))
            if best[1] is None:
                step[rows] = 0.03 * g / (n + 5)
                return
            f, t = best[1]
            split(rows & (x[:, f] <= t), depth + 1)
            split(rows & (x[:, f] > t), depth + 1)

        split(np.ones(len(y), bool), 0)
        pred = pred + step
        out.append(pred)
    return np.array(out)


def held(df, features):
    pdf = df.withColumn("_h", F.xxhash64("date", "identifier")).toPandas()
    return pdf[features].to_numpy(float), pdf["target"].to_numpy(float), pdf["_h"].to_numpy().astype(np.uint32)


def test_trees_equal_plain_boosting(panel):
    x, y, h = held(panel.df, panel.features)
    model = boosting.fit_trees(panel.df, panel.features, 6, 50)
    got = model.prefix_sums(np.ascontiguousarray(x.T), [1, 3, 6])
    want = plain(x, y, h, 6, 50)
    for n in got:
        assert got[n] == pytest.approx(want[n - 1], abs=1e-5 * np.abs(y).max()), n


def test_trees_do_not_depend_on_tasks(panel):
    one, three = (boosting.fit_trees(panel.df, panel.features, 40, 50, tasks=n) for n in (1, 3))
    assert len(one) == 40 and all(np.array_equal(getattr(one, k), getattr(three, k)) for k in ("feature", "threshold", "leaf"))


def test_rows_beyond_memory_give_the_same_trees(panel, monkeypatch):
    x, y, h = held(panel.df, panel.features)
    table = pa.RecordBatch.from_arrays([*map(pa.array, x.T), pa.array(y), pa.array(h.astype(np.int64))], [*panel.features, "target", "_h"])
    fit = lambda: [r for b in boosting._fit_task(panel.p, len(y), 1, 10, 50, 0)(iter([table])) for r in b.to_pylist()]
    kept = fit()
    monkeypatch.setattr(boosting, "HELD", 0)
    monkeypatch.setattr(boosting, "BLOCK", 500)
    assert len(kept) == 10 and fit() == kept


def test_keys_keep_the_order_and_their_highest_value():
    x = np.array([-np.inf, -2.5, -1e-300, -0.0, 0.0, 5e-324, 0.1, 0.1001, 1.0, 7.0, 1e308, np.inf, np.nan])
    keys = boosting._keys(x)
    assert (np.diff(keys.astype(np.int64)) >= 0).all() and keys[3] == keys[4] and len(np.unique(keys)) >= 11
    for k in np.unique(keys[:-1]):
        assert ((x <= boosting._highest(k)) == (keys <= k)).all()


def test_many_values_make_even_bins():
    values = boosting._keys(np.random.default_rng(0).random(100_000))
    keys, counts = np.unique(values, return_counts=True)
    last = boosting._bounds(keys, counts)
    sizes = np.bincount(np.searchsorted(last, values))
    assert last[-1] == keys[-1] and 200 < len(sizes) <= 256 and sizes.max() < 2 * len(values) / 256


def test_empty_and_constant_rows(panel):
    none = boosting.fit_trees(panel.df.limit(0), panel.features, 3, 50)
    assert len(none) == 3 and not none.leaf.any()
    flat = boosting.fit_trees(panel.df.withColumn("target", F.lit(2.0)), panel.features, 3, 50)
    assert flat.leaf[0] == pytest.approx(2.0) and flat.leaf[1:] == pytest.approx(0)


def test_whole_grid_is_a_few_jobs(spark, panel):
    """A job for each level of each tree made thousands, which never ended within any limit."""
    spark.sparkContext.setJobGroup("trees", "")
    try:
        out, best = trees.tree_signal(panel, panel.all_days, min_rows=50)
        assert best in trees.ROUNDS and out.count() == panel.df.count()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
