"""Depth-three boosted trees on raw features, with the tree count chosen on the inner validation days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .boosting import Trees, fit_trees
from .ic import daily_ic

ROUNDS = (25, 50, 100, 150, 200, 300, 400, 600)


def _model(rows: DataFrame, features: list[str], n: int, min_rows: int, seed: int) -> Trees:
    return fit_trees(rows, features, n, min_rows, seed)


def _scores(df: DataFrame, features: list[str], model: Trees, counts) -> DataFrame:
    """(date, identifier, target, s_<n>...): sums of the first n trees, in one pass however many trees there are."""
    keys, counts = ["date", "identifier", "target"], sorted(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = model.prefix_sums(np.ascontiguousarray(pdf[features].to_numpy(float).T), counts)
            yield pdf[keys].assign(**{f"s_{n}": sums[n] for n in counts})

    schema = StructType([*(df.schema[c] for c in keys), *(StructField(f"s_{n}", DoubleType()) for n in counts)])
    return df.select(*keys, *features).mapInPandas(run, schema)


def tree_signal(panel, days: np.ndarray, rounds=ROUNDS, min_rows: int = 1000, seed: int = 0) -> tuple[DataFrame, int]:
    """((date, identifier, target, s), chosen tree count)."""
    def rows(mask):
        return panel.df.join(F.broadcast(panel.df.sparkSession.createDataFrame([(int(d),) for d in panel.dates[mask]], "date long")), "date", "left_semi")

    inner, validation = panel.inner_split(days)
    model = _model(rows(inner), panel.features, max(rounds), min_rows, seed)
    counts = sorted({min(n, len(model)) for n in rounds})
    scored = _scores(rows(validation), panel.features, model, counts)
    long = scored.unpivot(["date", "identifier", "target"], [f"s_{n}" for n in counts], "n", "s")
    means = {r["n"]: r["m"] for r in daily_ic(long, ["n"]).groupBy("n").agg(F.avg("ic").alias("m")).collect()}
    best = max(counts, key=lambda n: -np.inf if means[f"s_{n}"] is None else means[f"s_{n}"])
    final = _model(rows(days), panel.features, best, min_rows, seed)
    out = _scores(panel.df, panel.features, final, [len(final)])
    return out.withColumnRenamed(f"s_{len(final)}", "s"), best
