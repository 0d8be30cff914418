"""The panel: complete-case rows, their calendar, and the aggregates from which every linear fit follows.

Rows never reach the driver. A fit needs the merged daily moments (a row for each day, p by p numbers), the daily rank
ICs of the features, and the daily ICs of weight vectors, which are scored together in one job a wave.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import avg_rank, safe_corr
from ..functions.numeric import nanmean, rank_ic
from ..sources.panels import KEYS, feature_columns


def complete_cases(df: DataFrame, features: Sequence[str], strict_nulls: bool = False) -> DataFrame:
    """Rows with a target and every feature; NaN counts as missing unless only NULL does (`strict_nulls`)."""
    def ok(c: str) -> Column:
        present = F.col(c).isNotNull()
        return present if strict_nulls else present & ~F.isnan(c)

    keep = ok("target")
    for c in features:
        keep = keep & ok(c)
    return df.where(keep)


def reflected(df: DataFrame, names: Sequence[str], features: Sequence[str]) -> DataFrame:
    """x -> 1 - x for the named features; other names are ignored."""
    return df.withColumns({c: 1.0 - F.col(c) for c in names if c in features}) if set(names) & set(features) else df


def calendar(df: DataFrame) -> DataFrame:
    """(date, day_idx): positions of the distinct dates. The window runs over dates only, a row for each."""
    from pyspark.sql import Window

    return df.select("date").distinct().withColumn("day_idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint"))


@dataclass
class Moments:
    """Count, means and centred co-moments of (features, target, target rank) over a set of days."""

    n: float
    mean: np.ndarray
    co: np.ndarray

    @property
    def p(self) -> int:
        return len(self.mean) - 2

    def sd(self) -> np.ndarray:
        return np.sqrt(np.diag(self.co)[: self.p] / self.n)

    def correlation(self) -> np.ndarray:
        s = np.sqrt(np.diag(self.co)[: self.p])
        c = self.co[: self.p, : self.p] / np.outer(s, s)
        np.fill_diagonal(c, 1.0)
        return c

    def standardised(self, rank_target: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(Z'Z / n, Z'y / n) of the standardised features; the rank target has unit variance."""
        s, k = self.sd(), self.p + rank_target
        g = self.co[: self.p, k] / self.n / s
        return self.correlation(), g / np.sqrt(self.co[k, k] / self.n) if rank_target else g


@dataclass
class SignalPanel:
    """A panel DataFrame with its feature order, reflections, horizon and folds."""

    df: DataFrame
    features: list[str]
    reflected: tuple[str, ...] = ()
    horizon: int = 21
    n_folds: int = 5
    name: str = "panel"

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str] | None = None, reflect: Sequence[str] = (), strict_nulls: bool = False, **kw) -> SignalPanel:
        """Complete cases, reflections, and one exchange by date that ranks and daily aggregates then share."""
        features = list(features or feature_columns(df))
        rows = reflected(complete_cases(df, features, strict_nulls), reflect, features)
        rows = rows.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in features), F.col("target").cast("double").alias("target"))
        return cls(rows.repartition("date").persist(), features, tuple(c for c in reflect if c in features), **kw)

    @property
    def p(self) -> int:
        return len(self.features)

    @cached_property
    def n_rows(self) -> int:
        return self.df.count()

    @cached_property
    def dates(self) -> np.ndarray:
        return np.array([r[0] for r in calendar(self.df).orderBy("day_idx").select("date").collect()], np.int64)

    @property
    def n_days(self) -> int:
        return len(self.dates)

    @property
    def all_days(self) -> np.ndarray:
        return np.ones(self.n_days, bool)

    @cached_property
    def _daily(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per day: rows, means, centred co-moments; one aggregation."""
        cols = [*self.features, "target", "_rank"]
        pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
        ranked = self.df.withColumn("_rank", avg_rank("target", ["date"]))
        rows = ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(c) for c in cols)).alias("m"), F.array(*(F.covar_pop(cols[a], cols[b]) for a, b in pairs)).alias("c")).orderBy("date").toPandas()
        co = np.zeros((len(rows), len(cols), len(cols)))
        flat = np.stack(rows["c"].to_numpy()) if len(rows) else np.zeros((0, len(pairs)))
        for k, (a, b) in enumerate(pairs):
            co[:, a, b] = co[:, b, a] = flat[:, k]
        n = rows["n"].to_numpy(float)
        return n, np.stack(rows["m"].to_numpy()) if len(rows) else np.zeros((0, len(cols))), co * n[:, None, None]

    def moments(self, days: np.ndarray | None = None) -> Moments:
        """Merged moments of the chosen days (pairwise merge around the common mean)."""
        days = self.all_days if days is None else days
        n, mean, co = (x[days] for x in self._daily)
        total = n.sum()
        centre = (n[:, None] * mean).sum(0) / total
        d = mean - centre
        return Moments(total, centre, co.sum(0) + np.einsum("k,ki,kj->ij", n, d, d))

    @cached_property
    def feature_ic(self) -> np.ndarray:
        """(days, features) rank ICs."""
        return self.ic_of(np.eye(self.p))

    def mean_ic(self, days: np.ndarray) -> np.ndarray:
        return np.array([nanmean(self.feature_ic[days, j]) for j in range(self.p)])

    def ic_of(self, weights: np.ndarray, chunk: int = 256) -> np.ndarray:
        """(days, vectors) rank ICs of weight vectors on raw features; a wave is one job over the cached rows."""
        weights = np.atleast_2d(np.asarray(weights, float))
        return np.concatenate([self.day_ics(lambda x, w=weights[k : k + chunk]: x @ w.T, len(weights[k : k + chunk])) for k in range(0, len(weights), chunk)], 1)

    def day_ics(self, signals, width: int) -> np.ndarray:
        """(days, signals) rank ICs of a function from a day's feature matrix to its signal matrix."""
        cols = self.features

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            s = signals(pdf[cols].to_numpy(float))
            top = np.abs(s).max(0)  # digits count from the largest signal of the day, so that sums that cancel are ties
            scale = np.where(top == 0, 1, top)
            digits = 10.0 ** (11 - np.floor(np.log10(scale)))
            return pd.DataFrame({"date": [pdf["date"].iloc[0]], "ic": [rank_ic(np.round(s * digits) / digits, pdf["target"].to_numpy(float))]})

        rows = self.df.groupBy("date").applyInPandas(one, "date long, ic array<double>").orderBy("date").toPandas()
        return np.stack([np.array(v, float) for v in rows["ic"]]) if len(rows) else np.zeros((0, width))

    def signal(self, weights: np.ndarray | None = None, column: Column | None = None) -> DataFrame:
        """(date, identifier, s, target) of a weight vector, or of any column expression over the features."""
        if column is None:
            column = F.lit(0.0)
            for c, w in zip(self.features, np.asarray(weights, float), strict=True):
                column = column + F.col(c) * F.lit(float(w))
        return self.df.select(*KEYS, column.alias("s"), "target")

    def subset(self, index: Sequence[int]) -> SignalPanel:
        """Only some features; reflections of others are forgotten."""
        names = [self.features[i] for i in index]
        return replace(self, df=self.df.select(*KEYS, *names, "target"), features=names, reflected=tuple(c for c in self.reflected if c in names))

    def aligned(self) -> SignalPanel:
        """Reflected where the first principal component points the other way, if that raises the coherence; earlier reflections stay."""
        from ..operators.clustering import orientation_flips, orientation_is_artifact

        corr = self.moments().correlation()
        if not orientation_is_artifact(corr):
            return self
        flips = orientation_flips(corr, self.features)
        state = set(self.reflected) ^ set(flips)
        return replace(self, df=reflected(self.df, flips, self.features).persist(), reflected=tuple(c for c in self.features if c in state))

    def folds(self):
        from ..operators.cv import purged_kfold

        return purged_kfold(self.n_days, self.n_folds, self.horizon, self.horizon)

    def inner_split(self, days: np.ndarray):
        from ..operators.cv import inner_split

        return inner_split(days, self.n_days, self.horizon)

    def best(self, candidates: Sequence[np.ndarray], days: np.ndarray) -> int:
        """The candidate vector with the best mean IC on the days, the first one on ties; undefined ones never."""
        ics = self.ic_of(np.array(candidates))[days]
        return int(np.argmax([nanmean(ics[:, k], -np.inf) for k in range(len(candidates))]))

    def __repr__(self) -> str:
        return f"SignalPanel({self.name}: {self.n_rows:,} rows, {self.n_days:,} days, {self.p} features, reflected {list(self.reflected)})"


__all__ = ["Moments", "SignalPanel", "calendar", "complete_cases", "reflected", "safe_corr"]
