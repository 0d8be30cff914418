"""Daily rank IC, scorecards and HAC inference as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at_lag, avg_rank, safe_corr

LAGS = 25


def daily_ic(df: DataFrame, by: Sequence[str] = (), signal: str = "s", target: str = "target", digits: int = 12) -> DataFrame:
    """(by, date, ic): rank correlation within each date; NULL where a side is constant."""
    keys = [*by, "date"]
    ranked = df.select(*keys, F.round(signal, digits).alias("_s"), F.col(target).alias("_t")).select(*keys, avg_rank("_s", keys).alias("_r"), avg_rank("_t", keys).alias("_q"))
    return ranked.groupBy(*keys).agg(safe_corr("_r", "_q").alias("ic"))


def feature_long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(date, identifier, target, feature, s): one row for each feature."""
    return df.unpivot(["date", "identifier", "target"], list(features), "feature", "s")


def feature_ic(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return daily_ic(feature_long(df, features), ["feature"])


def hac(series: DataFrame, value: str = "ic", by: Sequence[str] = (), order: str = "date", lags: int = LAGS) -> DataFrame:
    """(by, n, mean, variance, se, t) of a series with Bartlett weights; NULLs leave and the rest closes up.

    All lags share one window sort; a series is one group, as its order is what is measured.
    """
    w = Window.partitionBy(*by).orderBy(order) if by else Window.partitionBy(F.lit(0)).orderBy(order)
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = series.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(all_))
    x = x.withColumns({f"_l{j}": F.col("_d") * F.lag("_d", j).over(w) for j in range(1, lags + 1)})
    total = F.sum(F.col("_d") * F.col("_d"))
    for j in range(1, lags + 1):
        total = total + F.lit(2.0 * (1.0 - j / (lags + 1.0))) * F.coalesce(F.sum(f"_l{j}"), F.lit(0.0))
    out = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), total.alias("_v")).where("n > 0")
    out = out.withColumn("variance", F.greatest(F.col("_v") / F.col("n"), F.lit(1e-18))).withColumn("se", F.sqrt(F.col("variance") / F.col("n")))
    return out.withColumn("t", F.when(F.col("n") > 1, F.col("mean") / F.col("se"))).drop("_v")


def summary(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean_ic, ic_ir, nw_t, hit_rate, n_days): the population deviation, and hits above zero."""
    flat = series.where("ic is not null").groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_pop("ic")).alias("ic_ir"), F.avg((F.round("ic", 10) > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n_days"))
    t = hac(series, by=by).select(*by, F.col("t").alias("nw_t"))
    return flat.join(t, list(by)) if by else flat.crossJoin(t)  # one row each


def paired(a: DataFrame, b: DataFrame, by: Sequence[str] = (), lags: int = LAGS) -> DataFrame:
    """HAC test of a - b on common dates."""
    d = a.join(b.select("date", F.col("ic").alias("_o")), "date").withColumn("ic", F.col("ic") - F.col("_o"))
    return hac(d, by=by, lags=lags)


def lagged_ic(df: DataFrame, lags: Sequence[int]) -> DataFrame:
    """(lag, date, ic): the signal of `lag` dates before against the target, both ranked on the common names."""
    wide = df.withColumns({f"_{k}": at_lag("s", k) for k in lags})
    long = wide.select("date", "target", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("s")) for k in lags))).alias("e"))
    return daily_ic(long.select("date", "target", "e.lag", "e.s").where("s is not null"), ["lag"])


def decay_curve(df: DataFrame, last: int = 21) -> DataFrame:
    return lagged_ic(df, range(last + 1)).groupBy("lag").agg(F.avg("ic").alias("value"))


def autocorr_curve(df: DataFrame, last: int = 10) -> DataFrame:
    """(lag, value): mean daily correlation of the signal with its own past; lag 0 is one."""
    wide = df.withColumns({f"_{k}": at_lag("s", k) for k in range(1, last + 1)})
    daily = wide.groupBy("date").agg(*(safe_corr(f"_{k}", "s").alias(f"c{k}") for k in range(1, last + 1)))
    means = daily.agg(*(F.avg(f"c{k}").alias(f"c{k}") for k in range(1, last + 1)))
    pairs = [F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("value")), *(F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("value")) for k in range(1, last + 1))]
    return means.select(F.explode(F.array(*pairs)).alias("e")).select("e.lag", "e.value")


def half_life(curve: DataFrame) -> DataFrame:
    """(half_life): first crossing of half the value at lag 0, interpolated; NULL if there is none."""
    w = Window.partitionBy(F.lit(0)).orderBy("lag")  # a row for each lag
    x = curve.withColumns({"_p": F.lag("value").over(w), "_h": F.first("value").over(w) / 2})
    at = F.col("lag") - 1 + F.try_divide(F.col("_p") - F.col("_h"), F.col("_p") - F.col("value"))
    return x.agg(F.min_by(F.when(F.col("value") <= F.col("_h"), at), F.when((F.col("lag") > 0) & (F.col("value") <= F.col("_h")), F.col("lag"))).alias("half_life"))


def tradeability(df: DataFrame) -> DataFrame:
    """(half_life, ret_5d, turn_l1, turn_l5)."""
    decay, auto = decay_curve(df), autocorr_curve(df)
    pick = lambda f, k: F.max(F.when(F.col("lag") == k, F.col("value")))
    d = decay.agg(F.try_divide(pick(decay, 5), pick(decay, 0)).alias("ret_5d"))
    a = auto.agg((1 - pick(auto, 1)).alias("turn_l1"), (1 - pick(auto, 5)).alias("turn_l5"))
    return half_life(decay).crossJoin(d).crossJoin(a)  # one row each


def weekly_ic(df: DataFrame, lags: Sequence[int] = (0, 5)) -> DataFrame:
    """(date, ic): mean of the lagged ICs on dates that have every leg."""
    legs = lagged_ic(df, lags).groupBy("date").agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("_n"))
    return legs.where(F.col("_n") == len(lags)).select("date", "ic")


def weekly_score(df: DataFrame, dates: DataFrame, lags: Sequence[int] = (0, 5)) -> DataFrame:
    """(score): mean over the legs of their mean IC on the chosen dates."""
    chosen = lagged_ic(df, lags).join(F.broadcast(dates.select("date")), "date", "left_semi")
    return chosen.groupBy("lag").agg(F.avg("ic").alias("m")).agg(F.avg("m").alias("score"))


def portfolio_ir(df: DataFrame, periods: int = 252) -> DataFrame:
    """(port_ir): annualised ratio of the rank-weighted, unit-gross long-short return."""
    ranked = df.select("date", "target", F.round("s", 12).alias("s")).withColumn("_r", avg_rank("s", ["date"]))
    ranked = ranked.withColumn("_z", F.col("_r") - F.avg("_r").over(Window.partitionBy("date")))
    daily = ranked.groupBy("date").agg(F.try_divide(F.sum(F.col("_z") * F.col("target")), F.sum(F.abs("_z"))).alias("ret"))
    return daily.agg((F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(float(periods)))).alias("port_ir"))


def rolling_mean_ic(series: DataFrame, window: int = 250) -> DataFrame:
    """(date, value): trailing mean of the defined ICs, NULL until the window is full."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each date
    full = F.row_number().over(w) >= window
    return series.select("date", F.when(full, F.avg("ic").over(w.rowsBetween(1 - window, 0))).alias("value"))


def quantile_bucket(df: DataFrame, k: int) -> DataFrame:
    """(date, identifier, bucket): k ordinal buckets of the signal within the date."""
    w = Window.partitionBy("date").orderBy("s", "identifier")
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return df.select("date", "identifier", F.floor((F.row_number().over(w) - 1) * k / n).cast("bigint").alias("bucket"))


def scorecard(df: DataFrame) -> DataFrame:
    """One row: the hold-out scorecard of a signal."""
    ic = daily_ic(df)
    flat = ic.where("ic is not null").agg(
        F.avg("ic").alias("mean_ic"), (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.lit(252.0))).alias("ic_ir_ann"), F.avg((F.round("ic", 10) > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n_days"))
    t = hac(ic).select(F.col("t").alias("nw_t"))
    return flat.crossJoin(t).crossJoin(portfolio_ir(df).withColumnRenamed("port_ir", "port_ir_ann")).crossJoin(tradeability(df).select("half_life", "ret_5d", "turn_l5"))  # one row each
