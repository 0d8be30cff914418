"""Panel sources: feature and target files, panels derived from the test tables, a synthetic generator; CSV and JSON sinks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["date", "identifier"]


def feature_target(spark: SparkSession, features: str, target: str) -> DataFrame:
    """Inner join of a feature and a target file on (date, identifier)."""
    return spark.read.parquet(features).join(spark.read.parquet(target).select(*KEYS, "target"), KEYS)


def class_paths(data_dir: str, number: int, split: str = "in_sample") -> tuple[str, str]:
    return f"{data_dir}/feature_class_{number}_{split}.parquet", f"{data_dir}/feature_class_{number}_target_{split}.parquet"


def load_class(spark: SparkSession, data_dir: str, number: int, split: str = "in_sample") -> DataFrame:
    return feature_target(spark, *class_paths(data_dir, number, split))


def feature_columns(df: DataFrame) -> list[str]:
    """Everything but the reserved names, in file order."""
    return [c for c in df.columns if c not in (*KEYS, "target")]


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for report tables, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _ranked(base: DataFrame, reversed_: Sequence[int] = (5,)) -> DataFrame:
    """percent_rank features f1..f8 of a1..a8 within the date, and the entity's next value against its date's mean."""
    by_date = Window.partitionBy("date")
    out = base.withColumn("fwd", F.lead("ahead").over(Window.partitionBy("identifier").orderBy("date")))
    rank = {f"f{k}": F.percent_rank().over(by_date.orderBy(f"a{k}")) for k in range(1, 9)}
    cols = [(1 - r if int(c[1:]) in reversed_ else r).alias(c) for c, r in rank.items()]
    return out.select(*KEYS, *cols, F.round(F.col("fwd") - F.avg("fwd").over(by_date), 6).alias("target")).where(F.col("target").isNotNull())


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by fortnight, from line items; every rounding keeps ranks independent of summation order."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    price, cut = F.col("l_extendedprice"), F.col("l_discount")
    base = line.groupBy(F.floor(days / F.lit(14.0)).cast("bigint").alias("date"), F.col("l_suppkey").alias("identifier")).agg(
        F.sum("l_quantity").alias("a1"), F.count(F.lit(1)).cast("double").alias("a2"), F.round(F.sum(price), 4).alias("a3"), F.round(F.sum(price * (1 - cut)), 4).alias("a4"),
        F.round(F.avg(price), 6).alias("a5"), F.max(price).alias("a6"), F.round(F.avg(cut), 10).alias("a7"), F.round(F.avg("l_tax"), 10).alias("a8"))
    return _ranked(base.withColumn("ahead", F.col("a4")))


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day, from events: heavy ties and few days."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = [F.count(F.when(F.col("event_type") == k, 1)).cast("double").alias(f"a{j}") for j, k in enumerate(("click", "view", "purchase", "error"), 5)]
    base = ev.groupBy(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("date"), F.col("user_id").alias("identifier")).agg(
        F.count(F.lit(1)).cast("double").alias("a1"), F.round(F.sum("value"), 4).alias("a2"), F.max("value").alias("a3"), F.round(F.avg("value"), 6).alias("a4"), *kinds)
    return _ranked(base.withColumn("ahead", F.col("a2")), ())


def synthetic(spark: SparkSession, n_days: int = 400, n_names: int = 120, blocks: Sequence[int] = (4, 3, 1), strengths: Sequence[float] | None = None, within_noise: float = 0.6,
              common: float = 0.5, reversed_variants: Sequence[int] = (), horizon: int = 21, noise: float = 1.0, seed: int = 0, start: int = 1000) -> DataFrame:
    """Planted panel: AR(1) ideas with a common part, noisy variants ranked per day, overlapping forward target.

    The part that all names share is none, so each name is made by a seeded generator of its own, in parallel.
    """
    strengths = [0.012] * len(blocks) if strengths is None else list(strengths)
    names = [f"f{k + 1}" for k in range(sum(blocks))]
    schema = "date long, identifier string, " + ", ".join(f"v{c[1:]} double" for c in names) + ", ret double"

    def walk(rng, days: int, width: int) -> np.ndarray:
        steps = rng.normal(size=(days, width))
        out = steps.copy()
        for t in range(1, days):
            out[t] = 0.97 * out[t - 1] + np.sqrt(1 - 0.97**2) * steps[t]
        return out

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for i in pdf["id"]:
            rng = np.random.default_rng([seed, int(i)])
            days = n_days + horizon
            ideas = np.sqrt(common) * walk(rng, days, 1) + np.sqrt(1 - common) * walk(rng, days, len(blocks))
            ret = rng.normal(scale=noise, size=days) + ideas @ np.array(strengths)
            own = np.repeat(ideas, blocks, 1) + within_noise * rng.normal(size=(days, len(names)))
            parts.append(pd.DataFrame({"date": start + np.arange(days), "identifier": f"N{i:06d}"} | {f"v{k + 1}": own[:, k] for k in range(len(names))} | {"ret": ret}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["date", "identifier", *(f"v{c[1:]}" for c in names), "ret"])

    raw = spark.range(n_names).mapInPandas(lambda it: (make(p) for p in it), schema)
    ahead = Window.partitionBy("identifier").orderBy("date").rowsBetween(1, horizon)
    raw = raw.withColumn("fwd", F.sum("ret").over(ahead)).where(F.col("date") < start + n_days)
    by_date = Window.partitionBy("date")
    place = {c: F.percent_rank().over(by_date.orderBy(f"v{c[1:]}")) for c in names}
    cols = [(1 - r if k in reversed_variants else r).alias(c) for k, (c, r) in enumerate(place.items())]
    return raw.select(*KEYS, *cols, (F.col("fwd") - F.avg("fwd").over(by_date)).alias("target"))
