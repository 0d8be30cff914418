"""A frozen composite on a stream: the signal is a stateless projection, the coverage monitor a watermarked aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, composite, name: str = "s") -> DataFrame:
    """The streaming rows with the composite added."""
    return composite.transform(stream, name)


def coverage(scored: DataFrame, time: str, window: str = "1 day", late: str = "1 day", name: str = "s") -> DataFrame:
    """(start, n, mean) of the signal by event-time window; state is dropped behind the watermark."""
    grouped = scored.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(name).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")
