"""Session defaults."""

from pyspark.sql import SparkSession


def session(name: str = "signalmesh", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings stay where they are given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()
