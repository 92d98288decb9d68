"""Session factory: UTC, adaptive execution, ANSI on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "quern", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on, and adaptive execution for the rest.

    Partition counts are left to adaptive coalescing unless given; on a cluster start from a high count.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    if shuffle_partitions:
        fixed["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
