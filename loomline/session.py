"""Session builder with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every session needs for equal results across engines.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Settings for scale; a cluster's own values take their place.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with REQUIRED and DEFAULTS; extra uses __ for dots in keys."""
    builder = SparkSession.builder.appName("loomline").config(map=DEFAULTS | REQUIRED)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply(spark: SparkSession) -> SparkSession:
    """Set REQUIRED on a session that someone else built."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark
