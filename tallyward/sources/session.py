"""A session with the settings the reports are planned for.

Operators never open one: a caller with a session of its own passes that.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution picks join sides from real sizes, splits partitions one hot
# key fills, and merges small ones up to the advisory size, so that a high
# initial count costs little on small tables and is there for large ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}

_PARTITION_BYTES = 128 * 1024**2


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Partitions of about 128 MiB, one per core at least."""
    return max(cores, -(-input_bytes // _PARTITION_BYTES))


def partition_settings(count: int) -> dict[str, str]:
    """Settings for a known input size, for ``open_session(**settings)``."""
    return {
        "spark.sql.shuffle.partitions": str(count),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(count),
    }


def open_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """``settings`` add to or replace those above, as ``**{'spark.some.key': 'value'}``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
