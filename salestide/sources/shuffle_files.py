"""Shuffle files that go when they were read, not when the driver's memory fills."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """In here each query's shuffle files are deleted when it ends. Otherwise they stay
    on the executors' disks until the driver collects garbage, so that those of all
    steps of a load lie there together.

    For steps that each run once: a DataFrame that is run again shuffles again.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)
