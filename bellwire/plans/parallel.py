"""Running a few independent Spark jobs from driver threads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_side_by_side(spark: SparkSession, tasks: Sequence[Callable], parallelism: int) -> list:
    """Run Spark jobs from a few driver threads, results in task order."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    pool = ThreadPool(min(parallelism, len(tasks)))
    try:
        return pool.map(lambda t: t(), [inheritable_thread_target(spark)(t) for t in tasks])
    finally:
        pool.close()
