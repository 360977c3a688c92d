"""The Spark session the engine expects: UTC dates, adaptive execution, Arrow, fair scheduling; and jobs side by side in it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


def build_session(name: str = "tessera", **conf: str) -> SparkSession:
    """A session with the engine's settings; conf adds to or overrides them. Sizes are the cluster's to set."""
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
    }
    builder = SparkSession.builder.appName(name)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def side_by_side(spark: SparkSession, jobs: list[Callable[[], T]], at_once: int) -> list[T]:
    """What the jobs give, in their order, run by at most at_once threads, each in a scheduler pool of its own.

    Threads inherit the caller's local properties. Small jobs of one thread fill the cores that another's leave
    idle; where the session schedules fairly, none waits for all of another's tasks. After a
    failure what hasn't begun is left out, and the first failure is raised.
    """

    def run(place: int, job: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{place % at_once}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(at_once, 1), "fits") as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(run), k, job) for k, job in enumerate(jobs)]
        try:
            return [f.result() for f in futures]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise
