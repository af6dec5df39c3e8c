"""Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ARROW_BYTES = 4 << 20  # of an Arrow batch between Spark and a Python worker, at most about


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold few bytes, by default as many as fit 10,000 rows or 64 MB: each
    task has a batch in Spark's memory (and another where it grows) and one in its worker. A smaller
    limit in bytes that is set stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(limit).removesuffix("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(limit, f"{ARROW_BYTES}b")


def use_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library from where the driver has it.

    On a cluster the library is installed or sent with ``--py-files``; a path that is set stays.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])
    environment.setdefault("OMP_NUM_THREADS", "1")  # a task has one core
