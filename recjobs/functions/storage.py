"""Shared storage for intermediate tables.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir``, the folder that the driver and
all executors share; a lost executor then costs a re-read, not a re-computation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured a temporary one is set in local mode
    (tests); on a cluster that is an error, as executors would not see it."""
    set_here = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or set_here
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="recjobs-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to shared storage and return it read back, with a flat plan."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parquet_batches(files: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Stream a written table's files (``inputFiles`` of ``materialize``) inside a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            yield from pq.ParquetFile(source, buffer_size=1 << 20).iter_batches(rows)  # not a row group's column at once
