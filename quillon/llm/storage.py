"""Shared storage: where intermediate tables and files go on a cluster.

Everything that must outlive a stage is written below ``spark.checkpoint.dir``
(``sources.storage``), the one folder that driver and executors share.
"""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from quillon.sources import storage as shared
from quillon.sources.storage import fresh

#: Arrow settings, Spark's default and the value for batches of texts.
_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864", "4194304"))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    uri = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI or plain path, and the path in it."""
    if urlparse(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def publish(uri: str, write) -> int:
    """Write a file so that a retried or speculative task leaves a whole one.

    ``write(stream)`` fills a file under an attempt's own name, which is then
    moved to ``uri``; the last attempt wins and all attempts hold the same
    bytes. Returns the size in bytes.
    """
    fs, path = filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(own) as out:
        write(out)
        size = out.tell()
    fs.move(own, path)
    return size


def ship(spark: SparkSession) -> None:
    """Get a session ready: small Arrow batches, and this package on the executors.

    Batches of whole texts at Spark's default size take hundreds of megabytes
    on both sides of each Python worker; values set by the user stay.
    """
    for key, default, few in _BATCHES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, few)
    shared.ship(spark)
