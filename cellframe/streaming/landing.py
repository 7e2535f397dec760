"""Incremental landing of sheet files that arrive in a folder.

The scans are stateless projections, so the same parser serves a stream of
files; every run takes the files that are new since the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def land(spark: SparkSession, folder: str, schema: StructType, parse: Callable[[DataFrame], DataFrame], target: str, progress: str, fmt: str = "csv") -> StreamingQuery:
    """Parse new files of ``folder`` into the parquet table ``target``; ``progress`` is the stream's checkpoint folder.

    Both folders must be shared by the cluster.  Each file is taken exactly once.
    """
    raw = spark.readStream.format(fmt).schema(schema).option("header", "true").load(folder)
    if "file" not in raw.columns:
        raw = raw.select(F.col("_metadata.file_name").alias("file"), "*")
    return (
        parse(raw).writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress)
        .trigger(availableNow=True).start(target)
    )
