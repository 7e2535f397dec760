"""Stage tables: cutting lineage at a place every executor can reach."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder of this application's stage tables, removed when the process ends.

    It lies in the folder that ``spark.checkpoint.dir`` names.  A session without
    that setting gets one beside its tables, in the warehouse, which the driver
    and the executors share as well.
    """
    app = spark.sparkContext.applicationId
    if app not in _runs:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"
        _runs[app] = f"{base.rstrip('/')}/cellframe-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _runs[app])
    return _runs[app]


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new folder name under the stage root."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` as a written parquet table that later steps read instead of recomputing it.

    Unlike a cached block the table survives lost executors; unlike a row
    checkpoint it keeps column pruning, and its file sizes are real statistics
    for the join planner.
    """
    path = stage_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
