"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made inside each open :func:`scope`, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}"


def materialized(df: DataFrame, scoped: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it; an open :func:`scope` deletes it if ``scoped``."""
    path = scratch_path(df.sparkSession)
    if scoped and _SCOPES:
        _SCOPES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialized` that no pending plan reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._ledgerloom_path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan needs any more: Spark deletes them once the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end: read or write the result before it."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            _delete(spark, path)
