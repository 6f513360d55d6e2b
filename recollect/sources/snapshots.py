"""Versioned Parquet tables: every write makes a new directory, readers take a whole one.

A version is complete once its ``_SUCCESS`` marker exists, so a lost writer leaves nothing a
reader would pick up, and writing the same version again replaces it with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, location: str):
    return spark._jvm.org.apache.hadoop.fs.Path(location)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions in ascending order."""
    path = _path(spark, root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(_path(spark, f"{root}/{name}/_SUCCESS")):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The given or the newest complete version, None if there is none."""
    known = versions(spark, root)
    if version is None:
        version = known[-1] if known else None
    if version is None or version not in known:
        return None
    return spark.read.parquet(f"{root}/version={version}")


def write_version(
    df: DataFrame, root: str, version: int, partition_by: list[str] | None = None, rows_per_file: int = 5_000_000
) -> str:
    """Write one version; files are cut by row count so that no file grows with its partition."""
    target = f"{root}/version={version}"
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target
