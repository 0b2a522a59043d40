"""Incremental runs: only vintages that are not yet in the table are built and appended."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def built_vintages(spark: SparkSession, path: str) -> set[int]:
    """Years that have a partition at the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {int(n[5:]) for n in names if n.startswith("year=")}


def append_vintages(spark: SparkSession, path: str, years: Iterable[int], build: Callable[[int], DataFrame]) -> list[int]:
    """Builds each missing year into its own partition; returns the years built. A year is visible only when complete."""
    done, new = built_vintages(spark, path), []
    for year in sorted(set(years)):
        if year not in done:
            build(year).write.mode("overwrite").parquet(f"{path}/year={year}")
            new.append(year)
    return new
