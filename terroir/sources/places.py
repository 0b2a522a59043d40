"""Files and folders on any file system Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(path: str, spark: SparkSession | None = None):
    """(file system, its path)."""
    spark = spark or SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str, spark: SparkSession | None = None) -> bool:
    fs, p = _of(path, spark)
    return fs.exists(p)


def size(path: str, spark: SparkSession | None = None) -> int:
    """Bytes of a file, or of all files of a folder; 0 if there is none."""
    fs, p = _of(path, spark)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def copy(source: str, target: str, spark: SparkSession | None = None) -> None:
    """A file copied, also between file systems; one that is there already is replaced."""
    spark = spark or SparkSession.active()
    (a, x), (b, y) = _of(source, spark), _of(target, spark)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, True, spark._jsc.hadoopConfiguration())


def move(source: str, target: str, spark: SparkSession | None = None) -> None:
    fs, p = _of(source, spark)
    fs.rename(p, _of(target, spark)[1])


def remove(path: str, spark: SparkSession | None = None) -> None:
    fs, p = _of(path, spark)
    fs.delete(p, True)
