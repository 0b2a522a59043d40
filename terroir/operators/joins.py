"""Joins whose hot keys are split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters: rows of one key on the left that one task joins, about; hot keys that may be broadcast.
HOT, FEW_KEYS = 50_000, 10_000


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], hot: int = HOT) -> DataFrame:
    """The inner join on ``keys``, in which a key met by more than ``hot`` rows on the left is split into salts by a hash of the
    columns ``by`` of the left, and only the right rows of such keys are copied to every salt.

    Which keys are hot is counted beforehand, map-side first: without any, this is the plain join. At most (rows / hot) keys can be; up to
    ``FEW_KEYS`` of them travel with the tasks, more are joined. The left is read twice, so it should be a table or a checkpoint.
    Null keys join nothing. Columns: the keys, those of the left, those of the right.
    """
    keys = list(keys)
    some = left.dropna(subset=keys)
    counted = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_salts"))
    first = counted.limit(FEW_KEYS + 1).collect()
    if not first:
        return some.join(right, keys)
    if len(first) <= FEW_KEYS:
        counted = F.broadcast(left.sparkSession.createDataFrame(first, counted.schema))
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_salts")).cast("int"))
    a = some.join(counted, keys, "left").withColumn("_salt", salt).drop("_salts")
    every = F.explode(F.when(F.col("_salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_salts") - 1)))
    b = right.join(counted, keys, "left").withColumn("_salt", every).drop("_salts")
    return a.join(b, [*keys, "_salt"]).drop("_salt")
