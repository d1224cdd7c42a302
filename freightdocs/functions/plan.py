"""Plan helpers.

A filter on a computed column is pushed below the projection that computes it,
and an explode adds such a filter by itself; both then repeat the whole
expression. For text parsing that costs more than the filter saves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Evaluate every column once; filters and explodes after it use the results.

    One row in, one row out, no shuffle: a generator is where pushdown stops.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.explode_outer(F.array(row)).alias("_row")).select("_row.*")


def explode_rows(df: DataFrame, values: Column, pos: str, name: str) -> DataFrame:
    """``posexplode`` of a computed array that evaluates the array once."""
    return df.select("doc_id", F.posexplode_outer(values).alias(pos, name)).filter(F.col(pos).isNotNull())


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out for heavy work per row where the scan has fewer splits than there are cores (one small file).

    Tables of many splits are left as they are: a shuffle of all texts would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if df.rdd.getNumPartitions() < cores else df
