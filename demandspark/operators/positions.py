"""Row positions within groups that may each be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.session import materialize


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``position`` 1..n in ``order`` and ``n_rows`` to every row of every group.

    ``order`` must be a total order. Rows are range-partitioned, numbered inside their range, and moved by the size of
    the ranges before, whatever the size of a group. The ranges are written first, because both steps must see the same
    ones, also after a lost executor.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = W.partitionBy(*keys).orderBy("_range")
    sizes = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_size").over(ranges.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                "n_rows": F.sum("_size").over(W.partitionBy(*keys)),
            }
        )
    )
    within = W.partitionBy(*keys, "_range").orderBy(*order)
    placed = ranged.withColumn("_place", F.row_number().over(within)).join(sizes, [*keys, "_range"])
    return placed.withColumn("position", F.col("_before") + F.col("_place")).drop(
        "_range", "_size", "_before", "_place"
    )
