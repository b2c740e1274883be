"""Zone lookup joins.

Trips are always aggregated to zone ids before they meet the lookup.  A zone that holds a third
of all trips is then a handful of rows, and the join needs no hint: Spark broadcasts the lookup
when its measured size is under the session's threshold and shuffles both sides otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.config import SENTINEL_ZONES
from demandspark.functions.columns import borough_label, zone_label


def join_lookup(df: DataFrame, lookup: DataFrame, zone_id: str = "PULocationID") -> DataFrame:
    """Left join to the lookup, names as stored (NULL when unmatched); ids are cast to compare."""
    names = lookup.select(
        F.col("LocationID").try_cast("bigint").alias("_zone_key"),
        F.col("Zone").alias("lookup_zone"),
        F.col("Borough").alias("lookup_borough"),
    )
    key = F.col(zone_id).try_cast("bigint")
    return df.join(names, key == F.col("_zone_key"), "left").drop("_zone_key")


def label_zones(
    df: DataFrame,
    lookup: DataFrame,
    sentinels: Mapping[int, str] = SENTINEL_ZONES,
    zone_id: str = "PULocationID",
) -> DataFrame:
    """Add ``pickup_zone`` and ``pickup_borough`` with sentinel ids and unmatched ids named."""
    joined, key = join_lookup(df, lookup, zone_id), F.col(zone_id)
    return joined.withColumns(
        {
            "pickup_zone": zone_label(key, F.col("lookup_zone"), sentinels),
            "pickup_borough": borough_label(key, F.col("lookup_borough"), sentinels),
        }
    ).drop("lookup_zone", "lookup_borough")
