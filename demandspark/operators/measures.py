"""Additive measures of trips, read off single trips or off a table of their sums (a cube).

A cube holds one row per date, hour, zone and payment type with counts and sums. Every table that needs only counts, sums
and their ratios can be built from it, so one scan of the trips serves all of them, and cubes of parts of the trips add
up: the hourly stream keeps the same measures as its state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.columns import is_weekend, ratio

SUMMED = ("trip_distance", "trip_duration_min", "total_amount", "fare_amount", "tip_amount", "tip_rate")
CUBE_KEY = ("pickup_date", "pickup_hour", "PULocationID", "payment_type")
ADDITIVE = ("trips", *(f"{part}_{c}" for c in SUMMED for part in ("sum", "n")), "moved_amount", "moved_distance")


def additive() -> list[Column]:
    """The aggregates of a cube; ``moved`` ones cover trips with a positive distance."""
    moved = F.col("trip_distance") > 0
    parts = {"sum": F.sum, "n": F.count}
    return [
        F.count(F.lit(1)).alias("trips"),
        *[function(c).alias(f"{part}_{c}") for c in SUMMED for part, function in parts.items()],
        F.sum(F.when(moved, F.col("total_amount"))).alias("moved_amount"),
        F.sum(F.when(moved, F.col("trip_distance"))).alias("moved_distance"),
    ]


def cube(trips: DataFrame, key: Sequence[str] = CUBE_KEY) -> DataFrame:
    """Counts and sums of clean trips per ``key``: as many rows as the calendar, the zones and the payment types allow."""
    dated = trips.withColumns({"pickup_date": F.to_date("pickup_datetime"), "pickup_hour": F.hour("pickup_datetime")})
    return dated.groupBy(*key).agg(*additive())


class Measures:
    """How to count and sum over a frame of trips, or over a cube of them."""

    def __init__(self, trips: DataFrame):
        self.summed = "sum_total_amount" in trips.columns
        dated = F.col("pickup_date") if self.summed else F.to_date("pickup_datetime")
        self.date, self.hour = dated, F.col("pickup_hour") if self.summed else F.hour("pickup_datetime")
        self.weekend = is_weekend(dated) if self.summed else F.col("is_weekend")
        self.month = F.month(dated) if self.summed else F.col("month")

    def trips(self, condition: Column | None = None) -> Column:
        if not self.summed:
            return F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return F.sum("trips" if condition is None else F.when(condition, F.col("trips")).otherwise(F.lit(0).cast("long")))

    def total(self, column: str, condition: Column | None = None, otherwise: float | None = None) -> Column:
        value = F.col(f"sum_{column}" if self.summed else column)
        return F.sum(value if condition is None else F.when(condition, value).otherwise(F.lit(otherwise).cast("double")))

    def mean(self, column: str, condition: Column | None = None) -> Column:
        """Average over the trips with a value."""
        if not self.summed:
            return F.avg(column if condition is None else F.when(condition, F.col(column)))
        known = F.col(f"n_{column}")
        return ratio(self.total(column, condition), F.sum(known if condition is None else F.when(condition, known)))

    def moved_ratio(self) -> Column:
        """Spend per mile over the trips with a positive distance."""
        if self.summed:
            return ratio(F.sum("moved_amount"), F.sum("moved_distance"))
        moved = F.col("trip_distance") > 0
        return ratio(F.sum(F.when(moved, F.col("total_amount"))), F.sum(F.when(moved, F.col("trip_distance"))))
