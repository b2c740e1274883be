"""Zone and driver opportunity scores over the zone-hour profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.config import AIRPORT_PATTERN, OBJECTIVES
from demandspark.functions.columns import contains_text, ratio
from demandspark.operators.ranking import top_ranked

PERIOD = ["day_type", "hour"]


def zone_opportunity(
    profile: DataFrame,
    zones: DataFrame,
    min_trips: int = 1000,
    exclude_airports: bool = False,
    airport_pattern: str = AIRPORT_PATTERN,
    top: int = 10,
) -> DataFrame:
    """Expected trips × average spend, best zones of every day type and hour."""
    totals = zones.filter(F.col("trips") >= min_trips).select(
        "PULocationID", "trips", "avg_gross_spend_per_trip"
    )
    joined = profile.join(totals, "PULocationID")
    if exclude_airports:
        joined = joined.filter(~contains_text(F.col("pickup_zone"), airport_pattern))
    scored = joined.withColumn(
        "opportunity_score", F.col("avg_daily_trips") * F.col("avg_gross_spend_per_trip")
    )
    return top_ranked(scored, PERIOD, "opportunity_score", top)


def min_max_scores(df: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """Position of each measure within its period's range; 1 when all values are equal.

    The ranges are aggregated apart and joined back, so no task gathers a whole period.
    """
    ranges = df.groupBy(*PERIOD).agg(
        *[F.min(source).alias(f"_low_{out}") for out, source in measures.items()],
        *[F.max(source).alias(f"_high_{out}") for out, source in measures.items()],
    )
    # At most 48 rows: 24 hours of two day types.
    joined = df.join(F.broadcast(ranges), PERIOD)
    scores = {}
    for out, source in measures.items():
        low, high = F.col(f"_low_{out}"), F.col(f"_high_{out}")
        scores[out] = F.when(low == high, 1.0).otherwise(ratio(F.col(source) - low, high - low))
    return joined.withColumns(scores).drop(*[f"_{end}_{out}" for out in measures for end in ("low", "high")])


def driver_opportunity(
    profile: DataFrame,
    zones: DataFrame,
    objectives: Mapping[str, tuple[float, float]] = OBJECTIVES,
    exclude_airports: bool = False,
    airport_pattern: str = AIRPORT_PATTERN,
    top: int = 10,
) -> DataFrame:
    """Weighted trip and spend scores of every day type, hour and objective at once.

    Zones missing from the totals stay in the frame without a spend score and rank last.
    """
    totals = zones.select("PULocationID", "avg_gross_spend_per_trip")
    joined = profile.join(totals, "PULocationID", "left")
    if exclude_airports:
        joined = joined.filter(~contains_text(F.col("pickup_zone"), airport_pattern))
    valued = joined.withColumn(
        "gross_spend_opportunity", F.col("avg_daily_trips") * F.col("avg_gross_spend_per_trip")
    )
    scored = min_max_scores(
        valued, {"trip_score": "avg_daily_trips", "spend_score": "gross_spend_opportunity"}
    )
    weighted = scored.select(
        "*",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("objective"),
                        (F.col("trip_score") * trips + F.col("spend_score") * spend).alias("opportunity_score"),
                    )
                    for name, (trips, spend) in objectives.items()
                ]
            )
        ),
    )
    return top_ranked(weighted, [*PERIOD, "objective"], "opportunity_score", top)
