"""Point-in-time zone-hour features: as of each date (training) and frozen at the fold start (test).

Both results are dense by definition (one row per zone and hour).  The hours come from a calendar
whose length is bounded by the study period.  Only observed rows are shuffled, sorted and held: a zone
is one row with its observed hours until the end, where its silent hours are made as they are read, so
that a task's memory follows the observed rows and not the dense ones.

The two modes differ on purpose, as the published study does: training history is everything before
the row's own date and its weekly means count silent weeks as zero; test history ends at the fold
start for the whole week and its weekly means cover only weeks in which the zone was active.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.config import MIN_HISTORY_DAYS, RANKER_INPUTS, WEEKS_BACK
from demandspark.functions.columns import epoch_day, finite_or_zero, ratio, training_folds
from demandspark.operators.medians import summary_with_quantiles
from demandspark.operators.ranking import (
    RankingInput,
    observed_hours,
    target_hours,
    train_frame,
    weekly_scores,
)

TARGET = "target_gross_spend"
# Latest date that each source of a row's features has seen.
HISTORY_DATES = ("last_daily_date", "last_slot_date", "last_week_date", "last_trailing_date")
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _weighted(column: str) -> Column:
    """Averages per zone-hour are weighted back by their trips before they are combined."""
    return F.col(column) * F.col("trips")


def _history_columns(trips: Column, spend: Column, minutes: Column, miles: Column) -> dict[str, Column]:
    return {
        "historical_trips": trips,
        "historical_gross_spend": spend,
        "historical_avg_spend_per_trip": ratio(spend, trips),
        "historical_avg_duration": ratio(minutes, trips),
        "historical_distance": ratio(miles, trips),
    }


def _model_inputs() -> list[Column]:
    return [finite_or_zero(F.col(name).cast("double")).alias(name) for name in RANKER_INPUTS]


def training_panel(
    data: RankingInput, min_history_days: int = MIN_HISTORY_DAYS, with_history_date: bool = False
) -> DataFrame:
    """Every candidate zone at every observed hour before each fold start, silent hours as zero.

    Features of a date do not depend on the fold, so the windows run once over the longest
    training period and the rows are then dealt to the folds that may use them.
    """
    day, last_start = F.col("pickup_date"), max(f.start for f in data.folds)
    history = data.frame.filter(day < F.lit(last_start))

    # Placed by zone once: the aggregations and both windows below need no further shuffle.  Only observed hours are
    # summed, sorted and kept; the hours in between are made from them at the end, one zone after the other.
    sums = {
        "trips": F.sum("trips"),
        "spend": F.sum("gross_passenger_spend"),
        "minutes": F.sum(_weighted("avg_trip_duration_min")),
        "miles": F.sum(_weighted("avg_trip_distance_miles")),
    }
    active = (
        history.repartition("PULocationID")
        .groupBy("PULocationID", "pickup_date", "pickup_hour")
        .agg(
            F.bool_or("is_airport").alias("is_airport"),
            *[F.coalesce(total, F.lit(0)).alias(name) for name, total in sums.items()],
        )
        .withColumns({"dow": F.weekday(day), "epoch_day": epoch_day(day)})
    )
    by_zone = W.partitionBy("PULocationID").orderBy("epoch_day")
    by_slot = W.partitionBy("PULocationID", "dow", "pickup_hour").orderBy("epoch_day")
    so_far = active.withColumns({f"day_{c}": F.sum(c).over(by_zone.rangeBetween(W.unboundedPreceding, 0)) for c in sums})
    so_far = so_far.withColumns(
        {f"slot_{c}": F.sum(c).over(by_slot.rangeBetween(W.unboundedPreceding, 0)) for c in ("trips", "spend")}
    )
    date, hour = day.alias("date"), F.col("pickup_hour").alias("hour")
    zones = so_far.groupBy("PULocationID").agg(
        F.min(day).alias("first_date"),
        F.bool_or("is_airport").alias("is_airport"),
        F.collect_set(F.struct(date, *[f"day_{c}" for c in sums])).alias("past_days"),
        F.collect_list(F.struct(date, hour, "dow", "trips", "spend", "slot_trips", "slot_spend")).alias("cells"),
    )

    # A week counts as silent where the hour was observed at all, so their number depends on the calendar alone.
    hours = observed_hours(history).withColumns({"dow": F.weekday(day), "epoch_day": epoch_day(day)})
    same_slot = W.partitionBy("dow", "pickup_hour").orderBy("epoch_day")
    weeks = F.count(F.lit(1)).over(same_slot.rangeBetween(-7 * WEEKS_BACK, -7))
    mature = hours.withColumn("n_weeks", weeks).filter(
        day >= F.date_add(history.agg(F.min("pickup_date")).scalar(), min_history_days)
    )
    by_date = mature.groupBy("pickup_date").agg(F.collect_list(F.struct("pickup_hour", "n_weeks")).alias("hours"))
    calendar = by_date.agg(F.collect_list(F.struct("pickup_date", "hours")))

    days = zones.select("*", F.inline(calendar.scalar())).select(
        "PULocationID",
        "pickup_date",
        "is_airport",
        "hours",
        F.filter(training_folds(day, data.folds), lambda f: F.col("first_date") < f["fold_start"]).alias("folds"),
        F.array_max(F.filter("past_days", lambda c: c["date"] < day)).alias("past"),
        F.filter("cells", lambda c: (c["dow"] == F.weekday(day)) & (c["date"] <= day)).alias("cells"),
    )
    in_slot = F.transform(
        "hours",
        lambda h: F.struct(
            h["pickup_hour"].alias("pickup_hour"),
            h["n_weeks"].alias("n_weeks"),
            F.filter("cells", lambda c: c["hour"] == h["pickup_hour"]).alias("slot"),
        ),
    )
    dense = days.select("PULocationID", "pickup_date", "is_airport", "folds", "past", F.inline(in_slot)).select(
        "*",
        F.get(F.filter("slot", lambda c: c["date"] == day), F.lit(0))["spend"].alias("own_spend"),
        F.array_max(F.filter("slot", lambda c: c["date"] < day)).alias("earlier"),
        F.get(F.filter("slot", lambda c: c["date"] == F.date_sub(day, 7)), F.lit(0)).alias("week_ago"),
        F.filter(
            "slot", lambda c: c["date"].between(F.date_sub(day, 7 * WEEKS_BACK), F.date_sub(day, 7))
        ).alias("recent"),
    )

    def recent_mean(column: str) -> Column:
        total = F.aggregate("recent", F.lit(0.0), lambda total, c: total + c[column])
        return ratio(total, F.col("n_weeks"))

    dates = (F.col("past.date"), F.col("earlier.date"), F.col("week_ago.date"), F.array_max("recent")["date"])
    extra = [d.alias(n) for n, d in zip(HISTORY_DATES, dates, strict=True)] if with_history_date else []
    named = dense.withColumns(
        {
            "hour": F.col("pickup_hour"),
            "day_of_week": F.weekday(day),
            "is_weekend": (F.weekday(day) >= 5).cast("int"),
            "is_airport": F.col("is_airport").cast("int"),
            **_history_columns(
                *[F.coalesce(F.col(f"past.day_{c}"), F.lit(0)) for c in ("trips", "spend", "minutes", "miles")]
            ),
            "matching_dow_hour_trips": F.col("earlier.slot_trips"),
            "matching_dow_hour_spend": F.col("earlier.slot_spend"),
            "same_hour_last_week_trips": F.col("week_ago.trips"),
            "trailing_4_week_trips": recent_mean("trips"),
            "trailing_4_week_spend": recent_mean("spend"),
        }
    )
    made = named.select(
        "PULocationID", "pickup_date", "pickup_hour", "folds", *_model_inputs(),
        finite_or_zero(F.col("own_spend")).alias(TARGET), *extra,
    )
    columns = [c for c in made.columns if c != "folds"]
    return made.select(*columns, F.inline("folds")).select("fold", *columns)


def frozen_features(data: RankingInput, with_history_date: bool = False) -> DataFrame:
    """Features of every candidate zone at every test hour, from the fold's training rows alone."""
    placed = ["fold", "PULocationID"]
    # A zone's slots and weeks stay one row for the zone; they become its test hours at the end, without a shuffle.
    slots = (
        train_frame(data)
        .repartition(*placed)
        .groupBy(*placed, "dow", "pickup_hour")
        .agg(
            F.bool_or("is_airport").alias("is_airport"),
            F.max("pickup_date").alias("last_date"),
            F.sum("trips").alias("trips"),
            F.sum("gross_passenger_spend").alias("spend"),
            F.sum(_weighted("avg_trip_duration_min")).alias("minutes"),
            F.sum(_weighted("avg_trip_distance_miles")).alias("miles"),
        )
    )
    totals = slots.groupBy(*placed).agg(
        F.bool_or("is_airport").alias("is_airport"),
        F.max("last_date").alias("last_daily_date"),
        *[F.sum(c).alias(c) for c in ("trips", "spend", "minutes", "miles")],
        F.collect_list(F.struct("dow", "pickup_hour", "trips", "spend", "last_date")).alias("slots"),
    )
    weekly = weekly_scores(data).groupBy(*placed).agg(
        F.collect_list(
            F.struct(
                "test_date", "pickup_hour", "last_week_trips", "trailing_trips", "trailing_spend",
                "last_week_date", "trailing_date",
            )
        ).alias("weeks")
    )
    # One test window per fold: at most 24 hours for each of its days.
    by_date = target_hours(data).groupBy("fold", "test_date").agg(F.collect_list("pickup_hour").alias("hours"))
    by_fold = by_date.groupBy("fold").agg(F.collect_list(F.struct("test_date", "hours")).alias("days"))
    calendar = by_fold.agg(F.map_from_entries(F.collect_list(F.struct("fold", "days")))).scalar()

    day = F.col("test_date")
    kept = [*placed, "is_airport", "trips", "spend", "minutes", "miles", "last_daily_date"]
    days = (
        totals.join(weekly, placed, "left")
        .select(*kept, "slots", "weeks", F.inline(F.element_at(calendar, F.col("fold"))))
        .select(
            *kept,
            "test_date",
            "hours",
            F.filter("slots", lambda s: s["dow"] == F.weekday(day)).alias("slots"),
            F.filter("weeks", lambda w: w["test_date"] == day).alias("weeks"),
        )
    )
    in_hour = F.transform(
        "hours",
        lambda h: F.struct(
            h.alias("pickup_hour"),
            F.get(F.filter("slots", lambda s: s["pickup_hour"] == h), F.lit(0)).alias("slot"),
            F.get(F.filter("weeks", lambda w: w["pickup_hour"] == h), F.lit(0)).alias("week"),
        ),
    )
    named = days.select(*kept, "test_date", F.inline(in_hour)).withColumns(
        {
            "hour": F.col("pickup_hour"),
            "day_of_week": F.weekday(day),
            "is_weekend": (F.weekday(day) >= 5).cast("int"),
            "is_airport": F.col("is_airport").cast("int"),
            **_history_columns(F.col("trips"), F.col("spend"), F.col("minutes"), F.col("miles")),
            "matching_dow_hour_trips": F.col("slot.trips"),
            "matching_dow_hour_spend": F.col("slot.spend"),
            "same_hour_last_week_trips": F.col("week.last_week_trips"),
            "trailing_4_week_trips": F.col("week.trailing_trips"),
            "trailing_4_week_spend": F.col("week.trailing_spend"),
            "last_slot_date": F.col("slot.last_date"),
            "last_week_date": F.col("week.last_week_date"),
            "last_trailing_date": F.col("week.trailing_date"),
        }
    )
    extra = HISTORY_DATES if with_history_date else []
    return named.select(*placed, "test_date", "pickup_hour", *_model_inputs(), *extra)


def feature_null_counts(features: DataFrame) -> DataFrame:
    """Missing values per column, long."""
    names = features.columns
    counts = features.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("missing")) for n in names])
    return counts.select(F.inline(pairs))


def feature_summary(features: DataFrame, columns: Sequence[str] = RANKER_INPUTS) -> DataFrame:
    """Count, mean, spread, range and quartiles per column, long; the input is read twice."""
    stats = [
        F.struct(
            F.lit(c).alias("feature"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        ).alias(c)
        for c in columns
    ]
    totals, quartiles = summary_with_quantiles(features, columns, stats, QUARTILES)
    long = totals.select(F.inline(F.array(*columns)))
    stacked = long.unionByName(quartiles.withColumnRenamed("_measure", "feature"), allowMissingColumns=True)
    return stacked.groupBy("feature").agg(*[F.max(c).alias(c) for c in stacked.columns if c != "feature"])
