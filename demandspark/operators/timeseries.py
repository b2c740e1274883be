"""Dense hourly series, lag features, rolling-origin frames and naive forecasts.

Every function takes optional ``series`` key columns, so that many series (zones, say) spread over
the cluster; without them there is one citywide series, whose length is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.config import (
    DAY_AHEAD_INPUTS,
    HOLIDAYS,
    LAG_HOURS,
    NEXT_HOUR_INPUTS,
    ROLLING_HOURS,
    ROLLING_MIN_OBSERVED,
    Fold,
)
from demandspark.functions.columns import holiday_label, hour_start, test_folds, training_folds, weekend_label

# Naive forecast → (the lag it repeats, the inputs whose absence drops the row).
NAIVE_MODELS = {
    "baseline_lag1": ("lag_1", NEXT_HOUR_INPUTS),
    "baseline_lag24": ("lag_24", DAY_AHEAD_INPUTS),
    "baseline_lag168": ("lag_168", DAY_AHEAD_INPUTS),
}


def with_timestamp(hourly: DataFrame, series: Iterable[str] = ()) -> DataFrame:
    """One row per timestamp (duplicates are summed)."""
    stamp = hour_start(F.col("pickup_date"), F.col("pickup_hour")).alias("timestamp")
    return hourly.groupBy(*series, stamp).agg(F.sum("trips").alias("trips"))


def dense_hourly(observed: DataFrame, series: Iterable[str] = ()) -> DataFrame:
    """Every hour between the first and the last; hours without an observation stay NULL."""
    keys = list(series)
    bounds = observed.groupBy(*keys).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    hours = F.sequence(F.col("first"), F.col("last"), F.expr("interval 1 hour"))
    spine = bounds.filter("first IS NOT NULL").select(*keys, F.explode(hours).alias("timestamp"))
    return spine.join(observed, [*keys, "timestamp"], "left")


def missing_hours(dense: DataFrame, series: Iterable[str] = ()) -> DataFrame:
    return dense.groupBy(*series).agg(
        F.count(F.lit(1)).alias("expected_hours"),
        F.count("trips").alias("observed_hours"),
        F.count_if(F.col("trips").isNull()).alias("missing_hours"),
    )


def lag_features(
    dense: DataFrame, series: Iterable[str] = (), holidays: Mapping[date, str] = HOLIDAYS
) -> DataFrame:
    """Calendar columns, positional lags and the mean of the previous day's observed hours."""
    keys = list(series) or [F.lit(0)]
    timeline = W.partitionBy(*keys).orderBy("timestamp")
    previous = timeline.rowsBetween(-ROLLING_HOURS, -1)
    stamp, trips = F.col("timestamp"), F.col("trips")
    lags = {f"lag_{n}": F.lag(trips, n).over(timeline) for n in LAG_HOURS}
    enough = F.count(trips).over(previous) >= ROLLING_MIN_OBSERVED
    return dense.withColumns(
        {
            "hour": F.hour(stamp),
            "dow": F.weekday(stamp),
            "is_weekend": (F.weekday(stamp) >= 5).cast("int"),
            "date": F.to_date(stamp),
            "holiday": holiday_label(F.to_date(stamp), holidays),
            **lags,
            "rolling_24": F.when(enough, F.avg(trips).over(previous)),
        }
    )


def complete_rows(features: DataFrame, inputs: Iterable[str]) -> DataFrame:
    """Rows whose target and inputs are all present."""
    return features.na.drop(subset=["trips", *inputs])


def training_rows(features: DataFrame, folds: Iterable[Fold]) -> DataFrame:
    """One copy of each row per fold that may train on it."""
    return features.select("*", F.inline(training_folds(F.col("date"), folds)))


def test_rows(features: DataFrame, folds: Iterable[Fold]) -> DataFrame:
    return features.select("*", F.inline(test_folds(F.col("date"), folds)))


def fold_splits(features: DataFrame, folds: Iterable[Fold]) -> DataFrame:
    """Rows and date ranges of each fold and input set."""
    parts = {"train": training_rows(features, folds), "test": test_rows(features, folds)}
    present = {
        "next_hour": _all_present(NEXT_HOUR_INPUTS),
        "day_ahead": _all_present(DAY_AHEAD_INPUTS),
    }
    frames = [
        frame.groupBy("fold").agg(
            F.lit(part).alias("part"),
            F.count(F.lit(1)).alias("hours"),
            *[F.count_if(ok).alias(f"{name}_rows") for name, ok in present.items()],
            F.min("timestamp").alias("first_hour"),
            F.max("timestamp").alias("last_hour"),
        )
        for part, frame in parts.items()
    ]
    return frames[0].unionByName(frames[1])


def _all_present(inputs: Iterable[str]):
    condition = F.col("trips").isNotNull()
    for name in inputs:
        condition = condition & F.col(name).isNotNull()
    return condition


def as_predictions(scored: DataFrame, model, predicted) -> DataFrame:
    """The long prediction layout shared by naive and fitted models."""
    return scored.select(
        "timestamp",
        "date",
        "hour",
        weekend_label(F.col("is_weekend") == 1).alias("day_type"),
        "holiday",
        "fold",
        model.alias("model"),
        F.col("trips").cast("double").alias("actual_trips"),
        predicted.cast("double").alias("predicted_trips"),
    )


def naive_predictions(features: DataFrame, folds: Iterable[Fold]) -> DataFrame:
    """Previous hour, same hour yesterday, same hour last week; one pass over the test rows."""
    candidates = F.array(
        *[
            F.struct(
                F.lit(name).alias("naive_model"),
                F.col(lag).alias("naive_value"),
                _all_present(inputs).alias("usable"),
            )
            for name, (lag, inputs) in NAIVE_MODELS.items()
        ]
    )
    usable = test_rows(features, folds).select("*", F.inline(candidates)).filter("usable")
    return as_predictions(usable, F.col("naive_model"), F.col("naive_value"))
