"""Dense series, lags, folds, naive forecasts and their errors."""

import math
from datetime import date, datetime, timedelta

import pytest
from helpers import as_dicts

from demandspark import schemas
from demandspark.config import folds_from
from demandspark.operators import scoring, timeseries

START = datetime(2025, 3, 1)
GAP = datetime(2025, 3, 9, 2)  # an hour that does not exist on a clock that springs forward
HOLIDAYS = {date(2025, 3, 12): "Some Day"}


def value(stamp):
    return 100 + 10 * stamp.hour + stamp.weekday()


@pytest.fixture(scope="module")
def hourly(spark):
    stamps = [START + timedelta(hours=h) for h in range(24 * 20)]
    rows = [(s.date(), s.hour, value(s)) for s in stamps if s != GAP]
    rows.append((START.date(), 0, 7))  # a second row of the first hour
    return spark.createDataFrame(rows, schemas.HOURLY_SERIES)


@pytest.fixture(scope="module")
def lagged(hourly):
    dense = timeseries.dense_hourly(timeseries.with_timestamp(hourly))
    return timeseries.lag_features(dense, holidays=HOLIDAYS).cache()


def test_duplicates_are_summed_and_gaps_stay_missing(hourly):
    dense = timeseries.dense_hourly(timeseries.with_timestamp(hourly))
    rows = {r["timestamp"]: r["trips"] for r in dense.collect()}
    assert len(rows) == 480 and rows[START] == value(START) + 7 and rows[GAP] is None
    report = timeseries.missing_hours(dense).collect()[0]
    assert tuple(report) == (480, 479, 1)


def test_lags_and_rolling_mean(lagged):
    rows = {r["timestamp"]: r for r in lagged.collect()}
    after = rows[GAP + timedelta(hours=1)]
    assert after["lag_1"] is None and after["lag_24"] == value(GAP - timedelta(hours=23))
    window = [value(GAP + timedelta(hours=1 - h)) for h in range(1, 25) if h != 1]
    assert after["rolling_24"] == pytest.approx(sum(window) / len(window))
    assert rows[START + timedelta(hours=17)]["rolling_24"] is None  # 17 observed hours
    assert rows[START + timedelta(hours=18)]["rolling_24"] is not None
    assert rows[START + timedelta(hours=168)]["lag_168"] == value(START) + 7
    assert rows[datetime(2025, 3, 12, 5)]["holiday"] == "Some Day"
    assert (after["dow"], after["is_weekend"], after["hour"]) == (6, 1, 3)


def test_series_are_independent(spark, hourly):
    keyed = hourly.selectExpr("*", "1 AS zone").unionByName(
        hourly.filter("pickup_date >= '2025-03-05'").selectExpr("*", "2 AS zone")
    )
    dense = timeseries.dense_hourly(timeseries.with_timestamp(keyed, ["zone"]), ["zone"])
    first = timeseries.lag_features(dense, ["zone"]).filter("lag_1 IS NULL").groupBy("zone").agg({"timestamp": "min"})
    assert {tuple(r) for r in first.collect()} == {(1, START), (2, datetime(2025, 3, 5))}


def test_naive_predictions_drop_rows_per_model(lagged):
    folds = folds_from([date(2025, 3, 9)])
    found = timeseries.naive_predictions(lagged, folds)
    counts = {r["model"]: r["count"] for r in found.groupBy("model").count().collect()}
    # The gap hour itself, its successor (previous hour), the same hour a day and two days later.
    assert counts == {"baseline_lag1": 168 - 4, "baseline_lag24": 168 - 3, "baseline_lag168": 168 - 3}
    split = as_dicts(timeseries.fold_splits(lagged, folds), "part")
    assert [(r["part"], r["hours"], r["day_ahead_rows"]) for r in split] == [("test", 168, 165), ("train", 192, 24)]
    matched = scoring.matched_predictions(found)
    assert matched.select("timestamp").distinct().count() == 164


def test_error_measures_by_grain(spark):
    def row(hour, model, actual, predicted, holiday="None", fold=1):
        stamp = datetime(2025, 3, 10, hour)
        return (stamp, stamp.date(), hour, "Weekday", holiday, fold, model, actual, predicted)

    rows = [
        row(0, "a", 10.0, 7.0), row(1, "a", 20.0, 24.0, "Some Day"), row(0, "b", 0.0, 2.0), row(1, "b", 0.0, 0.0, fold=2),
    ]
    table = scoring.forecast_metrics(spark.createDataFrame(rows, schemas.PREDICTIONS))
    found = {(r["evaluation_set"], r["group"], r["fold"], r["model"]): r for r in table.collect()}
    overall = found[("overall", "all", "all", "a")]
    assert (overall["n"], overall["mae"], overall["wape"]) == (2, 3.5, 7 / 30)
    assert overall["rmse"] == pytest.approx(math.sqrt(12.5))
    assert found[("overall", "all", "all", "b")]["wape"] is None
    assert found[("by_hour", "1", "all", "a")]["mae"] == 4.0
    assert found[("by_fold", "all", "2", "b")]["n"] == 1
    assert ("holiday", "Some Day", "all", "a") in found
    assert not any(key[0] == "holiday" and key[1] == "None" for key in found)
    # overall 2, folds 3, hours 4, day types 2, holidays 1
    assert len(found) == 12


def test_relative_mae(spark):
    scores = spark.createDataFrame([("baseline_lag168", 4.0), ("x", 3.0)], "model string, mae double")
    found = {r["model"]: r["mae_vs_baseline"] for r in scoring.mae_against(scores).collect()}
    assert found == {"baseline_lag168": 0.0, "x": -0.25}
