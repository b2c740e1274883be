"""Boosted-tree forecasts and the learned ranker."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from small_series import FOLDS, make_rows, make_series

from demandspark import schemas
from demandspark.config import LEARNED, folds_from
from demandspark.operators import features, models, ranking, ranking_metrics, scoring, timeseries
from demandspark.sources import sinks

FORECAST_FOLDS = folds_from([date(2025, 1, 22)], days=3)


@pytest.fixture(scope="module")
def lagged(spark):
    """A daily and weekly season with a bump that yesterday's value misses."""
    start = datetime(2025, 1, 1)
    rows = []
    for h in range(24 * 26):
        stamp = start + timedelta(hours=h)
        level = 200 + 15 * stamp.hour + (150 if stamp.weekday() >= 5 else 0) + (h * 7919) % 5
        rows.append((stamp.date(), stamp.hour, level))
    hourly = spark.createDataFrame(rows, schemas.HOURLY_SERIES)
    return timeseries.lag_features(timeseries.dense_hourly(timeseries.with_timestamp(hourly)), holidays={})


@pytest.fixture(scope="module")
def fitted(lagged):
    return models.model_predictions(lagged, FORECAST_FOLDS, iterations=3).cache()


def test_forecasts_are_complete_and_beat_the_worst_naive(lagged, fitted):
    everything = timeseries.naive_predictions(lagged, FORECAST_FOLDS).unionByName(fitted)
    scores = {r["model"]: r for r in scoring.score_by(everything, ["model"]).collect()}
    assert {r["n"] for r in scores.values()} == {72}
    assert fitted.filter("predicted_trips IS NULL OR isnan(predicted_trips)").count() == 0
    worst = max(scores[m]["mae"] for m in timeseries.NAIVE_MODELS)
    assert all(scores[m]["mae"] < worst for m in models.FORECAST_MODELS)


def test_same_seed_same_predictions(lagged, fitted):
    again = models.model_predictions(lagged, FORECAST_FOLDS, iterations=3)
    key = ["model", "timestamp"]
    both = fitted.join(again.select(*key, F.col("predicted_trips").alias("second")), key)
    assert both.filter(F.abs(F.col("predicted_trips") - F.col("second")) > 1e-9).count() == 0


def test_final_models_survive_a_round_trip(lagged, tmp_path):
    name, model = next(iter(models.final_models(lagged, iterations=2).items()))
    sinks.save_model(model, str(tmp_path / name))
    ready = timeseries.complete_rows(lagged, models.FORECAST_MODELS[name])
    loaded = sinks.load_model(str(tmp_path / name))
    first = [r["predicted"] for r in model.transform(ready).orderBy("timestamp").collect()]
    assert first == [r["predicted"] for r in loaded.transform(ready).orderBy("timestamp").collect()]


def test_learned_ranker(spark):
    data = ranking.ranking_input(make_series(spark, make_rows(3)), FOLDS[:2])
    panel = features.training_panel(data, min_history_days=14)
    scores = models.learned_scores(panel, features.frozen_features(data), FOLDS[:2], iterations=2)
    ranked = models.learned_ranking(scores, k=5)
    zones = {r["fold"]: r["n"] for r in data.zones.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    hours = {r["fold"]: r["n"] for r in ranking.target_hours(data).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert scores.count() == sum(zones[f] * hours[f] for f in hours)
    assert ranked.groupBy(*ranking.HOUR_KEY).count().filter("count <> 5").count() == 0
    metrics = ranking_metrics.ranking_metrics(ranked, data, baselines=(LEARNED,), ks=(3,))
    assert metrics.count() == sum(hours.values())
    named = ranking_metrics.named_predictions(ranked, data)
    assert named.filter("predicted_gross_passenger_spend IS NULL").count() == 0


def test_fold_without_training_rows_is_skipped(spark):
    data = ranking.ranking_input(make_series(spark, make_rows(3)), FOLDS[:1])
    panel = features.training_panel(data, min_history_days=60)
    assert models.learned_scores(panel, features.frozen_features(data), FOLDS[:1], iterations=1).count() == 0
