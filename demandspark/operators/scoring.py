"""Forecast error metrics over long predictions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.config import NO_HOLIDAY
from demandspark.functions.columns import ratio


def error_measures(absolute_denominator: bool = True) -> list[Column]:
    """n, MAE, RMSE and WAPE; WAPE is NULL when the actuals sum to zero."""
    actual, error = F.col("actual_trips"), F.col("actual_trips") - F.col("predicted_trips")
    base = F.abs(actual) if absolute_denominator else actual
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        ratio(F.sum(F.abs(error)), F.sum(base)).alias("wape"),
    ]


def forecast_metrics(predictions: DataFrame) -> DataFrame:
    """Errors overall, by fold, hour, day type and holiday: one aggregation with grouping sets."""
    grains = {
        "overall": None,
        "by_fold": "fold",
        "by_hour": "hour",
        "by_day_type": "day_type",
        "holiday": "holiday",
    }
    sets = [["model"] if key is None else ["model", key] for key in grains.values()]
    keys = [key for key in grains.values() if key]
    grouped = predictions.groupingSets(sets, "model", *keys).agg(
        *[F.grouping(key).alias(f"_{key}_out") for key in keys], *error_measures()
    )
    evaluation, group = F.lit("overall"), F.lit("all")
    for name, key in grains.items():
        if key:
            is_grain = F.col(f"_{key}_out") == 0
            evaluation = F.when(is_grain, name).otherwise(evaluation)
            if key != "fold":
                group = F.when(is_grain, F.col(key).cast("string")).otherwise(group)
    fold = F.when(F.col("_fold_out") == 0, F.col("fold").cast("string")).otherwise("all")
    labelled = grouped.select(
        evaluation.alias("evaluation_set"), group.alias("group"), fold.alias("fold"),
        "model", "n", "mae", "rmse", "wape",
    )
    ordinary_day = (F.col("evaluation_set") == "holiday") & (F.col("group") == NO_HOLIDAY)
    return labelled.filter(~ordinary_day)


def matched_predictions(predictions: DataFrame) -> DataFrame:
    """Only the timestamps that every model has scored."""
    models = predictions.agg(F.countDistinct("model").alias("models"))
    scored = predictions.groupBy("timestamp").agg(F.countDistinct("model").alias("models"))
    complete = scored.filter(F.col("models") == models.scalar()).select("timestamp")
    return predictions.join(complete, "timestamp", "left_semi")


def score_by(predictions: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Errors per key; here the WAPE denominator is the plain sum of actuals."""
    return predictions.groupBy(*keys).agg(*error_measures(absolute_denominator=False))


def mae_against(scores: DataFrame, baseline: str = "baseline_lag168") -> DataFrame:
    """Relative MAE of each model against one of them."""
    reference = scores.filter(F.col("model") == baseline).select("mae").scalar()
    return scores.withColumn("mae_vs_baseline", ratio(F.col("mae"), reference) - 1)


def score_pivot(predictions: DataFrame, row: str, measure: str, models: list[str]) -> DataFrame:
    """One row per ``row`` value, one column per model."""
    scores = score_by(predictions, [row, "model"])
    return scores.groupBy(row).pivot("model", models).agg(F.first(measure))


def actual_and_predicted(predictions: DataFrame, fold: int, models: list[str]) -> DataFrame:
    """One fold, wide: the actual trips and each model's forecast per timestamp."""
    chosen = predictions.filter(F.col("fold") == fold)
    forecasts = [
        F.avg(F.when(F.col("model") == model, F.col("predicted_trips"))).alias(model) for model in models
    ]
    return chosen.groupBy("timestamp").agg(F.max("actual_trips").alias("actual"), *forecasts)
