"""Boosted-tree forecasts (Spark ML) and the learned zone ranker (:mod:`boosting`).

The driver loops only over folds and input sets, because each is a separate model; fitting and
scoring run on the cluster.  A few fits run at the same time: each boosting round is a row of short
jobs, and one fit alone leaves most of the cluster waiting for the next of them.  Both kinds of boosted trees bound depth rather than leaves
and have no L2 penalty, so models are compared with the published ones by error, not by value.  A forecast has a row an hour; the
ranker has one for each zone and hour, for which Spark ML takes too long.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.config import DAY_AHEAD_INPUTS, LEARNED, NEXT_HOUR_INPUTS, RANKER_INPUTS, TOP_K, Fold
from demandspark.operators import boosting
from demandspark.operators.features import TARGET
from demandspark.operators.ranking import EVERY_ZONE, HOUR_KEY, top_ranked
from demandspark.operators.timeseries import as_predictions, complete_rows, test_rows
from demandspark.session import materialize, shared_dir

FITS_AT_ONCE = 4
FORECAST_MODELS = {"gradient_boosting_lag1": NEXT_HOUR_INPUTS, "gradient_boosting_24h": DAY_AHEAD_INPUTS}


def boosted_trees(
    inputs: Sequence[str], label: str, iterations: int, step: float, depth: int, seed: int = 42
) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="inputs")
    trees = GBTRegressor(
        featuresCol="inputs",
        labelCol=label,
        predictionCol="predicted",
        maxIter=iterations,
        stepSize=step,
        maxDepth=depth,
        maxBins=256,
        seed=seed,
    )
    return Pipeline(stages=[assembler, trees])


def forecaster(inputs: Sequence[str], iterations: int = 300) -> Pipeline:
    return boosted_trees(inputs, "trips", iterations, step=0.06, depth=5)


def ranker(panel: DataFrame, iterations: int = 200) -> boosting.BoostedTrees:
    return boosting.fit(panel, RANKER_INPUTS, TARGET, iterations, step=0.05, depth=4)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _fit_all(jobs: list[tuple[Pipeline, DataFrame]]) -> list[PipelineModel]:
    """One fitted pipeline per (pipeline, training rows), in order."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda job: job[0].fit(job[1]), jobs))


def model_predictions(features: DataFrame, folds: Sequence[Fold], iterations: int = 300) -> DataFrame:
    """Long predictions of both forecast models, one fit per fold and model."""
    ready = materialize(features, "lag-features")
    parts = [(fold, name, inputs) for fold in folds for name, inputs in FORECAST_MODELS.items()]
    jobs = [
        (forecaster(inputs, iterations), complete_rows(ready.filter(F.col("date") < F.lit(fold.start)), inputs))
        for fold, _, inputs in parts
    ]
    frames = [
        as_predictions(
            model.transform(complete_rows(test_rows(ready, [fold]), inputs)), F.lit(name), F.col("predicted")
        )
        for (fold, name, inputs), model in zip(parts, _fit_all(jobs), strict=True)
    ]
    return _union(frames)


def final_models(features: DataFrame, iterations: int = 300) -> dict[str, PipelineModel]:
    """Both forecast models on every complete row."""
    shared_dir(features.sparkSession)
    jobs = [(forecaster(inputs, iterations), complete_rows(features, inputs)) for inputs in FORECAST_MODELS.values()]
    return dict(zip(FORECAST_MODELS, _fit_all(jobs), strict=True))


def learned_scores(
    panel: DataFrame, targets: DataFrame, folds: Sequence[Fold], iterations: int = 200
) -> DataFrame:
    """Predicted gross spend of every candidate zone at every test hour; one model per fold.

    ``panel`` comes from :func:`training_panel` and ``targets`` from :func:`frozen_features`; each is
    written once.  A fold without training rows is left out.
    """
    ready, targets = materialize(panel, "training-panel"), materialize(targets, "frozen-features")
    trained = {row.fold for row in ready.select("fold").distinct().toLocalIterator()}
    numbers = [fold.number for fold in folds if fold.number in trained]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        models = list(pool.map(lambda n: ranker(ready.filter(F.col("fold") == n), iterations), numbers))
    kept = [*HOUR_KEY, "PULocationID"]
    frames = [
        model.predict(targets.filter(F.col("fold") == n), kept, "predicted_gross_passenger_spend")
        for n, model in zip(numbers, models, strict=True)
    ]
    if not frames:
        return targets.select(
            *HOUR_KEY, "PULocationID", F.lit(0.0).alias("predicted_gross_passenger_spend")
        ).filter("false")
    return _union(frames)


def learned_ranking(scores: DataFrame, k: int = max(TOP_K)) -> DataFrame:
    """First k zones of every test hour, in the layout of the baseline rankings."""
    ranked = top_ranked(scores, HOUR_KEY, "predicted_gross_passenger_spend", k)
    return ranked.withColumns({"scope": F.lit(EVERY_ZONE.name), "baseline": F.lit(LEARNED)})
