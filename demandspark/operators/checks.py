"""Data checks of the evaluation: each is one row (check, passed, detail)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.config import RANKER_INPUTS, Fold
from demandspark.functions.columns import round_to
from demandspark.operators.features import HISTORY_DATES, frozen_features, training_panel
from demandspark.operators.ranking import RankingInput, ranking_input

REQUIRED_PREDICTION_COLUMNS = (
    "fold",
    "test_date",
    "pickup_hour",
    "PULocationID",
    "predicted_gross_passenger_spend",
    "actual_gross_passenger_spend",
)
TARGET_COLUMNS = ("target_gross_spend", "gross_passenger_spend", "actual_gross_passenger_spend")


def _result(name: str | Column, passed: Column, detail: Column) -> list[Column]:
    return [
        (name if isinstance(name, Column) else F.lit(name)).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        detail.cast("string").alias("detail"),
    ]


def _constant(df: DataFrame, name: str, passed: bool, detail: str) -> DataFrame:
    return df.sparkSession.range(1).select(*_result(name, F.lit(passed), F.lit(detail)))


def rows_present(df: DataFrame, label: str) -> DataFrame:
    found = df.agg(F.count(F.lit(1)).alias("rows"))
    return found.select(*_result(f"{label} has rows", F.col("rows") > 0, F.col("rows")))


def folds_complete(metrics: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    found = metrics.agg(F.sort_array(F.collect_set(F.col("fold").cast("int"))).alias("found"))
    wanted = F.array(*[F.lit(f.number) for f in folds])
    return found.select(
        *_result("exactly the configured folds", F.col("found") == wanted, F.array_join("found", ","))
    )


def splits_ordered(data: RankingInput) -> DataFrame:
    """Training ends before the fold start, testing lies inside the fold; one row per fold."""
    day = F.col("pickup_date")
    dates = data.frame.agg(
        *[
            F.struct(
                F.lit(f.number).alias("fold"),
                F.lit(f.start).alias("fold_start"),
                F.lit(f.end).alias("fold_end"),
                F.max(F.when(day < F.lit(f.start), day)).alias("last_train"),
                F.min(F.when((day >= F.lit(f.start)) & (day < F.lit(f.end)), day)).alias("first_test"),
                F.max(F.when((day >= F.lit(f.start)) & (day < F.lit(f.end)), day)).alias("last_test"),
            ).alias(f"_{f.number}")
            for f in data.folds
        ]
    ).select(F.inline(F.array(*[f"_{f.number}" for f in data.folds])))
    ordered = (
        (F.col("last_train") < F.col("fold_start"))
        & (F.col("fold_start") <= F.col("first_test"))
        & (F.col("last_test") < F.col("fold_end"))
    )
    detail = F.concat_ws(" / ", *[F.col(c).cast("string") for c in ("last_train", "first_test", "last_test")])
    return dates.select(
        F.concat(F.lit("train before test, fold "), F.col("fold").cast("string")).alias("check"),
        F.coalesce(ordered, F.lit(False)).alias("passed"),
        detail.alias("detail"),
    )


def history_before_target(features: DataFrame, target_date: str, label: str) -> DataFrame:
    """No feature row may use history from its own date or later; one row per source of history.

    Needs a feature table built ``with_history_date``.
    """
    sources = [
        F.struct(F.lit(name).alias("source"), F.count_if(F.col(name) >= F.col(target_date)).alias("late"))
        for name in HISTORY_DATES
    ]
    late = features.agg(F.array(*sources).alias("sources"), F.count(F.lit(1)).alias("rows"))
    source = F.regexp_extract("source", "last_(.*)_date", 1)
    return late.select("rows", F.inline("sources")).select(
        *_result(
            F.concat(F.lit(f"{label} history precedes the target: "), source),
            (F.col("late") == 0) & (F.col("rows") > 0),
            F.concat_ws(" of ", F.col("late").cast("string"), F.col("rows").cast("string")),
        )
    )


def _changed(before: DataFrame, after: DataFrame, key: list[str], inputs: Sequence[str], early: Column) -> DataFrame:
    """Rows up to the changed hour and after it, and how many of each lack an equal row in ``after``.

    ``key`` knows a row. Each side is built once: one join by the key counts the rows and compares their inputs.
    Dense rows are mostly zeros, so their shuffle files look small enough to broadcast; the hint keeps them off the driver.
    """
    own, other = (
        df.select(*key, F.struct(*[round_to(F.col(c).cast("double"), 6).alias(c) for c in inputs]).alias(side))
        for df, side in ((before, "own"), (after, "other"))
    )
    equal = reduce(Column.__and__, [F.col(f"own.{c}") == F.col(f"other.{c}") for c in inputs])
    marked = own.join(other.hint("merge"), key, "left").select(early.alias("early"), (~F.coalesce(equal, F.lit(False))).alias("changed"))
    early_row, changed = F.col("early"), F.col("changed")
    return marked.agg(
        F.count_if(early_row).alias("n_rows"),
        F.count_if(early_row & changed).alias("n_changed"),
        F.count_if(~early_row).alias("n_later"),
        F.count_if(~early_row & changed).alias("n_later_changed"),
    )


def feature_moves(
    series: DataFrame,
    folds: Sequence[Fold],
    airport_pattern: str,
    min_history_days: int,
    panel: Callable[[RankingInput, int], DataFrame] = training_panel,
    frozen: Callable[[RankingInput], DataFrame] = frozen_features,
    amount: float = 1000.0,
) -> DataFrame:
    """Which features move when the spend of one hour is changed; two rows per fold.

    For training features the hour is the last observed one a week before the fold, and rows up to that hour must not
    change while later ones do. For test features it is the fold's first test hour, and no row of the fold may change.
    Features are built twice from the whole series and compared row by row, to six digits. A fold without such an hour
    gives no row.
    """
    found = []
    for fold in folds:
        day, stamp = F.col("pickup_date"), F.struct("pickup_date", "pickup_hour")
        in_test = (day >= F.lit(fold.start)) & (day < F.lit(fold.end))
        hours = series.agg(
            F.max(F.when(day <= F.date_sub(F.lit(fold.start), 7), stamp)).alias("training"),
            F.min(F.when(in_test, stamp)).alias("test"),
        ).first()
        plain = ranking_input(series, [fold], airport_pattern)
        for label, at in hours.asDict().items():
            if at is None:
                continue
            hit = (day == F.lit(at["pickup_date"])) & (F.col("pickup_hour") == at["pickup_hour"])
            raised = F.col("gross_passenger_spend") + F.when(hit, F.lit(amount)).otherwise(F.lit(0.0))
            moved = ranking_input(series.withColumn("gross_passenger_spend", raised), [fold], airport_pattern)
            if label == "training":
                late = (day > F.lit(at["pickup_date"])) | ((day == F.lit(at["pickup_date"])) & (F.col("pickup_hour") > at["pickup_hour"]))
                key = ["PULocationID", "pickup_date", "pickup_hour", "fold"]
                moves = _changed(panel(plain, min_history_days), panel(moved, min_history_days), key, RANKER_INPUTS, ~late)
            else:
                key = ["PULocationID", "test_date", "pickup_hour", "fold"]
                moves = _changed(frozen(plain), frozen(moved), key, RANKER_INPUTS, F.lit(True))
            found.append(
                moves.select(
                    F.lit(fold.number).alias("fold"), F.lit(label).alias("features"),
                    F.lit(at["pickup_date"]).alias("target_date"), F.lit(at["pickup_hour"]).alias("target_hour"), "*",
                )
            )
    if not found:
        kinds = "fold int, features string, target_date date, target_hour int, n_rows long, n_changed long, n_later long, n_later_changed long"
        return series.sparkSession.createDataFrame([], kinds)
    return reduce(DataFrame.unionByName, found)


def features_unmoved(moves: DataFrame) -> DataFrame:
    """No feature of :func:`feature_moves` follows its own or a later hour, and later ones follow the changed hour."""
    total = moves.agg(F.sum("n_changed").alias("early"), F.sum("n_later_changed").alias("late"))
    return total.select(
        *_result(
            "features do not follow the target hour",
            (F.col("early") == 0) & (F.col("late") > 0),
            F.concat_ws(" early, ", F.col("early").cast("string"), F.concat(F.col("late").cast("string"), F.lit(" later"))),
        )
    )


def target_not_an_input(df: DataFrame, inputs: Sequence[str] = RANKER_INPUTS) -> DataFrame:
    leaked = sorted(set(inputs) & set(TARGET_COLUMNS))
    return _constant(df, "target is not a model input", not leaked, ",".join(leaked))


def required_columns(predictions: DataFrame, required: Sequence[str] = REQUIRED_PREDICTION_COLUMNS) -> DataFrame:
    missing = [c for c in required if c not in predictions.columns]
    return _constant(predictions, "required prediction columns", not missing, ",".join(missing))


def predictions_finite(predictions: DataFrame, column: str = "predicted_gross_passenger_spend") -> DataFrame:
    value = F.col(column)
    bad = predictions.agg(
        F.count_if(value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))).alias("bad")
    )
    return bad.select(*_result("predictions are finite", F.col("bad") == 0, F.col("bad")))


def reported_metrics(metrics: DataFrame) -> DataFrame:
    """Mean NDCG@10 and precision@10 overall and per fold."""
    grouped = metrics.groupingSets([["baseline"], ["baseline", "fold"]], "baseline", "fold").agg(
        round_to(F.avg("ndcg_at_10"), 6).alias("ndcg_at_10"),
        round_to(F.avg("precision_at_10"), 6).alias("precision_at_10"),
    )
    return grouped.select(
        "baseline", F.coalesce(F.col("fold").cast("string"), F.lit("all")).alias("fold"),
        "ndcg_at_10", "precision_at_10",
    )


def beats_baselines(learned: DataFrame, baselines: DataFrame) -> DataFrame:
    best = baselines.groupBy("baseline").agg(F.avg("ndcg_at_10").alias("mean")).agg(F.max("mean")).scalar()
    own = learned.agg(F.avg("ndcg_at_10").alias("own"))
    return own.withColumn("best", best).select(
        *_result(
            "learned ranker beats the best baseline",
            F.col("own") > F.col("best"),
            F.concat_ws(" vs ", *[round_to(F.col(c), 6).cast("string") for c in ("own", "best")]),
        )
    )


def verdict(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks in one table, with the overall result as its last row."""
    every = reduce(DataFrame.unionByName, checks)
    overall = every.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return every.unionByName(
        overall.select(F.lit("overall").alias("check"), "passed", F.col("failed").cast("string").alias("detail"))
    )
