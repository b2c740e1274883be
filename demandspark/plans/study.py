"""The whole study as one run: raw monthly files and a zone lookup in, result tables out.

Stages hand DataFrames to each other.  The raw files are read once, into checked trips that hold the clean ones and what
all audits need; the tables of counts and sums, the series and the opportunity scores come from one cube of the clean
trips.  Only the medians go back to the trips.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.config import LEARNED, StudyConfig
from demandspark.operators import (
    checks,
    cleaning,
    features,
    kpis,
    measures,
    models,
    opportunity,
    ranking,
    ranking_metrics,
    scoring,
    timeseries,
)
from demandspark.session import materialize, prepare
from demandspark.sources import files, sinks


@dataclass(frozen=True)
class CleanStage:
    """Clean trips as written, and the audit counters of the same scan."""

    trips: DataFrame
    counts: DataFrame


@dataclass(frozen=True)
class Table:
    """A named result: how to build it from the clean trips (or their cube) and the lookup, and its sort order."""

    build: Callable[[DataFrame, DataFrame, StudyConfig], DataFrame]
    order_by: tuple = ()
    additive: bool = True  # needs only what a cube holds


def _desc(name: str):
    return lambda: F.desc(name)


# The result tables computed straight from clean trips.
TABLES: dict[str, Table] = {
    "kpis": Table(lambda t, z, c: kpis.kpis(t), additive=False),
    "kpis_monthly": Table(lambda t, z, c: kpis.kpis_monthly(t), ("month",), additive=False),
    "hourly_profile": Table(lambda t, z, c: kpis.hourly_profile(t), ("day_type", "pickup_hour")),
    "hourly_demand": Table(
        lambda t, z, c: kpis.hourly_demand(t, z), ("day_type", "pickup_hour", _desc("avg_daily_trips"))
    ),
    "zone_hour_profile": Table(
        lambda t, z, c: kpis.zone_hour_profile(t, z, c.sentinels), ("day_type", "hour", _desc("avg_daily_trips"))
    ),
    "hourly_timeseries": Table(lambda t, z, c: kpis.hourly_timeseries(t), ("pickup_date", "pickup_hour")),
    "zone_hour_timeseries": Table(
        lambda t, z, c: kpis.zone_hour_timeseries(t, z, c.sentinels),
        ("pickup_date", "pickup_hour", _desc("trips")),
    ),
    "zone_analysis": Table(lambda t, z, c: kpis.zone_analysis(t, z, c.sentinels), (_desc("trips"),)),
    "payment_analysis": Table(lambda t, z, c: kpis.payment_analysis(t), (_desc("trips"),)),
    "zone_hour_heatmap": Table(
        lambda t, z, c: kpis.zone_hour_heatmap(t, z), ("pickup_borough", "pickup_zone", "hour")
    ),
}


def build_table(name: str, trips: DataFrame, lookup: DataFrame, config: StudyConfig) -> DataFrame:
    return TABLES[name].build(trips, lookup, config)


def register_views(trips: DataFrame, lookup: DataFrame, config: StudyConfig) -> None:
    """Make every named table, and its inputs, queryable with ``spark.sql``."""
    trips.createOrReplaceTempView("clean_trips")
    lookup.createOrReplaceTempView("zone_lookup")
    for name in TABLES:
        build_table(name, trips, lookup, config).createOrReplaceTempView(name)


def clean_stage(spark: SparkSession, raw_path: str, out: str, config: StudyConfig) -> CleanStage:
    prepare(spark)
    marked = cleaning.with_study_month(cleaning.standardize(files.scan_trips(spark, raw_path)))
    checked = cleaning.checked_trips(cleaning.flag_trips(marked, config.limits), config.limits)
    sinks.write_months(checked, f"{out}/checked_trips", F.col("study_month"))
    counts = cleaning.checked_counts(files.scan_checked_trips(spark, f"{out}/checked_trips"))
    counts = materialize(counts, "audit-counts")
    sinks.write_table(cleaning.quality_breakdown(counts), f"{out}/quality_breakdown", ["file"])
    sinks.write_table(cleaning.first_failure(counts), f"{out}/first_failure", ["file", F.desc("records")])
    sinks.write_table(cleaning.quality_summary(counts), f"{out}/data_quality_summary", ["file"])
    return CleanStage(files.scan_clean_trips(spark, f"{out}/checked_trips"), counts)


def sql_stage(trips: DataFrame, cube: DataFrame, lookup: DataFrame, out: str, config: StudyConfig) -> None:
    """The result tables; additive ones are built from ``cube``."""
    for name, table in TABLES.items():
        order = [key() if callable(key) else key for key in table.order_by]
        source = cube if table.additive else trips
        sinks.write_table(table.build(source, lookup, config), f"{out}/{name}", order)


def forecast_stage(hourly: DataFrame, out: str, config: StudyConfig) -> None:
    observed = timeseries.with_timestamp(hourly)
    lagged = materialize(
        timeseries.lag_features(timeseries.dense_hourly(observed), holidays=config.holidays), "lag-features"
    )
    fitted = models.model_predictions(lagged, config.folds, config.forecast_iterations)
    naive = timeseries.naive_predictions(lagged, config.folds)
    predictions = materialize(naive.unionByName(fitted), "forecast-predictions")
    sinks.write_table(predictions, f"{out}/forecast_predictions", ["fold", "timestamp", "model"])
    sinks.write_table(
        scoring.forecast_metrics(predictions), f"{out}/forecast_metrics", ["evaluation_set", "group", "fold", "model"]
    )
    for name, model in models.final_models(lagged, config.forecast_iterations).items():
        sinks.save_model(model, f"{out}/models/{name}")


def ranking_stage(series: DataFrame, out: str, config: StudyConfig) -> None:
    data = ranking.ranking_input(series, config.folds, config.airport_pattern)
    support = ranking.support_scopes(config.support_thresholds)
    scopes = (ranking.EVERY_ZONE, *support, *ranking.AIRPORT_SCOPES)
    ranked = materialize(ranking.rank_baselines(data, scopes), "baseline-rankings")
    scored = materialize(
        ranking_metrics.ranking_metrics(ranked, data, scopes, ks=config.top_k), "baseline-metrics"
    )
    order = ["fold", "test_date", "pickup_hour", "baseline"]

    def of(*names: str) -> DataFrame:
        return scored.filter(F.col("scope").isin(*names))

    baselines = ranking_metrics.baseline_table(of(ranking.EVERY_ZONE.name))
    sinks.write_table(baselines, f"{out}/ranking_baseline_metrics", order)
    sinks.write_table(
        ranking_metrics.support_table(of(*[s.name for s in support]), data, support),
        f"{out}/ranking_support_threshold_metrics",
        [*order, "support_threshold"],
    )
    sinks.write_table(
        ranking_metrics.airport_table(of(*[s.name for s in ranking.AIRPORT_SCOPES])),
        f"{out}/ranking_airport_metrics",
        [*order, "airport_group"],
    )
    first = ranked.filter(F.col("scope") == ranking.EVERY_ZONE.name)
    sinks.write_table(
        ranking_metrics.named_predictions(first, data), f"{out}/ranking_baseline_predictions", [*order, "rank"]
    )
    sinks.write_table(
        ranking_metrics.summary_report(baselines), f"{out}/ranking_summary", ["report", "group", "baseline"]
    )

    panel = features.training_panel(data, config.min_history_days)
    scores = models.learned_scores(
        panel, features.frozen_features(data), config.folds, config.ranker_iterations
    )
    learned = materialize(models.learned_ranking(scores), "learned-ranking")
    learned_metrics = materialize(
        ranking_metrics.baseline_table(
            ranking_metrics.ranking_metrics(learned, data, baselines=(LEARNED,), ks=config.top_k)
        ),
        "learned-metrics",
    )
    predictions = materialize(ranking_metrics.named_predictions(learned, data), "learned-predictions")
    sinks.write_table(learned_metrics, f"{out}/ranking_learned_metrics", order)
    sinks.write_table(predictions, f"{out}/ranking_learned_predictions", [*order, "rank"])
    moves = checks.feature_moves(data.frame.select(series.columns), config.folds, config.airport_pattern, config.min_history_days)
    found = [*ranking_checks(data, learned_metrics, predictions, baselines, config), checks.features_unmoved(moves)]
    sinks.write_table(checks.verdict(found), f"{out}/ranking_validation")


def ranking_checks(
    data: ranking.RankingInput,
    learned_metrics: DataFrame,
    predictions: DataFrame,
    baselines: DataFrame,
    config: StudyConfig,
) -> list[DataFrame]:
    panel = features.training_panel(data, config.min_history_days, with_history_date=True)
    frozen = features.frozen_features(data, with_history_date=True)
    return [
        checks.rows_present(learned_metrics, "learned metrics"),
        checks.rows_present(predictions, "learned predictions"),
        checks.rows_present(baselines, "baseline metrics"),
        checks.folds_complete(learned_metrics, config.folds),
        checks.splits_ordered(data),
        checks.history_before_target(panel, "pickup_date", "training"),
        checks.history_before_target(frozen, "test_date", "test"),
        checks.target_not_an_input(data.frame),
        checks.required_columns(predictions),
        checks.predictions_finite(predictions),
        checks.beats_baselines(learned_metrics, baselines),
    ]


def opportunity_stage(trips: DataFrame, lookup: DataFrame, out: str, config: StudyConfig) -> None:
    profile = build_table("zone_hour_profile", trips, lookup, config)
    zones = build_table("zone_analysis", trips, lookup, config)
    period = ["day_type", "hour"]
    sinks.write_table(opportunity.zone_opportunity(profile, zones), f"{out}/zone_opportunity", [*period, "rank"])
    sinks.write_table(
        opportunity.driver_opportunity(profile, zones), f"{out}/driver_opportunity", [*period, "objective", "rank"]
    )


def run_study(
    spark: SparkSession, raw_path: str, lookup_path: str, out: str, config: StudyConfig | None = None
) -> None:
    """Every stage, in order; ``out`` receives one dataset per result."""
    config = config or StudyConfig()
    clean = clean_stage(spark, raw_path, out, config)
    lookup = files.scan_zone_lookup(spark, lookup_path)
    cube = materialize(measures.cube(clean.trips), "cube")
    sql_stage(clean.trips, cube, lookup, out, config)
    forecast_stage(kpis.hourly_timeseries(cube), out, config)
    ranking_stage(kpis.zone_hour_timeseries(cube, lookup, config.sentinels), out, config)
    opportunity_stage(cube, lookup, out, config)

