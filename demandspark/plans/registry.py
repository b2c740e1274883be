"""Named queries over the shared test tables, one per operator family.

Each callable takes (spark, directory of the tables) and returns a lazy frame over the whole tables.
Results are rounded only where two engines may differ in the last bits of a sum.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.config import BASELINES, LEARNED, RANKER_INPUTS
from demandspark.functions.columns import round_to
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
from demandspark.plans import study, testdata
from demandspark.plans.testdata import STUDY
from demandspark.session import materialize, shared_dir
from demandspark.sources import files, sinks
from demandspark.streaming import hourly as hourly_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NAIVE = list(timeseries.NAIVE_MODELS)
SUPPORT = ranking.support_scopes(STUDY.support_thresholds)
METRICS = [f"{m}_at_{k}" for k in STUDY.top_k for m in ("ndcg", "hit_rate", "precision")]
SUMMARY_MEASURES = ["ndcg_at_5", "ndcg_at_10", "ndcg_at_20", "precision_at_10", "hit_rate_at_10"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: round_to(F.col(c), digits) for c in present})


# ---------------------------------------------------------------- shared inputs


def month_flags(spark: SparkSession, sf: str) -> DataFrame:
    trips = cleaning.standardize(testdata.trips_from_events(spark, sf))
    window = cleaning.with_study_window(trips, testdata.MONTH_START, testdata.MONTH_END)
    return cleaning.flag_trips(window, STUDY.limits)


def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    trips = cleaning.standardize(testdata.trips_from_events(spark, sf))
    window = cleaning.with_study_window(trips, testdata.AUDIT_START, testdata.AUDIT_END)
    return cleaning.audit_counts(cleaning.flag_trips(window, STUDY.limits), STUDY.limits)


def shipment_flags(spark: SparkSession, sf: str) -> DataFrame:
    trips = cleaning.standardize(testdata.trips_from_shipments(spark, sf))
    return cleaning.flag_trips(cleaning.with_study_month(trips), STUDY.limits)


def shipment_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.audit_counts(shipment_flags(spark, sf), STUDY.limits)


def trips(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_trips(month_flags(spark, sf), STUDY.limits)


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_trips(shipment_flags(spark, sf), STUDY.limits)


def zones(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.zone_analysis(trips(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels)


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.zone_hour_profile(trips(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels)


def lagged(spark: SparkSession, sf: str) -> DataFrame:
    hourly = timeseries.with_timestamp(kpis.hourly_timeseries(trips(spark, sf)))
    return timeseries.lag_features(timeseries.dense_hourly(hourly), holidays=STUDY.holidays)


def naive(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.naive_predictions(lagged(spark, sf), STUDY.folds)


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.matched_predictions(naive(spark, sf))


def ranking_data(spark: SparkSession, sf: str) -> ranking.RankingInput:
    """The ranking input, written once: every ranking plan reads it several times."""
    series = kpis.zone_hour_timeseries(
        trips(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels
    )
    return ranking.ranking_input(series, STUDY.folds, STUDY.airport_pattern)


def scope_metrics(base: ranking.RankingInput, scopes=(ranking.EVERY_ZONE,)) -> DataFrame:
    ranked = ranking.rank_baselines(base, scopes)
    return ranking_metrics.ranking_metrics(ranked, base, scopes, ks=STUDY.top_k)


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ranking_metrics.baseline_table(scope_metrics(ranking_data(spark, sf)))


# ---------------------------------------------------------------- cleaning


@query
def clean_trips(spark, sf):
    return trips(spark, sf)


@query
def quality_breakdown(spark, sf):
    return cleaning.quality_breakdown(audit_counts(spark, sf))


@query
def first_failure(spark, sf):
    return cleaning.first_failure(audit_counts(spark, sf))


@query
def quality_summary(spark, sf):
    return cleaning.quality_summary(audit_counts(spark, sf))


@query
def monthly_quality_breakdown(spark, sf):
    return cleaning.quality_breakdown(shipment_counts(spark, sf))


@query
def monthly_first_failure(spark, sf):
    return cleaning.first_failure(shipment_counts(spark, sf))


@query
def monthly_quality_summary(spark, sf):
    return cleaning.quality_summary(shipment_counts(spark, sf))


@query
def accounting_check(spark, sf):
    return cleaning.accounting_check(shipment_counts(spark, sf))


@query
def record_cards(spark, sf):
    return kpis.record_cards(cleaning.quality_summary(shipment_counts(spark, sf)))


@query
def exclusion_months(spark, sf):
    return kpis.exclusion_months(cleaning.first_failure(shipment_counts(spark, sf)))


@query
def exclusion_pivot(spark, sf):
    return kpis.exclusion_pivot(cleaning.first_failure(shipment_counts(spark, sf)), testdata.SHIPMENT_MONTHS)


@query
def exclusion_trend(spark, sf):
    return kpis.exclusion_trend(cleaning.first_failure(shipment_counts(spark, sf)))


def checked_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Every shipment with its failed rules, written by month: the one pass over the raw rows."""
    path = f"{shared_dir(spark)}/checked-{uuid.uuid4().hex}"
    checked = cleaning.checked_trips(shipment_flags(spark, sf), STUDY.limits)
    sinks.write_months(checked, path, F.col("study_month"))
    return files.scan_checked_trips(spark, path)


@query
def checked_quality_breakdown(spark, sf):
    """The audit of every rule, from trips that were written once."""
    return cleaning.quality_breakdown(cleaning.checked_counts(checked_shipments(spark, sf)))


@query
def checked_first_failure(spark, sf):
    return cleaning.first_failure(cleaning.checked_counts(checked_shipments(spark, sf)))


@query
def checked_accounting(spark, sf):
    return cleaning.accounting_check(cleaning.checked_counts(checked_shipments(spark, sf)))


@query
def checked_clean_trips(spark, sf):
    """The valid trips among them."""
    return cleaning.valid_of(checked_shipments(spark, sf)).drop("study_month")


@query
def month_rerun(spark, sf):
    """Three months written, the middle one written again with its card payments alone, and all read back."""
    path = f"{shared_dir(spark)}/rerun-{uuid.uuid4().hex}"
    month = F.date_format("pickup_datetime", "yyyy-MM")
    three = shipments(spark, sf).filter(month.isin("1998-01", "1998-02", "1998-03"))
    sinks.write_months(three, path, month)
    again = shipments(spark, sf).filter((month == "1998-02") & (F.col("payment_type") == 1))
    sinks.write_months(again, path, month, replace="months")
    kept = files.scan_clean_trips(spark, path).withColumn("study_month", F.date_format("study_month", "yyyy-MM"))
    return kept.groupBy("study_month", "payment_type").agg(
        F.count(F.lit(1)).alias("trips"), round_to(F.sum("total_amount"), 2).alias("revenue")
    )


# ---------------------------------------------------------------- KPIs, profiles, series


def cube(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums of the trips, written once: what the additive tables of a study are built from."""
    return materialize(measures.cube(trips(spark, sf)), "cube")


@query
def cube_payment_analysis(spark, sf):
    return kpis.payment_analysis(cube(spark, sf))


@query
def cube_hourly_profile(spark, sf):
    return kpis.hourly_profile(cube(spark, sf))


@query
def cube_hourly_demand(spark, sf):
    return kpis.hourly_demand(cube(spark, sf), testdata.customer_zones(spark, sf))


@query
def cube_zone_hour_profile(spark, sf):
    return kpis.zone_hour_profile(cube(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels)


@query
def cube_zone_hour_timeseries(spark, sf):
    return kpis.zone_hour_timeseries(cube(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels)


@query
def cube_zone_analysis(spark, sf):
    return kpis.zone_analysis(cube(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels)


@query
def zone_hour_stream(spark, sf):
    """Trip files that arrive in three parts, some trips one part late, kept up to date by a stream that starts anew for each."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = testdata.trips_from_events(spark, sf)
    pickup = F.col("tpep_pickup_datetime")
    part = F.least(F.floor((F.dayofmonth(pickup) - 1) / 10), F.lit(2))
    arrival = F.least(part + F.when(F.xxhash64(pickup, "trip_distance") % 10 == 0, 1).otherwise(0), F.lit(2))
    for number in range(3):
        raw.filter(arrival == number).write.mode("append").parquet(f"{root}/incoming")
        stream = hourly_stream.trip_stream(spark, f"{root}/incoming", raw.schema)
        marked = cleaning.with_study_window(cleaning.standardize(stream), testdata.MONTH_START, testdata.MONTH_END)
        clean = cleaning.clean_trips(cleaning.flag_trips(marked, STUDY.limits), STUDY.limits)
        hours = hourly_stream.zone_hours(clean, "15 days")
        hourly_stream.write_changes(hours, f"{root}/hours", f"{root}/checkpoint")
    counted = hourly_stream.read_hours(spark, f"{root}/hours", hours.schema)
    return kpis.zone_hour_timeseries(counted, testdata.customer_zones(spark, sf), STUDY.sentinels)


@query
def headline_kpis(spark, sf):
    return kpis.kpis(trips(spark, sf))


@query
def shipment_kpis(spark, sf):
    return kpis.kpis(shipments(spark, sf))


@query
def kpis_monthly(spark, sf):
    return kpis.kpis_monthly(shipments(spark, sf))


@query
def median_of_monthly_medians(spark, sf):
    return kpis.median_of_monthly_medians(kpis.kpis_monthly(shipments(spark, sf)))


@query
def monthly_growth(spark, sf):
    return kpis.monthly_growth(kpis.monthly_activity(shipments(spark, sf)))


@query
def payment_analysis(spark, sf):
    return kpis.payment_analysis(trips(spark, sf))


@query
def payment_mix(spark, sf):
    return kpis.payment_mix(shipments(spark, sf))


@query
def hourly_timeseries(spark, sf):
    return kpis.hourly_timeseries(trips(spark, sf))


@query
def hourly_profile(spark, sf):
    return kpis.hourly_profile(trips(spark, sf))


@query
def profile_by_day_type(spark, sf):
    return kpis.profile_by_day_type(kpis.hourly_profile(trips(spark, sf)))


@query
def hourly_demand(spark, sf):
    return kpis.hourly_demand(trips(spark, sf), testdata.customer_zones(spark, sf))


@query
def zone_hour_profile(spark, sf):
    return profile(spark, sf)


@query
def zone_hour_timeseries(spark, sf):
    return kpis.zone_hour_timeseries(trips(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels)


@query
def zone_analysis(spark, sf):
    return zones(spark, sf)


@query
def zone_hour_heatmap(spark, sf):
    return kpis.zone_hour_heatmap(shipments(spark, sf), testdata.supplier_zones(spark, sf))


@query
def daily_trips_revenue(spark, sf):
    return kpis.daily_trips_revenue(shipments(spark, sf))


@query
def trips_by_hour(spark, sf):
    return kpis.trips_by_hour(shipments(spark, sf))


@query
def hour_dow_heatmap(spark, sf):
    return kpis.hour_dow_heatmap(trips(spark, sf))


@query
def revenue_per_mile_by_zone(spark, sf):
    return kpis.revenue_per_mile_by_zone(shipments(spark, sf))


@query
def duration_by_distance(spark, sf):
    return kpis.duration_by_distance(shipments(spark, sf))


@query
def duration_distance_correlation(spark, sf):
    return kpis.duration_distance_correlation(shipments(spark, sf))


@query
def trip_cards(spark, sf):
    return kpis.trip_cards(shipments(spark, sf))


@query
def borough_share(spark, sf):
    return kpis.borough_share(zones(spark, sf))


@query
def pareto_zones(spark, sf):
    return kpis.pareto_zones(zones(spark, sf))


@query
def filter_zones(spark, sf):
    chosen = ["ASIA", "EUROPE"]
    return kpis.filter_zones(zones(spark, sf), chosen, min_trips=10, sort_by="gross_passenger_spend")


@query
def top_zones_by_trips(spark, sf):
    return kpis.top_zones(zones(spark, sf), "trips")


@query
def top_zones_by_spend(spark, sf):
    return kpis.top_zones(zones(spark, sf), "gross_passenger_spend")


# ---------------------------------------------------------------- hourly forecasting


@query
def dense_hourly(spark, sf):
    return timeseries.dense_hourly(timeseries.with_timestamp(kpis.hourly_timeseries(trips(spark, sf))))


@query
def missing_hours(spark, sf):
    return timeseries.missing_hours(dense_hourly(spark, sf))


@query
def lag_features(spark, sf):
    return lagged(spark, sf)


@query
def zone_lag_features(spark, sf):
    key = ["PULocationID"]
    by_zone = kpis.zone_hour_timeseries(
        trips(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels
    )
    dense = timeseries.dense_hourly(timeseries.with_timestamp(by_zone, key), key)
    return timeseries.lag_features(dense, key, STUDY.holidays).select(
        *key, "timestamp", "trips", "lag_1", "lag_24", "lag_168"
    )


@query
def fold_splits(spark, sf):
    return timeseries.fold_splits(lagged(spark, sf), STUDY.folds)


@query
def naive_predictions(spark, sf):
    return naive(spark, sf)


@query
def forecast_metrics(spark, sf):
    return rounded(scoring.forecast_metrics(naive(spark, sf)), ["mae", "rmse", "wape"])


@query
def matched_metrics(spark, sf):
    return rounded(scoring.score_by(matched(spark, sf), ["model"]), ["mae", "rmse", "wape"])


@query
def mae_vs_baseline(spark, sf):
    scores = scoring.mae_against(scoring.score_by(matched(spark, sf), ["model"]))
    return rounded(scores, ["mae", "mae_vs_baseline"]).select("model", "n", "mae", "mae_vs_baseline")


@query
def wape_by_hour_model(spark, sf):
    return rounded(scoring.score_pivot(matched(spark, sf), "hour", "wape", NAIVE), NAIVE)


@query
def mae_by_fold_model(spark, sf):
    return rounded(scoring.score_pivot(matched(spark, sf), "fold", "mae", NAIVE), NAIVE)


@query
def wape_by_day_type_model(spark, sf):
    return rounded(scoring.score_pivot(matched(spark, sf), "day_type", "wape", NAIVE), NAIVE)


@query
def actual_and_predicted(spark, sf):
    return scoring.actual_and_predicted(naive(spark, sf), 1, NAIVE)


# ---------------------------------------------------------------- ranking baselines


@query
def frame_profile(spark, sf):
    return ranking.frame_profile(ranking_data(spark, sf))


@query
def train_slots(spark, sf):
    return ranking.train_slots(ranking_data(spark, sf))


@query
def train_hour_counts(spark, sf):
    return ranking.train_hour_counts(ranking_data(spark, sf))


@query
def zone_totals(spark, sf):
    return ranking_data(spark, sf).zones


@query
def profile_scores(spark, sf):
    return rounded(ranking.profile_scores(ranking_data(spark, sf)), ["score"])


@query
def weekly_scores(spark, sf):
    scores = ranking.weekly_scores(ranking_data(spark, sf)).drop("last_week_date", "trailing_date")
    return rounded(scores, ["trailing_trips", "trailing_spend"])


@query
def ranking_scores(spark, sf):
    """First 20 zones of every scope and baseline, with their scores."""
    scopes = (ranking.EVERY_ZONE, *SUPPORT, *ranking.AIRPORT_SCOPES)
    return rounded(ranking.rank_baselines(ranking_data(spark, sf), scopes), ["score"])


@query
def observed_mean_ranking(spark, sf):
    ranked = ranking.rank_baselines(ranking_data(spark, sf), variant="observed_mean")
    profile_only = ranked.filter("baseline = 'zone_hour_profile'").drop("scope", "baseline")
    return rounded(profile_only, ["score"])


@query
def ranking_predictions(spark, sf):
    base = ranking_data(spark, sf)
    return ranking_metrics.named_predictions(ranking.rank_baselines(base), base)


@query
def baseline_metrics(spark, sf):
    return rounded(metrics(spark, sf), METRICS)


@query
def support_metrics(spark, sf):
    base = ranking_data(spark, sf)
    table = ranking_metrics.support_table(scope_metrics(base, SUPPORT), base, SUPPORT)
    return rounded(table, [*METRICS, "support_coverage"])


@query
def airport_metrics(spark, sf):
    scoped = scope_metrics(ranking_data(spark, sf), ranking.AIRPORT_SCOPES)
    return rounded(ranking_metrics.airport_table(scoped), METRICS)


@query
def ranking_summary(spark, sf):
    return ranking_metrics.summary_report(metrics(spark, sf), SUMMARY_MEASURES)


@query
def support_summary(spark, sf):
    base = ranking_data(spark, sf)
    table = ranking_metrics.support_table(scope_metrics(base, SUPPORT), base, SUPPORT)
    measures = ["ndcg_at_5", "ndcg_at_10", "ndcg_at_20", "precision_at_10", "support_coverage"]
    return ranking_metrics.summarize(table, ["support_threshold", "baseline"], measures)


@query
def airport_summary(spark, sf):
    table = ranking_metrics.airport_table(scope_metrics(ranking_data(spark, sf), ranking.AIRPORT_SCOPES))
    measures = [m for m in METRICS if not m.startswith("hit_rate")]
    return ranking_metrics.summarize(table, ["baseline", "airport_group"], measures)


@query
def ndcg_by_fold(spark, sf):
    return ranking_metrics.metric_pivot(metrics(spark, sf), "baseline", "fold", [f.number for f in STUDY.folds])


@query
def ndcg_by_time_block(spark, sf):
    return ranking_metrics.metric_pivot(metrics(spark, sf), "time_block", "baseline", BASELINES)


@query
def time_block_gain(spark, sf):
    return ranking_metrics.time_block_gain(metrics(spark, sf))


@query
def gain_extremes(spark, sf):
    return ranking_metrics.gain_extremes(ranking_metrics.time_block_gain(metrics(spark, sf)))


@query
def best_ranker(spark, sf):
    return ranking_metrics.best_ranker(metrics(spark, sf))


@query
def reported_metrics(spark, sf):
    return checks.reported_metrics(metrics(spark, sf))


@query
def heldout_hours(spark, sf):
    return ranking_metrics.heldout_hours(ranking_predictions(spark, sf))


# ---------------------------------------------------------------- features and opportunity


@query
def training_panel(spark, sf):
    panel = features.training_panel(ranking_data(spark, sf), STUDY.min_history_days)
    return rounded(panel, [*RANKER_INPUTS[5:], features.TARGET])


@query
def frozen_features(spark, sf):
    return rounded(features.frozen_features(ranking_data(spark, sf)), RANKER_INPUTS[5:])


@query
def feature_null_counts(spark, sf):
    return features.feature_null_counts(features.frozen_features(ranking_data(spark, sf)))


@query
def feature_summary(spark, sf):
    frozen = materialize(features.frozen_features(ranking_data(spark, sf)), "frozen-features")
    return rounded(features.feature_summary(frozen), ["mean", "std", "min", "max", *features.QUARTILES], 4)


@query
def zone_opportunity(spark, sf):
    return opportunity.zone_opportunity(
        profile(spark, sf), zones(spark, sf), min_trips=50, exclude_airports=True,
        airport_pattern=STUDY.airport_pattern,
    )


@query
def driver_opportunity(spark, sf):
    ranked = opportunity.driver_opportunity(
        profile(spark, sf), zones(spark, sf), exclude_airports=True, airport_pattern=STUDY.airport_pattern
    )
    return rounded(ranked, ["gross_spend_opportunity", "opportunity_score"]).select(
        "hour", "day_type", "PULocationID", "pickup_zone", "avg_daily_trips", "gross_spend_opportunity",
        "objective", "opportunity_score", "rank",
    )


# ---------------------------------------------------------------- checks


@query
def fold_check(spark, sf):
    return checks.splits_ordered(ranking_data(spark, sf))


@query
def leakage_check(spark, sf):
    base = ranking_data(spark, sf)
    panel = features.training_panel(base, STUDY.min_history_days, with_history_date=True)
    frozen = features.frozen_features(base, with_history_date=True)
    return checks.history_before_target(panel, "pickup_date", "training").unionByName(
        checks.history_before_target(frozen, "test_date", "test")
    )


@query
def baseline_checks(spark, sf):
    table = metrics(spark, sf)
    return checks.verdict(
        [checks.rows_present(table, "baseline metrics"), checks.folds_complete(table, STUDY.folds)]
    )


@query
def perturbation_check(spark, sf):
    """Which features move when the spend of one hour per fold is changed: none up to that hour."""
    series = kpis.zone_hour_timeseries(trips(spark, sf), testdata.customer_zones(spark, sf), STUDY.sentinels)
    series = materialize(series, "perturbed-series")
    return checks.feature_moves(series, STUDY.folds, STUDY.airport_pattern, STUDY.min_history_days)


# ---------------------------------------------------------------- models
# Fitted values have no SQL equivalent; the queries named *_rows, *_hours and *_folds state what a fit cannot change.

FITTED: dict[tuple[str, str, str], tuple] = {}


def fitted(label: str, spark: SparkSession, sf: str, build: Callable[[], tuple]) -> tuple:
    """What ``build`` fits on a folder of tables, kept for the application: several queries read the same written result."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in FITTED:
        FITTED[key] = build()
    return FITTED[key]


def all_predictions(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        ready = materialize(lagged(spark, sf), "lag-features")
        own = models.model_predictions(ready, STUDY.folds, STUDY.forecast_iterations)
        naive_rows = timeseries.naive_predictions(ready, STUDY.folds)
        return (materialize(naive_rows.unionByName(own), "predictions"),)

    return fitted("forecast", spark, sf, build)[0]


def learned(spark: SparkSession, sf: str) -> tuple[ranking.RankingInput, DataFrame, DataFrame]:
    """(ranking input, learned ranking, its metrics)."""

    def build():
        base = ranking_data(spark, sf)
        panel = features.training_panel(base, STUDY.min_history_days)
        scores = models.learned_scores(
            panel, features.frozen_features(base), STUDY.folds, STUDY.ranker_iterations
        )
        ranked = materialize(models.learned_ranking(scores), "learned-ranking")
        return base, ranked, materialize(learned_table(base, ranked), "learned-metrics")

    return fitted("ranker", spark, sf, build)


def final_predictions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Predictions of the final fits, and the same beside those of the models saved and loaded again."""

    def build():
        ready = materialize(lagged(spark, sf), "lag-features")
        root = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
        frames, reloaded = [], []
        for name, model in models.final_models(ready, STUDY.forecast_iterations).items():
            rows = timeseries.complete_rows(ready, models.FORECAST_MODELS[name]).withColumn("fold", F.lit(0))
            scored = model.transform(rows)
            frames.append(timeseries.as_predictions(scored, F.lit(name), F.col("predicted")))
            sinks.save_model(model, f"{root}/{name}")
            both = sinks.load_model(f"{root}/{name}").transform(scored.drop("inputs").withColumnRenamed("predicted", "before"))
            reloaded.append(both.select(F.lit(name).alias("model"), "timestamp", F.col("trips").cast("double").alias("actual_trips"), "before", "predicted"))
        return (
            materialize(frames[0].unionByName(frames[1]), "final-predictions"),
            materialize(reloaded[0].unionByName(reloaded[1]), "reloaded-predictions"),
        )

    return fitted("final", spark, sf, build)


def is_finite(column: str):
    value = F.col(column)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def learned_table(base: ranking.RankingInput, ranked: DataFrame) -> DataFrame:
    table = ranking_metrics.ranking_metrics(ranked, base, baselines=(LEARNED,), ks=STUDY.top_k)
    return ranking_metrics.baseline_table(table)


@query
def model_forecast_predictions(spark, sf):
    return all_predictions(spark, sf)


@query
def model_forecast_metrics(spark, sf):
    """All five forecasts on the hours every one of them has scored."""
    scored = scoring.matched_predictions(all_predictions(spark, sf))
    return scoring.mae_against(scoring.score_by(scored, ["model"]))


@query
def final_model_fit(spark, sf):
    """Both forecast models fitted on every complete row, with their errors on those rows."""
    return scoring.score_by(final_predictions(spark, sf)[0], ["model"])


@query
def model_forecast_rows(spark, sf):
    """Which hours each fitted model forecasts, with their actual trips and whether the forecast is a number."""
    own = all_predictions(spark, sf).filter(F.col("model").isin(list(models.FORECAST_MODELS)))
    return own.select("fold", "model", "timestamp", "actual_trips", is_finite("predicted_trips").alias("finite"))


@query
def final_model_rows(spark, sf):
    """Which hours the final fits cover."""
    own = final_predictions(spark, sf)[0]
    return own.select("model", "timestamp", "actual_trips", is_finite("predicted_trips").alias("finite"))


@query
def model_reload_rows(spark, sf):
    """Hours that the saved and reloaded models score, and whether each forecast is the one of the model in memory, bit by bit."""
    both = final_predictions(spark, sf)[1]
    return both.select("model", "timestamp", "actual_trips", (F.col("before") == F.col("predicted")).alias("same"))


@query
def learned_ranker_predictions(spark, sf):
    base, ranked, _ = learned(spark, sf)
    return ranking_metrics.named_predictions(ranked, base)


@query
def learned_ranker_metrics(spark, sf):
    return learned(spark, sf)[2]


@query
def learned_ranking_hours(spark, sf):
    """Shape of the learned ranking of every test hour: its ranks, distinct zones, and zones that are candidates."""
    base, ranked, _ = learned(spark, sf)
    known = base.zones.select("fold", "PULocationID", F.lit(True).alias("known"))
    return ranked.join(known, ["fold", "PULocationID"], "left").groupBy(*ranking.HOUR_KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("PULocationID").alias("n_zones"),
        F.countDistinct("rank").alias("n_ranks"),
        F.max("rank").cast("bigint").alias("last_rank"),
        F.count("known").alias("n_candidates"),
        F.bool_and(is_finite("predicted_gross_passenger_spend")).alias("finite"),
    )


@query
def learned_metric_hours(spark, sf):
    """Test hours the learned ranker is scored on, and whether every score lies between 0 and 1."""
    within = F.lit(True)
    for name in METRICS:
        within &= F.col(name).between(0.0, 1.0 + 1e-9)
    return learned(spark, sf)[2].select(
        *ranking.HOUR_KEY, "day_of_week", "time_block", "day_type", within.alias("within")
    )


def gains(spark: SparkSession, sf: str) -> DataFrame:
    base, _, own = learned(spark, sf)
    return ranking_metrics.learned_gain(own, ranking_metrics.baseline_table(scope_metrics(base)))


@query
def learned_ranker_gain(spark, sf):
    return gains(spark, sf)


@query
def learned_gain_folds(spark, sf):
    """The baseline that the learned ranker is compared with at every grain, and whether the gain is the difference."""
    difference = F.col("ndcg_at_10") - F.col("best_baseline_score")
    return gains(spark, sf).select(
        "fold", "best_baseline", "best_baseline_score", (F.abs(F.col("gain") - difference) < 3e-6).alias("consistent")
    )


def validation(spark: SparkSession, sf: str) -> list[DataFrame]:
    base, ranked, own = learned(spark, sf)
    baselines = ranking_metrics.baseline_table(scope_metrics(base))
    predictions = ranking_metrics.named_predictions(ranked, base)
    return study.ranking_checks(base, own, predictions, baselines, STUDY)


@query
def ranking_validation(spark, sf):
    """Every check of the learned ranker, with the overall verdict."""
    return checks.verdict(validation(spark, sf))


@query
def ranking_validation_rows(spark, sf):
    """The checks of the learned ranker whose result does not depend on the fitted values."""
    return checks.verdict(validation(spark, sf)[:-1])


# ---------------------------------------------------------------- files


@query
def monthly_files(spark: SparkSession, sf: str) -> DataFrame:
    """Months written with differing types and fee spellings, read back as one frame."""
    root = f"{shared_dir(spark)}/months-{uuid.uuid4().hex}"
    testdata.write_months(spark, sf, root)
    trips = cleaning.standardize(files.scan_trips(spark, f"{root}/trips_*"))
    return trips.select("pickup_datetime", "dropoff_datetime", "passenger_count", "PULocationID", "DOLocationID", "airport_fee")


@query
def table_files(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly series and a lookup with NA texts, through their CSV files."""
    root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    sinks.write_clean_trips(trips(spark, sf), f"{root}/clean")
    clean = files.scan_clean_trips(spark, f"{root}/clean")
    sinks.write_table(kpis.hourly_timeseries(clean), f"{root}/hourly", ["pickup_date", F.desc("pickup_hour")])
    sinks.write_table(testdata.lookup_with_na(spark, sf), f"{root}/lookup")
    hourly = files.scan_hourly_series(spark, f"{root}/hourly")
    zones = files.scan_zone_lookup(spark, f"{root}/lookup")
    return hourly.join(zones, hourly["pickup_hour"] == zones["LocationID"], "left")


def queries() -> dict[str, Query]:
    names = {"headline_kpis": "kpis", "baseline_metrics": "ranking_metrics"}
    return {names.get(name, name): function for name, function in QUERIES.items()}
