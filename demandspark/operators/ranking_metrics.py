"""Actual relevance, NDCG, hit rate and precision of rankings, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.config import BASELINES, TOP_K, UNKNOWN
from demandspark.functions.columns import day_name, day_type, ratio, round_to, test_folds, time_block
from demandspark.operators.ranking import (
    EVERY_ZONE,
    GROUP,
    HOUR_KEY,
    RankingInput,
    Scope,
    ranking_groups,
    target_hours,
)


def actual_relevance(data: RankingInput, scopes: Sequence[Scope] = (EVERY_ZONE,)) -> DataFrame:
    """Gross spend per test hour and zone with its rank, for each relevance the scopes need."""
    day = F.col("pickup_date")
    tested = data.frame.select(
        "*", F.inline(test_folds(day, data.folds)), day.alias("test_date")
    ).groupBy(*HOUR_KEY, "PULocationID").agg(
        F.sum("gross_passenger_spend").alias("spend"),
        F.bool_or("is_airport").alias("is_airport"),
        F.min("pickup_zone").alias("pickup_zone"),
        F.min("pickup_borough").alias("pickup_borough"),
    )
    needed = list(dict.fromkeys(s.relevance for s in scopes))
    restricted = [s for s in scopes if s.airport is not None]
    if restricted:
        # Outside the airports only zones known from training count.
        known = data.zones.select("fold", "PULocationID", F.lit(True).alias("known"))
        tested = tested.join(known, ["fold", "PULocationID"], "left")
        conditions = {EVERY_ZONE.name: F.lit(True)}
        for s in restricted:
            conditions[s.name] = (
                F.col("is_airport") if s.airport else ~F.col("is_airport") & F.coalesce("known", F.lit(False))
            )
        labels = F.array(
            *[F.struct(F.lit(n).alias("relevance_scope"), conditions[n].alias("counts")) for n in needed]
        )
        tested = tested.select("*", F.inline(labels)).filter("counts").drop("known", "counts")
    else:
        tested = tested.withColumn("relevance_scope", F.lit(EVERY_ZONE.name))
    order = W.partitionBy("relevance_scope", *HOUR_KEY).orderBy(F.desc("spend"), "PULocationID")
    return tested.withColumn("actual_rank", F.row_number().over(order))


def _gain(relevance: str, rank: str, k: int) -> Column:
    gain = F.coalesce(F.col(relevance), F.lit(0.0)) / F.log2(F.col(rank) + 1.0)
    return F.coalesce(F.sum(F.when(F.col(rank) <= k, gain)), F.lit(0.0))


def ranking_metrics(
    ranking: DataFrame,
    data: RankingInput,
    scopes: Sequence[Scope] = (EVERY_ZONE,),
    baselines: Sequence[str] = BASELINES,
    ks: Sequence[int] = TOP_K,
) -> DataFrame:
    """One row per (fold, test hour, scope, ranker); all k in one aggregation.

    NDCG is NULL without relevance, hit rate without actual zones, precision without a ranking.
    """
    actual = actual_relevance(data, scopes)
    groups = ranking_groups(target_hours(data), scopes, baselines)
    relevance_of = {s.name: s.relevance for s in scopes}
    scope_map = F.create_map(*[F.lit(x) for pair in relevance_of.items() for x in pair])
    judged = ranking.withColumn("relevance_scope", scope_map[F.col("scope")]).join(
        actual.select("relevance_scope", *HOUR_KEY, "PULocationID", "spend", "actual_rank"),
        ["relevance_scope", *HOUR_KEY, "PULocationID"],
        "left",
    )
    scored = judged.groupBy(*GROUP).agg(
        *[_gain("spend", "rank", k).alias(f"_dcg_{k}") for k in ks],
        *[F.count_if((F.col("rank") <= k) & (F.col("actual_rank") <= k)).alias(f"_hits_{k}") for k in ks],
    )
    ideal = actual.groupBy("relevance_scope", *HOUR_KEY).agg(
        *[_gain("spend", "actual_rank", k).alias(f"_ideal_{k}") for k in ks]
    )
    joined = groups.join(scored, GROUP, "left").join(ideal, ["relevance_scope", *HOUR_KEY], "left")
    day, hour = F.col("test_date"), F.col("pickup_hour")
    metrics = {}
    for k in ks:
        hits, ideal_gain = F.col(f"_hits_{k}"), F.col(f"_ideal_{k}")
        gain = F.coalesce(F.col(f"_dcg_{k}"), F.lit(0.0))
        metrics[f"ndcg_at_{k}"] = ratio(gain, ideal_gain)
        found = (F.coalesce(hits, F.lit(0)) > 0).cast("double")
        metrics[f"hit_rate_at_{k}"] = F.when(ideal_gain.isNotNull(), found)
        metrics[f"precision_at_{k}"] = ratio(hits, F.lit(k))
    return joined.select(
        "fold",
        "test_date",
        "pickup_hour",
        day_name(day).alias("day_of_week"),
        "scope",
        "baseline",
        time_block(hour).alias("time_block"),
        day_type(day).alias("day_type"),
        *[value.alias(name) for name, value in metrics.items()],
    )


def baseline_table(metrics: DataFrame) -> DataFrame:
    return metrics.drop("scope")


def support_table(metrics: DataFrame, data: RankingInput, scopes: Sequence[Scope]) -> DataFrame:
    """Metrics of the support scopes with the share of candidates that reach the threshold."""
    counts = data.zones.groupBy("fold").agg(
        F.count(F.lit(1)).alias("candidate_zone_count"),
        *[F.count_if(F.col("total_trips") >= s.min_trips).alias(f"_{s.name}") for s in scopes],
    )
    supported = counts.select(
        "fold",
        "candidate_zone_count",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s.name).alias("scope"), F.col(f"_{s.name}").alias("supported_zone_count"))
                    for s in scopes
                ]
            )
        ),
    )
    coverage = ratio(F.col("supported_zone_count"), F.col("candidate_zone_count"))
    hit_rates = [c for c in metrics.columns if c.startswith("hit_rate")]
    return (
        metrics.drop(*hit_rates)
        .join(supported, ["fold", "scope"])
        .withColumns({"support_threshold": F.col("scope").cast("bigint"), "support_coverage": coverage})
        .drop("scope")
    )


def airport_table(metrics: DataFrame) -> DataFrame:
    hit_rates = [c for c in metrics.columns if c.startswith("hit_rate")]
    return metrics.drop(*hit_rates).withColumnRenamed("scope", "airport_group")


def named_predictions(ranking: DataFrame, data: RankingInput, k: int = max(TOP_K)) -> DataFrame:
    """The first k zones with what happened; names only from zones seen in that very hour."""
    actual = actual_relevance(data).select(
        *HOUR_KEY, "PULocationID", "pickup_zone", "pickup_borough", "spend", "actual_rank"
    )
    joined = ranking.join(actual, [*HOUR_KEY, "PULocationID"], "left")
    extra = ["predicted_gross_passenger_spend"] if "predicted_gross_passenger_spend" in ranking.columns else []
    return joined.select(
        "fold",
        "test_date",
        "pickup_hour",
        day_name(F.col("test_date")).alias("day_of_week"),
        "baseline",
        "rank",
        "PULocationID",
        F.coalesce("pickup_zone", F.lit(UNKNOWN)).alias("pickup_zone"),
        F.coalesce("pickup_borough", F.lit(UNKNOWN)).alias("pickup_borough"),
        *extra,
        F.coalesce("spend", F.lit(0.0)).alias("actual_gross_passenger_spend"),
        F.when(F.col("actual_rank") <= k, F.col("actual_rank")).alias("actual_rank_top20"),
    )


def summarize(metrics: DataFrame, keys: Sequence[str], measures: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean of each measure per group, missing values skipped."""
    return metrics.groupBy(*keys).agg(*[round_to(F.avg(m), digits).alias(m) for m in measures])


def summary_report(
    metrics: DataFrame, measures: Sequence[str] = ("ndcg_at_10", "precision_at_10"), digits: int = 4
) -> DataFrame:
    """Means by baseline, and by baseline with fold, time block and day type, in one aggregation."""
    grains = ("fold", "time_block", "day_type")
    sets = [["baseline"], *[["baseline", g] for g in grains]]
    grouped = metrics.groupingSets(sets, "baseline", *grains).agg(
        *[F.grouping(g).alias(f"_{g}_out") for g in grains],
        *[round_to(F.avg(m), digits).alias(m) for m in measures],
    )
    report, group = F.lit("baseline"), F.lit("all")
    for g in grains:
        is_grain = F.col(f"_{g}_out") == 0
        report = F.when(is_grain, g).otherwise(report)
        group = F.when(is_grain, F.col(g).cast("string")).otherwise(group)
    return grouped.select(report.alias("report"), group.alias("group"), "baseline", *measures)


def metric_pivot(
    metrics: DataFrame, row: str, column: str, values: Sequence, measure: str = "ndcg_at_10", digits: int = 6
) -> DataFrame:
    """Mean of one metric, wide."""
    wide = metrics.groupBy(row).pivot(column, list(values)).agg(round_to(F.avg(measure), digits))
    return wide


def time_block_gain(
    metrics: DataFrame,
    better: str = "zone_hour_profile",
    base: str = "global_popularity",
    measure: str = "ndcg_at_10",
) -> DataFrame:
    """How much ``better`` gains on ``base`` per time block."""

    def mean_of(name: str) -> Column:
        return F.avg(F.when(F.col("baseline") == name, F.col(measure)))

    return metrics.groupBy("time_block").agg(round_to(mean_of(better) - mean_of(base), 6).alias("gain"))


def gain_extremes(gains: DataFrame) -> DataFrame:
    return gains.agg(
        F.max_by("time_block", "gain").alias("largest_block"),
        F.max("gain").alias("largest_gain"),
        F.min_by("time_block", "gain").alias("smallest_block"),
        F.min("gain").alias("smallest_gain"),
    )


def _strongest(metrics: DataFrame, measure: str) -> DataFrame:
    means = metrics.groupBy("baseline").agg(F.avg(measure).alias("score"))
    return means.orderBy(F.desc_nulls_last("score"), "baseline").limit(1)


def best_ranker(metrics: DataFrame, measure: str = "ndcg_at_10") -> DataFrame:
    """The baseline with the highest mean; ties to the first name. Means are compared before they are rounded."""
    return _strongest(metrics, measure).withColumn("score", round_to(F.col("score"), 6))


def learned_gain(
    learned: DataFrame,
    baselines: DataFrame,
    measures: Sequence[str] = ("ndcg_at_5", "ndcg_at_10", "ndcg_at_20", "precision_at_10"),
    measure: str = "ndcg_at_10",
) -> DataFrame:
    """Learned ranker overall and per fold, with its gain on the baseline that is strongest overall, at the same grain."""
    name = _strongest(baselines, measure).select("baseline").scalar()
    own = learned.select("fold", *measures, F.lit(None).cast("double").alias("_base"))
    base = baselines.filter(F.col("baseline") == name)
    empty = [F.lit(None).cast("double").alias(m) for m in measures]
    both = own.unionByName(base.select("fold", *empty, F.col(measure).alias("_base")))
    grouped = both.groupingSets([[], ["fold"]], "fold").agg(
        *[F.avg(m).alias(m) for m in measures], F.avg("_base").alias("_base")
    )
    return grouped.filter(F.col(measure).isNotNull()).select(
        F.coalesce(F.col("fold").cast("string"), F.lit("all")).alias("fold"),
        *[round_to(F.col(m), 6).alias(m) for m in measures],
        name.alias("best_baseline"),
        round_to(F.col("_base"), 6).alias("best_baseline_score"),
        round_to(F.col(measure) - F.col("_base"), 6).alias("gain"),
    )


def heldout_hours(predictions: DataFrame, top: int = 10) -> DataFrame:
    """Model rank against actual rank within the saved rows of each hour (ties share a rank)."""
    hour = W.partitionBy(*HOUR_KEY, "baseline")
    spend = F.col("actual_gross_passenger_spend")
    ranked = predictions.withColumns(
        {
            "model_rank": F.row_number().over(hour.orderBy("rank")),
            "actual_rank": F.rank().over(hour.orderBy(F.desc("actual_gross_passenger_spend"))),
            "top_zone": F.first("pickup_zone").over(
                hour.orderBy(spend.desc(), "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            ),
        }
    )
    predicted = [c for c in predictions.columns if c == "predicted_gross_passenger_spend"]
    return ranked.filter(F.col("model_rank") <= top).select(
        *HOUR_KEY, "baseline", "model_rank", "pickup_zone", "pickup_borough", *predicted,
        "actual_gross_passenger_spend", "actual_rank", "top_zone",
    )
