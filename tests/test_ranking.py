"""Baseline rankings, their metrics and the feature tables, against direct loops."""

import re
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from small_series import FIRST, FOLDS, Direct, make_rows, make_series

from demandspark.config import BASELINES, RANKER_INPUTS
from demandspark.operators import checks, features, ranking, ranking_metrics

SUPPORT = ranking.support_scopes([25, 10_000])
SCOPES = (ranking.EVERY_ZONE, *SUPPORT, *ranking.AIRPORT_SCOPES)
KS = (1, 3, 20)


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    rows = make_rows(request.param)
    data = ranking.ranking_input(make_series(spark, rows), FOLDS)
    return rows, data


@pytest.fixture(scope="module")
def direct(case):
    return {f.number: Direct(case[0], f) for f in FOLDS}


def ranked_zones(ranked):
    found = defaultdict(dict)
    for r in ranked.collect():
        found[(r["fold"], r["scope"], r["baseline"], r["test_date"], r["pickup_hour"])][r["rank"]] = r["PULocationID"]
    return {key: [zones[i] for i in sorted(zones)] for key, zones in found.items()}


@pytest.mark.parametrize("k", [2, 20])
def test_rankings(case, direct, k):
    found = ranked_zones(ranking.rank_baselines(case[1], SCOPES, k=k))
    expected = {
        (n, s.name, b, day, hour): d.ranking(s.name, b, day, hour, k)
        for n, d in direct.items()
        for s in SCOPES
        for b in BASELINES
        for day, hour in d.hours
    }
    assert found == {key: zones for key, zones in expected.items() if zones}
    assert any(not zones for zones in expected.values())  # a threshold nobody reaches


def test_observed_mean_variant(case, direct):
    found = ranked_zones(ranking.rank_baselines(case[1], k=4, variant="observed_mean"))
    for (fold, _, baseline, day, hour), zones in found.items():
        if baseline == "zone_hour_profile":
            assert zones == direct[fold].ranking("all", "observed_mean", day, hour, 4)


def test_metrics(case, direct):
    ranked = ranking.rank_baselines(case[1], SCOPES)
    table = ranking_metrics.ranking_metrics(ranked, case[1], SCOPES, ks=KS).collect()
    assert len(table) == sum(len(d.hours) for d in direct.values()) * len(SCOPES) * len(BASELINES)
    nulls = 0
    for r in table:
        d = direct[r["fold"]]
        key = (r["test_date"], r["pickup_hour"])
        order = d.ranking(r["scope"], r["baseline"], *key)
        relevance = d.relevance(r["scope"], *key)
        for k in KS:
            expected = d.metrics(order, relevance, k)
            found = (r[f"ndcg_at_{k}"], r[f"hit_rate_at_{k}"], r[f"precision_at_{k}"])
            assert found == pytest.approx(expected), (r, k)
            nulls += found[0] is None
            if found[0] is not None:
                assert -1e-9 <= found[0] <= 1 + 1e-9
    assert nulls  # an hour of zero spend


def test_perfect_ranking_scores_one(case):
    data = case[1]
    actual = ranking_metrics.actual_relevance(data).select(
        *ranking.HOUR_KEY, "PULocationID", F.col("actual_rank").alias("rank"),
        F.lit("all").alias("scope"), F.lit("oracle").alias("baseline"),
    )
    table = ranking_metrics.ranking_metrics(actual, data, baselines=("oracle",), ks=(3,))
    scores = {round(r[0], 9) for r in table.select("ndcg_at_3").collect() if r[0] is not None}
    assert scores == {1.0}


def test_support_coverage(case, direct):
    data = case[1]
    scored = ranking_metrics.ranking_metrics(ranking.rank_baselines(data, SUPPORT), data, SUPPORT)
    table = ranking_metrics.support_table(scored, data, SUPPORT)
    for r in table.select("fold", "support_threshold", "support_coverage", "candidate_zone_count").distinct().collect():
        d = direct[r["fold"]]
        supported = d.members(str(r["support_threshold"]))
        assert r["support_coverage"] == len(supported) / len(d.zones)
        assert r["candidate_zone_count"] == len(d.zones)
    assert not any(c.startswith("hit_rate") for c in table.columns)


def test_named_predictions(case, direct):
    data = case[1]
    rows = ranking_metrics.named_predictions(ranking.rank_baselines(data), data).collect()
    unknown = 0
    for r in rows:
        spend = direct[r["fold"]].relevance("all", r["test_date"], r["pickup_hour"])
        best = sorted(spend, key=lambda z: (-spend[z], z))[:20]
        zone = r["PULocationID"]
        assert r["actual_gross_passenger_spend"] == pytest.approx(spend.get(zone, 0.0))
        assert r["actual_rank_top20"] == (best.index(zone) + 1 if zone in best else None)
        assert (r["pickup_zone"] == "Unknown") == (zone not in spend)
        unknown += zone not in spend
    assert unknown
    shown = ranking_metrics.heldout_hours(ranking_metrics.named_predictions(ranking.rank_baselines(data), data), top=3)
    assert shown.filter("model_rank > 3 OR actual_rank < 1").count() == 0


def test_fold_without_rows_is_left_out(case):
    assert {r[0] for r in ranking.target_hours(case[1]).select("fold").distinct().collect()} == {1, 2}
    profile = {r["fold"]: (r["train_rows"], r["test_rows"]) for r in ranking.frame_profile(case[1]).collect()}
    assert profile[3][1] == 0 and profile[3][0] == len(case[0])


def test_summaries_skip_missing_metrics(spark):
    rows = [(1, "Morning", "Weekday", "a", 0.5), (1, "Morning", "Weekday", "a", None), (2, "Evening", "Weekend", "a", 0.7)]
    metrics = spark.createDataFrame(rows, "fold int, time_block string, day_type string, baseline string, ndcg_at_10 double")
    table = {(r["report"], r["group"]): r["ndcg_at_10"] for r in ranking_metrics.summary_report(metrics, ["ndcg_at_10"]).collect()}
    assert table[("baseline", "all")] == 0.6 and table[("fold", "1")] == 0.5 and table[("time_block", "Evening")] == 0.7
    assert len(table) == 7


# ---------------------------------------------------------------- features


def test_frozen_features(case, direct):
    rows = features.frozen_features(case[1]).collect()
    assert len(rows) == sum(len(d.hours) * len(d.zones) for d in direct.values())
    for r in rows:
        d = direct[r["fold"]]
        expected = d.frozen(r["test_date"], r["pickup_hour"], r["PULocationID"])
        assert {k: r[k] for k in expected} == pytest.approx(expected)
        assert r["is_airport"] == (r["PULocationID"] in d.airports)
        assert (r["hour"], r["day_of_week"]) == (r["pickup_hour"], r["test_date"].weekday())


def test_training_panel(case, direct):
    rows = features.training_panel(case[1], min_history_days=14).collect()
    start = min(r[0] for r in case[0]) + timedelta(days=14)
    size = 0
    for d in direct.values():
        size += len(d.zones) * len({r[:2] for r in d.train if r[0] >= start})
    assert len(rows) == size
    for r in rows:
        d = direct[r["fold"]]
        key = (r["pickup_date"], r["pickup_hour"], r["PULocationID"])
        expected = d.as_of(*key)
        assert {k: r[k] for k in expected} == pytest.approx(expected), key
        assert r["target_gross_spend"] == (d.cell[key][6] if key in d.cell else 0.0)


def test_own_hour_never_reaches_its_features(spark, case):
    """Change the spend of one hour: only its target and later rows may move."""
    day, hour = FIRST + timedelta(days=17), 9
    changed = [
        (*r[:5], r[5] + 50, r[6] + 1000.0, *r[7:]) if r[:2] == (day, hour) else r for r in case[0]
    ]
    assert changed != case[0]
    other = ranking.ranking_input(make_series(spark, changed), FOLDS)

    def table(data, keep):
        panel = features.training_panel(data, min_history_days=14).filter(F.col("fold") == 1)
        return sorted(tuple(r) for r in panel.filter(keep).select("PULocationID", "pickup_hour", *RANKER_INPUTS).collect())

    same_day = F.col("pickup_date") <= F.lit(day)
    assert table(case[1], same_day) == table(other, same_day)
    later = F.col("pickup_date") > F.lit(day)
    assert table(case[1], later) != table(other, later)


def leaking_panel(data, min_history_days):
    """A builder that lets a zone's own day into its history."""
    own = data.frame.groupBy("PULocationID", "pickup_date").agg(F.sum("gross_passenger_spend").alias("own"))
    panel = features.training_panel(data, min_history_days).join(own, ["PULocationID", "pickup_date"], "left")
    return panel.withColumn("historical_gross_spend", F.col("historical_gross_spend") + F.coalesce("own", F.lit(0.0)))


def test_perturbed_hours_find_a_planted_leak(spark, case):
    series = make_series(spark, case[0])
    moves = checks.feature_moves(series, FOLDS, "airport", 14)
    rows = moves.collect()
    assert [(r["fold"], r["features"]) for r in rows] == [(1, "training"), (1, "test"), (2, "training"), (2, "test"), (3, "training")]
    assert all(r["n_changed"] == 0 for r in rows) and all(r["n_later_changed"] > 0 for r in rows if r["features"] == "training" and r["fold"] < 3)
    assert checks.features_unmoved(moves).first()["passed"]
    leaks = checks.feature_moves(series, FOLDS[:1], "airport", 14, panel=leaking_panel)
    assert leaks.filter("features = 'training'").first()["n_changed"] > 0
    assert not checks.features_unmoved(leaks).first()["passed"]
    assert checks.feature_moves(series.limit(0), FOLDS, "airport", 14).count() == 0


def test_checks_hold(case):
    data = case[1]
    panel = features.training_panel(data, 14, with_history_date=True)
    frozen = features.frozen_features(data, with_history_date=True)
    found = checks.verdict(
        [
            checks.rows_present(panel, "panel"),
            checks.history_before_target(panel, "pickup_date", "training"),
            checks.history_before_target(frozen, "test_date", "test"),
            checks.target_not_an_input(panel),
        ]
    ).collect()
    assert all(r["passed"] for r in found) and found[-1]["check"] == "overall"


def test_checks_fail_when_they_should(spark, case):
    data = case[1]
    late = features.training_panel(data, 14, with_history_date=True).withColumns(
        {name: F.col("pickup_date") for name in features.HISTORY_DATES}
    )
    rows = spark.createDataFrame([(float("nan"),), (1.0,)], "predicted_gross_passenger_spend double")
    found = checks.verdict(
        [
            checks.history_before_target(late, "pickup_date", "training"),
            checks.predictions_finite(rows),
            checks.required_columns(rows),
            checks.target_not_an_input(rows, ["hour", "target_gross_spend"]),
            checks.folds_complete(data.zones, FOLDS[:1]),
            checks.splits_ordered(data),
        ]
    ).collect()
    outcome = {r["check"]: r["passed"] for r in found}
    assert outcome.pop("train before test, fold 1") and outcome.pop("train before test, fold 2")
    assert not any(outcome.values())  # fold 3 has no test rows
    assert found[-1]["detail"] == "9"


def test_learned_gain(spark):
    learned = spark.createDataFrame([(1, 0.9), (2, 0.7)], "fold int, ndcg_at_10 double")
    scores = [(1, "a", 0.5), (2, "a", 0.7), (1, "b", 0.5), (2, "b", 0.6999998)]  # equal once rounded
    base = spark.createDataFrame(scores, "fold int, baseline string, ndcg_at_10 double")
    gains = ranking_metrics.learned_gain(learned, base, measures=["ndcg_at_10"])
    found = {r["fold"]: r for r in gains.collect()}
    assert found["all"]["best_baseline"] == "a" and found["all"]["gain"] == pytest.approx(0.2)
    assert found["1"]["gain"] == pytest.approx(0.4) and found["2"]["gain"] == pytest.approx(0.0)
    assert checks.beats_baselines(learned, base).collect()[0]["passed"]


@pytest.mark.parametrize("build", [features.training_panel, features.frozen_features])
def test_dense_rows_are_made_last(case, build):
    """Nothing above the generators of days and hours sorts, groups or joins, so a task holds no dense rows."""
    text = build(case[1])._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"^ *\+- (?:\*\(\d+\) )?(\w+)", text, re.MULTILINE)
    held = next(n for n, node in enumerate(nodes) if re.search("Aggregate|Window|Sort|Join|Exchange", node))
    assert nodes[:held].count("Generate") >= 2


def test_moves_build_each_side_once(spark):
    """Counted and compared in one join: rows that differ, lack a partner or hold a missing value count as changed."""
    rows = spark.range(6).select(F.col("id").alias("k"), F.when(F.col("id") != 5, F.col("id") * 1.0).alias("v"))
    moved = rows.filter("k <> 3").withColumn("v", F.col("v") + F.when(F.col("k") == 1, 1.0).otherwise(0.0))
    moves = checks._changed(rows, moved, ["k"], ["v"], F.col("k") < 3)
    assert moves.columns == ["n_rows", "n_changed", "n_later", "n_later_changed"]
    assert tuple(moves.first()) == (3, 1, 3, 2)
    assert moves._jdf.queryExecution().executedPlan().toString().count("Range (") == 2


def test_moves_keep_dense_rows_off_the_driver(spark):
    """Rows of zeros shrink in shuffle files to less than a broadcast may have; neither side is sent through the driver."""
    rows = spark.range(200_000).select((F.col("id") % 2000).alias("zone"), F.col("id").alias("hour"), F.lit(0.0).alias("v"))
    moves = checks._changed(rows.repartition("zone"), rows.repartition("zone"), ["zone", "hour"], ["v"], F.col("hour") < 100)
    assert tuple(moves.first()) == (100, 0, 199_900, 0)
    moves.collect()
    text = moves._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in text and "SortMergeJoin" in text
