"""Aggregates, medians and reports against small hand-made or brute-force results."""

import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from helpers import as_dicts
from pyspark.sql import functions as F

from demandspark import schemas
from demandspark.functions.columns import round_to, time_block
from demandspark.operators import kpis, opportunity
from demandspark.operators.medians import exact_medians

FRIDAY = datetime(2025, 1, 3)
LOOKUP = [(1, "Manhattan", "Midtown"), (2, "Queens", "JFK AIRport"), (3, "Queens", "Corona"), (4, "Queens", "Corona"),
          (264, "N/A", "NA"), (265, None, None)]


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame(LOOKUP, schemas.ZONE_LOOKUP)


@pytest.fixture(scope="module")
def trips(spark):
    def trip(day, hour, zone, total=10.0, fare=8.0, tip=2.0, payment=1, miles=2.0, mins=10.0, fee=0.0):
        pickup = FRIDAY + timedelta(days=day, hours=hour, minutes=59)
        return (pickup, zone, total, fare, tip, payment, miles, mins, fee)

    rows = [
        trip(0, 23, 1), trip(0, 23, 1, total=20.0), trip(0, 23, 3), trip(0, 23, 4),
        trip(3, 23, 1, payment=2, fee=0.75), trip(3, 5, 3, payment=2, tip=0.0, fee=None),
        trip(1, 0, 1, payment=3), trip(2, 0, 2, total=50.0), trip(2, 1, 264), trip(2, 1, 265), trip(2, 1, 99),
    ]
    frame = spark.createDataFrame(
        rows,
        "pickup_datetime timestamp_ntz, PULocationID bigint, total_amount double, fare_amount double, "
        "tip_amount double, payment_type bigint, trip_distance double, trip_duration_min double, "
        "cbd_congestion_fee double",
    )
    return frame.withColumns(
        {
            "is_weekend": F.weekday("pickup_datetime") >= 5,
            "month": F.month("pickup_datetime"),
            "tip_rate": F.col("tip_amount") / F.col("fare_amount"),
        }
    )


@pytest.mark.parametrize("seed", range(4))
def test_exact_medians_match_the_definition(spark, seed):
    rng = random.Random(seed)
    values = [
        (rng.choice("ab"), rng.choice([None, 0.0, 1.0, 1.5, -3.25, rng.uniform(-50, 900), rng.uniform(3, 3.001)]))
        for _ in range(rng.choice([7, 60, 301]))
    ]
    values += [(None, 4.0), ("only null", None)]
    frame = spark.createDataFrame(values, "k string, v double")
    found = {r["k"]: r["m"] for r in exact_medians(frame, ["k"], {"m": "v"}).collect()}
    expected = {}
    for key in {k for k, v in values if v is not None}:
        expected[key] = statistics.median(v for k, v in values if k == key and v is not None)
    assert found == pytest.approx(expected)


def test_kpis(trips):
    row = kpis.kpis(trips).collect()[0]
    assert (row["trips"], row["active_days"]) == (11, 4)
    assert row["gross_passenger_spend"] == 160.0 and row["median_gross_spend_per_trip"] == 10.0
    assert row["gross_spend_per_mile"] == round(160 / 22, 2)
    assert row["card_tip_rate"] == 0.25


def test_kpis_of_nothing(trips):
    row = kpis.kpis(trips.filter("false")).collect()[0]
    assert row["trips"] == 0 and row["median_gross_spend_per_trip"] is None and row["card_tip_rate"] is None


def test_monthly_kpis_ignore_missing_fees(trips):
    row = kpis.kpis_monthly(trips).collect()[0]
    assert row["trips_per_day"] == 3.0  # 11 trips on 4 days
    assert row["share_with_cbd_fee"] == 0.1  # one of the ten known fees


def test_filtered_mean_is_null_without_card_trips(trips):
    rates = {r["payment_type"]: r["avg_card_tip_rate"] for r in kpis.payment_analysis(trips).collect()}
    assert rates == {1: 0.25, 2: None, 3: None}


def test_day_type_boundaries_and_in_group_days(trips):
    rows = {(r["pickup_hour"], r["day_type"]): r["avg_daily_trips"] for r in kpis.hourly_profile(trips).collect()}
    assert rows[(23, "Weekday")] == 2.5 and rows[(5, "Weekday")] == 1.0
    assert rows[(0, "Weekend")] == 1.0 and (0, "Weekday") not in rows


def test_two_average_daily_trips_differ(trips, lookup):
    """One counts the dates seen in the group, the other every date of the day type."""
    demand = {
        (r["pickup_hour"], r["pickup_zone"]): r["avg_daily_trips"]
        for r in kpis.hourly_demand(trips, lookup).filter("day_type = 'Weekday'").collect()
    }
    profile = {
        (r["hour"], r["PULocationID"]): r["avg_daily_trips"]
        for r in kpis.zone_hour_profile(trips, lookup).filter("day_type = 'Weekday'").collect()
    }
    assert demand[(5, "Corona")] == 1.0 and profile[(5, 3)] == 0.5
    assert demand[(23, "Corona")] == 2.0  # two ids of one name on one date
    assert profile[(23, 3)] == 0.5 and profile[(23, 4)] == 0.5


def test_zone_names(trips, lookup):
    rows = {r["PULocationID"]: (r["pickup_zone"], r["pickup_borough"]) for r in kpis.zone_analysis(trips, lookup).collect()}
    assert rows[264] == ("Unknown", "Unknown") and rows[265] == ("Outside NYC", "Unknown")
    assert rows[99] == ("Unknown", "Unknown") and rows[2] == ("JFK AIRport", "Queens")
    raw = {(r["pickup_borough"], r["pickup_zone"]) for r in kpis.zone_hour_heatmap(trips, lookup).collect()}
    assert ("N/A", "NA") in raw and (None, None) in raw


@pytest.mark.parametrize("sizes", [[5, 5, 5, 5], [100, 1, 1], [8, 1, 1], [7, 7, 3, 3, 3, 1, 1, 1, 1, 1, 1, 1], [4]])
def test_pareto_counts_zones_one_by_one(spark, sizes):
    zones = spark.createDataFrame(list(enumerate(sizes)), "PULocationID bigint, trips bigint")
    row = kpis.pareto_zones(zones, top=2).collect()[0]
    ordered, running, below = sorted(sizes, reverse=True), 0, 0
    for size in ordered:
        running += size
        below += running / sum(sizes) < 0.8
    assert row["zones_for_share"] == below + 1
    assert row["top_zones_share"] == pytest.approx(sum(ordered[:2]) / sum(sizes), abs=1e-6)


def test_exclusion_reports(spark):
    rows = [
        ("t_2025-01.parquet", "valid", 90), ("t_2025-01.parquet", "zero_distance", 6),
        ("t_2025-01.parquet", "zero_or_negative_duration", 3), ("t_2025-02.parquet", "zero_or_negative_duration", 1),
    ]
    failures = spark.createDataFrame(rows, "file string, first_failing_rule string, records bigint")
    pivot = as_dicts(kpis.exclusion_pivot(failures, ["2025-01", "2025-02"]), "first_failing_rule")
    assert [(r["rule_share"], r["2025-01"], r["2025-02"]) for r in pivot] == [(0.6, 6, 0), (0.4, 3, 1)]
    assert tuple(kpis.exclusion_trend(failures).collect()[0]) == (3, 1)
    assert tuple(kpis.exclusion_trend(failures, "zero_distance").collect()[0]) == (6, 0)  # silent in the last month
    later = failures.unionByName(spark.createDataFrame([("t_2031-07.parquet", "zero_distance", 2)], failures.schema))
    pivot = as_dicts(kpis.exclusion_pivot(later), "first_failing_rule")
    assert [(r["2025-01"], r["2025-02"], r["2031-07"]) for r in pivot] == [(6, 0, 2), (3, 1, 0)]


def test_growth_uses_first_and_last_month(spark):
    monthly = spark.createDataFrame([(3, 120.0), (1, 100.0), (2, 50.0)], "month int, trips_per_day double")
    assert tuple(kpis.monthly_growth(monthly).collect()[0]) == (100.0, 120.0, 0.2)


def test_rounding_is_half_away_from_zero(spark):
    values = [0.125, 2.5, -2.5, 0.285, 1.005, 2.675, 1e9 + 0.125, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in frame.select(round_to(F.col("v"), 2)).collect()]
    assert found[:3] == [0.13, 2.5, -2.5] and found[6] == 1e9 + 0.13 and found[7] is None


def test_time_blocks_cover_the_day(spark):
    blocks = [r[0] for r in spark.range(24).orderBy("id").select(time_block(F.col("id"))).collect()]
    assert blocks == (
        ["Overnight"] * 6 + ["Morning"] * 4 + ["Midday"] * 6 + ["Evening"] * 5 + ["Late evening"] * 3
    )


def _profile(spark, rows):
    return spark.createDataFrame(
        [(18, "Weekday", *row, "Queens") for row in rows],
        "hour int, day_type string, PULocationID bigint, pickup_zone string, avg_daily_trips double, pickup_borough string",
    )


def test_driver_opportunity(spark):
    profile = _profile(spark, [(1, "A", 10.0), (2, "B", 0.0), (3, "C", 5.0), (4, "An AIRPORT", 50.0), (5, "new", 4.0)])
    zones = spark.createDataFrame(
        [(1, 9, 1.0), (2, 9, 1.0), (3, 9, 4.0), (4, 9, 9.0)],
        "PULocationID bigint, trips bigint, avg_gross_spend_per_trip double",
    )
    ranked = opportunity.driver_opportunity(profile, zones, exclude_airports=True).collect()
    scores = {(r["objective"], r["PULocationID"]): r["opportunity_score"] for r in ranked}
    assert scores[("More trips", 1)] == pytest.approx(0.75 * 1 + 0.25 * 0.5)
    assert scores[("Higher-value trips", 3)] == pytest.approx(0.25 * 0.5 + 0.75 * 1)
    assert scores[("Balanced", 2)] == 0.0 and scores[("Balanced", 5)] is None
    last = [r["PULocationID"] for r in ranked if r["objective"] == "Balanced" and r["rank"] == 4]
    assert last == [5] and not any(r["PULocationID"] == 4 for r in ranked)


def test_equal_scores_normalise_to_one(spark):
    profile = _profile(spark, [(1, "A", 3.0), (2, "B", 3.0)])
    zones = spark.createDataFrame(
        [(1, 5, 2.0), (2, 5, 2.0)], "PULocationID bigint, trips bigint, avg_gross_spend_per_trip double"
    )
    scores = {r["opportunity_score"] for r in opportunity.driver_opportunity(profile, zones).collect()}
    assert scores == {1.0}


def test_zone_opportunity_needs_known_busy_zones(spark):
    profile = _profile(spark, [(1, "A", 3.0), (2, "B", 9.0), (3, "C", 9.0)])
    zones = spark.createDataFrame(
        [(1, 2000, 2.0), (2, 10, 2.0)], "PULocationID bigint, trips bigint, avg_gross_spend_per_trip double"
    )
    rows = opportunity.zone_opportunity(profile, zones).collect()
    assert [(r["PULocationID"], r["opportunity_score"], r["rank"]) for r in rows] == [(1, 6.0, 1)]


def test_date_measures(trips):
    rows = as_dicts(kpis.daily_trips_revenue(trips), "pickup_date")
    assert rows[0] == {"pickup_date": date(2025, 1, 3), "trips": 4, "revenue": 50.0}
    heat = {r["hour"]: r for r in kpis.hour_dow_heatmap(trips).collect()}
    assert heat[23]["Friday"] == 4 and heat[23]["Monday"] == 1 and heat[0]["Sunday"] == 1
