"""The whole study on two months of made-up files."""

import random
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest

from helpers import as_dicts
from pyspark.sql import functions as F

from demandspark import schemas
from demandspark.config import StudyConfig, folds_from
from demandspark.operators import cleaning
from demandspark.plans import study
from demandspark.session import materialize
from demandspark.sources import files

READ = {}

CONFIG = StudyConfig(
    folds=folds_from([date(2025, 1, 24), date(2025, 2, 3)], days=2),
    support_thresholds=(50,),
    min_history_days=14,
    forecast_iterations=1,
    ranker_iterations=1,
)


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    rng = random.Random(5)
    names = [f.name for f in schemas.RAW_TRIPS.fields]
    for month, days in (("2025-01", 31), ("2025-02", 6)):
        rows = []
        for hour in range(24 * days):
            for _ in range(rng.randint(1, 4)):
                pickup = datetime.fromisoformat(f"{month}-01") + timedelta(hours=hour, minutes=rng.randint(0, 59))
                total = round(rng.uniform(5, 60), 2)
                trip = {
                    "tpep_pickup_datetime": pickup,
                    "tpep_dropoff_datetime": pickup + timedelta(minutes=rng.choice([0, 7, 12, 30])),
                    "trip_distance": round(rng.uniform(0.5, 9), 2),
                    "PULocationID": rng.choice([1, 2, 3, 132]),
                    "DOLocationID": 7,
                    "payment_type": rng.choice([1, 2]),
                    "fare_amount": total - 2,
                    "tip_amount": 1.0,
                    "total_amount": total,
                }
                rows.append(tuple(trip.get(n) for n in names))
        frame = spark.createDataFrame(rows, schemas.RAW_TRIPS).drop("Airport_fee")
        pq.write_table(frame.toArrow(), root / f"trips_{month}.parquet")
    (root / "lookup.csv").write_text(
        "LocationID,Borough,Zone\n1,Manhattan,Midtown\n2,Queens,Corona\n3,Bronx,NA\n132,Queens,JFK Airport\n"
    )
    out = root / "out"
    scan, seen = files.scan_trips, spark.sparkContext.accumulator(0)
    READ.update(raw=seen, rows=sum(pq.read_metadata(p).num_rows for p in root.glob("trips_*.parquet")))

    def counting(session, path):
        def count(zone):
            seen.add(1)
            return zone

        counted = F.udf(count, "long").asNondeterministic()
        return scan(session, path).withColumn("PULocationID", counted("PULocationID"))

    clean, cube = files.scan_clean_trips, study.measures.cube
    READ.update(clean=[], cubes=[])

    def noting(session, path):
        READ["clean"].append(path)
        return clean(session, path)

    def cubing(trips):
        READ["cubes"].append(trips)
        return cube(trips)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(files, "scan_trips", counting)
        patch.setattr(files, "scan_clean_trips", noting)
        patch.setattr(study.measures, "cube", cubing)
        study.run_study(spark, str(root / "trips_*.parquet"), str(root / "lookup.csv"), str(out), CONFIG)
    return out


def test_raw_files_are_read_once(spark, outputs):
    assert READ["raw"].value == READ["rows"]


def test_additive_tables_read_the_trips_once(spark, outputs):
    """One cube for all of them; no table of sums has a plan that reads the checked trips."""
    assert len(READ["cubes"]) == len(READ["clean"]) == 1
    trips = files.scan_clean_trips(spark, str(outputs / "checked_trips"))
    cube = materialize(study.measures.cube(trips), "cube")
    lookup = files.scan_zone_lookup(spark, str(outputs.parent / "lookup.csv"))
    for name, table in study.TABLES.items():
        if table.additive:
            inputs = table.build(cube, lookup, CONFIG).inputFiles()
            assert inputs and not any("checked_trips" in path for path in inputs), name
    assert [name for name, table in study.TABLES.items() if not table.additive] == ["kpis", "kpis_monthly"]


def test_audits_of_checked_trips_are_those_of_the_raw_files(spark, outputs):
    raw = cleaning.standardize(files.scan_trips(spark, str(outputs.parent / "trips_*.parquet")))
    flagged = cleaning.flag_trips(cleaning.with_study_month(raw), CONFIG.limits)
    checked = cleaning.checked_counts(files.scan_checked_trips(spark, str(outputs / "checked_trips")))
    expected = cleaning.audit_counts(flagged, CONFIG.limits)
    assert as_dicts(checked.select(expected.columns), "file") == as_dicts(expected, "file")
    assert all(r["balanced"] for r in cleaning.accounting_check(checked).collect())


def read(spark, outputs, name):
    return spark.read.option("header", True).option("inferSchema", True).csv(str(outputs / name))


def test_every_result_is_written(spark, outputs):
    expected = {
        *study.TABLES, "checked_trips", "quality_breakdown", "first_failure", "data_quality_summary",
        "forecast_predictions", "forecast_metrics", "models", "ranking_baseline_metrics",
        "ranking_support_threshold_metrics", "ranking_airport_metrics", "ranking_baseline_predictions",
        "ranking_summary", "ranking_learned_metrics", "ranking_learned_predictions", "ranking_validation",
        "zone_opportunity", "driver_opportunity",
    }
    assert {p.name for p in outputs.iterdir()} == expected
    for name in expected - {"models", "checked_trips", "zone_opportunity"}:
        assert read(spark, outputs, name).count() > 0, name


def test_totals_agree_between_results(spark, outputs):
    clean = files.scan_clean_trips(spark, str(outputs / "checked_trips")).count()
    summary = read(spark, outputs, "data_quality_summary").collect()
    assert len(summary) == 2 and sum(r["clean_trip_count"] for r in summary) == clean
    for name in ("kpis", "kpis_monthly", "hourly_timeseries", "zone_hour_timeseries", "zone_analysis",
                 "payment_analysis", "zone_hour_heatmap"):
        assert read(spark, outputs, name).agg({"trips": "sum"}).collect()[0][0] == clean, name


def test_results_are_sorted(spark, outputs):
    hours = [tuple(r)[:2] for r in read(spark, outputs, "hourly_timeseries").collect()]
    assert hours == sorted(hours)
    trips = [r["trips"] for r in read(spark, outputs, "zone_analysis").collect()]
    assert trips == sorted(trips, reverse=True)


def test_validation_covers_both_folds(spark, outputs):
    outcome = {r["check"]: r["passed"] for r in read(spark, outputs, "ranking_validation").collect()}
    sources = ("daily", "slot", "week", "trailing")
    expected = {
        "overall", "learned metrics has rows", "learned predictions has rows", "baseline metrics has rows",
        "exactly the configured folds", "target is not a model input", "required prediction columns",
        "predictions are finite", "learned ranker beats the best baseline", "features do not follow the target hour",
        *(f"train before test, fold {fold.number}" for fold in CONFIG.folds),
        *(f"{label} history precedes the target: {source}" for label in ("training", "test") for source in sources),
    }
    assert set(outcome) == expected
    assert all(passed for check, passed in outcome.items() if check not in ("overall", "learned ranker beats the best baseline"))


def test_named_tables_are_queryable_in_sql(spark, outputs, tmp_path):
    trips = files.scan_clean_trips(spark, str(outputs / "checked_trips"))
    lookup = files.scan_zone_lookup(spark, str(outputs.parent / "lookup.csv"))
    study.register_views(trips, lookup, CONFIG)
    busiest = spark.sql("SELECT pickup_zone FROM zone_analysis ORDER BY trips DESC LIMIT 1").collect()
    totals = spark.sql("SELECT sum(trips) FROM hourly_timeseries").collect()[0][0]
    assert len(busiest) == 1 and totals == trips.count()
