"""Cleaning rules, audit tables and the file sources they start from."""

import itertools
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest
from helpers import as_dicts
from pyspark.sql import functions as F

from demandspark import schemas
from demandspark.config import CleaningLimits
from demandspark.functions.columns import round_to
from demandspark.operators import cleaning
from demandspark.sources import files, sinks

GOOD = {
    "pickup_datetime": datetime(2025, 1, 10, 9, 30),
    "dropoff_datetime": datetime(2025, 1, 10, 9, 50),
    "trip_distance": 3.0,
    "PULocationID": 1,
    "DOLocationID": 2,
    "fare_amount": 20.0,
    "tip_amount": 4.0,
    "total_amount": 30.0,
}
SCHEMA = (
    "case string, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, trip_distance double, "
    "PULocationID bigint, DOLocationID bigint, fare_amount double, tip_amount double, total_amount double"
)


def minutes(n):
    return {"dropoff_datetime": GOOD["pickup_datetime"] + timedelta(minutes=n)}


CASES = {
    "good": ({}, "valid"),
    "no_dropoff": ({"dropoff_datetime": None}, "missing_dropoff_datetime"),
    "no_pickup_zone": ({"PULocationID": None}, "missing_location"),
    "no_dropoff_zone": ({"DOLocationID": None}, "missing_location"),
    "zero_minutes": (minutes(0), "zero_or_negative_duration"),
    "negative_minutes": (minutes(-5), "zero_or_negative_duration"),
    "half_minute": (minutes(0.5), "short_duration_under_1_min"),
    "one_minute": (minutes(1), "valid"),
    "three_hours": (minutes(180), "valid"),
    "over_three_hours": (minutes(180.5), "long_duration_over_180_min"),
    "zero_miles": ({"trip_distance": 0.0}, "zero_distance"),
    "negative_miles": ({"trip_distance": -1.0}, "zero_distance"),
    "hundred_miles": ({"trip_distance": 100.0}, "valid"),
    "over_hundred_miles": ({"trip_distance": 100.1}, "distance_over_100_miles"),
    "missing_miles": ({"trip_distance": None}, "valid"),
    "nan_miles": ({"trip_distance": float("nan")}, "valid"),
    "zero_fare": ({"fare_amount": 0.0}, "valid"),
    "negative_fare": ({"fare_amount": -1.0}, "negative_fare"),
    "large_fare": ({"fare_amount": 500.5}, "fare_over_500"),
    "nan_fare": ({"fare_amount": float("nan")}, "valid"),
    "negative_total": ({"total_amount": -0.5}, "negative_total_amount"),
    "large_total": ({"total_amount": 1000.5}, "total_amount_over_1000"),
    "missing_total": ({"total_amount": None}, "valid"),
    "two_rules": ({"trip_distance": 0.0, "fare_amount": -3.0, "total_amount": -3.0}, "zero_distance"),
    "before_month": ({"pickup_datetime": datetime(2024, 12, 31, 23, 59)}, None),
    "at_month_start": (
        {"pickup_datetime": datetime(2025, 1, 1), "dropoff_datetime": datetime(2025, 1, 1, 0, 10)},
        "valid",
    ),
    "at_next_month": (
        {"pickup_datetime": datetime(2025, 2, 1), "dropoff_datetime": datetime(2025, 2, 1, 0, 10)},
        None,
    ),
    "no_pickup": ({"pickup_datetime": None}, None),
}


@pytest.fixture(scope="module")
def flagged(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple({"case": c, **GOOD, **change}[n] for n in names) for c, (change, _) in CASES.items()]
    raw = spark.createDataFrame(rows, SCHEMA).withColumn("file", F.lit("trips_2025-01.parquet"))
    return cleaning.flag_trips(cleaning.with_study_month(cleaning.standardize(raw)))


def test_first_failing_rule_of_every_case(flagged):
    found = {r["case"]: r["first_failing_rule"] for r in flagged.collect()}
    assert found == {case: rule for case, (_, rule) in CASES.items()}


def test_month_and_window_agree(spark, flagged):
    base = flagged.drop("in_study_period", "first_failing_rule", "trip_duration_min")
    window = cleaning.with_study_window(base, date(2025, 1, 1), date(2025, 2, 1))
    by_window = {r["case"]: bool(r["in_study_period"]) for r in window.collect()}
    by_month = {r["case"]: bool(r["in_study_period"]) for r in flagged.collect()}
    assert by_window == by_month


def test_valid_trip_is_the_complement_of_all_rules(spark):
    values = itertools.product(
        [None, -1.0, 0.0, 0.5, 1.0, 180.0, 181.0], [None, -1.0, 0.0, 100.0, 101.0], [None, -1.0, 0.0, 500.0, 501.0],
        [None, -1.0, 0.0, 1000.0, 1001.0], [None, 1], [True, False],
    )
    frame = spark.createDataFrame(
        [(m, d, f, t, z, datetime(2025, 1, 1) if ok else None) for m, d, f, t, z, ok in values],
        "trip_duration_min double, trip_distance double, fare_amount double, total_amount double, "
        "PULocationID int, dropoff_datetime timestamp_ntz",
    ).withColumn("DOLocationID", F.lit(1))
    for limits in (CleaningLimits(), CleaningLimits(min_minutes=0.0, max_total=700.0)):
        failing = F.array_max(F.array(*cleaning.quality_rules(limits).values()))
        assert frame.filter(cleaning.valid_trip(limits) == failing).count() == 0


def test_clean_columns(flagged):
    rows = {r["case"]: r for r in cleaning.clean_trips(flagged).collect()}
    assert set(rows) == {case for case, (_, rule) in CASES.items() if rule == "valid"}
    good = rows["good"]
    assert (good["hour"], good["day_of_week"], good["day_of_week_num"], good["month"]) == (9, "Friday", 4, 1)
    assert good["date"] == datetime(2025, 1, 10) and good["is_weekend"] is False
    assert good["trip_duration_min"] == 20.0 and good["revenue_per_mile"] == 10.0 and good["tip_rate"] == 0.2
    assert rows["zero_fare"]["tip_rate"] is None and rows["nan_miles"]["revenue_per_mile"] is None


def test_audits_reconcile(flagged):
    counts = cleaning.audit_counts(flagged)
    summary = counts.transform(cleaning.quality_summary).collect()[0]
    in_period = [rule for _, rule in CASES.values() if rule]
    valid = in_period.count("valid")
    assert summary["raw_trip_count"] == len(CASES)
    assert summary["out_of_period_count"] == len(CASES) - len(in_period)
    assert summary["clean_trip_count"] == valid
    assert summary["total_excluded_trip_count"] == len(CASES) - valid
    assert summary["excluded_pct"] == round((len(CASES) - valid) / len(CASES) * 100, 2)

    first = {r["first_failing_rule"]: r["records"] for r in cleaning.first_failure(counts).collect()}
    assert first == {rule: in_period.count(rule) for rule in set(in_period)}
    breakdown = {r["rule"]: r["excluded_records"] for r in cleaning.quality_breakdown(counts).collect()}
    assert len(breakdown) == 11
    assert breakdown["negative_fare"] == 2 and first["negative_fare"] == 1  # overlapping rules
    assert sum(breakdown.values()) >= sum(n for rule, n in first.items() if rule != "valid")
    assert cleaning.accounting_check(counts).collect()[0]["balanced"] is True


def test_breakdown_of_a_file_without_period_rows(spark, flagged):
    outside = flagged.filter(~F.col("in_study_period"))
    rows = cleaning.quality_breakdown(cleaning.audit_counts(outside)).collect()
    assert {(r["excluded_records"], r["pct_of_study_period_records"]) for r in rows} == {(0, 0.0)}
    assert cleaning.first_failure(cleaning.audit_counts(outside)).count() == 0


def _raw(spark, rows, fees):
    schema = "tpep_pickup_datetime string, tpep_dropoff_datetime timestamp_ntz, trip_distance double, extra int"
    schema += "".join(f", {fee} double" for fee in fees)
    return spark.createDataFrame(rows, schema)


def test_monthly_files_with_different_schemas(spark, tmp_path):
    """Fee spelled either way, both, or missing; text timestamps; a column outside the allow-list."""
    stop = datetime(2025, 1, 2, 10, 20)
    for name, rows, fees in (
        ("trips_2025-01.parquet", [("2025-01-02 10:00:00", stop, 1.0, 7, 1.5)], ["airport_fee"]),
        ("trips_2025-02.parquet", [("2025-02-02 10:00:00", stop, 1.0, 7, 2.5)], ["Airport_fee"]),
        (
            "trips_2025-03.parquet",
            [("2025-03-02 10:00:00", stop, 1.0, 7, None, 3.5), ("not a time", stop, 1.0, 7, 4.5, 9.0)],
            ["airport_fee", "Airport_fee"],
        ),
        ("trips_2025-04.parquet", [("2025-04-02 10:00:00", stop, 1.0, 7)], []),
    ):
        pq.write_table(_raw(spark, rows, fees).toArrow(), tmp_path / name)
    raw = files.scan_trips(spark, str(tmp_path / "trips_*.parquet"))
    assert "extra" not in raw.columns and {"airport_fee", "Airport_fee"} <= set(raw.columns)
    standard = cleaning.with_study_month(cleaning.standardize(raw))
    assert "Airport_fee" not in standard.columns
    rows = as_dicts(standard, "file", "airport_fee")
    assert [r["airport_fee"] for r in rows] == [1.5, 2.5, 3.5, 4.5, None]
    assert [r["in_study_period"] for r in rows] == [True, True, True, None, True]
    assert rows[3]["pickup_datetime"] is None


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|Path does not exist"):
        files.scan_trips(spark, str(tmp_path / "nothing_*.parquet"))


def test_zone_lookup_keeps_na_texts(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_text('LocationID,Borough,Zone\n1,EWR,"Newark Airport"\n57,N/A,NA\n58,,Somewhere\n')
    rows = as_dicts(files.scan_zone_lookup(spark, str(path)), "LocationID")
    assert [(r["Borough"], r["Zone"]) for r in rows] == [
        ("EWR", "Newark Airport"), ("N/A", "NA"), (None, "Somewhere"),
    ]


def test_clean_sink_partitions_by_month_and_replaces(spark, flagged, tmp_path):
    out = str(tmp_path / "clean")
    clean = cleaning.clean_trips(flagged)
    sinks.write_clean_trips(clean, out)
    sinks.write_clean_trips(clean, out)
    back = files.scan_clean_trips(spark, out)
    assert back.count() == clean.count()
    assert [r[0] for r in back.select("study_month").distinct().collect()] == ["2025-01"]


def test_table_sink_round_trip(spark, tmp_path):
    rows = [(date(2025, 1, 2), 3, 5), (date(2025, 1, 1), 23, 2)]
    frame = spark.createDataFrame(rows, schemas.HOURLY_SERIES)
    sinks.write_table(frame, str(tmp_path / "t"), ["pickup_date"])
    assert [tuple(r) for r in files.scan_hourly_series(spark, str(tmp_path / "t")).collect()] == rows[::-1]


def test_monthly_files_with_different_widths(spark, tmp_path):
    """INT32, INT64 and DOUBLE in the same column of different months; the result has the declared types."""
    for month, (count, zone) in enumerate([("int", "int"), ("bigint", "bigint"), ("double", "bigint"), ("string", "double")], 1):
        row = spark.sql(f"SELECT CAST({month} AS {count}) AS passenger_count, CAST(7 AS {zone}) AS PULocationID, 1.5D AS fare_amount")
        pq.write_table(row.toArrow(), tmp_path / f"trips_2025-0{month}.parquet")
    for sensitive in ("true", "false"):
        spark.conf.set("spark.sql.caseSensitive", sensitive)
        raw = files.scan_trips(spark, str(tmp_path / "trips_*.parquet"))
        assert dict(raw.dtypes) == {"passenger_count": "double", "PULocationID": "bigint", "fare_amount": "double", "file": "string"}
        rows = as_dicts(raw, "file")
        assert [r["passenger_count"] for r in rows] == [1.0, 2.0, 3.0, 4.0]
        assert {r["PULocationID"] for r in rows} == {7}


def test_rounding_does_not_lift_values_below_a_tie(spark):
    rows = spark.createDataFrame([(2.67499996,), (0.12499997,), (10.00499999,), (-2.5,), (0.125,)], "x double")
    found = [r[0] for r in rows.select(round_to(F.col("x"), 2)).collect()]
    assert found == [2.67, 0.12, 10.0, -2.5, 0.13]


def test_footers_of_many_files_take_as_few_jobs_as_of_few(spark, tmp_path):
    def jobs(count, root):
        kinds = ("int", "long")
        for kind in kinds:
            spark.range(count).select(F.col("id").cast(kind).alias("PULocationID")).repartition(count // 2).write.parquet(str(root / kind))
        names = sorted(f"file://{p}" for p in root.glob("*/*.parquet"))
        group = f"footers-{count}"
        spark.sparkContext.setJobGroup(group, group)
        found = files.files_by_schema(spark, names)
        ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sorted(same for _, group_ in found for same in group_) == names
        assert sorted(schema["PULocationID"].dataType.simpleString() for schema, _ in found) == ["bigint", "int"]
        return ran

    few, many = tmp_path / "few", tmp_path / "many"
    assert jobs(200, many) == jobs(8, few) <= 6


def test_footers_that_tasks_cannot_read(spark, tmp_path, monkeypatch):
    spark.range(4).select(F.col("id").alias("PULocationID")).repartition(2).write.parquet(str(tmp_path / "a"))
    names = sorted(f"file://{p}" for p in (tmp_path / "a").glob("*.parquet"))

    def unknown(batches):
        import pyarrow as pa

        for batch in batches:
            none = pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), none], names=["name", "footer"])

    monkeypatch.setattr(files, "_footers", unknown)
    assert [same for _, same in files.files_by_schema(spark, names)] == [names]


def test_a_month_is_replaced_whole_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "months")
    month = F.col("m")

    def written(rows, **how):
        sinks.write_months(spark.createDataFrame(rows, "m string, v int").repartition(4), path, month, **how)
        return sorted((r["m"], r["v"]) for r in spark.read.parquet(path).collect())

    rows = [(f"m{i % 3}", i) for i in range(60)]
    assert written(rows) == sorted(rows)
    assert len(list((tmp_path / "months").glob("study_month=m0/*.parquet"))) == 1  # rebalanced
    kept = [r for r in rows if r[0] != "m1"]
    assert written([("m1", 100)], replace="months") == sorted([*kept, ("m1", 100)])
    assert written([("m9", 1)]) == [("m9", 1)]
    with pytest.raises(ValueError):
        written([("m9", 1)], replace="some")


def test_checked_trips_hold_every_rule(spark):
    """Bits of the failed rules give the counters of the direct audit, also for rows that fail several rules."""
    rows = [("2025-01-05 10:00:00", "2025-01-05 10:20:00", 1.0, 1, 2, 10.0, 12.0), ("2025-01-05 10:00:00", None, -1.0, None, 2, -5.0, 2000.0),
            ("2025-01-05 10:00:00", "2025-01-05 09:00:00", 500.0, 1, 2, 600.0, -1.0), ("2024-12-31 23:00:00", "2025-01-01 00:10:00", 1.0, 1, 2, 5.0, 6.0),
            (None, None, None, None, None, None, None)]
    names = "a string, b string, trip_distance double, PULocationID long, DOLocationID long, fare_amount double, total_amount double"
    frame = spark.createDataFrame(rows, names).select(
        F.to_timestamp_ntz("a").alias("pickup_datetime"), F.to_timestamp_ntz("b").alias("dropoff_datetime"), "trip_distance", "PULocationID",
        "DOLocationID", "fare_amount", F.lit(0.0).alias("tip_amount"), "total_amount", F.lit("trips_2025-01.parquet").alias("file"),
    )
    flagged = cleaning.flag_trips(cleaning.with_study_month(frame))
    checked = cleaning.checked_trips(flagged)
    expected = cleaning.audit_counts(flagged)
    assert as_dicts(cleaning.checked_counts(checked).select(expected.columns)) == as_dicts(expected)
    valid = cleaning.valid_of(checked).drop("study_month")
    assert as_dicts(valid) == as_dicts(cleaning.clean_trips(flagged).select(valid.columns))
    assert {r["study_month"] for r in checked.collect()} == {"2025-01"}
