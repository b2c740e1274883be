"""The hourly stream against one batch aggregation over the same trips."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import as_dicts

from demandspark.operators import measures
from demandspark.streaming import hourly

SCHEMA = (
    "pickup_datetime timestamp_ntz, PULocationID long, payment_type long, trip_distance double, trip_duration_min double, "
    "total_amount double, fare_amount double, tip_amount double, tip_rate double"
)
KEY = ("pickup_date", "pickup_hour", "PULocationID")
START = datetime(2025, 3, 1)


def make_trips(seed, days, count):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        at = START + timedelta(days=rng.choice(days), minutes=rng.randint(0, 1439))
        value = rng.choice([None, float(rng.randint(1, 50))])
        rows.append((at, rng.choice([1, 2, 3]), 1, value, 4.0, value, 2.0, 0.5, 0.25))
    return rows


class Files:
    """Trip files that arrive one after the other, and the stream over them."""

    def __init__(self, spark, root, delay="10 days", per_batch=None):
        self.spark, self.root, self.delay, self.per_batch, self.rows = spark, root, delay, per_batch, []

    def add(self, rows):
        self.rows += rows
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/incoming")

    def hours(self):
        frame = self.spark.createDataFrame([], SCHEMA)
        stream = hourly.trip_stream(self.spark, f"{self.root}/incoming", frame.schema, self.per_batch)
        return hourly.zone_hours(stream, self.delay)

    def run(self):
        return hourly.write_changes(self.hours(), f"{self.root}/hours", f"{self.root}/checkpoint")

    def found(self):
        return as_dicts(hourly.read_hours(self.spark, f"{self.root}/hours", self.hours().schema), *KEY)

    def expected(self):
        return as_dicts(measures.cube(self.spark.createDataFrame(self.rows, SCHEMA), KEY), *KEY)


def test_late_files_give_the_batch_result(spark, tmp_path):
    files = Files(spark, tmp_path)
    for seed, days in enumerate(([0, 1, 2], [1, 3, 4], [2, 4, 5])):  # each brings hours that came before
        files.add(make_trips(seed, days, 60))
        assert files.run() >= 1
        assert files.found() == files.expected()
    assert files.run() == 0 or files.found() == files.expected()  # nothing new
    assert files.found() == files.expected()


def test_several_batches_in_one_run(spark, tmp_path):
    files = Files(spark, tmp_path, per_batch=1)
    for seed in range(3):
        files.add(make_trips(seed, [seed, seed + 1], 40))
    assert files.run() >= 3
    assert files.found() == files.expected()


def test_restart_after_a_failed_batch(spark, tmp_path, monkeypatch):
    """A batch that wrote its rows but never finished is run again and replaces them."""
    files = Files(spark, tmp_path)
    files.add(make_trips(1, [0, 1], 50))
    files.run()
    files.add(make_trips(2, [1, 2], 50))
    from pyspark.sql.streaming import DataStreamWriter

    plain = DataStreamWriter.foreachBatch

    def failing(writer, function):
        def write_and_fail(batch, number):
            function(batch, number)
            raise RuntimeError("lost")

        return plain(writer, write_and_fail)

    monkeypatch.setattr(DataStreamWriter, "foreachBatch", failing)
    with pytest.raises(Exception, match="lost"):
        files.run()
    monkeypatch.undo()
    files.run()
    assert files.found() == files.expected()


def test_trips_behind_the_watermark_are_reported(spark, tmp_path):
    files = Files(spark, tmp_path, delay="1 day")
    files.add(make_trips(1, [9, 10], 30))
    files.run()
    files.add(make_trips(2, [11], 10))
    files.run()
    files.add(make_trips(3, [0], 10))
    with pytest.raises(hourly.LateTripsDropped):
        files.run()
