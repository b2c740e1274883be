"""Trip-shaped views of the shared test tables.

``events`` becomes one month of hourly trips; ``lineitem`` becomes
several years of monthly files.  Both are single projections, so column pruning and filters reach
the Parquet scan.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.config import StudyConfig, folds_from
from demandspark.session import prepare

AUDIT_START, AUDIT_END = date(2024, 1, 3), date(2024, 1, 30)
SHIPMENT_MONTHS = [f"{year}-{month:02d}" for year in range(1995, 2002) for month in range(1, 13)]
MONTH_START, MONTH_END = date(2024, 1, 1), date(2024, 2, 1)

STUDY = replace(
    StudyConfig(),
    sentinels={3: "Unknown", 4: "Outside NYC"},
    airport_pattern="7",
    holidays={date(2024, 1, 1): "New Year's Day", date(2024, 1, 15): "MLK Day"},
    folds=folds_from([date(2024, 1, 15), date(2024, 1, 22)]),
    support_thresholds=(25, 30),
    min_history_days=7,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.get_json_object("props", "$.k").cast("int")
    number = F.col("event_id")
    offset = F.expr("INTERVAL '1' SECOND") * (key * 114 - 57)
    fee = F.when(number % 4 == 0, 0.75).when(number % 4 < 3, 0.0)
    payment = (
        F.when(F.col("event_type") == "signup", 0)
        .when(F.col("event_type") == "purchase", 1)
        .when(F.col("event_type") == "view", 2)
        .when(F.col("event_type") == "click", 3)
        .otherwise(4)
    )
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("tpep_pickup_datetime"),
        F.when(number % 997 != 0, F.col("ts") + offset).alias("tpep_dropoff_datetime"),
        (number % 103).cast("double").alias("trip_distance"),
        F.when(number % 499 != 0, F.col("user_id")).alias("PULocationID"),
        (number % 263).alias("DOLocationID"),
        payment.cast("bigint").alias("payment_type"),
        (F.col("value") - 1.0).alias("fare_amount"),
        (F.col("value") * 0.1).alias("tip_amount"),
        (F.col("value") * 1.2 - 2.0).alias("total_amount"),
        fee.alias("cbd_congestion_fee"),
        F.lit("events_2024-01.parquet").alias("file"),
    )


def trips_from_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a trip at a spread-out hour of its ship date.

    One row in 50 carries the name of the following month's file, and is out of period there.
    """
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    minute = F.expr("INTERVAL '1' MINUTE")
    start = F.col("l_shipdate") + minute * (F.col("l_orderkey") % 1440)
    ride = minute * (F.col("l_quantity").cast("int") * 4 - 6)
    fare = F.col("l_extendedprice") / 200 - F.col("l_quantity") / 4
    filed = F.when(part % 50 == 0, F.add_months("l_shipdate", 1)).otherwise(F.to_date("l_shipdate"))
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        start.alias("tpep_pickup_datetime"),
        F.when(part % 97 != 0, start + ride).alias("tpep_dropoff_datetime"),
        (F.col("l_quantity") - line).alias("trip_distance"),
        F.col("l_suppkey").alias("PULocationID"),
        F.when(part % 89 != 0, part % 263).alias("DOLocationID"),
        F.when(flag == "R", 1).when(flag == "A", 2).otherwise(3).cast("bigint").alias("payment_type"),
        fare.alias("fare_amount"),
        (fare * F.col("l_discount")).alias("tip_amount"),
        (fare * (1 + F.col("l_tax")) - 1.0).alias("total_amount"),
        F.when(line == 7, F.lit(None).cast("double")).when(line > 3, 0.75).otherwise(0.0).alias(
            "cbd_congestion_fee"
        ),
        F.concat(F.lit("shipments_"), F.left(filed.cast("string"), F.lit(7)), F.lit(".parquet")).alias("file"),
    )


def _lookup(spark: SparkSession, sf_dir: str, source: str, key: str, name: str, nation: str) -> DataFrame:
    named = table(spark, sf_dir, source).select(
        F.col(key).alias("LocationID"), F.col(name).alias("Zone"), F.col(nation).alias("n_nationkey")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("Borough"))
    return named.join(nations, "n_nationkey").join(regions, "r_regionkey").select("LocationID", "Borough", "Zone")


def customer_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")


def supplier_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")


def lookup_with_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone lookup whose boroughs are "N/A", "NA" or missing."""
    key = F.col("s_suppkey")
    borough = F.when(key % 3 == 0, "N/A").when(key % 3 == 1, "NA")
    return table(spark, sf_dir, "supplier").select(key.cast("int").alias("LocationID"), borough.alias("Borough"), F.col("s_name").alias("Zone"))


def write_months(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Line items as raw trips, in four sets of months that differ in types and in the fee column's spelling."""
    line = table(spark, sf_dir, "lineitem")
    minute = F.expr("INTERVAL '1' MINUTE")
    start = F.col("l_shipdate").cast("timestamp_ntz") + minute * (F.col("l_orderkey") % 1440)
    known = F.col("l_partkey") % 61 != 0
    stop = start + minute * F.col("l_quantity").cast("int")
    fee = F.col("l_tax")
    for part, (count, zone, pickup, fees) in enumerate(
        [
            ("int", "int", F.when(known, start), {"airport_fee": fee}),
            ("bigint", "bigint", F.when(known, start.cast("string")).otherwise("not a time"), {"Airport_fee": fee}),
            ("double", "double", F.when(known, start), {"airport_fee": fee.cast("string")}),
            ("double", "bigint", F.when(known, start), {}),
        ]
    ):
        line.filter(F.month("l_shipdate") % 4 == part).select(
            pickup.alias("tpep_pickup_datetime"),
            stop.alias("tpep_dropoff_datetime"),
            F.col("l_linenumber").cast(count).alias("passenger_count"),
            F.col("l_suppkey").cast(zone).alias("PULocationID"),
            F.col("l_partkey").cast(zone).alias("DOLocationID"),
            *[value.alias(name) for name, value in fees.items()],
            F.col("l_linestatus").alias("outside"),
        ).write.parquet(f"{root}/trips_{part}")
