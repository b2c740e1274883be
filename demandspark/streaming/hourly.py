"""Hourly zone counts kept up to date as trip files arrive.

The stream keeps the additive measures of every zone and hour as state. After each batch the rows that changed are written
under the number of the batch, so a batch that is run again after a failure replaces its own output. A reader takes the
latest version of each row: the same counts and sums as one batch aggregation over all files. A watermark bounds the
state; a run that had to drop a trip for it fails and says so, instead of giving counts that are too low.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandspark.operators.measures import ADDITIVE, additive

KEY = ("pickup_date", "pickup_hour", "PULocationID")
MAX_BATCHES = 100_000  # batches of one run whose progress is kept, to count what they dropped


class LateTripsDropped(RuntimeError):
    """Trips arrived after their hour had left the state: the counts lack them; use a longer delay and a new checkpoint."""


def trip_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Raw trip files of one schema under ``path``, each read once, new ones as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def zone_hours(trips: DataFrame, delay: str) -> DataFrame:
    """Measures per zone and hour of clean trips, as a stream; hours older than the latest trip by ``delay`` leave the state."""
    timed = trips.withColumn("at", F.col("pickup_datetime").cast("timestamp")).withWatermark("at", delay)
    hours = timed.groupBy(F.window("at", "1 hour"), "PULocationID").agg(*additive())
    start = F.col("window.start").cast("timestamp_ntz")
    return hours.select(F.to_date(start).alias("pickup_date"), F.hour(start).alias("pickup_hour"), "PULocationID", *ADDITIVE)


def write_changes(hours: DataFrame, out: str, checkpoint: str) -> int:
    """Run the stream over all files there are and write what changed; the number of batches it took.

    ``out`` and ``checkpoint`` must be reachable by all executors, and belong together. A later call with the same two goes
    on where this one ended, also after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark = hours.sparkSession
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(MAX_BATCHES))
    try:
        query = (
            hours.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    progress = query.recentProgress
    dropped = sum(state.numRowsDroppedByWatermark for p in progress for state in p.stateOperators)
    if dropped:
        raise LateTripsDropped(f"{dropped} groups of trips came after the watermark")
    return len({p.batchId for p in progress})


def read_hours(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The latest measures of every zone and hour: a cube without payment types. ``schema`` is that of :func:`zone_hours`."""
    versions = spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(out)
    latest = versions.groupBy(*KEY).agg(F.max_by(F.struct(*ADDITIVE), "batch").alias("latest"))
    return latest.select(*KEY, "latest.*")
