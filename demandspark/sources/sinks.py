"""Sinks.  A write replaces its own dataset, or the months it holds, so no stale result of an earlier run remains."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_months(trips: DataFrame, path: str, month: Column, replace: str = "all", rebalance: bool = True) -> None:
    """Parquet partitioned by ``study_month``, the value of ``month``.

    With ``replace="all"`` the dataset holds these trips alone afterwards; with ``"months"`` only the months that occur in
    ``trips`` are replaced, whole, and the others stay as they are. A month without any trip isn't touched then.
    Rebalancing shuffles the trips by month, splits large months and joins small parts, so that files have about
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` however many tasks read the input; without it each task writes one file
    for every month it meets.
    """
    if replace not in ("all", "months"):
        raise ValueError(f"replace must be all or months, not {replace}")
    placed = trips.withColumn("study_month", month)
    if rebalance:
        placed = placed.hint("rebalance", F.col("study_month"))
    mode = "static" if replace == "all" else "dynamic"
    placed.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("study_month").parquet(path)


def write_clean_trips(clean: DataFrame, path: str) -> None:
    """Clean trips by pickup month. Raw files are monthly, so a task mostly holds one month and writes one file for it."""
    write_months(clean, path, F.date_format("pickup_datetime", "yyyy-MM"), rebalance=False)


def write_table(df: DataFrame, path: str, order_by: list | None = None, fmt: str = "csv") -> None:
    """A result table; the order matters only to readers, so the sort happens here."""
    ordered = df.orderBy(*order_by) if order_by else df
    writer = ordered.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
