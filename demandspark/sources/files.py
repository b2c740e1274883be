"""File sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandspark import schemas
from demandspark.config import KEEP_COLUMNS
from demandspark.operators.cleaning import valid_of

FOOTER_READS = 16  # footers the driver reads at the same time, where the executors can't
FOOTERS_A_TASK = 32


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file the text of its Parquet schema; null where this reader doesn't know the file system."""
    for batch in batches:
        names, found = batch.column(0).to_pylist(), []
        for name in names:
            try:
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as opened:
                    found.append(str(pq.ParquetFile(opened).schema).split("\n", 1)[1])
            except (OSError, pa.ArrowException):
                found.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], names=["name", "footer"])


def files_by_schema(spark: SparkSession, names: Sequence[str]) -> list[tuple[StructType, list[str]]]:
    """The files grouped by the schema in their footers.

    Tasks read the footers, one job for all files; Spark then infers one schema per distinct footer. Files in a store that
    only Spark reads have theirs inferred one by one.
    """
    rows = spark.createDataFrame([(name,) for name in names], "name string").repartition(-(-len(names) // FOOTERS_A_TASK))
    groups: dict[str, list[str]] = {}
    for row in rows.mapInArrow(_footers, "name string, footer string").collect():  # a row a file, as in the list itself
        groups.setdefault(row["footer"] or row["name"], []).append(row["name"])
    with ThreadPoolExecutor(FOOTER_READS) as pool:
        found = list(pool.map(lambda same: spark.read.parquet(min(same)).schema, groups.values()))
    by_schema: dict[str, tuple[StructType, list[str]]] = {}
    for schema, same in zip(found, groups.values(), strict=True):
        by_schema.setdefault(schema.json(), (schema, []))[1].extend(same)
    return [(schema, sorted(same)) for schema, same in sorted(by_schema.values(), key=lambda group: min(group[1]))]


def scan_trips(spark: SparkSession, path: str, keep: tuple[str, ...] = KEEP_COLUMNS) -> DataFrame:
    """All monthly Parquet files under a path or glob, as one frame with a ``file`` column.

    Months may store a column in different types: files are grouped by the schema in their footers, each group is one
    scan, its columns are cast to the declared types where they differ, and the groups are united by name. A value that
    has no form in the declared type becomes NULL. Columns outside the allow-list are never read, and a path without
    files raises ``AnalysisException``.
    """
    names = sorted(spark.read.parquet(path).inputFiles())
    groups = [_as_declared(spark.read.schema(schema).parquet(*same), keep) for schema, same in files_by_schema(spark, names)]
    united = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), groups)
    return united.select(*[name for name in keep if name in united.columns], "file")


def _as_declared(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    declared = {field.name: field.dataType for field in schemas.RAW_TRIPS.fields}
    columns = []
    for field in raw.schema.fields:
        if field.name in keep:
            kind = declared.get(field.name, field.dataType)
            same = kind == field.dataType
            columns.append(F.col(field.name) if same else F.col(field.name).try_cast(kind).alias(field.name))
    return raw.select(*columns, F.col("_metadata.file_name").alias("file"))


def scan_checked_trips(spark: SparkSession, path: str) -> DataFrame:
    """Checked trips of :func:`demandspark.operators.cleaning.checked_trips`, as written by month."""
    return spark.read.parquet(path)


def scan_clean_trips(spark: SparkSession, path: str) -> DataFrame:
    """The valid ones of trips written by month, checked or already clean, with one schema."""
    trips = spark.read.parquet(path)
    return valid_of(trips) if "failed_rules" in trips.columns else trips


def scan_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup CSV; only an empty field is missing, so texts like ``N/A`` stay as they are."""
    return (
        spark.read.schema(schemas.ZONE_LOOKUP)
        .option("header", True)
        .option("nullValue", "")
        .csv(path)
    )


def scan_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A result table written as CSV, read back with its declared types."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def scan_hourly_series(spark: SparkSession, path: str) -> DataFrame:
    return scan_table(spark, path, schemas.HOURLY_SERIES)


def scan_zone_hour_series(spark: SparkSession, path: str) -> DataFrame:
    return scan_table(spark, path, schemas.ZONE_HOUR_SERIES)
