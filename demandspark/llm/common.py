"""Helpers the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandspark.session import materialize, shared_dir


class Scratch:
    """Written tables of an operator's inner steps, each deleted once all that reads it is written too.

    Like ``materialize`` they lie in the shared folder. Without this, the disk holds every step of an operator at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{label}")

    def drop(self, *labels: str) -> None:
        """Delete the named tables. Shuffle files of finished steps go when the JVM collects the plans that wrote them."""
        jvm = self.spark.sparkContext._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{label}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


# Arrow batches of whole texts are cut by Spark at about so many bytes, which bounds what the JVM and the worker hold of one
# task; they are worked on in slices of about so many bytes, which bounds what a task holds beside the batch.
BATCH_BYTES = 15 << 19
SLICE_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches from now on hold at most BATCH_BYTES, or less where less is set.

    The bound on rows alone (10,000) lets a batch of texts grow to tens of megabytes, which are held as often by buffers
    that double while they are filled. No result depends on the setting.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    if conf.arrowMaxBytesPerBatch() > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes."""
    rows = max(1, batch.num_rows * limit // max(limit, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_KEPT: list[Callable] = []


def kept(build: Callable) -> Callable:
    """``build`` with its last results, which a worker keeps from task to task until it begins one of ``map_batches`` without them."""
    cached = functools.lru_cache(maxsize=4)(build)
    _KEPT.append(cached)
    return cached


def let_go(keeps: Callable | None = None) -> None:
    """Empty all that is ``kept`` but ``keeps``, and give the memory back to the system.

    Spark's workers live as long as their executor and serve one operator after the other: without this, the large tables of
    one operator take memory from all later ones.
    """
    others = [cached for cached in _KEPT if cached is not keeps and cached.cache_info().currsize]
    for cached in others:
        cached.cache_clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError, TypeError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    df: DataFrame,
    per_batch: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str | StructType,
    limit: int = SLICE_BYTES,
    keeps: Callable | None = None,
) -> DataFrame:
    """``per_batch`` over the Arrow batches of every task, in slices of about ``limit`` bytes.

    ``keeps`` is the function marked as ``kept`` that ``per_batch`` calls, if any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        for batch in batches:
            yield from map(per_batch, slices(batch, limit))

    return bound_batches(df).mapInArrow(run, schema)


def _star(edges: DataFrame, centre: str, leaf: str) -> DataFrame:
    """Each leaf of a centre joined with the least id among the centre and its leaves."""
    least = edges.groupBy(centre).agg(F.min(leaf).alias("least"))
    least = least.withColumn("least", F.least("least", centre))
    return edges.join(least, centre)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (u, v): one row (id, component_id) per linked id, with the least id reached.

    Alternates the large-star and small-star steps: each replaces edges by edges to the least neighbour, so a chain
    shrinks by a factor per round and a hub is never gathered, only its minimum is. Every round is a written table, which
    cuts the lineage; it ends when a round changes nothing. No ids reach the driver, only the two checks of a round.
    """
    edges = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "edges")
        small = _star(large, "u", "v")
        small = small.select(F.explode(F.array("v", "u")).alias("u"), F.col("least").alias("v"))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        check = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == state:
            break
        state = check
    leaves = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return materialize(leaves.unionByName(roots), "components")
