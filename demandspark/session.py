"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Results depend on these two: timestamps carry no zone, and a raw file may hold
# two fee columns whose names differ only in case.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
}

TUNING_CONF = {
    # HotSpot never compiles a method over 8000 bytecodes; above that, split expression code is faster
    # than one interpreted whole-stage method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "demandspark", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; keyword keys use ``__`` in place of dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    overrides = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**TUNING_CONF, **SEMANTIC_CONF, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Runtime settings the plans rely on, for sessions not made by :func:`build_session`.

    Differences of zone-less timestamps are free of DST jumps only with the zone at UTC.
    """
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(key, {**SEMANTIC_CONF, **TUNING_CONF}[key])


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    A local-mode session without the setting (tests) gets a scratch folder; a real cluster
    must name one, because a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    scratch = tempfile.mkdtemp(prefix="demandspark-")
    spark.sparkContext.setCheckpointDir(scratch)
    return shared_dir(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the written table.

    Used where several branches read the same expensive aggregate: each branch would otherwise
    rescan the raw trips, and its own column pruning keeps Spark from reusing the exchange.
    The written table prunes per branch, carries real sizes for join planning, and survives the
    loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
