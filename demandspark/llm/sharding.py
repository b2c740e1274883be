"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit.

The hash of a row is 60 bits: 30 of its key and 30 of its row id, so a key that holds a third of all rows is split by
row id once its own bits are used up. Rows are summed by prefix cells of a few more bits, each round only within buckets
that are still too large; the splits of a round are sums over the cells, not scans of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import materialize

HASH_BITS = 60
KEY_BITS = 30
ROUND_BITS = 10
LIMIT_BYTES = 4 << 20


def _bits(column: str) -> Column:
    """30 bits of the MD5 of a value's text; null hashes as an empty text."""
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 2)


def _prefix(hash_: str, depth: Column | int) -> Column:
    return F.shiftright(hash_, HASH_BITS - depth) if isinstance(depth, int) else F.expr(f"shiftright({hash_}, cast({HASH_BITS} - depth as int))")


def shard_rows(documents: DataFrame, key: str = "doc_id", row_id: str = "doc_id", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, shard (its hash prefix in bits), depth, shard_bytes.

    A shard is the shortest prefix whose texts have at most ``limit_bytes`` bytes of UTF-8 together. Rows that share all
    60 bits, such as a single text above the limit or repeats of one row, can't be separated and form a shard of their
    own however large. Null texts have no bytes, null keys hash as an empty text; other columns are ignored; an empty
    table gives an empty result. All rows in one shard give the empty prefix with depth 0.
    """
    hashed = F.shiftleft(_bits(key), KEY_BITS).bitwiseOR(_bits(row_id))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = materialize(documents.select(F.col(row_id).alias("doc_id"), size.alias("n_bytes"), hashed.alias("h")), "shard-rows")
    sums = F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high")
    settled, done, active = None, 0, rows
    while done < HASH_BITS:
        deep = min(HASH_BITS, done + ROUND_BITS)
        cells = active.groupBy(_prefix("h", deep).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        cells = materialize(cells, "shard-cells")
        # Every bucket on the way from the round's first depth to its cells, with its size.
        path = cells.withColumn("depth", F.explode(F.sequence(F.lit(done), F.lit(deep))))
        path = path.withColumn("prefix", F.expr(f"shiftright(cell, cast({deep} - depth as int))"))
        buckets = path.groupBy("depth", "prefix").agg(*sums)
        fits = (F.col("bytes") <= limit_bytes) | (F.col("low") == F.col("high"))
        leaf = path.select("cell", "depth", "prefix").join(buckets.filter(fits).select("depth", "prefix", "bytes"), ["depth", "prefix"])
        leaf = leaf.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "bytes")).alias("bucket"))
        directory = materialize(
            cells.select("cell").join(leaf, "cell", "left").select("cell", "bucket.depth", "bucket.prefix", "bucket.bytes"), "directory"
        )
        joined = active.withColumn("cell", _prefix("h", deep)).join(directory, "cell")
        placed = joined.filter("depth is not null").select("doc_id", "n_bytes", "prefix", "depth", F.col("bytes").alias("shard_bytes"))
        settled = placed if settled is None else settled.unionByName(placed)
        if directory.filter("depth is null").isEmpty():
            break
        active = materialize(joined.filter("depth is null").select("doc_id", "n_bytes", "h"), "shard-rows")
        done = deep
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(cast(prefix as string), 10, 2), depth, '0')"))
    return settled.select("doc_id", "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes")


def write_shards(documents: DataFrame, folder: str, limit_bytes: int = LIMIT_BYTES) -> None:
    """Write the rows of ``documents`` (distinct doc_id) as one folder per shard."""
    placed = shard_rows(documents, limit_bytes=limit_bytes).select("doc_id", F.concat(F.lit("s"), "shard").alias("shard"))
    documents.join(placed, "doc_id").repartition("shard").write.partitionBy("shard").parquet(folder)
