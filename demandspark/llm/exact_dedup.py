"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Every step only looks at rows of groups that the step before left with two rows or more; whole texts are hashed for the
survivors of the prefix step alone. The groups of each step are counted with partial aggregation, so a group that holds a
third of all rows is one row per task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import materialize

PREFIX_CHARS = 128
DEALS = 32


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def exact_groups(documents: DataFrame, prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept; with ``digest`` also text_sha256.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest doc_id stays.
    ``group_size`` counts rows, so repeated rows count each; where rows repeat the doc_id that stays, all of them are
    marked as kept. A null doc_id never wins against another; alone it keeps itself. Other columns are ignored and an
    empty table gives an empty result.
    """
    full = F.sha2(_text(), 256).alias("full")
    rows = documents.select(
        "doc_id", F.octet_length(_text()).alias("length"), F.xxhash64(F.left(_text(), F.lit(prefix_chars))).alias("prefix"),
        *([full] if digest else []),
    )
    repeated = F.col("n") > 1
    lengths = rows.groupBy("length").agg(F.count("*").alias("n")).filter(repeated).select("length")
    # One length may be that of a third of all rows: its rows are dealt over several tasks for the join.
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)))
    lengths = lengths.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    prefixes = (
        dealt.join(lengths, ["length", "deal"], "left_semi")
        .groupBy("length", "prefix").agg(F.count("*").alias("n")).filter(repeated).select("length", "prefix")
    )
    # The whole text of a survivor is reduced to its hash before anything but the join with the surviving groups.
    whole = documents.select(
        "doc_id",
        F.octet_length(_text()).alias("length"),
        F.xxhash64(F.left(_text(), F.lit(prefix_chars))).alias("prefix"),
        "text",
    )
    prefixes = materialize(prefixes, "prefix-groups")
    keys = ["length", "prefix"]
    hashed = whole.join(prefixes, keys, "left_semi").select("doc_id", "length", full)
    hashed = materialize(hashed, "full-hashes")
    groups = hashed.groupBy("length", "full").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = hashed.join(groups.filter(F.col("group_size") > 1), ["length", "full"], "left")
    shown = ["full"] if digest else []
    alone = rows.join(prefixes, keys, "left_anti").select("doc_id", F.lit(None).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), *shown)
    decided = grouped.select("doc_id", "group_size", "keep_id", *shown).unionByName(alone)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return decided.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        *([F.col("full").alias("text_sha256")] if digest else []),
    )
