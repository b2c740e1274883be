"""Exact quantiles in two scans, without gathering a group's rows and without shuffling its values.

``median`` keeps every distinct value of a group in one task.  Here the first scan keeps a mergeable quantile sketch (KLL)
per group and measure, in the same aggregation as whatever else is wanted of the group.  The sketches bracket the values
at the wanted ranks; the second scan counts what lies between the brackets and keeps only the distinct values inside, with
their counts, and those are ranked exactly.  Inside a bracket, running counts go over bins first, so that only the values
of the bins that hold a rank are ordered.  A sketch is right only with high probability: a rank that turns out to lie
outside its bracket is noticed, and the second scan is repeated with wider ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.functions.columns import nan_to_null, round_to
from demandspark.session import materialize

SKETCH_SIZE = 4096
# Share of the ranks by which a bracket reaches beyond the wanted one on either side: about three times the
# error that sketches of this size stay below in 99 of 100 cases.
MARGIN = 0.003
WIDEN = 8
BINS = 1024


def _sketched(df: DataFrame, keys: list[str], measures: dict[str, str], aggregates: Sequence[Column]) -> DataFrame:
    """One row per group: ``aggregates``, and per measure its count of values and their sketch (n_0, sketch_0, …)."""
    columns = []
    for i, source in enumerate(measures.values()):
        value = nan_to_null(F.col(source).cast("double"))
        columns += [F.count(value).alias(f"_n_{i}"), F.kll_sketch_agg_double(value, SKETCH_SIZE).alias(f"_sketch_{i}")]
    return materialize(df.groupBy(*keys).agg(*aggregates, *columns), "sketches")


def _brackets(sketched: DataFrame, keys: list[str], count: int, probabilities: Sequence[float], margin: float) -> DataFrame:
    """keys, _measure, _total and for each probability the low and high end of its bracket."""
    rows = []
    for i in range(count):
        total, sketch = F.col(f"_n_{i}"), F.col(f"_sketch_{i}")
        ends = []
        for j, p in enumerate(probabilities):
            few = total < SKETCH_SIZE  # where a rank weighs as much as the margin: all of them
            for name, end, rank in (("_low", 0.0, max(0.0, p - margin)), ("_high", 1.0, min(1.0, p + margin))):
                wide, narrow = (F.kll_sketch_get_quantile_double(sketch, F.lit(float(r))) for r in (end, rank))
                ends.append(F.when(few, wide).otherwise(narrow).alias(f"{name}_{j}"))
        row = F.struct(F.lit(i).alias("_measure"), total.alias("_total"), *ends)
        rows.append(F.when(total > 0, row))
    found = sketched.select(*keys, F.explode(F.array(*rows)).alias("_row")).filter("_row is not null")
    return found.select(*[F.col(k).alias(f"{k}_at") for k in keys], "_row.*").withColumnRenamed("_measure", "_measure_at")


def _counted(df: DataFrame, keys: list[str], measures: dict[str, str], brackets: DataFrame, count: int) -> DataFrame:
    """Distinct values inside the brackets with their counts, and one row for all values of each gap between brackets.

    A gap stands at the end of the bracket before it. ``_bin`` never falls as the value rises.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("_measure"), nan_to_null(F.col(source).cast("double")).alias("_value"))
            for i, source in enumerate(measures.values())
        ]
    )
    value = F.col("_value")
    ends = [(F.col(f"_low_{j}"), F.col(f"_high_{j}")) for j in range(count)]
    inside = reduce(or_, [(value >= low) & (value <= high) for low, high in ends])
    passed = F.greatest(F.lit(float("-inf")), F.lit(float("-inf")), *[F.when(high < value, high) for _, high in ends])
    place = F.col("_place")
    steps = [
        F.when(place < low, 0).when(place >= high, BINS + 1).otherwise(1 + F.floor((place - low) / (high - low) * BINS))
        for low, high in ends
    ]
    # A row per group and measure, whatever the size of the data.
    same = [F.col(k).eqNullSafe(F.col(f"{k}_at")) for k in keys] + [F.col("_measure") == F.col("_measure_at")]
    return (
        df.select(*keys, F.inline(pairs))
        .filter("_value is not null")
        .join(F.broadcast(brackets), reduce(and_, same))
        .withColumns({"_gap": ~inside, "_place": F.when(inside, value).otherwise(passed)})
        .withColumn("_bin", reduce(add, steps).cast("long"))
        .groupBy(*keys, "_measure", "_bin", "_place", "_gap")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def _ranked(counted: DataFrame, group: list[str], probabilities: Sequence[float]) -> DataFrame:
    """group, _probability, _quantile, and ``_missed`` where a wanted rank lies in a gap."""
    by_group = W.partitionBy(*group)
    through = by_group.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    spot = (F.col("_total") - 1) * F.col("_probability")
    holds_low, holds_high = (
        (F.col(rank) > F.col("_before")) & (F.col(rank) <= F.col("_through")) for rank in ("_low", "_high")
    )
    located = (
        counted.groupBy(*group, "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .withColumns({"_through": F.sum("_in_bin").over(through), "_total": F.sum("_in_bin").over(by_group)})
        .select(
            *group, "_bin", "_through",
            (F.col("_through") - F.col("_in_bin")).alias("_before"), "_total",
            F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("_probability"),
        )
        .withColumns({"_low": F.floor(spot) + 1, "_high": F.ceil(spot) + 1, "_share": spot - F.floor(spot)})
        .filter(holds_low | holds_high)
        .groupBy(*group, "_bin", "_before")
        .agg(F.collect_list(F.struct("_probability", "_low", "_high", "_share")).alias("_wanted"))
        .select(*[F.col(c).alias(f"{c}_at") for c in (*group, "_bin")], "_before", "_wanted")
    )
    # At most two bins per group and probability.
    same_bin = [F.col(c).eqNullSafe(F.col(f"{c}_at")) for c in (*group, "_bin")]
    ordered = W.partitionBy(*group, "_bin").orderBy("_place", "_gap").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        counted.join(F.broadcast(located), reduce(and_, same_bin))
        .withColumn("_last", F.col("_before") + F.sum("_n").over(ordered))
        .select(*group, "_place", "_gap", "_n", "_last", F.inline("_wanted"))
    )

    def at(rank: str) -> Column:
        return (F.col(rank) > F.col("_last") - F.col("_n")) & (F.col(rank) <= F.col("_last"))

    return (
        ranked.groupBy(*group, "_probability")
        .agg(
            F.max(F.when(at("_low"), F.col("_place"))).alias("_from"),
            F.max(F.when(at("_high"), F.col("_place"))).alias("_to"),
            F.max("_share").alias("_share"),
            F.bool_or((at("_low") | at("_high")) & F.col("_gap")).alias("_missed"),
        )
        .select(
            *group,
            "_probability",
            (F.col("_from") + (F.col("_to") - F.col("_from")) * F.col("_share")).alias("_quantile"),
            "_missed",
        )
    )


def _quantiles(
    df: DataFrame, keys: list[str], measures: dict[str, str], probabilities: Sequence[float], aggregates: Sequence[Column] = (), margin: float = MARGIN
) -> tuple[DataFrame, DataFrame]:
    """The aggregates of every group, and the quantiles long: ``keys``, _measure, _probability, _quantile."""
    sketched = _sketched(df, keys, measures, aggregates)
    while True:
        brackets = _brackets(sketched, keys, len(measures), probabilities, margin)
        counted = materialize(_counted(df, keys, measures, brackets, len(probabilities)), "bracketed-values")
        ranked = materialize(_ranked(counted, [*keys, "_measure"], probabilities), "quantiles")
        if margin >= 1 or ranked.filter("_missed").isEmpty():
            break
        margin *= WIDEN
    names = F.array(*[F.lit(out) for out in measures])
    long = ranked.withColumn("_measure", F.get(names, F.col("_measure"))).drop("_missed")
    return sketched.drop(*[c for c in sketched.columns if c.startswith(("_n_", "_sketch_"))]), long


def quantiles_long(
    df: DataFrame, keys: list[str], measures: dict[str, str], probabilities: Sequence[float], margin: float = MARGIN
) -> DataFrame:
    """Linearly interpolated quantiles, long: ``keys``, _measure, _probability, _quantile.

    ``measures`` maps output name to input column; missing values and NaN do not count.  ``keys`` must be
    a low-cardinality grouping such as the month number: brackets, one row for each key and measure, are joined back.
    """
    return _quantiles(df, keys, measures, probabilities, margin=margin)[1]


def _wide(long: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_measure") == out, F.col("_quantile"))).alias(out) for out in measures]
    )


def exact_medians(df: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """One row per ``keys`` with the interpolated median of each measure."""
    return _wide(quantiles_long(df, keys, measures, [0.5]), keys, measures)


def with_medians(
    df: DataFrame, keys: list[str], aggregates: Sequence[Column], measures: dict[str, str], digits: int = 2
) -> DataFrame:
    """One row per ``keys`` (one row in all without keys): the aggregates, and the rounded medians of the measures.

    Both parts are tiny, so they are stacked and regrouped: NULL keys meet, and nothing is joined.
    """
    totals, long = _quantiles(df, keys, measures, [0.5], aggregates)
    medians = _wide(long, keys, measures).withColumns({out: round_to(F.col(out), digits) for out in measures})
    stacked = totals.unionByName(medians, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])


def summary_with_quantiles(
    df: DataFrame, columns: Sequence[str], aggregates: Sequence[Column], quantiles: dict[str, float]
) -> tuple[DataFrame, DataFrame]:
    """One row of ``aggregates``, and per column its named quantiles (_measure, one column a name), in two scans."""
    totals, long = _quantiles(df, [], {c: c for c in columns}, list(quantiles.values()), aggregates)
    wide = long.groupBy("_measure").agg(
        *[F.max(F.when(F.col("_probability") == p, F.col("_quantile"))).alias(n) for n, p in quantiles.items()]
    )
    return totals, wide
