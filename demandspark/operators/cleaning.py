"""Trip cleaning with a priority-ordered rule table, and its audit tables.

One lazy plan covers all monthly files.  The audits come from a single aggregation that keeps one
row per file, so a file of any size costs one partial aggregate per task and no skewed shuffle.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.config import KEEP_COLUMNS, RENAMES, CleaningLimits
from demandspark.functions.columns import (
    day_name,
    is_weekend,
    minutes_between,
    nan_to_null,
    ratio,
    round_to,
)

VALID = "valid"


def standardize(raw: DataFrame) -> DataFrame:
    """Coerce timestamps, rename columns, merge the two fee spellings, turn NaN into NULL."""
    names = [f.name for f in raw.schema.fields]
    fees = [name for name in ("airport_fee", "Airport_fee") if name in names]
    kinds = dict(raw.dtypes)
    columns = []
    for name in names:
        if name in ("airport_fee", "Airport_fee"):
            if name == fees[0]:
                columns.append(F.coalesce(*[_numeric(fee, kinds) for fee in fees]).alias("airport_fee"))
            continue
        target = RENAMES.get(name, name)
        if target in RENAMES.values():
            columns.append(_timestamp(name, kinds).alias(target))
        elif name in KEEP_COLUMNS:
            columns.append(_numeric(name, kinds).alias(target))
        else:
            columns.append(F.col(name))
    return raw.select(*columns)


def _timestamp(name: str, kinds: dict[str, str]) -> Column:
    column = F.col(name)
    return column if kinds[name] == "timestamp_ntz" else column.try_cast("timestamp_ntz")


def _numeric(name: str, kinds: dict[str, str]) -> Column:
    column = F.col(name)
    return nan_to_null(column) if kinds[name] in ("double", "float") else column


def with_study_month(trips: DataFrame) -> DataFrame:
    """Mark rows picked up in the month that ends their file name (``..._YYYY-MM.parquet``)."""
    token = F.substring_index("file", "_", -1)
    month_start = F.concat(F.left(token, F.lit(7)), F.lit("-01")).try_cast("date")
    return trips.withColumn("in_study_period", F.trunc("pickup_datetime", "MM") == month_start)


def with_study_window(trips: DataFrame, start: date, end: date) -> DataFrame:
    """Mark rows picked up in [start, end); a filter on the mark reaches the Parquet scan."""
    pickup = F.col("pickup_datetime")
    first, last = (F.lit(day).cast("timestamp_ntz") for day in (start, end))
    return trips.withColumn("in_study_period", (pickup >= first) & (pickup < last))


def quality_rules(limits: CleaningLimits = CleaningLimits()) -> dict[str, Column]:
    """Failing conditions in priority order; a missing value fails only the missing-value rules."""
    minutes, miles = F.col("trip_duration_min"), F.col("trip_distance")
    fare, total = F.col("fare_amount"), F.col("total_amount")
    table = {
        "missing_dropoff_datetime": F.col("dropoff_datetime").isNull(),
        "missing_location": F.col("PULocationID").isNull() | F.col("DOLocationID").isNull(),
        "zero_or_negative_duration": minutes <= 0,
        "short_duration_under_1_min": (minutes > 0) & (minutes < limits.min_minutes),
        "long_duration_over_180_min": minutes > limits.max_minutes,
        "zero_distance": miles <= 0,
        "distance_over_100_miles": miles > limits.max_miles,
        "negative_fare": fare < 0,
        "fare_over_500": fare > limits.max_fare,
        "negative_total_amount": total < 0,
        "total_amount_over_1000": total > limits.max_total,
    }
    return {name: F.coalesce(condition, F.lit(False)) for name, condition in table.items()}


def valid_trip(limits: CleaningLimits = CleaningLimits()) -> Column:
    """True exactly where no quality rule fails, as a conjunction of ranges.

    Filtering on the rule label instead would copy its whole CASE expression, with every input
    expression in it, into the filter below the projections.
    """

    def absent_or(inside: Column) -> Column:
        return F.coalesce(inside, F.lit(True))

    minutes, miles = F.col("trip_duration_min"), F.col("trip_distance")
    fare, total = F.col("fare_amount"), F.col("total_amount")
    lower = F.lit(limits.min_minutes) if limits.min_minutes > 0 else None
    long_enough = minutes >= lower if lower is not None else minutes > 0
    return (
        F.col("dropoff_datetime").isNotNull()
        & F.col("PULocationID").isNotNull()
        & F.col("DOLocationID").isNotNull()
        & absent_or(long_enough & (minutes <= limits.max_minutes))
        & absent_or((miles > 0) & (miles <= limits.max_miles))
        & absent_or((fare >= 0) & (fare <= limits.max_fare))
        & absent_or((total >= 0) & (total <= limits.max_total))
    )


def flag_trips(trips: DataFrame, limits: CleaningLimits = CleaningLimits()) -> DataFrame:
    """Add the duration and ``first_failing_rule`` (NULL out of period)."""
    timed = trips.withColumn(
        "trip_duration_min", minutes_between(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    )
    first = None
    for name, fails in quality_rules(limits).items():
        first = F.when(fails, name) if first is None else first.when(fails, name)
    return timed.withColumn("first_failing_rule", F.when(F.col("in_study_period"), first.otherwise(VALID)))


def _with_calendar(trips: DataFrame) -> DataFrame:
    pickup = F.col("pickup_datetime")
    return trips.withColumns(
        {
            "date": F.to_date(pickup).cast("timestamp_ntz"),
            "hour": F.hour(pickup),
            "day_of_week": day_name(pickup),
            "day_of_week_num": F.weekday(pickup),
            "is_weekend": is_weekend(pickup),
            "month": F.month(pickup),
            "revenue_per_mile": ratio(F.col("total_amount"), F.col("trip_distance")),
            "tip_rate": ratio(F.col("tip_amount"), F.col("fare_amount")),
        }
    )


def clean_trips(flagged: DataFrame, limits: CleaningLimits = CleaningLimits()) -> DataFrame:
    """Valid in-period trips with calendar columns and safe ratios."""
    kept = flagged.filter(F.col("in_study_period")).filter(valid_trip(limits))
    return _with_calendar(kept).drop("in_study_period", "first_failing_rule")


def checked_trips(flagged: DataFrame, limits: CleaningLimits = CleaningLimits()) -> DataFrame:
    """Every trip, with the rules it fails as bits of ``failed_rules``, and ``study_month``, that of its file's name.

    Written once, it serves as the clean trips (:func:`valid_of`) and as the source of all audits (:func:`checked_counts`),
    so the raw files are read a single time. A file without a month in its name counts by the month of the pickup.
    """
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(quality_rules(limits).values())]
    named = F.nullif(F.regexp_extract("file", r"(\d{4}-\d{2})", 1), F.lit(""))
    month = F.coalesce(named, F.date_format("pickup_datetime", "yyyy-MM"))
    marked = flagged.withColumns(
        {
            "in_study_period": F.coalesce("in_study_period", F.lit(False)),
            "failed_rules": reduce(lambda one, other: one.bitwiseOR(other), bits),
            "study_month": month,
        }
    )
    return _with_calendar(marked).drop("first_failing_rule")


def valid_of(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("in_study_period") & (F.col("failed_rules") == 0)).drop("in_study_period", "failed_rules")


def checked_counts(checked: DataFrame) -> DataFrame:
    """The counters of :func:`audit_counts` from checked trips: reads three narrow columns."""
    inside, failed = F.col("in_study_period"), F.col("failed_rules")
    lowest = failed.bitwiseAND(-failed)
    names = list(quality_rules())
    return checked.groupBy("file").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(inside).alias("period_rows"),
        *[F.count_if(inside & (failed.bitwiseAND(F.lit(1 << i)) != 0)).alias(f"fails_{n}") for i, n in enumerate(names)],
        *[F.count_if(inside & (lowest == 1 << i)).alias(f"first_{n}") for i, n in enumerate(names)],
        F.count_if(inside & (failed == 0)).alias(f"first_{VALID}"),
    )


def audit_counts(flagged: DataFrame, limits: CleaningLimits = CleaningLimits()) -> DataFrame:
    """One row per file with every counter the audit tables need (a single scan)."""
    inside = F.coalesce(F.col("in_study_period"), F.lit(False))
    first = F.col("first_failing_rule")
    rules = quality_rules(limits)
    return flagged.groupBy("file").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(inside).alias("period_rows"),
        *[F.count_if(inside & fails).alias(f"fails_{name}") for name, fails in rules.items()],
        *[F.count_if(first == name).alias(f"first_{name}") for name in (*rules, VALID)],
    )


def _long_counts(counts: DataFrame, prefix: str, names: list[str], label: str, value: str) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(n).alias(label), F.col(f"{prefix}_{n}").alias(value)) for n in names]
    )
    return counts.select("file", "period_rows", F.inline(pairs))


def quality_breakdown(counts: DataFrame) -> DataFrame:
    """Records failing each rule, evaluated independently, zero counts included."""
    long = _long_counts(counts, "fails", list(quality_rules()), "rule", "excluded_records")
    share = round_to(ratio(F.col("excluded_records"), F.col("period_rows")) * 100, 2)
    return long.select(
        "file", "rule", "excluded_records", F.coalesce(share, F.lit(0.0)).alias("pct_of_study_period_records")
    )


def first_failure(counts: DataFrame) -> DataFrame:
    """Records by the first rule they fail (or ``valid``); only classes that occur."""
    names = [*quality_rules(), VALID]
    long = _long_counts(counts, "first", names, "first_failing_rule", "records")
    share = round_to(ratio(F.col("records"), F.col("period_rows")) * 100, 2)
    return long.filter("records > 0").select(
        "file", "first_failing_rule", "records", share.alias("pct_of_study_period")
    )


def quality_summary(counts: DataFrame) -> DataFrame:
    """Raw, excluded and clean record counts of each file."""
    excluded = F.col("raw_rows") - F.col(f"first_{VALID}")
    return counts.select(
        "file",
        F.col("raw_rows").alias("raw_trip_count"),
        (F.col("raw_rows") - F.col("period_rows")).alias("out_of_period_count"),
        (F.col("period_rows") - F.col(f"first_{VALID}")).alias("invalid_in_period_count"),
        F.col(f"first_{VALID}").alias("clean_trip_count"),
        excluded.alias("total_excluded_trip_count"),
        round_to(ratio(excluded, F.col("raw_rows")) * 100, 2).alias("excluded_pct"),
    )


def accounting_check(counts: DataFrame) -> DataFrame:
    """raw = out of period + Σ first failures + clean, from independently counted classes."""
    failures = sum((F.col(f"first_{name}") for name in quality_rules()), F.lit(0))
    outside = F.col("raw_rows") - F.col("period_rows")
    return counts.select(
        "file",
        F.col("raw_rows").alias("raw_trip_count"),
        outside.alias("out_of_period_count"),
        failures.alias("first_failure_count"),
        F.col(f"first_{VALID}").alias("clean_trip_count"),
        (F.col("raw_rows") == outside + failures + F.col(f"first_{VALID}")).alias("balanced"),
    )
