"""Small column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandspark.config import NO_HOLIDAY, TIME_BLOCKS, UNKNOWN, Fold


# Sums of doubles depend on their order from about this digit on.
NOISE_DIGITS = 11


def round_to(value: Column, digits: int) -> Column:
    """Half-away-from-zero rounding of a double: scale, round, unscale.

    A value within 5e-12 of a tie counts as the tie, so that the order in which partial sums were merged cannot push it
    to either side; every other value is rounded as it is, and so are values too large to hold that digit.
    """
    fine, coarse = float(10**NOISE_DIGITS), float(10**digits)
    steady = F.when(F.abs(value) < 2.0**53 / fine, F.round(value * fine) / fine).otherwise(value)
    return F.round(steady * coarse) / coarse


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division whose result is NULL for a zero or NULL denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def nan_to_null(value: Column) -> Column:
    """NaN compares greater than everything in Spark; a missing number must compare as unknown."""
    return F.nanvl(value, F.lit(None).cast("double"))


def finite_or_zero(value: Column) -> Column:
    bounded = F.abs(value) < F.lit(float("inf"))
    return F.when(bounded & ~F.isnan(value), value).otherwise(F.lit(0.0))


def minutes_between(start: Column, end: Column) -> Column:
    """Fractional minutes; with the session zone at UTC the casts keep the wall-clock difference."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))).cast("double") / 6e7


def hour_start(day: Column, hour: Column) -> Column:
    return day.cast("timestamp_ntz") + F.expr("INTERVAL '1' HOUR") * hour


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def day_type(day: Column) -> Column:
    return weekend_label(is_weekend(day))


def weekend_label(flag: Column) -> Column:
    return F.when(flag, "Weekend").otherwise("Weekday")


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def epoch_day(day: Column) -> Column:
    return F.unix_date(day.cast("date"))


def time_block(hour: Column) -> Column:
    label = F.lit(TIME_BLOCKS[0][1])
    for first_hour, name in TIME_BLOCKS[1:]:
        label = F.when(hour >= first_hour, name).otherwise(label)
    return label


def contains_text(value: Column, text: str) -> Column:
    return F.coalesce(F.contains(F.lower(value), F.lit(text.lower())), F.lit(False))


def zone_label(zone_id: Column, name: Column, sentinels: Mapping[int, str]) -> Column:
    label = F.coalesce(name, F.lit(UNKNOWN))
    for sentinel, text in sentinels.items():
        label = F.when(zone_id == sentinel, text).otherwise(label)
    return label


def borough_label(zone_id: Column, name: Column, sentinels: Iterable[int]) -> Column:
    known = F.coalesce(name, F.lit(UNKNOWN))
    return F.when(zone_id.isin(list(sentinels)), UNKNOWN).otherwise(known)


def holiday_label(day: Column, holidays: Mapping[date, str]) -> Column:
    label = F.lit(NO_HOLIDAY)
    for holiday, name in holidays.items():
        label = F.when(day == F.lit(holiday), name).otherwise(label)
    return label


def _fold_structs(folds: Iterable[Fold]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(f.number).alias("fold"),
                F.lit(f.start).alias("fold_start"),
                F.lit(f.end).alias("fold_end"),
            )
            for f in folds
        ]
    )


def training_folds(day: Column, folds: Iterable[Fold]) -> Column:
    """Array of the folds that may train on ``day``; explode it in place of a range join."""
    return F.filter(_fold_structs(folds), lambda f: day < f["fold_start"])


def test_folds(day: Column, folds: Iterable[Fold]) -> Column:
    """Array of the folds that test on ``day``."""
    return F.filter(_fold_structs(folds), lambda f: (day >= f["fold_start"]) & (day < f["fold_end"]))
