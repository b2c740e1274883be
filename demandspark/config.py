"""Parameters of the pipeline, with the published study's values as defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

# --- fixed values: raw columns that are kept, in file order -----------------------------------
KEEP_COLUMNS = (
    "VendorID",
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "RatecodeID",
    "PULocationID",
    "DOLocationID",
    "payment_type",
    "fare_amount",
    "tip_amount",
    "tolls_amount",
    "total_amount",
    "congestion_surcharge",
    "airport_fee",
    "Airport_fee",
    "cbd_congestion_fee",
)
RENAMES = {"tpep_pickup_datetime": "pickup_datetime", "tpep_dropoff_datetime": "dropoff_datetime"}

# --- fixed values: labels of zone ids that stand for no real zone -----------------------------
SENTINEL_ZONES = {264: "Unknown", 265: "Outside NYC"}
UNKNOWN = "Unknown"
CARD_PAYMENT = 1
AIRPORT_PATTERN = "airport"

# --- fixed values: first hour of each time block, in day order --------------------------------
TIME_BLOCKS = ((0, "Overnight"), (6, "Morning"), (10, "Midday"), (16, "Evening"), (21, "Late evening"))

# --- fixed values: holidays of the study period -----------------------------------------------
HOLIDAYS = {
    date(2025, 1, 1): "New Year's Day",
    date(2025, 1, 20): "MLK Day",
    date(2025, 2, 17): "Presidents' Day",
}
NO_HOLIDAY = "None"

# --- fixed values: hourly lags, rolling window and model inputs -------------------------------
LAG_HOURS = (1, 24, 48, 168)
ROLLING_HOURS = 24
ROLLING_MIN_OBSERVED = 18
CALENDAR_INPUTS = ("hour", "dow", "is_weekend")
NEXT_HOUR_INPUTS = CALENDAR_INPUTS + ("lag_1", "lag_24", "lag_48", "lag_168", "rolling_24")
DAY_AHEAD_INPUTS = CALENDAR_INPUTS + ("lag_24", "lag_48", "lag_168")

# --- fixed values: rankings --------------------------------------------------------------------
TOP_K = (5, 10, 20)
SUPPORT_THRESHOLDS = (500, 1000)
WEEKS_BACK = 4
MIN_HISTORY_DAYS = 28
BASELINES = ("global_popularity", "zone_hour_profile", "same_hour_last_week", "trailing_4_week_profile")
LEARNED = "learned_ranker"
RANKER_INPUTS = (
    "hour",
    "day_of_week",
    "is_weekend",
    "is_airport",
    "historical_trips",
    "historical_gross_spend",
    "historical_avg_spend_per_trip",
    "historical_avg_duration",
    "historical_distance",
    "matching_dow_hour_trips",
    "matching_dow_hour_spend",
    "same_hour_last_week_trips",
    "trailing_4_week_trips",
    "trailing_4_week_spend",
)

# --- fixed values: trip and spend weights of each driver objective ----------------------------
OBJECTIVES = {
    "Balanced": (0.50, 0.50),
    "More trips": (0.75, 0.25),
    "Higher-value trips": (0.25, 0.75),
}


@dataclass(frozen=True)
class CleaningLimits:
    """Bounds of the quality rules."""

    min_minutes: float = 1.0
    max_minutes: float = 180.0
    max_miles: float = 100.0
    max_fare: float = 500.0
    max_total: float = 1000.0


@dataclass(frozen=True)
class Fold:
    """One rolling-origin split: train before ``start``, test in [start, start + days)."""

    number: int
    start: date
    days: int = 7

    @property
    def end(self) -> date:
        return self.start + timedelta(days=self.days)


def folds_from(starts: list[date], days: int = 7) -> tuple[Fold, ...]:
    return tuple(Fold(i, start, days) for i, start in enumerate(starts, start=1))


STUDY_FOLDS = folds_from([date(2025, 2, 3), date(2025, 2, 17), date(2025, 3, 3), date(2025, 3, 17)])


@dataclass(frozen=True)
class StudyConfig:
    """Everything a run may want to change, in one place."""

    limits: CleaningLimits = field(default_factory=CleaningLimits)
    sentinels: dict[int, str] = field(default_factory=lambda: dict(SENTINEL_ZONES))
    airport_pattern: str = AIRPORT_PATTERN
    holidays: dict[date, str] = field(default_factory=lambda: dict(HOLIDAYS))
    folds: tuple[Fold, ...] = STUDY_FOLDS
    top_k: tuple[int, ...] = TOP_K
    support_thresholds: tuple[int, ...] = SUPPORT_THRESHOLDS
    min_history_days: int = MIN_HISTORY_DAYS
    forecast_iterations: int = 300
    ranker_iterations: int = 200
