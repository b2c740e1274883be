"""KPI, profile and series aggregates over clean trips.

Names and boroughs are joined after aggregation, and every ratio is a ratio of doubles. Tables of counts, sums and
averages take the trips themselves or their cube (:func:`demandspark.operators.measures.cube`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.config import CARD_PAYMENT, SENTINEL_ZONES
from demandspark.functions.columns import day_type, ratio, round_to, weekend_label
from demandspark.operators.measures import Measures
from demandspark.operators.medians import with_medians
from demandspark.operators.zones import join_lookup, label_zones


def _sum_ratio(m: Measures, numerator: str, denominator: str, digits: int = 2) -> Column:
    return round_to(ratio(m.total(numerator), m.total(denominator)), digits)


def card_tip_rate(m: Measures, digits: int = 4) -> Column:
    """Σ tips / Σ fares over card payments (a ratio of sums)."""
    card = F.col("payment_type") == CARD_PAYMENT
    return round_to(ratio(m.total("tip_amount", card, 0.0), m.total("fare_amount", card, 0.0)), digits)


def _days(date: Column) -> Column:
    """Distinct dates, at most those of the calendar, beside other aggregates without a second pass for the distinct."""
    return F.size(F.collect_set(date)).cast("long")


def kpis(trips: DataFrame) -> DataFrame:
    """One row of headline figures."""
    m = Measures(trips)
    joined = with_medians(
        trips,
        [],
        [
            m.trips().alias("trips"),
            _days(m.date).alias("active_days"),
            round_to(m.mean("trip_distance"), 2).alias("avg_trip_distance_miles"),
            round_to(m.mean("trip_duration_min"), 2).alias("avg_trip_duration_min"),
            round_to(m.mean("total_amount"), 2).alias("avg_gross_spend_per_trip"),
            round_to(m.total("total_amount"), 2).alias("gross_passenger_spend"),
            _sum_ratio(m, "total_amount", "trip_distance").alias("gross_spend_per_mile"),
            card_tip_rate(m).alias("card_tip_rate"),
        ],
        {
            "median_trip_distance_miles": "trip_distance",
            "median_trip_duration_min": "trip_duration_min",
            "median_gross_spend_per_trip": "total_amount",
        },
    )
    return joined.select(
        "trips",
        "active_days",
        "avg_trip_distance_miles",
        "median_trip_distance_miles",
        "avg_trip_duration_min",
        "median_trip_duration_min",
        "avg_gross_spend_per_trip",
        "median_gross_spend_per_trip",
        "gross_passenger_spend",
        "gross_spend_per_mile",
        "card_tip_rate",
    )


def kpis_monthly(trips: DataFrame) -> DataFrame:
    """Headline figures by month number (the same month of different years is one group)."""
    m = Measures(trips)
    joined = with_medians(
        trips,
        ["month"],
        [
            m.trips().alias("trips"),
            _days(m.date).alias("active_days"),
            round_to(m.mean("trip_distance"), 2).alias("avg_distance_miles"),
            round_to(m.mean("trip_duration_min"), 2).alias("avg_duration_min"),
            round_to(m.mean("total_amount"), 2).alias("avg_gross_spend"),
            round_to(m.total("total_amount"), 2).alias("gross_passenger_spend"),
            _sum_ratio(m, "total_amount", "trip_distance").alias("gross_spend_per_mile"),
            card_tip_rate(m).alias("card_tip_rate"),
            round_to(F.avg((F.col("cbd_congestion_fee") > 0).cast("int")), 4).alias("share_with_cbd_fee"),
        ],
        {
            "median_distance_miles": "trip_distance",
            "median_duration_min": "trip_duration_min",
            "median_gross_spend": "total_amount",
        },
    )
    per_day = round_to(ratio(F.col("trips"), F.col("active_days")), 0)
    return joined.select(
        "month",
        "trips",
        "active_days",
        per_day.alias("trips_per_day"),
        "avg_distance_miles",
        "median_distance_miles",
        "avg_duration_min",
        "median_duration_min",
        "avg_gross_spend",
        "median_gross_spend",
        "gross_passenger_spend",
        "gross_spend_per_mile",
        "card_tip_rate",
        "share_with_cbd_fee",
    )


def median_of_monthly_medians(monthly: DataFrame) -> DataFrame:
    """Middle of at most twelve monthly medians."""
    return monthly.agg(F.median("median_gross_spend").alias("median_spend_per_trip"))


def payment_analysis(trips: DataFrame) -> DataFrame:
    m = Measures(trips)
    return trips.groupBy("payment_type").agg(
        m.trips().alias("trips"),
        round_to(m.mean("total_amount"), 2).alias("avg_total_amount"),
        round_to(m.mean("tip_amount"), 2).alias("avg_tip_amount"),
        round_to(m.mean("tip_rate", F.col("payment_type") == CARD_PAYMENT), 4).alias("avg_card_tip_rate"),
    )


# ---------------------------------------------------------------- series


def hourly_timeseries(trips: DataFrame) -> DataFrame:
    m = Measures(trips)
    return trips.groupBy(m.date.alias("pickup_date"), m.hour.alias("pickup_hour")).agg(m.trips().alias("trips"))


def zone_hour_timeseries(
    trips: DataFrame, lookup: DataFrame, sentinels: Mapping[int, str] = SENTINEL_ZONES
) -> DataFrame:
    """Trips and spend per date, hour and zone: the input of every ranking operator."""
    m = Measures(trips)
    series = trips.groupBy(m.date.alias("pickup_date"), m.hour.alias("pickup_hour"), "PULocationID").agg(
        m.trips().alias("trips"),
        round_to(m.total("total_amount"), 2).alias("gross_passenger_spend"),
        round_to(m.mean("total_amount"), 2).alias("avg_gross_spend_per_trip"),
        _sum_ratio(m, "total_amount", "trip_duration_min", 4).alias("gross_spend_per_minute"),
        round_to(m.mean("trip_duration_min"), 2).alias("avg_trip_duration_min"),
        round_to(m.mean("trip_distance"), 2).alias("avg_trip_distance_miles"),
    )
    return label_zones(series, lookup, sentinels).select(
        "pickup_date",
        "pickup_hour",
        "PULocationID",
        "pickup_zone",
        "pickup_borough",
        "trips",
        "gross_passenger_spend",
        "avg_gross_spend_per_trip",
        "gross_spend_per_minute",
        "avg_trip_duration_min",
        "avg_trip_distance_miles",
    )


# ---------------------------------------------------------------- profiles


def hourly_profile(trips: DataFrame) -> DataFrame:
    """Average daily trips by hour and day type, over the dates seen in that very group."""
    hourly = hourly_timeseries(trips)  # (date, hour) is unique from here on
    grouped = hourly.groupBy("pickup_hour", day_type(F.col("pickup_date")).alias("day_type"))
    return grouped.agg(
        round_to(ratio(F.sum("trips"), F.count(F.lit(1))), 2).alias("avg_daily_trips")
    )


def hourly_demand(trips: DataFrame, lookup: DataFrame) -> DataFrame:
    """The same by borough and zone name as stored in the lookup.

    Several ids may share a name, so dates are made distinct per name after the join.
    """
    m = Measures(trips)
    by_id = trips.groupBy(m.date.alias("pickup_date"), m.hour.alias("pickup_hour"), "PULocationID").agg(
        m.trips().alias("trips")
    )
    named = join_lookup(by_id, lookup).groupBy("pickup_date", "pickup_hour", "lookup_borough", "lookup_zone")
    by_name = named.agg(F.sum("trips").alias("trips"))
    return by_name.groupBy(
        "pickup_hour",
        day_type(F.col("pickup_date")).alias("day_type"),
        F.col("lookup_borough").alias("pickup_borough"),
        F.col("lookup_zone").alias("pickup_zone"),
    ).agg(round_to(ratio(F.sum("trips"), F.count(F.lit(1))), 2).alias("avg_daily_trips"))


def zone_hour_profile(
    trips: DataFrame, lookup: DataFrame, sentinels: Mapping[int, str] = SENTINEL_ZONES
) -> DataFrame:
    """Average daily trips by hour, day type and zone, over all dates of that day type."""
    m = Measures(trips)
    days = trips.groupBy(m.weekend.alias("is_weekend")).agg(F.countDistinct(m.date).alias("n_days"))
    counts = trips.groupBy(m.weekend.alias("is_weekend"), m.hour.alias("hour"), "PULocationID").agg(
        m.trips().alias("trips")
    )
    # Two rows at most, one per value of the boolean key.
    averaged = counts.join(F.broadcast(days), "is_weekend")
    return label_zones(averaged, lookup, sentinels).select(
        "hour",
        weekend_label(F.col("is_weekend")).alias("day_type"),
        "PULocationID",
        "pickup_zone",
        "pickup_borough",
        round_to(ratio(F.col("trips"), F.col("n_days")), 2).alias("avg_daily_trips"),
    )


def zone_analysis(
    trips: DataFrame, lookup: DataFrame, sentinels: Mapping[int, str] = SENTINEL_ZONES
) -> DataFrame:
    m = Measures(trips)
    by_zone = trips.groupBy("PULocationID").agg(
        m.trips().alias("trips"),
        round_to(m.mean("trip_distance"), 2).alias("avg_trip_distance_miles"),
        round_to(m.mean("trip_duration_min"), 2).alias("avg_trip_duration_min"),
        round_to(m.mean("total_amount"), 2).alias("avg_gross_spend_per_trip"),
        round_to(m.total("total_amount"), 2).alias("gross_passenger_spend"),
        _sum_ratio(m, "total_amount", "trip_distance").alias("gross_spend_per_mile"),
    )
    return label_zones(by_zone, lookup, sentinels).select(
        "PULocationID",
        "pickup_zone",
        "pickup_borough",
        "trips",
        "avg_trip_distance_miles",
        "avg_trip_duration_min",
        "avg_gross_spend_per_trip",
        "gross_passenger_spend",
        "gross_spend_per_mile",
    )


def zone_hour_heatmap(trips: DataFrame, lookup: DataFrame) -> DataFrame:
    m = Measures(trips)
    by_id = trips.groupBy("PULocationID", m.hour.alias("hour")).agg(m.trips().alias("trips"))
    named = join_lookup(by_id, lookup)
    return named.groupBy(
        F.col("lookup_borough").alias("pickup_borough"), F.col("lookup_zone").alias("pickup_zone"), "hour"
    ).agg(F.sum("trips").alias("trips"))


# ---------------------------------------------------------------- documented measures


def daily_trips_revenue(trips: DataFrame) -> DataFrame:
    m = Measures(trips)
    return trips.groupBy(m.date.alias("pickup_date")).agg(
        m.trips().alias("trips"), round_to(m.total("total_amount"), 2).alias("revenue")
    )


def trips_by_hour(trips: DataFrame) -> DataFrame:
    m = Measures(trips)
    per_trip = round_to(ratio(m.total("total_amount"), m.trips()), 2)
    return trips.groupBy(m.hour.alias("hour")).agg(m.trips().alias("trips"), per_trip.alias("revenue_per_trip"))


def hour_dow_heatmap(trips: DataFrame) -> DataFrame:
    """One row per hour, one column per weekday."""
    m = Measures(trips)
    days = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    counts = [m.trips(F.weekday(m.date) == i).alias(name) for i, name in enumerate(days)]
    return trips.groupBy(m.hour.alias("hour")).agg(*counts)


def revenue_per_mile_by_zone(trips: DataFrame) -> DataFrame:
    """Zones with a trip of positive distance."""
    m = Measures(trips)
    moved = trips.filter(F.col("moved_distance" if m.summed else "trip_distance") > 0)
    return moved.groupBy("PULocationID").agg(round_to(m.moved_ratio(), 2).alias("revenue_per_mile"))


def duration_by_distance(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.floor("trip_distance").alias("distance_miles")).agg(
        F.count(F.lit(1)).alias("trips"), round_to(F.avg("trip_duration_min"), 2).alias("avg_duration_min")
    )


def duration_distance_correlation(trips: DataFrame) -> DataFrame:
    return trips.agg(round_to(F.corr("trip_distance", "trip_duration_min"), 6).alias("correlation"))


def payment_mix(trips: DataFrame) -> DataFrame:
    counts = trips.groupBy("payment_type").agg(Measures(trips).trips().alias("trips"))
    return counts.withColumn("trip_share", round_to(ratio(F.col("trips"), _overall("trips")), 6))


def _overall(column: str) -> Column:
    """Total over an already aggregated frame (one row per group, so one small partition)."""
    return F.sum(column).over(W.partitionBy(F.lit(0)))


def trip_cards(trips: DataFrame) -> DataFrame:
    m = Measures(trips)
    return trips.agg(
        m.trips().alias("trips"),
        round_to(m.total("total_amount"), 2).alias("revenue"),
        round_to(m.mean("fare_amount"), 2).alias("avg_fare"),
        round_to(m.mean("trip_duration_min"), 2).alias("avg_duration_min"),
        round_to(m.mean("trip_distance"), 2).alias("avg_distance_miles"),
    )


def record_cards(summary: DataFrame) -> DataFrame:
    """Raw, clean and excluded records over all files, with the shares."""
    return summary.agg(
        F.sum("raw_trip_count").alias("raw_records"),
        F.sum("clean_trip_count").alias("clean_records"),
        F.sum("total_excluded_trip_count").alias("excluded_records"),
        round_to(ratio(F.sum("clean_trip_count"), F.sum("raw_trip_count")), 6).alias("kept_share"),
        round_to(ratio(F.sum("total_excluded_trip_count"), F.sum("raw_trip_count")) * 100, 2).alias(
            "excluded_pct"
        ),
    )


# ---------------------------------------------------------------- reports over zone and month tables


def borough_share(zones: DataFrame) -> DataFrame:
    totals = zones.groupBy("pickup_borough").agg(
        F.sum("trips").alias("trips"), F.sum("gross_passenger_spend").alias("spend")
    )
    return totals.select(
        "pickup_borough",
        round_to(ratio(F.col("trips"), _overall("trips")), 6).alias("trip_share"),
        round_to(ratio(F.col("spend"), _overall("spend")), 6).alias("spend_share"),
    )


def pareto_zones(zones: DataFrame, share: float = 0.8, top: int = 10) -> DataFrame:
    """How many zones carry ``share`` of the trips, and what the ``top`` zones carry.

    Zones are counted by their trip total first: zones with equal totals are interchangeable for
    both figures, so the running sums go over distinct totals instead of single zones.
    """
    sizes = zones.groupBy("trips").agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy(F.lit(0))
    larger = everything.orderBy(F.desc("trips")).rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumns(
        {
            "total": F.sum(F.col("trips") * F.col("n")).over(everything),
            "zones_before": F.coalesce(F.sum("n").over(larger), F.lit(0)),
            "trips_before": F.coalesce(F.sum(F.col("trips") * F.col("n")).over(larger), F.lit(0)),
        }
    )
    # Of n zones with t trips each, the first j stay below the share while
    # (trips_before + j * t) / total < share.
    fitting = F.ceil((F.col("total") * share - F.col("trips_before")) / F.col("trips")) - 1
    below = F.least(F.col("n"), F.greatest(F.lit(0), fitting))
    in_top = F.least(F.col("n"), F.greatest(F.lit(0), top - F.col("zones_before")))
    return placed.agg(
        (F.sum(below) + 1).cast("bigint").alias("zones_for_share"),
        round_to(ratio(F.sum(in_top * F.col("trips")), F.max("total")), 6).alias("top_zones_share"),
    )


def monthly_activity(trips: DataFrame) -> DataFrame:
    """Trips per active day by month number: the part of :func:`kpis_monthly` that needs no medians."""
    m = Measures(trips)
    monthly = trips.groupBy(m.month.alias("month")).agg(
        m.trips().alias("trips"), F.countDistinct(m.date).alias("active_days")
    )
    return monthly.withColumn("trips_per_day", round_to(ratio(F.col("trips"), F.col("active_days")), 0))


def monthly_growth(monthly: DataFrame) -> DataFrame:
    """Trips per day of the last month against the first."""
    ends = monthly.agg(
        F.min_by("trips_per_day", "month").alias("first_trips_per_day"),
        F.max_by("trips_per_day", "month").alias("last_trips_per_day"),
    )
    growth = ratio(F.col("last_trips_per_day"), F.col("first_trips_per_day")) - 1
    return ends.withColumn("growth", round_to(growth, 6))


def filter_zones(
    zones: DataFrame, boroughs: list[str], min_trips: int, sort_by: str = "trips", limit: int = 25
) -> DataFrame:
    """The zone table of a chosen set of boroughs, largest first."""
    chosen = zones.filter(F.col("pickup_borough").isin(boroughs) & (F.col("trips") >= min_trips))
    return chosen.orderBy(F.desc(sort_by), "PULocationID").limit(limit)


def top_zones(zones: DataFrame, measure: str, n: int = 10) -> DataFrame:
    top = zones.orderBy(F.desc(measure), "PULocationID").limit(n)
    return top.select("PULocationID", "pickup_zone", "pickup_borough", measure)


def profile_by_day_type(profile: DataFrame) -> DataFrame:
    """Hourly profile with one column per day type."""
    wide = profile.groupBy("pickup_hour").pivot("day_type", ["Weekday", "Weekend"])
    return wide.agg(F.first("avg_daily_trips"))


def exclusion_months(failures: DataFrame) -> DataFrame:
    """Excluded records by first failing rule and month, with the rule's share of all exclusions."""
    excluded = failures.filter("first_failing_rule <> 'valid'").withColumn(
        "month", F.regexp_extract("file", r"(\d{4}-\d{2})", 1)
    )
    by_month = excluded.groupBy("first_failing_rule", "month").agg(F.sum("records").alias("records"))
    rule_total = F.sum("records").over(W.partitionBy("first_failing_rule"))
    return by_month.withColumn("rule_share", round_to(ratio(rule_total, _overall("records")), 6))


def exclusion_pivot(failures: DataFrame, months: list[str] | None = None) -> DataFrame:
    """The same with one column per month, by default of the data, zero where a rule never fired."""
    by_month = exclusion_months(failures)
    months = months or [r["month"] for r in by_month.select("month").distinct().orderBy("month").collect()]
    wide = by_month.groupBy("first_failing_rule", "rule_share").pivot("month", months)
    return wide.agg(F.sum("records")).na.fill(0, subset=months)


def exclusion_trend(failures: DataFrame, rule: str = "zero_or_negative_duration") -> DataFrame:
    """Records excluded by one rule in the first and the last month with any exclusion, zero where it never fired."""
    own = F.when(F.col("first_failing_rule") == rule, F.col("records")).otherwise(F.lit(0).cast("bigint"))
    by_month = exclusion_months(failures).groupBy("month").agg(F.sum(own).alias("records"))
    return by_month.agg(
        F.min_by("records", "month").alias("first_month_records"),
        F.max_by("records", "month").alias("last_month_records"),
    )
