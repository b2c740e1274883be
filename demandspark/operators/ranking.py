"""Zone-ranking baselines over the zone-hour series, for all folds and test hours in one plan.

No frame of hours × zones is ever built.  A baseline gives an own score only to zones it has seen
in the slot in question (sparse rows); all other candidates keep a fallback score that is the same
in every hour of the fold.  The first k of such a group are among

* the k best sparse rows, and
* the first k candidates, in fallback order, that have no sparse row: the gaps between the fallback
  positions of the sparse rows.

Both come out of one window pass over the sparse rows, and the result is exactly the first k of the
full ranking.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.config import AIRPORT_PATTERN, BASELINES, TOP_K, WEEKS_BACK, Fold
from demandspark.functions.columns import contains_text, is_weekend, ratio, test_folds, training_folds
from demandspark.operators.positions import numbered
from demandspark.session import materialize

HOUR_KEY = ["fold", "test_date", "pickup_hour"]
GROUP = ["fold", "scope", "baseline", "test_date", "pickup_hour"]


@dataclass(frozen=True)
class Scope:
    """A subset of the candidates that is ranked on its own.

    Airport scopes also restrict the relevance they are judged by; support scopes do not.
    """

    name: str
    min_trips: int | None = None
    airport: bool | None = None

    def member(self, total_trips: Column, is_airport: Column) -> Column:
        if self.min_trips is not None:
            return total_trips >= self.min_trips
        if self.airport is not None:
            return is_airport if self.airport else ~is_airport
        return F.lit(True)

    @property
    def relevance(self) -> str:
        return EVERY_ZONE.name if self.airport is None else self.name


EVERY_ZONE = Scope("all")
AIRPORT_SCOPES = (Scope("Airport", airport=True), Scope("Non-airport", airport=False))


def support_scopes(thresholds: Iterable[int]) -> tuple[Scope, ...]:
    return tuple(Scope(str(t), min_trips=t) for t in thresholds)


@dataclass(frozen=True)
class RankingInput:
    """What every ranking operator reads.

    ``frame`` is the zone-hour series with its flags, ``calendar`` the observed hours of every fold
    (bounded by the study period), ``zones`` the candidate zones of every fold.
    """

    frame: DataFrame
    calendar: DataFrame
    zones: DataFrame
    folds: tuple[Fold, ...]


def ranking_input(
    series: DataFrame, folds: Sequence[Fold], airport_pattern: str = AIRPORT_PATTERN
) -> RankingInput:
    """Write the three tables once; all branches of a ranking plan then read them instead of trips."""
    frame = materialize(ranking_frame(series, airport_pattern), "zone-hour-series")
    calendar = materialize(fold_calendar(frame, folds), "fold-calendar")
    return RankingInput(frame, calendar, materialize(zone_totals(frame, folds), "fold-zones"), tuple(folds))


def ranking_frame(series: DataFrame, airport_pattern: str = AIRPORT_PATTERN) -> DataFrame:
    """The zone-hour series with the flags every ranking operator uses."""
    day = F.col("pickup_date")
    return series.withColumns(
        {
            "dow": F.weekday(day),
            "is_weekend": is_weekend(day),
            "is_airport": contains_text(F.col("pickup_zone"), airport_pattern),
        }
    )


def observed_hours(frame: DataFrame) -> DataFrame:
    """The distinct (date, hour) pairs: bounded by the calendar, not by the trips."""
    return frame.select("pickup_date", "pickup_hour").distinct()


def fold_calendar(frame: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Observed hours of every fold, marked ``tested`` or not; folds without training are left out."""
    day = F.col("pickup_date")
    hours = observed_hours(frame).withColumn("dow", F.weekday(day))
    trained = hours.select("*", F.inline(training_folds(day, folds)), F.lit(False).alias("tested"))
    tested = hours.select("*", F.inline(test_folds(day, folds)), F.lit(True).alias("tested"))
    first_day = frame.agg(F.min("pickup_date")).scalar()
    both = trained.unionByName(tested).filter(F.col("fold_start") > first_day)
    return both.select("fold", "tested", "pickup_date", "dow", "pickup_hour")


def frame_profile(data: RankingInput) -> DataFrame:
    """Date range, zones, and the train and test rows of each fold."""
    day = F.col("pickup_date")
    shared = [
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        F.countDistinct("PULocationID").alias("zones"),
    ]
    per_fold = [
        F.struct(
            F.lit(f.number).alias("fold"),
            F.count_if(day < F.lit(f.start)).alias("train_rows"),
            F.count_if((day >= F.lit(f.start)) & (day < F.lit(f.end))).alias("test_rows"),
        ).alias(f"_{f.number}")
        for f in data.folds
    ]
    row = data.frame.agg(*shared, *per_fold)
    split = F.inline(F.array(*[f"_{f.number}" for f in data.folds]))
    return row.select("first_date", "last_date", "zones", split)


def train_frame(data: RankingInput) -> DataFrame:
    """One copy of each row per fold that may train on it."""
    return data.frame.select("*", F.inline(training_folds(F.col("pickup_date"), data.folds)))


def train_slots(data: RankingInput) -> DataFrame:
    """Observed training dates of each (fold, weekday, hour)."""
    hours = data.calendar.filter(~F.col("tested"))
    return hours.groupBy("fold", "dow", "pickup_hour").agg(F.count(F.lit(1)).alias("n_slots"))


def train_hour_counts(data: RankingInput) -> DataFrame:
    hours = data.calendar.filter(~F.col("tested"))
    return hours.groupBy("fold").agg(F.count(F.lit(1)).alias("n_hours"))


def target_hours(data: RankingInput) -> DataFrame:
    """Observed test hours of every fold that has something to train on."""
    tested = data.calendar.filter("tested")
    return tested.select("fold", F.col("pickup_date").alias("test_date"), "pickup_hour", "dow")


def zone_totals(frame: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Per fold and candidate zone: training trips, observed rows, and the airport flag."""
    day, trips = F.col("pickup_date"), F.col("trips")
    zones = frame.groupBy("PULocationID").agg(
        F.bool_or("is_airport").alias("is_airport"),
        *[
            F.struct(
                F.lit(f.number).alias("fold"),
                F.sum(F.when(day < F.lit(f.start), trips)).alias("total_trips"),
                F.count_if(day < F.lit(f.start)).alias("observed_rows"),
            ).alias(f"_{f.number}")
            for f in folds
        ],
    )
    long = zones.select("PULocationID", "is_airport", F.inline(F.array(*[f"_{f.number}" for f in folds])))
    return long.filter("observed_rows > 0")


# ---------------------------------------------------------------- sparse scores


def profile_scores(data: RankingInput, variant: str = "slots") -> DataFrame:
    """Average trips per (fold, weekday, hour, zone).

    ``slots`` divides by the number of training dates that have the slot at all,
    ``observed_mean`` by the rows the zone itself has there.
    """
    grouped = train_frame(data).groupBy("fold", "dow", "pickup_hour", "PULocationID")
    sums = grouped.agg(F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("n_rows"))
    if variant == "observed_mean":
        return sums.withColumn("score", ratio(F.col("trips"), F.col("n_rows")))
    return sums.join(train_slots(data), ["fold", "dow", "pickup_hour"]).withColumn(
        "score", ratio(F.col("trips"), F.col("n_slots"))
    )


def weekly_scores(data: RankingInput, weeks: int = WEEKS_BACK) -> DataFrame:
    """What each zone did in the same hour one to four weeks before each test hour.

    Every row is sent forward to the dates it is a lag of, and one join keeps those that are test
    hours; only rows before the fold start count.
    """
    day = F.col("pickup_date")
    earliest = min(f.start for f in data.folds)
    latest = max(f.start for f in data.folds)
    recent = data.frame.filter((day >= F.date_sub(F.lit(earliest), 7 * weeks)) & (day < F.lit(latest)))
    sent = recent.select(
        day,
        "pickup_hour",
        "PULocationID",
        "trips",
        "gross_passenger_spend",
        F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("weeks_back"),
    ).withColumn("test_date", F.date_add("pickup_date", F.col("weeks_back") * 7))
    reached = sent.select("*", F.inline(test_folds(F.col("test_date"), data.folds)))
    usable = reached.filter(F.col("pickup_date") < F.col("fold_start"))
    matched = usable.join(target_hours(data), HOUR_KEY, "left_semi")
    return matched.groupBy(*HOUR_KEY, "PULocationID").agg(
        F.max(F.when(F.col("weeks_back") == 1, F.col("trips"))).alias("last_week_trips"),
        F.avg("trips").alias("trailing_trips"),
        F.avg("gross_passenger_spend").alias("trailing_spend"),
        F.max(F.when(F.col("weeks_back") == 1, F.col("pickup_date"))).alias("last_week_date"),
        F.max("pickup_date").alias("trailing_date"),
    )


def _named_score(baseline: str, score: Column) -> Column:
    return F.struct(F.lit(baseline).alias("baseline"), score.alias("score"))


def sparse_scores(data: RankingInput, variant: str = "slots") -> DataFrame:
    """Own scores of all baselines, long, at test-hour grain."""
    profile = profile_scores(data, variant).join(target_hours(data), ["fold", "dow", "pickup_hour"])
    weekly = weekly_scores(data).select(
        *HOUR_KEY,
        "PULocationID",
        F.inline(
            F.array(
                _named_score("same_hour_last_week", F.col("last_week_trips").cast("double")),
                _named_score("trailing_4_week_profile", F.col("trailing_trips")),
            )
        ),
    )
    columns = [*HOUR_KEY, "baseline", "PULocationID", "score"]
    return (
        profile.withColumn("baseline", F.lit("zone_hour_profile"))
        .select(*columns)
        .unionByName(weekly.filter("score IS NOT NULL").select(*columns))
    )


def candidates(data: RankingInput, scopes: Sequence[Scope], variant: str = "slots") -> DataFrame:
    """Candidate zones of each fold, scope and baseline with fallback score and position."""
    total = F.col("total_trips").cast("double")
    zones = data.zones.join(train_hour_counts(data), "fold")
    fallback = {
        "global_popularity": total,
        "zone_hour_profile": ratio(total, F.col("observed_rows" if variant == "observed_mean" else "n_hours")),
        "same_hour_last_week": F.lit(0.0),
        "trailing_4_week_profile": F.lit(0.0),
    }
    scoped = zones.select(
        "*",
        F.inline(
            F.filter(
                F.array(
                    *[
                        F.struct(
                            F.lit(s.name).alias("scope"),
                            s.member(F.col("total_trips"), F.col("is_airport")).alias("member"),
                        )
                        for s in scopes
                    ]
                ),
                lambda s: s["member"],
            )
        ),
    )
    scored = scoped.select(
        "fold",
        "scope",
        "PULocationID",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("baseline"), score.alias("fallback"))
                    for name, score in fallback.items()
                ]
            )
        ),
    )
    order = [F.desc("fallback"), F.col("PULocationID")]
    return numbered(scored, ["fold", "scope", "baseline"], order).withColumnRenamed("n_rows", "n_candidates")


# ---------------------------------------------------------------- ranking


def ranking_groups(hours: DataFrame, scopes: Sequence[Scope], baselines: Sequence[str]) -> DataFrame:
    """Every (test hour, scope, baseline) that gets a ranking, be it empty."""
    labels = [
        F.struct(
            F.lit(s.name).alias("scope"), F.lit(s.relevance).alias("relevance_scope"), F.lit(b).alias("baseline")
        )
        for s in scopes
        for b in baselines
    ]
    return hours.select(*HOUR_KEY, F.inline(F.array(*labels)))


def rank_baselines(
    data: RankingInput,
    scopes: Sequence[Scope] = (EVERY_ZONE,),
    k: int = max(TOP_K),
    variant: str = "slots",
) -> DataFrame:
    """The first ``k`` zones of every (fold, scope, baseline, test hour): score desc, zone asc."""
    pool = candidates(data, scopes, variant)
    own = sparse_scores(data, variant).join(pool.drop("fallback"), ["fold", "baseline", "PULocationID"])
    sizes = pool.filter("position = 1").select("fold", "scope", "baseline", "n_candidates")
    start = (
        ranking_groups(target_hours(data), scopes, BASELINES)
        .join(sizes, ["fold", "scope", "baseline"])
        .select(
            *GROUP,
            F.lit(0).alias("position"),
            "n_candidates",
            F.lit(None).cast("bigint").alias("PULocationID"),
            F.lit(None).cast("double").alias("score"),
        )
    )
    marks = own.select(*GROUP, "position", "n_candidates", "PULocationID", "score").unionByName(start)

    group = W.partitionBy(*GROUP)
    by_position = group.orderBy("position")
    by_score = group.orderBy(F.desc_nulls_last("score"), "PULocationID")
    placed = marks.withColumns(
        {
            "next_position": F.lead("position").over(by_position),
            "seen": F.row_number().over(by_position) - 1,
            "score_rank": F.row_number().over(by_score),
        }
    )
    position, seen = F.col("position"), F.col("seen")
    gap_end = F.coalesce(F.col("next_position"), F.col("n_candidates") + 1)
    wanted = F.least(gap_end - position - 1, F.lit(k) - (position - seen))
    zone = F.col("PULocationID")
    no_entry = F.array().cast("array<struct<zone:bigint,score:double,position:bigint>>")
    own_entry = F.array(
        F.struct(zone.cast("bigint").alias("zone"), F.col("score"), F.lit(None).cast("bigint").alias("position"))
    )
    gap_entries = F.transform(
        F.sequence(position + 1, position + F.greatest(wanted, F.lit(1))),
        lambda p: F.struct(
            F.lit(None).cast("bigint").alias("zone"), F.lit(None).cast("double").alias("score"), p.alias("position")
        ),
    )
    entries = F.concat(
        F.when(zone.isNotNull() & (F.col("score_rank") <= k), own_entry).otherwise(no_entry),
        F.when(wanted > 0, gap_entries).otherwise(no_entry),
    )
    shortlist = placed.select(*GROUP, F.inline(entries))
    by_place = pool.select("fold", "scope", "baseline", "position", "PULocationID", "fallback")
    resolved = shortlist.join(by_place, ["fold", "scope", "baseline", "position"], "left").select(
        *GROUP,
        F.coalesce("zone", "PULocationID").alias("PULocationID"),
        F.coalesce("score", "fallback").alias("score"),
    )
    return top_ranked(resolved, GROUP, "score", k)


def top_ranked(scored: DataFrame, keys: Sequence[str], score: str, k: int) -> DataFrame:
    """``rank`` 1..k per group, score desc, ties to the smaller zone id."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), "PULocationID")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
