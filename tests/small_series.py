"""A random little zone-hour series and a direct, loop-by-loop evaluation of it."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

from demandspark import schemas
from demandspark.config import folds_from

FIRST = date(2025, 1, 6)
FOLDS = folds_from([FIRST + timedelta(days=21), FIRST + timedelta(days=28), FIRST + timedelta(days=300)])
HOURS = (0, 9, 23)
AIRPORTS = {2, 7}
LATE_ZONE = 9  # first seen in the test week of the first fold


def make_rows(seed, days=36, zones=8, density=0.35):
    rng = random.Random(seed)
    rows = []
    for day in range(days):
        for hour in HOURS:
            if rng.random() < 0.1:
                continue  # an hour nobody was observed in
            for zone in [*range(1, zones + 1), LATE_ZONE]:
                if zone == LATE_ZONE and day < 23:
                    continue
                if rng.random() > density:
                    continue
                trips = rng.choice([1, 1, 2, 3])
                spend = rng.choice([0.0, 10.0, 10.0, round(rng.uniform(1, 90), 2)])
                if day == 25 and hour == 9:
                    spend = 0.0  # a test hour without any relevance
                name = "Grand AIRport" if zone in AIRPORTS else f"Zone {zone}"
                rows.append(
                    (FIRST + timedelta(days=day), hour, zone, name, "Borough", trips, spend, spend / trips, 1.0,
                     float(rng.randint(1, 60)), float(rng.randint(1, 20)))
                )
    return rows


def make_series(spark, rows):
    return spark.createDataFrame(rows, schemas.ZONE_HOUR_SERIES)


class Direct:
    """Everything by plain loops over one fold."""

    def __init__(self, rows, fold):
        self.fold = fold
        self.train = [r for r in rows if r[0] < fold.start]
        self.test = [r for r in rows if fold.start <= r[0] < fold.end]
        self.zones = sorted({r[2] for r in self.train})
        self.hours = sorted({r[:2] for r in self.test}) if self.train else []
        self.trips = defaultdict(int)
        self.cell = {}
        for r in self.train:
            self.trips[r[2]] += r[5]
            self.cell[r[:3]] = r
        self.airports = {r[2] for r in rows if "airport" in r[3].lower()}

    def score(self, baseline, day, hour, zone):
        if baseline == "global_popularity":
            return float(self.trips[zone])
        if baseline == "same_hour_last_week":
            row = self.cell.get((day - timedelta(7), hour, zone))
            return float(row[5]) if row else 0.0
        if baseline == "trailing_4_week_profile":
            rows = [self.cell.get((day - timedelta(7 * w), hour, zone)) for w in range(1, 5)]
            seen = [r[5] for r in rows if r]
            return sum(seen) / len(seen) if seen else 0.0
        same = [r for r in self.train if r[0].weekday() == day.weekday() and r[1] == hour]
        own = [r[5] for r in same if r[2] == zone]
        if baseline == "observed_mean":
            rows = [r[5] for r in self.train if r[2] == zone]
            return sum(own) / len(own) if own else sum(rows) / len(rows)
        if own:
            return sum(own) / len({r[0] for r in same})
        return self.trips[zone] / len({r[:2] for r in self.train})

    def members(self, scope):
        if scope == "Airport":
            return [z for z in self.zones if z in self.airports]
        if scope == "Non-airport":
            return [z for z in self.zones if z not in self.airports]
        if scope == "all":
            return self.zones
        return [z for z in self.zones if self.trips[z] >= int(scope)]

    def ranking(self, scope, baseline, day, hour, k=20):
        scored = [(-self.score(baseline, day, hour, z), z) for z in self.members(scope)]
        return [z for _, z in sorted(scored)][:k]

    def relevance(self, scope, day, hour):
        spend = defaultdict(float)
        for r in self.test:
            if r[:2] == (day, hour):
                spend[r[2]] += r[6]
        if scope == "Airport":
            return {z: s for z, s in spend.items() if z in self.airports}
        if scope == "Non-airport":
            return {z: s for z, s in spend.items() if z in self.zones and z not in self.airports}
        return dict(spend)

    def metrics(self, ranking, relevance, k):
        def gain(values):
            return sum(v / math.log2(place + 2) for place, v in enumerate(values))

        best = sorted(relevance, key=lambda z: (-relevance[z], z))[:k]
        ideal = gain([relevance[z] for z in best])
        hits = len(set(ranking[:k]) & set(best))
        return (
            gain([relevance.get(z, 0.0) for z in ranking[:k]]) / ideal if ideal else None,
            float(hits > 0) if best else None,
            hits / k if ranking else None,
        )

    def frozen(self, day, hour, zone):
        """The history part of the features at a test hour."""
        own = [r for r in self.train if r[2] == zone]
        slot = [r for r in own if r[0].weekday() == day.weekday() and r[1] == hour]
        weeks = [self.cell.get((day - timedelta(7 * w), hour, zone)) for w in range(1, 5)]
        return _features(own, slot, weeks[0], [(r[5], r[6]) for r in weeks if r])

    def as_of(self, day, hour, zone):
        """The same at a training hour: dense weeks count as zero, unobserved hours do not count."""
        own = [r for r in self.train if r[2] == zone and r[0] < day]
        slot = [r for r in own if r[0].weekday() == day.weekday() and r[1] == hour]
        observed = {r[:2] for r in self.train}
        weeks = []
        for w in range(1, 5):
            past = day - timedelta(7 * w)
            if (past, hour) in observed:
                row = self.cell.get((past, hour, zone))
                weeks.append((row[5], row[6]) if row else (0, 0.0))
        return _features(own, slot, self.cell.get((day - timedelta(7), hour, zone)), weeks)


def _features(own, slot, last_week, weeks):
    trips = sum(r[5] for r in own)

    def per_trip(total):
        return total / trips if trips else 0.0

    return {
        "historical_trips": trips,
        "historical_gross_spend": sum(r[6] for r in own),
        "historical_avg_spend_per_trip": per_trip(sum(r[6] for r in own)),
        "historical_avg_duration": per_trip(sum(r[9] * r[5] for r in own)),
        "historical_distance": per_trip(sum(r[10] * r[5] for r in own)),
        "matching_dow_hour_trips": sum(r[5] for r in slot),
        "matching_dow_hour_spend": sum(r[6] for r in slot),
        "same_hour_last_week_trips": last_week[5] if last_week else 0,
        "trailing_4_week_trips": sum(w[0] for w in weeks) / len(weeks) if weeks else 0.0,
        "trailing_4_week_spend": sum(w[1] for w in weeks) / len(weeks) if weeks else 0.0,
    }
