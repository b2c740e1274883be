"""The expected results as DuckDB SQL over the same tables.

Statements are composed of named common table expressions.  Where the Spark plan takes a sparse or
incremental route, the statement here takes the direct dense one, so the two can disagree.
"""

from __future__ import annotations


KS = (5, 10, 20)
MONTHS = [f"{year}-{month:02d}" for year in range(1995, 2002) for month in range(1, 13)]  # of the shipment files
MONDAY_FIRST = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def rnd(expr: str, digits: int) -> str:
    value = f"CAST({expr} AS DOUBLE)"
    return f"round(CASE WHEN abs({value}) < 2::DOUBLE ** 53 / 1e11 THEN round({value}, 11) ELSE {value} END, {digits})"


def div(numerator: str, denominator: str) -> str:
    return f"(CAST({numerator} AS DOUBLE) / nullif(CAST({denominator} AS DOUBLE), 0))"


_RULES = [
    ("missing_dropoff_datetime", "dropoff_datetime IS NULL"),
    ("missing_location", "PULocationID IS NULL OR DOLocationID IS NULL"),
    ("zero_or_negative_duration", "trip_duration_min <= 0"),
    ("short_duration_under_1_min", "trip_duration_min > 0 AND trip_duration_min < 1"),
    ("long_duration_over_180_min", "trip_duration_min > 180"),
    ("zero_distance", "trip_distance <= 0"),
    ("distance_over_100_miles", "trip_distance > 100"),
    ("negative_fare", "fare_amount < 0"),
    ("fare_over_500", "fare_amount > 500"),
    ("negative_total_amount", "total_amount < 0"),
    ("total_amount_over_1000", "total_amount > 1000"),
]
_FIRST = "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in _RULES) + " ELSE 'valid' END"

_EVENT_TRIPS = """
  SELECT ts AS pickup_datetime,
         CASE WHEN event_id % 997 <> 0 THEN ts + to_seconds(k * 114 - 57) END AS dropoff_datetime,
         CAST(event_id % 103 AS DOUBLE) AS trip_distance,
         CASE WHEN event_id % 499 <> 0 THEN user_id END AS PULocationID,
         event_id % 263 AS DOLocationID,
         CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2
                              WHEN 'click' THEN 3 ELSE 4 END AS BIGINT) AS payment_type,
         value - 1.0 AS fare_amount, value * 0.1 AS tip_amount, value * 1.2 - 2.0 AS total_amount,
         CAST(CASE WHEN event_id % 4 = 0 THEN 0.75 WHEN event_id % 4 < 3 THEN 0.0 END AS DOUBLE) AS cbd_congestion_fee,
         'events_2024-01.parquet' AS file
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"""

_SHIPMENT_TRIPS = """
  SELECT start_ts AS pickup_datetime,
         CASE WHEN l_partkey % 97 <> 0
              THEN start_ts + to_minutes(CAST(l_quantity AS INTEGER) * 4 - 6) END AS dropoff_datetime,
         l_quantity - l_linenumber AS trip_distance,
         l_suppkey AS PULocationID,
         CASE WHEN l_partkey % 89 <> 0 THEN l_partkey % 263 END AS DOLocationID,
         CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS BIGINT) AS payment_type,
         fare AS fare_amount, fare * l_discount AS tip_amount, fare * (1 + l_tax) - 1.0 AS total_amount,
         CAST(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber > 3 THEN 0.75 ELSE 0.0 END AS DOUBLE)
           AS cbd_congestion_fee,
         'shipments_' || strftime(CASE WHEN l_partkey % 50 = 0 THEN l_shipdate + INTERVAL 1 MONTH
                                       ELSE l_shipdate END, '%Y-%m') || '.parquet' AS file
  FROM (SELECT *, l_shipdate + to_minutes(CAST(l_orderkey % 1440 AS INTEGER)) AS start_ts,
               l_extendedprice / 200 - l_quantity / 4 AS fare
        FROM lineitem)"""


def _flagged(source: str, start: str, end: str) -> str:
    timed = f"""SELECT *, coalesce(pickup_datetime >= {start} AND pickup_datetime < {end}, false) AS inside,
                       date_diff('microsecond', pickup_datetime, dropoff_datetime) / 6e7 AS trip_duration_min
                FROM {source}"""
    return f"SELECT *, CASE WHEN inside THEN {_FIRST} END AS first_rule FROM ({timed})"


def _clean(source: str) -> str:
    return f"""
  SELECT pickup_datetime, dropoff_datetime, trip_distance, PULocationID, DOLocationID, payment_type,
         fare_amount, tip_amount, total_amount, cbd_congestion_fee, file, trip_duration_min,
         CAST(CAST(pickup_datetime AS DATE) AS TIMESTAMP) AS date,
         CAST(hour(pickup_datetime) AS INTEGER) AS hour,
         dayname(pickup_datetime) AS day_of_week,
         CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS day_of_week_num,
         isodow(pickup_datetime) >= 6 AS is_weekend,
         CAST(month(pickup_datetime) AS INTEGER) AS month,
         total_amount / nullif(trip_distance, 0) AS revenue_per_mile,
         tip_amount / nullif(fare_amount, 0) AS tip_rate
  FROM {source} WHERE inside AND first_rule = 'valid'"""


_FILE_MONTH = "CAST(regexp_extract(file, '_(\\d{4}-\\d{2})', 1) || '-01' AS DATE)"
_ZONES = """
  SELECT {key} AS LocationID, r_name AS Borough, {name} AS Zone
  FROM {source} JOIN nation ON {nation} = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_DAY_TYPE = "CASE WHEN isodow({0}) >= 6 THEN 'Weekend' ELSE 'Weekday' END"
_NAMED_ZONE = "CASE {0} WHEN 3 THEN 'Unknown' WHEN 4 THEN 'Outside NYC' ELSE coalesce(Zone, 'Unknown') END"
_NAMED_BOROUGH = "CASE WHEN {0} IN (3, 4) THEN 'Unknown' ELSE coalesce(Borough, 'Unknown') END"
_BLOCK = """CASE WHEN pickup_hour < 6 THEN 'Overnight' WHEN pickup_hour < 10 THEN 'Morning'
                 WHEN pickup_hour < 16 THEN 'Midday' WHEN pickup_hour < 21 THEN 'Evening'
                 ELSE 'Late evening' END"""


def _zone_table(trips: str, zones: str) -> str:
    return f"""
  SELECT PULocationID, {_NAMED_ZONE.format('PULocationID')} AS pickup_zone,
         {_NAMED_BOROUGH.format('PULocationID')} AS pickup_borough,
         count(*) AS trips,
         {rnd('avg(trip_distance)', 2)} AS avg_trip_distance_miles,
         {rnd('avg(trip_duration_min)', 2)} AS avg_trip_duration_min,
         {rnd('avg(total_amount)', 2)} AS avg_gross_spend_per_trip,
         {rnd('sum(total_amount)', 2)} AS gross_passenger_spend,
         {rnd(div('sum(total_amount)', 'sum(trip_distance)'), 2)} AS gross_spend_per_mile
  FROM {trips} LEFT JOIN {zones} ON PULocationID = LocationID GROUP BY ALL"""


def _pivot_metrics() -> str:
    parts = []
    for k in KS:
        parts.append(f"coalesce(p.dcg_{k}, 0) / nullif(i.ideal_{k}, 0) AS ndcg_at_{k}")
        parts.append(
            f"CASE WHEN i.ideal_{k} IS NOT NULL THEN CAST(coalesce(p.hits_{k}, 0) > 0 AS INT)::DOUBLE END AS hit_rate_at_{k}"
        )
        parts.append(f"CAST(p.hits_{k} AS DOUBLE) / {k} AS precision_at_{k}")
    return ",\n         ".join(parts)


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "event_trips": (_EVENT_TRIPS, ()),
    "audit_flags": (_flagged("event_trips", "DATE '2024-01-03'", "DATE '2024-01-30'"), ("event_trips",)),
    "month_flags": (_flagged("event_trips", "DATE '2024-01-01'", "DATE '2024-02-01'"), ("event_trips",)),
    "trips": (_clean("month_flags"), ("month_flags",)),
    "shipment_trips": (_SHIPMENT_TRIPS, ()),
    "shipment_flags": (
        _flagged("shipment_trips", _FILE_MONTH, f"{_FILE_MONTH} + INTERVAL 1 MONTH"),
        ("shipment_trips",),
    ),
    "shipments": (_clean("shipment_flags"), ("shipment_flags",)),
    "czones": (_ZONES.format(source="customer", key="c_custkey", name="c_name", nation="c_nationkey"), ()),
    "szones": (_ZONES.format(source="supplier", key="s_suppkey", name="s_name", nation="s_nationkey"), ()),
    "zone_table": (_zone_table("trips", "czones"), ("trips", "czones")),
    "monthly": (
        f"""
  SELECT month, count(*) AS trips, count(DISTINCT CAST(pickup_datetime AS DATE)) AS active_days,
         {rnd('CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(pickup_datetime AS DATE))', 0)} AS trips_per_day,
         {rnd('avg(trip_distance)', 2)} AS avg_distance_miles,
         {rnd('median(trip_distance)', 2)} AS median_distance_miles,
         {rnd('avg(trip_duration_min)', 2)} AS avg_duration_min,
         {rnd('median(trip_duration_min)', 2)} AS median_duration_min,
         {rnd('avg(total_amount)', 2)} AS avg_gross_spend,
         {rnd('median(total_amount)', 2)} AS median_gross_spend,
         {rnd('sum(total_amount)', 2)} AS gross_passenger_spend,
         {rnd(div('sum(total_amount)', 'sum(trip_distance)'), 2)} AS gross_spend_per_mile,
         {rnd(div('sum(tip_amount) FILTER (payment_type = 1)', 'sum(fare_amount) FILTER (payment_type = 1)'), 4)}
           AS card_tip_rate,
         {rnd('avg((cbd_congestion_fee > 0)::INT)', 4)} AS share_with_cbd_fee
  FROM shipments GROUP BY month""",
        ("shipments",),
    ),
    "zone_profile": (
        f"""
  SELECT c.hour, CASE WHEN c.is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type, c.PULocationID,
         {_NAMED_ZONE.format('c.PULocationID')} AS pickup_zone,
         {_NAMED_BOROUGH.format('c.PULocationID')} AS pickup_borough,
         {rnd('CAST(c.trips AS DOUBLE) / n_days', 2)} AS avg_daily_trips
  FROM (SELECT is_weekend, hour, PULocationID, count(*) AS trips FROM trips GROUP BY ALL) c
  JOIN (SELECT is_weekend, count(DISTINCT date) AS n_days FROM trips GROUP BY ALL) d USING (is_weekend)
  LEFT JOIN czones ON c.PULocationID = LocationID""",
        ("trips", "czones"),
    ),
    "series": (
        f"""
  SELECT CAST(pickup_datetime AS DATE) AS pickup_date, hour AS pickup_hour, PULocationID,
         {_NAMED_ZONE.format('PULocationID')} AS pickup_zone,
         {_NAMED_BOROUGH.format('PULocationID')} AS pickup_borough,
         count(*) AS trips,
         {rnd('sum(total_amount)', 2)} AS gross_passenger_spend,
         {rnd('avg(total_amount)', 2)} AS avg_gross_spend_per_trip,
         {rnd(div('sum(total_amount)', 'sum(trip_duration_min)'), 4)} AS gross_spend_per_minute,
         {rnd('avg(trip_duration_min)', 2)} AS avg_trip_duration_min,
         {rnd('avg(trip_distance)', 2)} AS avg_trip_distance_miles
  FROM trips LEFT JOIN czones ON PULocationID = LocationID GROUP BY ALL""",
        ("trips", "czones"),
    ),
    # ------------------------------------------------------------ hourly forecasting
    "hourly": (
        "SELECT CAST(pickup_datetime AS DATE) AS pickup_date, hour AS pickup_hour, count(*) AS trips FROM trips GROUP BY ALL",
        ("trips",),
    ),
    "dense": (
        """
  SELECT h AS timestamp, trips
  FROM (SELECT unnest(generate_series(min(pickup_date + to_hours(pickup_hour)),
                                      max(pickup_date + to_hours(pickup_hour)), INTERVAL 1 HOUR)) AS h FROM hourly)
  LEFT JOIN hourly ON h = pickup_date + to_hours(pickup_hour)""",
        ("hourly",),
    ),
    "lagged": (
        """
  SELECT d.timestamp, d.trips, CAST(hour(d.timestamp) AS INTEGER) AS hour,
         CAST(isodow(d.timestamp) - 1 AS INTEGER) AS dow,
         CAST(isodow(d.timestamp) >= 6 AS INTEGER) AS is_weekend, CAST(d.timestamp AS DATE) AS date,
         CASE CAST(d.timestamp AS DATE) WHEN DATE '2024-01-01' THEN 'New Year''s Day'
                                        WHEN DATE '2024-01-15' THEN 'MLK Day' ELSE 'None' END AS holiday,
         a.trips AS lag_1, b.trips AS lag_24, c.trips AS lag_48, e.trips AS lag_168,
         (SELECT CASE WHEN count(p.trips) >= 18 THEN avg(p.trips) END FROM dense p
          WHERE p.timestamp >= d.timestamp - INTERVAL 24 HOUR AND p.timestamp < d.timestamp) AS rolling_24
  FROM dense d
  LEFT JOIN dense a ON a.timestamp = d.timestamp - INTERVAL 1 HOUR
  LEFT JOIN dense b ON b.timestamp = d.timestamp - INTERVAL 24 HOUR
  LEFT JOIN dense c ON c.timestamp = d.timestamp - INTERVAL 48 HOUR
  LEFT JOIN dense e ON e.timestamp = d.timestamp - INTERVAL 168 HOUR""",
        ("dense",),
    ),
    "folds": (
        """
  SELECT CAST(fold AS INTEGER) AS fold, fold_start, CAST(fold_start + 7 AS DATE) AS fold_end
  FROM (VALUES (1, DATE '2024-01-15'), (2, DATE '2024-01-22')) v(fold, fold_start)""",
        (),
    ),
    "usable": (
        """
  SELECT l.*, f.fold, f.fold_start,
         trips + lag_1 + lag_24 + lag_48 + lag_168 + rolling_24 IS NOT NULL AS next_ok,
         trips + lag_24 + lag_48 + lag_168 IS NOT NULL AS day_ok,
         l.timestamp >= f.fold_start AS tested
  FROM lagged l JOIN folds f ON l.timestamp < f.fold_end""",
        ("lagged", "folds"),
    ),
    "naive": (
        """
  SELECT timestamp, date, hour, CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type,
         holiday, fold, model, CAST(trips AS DOUBLE) AS actual_trips, CAST(guess AS DOUBLE) AS predicted_trips
  FROM (SELECT *, 'baseline_lag1' AS model, lag_1 AS guess FROM usable WHERE tested AND next_ok
        UNION ALL SELECT *, 'baseline_lag24', lag_24 FROM usable WHERE tested AND day_ok
        UNION ALL SELECT *, 'baseline_lag168', lag_168 FROM usable WHERE tested AND day_ok)""",
        ("usable",),
    ),
    "matched": (
        """
  SELECT * FROM naive WHERE timestamp IN
    (SELECT timestamp FROM naive GROUP BY timestamp HAVING count(DISTINCT model) = 3)""",
        ("naive",),
    ),
    # ------------------------------------------------------------ rankings
    "frame": (
        """
  SELECT *, CAST(isodow(pickup_date) - 1 AS INTEGER) AS dow, isodow(pickup_date) >= 6 AS is_weekend,
         coalesce(contains(lower(pickup_zone), '7'), false) AS is_airport FROM series""",
        ("series",),
    ),
    "train": (
        "SELECT s.*, f.fold, f.fold_start FROM frame s JOIN folds f ON s.pickup_date < f.fold_start",
        ("frame", "folds"),
    ),
    "test_hours": (
        """
  SELECT DISTINCT f.fold, s.pickup_date AS test_date, s.pickup_hour
  FROM frame s JOIN folds f ON s.pickup_date >= f.fold_start AND s.pickup_date < f.fold_end""",
        ("frame", "folds"),
    ),
    "slots": (
        "SELECT fold, dow, pickup_hour, count(DISTINCT pickup_date) AS n_slots FROM train GROUP BY ALL",
        ("train",),
    ),
    "cand": (
        """
  SELECT fold, PULocationID, sum(trips)::BIGINT AS total_trips, count(*) AS observed_rows,
         PULocationID IN (SELECT PULocationID FROM frame WHERE is_airport) AS is_airport
  FROM train GROUP BY fold, PULocationID""",
        ("train", "frame"),
    ),
    "profile": (
        """
  SELECT t.fold, t.dow, t.pickup_hour, t.PULocationID, sum(t.trips)::BIGINT AS trips, count(*) AS n_rows,
         any_value(n_slots) AS n_slots, CAST(sum(t.trips) AS DOUBLE) / any_value(n_slots) AS score
  FROM train t JOIN slots USING (fold, dow, pickup_hour) GROUP BY ALL""",
        ("train", "slots"),
    ),
    "weekly": (
        """
  SELECT h.fold, h.test_date, h.pickup_hour, t.PULocationID,
         max(t.trips) FILTER (t.pickup_date = h.test_date - 7) AS last_week_trips,
         avg(t.trips) AS trailing_trips, avg(t.gross_passenger_spend) AS trailing_spend,
         max(t.pickup_date) FILTER (t.pickup_date = h.test_date - 7) AS last_week_date,
         max(t.pickup_date) AS trailing_date
  FROM test_hours h JOIN train t ON t.fold = h.fold AND t.pickup_hour = h.pickup_hour
   AND t.pickup_date IN (h.test_date - 7, h.test_date - 14, h.test_date - 21, h.test_date - 28)
  GROUP BY ALL""",
        ("test_hours", "train"),
    ),
    "scored": (
        """
  SELECT h.fold, h.test_date, h.pickup_hour, c.PULocationID, c.total_trips, c.is_airport,
         CAST(c.total_trips AS DOUBLE) AS global_popularity,
         coalesce(p.score, c.total_trips / CAST(n.n_hours AS DOUBLE)) AS zone_hour_profile,
         coalesce(p.trips / CAST(p.n_rows AS DOUBLE), c.total_trips / CAST(c.observed_rows AS DOUBLE)) AS observed_mean,
         coalesce(CAST(w.last_week_trips AS DOUBLE), 0.0) AS same_hour_last_week,
         coalesce(w.trailing_trips, 0.0) AS trailing_4_week_profile
  FROM test_hours h
  JOIN cand c USING (fold)
  JOIN (SELECT fold, count(DISTINCT (pickup_date, pickup_hour)) AS n_hours FROM train GROUP BY fold) n USING (fold)
  LEFT JOIN profile p ON p.fold = h.fold AND p.dow = isodow(h.test_date) - 1
    AND p.pickup_hour = h.pickup_hour AND p.PULocationID = c.PULocationID
  LEFT JOIN weekly w ON w.fold = h.fold AND w.test_date = h.test_date
    AND w.pickup_hour = h.pickup_hour AND w.PULocationID = c.PULocationID""",
        ("test_hours", "cand", "train", "profile", "weekly"),
    ),
    "long_scores": (
        """
  SELECT fold, test_date, pickup_hour, PULocationID, total_trips, is_airport, baseline, score FROM scored
  UNPIVOT (score FOR baseline IN (global_popularity, zone_hour_profile, same_hour_last_week, trailing_4_week_profile))""",
        ("scored",),
    ),
    "scoped": (
        """
  SELECT *, 'all' AS scope, 'all' AS relevance_scope FROM long_scores
  UNION ALL SELECT *, '25', 'all' FROM long_scores WHERE total_trips >= 25
  UNION ALL SELECT *, '30', 'all' FROM long_scores WHERE total_trips >= 30
  UNION ALL SELECT *, 'Airport', 'Airport' FROM long_scores WHERE is_airport
  UNION ALL SELECT *, 'Non-airport', 'Non-airport' FROM long_scores WHERE NOT is_airport""",
        ("long_scores",),
    ),
    "ranked": (
        """
  SELECT *, row_number() OVER (PARTITION BY scope, fold, baseline, test_date, pickup_hour
                               ORDER BY score DESC, PULocationID) AS rank
  FROM scoped QUALIFY rank <= 20""",
        ("scoped",),
    ),
    "actual_all": (
        """
  SELECT h.fold, h.test_date, h.pickup_hour, s.PULocationID, s.gross_passenger_spend AS spend, s.pickup_zone,
         s.pickup_borough, s.is_airport, c.PULocationID IS NOT NULL AS known
  FROM test_hours h JOIN frame s ON s.pickup_date = h.test_date AND s.pickup_hour = h.pickup_hour
  LEFT JOIN cand c ON c.fold = h.fold AND c.PULocationID = s.PULocationID""",
        ("test_hours", "frame", "cand"),
    ),
    "actual": (
        """
  SELECT *, row_number() OVER (PARTITION BY relevance_scope, fold, test_date, pickup_hour
                               ORDER BY spend DESC, PULocationID) AS actual_rank
  FROM (SELECT *, 'all' AS relevance_scope FROM actual_all
        UNION ALL SELECT *, 'Airport' FROM actual_all WHERE is_airport
        UNION ALL SELECT *, 'Non-airport' FROM actual_all WHERE NOT is_airport AND known)""",
        ("actual_all",),
    ),
    "all_metrics": (
        f"""
  SELECT g.fold, g.test_date, g.pickup_hour, dayname(g.test_date) AS day_of_week, g.scope, g.baseline,
         {_BLOCK.replace('pickup_hour', 'g.pickup_hour')} AS time_block,
         {_DAY_TYPE.format('g.test_date')} AS day_type,
         {_pivot_metrics()}
  FROM (SELECT h.*, scope, relevance_scope, baseline FROM test_hours h
        CROSS JOIN (VALUES ('all', 'all'), ('25', 'all'), ('30', 'all'), ('Airport', 'Airport'),
                           ('Non-airport', 'Non-airport')) s(scope, relevance_scope)
        CROSS JOIN (VALUES ('global_popularity'), ('zone_hour_profile'), ('same_hour_last_week'),
                           ('trailing_4_week_profile')) b(baseline)) g
  LEFT JOIN (SELECT r.fold, r.test_date, r.pickup_hour, r.scope, r.baseline,
                    {", ".join(f"sum(CASE WHEN rank <= {k} THEN coalesce(spend, 0) / log2(rank + 1) ELSE 0 END) AS dcg_{k}, count(*) FILTER (rank <= {k} AND actual_rank <= {k}) AS hits_{k}" for k in KS)}
             FROM ranked r LEFT JOIN actual a ON a.relevance_scope = r.relevance_scope AND a.fold = r.fold
               AND a.test_date = r.test_date AND a.pickup_hour = r.pickup_hour AND a.PULocationID = r.PULocationID
             GROUP BY ALL) p
    ON p.fold = g.fold AND p.test_date = g.test_date AND p.pickup_hour = g.pickup_hour
   AND p.scope = g.scope AND p.baseline = g.baseline
  LEFT JOIN (SELECT relevance_scope, fold, test_date, pickup_hour,
                    {", ".join(f"sum(CASE WHEN actual_rank <= {k} THEN spend / log2(actual_rank + 1) ELSE 0 END) AS ideal_{k}" for k in KS)}
             FROM actual GROUP BY ALL) i
    ON i.relevance_scope = g.relevance_scope AND i.fold = g.fold AND i.test_date = g.test_date
   AND i.pickup_hour = g.pickup_hour""",
        ("test_hours", "ranked", "actual"),
    ),
    "metrics": ("SELECT * EXCLUDE (scope) FROM all_metrics WHERE scope = 'all'", ("all_metrics",)),
    "predictions": (
        """
  SELECT r.fold, r.test_date, CAST(r.pickup_hour AS INTEGER) AS pickup_hour, dayname(r.test_date) AS day_of_week,
         r.baseline, CAST(r.rank AS INTEGER) AS rank, r.PULocationID,
         coalesce(a.pickup_zone, 'Unknown') AS pickup_zone, coalesce(a.pickup_borough, 'Unknown') AS pickup_borough,
         coalesce(a.spend, 0.0) AS actual_gross_passenger_spend,
         CAST(CASE WHEN a.actual_rank <= 20 THEN a.actual_rank END AS INTEGER) AS actual_rank_top20
  FROM ranked r LEFT JOIN actual a ON a.relevance_scope = 'all' AND a.fold = r.fold
    AND a.test_date = r.test_date AND a.pickup_hour = r.pickup_hour AND a.PULocationID = r.PULocationID
  WHERE r.scope = 'all'""",
        ("ranked", "actual"),
    ),
    # ------------------------------------------------------------ features
    "panel_base": (
        """
  SELECT f.fold, c.PULocationID, d.pickup_date, d.pickup_hour, c.is_airport,
         coalesce(s.trips, 0) AS trips, coalesce(s.gross_passenger_spend, 0) AS spend,
         coalesce(s.trips * s.avg_trip_duration_min, 0) AS minutes,
         coalesce(s.trips * s.avg_trip_distance_miles, 0) AS miles
  FROM folds f JOIN cand c USING (fold)
  JOIN (SELECT DISTINCT pickup_date, pickup_hour FROM frame) d ON d.pickup_date < f.fold_start
  LEFT JOIN frame s ON s.PULocationID = c.PULocationID AND s.pickup_date = d.pickup_date
   AND s.pickup_hour = d.pickup_hour""",
        ("folds", "cand", "frame"),
    ),
    "panel_daily": (
        """
  SELECT *, sum(trips) OVER w - trips AS prior_trips, sum(spend) OVER w - spend AS prior_spend,
         sum(minutes) OVER w - minutes AS prior_minutes, sum(miles) OVER w - miles AS prior_miles,
         lag(pickup_date) OVER w AS last_daily_date
  FROM (SELECT fold, PULocationID, pickup_date, sum(trips) AS trips, sum(spend) AS spend,
               sum(minutes) AS minutes, sum(miles) AS miles FROM panel_base GROUP BY ALL)
  WINDOW w AS (PARTITION BY fold, PULocationID ORDER BY pickup_date)""",
        ("panel_base",),
    ),
    "panel": (
        """
  SELECT b.*, d.prior_trips, d.prior_spend, d.prior_minutes, d.prior_miles, d.last_daily_date,
         lag(b.pickup_date) OVER s AS last_slot_date, l1.pickup_date AS last_week_date,
         greatest(l1.pickup_date, l2.pickup_date, l3.pickup_date, l4.pickup_date) AS last_trailing_date,
         sum(b.trips) OVER s - b.trips AS slot_trips, sum(b.spend) OVER s - b.spend AS slot_spend,
         l1.trips AS week_1, list_avg([l1.trips, l2.trips, l3.trips, l4.trips]) AS mean_trips,
         list_avg([l1.spend, l2.spend, l3.spend, l4.spend]) AS mean_spend
  FROM panel_base b
  JOIN panel_daily d USING (fold, PULocationID, pickup_date)
  LEFT JOIN panel_base l1 ON l1.fold = b.fold AND l1.PULocationID = b.PULocationID AND l1.pickup_hour = b.pickup_hour AND l1.pickup_date = b.pickup_date - 7
  LEFT JOIN panel_base l2 ON l2.fold = b.fold AND l2.PULocationID = b.PULocationID AND l2.pickup_hour = b.pickup_hour AND l2.pickup_date = b.pickup_date - 14
  LEFT JOIN panel_base l3 ON l3.fold = b.fold AND l3.PULocationID = b.PULocationID AND l3.pickup_hour = b.pickup_hour AND l3.pickup_date = b.pickup_date - 21
  LEFT JOIN panel_base l4 ON l4.fold = b.fold AND l4.PULocationID = b.PULocationID AND l4.pickup_hour = b.pickup_hour AND l4.pickup_date = b.pickup_date - 28
  WINDOW s AS (PARTITION BY b.fold, b.PULocationID, b.pickup_hour, isodow(b.pickup_date) ORDER BY b.pickup_date)
  QUALIFY b.pickup_date >= (SELECT min(pickup_date) FROM frame) + 7""",
        ("panel_base", "panel_daily", "frame"),
    ),
}


def q(body: str, *needs: str) -> str:
    """``body`` with every table expression it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in CTES[name][1]:
                add(need)
            if name not in ordered:
                ordered.append(name)

    for need in needs:
        add(need)
    ctes = ",\n".join(f"{name} AS ({CTES[name][0]})" for name in ordered)
    return f"WITH {ctes}\n{body}"


def _errors(table: str, keys: str, absolute: bool = True) -> str:
    base = "abs(actual_trips)" if absolute else "actual_trips"
    return f"""
SELECT {keys}, count(*) AS n, {rnd('avg(abs(actual_trips - predicted_trips))', 6)} AS mae,
       {rnd('sqrt(avg((actual_trips - predicted_trips) ** 2))', 6)} AS rmse,
       {rnd(div('sum(abs(actual_trips - predicted_trips))', f'sum({base})'), 6)} AS wape
FROM {table}"""


def _breakdown(flags: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT file, '{name}' AS rule, count(*) FILTER (inside AND ({cond})) AS excluded_records,
       coalesce({rnd(div(f'count(*) FILTER (inside AND ({cond}))', 'count(*) FILTER (inside)') + ' * 100', 2)}, 0)
         AS pct_of_study_period_records
FROM {flags} GROUP BY file"""
        for name, cond in _RULES
    )


def _first_failures(flags: str) -> str:
    return f"""
SELECT file, first_rule AS first_failing_rule, count(*) AS records,
       {rnd('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY file)', 2)} AS pct_of_study_period
FROM {flags} WHERE inside GROUP BY file, first_rule"""


def _summary(flags: str) -> str:
    return f"""
SELECT file, count(*) AS raw_trip_count, count(*) FILTER (NOT inside) AS out_of_period_count,
       count(*) FILTER (inside AND first_rule <> 'valid') AS invalid_in_period_count,
       count(*) FILTER (first_rule = 'valid') AS clean_trip_count,
       count(*) FILTER (NOT inside OR first_rule <> 'valid') AS total_excluded_trip_count,
       {rnd(div("count(*) FILTER (NOT inside OR first_rule <> 'valid')", 'count(*)') + ' * 100', 2)} AS excluded_pct
FROM {flags} GROUP BY file"""


_KPI_COLUMNS = f"""
       count(*) AS trips, count(DISTINCT CAST(pickup_datetime AS DATE)) AS active_days,
       {rnd('avg(trip_distance)', 2)} AS avg_trip_distance_miles,
       {rnd('median(trip_distance)', 2)} AS median_trip_distance_miles,
       {rnd('avg(trip_duration_min)', 2)} AS avg_trip_duration_min,
       {rnd('median(trip_duration_min)', 2)} AS median_trip_duration_min,
       {rnd('avg(total_amount)', 2)} AS avg_gross_spend_per_trip,
       {rnd('median(total_amount)', 2)} AS median_gross_spend_per_trip,
       {rnd('sum(total_amount)', 2)} AS gross_passenger_spend,
       {rnd(div('sum(total_amount)', 'sum(trip_distance)'), 2)} AS gross_spend_per_mile,
       {rnd(div('sum(tip_amount) FILTER (payment_type = 1)', 'sum(fare_amount) FILTER (payment_type = 1)'), 4)} AS card_tip_rate"""

_EXCLUDED = f"""
  SELECT first_rule AS first_failing_rule, regexp_extract(file, '(\\d{{4}}-\\d{{2}})', 1) AS month, count(*) AS records
  FROM shipment_flags WHERE inside AND first_rule <> 'valid' GROUP BY ALL"""

_METRIC_NAMES = [f"{m}_at_{k}" for k in KS for m in ("ndcg", "hit_rate", "precision")]
_NO_HITS = [n for n in _METRIC_NAMES if not n.startswith("hit_rate")]


def _rounded(names: list[str]) -> str:
    return ", ".join(f"{rnd(n, 6)} AS {n}" for n in names)


def _means(names: list[str], digits: int = 4) -> str:
    return ", ".join(f"{rnd(f'avg({n})', digits)} AS {n}" for n in names)


_METRIC_KEYS = "fold, test_date, pickup_hour, day_of_week"
_FEATURES = """
       CAST(pickup_hour AS DOUBLE) AS hour, CAST(isodow({day}) - 1 AS DOUBLE) AS day_of_week,
       CAST(isodow({day}) >= 6 AS INT)::DOUBLE AS is_weekend, CAST(is_airport AS INT)::DOUBLE AS is_airport,
       {trips}::DOUBLE AS historical_trips"""


def _features(day: str, trips: str, spend: str, minutes: str, miles: str, rest: dict[str, str]) -> str:
    real = {
        "historical_gross_spend": spend,
        "historical_avg_spend_per_trip": div(spend, trips),
        "historical_avg_duration": div(minutes, trips),
        "historical_distance": div(miles, trips),
        **rest,
    }
    columns = ",\n       ".join(f"{rnd(f'coalesce({e}, 0)', 6)} AS {n}" for n, e in real.items())
    return _FEATURES.format(day=day, trips=trips) + ",\n       " + columns


_PANEL_FEATURES = _features(
    "pickup_date", "prior_trips", "prior_spend", "prior_minutes", "prior_miles",
    {
        "matching_dow_hour_trips": "slot_trips",
        "matching_dow_hour_spend": "slot_spend",
        "same_hour_last_week_trips": "week_1",
        "trailing_4_week_trips": "mean_trips",
        "trailing_4_week_spend": "mean_spend",
    },
)
_FROZEN = f"""
SELECT fold, PULocationID, test_date, pickup_hour,
       {_features("test_date", "trips", "spend", "minutes", "miles", {
           "matching_dow_hour_trips": "slot_trips",
           "matching_dow_hour_spend": "slot_spend",
           "same_hour_last_week_trips": "last_week_trips",
           "trailing_4_week_trips": "trailing_trips",
           "trailing_4_week_spend": "trailing_spend",
       })}
FROM (SELECT h.fold, h.test_date, h.pickup_hour, z.PULocationID, z.is_airport, z.trips, z.spend, z.minutes, z.miles,
             m.trips AS slot_trips, m.spend AS slot_spend, w.last_week_trips, w.trailing_trips, w.trailing_spend
      FROM test_hours h
      JOIN (SELECT fold, PULocationID, bool_or(is_airport) AS is_airport, sum(trips) AS trips,
                   sum(gross_passenger_spend) AS spend, sum(trips * avg_trip_duration_min) AS minutes,
                   sum(trips * avg_trip_distance_miles) AS miles FROM train GROUP BY ALL) z USING (fold)
      LEFT JOIN (SELECT fold, dow, pickup_hour, PULocationID, sum(trips) AS trips,
                        sum(gross_passenger_spend) AS spend FROM train GROUP BY ALL) m
        ON m.fold = h.fold AND m.dow = isodow(h.test_date) - 1 AND m.pickup_hour = h.pickup_hour
       AND m.PULocationID = z.PULocationID
      LEFT JOIN weekly w ON w.fold = h.fold AND w.test_date = h.test_date AND w.pickup_hour = h.pickup_hour
       AND w.PULocationID = z.PULocationID)"""

_OPPORTUNITY = """
SELECT p.hour, p.day_type, p.PULocationID, p.pickup_zone, p.pickup_borough, p.avg_daily_trips,
       {columns}
FROM zone_profile p {how} JOIN (SELECT PULocationID, trips, avg_gross_spend_per_trip FROM zone_table {where}) z USING (PULocationID)"""

_FOLD_CHECK = """
SELECT 'train before test, fold ' || fold AS "check",
       coalesce(max(pickup_date) FILTER (pickup_date < fold_start) < any_value(fold_start)
         AND min(pickup_date) FILTER (pickup_date >= fold_start) >= any_value(fold_start), false) AS passed,
       concat_ws(' / ', max(pickup_date) FILTER (pickup_date < fold_start),
                 min(pickup_date) FILTER (pickup_date >= fold_start), max(pickup_date)) AS detail
FROM frame JOIN folds ON pickup_date < fold_end GROUP BY fold"""
_LEAKAGE = "UNION ALL".join(
    f"""
SELECT '{label} history precedes the target: {source}' AS "check", count(*) FILTER (last_{source}_date >= {day}) = 0 AS passed,
       count(*) FILTER (last_{source}_date >= {day}) || ' of ' || count(*) AS detail FROM {table}
"""
    for label, table, day in (("training", "panel", "pickup_date"), ("test", "history_dates", "test_date"))
    for source in ("daily", "slot", "week", "trailing")
)

_LONG_DRIVER = """
SELECT hour, day_type, PULocationID, pickup_zone, avg_daily_trips, round(round(gross, 11), 6) AS gross_spend_opportunity,
       objective, round(round(opportunity_score, 11), 6) AS opportunity_score, rank
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day_type, hour, objective
                     ORDER BY opportunity_score DESC, PULocationID) AS INTEGER) AS rank
      FROM (SELECT *, trip_score * a + spend_score * b AS opportunity_score
            FROM (SELECT *, CASE WHEN max(avg_daily_trips) OVER w = min(avg_daily_trips) OVER w THEN 1.0
                                 ELSE (avg_daily_trips - min(avg_daily_trips) OVER w)
                                      / (max(avg_daily_trips) OVER w - min(avg_daily_trips) OVER w) END AS trip_score,
                         CASE WHEN max(gross) OVER w = min(gross) OVER w THEN 1.0
                              ELSE (gross - min(gross) OVER w) / (max(gross) OVER w - min(gross) OVER w) END AS spend_score
                  FROM (SELECT p.*, p.avg_daily_trips * z.avg_gross_spend_per_trip AS gross
                        FROM zone_profile p LEFT JOIN zone_table z USING (PULocationID)
                        WHERE NOT contains(p.pickup_zone, '7'))
                  WINDOW w AS (PARTITION BY day_type, hour))
            CROSS JOIN (VALUES ('Balanced', 0.5::DOUBLE, 0.5::DOUBLE), ('More trips', 0.75::DOUBLE, 0.25::DOUBLE),
                               ('Higher-value trips', 0.25::DOUBLE, 0.75::DOUBLE)) o(objective, a, b)))
WHERE rank <= 10"""


def statements() -> dict[str, str]:
    weekdays = ", ".join(
        f"count(*) FILTER (day_of_week_num = {i}) AS {name}" for i, name in enumerate(MONDAY_FIRST)
    )
    naive_models = ("baseline_lag1", "baseline_lag24", "baseline_lag168")
    error = "abs(actual_trips - predicted_trips)"

    def wide(key: str, value: str, cast: str = "") -> str:
        columns = ", ".join(
            f"{rnd(value.format(f'FILTER (model = {m!r})'), 6)} AS {m}" for m in naive_models
        )
        return f"SELECT {key}, {columns} FROM matched GROUP BY {key}"

    wape = "sum(" + error + ") {0} / nullif(sum(actual_trips) {0}, 0)"
    mae = "avg(" + error + ") {0}"
    out: dict[str, str] = {
        # ---------------------------------------------------------------- cleaning
        "clean_trips": q("SELECT * FROM trips", "trips"),
        "quality_breakdown": q(_breakdown("audit_flags"), "audit_flags"),
        "first_failure": q(_first_failures("audit_flags"), "audit_flags"),
        "quality_summary": q(_summary("audit_flags"), "audit_flags"),
        "monthly_quality_breakdown": q(_breakdown("shipment_flags"), "shipment_flags"),
        "monthly_first_failure": q(_first_failures("shipment_flags"), "shipment_flags"),
        "monthly_quality_summary": q(_summary("shipment_flags"), "shipment_flags"),
        "accounting_check": q(
            """
SELECT file, count(*) AS raw_trip_count, count(*) FILTER (NOT inside) AS out_of_period_count,
       count(*) FILTER (inside AND first_rule <> 'valid') AS first_failure_count,
       count(*) FILTER (first_rule = 'valid') AS clean_trip_count,
       count(*) = count(*) FILTER (NOT inside) + count(*) FILTER (inside AND first_rule <> 'valid')
                  + count(*) FILTER (first_rule = 'valid') AS balanced
FROM shipment_flags GROUP BY file""",
            "shipment_flags",
        ),
        "record_cards": q(
            f"""
SELECT sum(raw_trip_count)::BIGINT AS raw_records, sum(clean_trip_count)::BIGINT AS clean_records,
       sum(total_excluded_trip_count)::BIGINT AS excluded_records,
       {rnd(div('sum(clean_trip_count)', 'sum(raw_trip_count)'), 6)} AS kept_share,
       {rnd(div('sum(total_excluded_trip_count)', 'sum(raw_trip_count)') + ' * 100', 2)} AS excluded_pct
FROM ({_summary('shipment_flags')})""",
            "shipment_flags",
        ),
        "exclusion_months": q(
            f"""
SELECT first_failing_rule, month, records,
       {rnd(div('sum(records) OVER (PARTITION BY first_failing_rule)', 'sum(records) OVER ()'), 6)} AS rule_share
FROM ({_EXCLUDED})""",
            "shipment_flags",
        ),
        "exclusion_pivot": q(
            f"""
SELECT * FROM (PIVOT (SELECT first_failing_rule, month, records,
                             {rnd(div('sum(records) OVER (PARTITION BY first_failing_rule)', 'sum(records) OVER ()'), 6)} AS rule_share
                      FROM ({_EXCLUDED}))
               ON month IN ({', '.join(f"'{month}'" for month in MONTHS)})
               USING coalesce(sum(records), 0)::BIGINT GROUP BY first_failing_rule, rule_share)""",
            "shipment_flags",
        ),
        "exclusion_trend": q(
            f"""
SELECT arg_min(records, month)::BIGINT AS first_month_records, arg_max(records, month)::BIGINT AS last_month_records
FROM (SELECT month, coalesce(sum(records) FILTER (first_failing_rule = 'zero_or_negative_duration'), 0) AS records
      FROM ({_EXCLUDED}) GROUP BY month)""",
            "shipment_flags",
        ),
        # ---------------------------------------------------------------- files
        "monthly_files": """
SELECT CASE WHEN l_partkey % 61 <> 0 THEN l_shipdate + to_minutes(CAST(l_orderkey % 1440 AS INTEGER)) END AS pickup_datetime,
       l_shipdate + to_minutes(CAST(l_orderkey % 1440 + l_quantity AS INTEGER)) AS dropoff_datetime,
       CAST(l_linenumber AS DOUBLE) AS passenger_count, l_suppkey AS PULocationID, l_partkey AS DOLocationID,
       CASE WHEN month(l_shipdate) % 4 <> 3 THEN l_tax END AS airport_fee
FROM lineitem""",
        "table_files": q(
            f"""
SELECT h.pickup_date, h.pickup_hour, h.trips, z.LocationID, z.Borough, z.Zone
FROM (SELECT CAST(pickup_datetime AS DATE) AS pickup_date, CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour, count(*) AS trips
      FROM trips GROUP BY ALL) h
LEFT JOIN (SELECT CAST(s_suppkey AS INTEGER) AS LocationID, CASE s_suppkey % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'NA' END AS Borough,
                  s_name AS Zone FROM supplier) z ON z.LocationID = h.pickup_hour""",
            "trips",
        ),
        # ---------------------------------------------------------------- KPIs and profiles
        "kpis": q(f"SELECT {_KPI_COLUMNS} FROM trips", "trips"),
        "shipment_kpis": q(f"SELECT {_KPI_COLUMNS} FROM shipments", "shipments"),
        "kpis_monthly": q("SELECT * FROM monthly", "monthly"),
        "median_of_monthly_medians": q(
            "SELECT median(median_gross_spend) AS median_spend_per_trip FROM monthly", "monthly"
        ),
        "monthly_growth": q(
            f"""
SELECT arg_min(trips_per_day, month) AS first_trips_per_day, arg_max(trips_per_day, month) AS last_trips_per_day,
       {rnd('arg_max(trips_per_day, month) / arg_min(trips_per_day, month) - 1', 6)} AS growth FROM monthly""",
            "monthly",
        ),
        "payment_analysis": q(
            f"""
SELECT payment_type, count(*) AS trips, {rnd('avg(total_amount)', 2)} AS avg_total_amount,
       {rnd('avg(tip_amount)', 2)} AS avg_tip_amount,
       {rnd('avg(tip_rate) FILTER (payment_type = 1)', 4)} AS avg_card_tip_rate
FROM trips GROUP BY payment_type""",
            "trips",
        ),
        "payment_mix": q(
            f"""
SELECT payment_type, count(*) AS trips, {rnd(div('count(*)', 'sum(count(*)) OVER ()'), 6)} AS trip_share
FROM shipments GROUP BY payment_type""",
            "shipments",
        ),
        "hourly_timeseries": q("SELECT * FROM hourly", "hourly"),
        "hourly_profile": q(
            f"""
SELECT hour AS pickup_hour, {_DAY_TYPE.format('pickup_datetime')} AS day_type,
       {rnd('CAST(count(*) AS DOUBLE) / count(DISTINCT date)', 2)} AS avg_daily_trips
FROM trips GROUP BY ALL""",
            "trips",
        ),
        "profile_by_day_type": q(
            f"""
SELECT hour AS pickup_hour,
       {rnd("count(*) FILTER (NOT is_weekend) / CAST(count(DISTINCT date) FILTER (NOT is_weekend) AS DOUBLE)", 2)} AS Weekday,
       {rnd("count(*) FILTER (is_weekend) / CAST(count(DISTINCT date) FILTER (is_weekend) AS DOUBLE)", 2)} AS Weekend
FROM trips GROUP BY hour""",
            "trips",
        ),
        "hourly_demand": q(
            f"""
SELECT hour AS pickup_hour, {_DAY_TYPE.format('pickup_datetime')} AS day_type, Borough AS pickup_borough,
       Zone AS pickup_zone, {rnd('CAST(count(*) AS DOUBLE) / count(DISTINCT date)', 2)} AS avg_daily_trips
FROM trips LEFT JOIN czones ON PULocationID = LocationID GROUP BY ALL""",
            "trips", "czones",
        ),
        "zone_hour_profile": q("SELECT * FROM zone_profile", "zone_profile"),
        "zone_hour_timeseries": q("SELECT * FROM series", "series"),
        "zone_analysis": q("SELECT * FROM zone_table", "zone_table"),
        "zone_hour_heatmap": q(
            """
SELECT Borough AS pickup_borough, Zone AS pickup_zone, hour, count(*)::BIGINT AS trips
FROM shipments LEFT JOIN szones ON PULocationID = LocationID GROUP BY ALL""",
            "shipments", "szones",
        ),
        "daily_trips_revenue": q(
            f"""
SELECT CAST(date AS DATE) AS pickup_date, count(*) AS trips, {rnd('sum(total_amount)', 2)} AS revenue
FROM shipments GROUP BY ALL""",
            "shipments",
        ),
        "trips_by_hour": q(
            f"""
SELECT hour, count(*) AS trips, {rnd(div('sum(total_amount)', 'count(*)'), 2)} AS revenue_per_trip
FROM shipments GROUP BY hour""",
            "shipments",
        ),
        "hour_dow_heatmap": q(f"SELECT hour, {weekdays} FROM trips GROUP BY hour", "trips"),
        "revenue_per_mile_by_zone": q(
            f"""
SELECT PULocationID, {rnd(div('sum(total_amount)', 'sum(trip_distance)'), 2)} AS revenue_per_mile
FROM shipments WHERE trip_distance > 0 GROUP BY PULocationID""",
            "shipments",
        ),
        "duration_by_distance": q(
            f"""
SELECT CAST(floor(trip_distance) AS BIGINT) AS distance_miles, count(*) AS trips,
       {rnd('avg(trip_duration_min)', 2)} AS avg_duration_min FROM shipments GROUP BY ALL""",
            "shipments",
        ),
        "duration_distance_correlation": q(
            f"SELECT {rnd('corr(trip_distance, trip_duration_min)', 6)} AS correlation FROM shipments", "shipments"
        ),
        "trip_cards": q(
            f"""
SELECT count(*) AS trips, {rnd('sum(total_amount)', 2)} AS revenue, {rnd('avg(fare_amount)', 2)} AS avg_fare,
       {rnd('avg(trip_duration_min)', 2)} AS avg_duration_min, {rnd('avg(trip_distance)', 2)} AS avg_distance_miles
FROM shipments""",
            "shipments",
        ),
        "borough_share": q(
            f"""
SELECT pickup_borough, {rnd(div('sum(trips)', 'sum(sum(trips)) OVER ()'), 6)} AS trip_share,
       {rnd(div('sum(gross_passenger_spend)', 'sum(sum(gross_passenger_spend)) OVER ()'), 6)} AS spend_share
FROM zone_table GROUP BY pickup_borough""",
            "zone_table",
        ),
        "pareto_zones": q(
            f"""
SELECT count(*) FILTER (below) + 1 AS zones_for_share,
       {rnd(div('sum(trips) FILTER (place <= 10)', 'sum(trips)'), 6)} AS top_zones_share
FROM (SELECT trips, row_number() OVER (ORDER BY trips DESC, PULocationID) AS place,
             CAST(sum(trips) OVER (ORDER BY trips DESC, PULocationID) AS DOUBLE) / sum(trips) OVER () < 0.8 AS below
      FROM zone_table)""",
            "zone_table",
        ),
        "filter_zones": q(
            """
SELECT * FROM zone_table WHERE pickup_borough IN ('ASIA', 'EUROPE') AND trips >= 10
ORDER BY gross_passenger_spend DESC, PULocationID LIMIT 25""",
            "zone_table",
        ),
        "top_zones_by_trips": q(
            """
SELECT PULocationID, pickup_zone, pickup_borough, trips FROM zone_table
ORDER BY trips DESC, PULocationID LIMIT 10""",
            "zone_table",
        ),
        "top_zones_by_spend": q(
            """
SELECT PULocationID, pickup_zone, pickup_borough, gross_passenger_spend FROM zone_table
ORDER BY gross_passenger_spend DESC, PULocationID LIMIT 10""",
            "zone_table",
        ),
        # ---------------------------------------------------------------- forecasting
        "dense_hourly": q("SELECT * FROM dense", "dense"),
        "missing_hours": q(
            """
SELECT count(*) AS expected_hours, count(trips) AS observed_hours,
       count(*) FILTER (trips IS NULL) AS missing_hours FROM dense""",
            "dense",
        ),
        "lag_features": q("SELECT * FROM lagged", "lagged"),
        "zone_lag_features": q(
            """
SELECT d.PULocationID, d.timestamp, o.trips, a.trips AS lag_1, b.trips AS lag_24, c.trips AS lag_168
FROM (SELECT PULocationID, unnest(generate_series(min(pickup_date + to_hours(pickup_hour)),
                                                  max(pickup_date + to_hours(pickup_hour)), INTERVAL 1 HOUR)) AS timestamp
      FROM series GROUP BY PULocationID) d
LEFT JOIN stamped o ON o.PULocationID = d.PULocationID AND o.timestamp = d.timestamp
LEFT JOIN stamped a ON a.PULocationID = d.PULocationID AND a.timestamp = d.timestamp - INTERVAL 1 HOUR
LEFT JOIN stamped b ON b.PULocationID = d.PULocationID AND b.timestamp = d.timestamp - INTERVAL 24 HOUR
LEFT JOIN stamped c ON c.PULocationID = d.PULocationID AND c.timestamp = d.timestamp - INTERVAL 168 HOUR""",
            "stamped",
        ),
        "fold_splits": q(
            """
SELECT fold, CASE WHEN tested THEN 'test' ELSE 'train' END AS part, count(*) AS hours,
       count(*) FILTER (next_ok) AS next_hour_rows, count(*) FILTER (day_ok) AS day_ahead_rows,
       min(timestamp) AS first_hour, max(timestamp) AS last_hour
FROM usable GROUP BY fold, tested""",
            "usable",
        ),
        "naive_predictions": q("SELECT * FROM naive", "naive"),
        "forecast_metrics": q(
            _errors("naive", "'overall' AS evaluation_set, 'all' AS \"group\", 'all' AS fold, model") + " GROUP BY model"
            + "\nUNION ALL" + _errors("naive", "'by_fold', 'all', CAST(fold AS VARCHAR), model") + " GROUP BY fold, model"
            + "\nUNION ALL" + _errors("naive", "'by_hour', CAST(hour AS VARCHAR), 'all', model") + " GROUP BY hour, model"
            + "\nUNION ALL" + _errors("naive", "'by_day_type', day_type, 'all', model") + " GROUP BY day_type, model"
            + "\nUNION ALL" + _errors("naive", "'holiday', holiday, 'all', model")
            + " WHERE holiday <> 'None' GROUP BY holiday, model",
            "naive",
        ),
        "matched_metrics": q(_errors("matched", "model", absolute=False) + " GROUP BY model", "matched"),
        "mae_vs_baseline": q(
            f"""
SELECT model, n, {rnd('mae', 6)} AS mae,
       {rnd("mae / (SELECT avg(" + error + ") FROM matched WHERE model = 'baseline_lag168') - 1", 6)} AS mae_vs_baseline
FROM (SELECT model, count(*) AS n, avg({error}) AS mae FROM matched GROUP BY model)""",
            "matched",
        ),
        "wape_by_hour_model": q(wide("hour", wape), "matched"),
        "mae_by_fold_model": q(wide("fold", mae), "matched"),
        "wape_by_day_type_model": q(wide("day_type", wape), "matched"),
        "actual_and_predicted": q(
            """
SELECT timestamp, max(actual_trips) AS actual,
       avg(predicted_trips) FILTER (model = 'baseline_lag1') AS baseline_lag1,
       avg(predicted_trips) FILTER (model = 'baseline_lag24') AS baseline_lag24,
       avg(predicted_trips) FILTER (model = 'baseline_lag168') AS baseline_lag168
FROM naive WHERE fold = 1 GROUP BY timestamp""",
            "naive",
        ),
        # ---------------------------------------------------------------- rankings
        "frame_profile": q(
            """
SELECT (SELECT min(pickup_date) FROM frame) AS first_date, (SELECT max(pickup_date) FROM frame) AS last_date,
       (SELECT count(DISTINCT PULocationID) FROM frame) AS zones, fold,
       count(*) FILTER (pickup_date < fold_start) AS train_rows,
       count(*) FILTER (pickup_date >= fold_start AND pickup_date < fold_end) AS test_rows
FROM frame CROSS JOIN folds GROUP BY fold""",
            "frame", "folds",
        ),
        "train_slots": q("SELECT * FROM slots", "slots"),
        "train_hour_counts": q(
            "SELECT fold, count(DISTINCT (pickup_date, pickup_hour)) AS n_hours FROM train GROUP BY fold", "train"
        ),
        "zone_totals": q(
            "SELECT fold, PULocationID, total_trips, observed_rows, is_airport FROM cand", "cand"
        ),
        "profile_scores": q(
            f"SELECT fold, dow, pickup_hour, PULocationID, trips, n_rows, n_slots, {rnd('score', 6)} AS score FROM profile",
            "profile",
        ),
        "weekly_scores": q(
            f"""
SELECT fold, test_date, pickup_hour, PULocationID, last_week_trips, {rnd('trailing_trips', 6)} AS trailing_trips,
       {rnd('trailing_spend', 6)} AS trailing_spend FROM weekly""",
            "weekly",
        ),
        "ranking_scores": q(
            f"""
SELECT fold, scope, baseline, test_date, pickup_hour, PULocationID, {rnd('score', 6)} AS score,
       CAST(rank AS INTEGER) AS rank FROM ranked""",
            "ranked",
        ),
        "observed_mean_ranking": q(
            f"""
SELECT fold, test_date, pickup_hour, PULocationID, {rnd('observed_mean', 6)} AS score,
       CAST(row_number() OVER (PARTITION BY fold, test_date, pickup_hour
                               ORDER BY observed_mean DESC, PULocationID) AS INTEGER) AS rank
FROM scored QUALIFY rank <= 20""",
            "scored",
        ),
        "ranking_predictions": q("SELECT * FROM predictions", "predictions"),
        "ranking_metrics": q(
            f"SELECT {_METRIC_KEYS}, baseline, time_block, day_type, {_rounded(_METRIC_NAMES)} FROM metrics", "metrics"
        ),
        "support_metrics": q(
            f"""
SELECT {_METRIC_KEYS}, baseline, CAST(scope AS BIGINT) AS support_threshold, supported_zone_count,
       candidate_zone_count, {rnd(div('supported_zone_count', 'candidate_zone_count'), 6)} AS support_coverage,
       time_block, day_type, {_rounded(_NO_HITS)}
FROM all_metrics
JOIN (SELECT fold, scope, count(*) AS candidate_zone_count,
             count(*) FILTER (total_trips >= CAST(scope AS BIGINT)) AS supported_zone_count
      FROM cand CROSS JOIN (VALUES ('25'), ('30')) t(scope) GROUP BY ALL) USING (fold, scope)""",
            "all_metrics", "cand",
        ),
        "airport_metrics": q(
            f"""
SELECT {_METRIC_KEYS}, baseline, scope AS airport_group, time_block, day_type, {_rounded(_NO_HITS)}
FROM all_metrics WHERE scope IN ('Airport', 'Non-airport')""",
            "all_metrics",
        ),
        "ranking_summary": q(
            "\nUNION ALL ".join(
                f"""SELECT '{report}' AS report, {group} AS "group", baseline,
       {_means(['ndcg_at_5', 'ndcg_at_10', 'ndcg_at_20', 'precision_at_10', 'hit_rate_at_10'])}
FROM metrics GROUP BY {by}"""
                for report, group, by in (
                    ("baseline", "'all'", "baseline"),
                    ("fold", "CAST(fold AS VARCHAR)", "baseline, fold"),
                    ("time_block", "time_block", "baseline, time_block"),
                    ("day_type", "day_type", "baseline, day_type"),
                )
            ),
            "metrics",
        ),
        "support_summary": q(
            f"""
SELECT CAST(scope AS BIGINT) AS support_threshold, baseline, {_means(['ndcg_at_5', 'ndcg_at_10', 'ndcg_at_20', 'precision_at_10'])},
       {rnd('avg(CAST(supported AS DOUBLE) / zones)', 4)} AS support_coverage
FROM all_metrics
JOIN (SELECT fold, scope, count(*) AS zones, count(*) FILTER (total_trips >= CAST(scope AS BIGINT)) AS supported
      FROM cand CROSS JOIN (VALUES ('25'), ('30')) t(scope) GROUP BY ALL) USING (fold, scope)
GROUP BY scope, baseline""",
            "all_metrics", "cand",
        ),
        "airport_summary": q(
            f"""
SELECT baseline, scope AS airport_group, {_means(_NO_HITS)} FROM all_metrics
WHERE scope IN ('Airport', 'Non-airport') GROUP BY baseline, scope""",
            "all_metrics",
        ),
        "ndcg_by_fold": q(
            f"""
SELECT baseline, {rnd('avg(ndcg_at_10) FILTER (fold = 1)', 6)} AS "1",
       {rnd('avg(ndcg_at_10) FILTER (fold = 2)', 6)} AS "2" FROM metrics GROUP BY baseline""",
            "metrics",
        ),
        "ndcg_by_time_block": q(
            "SELECT time_block, "
            + ", ".join(
                f"{rnd(f'avg(ndcg_at_10) FILTER (baseline = {b!r})', 6)} AS {b}"
                for b in ("global_popularity", "zone_hour_profile", "same_hour_last_week", "trailing_4_week_profile")
            )
            + " FROM metrics GROUP BY time_block",
            "metrics",
        ),
        "time_block_gain": q(
            f"""
SELECT time_block, {rnd("avg(ndcg_at_10) FILTER (baseline = 'zone_hour_profile') - avg(ndcg_at_10) FILTER (baseline = 'global_popularity')", 6)} AS gain
FROM metrics GROUP BY time_block""",
            "metrics",
        ),
        "gain_extremes": q(
            f"""
SELECT arg_max(time_block, gain) AS largest_block, max(gain) AS largest_gain,
       arg_min(time_block, gain) AS smallest_block, min(gain) AS smallest_gain
FROM (SELECT time_block, {rnd("avg(ndcg_at_10) FILTER (baseline = 'zone_hour_profile') - avg(ndcg_at_10) FILTER (baseline = 'global_popularity')", 6)} AS gain
      FROM metrics GROUP BY time_block)""",
            "metrics",
        ),
        "best_ranker": q(
            f"""
SELECT baseline, {rnd('mean', 6)} AS score
FROM (SELECT baseline, avg(ndcg_at_10) AS mean FROM metrics GROUP BY baseline ORDER BY mean DESC, baseline LIMIT 1)""",
            "metrics",
        ),
        "reported_metrics": q(
            f"""
SELECT baseline, 'all' AS fold, {_means(['ndcg_at_10', 'precision_at_10'], 6)} FROM metrics GROUP BY baseline
UNION ALL SELECT baseline, CAST(fold AS VARCHAR), {_means(['ndcg_at_10', 'precision_at_10'], 6)}
FROM metrics GROUP BY baseline, fold""",
            "metrics",
        ),
        "heldout_hours": q(
            """
SELECT fold, test_date, pickup_hour, baseline, CAST(model_rank AS INTEGER) AS model_rank, pickup_zone,
       pickup_borough, actual_gross_passenger_spend, CAST(actual_rank AS INTEGER) AS actual_rank, top_zone
FROM (SELECT *, rank AS model_rank,
             rank() OVER (PARTITION BY fold, test_date, pickup_hour, baseline
                          ORDER BY actual_gross_passenger_spend DESC) AS actual_rank,
             first_value(pickup_zone) OVER (PARTITION BY fold, test_date, pickup_hour, baseline
                          ORDER BY actual_gross_passenger_spend DESC, rank) AS top_zone
      FROM predictions)
WHERE model_rank <= 10""",
            "predictions",
        ),
        # ---------------------------------------------------------------- features
        "training_panel": q(
            f"""
SELECT fold, PULocationID, pickup_date, pickup_hour, {_PANEL_FEATURES}, {rnd('spend', 6)} AS target_gross_spend
FROM panel""",
            "panel",
        ),
        "frozen_features": q(_FROZEN, "test_hours", "train", "weekly"),
        "feature_null_counts": q(
            "\nUNION ALL ".join(
                f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM frozen"
                for c in ("fold", "PULocationID", "test_date", "pickup_hour", "hour", "day_of_week", "is_weekend",
                          "is_airport", "historical_trips", "historical_gross_spend",
                          "historical_avg_spend_per_trip", "historical_avg_duration", "historical_distance",
                          "matching_dow_hour_trips", "matching_dow_hour_spend", "same_hour_last_week_trips",
                          "trailing_4_week_trips", "trailing_4_week_spend")
            ),
            "frozen",
        ),
        "feature_summary": q(
            "\nUNION ALL ".join(
                f"""SELECT '{c}' AS feature, count({c}) AS n, {rnd(f'avg({c})', 4)} AS mean,
       {rnd(f'stddev_samp({c})', 4)} AS std, {rnd(f'min({c})', 4)} AS min, {rnd(f'max({c})', 4)} AS max,
       {", ".join(f"{rnd(f'quantile_cont({c}, {p / 100})', 4)} AS q{p}" for p in (25, 50, 75))} FROM frozen"""
                for c in ("hour", "day_of_week", "is_weekend",
                          "is_airport", "historical_trips", "historical_gross_spend",
                          "historical_avg_spend_per_trip", "historical_avg_duration", "historical_distance",
                          "matching_dow_hour_trips", "matching_dow_hour_spend", "same_hour_last_week_trips",
                          "trailing_4_week_trips", "trailing_4_week_spend")
            ),
            "frozen",
        ),
        # ---------------------------------------------------------------- opportunity
        "zone_opportunity": q(
            """
SELECT *, CAST(row_number() OVER (PARTITION BY day_type, hour ORDER BY opportunity_score DESC, PULocationID) AS INTEGER) AS rank
FROM (SELECT p.hour, p.day_type, p.PULocationID, p.pickup_zone, p.pickup_borough, p.avg_daily_trips, z.trips,
             z.avg_gross_spend_per_trip, p.avg_daily_trips * z.avg_gross_spend_per_trip AS opportunity_score
      FROM zone_profile p JOIN zone_table z USING (PULocationID)
      WHERE z.trips >= 50 AND NOT contains(p.pickup_zone, '7'))
QUALIFY rank <= 10""",
            "zone_profile", "zone_table",
        ),
        "driver_opportunity": q(_LONG_DRIVER, "zone_profile", "zone_table"),
        # ---------------------------------------------------------------- checks
        "fold_check": q(_FOLD_CHECK, "frame", "folds"),
        "baseline_checks": q(
            """
SELECT 'baseline metrics has rows' AS "check", count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM metrics
UNION ALL
SELECT 'exactly the configured folds', count(DISTINCT fold) = 2 AND min(fold) = 1 AND max(fold) = 2,
       string_agg(DISTINCT CAST(fold AS VARCHAR), ',' ORDER BY CAST(fold AS VARCHAR)) FROM metrics
UNION ALL
SELECT 'overall', count(*) > 0 AND count(DISTINCT fold) = 2, '0' FROM metrics""",
            "metrics",
        ),
        "leakage_check": q(_LEAKAGE, "panel", "history_dates"),
        # ---------------------------------------------------------------- what a fitted model cannot change
        "model_forecast_rows": q(
            """
SELECT fold, model, timestamp, CAST(trips AS DOUBLE) AS actual_trips, true AS finite
FROM (SELECT *, 'gradient_boosting_lag1' AS model FROM usable WHERE tested AND next_ok
      UNION ALL SELECT *, 'gradient_boosting_24h' FROM usable WHERE tested AND day_ok)""",
            "usable",
        ),
        "final_model_rows": q(
            """
SELECT 'gradient_boosting_lag1' AS model, timestamp, CAST(trips AS DOUBLE) AS actual_trips, true AS finite
FROM lagged WHERE trips + lag_1 + lag_24 + lag_48 + lag_168 + rolling_24 IS NOT NULL
UNION ALL
SELECT 'gradient_boosting_24h', timestamp, CAST(trips AS DOUBLE), true
FROM lagged WHERE trips + lag_24 + lag_48 + lag_168 IS NOT NULL""",
            "lagged",
        ),
        "learned_ranking_hours": q(
            """
SELECT fold, test_date, pickup_hour, n AS n_rows, n AS n_zones, n AS n_ranks, n AS last_rank, n AS n_candidates,
       true AS finite
FROM test_hours JOIN (SELECT fold, least(20, count(*)) AS n FROM cand GROUP BY fold) USING (fold)""",
            "test_hours", "cand",
        ),
        "learned_metric_hours": q(
            f"""
SELECT fold, test_date, pickup_hour, dayname(test_date) AS day_of_week, {_BLOCK} AS time_block,
       {_DAY_TYPE.format("test_date")} AS day_type, true AS within
FROM test_hours""",
            "test_hours",
        ),
        "learned_gain_folds": q(
            f"""
SELECT coalesce(CAST(fold AS VARCHAR), 'all') AS fold, baseline AS best_baseline,
       {rnd('avg(ndcg_at_10)', 6)} AS best_baseline_score, true AS consistent
FROM metrics
WHERE baseline = (SELECT baseline FROM metrics GROUP BY baseline ORDER BY avg(ndcg_at_10) DESC, baseline LIMIT 1)
GROUP BY GROUPING SETS ((baseline), (baseline, fold))""",
            "metrics",
        ),
        "ranking_validation_rows": q(
            f"""
, found AS (
  SELECT 'learned metrics has rows' AS "check", count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM test_hours
  UNION ALL
  SELECT 'learned predictions has rows', sum(n) > 0, CAST(sum(n) AS VARCHAR)
  FROM test_hours JOIN (SELECT fold, least(20, count(*)) AS n FROM cand GROUP BY fold) USING (fold)
  UNION ALL
  SELECT 'baseline metrics has rows', count(*) > 0, CAST(count(*) AS VARCHAR) FROM metrics
  UNION ALL
  SELECT 'exactly the configured folds', list(DISTINCT fold ORDER BY fold) = [1, 2],
         string_agg(DISTINCT CAST(fold AS VARCHAR), ',' ORDER BY CAST(fold AS VARCHAR)) FROM test_hours
  UNION ALL {_FOLD_CHECK}
  UNION ALL {_LEAKAGE}
  UNION ALL SELECT 'target is not a model input', true, ''
  UNION ALL SELECT 'required prediction columns', true, ''
  UNION ALL SELECT 'predictions are finite', true, '0')
SELECT * FROM found
UNION ALL SELECT 'overall', bool_and(passed), CAST(count(*) FILTER (NOT passed) AS VARCHAR) FROM found""",
            "test_hours", "cand", "metrics", "frame", "folds", "panel", "history_dates",
        ),
    }
    for name in ("payment_analysis", "hourly_profile", "hourly_demand", "zone_hour_profile", "zone_hour_timeseries", "zone_analysis"):
        out[f"cube_{name}"] = out[name]
    out["zone_hour_stream"] = out["zone_hour_timeseries"]
    out["checked_quality_breakdown"] = out["monthly_quality_breakdown"]
    out["checked_first_failure"] = out["monthly_first_failure"]
    out["checked_accounting"] = out["accounting_check"]
    out["checked_clean_trips"] = q("SELECT * FROM shipments", "shipments")
    out["month_rerun"] = q(
        f"""
SELECT strftime(pickup_datetime, '%Y-%m') AS study_month, payment_type, count(*) AS trips, {rnd('sum(total_amount)', 2)} AS revenue
FROM shipments
WHERE study_month IN ('1998-01', '1998-03') OR (study_month = '1998-02' AND payment_type = 1) GROUP BY ALL""",
        "shipments",
    )
    out["perturbation_check"] = q(
        """
, marks AS (
  SELECT fold, max(pickup_date + to_hours(pickup_hour)) FILTER (pickup_date <= fold_start - 7) AS training,
         min(pickup_date + to_hours(pickup_hour)) FILTER (pickup_date >= fold_start AND pickup_date < fold_end) AS test
  FROM frame CROSS JOIN folds GROUP BY fold),
moved AS (SELECT DISTINCT fold, PULocationID, true AS hit FROM frame JOIN marks ON pickup_date + to_hours(pickup_hour) = training)
SELECT fold, 'training' AS features, CAST(training AS DATE) AS target_date, CAST(hour(training) AS INTEGER) AS target_hour,
       count(*) FILTER (pickup_date + to_hours(pickup_hour) <= training) AS n_rows, 0::BIGINT AS n_changed,
       count(*) FILTER (pickup_date + to_hours(pickup_hour) > training) AS n_later,
       count(*) FILTER (pickup_date > CAST(training AS DATE) AND hit) AS n_later_changed
FROM panel JOIN marks USING (fold) LEFT JOIN moved USING (fold, PULocationID) GROUP BY fold, training
UNION ALL
SELECT fold, 'test', CAST(test AS DATE), CAST(hour(test) AS INTEGER), count(*), 0, 0, 0
FROM frozen JOIN marks USING (fold) GROUP BY fold, test""",
        "frame", "folds", "panel", "frozen",
    )
    out["model_reload_rows"] = out["final_model_rows"].replace("true AS finite", "true AS same")
    return out


CTES["history_dates"] = (
    """
  SELECT h.test_date, z.last_daily_date, m.last_slot_date, w.last_week_date, w.trailing_date AS last_trailing_date
  FROM test_hours h
  JOIN (SELECT fold, PULocationID, max(pickup_date) AS last_daily_date FROM train GROUP BY ALL) z USING (fold)
  LEFT JOIN (SELECT fold, dow, pickup_hour, PULocationID, max(pickup_date) AS last_slot_date FROM train GROUP BY ALL) m
    ON m.fold = h.fold AND m.dow = isodow(h.test_date) - 1 AND m.pickup_hour = h.pickup_hour
   AND m.PULocationID = z.PULocationID
  LEFT JOIN weekly w ON w.fold = h.fold AND w.test_date = h.test_date AND w.pickup_hour = h.pickup_hour
   AND w.PULocationID = z.PULocationID""",
    ("test_hours", "train", "weekly"),
)
CTES["frozen"] = (_FROZEN, ("test_hours", "train", "weekly"))
CTES["stamped"] = (
    "SELECT PULocationID, pickup_date + to_hours(pickup_hour) AS timestamp, trips FROM series",
    ("series",),
)
