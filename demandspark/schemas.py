"""Explicit schemas; nothing is inferred from file content."""

from pyspark.sql import types as T

_L, _D, _S, _I, _DATE = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.DateType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ZONE_LOOKUP = _schema(LocationID=_I, Borough=_S, Zone=_S)

HOURLY_SERIES = _schema(pickup_date=_DATE, pickup_hour=_I, trips=_L)

ZONE_HOUR_SERIES = _schema(
    pickup_date=_DATE,
    pickup_hour=_I,
    PULocationID=_L,
    pickup_zone=_S,
    pickup_borough=_S,
    trips=_L,
    gross_passenger_spend=_D,
    avg_gross_spend_per_trip=_D,
    gross_spend_per_minute=_D,
    avg_trip_duration_min=_D,
    avg_trip_distance_miles=_D,
)

RAW_TRIPS = _schema(
    VendorID=_L,
    tpep_pickup_datetime=T.TimestampNTZType(),
    tpep_dropoff_datetime=T.TimestampNTZType(),
    passenger_count=_D,
    trip_distance=_D,
    RatecodeID=_D,
    PULocationID=_L,
    DOLocationID=_L,
    payment_type=_L,
    fare_amount=_D,
    tip_amount=_D,
    tolls_amount=_D,
    total_amount=_D,
    congestion_surcharge=_D,
    airport_fee=_D,
    Airport_fee=_D,
    cbd_congestion_fee=_D,
)

PREDICTIONS = _schema(
    timestamp=T.TimestampNTZType(),
    date=_DATE,
    hour=_I,
    day_type=_S,
    holiday=_S,
    fold=_I,
    model=_S,
    actual_trips=_D,
    predicted_trips=_D,
)
