"""Declared schemas (A14): raw feed shapes and the three tables.

Raw JSON leaves are read as strings so every numeric conversion is an explicit,
checked cast (no binary float sneaks into the fixed-point coordinates).
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType(), True) for n in names]


# One element of the status feed array (strings at the leaves, one nested object).
STATUS_JSON = StructType(
    _strings("station_id", "num_bikes_available")
    + [StructField("num_bikes_available_types", StructType(_strings("mechanical", "ebike")), True)]
    + _strings(
        "num_docks_available",
        "last_reported",
        "is_charging_station",
        "status",
        "is_installed",
        "is_renting",
        "is_returning",
        "traffic",
    )
)

# One element of the master feed array. rental_uris is an object; reading it as a
# string keeps its JSON text.
MASTER_JSON = StructType(
    _strings(
        "station_id",
        "name",
        "physical_configuration",
        "lat",
        "lon",
        "altitude",
        "address",
        "post_code",
        "capacity",
        "is_charging_station",
        "nearby_distance",
        "_ride_code_support",
        "rental_uris",
    )
)

# API envelope {"data": {"stations": [...]}}.
ENVELOPE_JSON = StructType(
    [StructField("data", StructType([StructField("stations", ArrayType(STATUS_JSON), True)]), True)]
)

# The columns of the tables below must match the reference's.
# Staging fact table: 13 columns.
STAGING = StructType(
    [
        StructField("STATION_ID", LongType()),
        StructField("NUM_BIKES_AVAILABLE", LongType()),
        StructField("NUM_BIKES_AVAILABLE_MECHANICAL", LongType()),
        StructField("NUM_BIKES_AVAILABLE_EBIKE", LongType()),
        StructField("NUM_DOCKS_AVAILABLE", LongType()),
        StructField("LAST_REPORTED", LongType()),
        StructField("IS_CHARGING_STATION", BooleanType()),
        StructField("STATUS", StringType()),
        StructField("IS_INSTALLED", LongType()),
        StructField("IS_RENTING", LongType()),
        StructField("IS_RETURNING", LongType()),
        StructField("TRAFFIC", StringType()),
        StructField("TST_REC", TimestampNTZType()),
    ]
)

# Station master (dimension): 14 columns.
MASTER = StructType(
    [
        StructField("STATION_ID", LongType()),
        StructField("STATION_NAME", StringType()),
        StructField("PHYSICAL_CONFIGURATION", StringType()),
        StructField("LAT", DecimalType(12, 7)),
        StructField("LON", DecimalType(12, 7)),
        StructField("ALTITUDE", DecimalType(12, 2)),
        StructField("ADDRESS", StringType()),
        StructField("POST_CODE", StringType()),
        StructField("CAPACITY", LongType()),
        StructField("IS_CHARGING_STATION", BooleanType()),
        StructField("NEARBY_DISTANCE", DecimalType(8, 2)),
        StructField("_RIDE_CODE_SUPPORT", BooleanType()),
        StructField("RENTAL_URIS", StringType()),
        StructField("TST_REC", TimestampNTZType()),
    ]
)

# Current state: 19 columns, one row per station.
STATE = StructType(
    [
        StructField("STATION_ID", LongType()),
        StructField("STATION_NAME", StringType()),
        StructField("LAT", DecimalType(12, 7)),
        StructField("LON", DecimalType(12, 7)),
        StructField("CAPACITY", LongType()),
        StructField("NUM_BIKES_AVAILABLE", LongType()),
        StructField("NUM_BIKES_AVAILABLE_MECHANICAL", LongType()),
        StructField("NUM_BIKES_AVAILABLE_EBIKE", LongType()),
        StructField("NUM_DOCKS_AVAILABLE", LongType()),
        StructField("OCCUPATION_RATIO", DecimalType(12, 4)),
        StructField("LAST_REPORTED", LongType()),
        StructField("LAST_REPORTED_TST", TimestampNTZType()),
        StructField("IS_CHARGING_STATION", BooleanType()),
        StructField("STATUS", StringType()),
        StructField("IS_INSTALLED", LongType()),
        StructField("IS_RENTING", LongType()),
        StructField("IS_RETURNING", LongType()),
        StructField("TRAFFIC", StringType()),
        StructField("TST_REC", TimestampNTZType()),
    ]
)

STATE_COLUMNS = [f.name for f in STATE.fields]

# Broken-docks result (also the CSV layout).
BROKEN_DOCKS = StructType(
    [
        StructField("STATION_ID", LongType()),
        StructField("STATION_NAME", StringType()),
        StructField("ADDRESS", StringType()),
        StructField("LAT", DecimalType(12, 7)),
        StructField("LON", DecimalType(12, 7)),
        StructField("BROKEN_DOCKS", LongType()),
    ]
)

# One route leg per served station (output of the grouped planner).
LEGS = StructType(
    [
        StructField("ZONE", StringType()),
        StructField("LEG_NO", IntegerType()),
        StructField("FROM_ID", LongType()),
        StructField("TO_ID", LongType()),
        StructField("AMOUNT", IntegerType()),
        StructField("ACTION", StringType()),
        StructField("LOAD_AFTER", LongType()),
        StructField("BIKES_AFTER", LongType()),
        StructField("DOCKS_AFTER", LongType()),
        StructField("RATIO_AFTER", DoubleType()),
        StructField("NEED_AFTER", DoubleType()),
    ]
)
