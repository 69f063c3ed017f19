"""Schemas, column names and the fixed label lists the marts are built on."""

from __future__ import annotations

from pyspark.sql import types as T

_STR = T.StringType()
_COORD = T.DecimalType(12, 10)

# Raw monthly trip file: 13 positional columns, header row skipped.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("ride_id", _STR),
        T.StructField("rideable_type", _STR),
        T.StructField("started_at", _STR),
        T.StructField("ended_at", _STR),
        T.StructField("start_station_name", _STR),
        T.StructField("start_station_id", _STR),
        T.StructField("end_station_name", _STR),
        T.StructField("end_station_id", _STR),
        T.StructField("start_lat", _COORD),
        T.StructField("start_lng", _COORD),
        T.StructField("end_lat", _COORD),
        T.StructField("end_lng", _COORD),
        T.StructField("member_casual", _STR),
    ]
)

# The same with coordinates as doubles, for the profile that keeps every digit.
RAW_DOUBLES = T.StructType(
    [T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, T.DecimalType) else f.dataType) for f in RAW_SCHEMA.fields]
)

# Cleaned trip table (before ride_length / day_of_week are derived).
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("ride_id", _STR),
        T.StructField("bike_type", _STR),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("ended_at", T.TimestampNTZType()),
        T.StructField("start_sta_name", _STR),
        T.StructField("start_sta_id", _STR),
        T.StructField("end_sta_name", _STR),
        T.StructField("end_sta_id", _STR),
        T.StructField("start_lat", _COORD),
        T.StructField("start_lng", _COORD),
        T.StructField("end_lat", _COORD),
        T.StructField("end_lng", _COORD),
        T.StructField("user_type", _STR),
    ]
)

# --- fixed values (must equal the reference's) -------------------------------
RENAMES = {
    "rideable_type": "bike_type",
    "start_station_name": "start_sta_name",
    "start_station_id": "start_sta_id",
    "end_station_name": "end_sta_name",
    "end_station_id": "end_sta_id",
    "member_casual": "user_type",
}

# Declared text widths and the coordinate decimal.
TEXT_BOUNDS = {
    "ride_id": 50,
    "rideable_type": 50,
    "started_at": 50,
    "ended_at": 50,
    "start_station_name": 53,
    "start_station_id": 50,
    "end_station_name": 53,
    "end_station_id": 50,
    "member_casual": 50,
}

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAYS_SUNDAY_FIRST = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WORKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
WEEKEND = ["Saturday", "Sunday"]
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
HOURS_UNPADDED = [
    "12 AM", "1 AM", "2 AM", "3 AM", "4 AM", "5 AM", "6 AM", "7 AM", "8 AM", "9 AM", "10 AM", "11 AM",
    "12 PM", "1 PM", "2 PM", "3 PM", "4 PM", "5 PM", "6 PM", "7 PM", "8 PM", "9 PM", "10 PM", "11 PM",
]
HOURS_PADDED = [
    "12 AM", "01 AM", "02 AM", "03 AM", "04 AM", "05 AM", "06 AM", "07 AM", "08 AM", "09 AM", "10 AM", "11 AM",
    "12 PM", "01 PM", "02 PM", "03 PM", "04 PM", "05 PM", "06 PM", "07 PM", "08 PM", "09 PM", "10 PM", "11 PM",
]
USER_TYPES_SQL = ["casual", "member"]

# Duration bands of the range join: (name, low_limit, high_limit), inclusive.
BANDS = [("short rides", 1, 10), ("medium rides", 11, 20), ("long rides", 21, 99999)]
# Duration bands of the CASE variant: 1-10, 11-20, >= 21, anything else.
BAND_OTHER = "Other"

# Weekday / weekend labels and route frequency classes.
DAY_TYPE_WORK = "WKDY"
DAY_TYPE_WEEKEND = "WKND"
ROUTE_LOW = "< 500 Times"
ROUTE_HIGH = "> 500 Times"
POPULAR_MIN_RIDES = 250
FREQUENT_MAX_LOW = 500
FREQUENT_MIN_HIGH = 501

# Map window: top, right, bottom, left.
MAP_WINDOW = {"top": 41.990119, "right": -87.554855, "bottom": 41.790769, "left": -87.700424}

# Bike-type display labels and variable display names of the user/bike tree.
BIKE_LABELS = {"Classic_bike": "Classic", "Docked_bike": "Docked", "Electric_bike": "Electric"}
VAR_LABELS = {"user_type": "Type of User", "bike_type": "Type of Bike"}

# Text fix claimed by the cleaning notes.
TEXT_FIXES = {"Clybourne Ave": "Clybourn Ave"}

# Total labels of the SQL script and of the R script.
SQL_TOTALS = {
    "user": "combined",
    "band": "all rides",
    "month": "all year",
    "hour": "total",
}
R_TOTALS = {
    "user": "Combined",
    "user_cube": "United",
    "weekday": "gt",
    "band": "all rides",
    "month": "All Year",
    "hour": "Total",
}
# -----------------------------------------------------------------------------

STRING_COLUMNS = [f.name for f in TRIP_SCHEMA.fields if isinstance(f.dataType, T.StringType)]
COORD_COLUMNS = ["start_lat", "start_lng", "end_lat", "end_lng"]
