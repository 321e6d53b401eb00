"""Booking table schema, domains and the column lists the models use.

Everything in this module is a fixed value: it must equal the source data
contract for results to be right, so it is written out plainly.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the 19 source columns, in source order, with types ------
BOOKING_COLUMNS: list[tuple[str, T.DataType]] = [
    ("Booking_ID", T.StringType()),
    ("no_of_adults", T.LongType()),
    ("no_of_children", T.LongType()),
    ("no_of_weekend_nights", T.LongType()),
    ("no_of_week_nights", T.LongType()),
    ("type_of_meal_plan", T.StringType()),
    ("required_car_parking_space", T.LongType()),
    ("room_type_reserved", T.StringType()),
    ("lead_time", T.LongType()),
    ("arrival_year", T.LongType()),
    ("arrival_month", T.LongType()),
    ("arrival_date", T.LongType()),
    ("market_segment_type", T.StringType()),
    ("repeated_guest", T.LongType()),
    ("no_of_previous_cancellations", T.LongType()),
    ("no_of_previous_bookings_not_canceled", T.LongType()),
    ("avg_price_per_room", T.DoubleType()),
    ("no_of_special_requests", T.LongType()),
    ("booking_status", T.StringType()),
]

BOOKING_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in BOOKING_COLUMNS])

# --- fixed values: allowed categorical domains --------------------------------
MEAL_PLANS = ["Meal Plan 1", "Meal Plan 2", "Meal Plan 3", "Not Selected"]
ROOM_TYPES = ["Room_Type 1", "Room_Type 2", "Room_Type 3", "Room_Type 4",
              "Room_Type 5", "Room_Type 6", "Room_Type 7"]
MARKET_SEGMENTS = ["Online", "Offline", "Corporate", "Complementary", "Aviation"]
BOOKING_STATUSES = ["Not_Canceled", "Canceled"]

EXPECTED_CATEGORIES: dict[str, list] = {
    "type_of_meal_plan": MEAL_PLANS,
    "room_type_reserved": ROOM_TYPES,
    "market_segment_type": MARKET_SEGMENTS,
    "booking_status": BOOKING_STATUSES,
    "required_car_parking_space": [0, 1],
    "repeated_guest": [0, 1],
}

POSITIVE_STATUS = "Canceled"

# --- fixed values: numeric columns profiled by the numeric summary -----------
PROFILE_NUMERIC = [
    "lead_time", "avg_price_per_room", "no_of_adults", "no_of_children",
    "no_of_weekend_nights", "no_of_week_nights", "no_of_special_requests",
    "no_of_previous_cancellations", "no_of_previous_bookings_not_canceled",
]

# --- fixed values: categorical columns profiled by the category counts -------
PROFILE_CATEGORICAL = [
    "type_of_meal_plan", "room_type_reserved", "market_segment_type",
    "required_car_parking_space", "repeated_guest",
]

# --- fixed values: columns of the Spearman matrix, in order ------------------
SPEARMAN_COLUMNS = [
    "canceled", "lead_time", "avg_price_per_room", "no_of_adults", "no_of_children",
    "total_nights", "total_guests", "no_of_special_requests",
    "no_of_previous_cancellations", "no_of_previous_bookings_not_canceled",
    "required_car_parking_space", "repeated_guest",
]

# --- fixed values: model input columns (cancellation model) ------------------
CANCEL_NUMERIC = [
    "no_of_adults", "no_of_children",
    "no_of_weekend_nights", "no_of_week_nights",
    "lead_time", "arrival_month",
    "required_car_parking_space", "repeated_guest",
    "no_of_previous_cancellations", "no_of_previous_bookings_not_canceled",
    "avg_price_per_room", "no_of_special_requests",
    "total_nights", "total_guests", "has_children",
    "log_lead_time", "log_price", "price_is_zero",
    "is_weekend_stay", "arrival_season", "arrival_dow",
    "has_special_request", "prior_cancel_rate",
]
CATEGORICAL = ["type_of_meal_plan", "room_type_reserved", "market_segment_type"]

# --- fixed values: model input columns (price model) -------------------------
PRICE_NUMERIC = [
    "no_of_adults", "no_of_children",
    "no_of_weekend_nights", "no_of_week_nights",
    "lead_time", "arrival_month",
    "required_car_parking_space", "repeated_guest",
    "no_of_previous_cancellations", "no_of_previous_bookings_not_canceled",
    "no_of_special_requests",
    "total_nights", "total_guests", "has_children",
    "log_lead_time",
    "is_weekend_stay", "arrival_season", "arrival_dow",
    "has_special_request", "prior_cancel_rate",
]

# Categories seen fewer times than this in the training rows are pooled.
RARE_CATEGORY_MIN_COUNT = 10

# --- fixed values: month abbreviations ---------------------------------------
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# --- fixed values: risk bands and their descriptions --------------------------
RISK_LOW_UPPER = 0.30
RISK_HIGH_LOWER = 0.60
RISK_BAND_TEXT = {
    "low": "Low cancellation risk — no immediate action required",
    "medium": "Medium risk — send pre-arrival confirmation",
    "high": "High risk — request deposit or offer incentive",
}

SEED = 42
