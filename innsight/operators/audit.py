"""Schema audit, data quality rules, cleaning and request validation.

Each audit is one fused aggregate over the table (a single scan with
map-side partial aggregation), turned into a long result table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.columns import (scalar, scalars, arrival_as_date, arrival_parts, is_canceled,
                                        stay_nights, valid_arrival)
from innsight.operators.ranks import bracketed_quantiles
from innsight.schema import (BOOKING_COLUMNS, EXPECTED_CATEGORIES, MARKET_SEGMENTS,
                             MEAL_PLANS, ROOM_TYPES)


def _long(df_one_row: DataFrame, items: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """Unpivot one wide row into rows via ``stack``; items are SQL expressions."""
    n = len(items)
    width = len(items[0])
    args = ", ".join(", ".join(it) for it in items)
    return df_one_row.selectExpr(f"stack({n}, {args}) AS ({', '.join(names)})") if width else df_one_row


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _s(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---------------------------------------------------------------------------
# schema and domains
# ---------------------------------------------------------------------------

def schema_audit(df: DataFrame, expected=BOOKING_COLUMNS) -> DataFrame:
    """Missing columns, extra columns and type mismatches against the contract.

    Works on the schema only (metadata), so it costs no scan."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for name, dtype in expected:
        exp = dtype.simpleString()
        act = actual.get(name)
        status = "missing" if act is None else ("ok" if act == exp else "type_mismatch")
        rows.append((name, exp, act, status))
    exp_names = {n for n, _ in expected}
    for name, act in actual.items():
        if name not in exp_names:
            rows.append((name, None, act, "extra"))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, expected_type string, actual_type string, status string")


def category_membership(df: DataFrame, expected: dict = EXPECTED_CATEGORIES) -> DataFrame:
    """Every distinct value of each categorical column with its row count and
    whether it belongs to the allowed domain. Unexpected values are the rows
    with ``in_domain = false``."""
    cols = [c for c in expected if c in df.columns]
    items = ", ".join(f"{_s(c)}, CAST({_q(c)} AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {items}) AS (column_name, value)")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    member = F.lit(False)
    for c in reversed(cols):
        allowed = [str(v) for v in expected[c]]
        member = F.when(F.col("column_name") == c, F.col("value").isin(allowed)).otherwise(member)
    return counts.withColumn("in_domain", F.coalesce(member, F.lit(False)))


def unexpected_categories(df: DataFrame, expected: dict = EXPECTED_CATEGORIES) -> DataFrame:
    return category_membership(df, expected).where(~F.col("in_domain"))


# ---------------------------------------------------------------------------
# completeness
# ---------------------------------------------------------------------------

def missingness(df: DataFrame) -> DataFrame:
    """(column_name, n_null) for every column, from one aggregate."""
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    items = [(_s(c), f"CAST({_q(c)} AS BIGINT)") for c in df.columns]
    return _long(wide, items, ["column_name", "n_null"])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row (pandas ``duplicated().sum()``).

    Only a 64-bit row hash is shuffled for all rows (pre-aggregated, so a hot
    group of copies collapses first). Rows whose hash repeats are compared in
    full, so the count is exact."""
    from innsight.operators.ranks import bounded_broadcast
    hashed = df.withColumn("_row_hash", F.xxhash64(*[F.col(_q(c)) for c in df.columns]))
    again = (hashed.groupBy("_row_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
             .select("_row_hash"))
    same = hashed.join(bounded_broadcast(again), "_row_hash", "left_semi")
    grouped = same.groupBy(*[F.col(_q(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return grouped.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint")
                       .alias("n_duplicates"))


SMALL_DOMAIN = 1 << 14


def _set_size(col: Column, kind: T.DataType) -> Column:
    """Distinct values as a set; NaN is one value, and zeros of both signs are equal, as in a grouping."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.size(F.collect_set(col))
    nan = F.isnan(col)
    return F.size(F.collect_set(F.when(~nan, col + F.lit(0.0)))) + F.coalesce(F.max(nan.cast("int")), F.lit(0))


def column_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """dtype, n_null, n_unique (nulls excluded) and pct_null per column.

    One aggregate counts rows and nulls and estimates every column's distinct values
    (HyperLogLog++, which is the result for ``exact=False``). Columns of an estimated
    ``SMALL_DOMAIN`` values or fewer are then counted exactly in one more aggregate, as
    sets that are combined on the map side; each larger column has an exact
    distinct count of its own, spread over the shuffle by value."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.sum(F.col(_q(c)).isNull().cast("long")).alias(f"_null{i}"))
        aggs.append(F.approx_count_distinct(F.col(_q(c))).alias(f"_uniq{i}"))
    wide = df.agg(*aggs)
    if exact:
        estimate = wide.first()
        of = {i: F.col(_q(c)) for i, c in enumerate(df.columns)}
        small = [i for i in of if estimate[f"_uniq{i}"] <= SMALL_DOMAIN]
        counted = df.agg(*[_set_size(of[i], df.schema[i].dataType).alias(f"_uniq{i}") for i in small]).first() \
            if small else {}
        wide = df.sparkSession.createDataFrame([(estimate["_rows"], *[estimate[f"_null{i}"] for i in of])],
                                               ", ".join(["_rows long", *[f"_null{i} long" for i in of]]))
        wide = wide.withColumns({f"_uniq{i}": F.lit(counted[f"_uniq{i}"]) if i in small else
                                 scalar(df.agg(F.count_distinct(of[i]).alias("u")), "u") for i in of})
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    items = [(_s(c), _s(dtypes[c]), f"CAST(_null{i} AS BIGINT)", f"CAST(_uniq{i} AS BIGINT)",
              f"ROUND(CAST(_null{i} AS DOUBLE) * 100 / _rows, 6)")
             for i, c in enumerate(df.columns)]
    return _long(wide, items, ["column_name", "dtype", "n_null", "n_unique", "pct_null"])


def dataset_size(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells and duplicate rows, as (metric, value)."""
    null_cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(null_cells).alias("n_missing"))
    wide = base.withColumns(scalars(duplicate_rows(df)))
    items = [("'rows'", "CAST(n_rows AS BIGINT)"),
             ("'columns'", f"CAST({len(df.columns)} AS BIGINT)"),
             ("'missing_cells'", "CAST(n_missing AS BIGINT)"),
             ("'duplicate_rows'", "CAST(n_duplicates AS BIGINT)")]
    return _long(wide, items, ["metric", "value"])


# ---------------------------------------------------------------------------
# suspicious values
# ---------------------------------------------------------------------------

def iqr_fence(df: DataFrame, col: str = "avg_price_per_room") -> DataFrame:
    """One row: q1, q3, iqr and the upper Tukey fence q3 + 1.5 * iqr
    (quantiles exact, linear interpolation, from brackets: no shuffle of the values).
    Null where the column has no values."""
    q = bracketed_quantiles(df, {col: F.col(col)}, [0.25, 0.75])
    wide = q.agg(F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
                 F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    return (wide.withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))


def iqr_outliers(df: DataFrame, col: str = "avg_price_per_room",
                 id_col: str = "Booking_ID") -> DataFrame:
    """Rows strictly above the upper Tukey fence (a scalar subquery)."""
    fence = scalar(iqr_fence(df, col), "upper_fence")
    return (df.select(id_col, col).withColumn("upper_fence", fence)
            .where(F.col(col) > F.col("upper_fence")))


# what a reader of the audit should do about each rule
AUDIT_NOTES = [
    ([1], "No adult in the room: keep the row and flag it."),
    ([2], "More adults than a standard room holds: check for group bookings."),
    ([3], "More children than a standard room holds: check the entry."),
    ([4], "No night is booked: day use or an entry error; keep the row and flag it."),
    ([5], "Free of charge: complimentary stay or missing price; leave out of the price model."),
    ([6], "Far above all other prices: check the entry."),
    ([7], "Above the upper fence: rare but possible; trees cope with it."),
    ([8], "Booked over a year ahead: rare but possible."),
    ([9], "Not a date of the calendar: drop before date features are derived."),
    ([10], "Few years only: seasons can't be told from trends."),
    ([11, 12], "The flag must be 0 or 1."),
]


def suspicious_audit(df: DataFrame) -> DataFrame:
    """The 12-rule audit: (rule_no, column_name, issue, n_rows, pct, threshold, note).

    All rule counts come from one aggregate; the IQR fence is a scalar
    subquery computed beforehand."""
    fence = scalar(iqr_fence(df), "upper_fence")
    nights = F.col("no_of_weekend_nights") + F.col("no_of_week_nights")
    price = F.col("avg_price_per_room")

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    # fixed values: columns, labels and limits of the rules
    rules = [
        ("no_of_adults", "zero adults", F.col("no_of_adults") == 0, None),
        ("no_of_adults", "more than 4 adults", F.col("no_of_adults") > 4, None),
        ("no_of_children", "more than 5 children", F.col("no_of_children") > 5, None),
        ("no_of_weekend_nights + no_of_week_nights", "zero total nights", nights == 0, None),
        ("avg_price_per_room", "zero price", price == 0, None),
        ("avg_price_per_room", "price > 500", price > 500, None),
        ("avg_price_per_room", "IQR outlier (> upper fence)", price > F.col("upper_fence"),
         "upper_fence"),
        ("lead_time", "lead time > 365 days (~1 year)", F.col("lead_time") > 365, None),
        ("arrival_date", "calendar-invalid date (e.g. Feb 30)", ~valid_arrival(), None),
    ]
    aggs = [F.count(F.lit(1)).alias("_rows"),
            F.min("arrival_year").alias("_ymin"), F.max("arrival_year").alias("_ymax"),
            F.max("upper_fence").alias("upper_fence")]
    for i, (_, _, cond, _) in enumerate(rules):
        aggs.append(cnt(cond).alias(f"_r{i}"))
    for i, c in enumerate(("required_car_parking_space", "repeated_guest")):
        aggs.append(cnt(~F.col(c).isin(0, 1)).alias(f"_b{i}"))
    wide = df.withColumn("upper_fence", fence).agg(*aggs)

    items = []
    for i, (c, issue, _, thr) in enumerate(rules):
        items.append((str(i + 1), _s(c), _s(issue), f"_r{i}",
                      f"ROUND(CAST(_r{i} AS DOUBLE) * 100 / _rows, 6)",
                      f"ROUND({thr}, 6)" if thr else "CAST(NULL AS DOUBLE)"))
    items.append(("10", "'arrival_year'",
                  "concat('only ', CAST(_ymin AS STRING), '–', CAST(_ymax AS STRING))",
                  "CAST(_rows AS BIGINT)", "CAST(100.0 AS DOUBLE)", "CAST(NULL AS DOUBLE)"))
    for i, c in enumerate(("required_car_parking_space", "repeated_guest")):
        items.append((str(11 + i), _s(c), "'value not in {0,1}'", f"_b{i}",
                      f"ROUND(CAST(_b{i} AS DOUBLE) * 100 / _rows, 6)", "CAST(NULL AS DOUBLE)"))
    out = _long(wide, items, ["rule_no", "column_name", "issue", "n_rows", "pct", "threshold"])
    note = F.lit(None).cast("string")
    for rules_, text in AUDIT_NOTES:
        note = F.when(F.col("rule_no").isin(rules_), F.lit(text)).otherwise(note)
    return out.withColumn("note", note).withColumn("rule_no", F.col("rule_no").cast("bigint"))


# ---------------------------------------------------------------------------
# cleaning
# ---------------------------------------------------------------------------

def drop_invalid_dates(df: DataFrame) -> DataFrame:
    """Keep rows whose (year, month, day) is a calendar date."""
    return df.where(valid_arrival())


def anomaly_flags(df: DataFrame) -> DataFrame:
    nights = F.col("no_of_weekend_nights") + F.col("no_of_week_nights")
    return df.withColumns({
        "is_zero_adults": (F.col("no_of_adults") == 0).cast("int"),
        "is_zero_nights": (nights == 0).cast("int"),
        "price_is_zero": (F.col("avg_price_per_room") == 0).cast("int"),
    })


def encode_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", is_canceled())


def load_and_clean(df: DataFrame) -> DataFrame:
    """Valid dates only, anomaly flags, 0/1 label: the modelling table."""
    return encode_label(anomaly_flags(drop_invalid_dates(df)))


def price_model_rows(df: DataFrame) -> DataFrame:
    """Rows for the price model: cleaned, price > 0, target-derived columns
    dropped (the price itself stays as the target)."""
    return (load_and_clean(df).where(F.col("avg_price_per_room") > 0)
            .drop("booking_status", "label", "price_is_zero"))


def rows_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.agg(F.count(F.lit(1)).alias("n_before"))
    a = after.agg(F.count(F.lit(1)).alias("n_after"))
    return b.withColumns(scalars(a)).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


# ---------------------------------------------------------------------------
# request validation (the API contract, applied to a table or stream)
# ---------------------------------------------------------------------------

# fixed values: fields with defaults, and the numeric ranges of the contract
REQUEST_DEFAULTS = {"no_of_children": 0, "no_of_previous_cancellations": 0,
                    "no_of_previous_bookings_not_canceled": 0, "no_of_special_requests": 0}
REQUEST_RANGES = [
    ("no_of_adults", 1, 4),
    ("no_of_children", 0, 10),
    ("no_of_weekend_nights", 0, 7),
    ("no_of_week_nights", 0, 17),
    ("lead_time", 0, None),
    ("arrival_year", 2017, None),
    ("arrival_month", 1, 12),
    ("arrival_date", 1, 31),
    ("no_of_previous_cancellations", 0, None),
    ("no_of_previous_bookings_not_canceled", 0, None),
    ("current_room_price", 0, None),
    ("no_of_special_requests", 0, 5),
]
REQUEST_ENUMS = [
    ("type_of_meal_plan", MEAL_PLANS),
    ("required_car_parking_space", [0, 1]),
    ("room_type_reserved", ROOM_TYPES),
    ("market_segment_type", MARKET_SEGMENTS),
    ("repeated_guest", [0, 1]),
]
REQUEST_FIELDS = [
    "no_of_adults", "no_of_children", "no_of_weekend_nights", "no_of_week_nights",
    "type_of_meal_plan", "required_car_parking_space", "room_type_reserved", "lead_time",
    "arrival_year", "arrival_month", "arrival_date", "market_segment_type", "repeated_guest",
    "no_of_previous_cancellations", "no_of_previous_bookings_not_canceled",
    "current_room_price", "no_of_special_requests",
]


def as_requests(bookings: DataFrame) -> DataFrame:
    """Booking rows in request shape: the price is the current room price."""
    return bookings.select("Booking_ID", *[
        F.col("avg_price_per_room").alias("current_room_price") if f == "current_room_price"
        else F.col(f) for f in REQUEST_FIELDS])


def _range_msg(lo, hi) -> str:
    if hi is None:
        return f"must be >= {lo}"
    return f"must be between {lo} and {hi}"


def validate_bookings(requests: DataFrame, min_arrival_year: int | None = 2017) -> DataFrame:
    """Apply the request contract to every row.

    Missing optional fields get their defaults; each failed rule adds
    ``'<field>: <message>'`` to ``errors``; ``is_valid`` is true when there
    are none. ``min_arrival_year`` is the contract's lower bound on the year
    (the first year of the training data); None disables that rule.
    """
    df = requests
    for f, v in REQUEST_DEFAULTS.items():
        if f in df.columns:
            df = df.withColumn(f, F.coalesce(F.col(f), F.lit(v).cast(df.schema[f].dataType)))
    checks: list[Column] = []
    for f, lo, hi in REQUEST_RANGES:
        if f == "arrival_year":
            if min_arrival_year is None:
                continue
            lo = min_arrival_year
        c = F.col(f)
        bad = (c < lo) if hi is None else ((c < lo) | (c > hi))
        checks.append(F.when(c.isNull(), F.lit(f"{f}: field required"))
                      .when(bad, F.lit(f"{f}: {_range_msg(lo, hi)}")))
    for f, allowed in REQUEST_ENUMS:
        c = F.col(f)
        checks.append(F.when(c.isNull(), F.lit(f"{f}: field required"))
                      .when(~c.isin(allowed), F.lit(f"{f}: value not allowed")))
    from innsight.operators.scoring import optional_array
    errors = optional_array([(ch.isNotNull(), ch) for ch in checks])
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without the error columns, rejected rows with errors)."""
    ok = validated.where("is_valid").drop("errors", "is_valid")
    bad = validated.where(~F.col("is_valid")).drop("is_valid")
    return ok, bad


# ---------------------------------------------------------------------------
# intake form (check-in / check-out) rules
# ---------------------------------------------------------------------------

# fixed values: the fields of the form
FORM_FIELDS = [
    "no_of_adults", "no_of_children", "type_of_meal_plan", "required_car_parking_space",
    "room_type_reserved", "lead_time", "market_segment_type", "repeated_guest",
    "no_of_previous_cancellations", "no_of_previous_bookings_not_canceled",
    "current_room_price", "no_of_special_requests",
]

# fixed values: the order the form reports problems in, and the messages
FORM_REQUIRED_ORDER = [
    ("no_of_children", "This field is required."),
    ("no_of_special_requests", "This field is required."),
    ("type_of_meal_plan", "Please select a meal plan."),
    ("room_type_reserved", "Please select a room type."),
    ("market_segment_type", "Please select a market segment."),
    ("required_car_parking_space", "This field is required."),
    ("lead_time", "This field is required."),
    ("current_room_price", "This field is required."),
    ("repeated_guest", "This field is required."),
    ("no_of_previous_cancellations", "This field is required."),
    ("no_of_previous_bookings_not_canceled", "This field is required."),
]


def intake_forms(bookings: DataFrame) -> DataFrame:
    """Bookings as intake-form rows: text fields and check-in/check-out text.

    Check-in is the arrival date as YYYY-MM-DD text; check-out adds the
    booked nights (a non-calendar arrival stays as its raw text)."""
    arrival = arrival_as_date()
    ci_text = F.format_string("%04d-%02d-%02d", F.col("arrival_year"), F.col("arrival_month"),
                              F.col("arrival_date"))
    nights = (F.col("no_of_weekend_nights") + F.col("no_of_week_nights")).cast("int")
    co = F.date_format(F.date_add(arrival, nights), "yyyy-MM-dd")
    out = bookings.select(
        "Booking_ID",
        *[(F.col("avg_price_per_room") if f == "current_room_price" else F.col(f))
          .cast("string").alias(f) for f in FORM_FIELDS],
        ci_text.alias("check_in"),
        F.coalesce(co, F.lit("")).alias("check_out"),
    )
    return out


def validate_form(forms: DataFrame) -> DataFrame:
    """The intake-form rules: required fields, check-out after check-in,
    at least one adult. Adds ``errors`` (array of 'field: message')."""
    def empty(f):
        return F.coalesce(F.col(f), F.lit("")) == ""

    nights = stay_nights("check_in", "check_out")
    checks = [
        F.when(empty("check_in"), F.lit("checkIn: This field is required.")),
        F.when(empty("check_out"), F.lit("checkOut: This field is required."))
         .when(~empty("check_in") & (nights["total"] == 0),
               F.lit("checkOut: Check-out must be after check-in.")),
        F.when(empty("no_of_adults"), F.lit("no_of_adults: This field is required."))
         .when(F.col("no_of_adults").try_cast("double") < 1,
               F.lit("no_of_adults: Value must be at least 1.")),
    ]
    for f, msg in FORM_REQUIRED_ORDER:
        checks.append(F.when(empty(f), F.lit(f"{f}: {msg}")))
    from innsight.operators.scoring import optional_array
    return forms.withColumn("errors", optional_array([(ch.isNotNull(), ch) for ch in checks]))


def stay_nights_table(forms: DataFrame) -> DataFrame:
    n = stay_nights("check_in", "check_out")
    return forms.select("Booking_ID", "check_in", "check_out",
                        n["weekday"].alias("weekday_nights"),
                        n["weekend"].alias("weekend_nights"),
                        n["total"].alias("total_nights"))


def arrival_parts_table(forms: DataFrame) -> DataFrame:
    p = arrival_parts("check_in")
    return forms.select("Booking_ID", "check_in", p["arrival_year"].alias("arrival_year"),
                        p["arrival_month"].alias("arrival_month"),
                        p["arrival_date"].alias("arrival_date"))
