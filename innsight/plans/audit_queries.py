"""Registered queries for sources, audits, cleaning and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.operators import audit
from innsight.plans.registry import register
from innsight.schema import BOOKING_COLUMNS, EXPECTED_CATEGORIES
from innsight.session import scratch_path
from innsight.sources.bookings import bookings_table, read_bookings
from innsight.sources.tables import read_table, write_table

COLS = [n for n, _ in BOOKING_COLUMNS]


def _sql_str(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# sources and sinks
# ---------------------------------------------------------------------------

@register("read_bookings", "SELECT * FROM bookings", ["avg_price_per_room"])
def q_read_bookings(spark, sf_dir):
    """The booking table, written as CSV with a header and read back with the
    fixed schema (no inference)."""
    path = scratch_path(spark, "bookings-csv")
    bookings_table(spark, sf_dir).write.option("header", True).csv(path)
    return read_bookings(spark, path, "csv")


_CR_MARKET = """
SELECT market_segment_type,
       AVG(CASE WHEN booking_status = 'Canceled' THEN 1 ELSE 0 END) * 100.0 AS cancel_rate_pct,
       COUNT(*) AS n
FROM bookings GROUP BY market_segment_type"""


@register("write_table", _CR_MARKET, ["cancel_rate_pct"])
def q_write_table(spark, sf_dir):
    """A result table written to the shared table folder as Parquet."""
    from innsight.operators.profile import cancel_rate_by
    out = cancel_rate_by(bookings_table(spark, sf_dir), "market_segment_type")
    path = write_table(out, "cancel_rate_by_market_segment")
    return spark.read.parquet(path)


@register("read_table", _CR_MARKET, ["cancel_rate_pct"])
def q_read_table(spark, sf_dir):
    """A result table written as CSV (header, no index column) and re-read."""
    from innsight.operators.profile import cancel_rate_by
    out = cancel_rate_by(bookings_table(spark, sf_dir), "market_segment_type")
    path = write_table(out, "cancel_rate_by_market_segment_csv", fmt="csv")
    return read_table(spark, path, out.schema, fmt="csv")


# ---------------------------------------------------------------------------
# schema and domains
# ---------------------------------------------------------------------------

_SCHEMA_VALUES = ", ".join(
    f"({_sql_str(n)}, {_sql_str(t.simpleString())}, {_sql_str(t.simpleString())}, 'ok')"
    for n, t in BOOKING_COLUMNS)


@register("schema_audit",
          f"SELECT * FROM (VALUES {_SCHEMA_VALUES}) AS t(column_name, expected_type, actual_type, status)")
def q_schema_audit(spark, sf_dir):
    return audit.schema_audit(bookings_table(spark, sf_dir))


def _membership_sql() -> str:
    parts = [f"SELECT {_sql_str(c)} AS column_name, CAST({c} AS VARCHAR) AS value FROM bookings"
             for c in EXPECTED_CATEGORIES]
    case = " ".join(
        f"WHEN {_sql_str(c)} THEN value IN ({', '.join(_sql_str(v) for v in vals)})"
        for c, vals in EXPECTED_CATEGORIES.items())
    return (", long AS (" + " UNION ALL ".join(parts) + ")\n"
            f"SELECT column_name, value, COUNT(*) AS n_rows, "
            f"COALESCE(CASE column_name {case} END, FALSE) AS in_domain "
            f"FROM long GROUP BY column_name, value")


@register("category_membership", _membership_sql())
def q_category_membership(spark, sf_dir):
    return audit.category_membership(bookings_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# completeness
# ---------------------------------------------------------------------------

@register("missingness", " UNION ALL ".join(
    f"SELECT {_sql_str(c)} AS column_name, "
    f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM bookings"
    for c in COLS))
def q_missingness(spark, sf_dir):
    return audit.missingness(bookings_table(spark, sf_dir))


_DUP_SQL = (f"SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS n_duplicates FROM "
            f"(SELECT COUNT(*) AS n FROM bookings GROUP BY {', '.join(COLS)}) d")


@register("duplicate_rows", _DUP_SQL)
def q_duplicate_rows(spark, sf_dir):
    return audit.duplicate_rows(bookings_table(spark, sf_dir))


@register("column_summary", " UNION ALL ".join(
    f"SELECT {_sql_str(c)} AS column_name, {_sql_str(t.simpleString())} AS dtype, "
    f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, "
    f"CAST(COUNT(DISTINCT {c}) AS BIGINT) AS n_unique, "
    f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) * 100 / COUNT(*) AS pct_null "
    f"FROM bookings" for c, t in BOOKING_COLUMNS), ["pct_null"])
def q_column_summary(spark, sf_dir):
    return audit.column_summary(bookings_table(spark, sf_dir))


_NULL_CELLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in COLS)


@register("dataset_size", f"""
, s AS (SELECT COUNT(*) AS n_rows, SUM({_NULL_CELLS}) AS n_missing FROM bookings),
  d AS ({_DUP_SQL})
SELECT 'rows' AS metric, CAST(n_rows AS BIGINT) AS value FROM s
UNION ALL SELECT 'columns', CAST({len(COLS)} AS BIGINT) FROM s
UNION ALL SELECT 'missing_cells', CAST(n_missing AS BIGINT) FROM s
UNION ALL SELECT 'duplicate_rows', n_duplicates FROM d""")
def q_dataset_size(spark, sf_dir):
    return audit.dataset_size(bookings_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# suspicious values
# ---------------------------------------------------------------------------

_VALID_DATE_SQL = ("try_cast(concat_ws('-', CAST(arrival_year AS VARCHAR), CAST(arrival_month AS VARCHAR), "
                   "CAST(arrival_date AS VARCHAR)) AS DATE) IS NOT NULL")

_FENCE_CTE = """
, fence AS (
  SELECT quantile_cont(avg_price_per_room, 0.75)
         + 1.5 * (quantile_cont(avg_price_per_room, 0.75) - quantile_cont(avg_price_per_room, 0.25))
         AS upper_fence
  FROM bookings)"""


def _audit_sql() -> str:
    rules = [
        ("no_of_adults", "zero adults", "no_of_adults = 0", False),
        ("no_of_adults", "more than 4 adults", "no_of_adults > 4", False),
        ("no_of_children", "more than 5 children", "no_of_children > 5", False),
        ("no_of_weekend_nights + no_of_week_nights", "zero total nights",
         "no_of_weekend_nights + no_of_week_nights = 0", False),
        ("avg_price_per_room", "zero price", "avg_price_per_room = 0", False),
        ("avg_price_per_room", "price > 500", "avg_price_per_room > 500", False),
        ("avg_price_per_room", "IQR outlier (> upper fence)", "avg_price_per_room > upper_fence", True),
        ("lead_time", "lead time > 365 days (~1 year)", "lead_time > 365", False),
        ("arrival_date", "calendar-invalid date (e.g. Feb 30)", f"NOT ({_VALID_DATE_SQL})", False),
    ]
    parts = []
    for i, (c, issue, cond, thr) in enumerate(rules):
        parts.append(
            f"SELECT CAST({i + 1} AS BIGINT) AS rule_no, {_sql_str(c)} AS column_name, "
            f"{_sql_str(issue)} AS issue, "
            f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n_rows, "
            f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS DOUBLE) * 100 / COUNT(*) AS pct, "
            f"{'MAX(upper_fence)' if thr else 'CAST(NULL AS DOUBLE)'} AS threshold "
            f"FROM bookings, fence")
    parts.append(
        "SELECT CAST(10 AS BIGINT), 'arrival_year', "
        "'only ' || CAST(MIN(arrival_year) AS VARCHAR) || '–' || CAST(MAX(arrival_year) AS VARCHAR), "
        "CAST(COUNT(*) AS BIGINT), CAST(100.0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM bookings")
    for i, c in enumerate(("required_car_parking_space", "repeated_guest")):
        cond = f"{c} NOT IN (0, 1)"
        parts.append(
            f"SELECT CAST({11 + i} AS BIGINT), {_sql_str(c)}, 'value not in {{0,1}}', "
            f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT), "
            f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS DOUBLE) * 100 / COUNT(*), "
            f"CAST(NULL AS DOUBLE) FROM bookings")
    notes = ", ".join(f"({r}, {_sql_str(t)})" for rs, t in audit.AUDIT_NOTES for r in rs)
    rules_sql = _FENCE_CTE + "\n" + "\nUNION ALL ".join(parts)
    head, sep, select = rules_sql.partition("SELECT CAST(1 AS BIGINT)")
    return (f"{head}, al AS ({sep}{select}),\n  notes(r, note) AS (VALUES {notes})\n"
            "SELECT al.*, note FROM al JOIN notes ON rule_no = r")


@register("suspicious_audit", _audit_sql(), ["pct", "threshold"])
def q_suspicious_audit(spark, sf_dir):
    return audit.suspicious_audit(bookings_table(spark, sf_dir))


@register("iqr_outliers", _FENCE_CTE + """
SELECT Booking_ID, avg_price_per_room, upper_fence FROM bookings, fence
WHERE avg_price_per_room > upper_fence""", ["avg_price_per_room", "upper_fence"])
def q_iqr_outliers(spark, sf_dir):
    return audit.iqr_outliers(bookings_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# cleaning
# ---------------------------------------------------------------------------

@register("drop_invalid_dates", f"SELECT * FROM bookings WHERE {_VALID_DATE_SQL}",
          ["avg_price_per_room"])
def q_drop_invalid_dates(spark, sf_dir):
    return audit.drop_invalid_dates(bookings_table(spark, sf_dir))


_FLAGS_SQL = """CAST(no_of_adults = 0 AS INTEGER) AS is_zero_adults,
       CAST(no_of_weekend_nights + no_of_week_nights = 0 AS INTEGER) AS is_zero_nights"""


@register("anomaly_flags", f"""
SELECT Booking_ID, {_FLAGS_SQL},
       CAST(avg_price_per_room = 0 AS INTEGER) AS price_is_zero
FROM bookings""")
def q_anomaly_flags(spark, sf_dir):
    return audit.anomaly_flags(bookings_table(spark, sf_dir)).select(
        "Booking_ID", "is_zero_adults", "is_zero_nights", "price_is_zero")


@register("encode_label", """
SELECT Booking_ID, CAST(booking_status = 'Canceled' AS INTEGER) AS label FROM bookings""")
def q_encode_label(spark, sf_dir):
    return audit.encode_label(bookings_table(spark, sf_dir)).select("Booking_ID", "label")


_PRICE_ROWS_COLS = [c for c in COLS if c != "booking_status"]


@register("price_model_rows", f"""
SELECT {', '.join(_PRICE_ROWS_COLS)}, {_FLAGS_SQL}
FROM bookings WHERE {_VALID_DATE_SQL} AND avg_price_per_room > 0""", ["avg_price_per_room"])
def q_price_model_rows(spark, sf_dir):
    return audit.price_model_rows(bookings_table(spark, sf_dir))


@register("rows_removed", f"""
SELECT COUNT(*) AS n_before, COUNT(*) FILTER ({_VALID_DATE_SQL}) AS n_after,
       COUNT(*) FILTER (NOT ({_VALID_DATE_SQL})) AS n_removed FROM bookings""")
def q_rows_removed(spark, sf_dir):
    """Rows before and after the rows without a calendar date are dropped."""
    b = bookings_table(spark, sf_dir)
    return audit.rows_removed(b, audit.drop_invalid_dates(b))


# ---------------------------------------------------------------------------
# validation
# ---------------------------------------------------------------------------

def _validate_sql(src: str = "bookings") -> str:
    checks = []
    for f, lo, hi in audit.REQUEST_RANGES:
        c = f"{f}_v"
        bad = f"{c} < {lo}" if hi is None else f"({c} < {lo} OR {c} > {hi})"
        checks.append(f"CASE WHEN {c} IS NULL THEN '{f}: field required' "
                      f"WHEN {bad} THEN '{f}: {audit._range_msg(lo, hi)}' END")
    for f, allowed in audit.REQUEST_ENUMS:
        c = f"{f}_v"
        vals = ", ".join(_sql_str(v) if isinstance(v, str) else str(v) for v in allowed)
        checks.append(f"CASE WHEN {c} IS NULL THEN '{f}: field required' "
                      f"WHEN {c} NOT IN ({vals}) THEN '{f}: value not allowed' END")
    sel = ", ".join(
        (f"COALESCE({'avg_price_per_room' if f == 'current_room_price' else f}, "
         f"{audit.REQUEST_DEFAULTS[f]}) AS {f}_v") if f in audit.REQUEST_DEFAULTS else
        f"{'avg_price_per_room' if f == 'current_room_price' else f} AS {f}_v"
        for f in audit.REQUEST_FIELDS)
    n_err = " + ".join(f"CASE WHEN ({ch}) IS NULL THEN 0 ELSE 1 END" for ch in checks)
    return (f", r AS (SELECT Booking_ID, {sel} FROM {src})\n"
            f"SELECT Booking_ID, CAST({n_err} AS INTEGER) AS n_errors, "
            f"concat_ws('; ', {', '.join(checks)}) AS errors, ({n_err}) = 0 AS is_valid FROM r")


@register("validate_bookings", _validate_sql())
def q_validate_bookings(spark, sf_dir):
    v = audit.validate_bookings(audit.as_requests(bookings_table(spark, sf_dir)))
    return v.select("Booking_ID", F.size("errors").alias("n_errors"),
                    F.array_join("errors", "; ").alias("errors"), "is_valid")


# bookings moved into the contract's years, with planted faults: every 7th to
# 41st row of some residue has a missing, out-of-range or unknown value
_FAULTS = [("type_of_meal_plan", 11, 1, "'Meal Plan 9'"), ("room_type_reserved", 13, 2, "NULL"),
           ("no_of_adults", 17, 3, "0"), ("no_of_children", 19, 4, "NULL"), ("arrival_month", 23, 5, "13"),
           ("lead_time", 29, 6, "-1"), ("market_segment_type", 31, 7, "'Unknown'"),
           ("repeated_guest", 37, 8, "2"), ("avg_price_per_room", 41, 9, "-10"),
           ("no_of_special_requests", 7, 3, "6"), ("required_car_parking_space", 43, 9, "NULL")]
_K_SQL = "CAST(substr(Booking_ID, 4) AS BIGINT)"
_MIXED_CTE = ", mixed AS (SELECT * REPLACE (arrival_year + 25 AS arrival_year, " + ", ".join(
    f"CASE WHEN {_K_SQL} % {m} = {r} THEN {v} ELSE {c} END AS {c}" for c, m, r, v in _FAULTS) + ") FROM bookings)"


def mixed_bookings(df):
    """Bookings that partly pass and partly fail the request contract."""
    out = df.withColumn("arrival_year", F.col("arrival_year") + 25)
    for c, m, r, v in _FAULTS:
        out = out.withColumn(c, F.expr(f"CASE WHEN {_K_SQL} % {m} = {r} THEN CAST({v} AS "
                                       f"{df.schema[c].dataType.simpleString()}) ELSE {c} END"))
    return out


@register("validate_bookings_mixed", _MIXED_CTE + _validate_sql("mixed"))
def q_validate_bookings_mixed(spark, sf_dir):
    """The contract on rows of which some pass and the others break each rule."""
    v = audit.validate_bookings(audit.as_requests(mixed_bookings(bookings_table(spark, sf_dir))))
    return v.select("Booking_ID", F.size("errors").alias("n_errors"),
                    F.array_join("errors", "; ").alias("errors"), "is_valid")


_FORM_CTE = """
, fm AS (
  SELECT Booking_ID, no_of_adults, no_of_weekend_nights + no_of_week_nights AS nights,
         printf('%04d-%02d-%02d', arrival_year, arrival_month, arrival_date) AS check_in,
         try_cast(concat_ws('-', CAST(arrival_year AS VARCHAR), CAST(arrival_month AS VARCHAR),
                  CAST(arrival_date AS VARCHAR)) AS DATE) AS arr
  FROM bookings),
  fr AS (
  SELECT Booking_ID, no_of_adults, check_in,
         COALESCE(strftime(arr + CAST(nights AS INTEGER), '%Y-%m-%d'), '') AS check_out
  FROM fm),
  nt AS (
  SELECT *, try_cast(check_in AS DATE) AS ci, try_cast(check_out AS DATE) AS co FROM fr),
  nn AS (
  SELECT *,
    CASE WHEN ci IS NOT NULL AND co IS NOT NULL AND co > ci THEN CAST(co - ci AS BIGINT) ELSE 0 END AS total_n,
    CASE WHEN ci IS NOT NULL AND co IS NOT NULL AND co > ci
         THEN CAST(len(list_filter(range(CAST(ci AS TIMESTAMP), CAST(co AS TIMESTAMP), INTERVAL 1 DAY),
                                   lambda x: isodow(x) >= 6)) AS BIGINT)
         ELSE 0 END AS weekend_n
  FROM nt)"""


@register("validate_form", _FORM_CTE + """
SELECT Booking_ID, concat_ws('; ',
  CASE WHEN check_in = '' THEN 'checkIn: This field is required.' END,
  CASE WHEN check_out = '' THEN 'checkOut: This field is required.'
       WHEN check_in <> '' AND total_n = 0 THEN 'checkOut: Check-out must be after check-in.' END,
  CASE WHEN no_of_adults < 1 THEN 'no_of_adults: Value must be at least 1.' END) AS errors
FROM nn""")
def q_validate_form(spark, sf_dir):
    v = audit.validate_form(audit.intake_forms(bookings_table(spark, sf_dir)))
    return v.select("Booking_ID", F.array_join("errors", "; ").alias("errors"))


_EMPTY_AT = {"check_in": 20, "check_out": 21, "no_of_adults": 22}   # residues of the row number by 29


@register("validate_form_mixed", _FORM_CTE + f"""
, e AS (SELECT *, {_K_SQL} % 29 AS e FROM nn)
SELECT Booking_ID, concat_ws('; ',
  CASE WHEN e = 20 OR check_in = '' THEN 'checkIn: This field is required.' END,
  CASE WHEN e = 21 OR check_out = '' THEN 'checkOut: This field is required.'
       WHEN e <> 20 AND check_in <> '' AND total_n = 0 THEN 'checkOut: Check-out must be after check-in.' END,
  CASE WHEN e = 22 THEN 'no_of_adults: This field is required.'
       WHEN no_of_adults < 1 THEN 'no_of_adults: Value must be at least 1.' END, """ + ", ".join(
    f"CASE WHEN e = {i} THEN {_sql_str(f + ': ' + m)} END" for i, (f, m) in
    enumerate(audit.FORM_REQUIRED_ORDER)) + ") AS errors FROM e")
def q_validate_form_mixed(spark, sf_dir):
    """The form rules on rows of which some lack a field: every required field is missing somewhere."""
    forms = audit.intake_forms(bookings_table(spark, sf_dir))
    at = {f: i for i, (f, _) in enumerate(audit.FORM_REQUIRED_ORDER)} | _EMPTY_AT
    for f, i in at.items():
        forms = forms.withColumn(f, F.when(F.expr(f"{_K_SQL} % 29 = {i}"), F.lit("")).otherwise(F.col(f)))
    return audit.validate_form(forms).select("Booking_ID", F.array_join("errors", "; ").alias("errors"))


@register("stay_nights", _FORM_CTE + """
SELECT Booking_ID, check_in, check_out, total_n - weekend_n AS weekday_nights,
       weekend_n AS weekend_nights, total_n AS total_nights
FROM nn""")
def q_stay_nights(spark, sf_dir):
    return audit.stay_nights_table(audit.intake_forms(bookings_table(spark, sf_dir)))


@register("arrival_parts", _FORM_CTE + """
SELECT Booking_ID, check_in,
       try_cast(split_part(check_in, '-', 1) AS BIGINT) AS arrival_year,
       try_cast(split_part(check_in, '-', 2) AS BIGINT) AS arrival_month,
       try_cast(split_part(check_in, '-', 3) AS BIGINT) AS arrival_date
FROM nn""")
def q_arrival_parts(spark, sf_dir):
    return audit.arrival_parts_table(audit.intake_forms(bookings_table(spark, sf_dir)))
