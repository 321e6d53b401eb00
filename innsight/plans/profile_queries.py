"""Registered queries for the descriptive profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.operators import profile as P
from innsight.plans.registry import register
from innsight.schema import PROFILE_CATEGORICAL, PROFILE_NUMERIC, SPEARMAN_COLUMNS
from innsight.sources.bookings import bookings_table

CANCELED = "CASE WHEN booking_status = 'Canceled' THEN 1 ELSE 0 END"
RATE = f"AVG({CANCELED}) * 100.0 AS cancel_rate_pct, COUNT(*) AS n"
MONTHS = ("['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
          "[arrival_month]")


def B(spark, sf_dir):
    return bookings_table(spark, sf_dir)


@register("target_distribution", """
SELECT booking_status, COUNT(*) AS count,
       COUNT(*) * 100.0 / SUM(COUNT(*)) OVER () AS pct
FROM bookings GROUP BY booking_status""", ["pct"])
def q_target_distribution(spark, sf_dir):
    return P.target_distribution(B(spark, sf_dir))


@register("imbalance_ratio", f"""
SELECT CAST(SUM(1 - {CANCELED}) AS BIGINT) AS n_not_canceled,
       CAST(SUM({CANCELED}) AS BIGINT) AS n_canceled,
       CAST(SUM(1 - {CANCELED}) AS DOUBLE) / SUM({CANCELED}) AS ratio
FROM bookings""", ["ratio"])
def q_imbalance_ratio(spark, sf_dir):
    return P.imbalance_ratio(B(spark, sf_dir))


def _numeric_summary_sql() -> str:
    parts = []
    for c in PROFILE_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, COUNT({x}) AS count, AVG({x}) AS mean, "
            f"STDDEV_SAMP({x}) AS std, MIN({x}) AS min, quantile_cont({x}, 0.25) AS q25, "
            f"quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75, MAX({x}) AS max, "
            f"skewness({x}) AS skewness, kurtosis({x}) AS kurtosis FROM bookings")
    return "\nUNION ALL ".join(parts)


@register("numeric_summary", _numeric_summary_sql(),
          ["mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"])
def q_numeric_summary(spark, sf_dir):
    return P.numeric_summary(B(spark, sf_dir))


def _categorical_sql() -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM bookings"
             for c in PROFILE_CATEGORICAL]
    return (", long AS (" + " UNION ALL ".join(parts) + ")\n"
            "SELECT column_name, value, COUNT(*) AS count, "
            "COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY column_name) AS pct "
            "FROM long GROUP BY column_name, value")


@register("categorical_counts", _categorical_sql(), ["pct"])
def q_categorical_counts(spark, sf_dir):
    return P.categorical_counts(B(spark, sf_dir))


VALUE_COUNT_COLS = ["no_of_adults", "no_of_children", "no_of_weekend_nights",
                    "no_of_special_requests"]


@register("value_counts", ", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS BIGINT) AS value FROM bookings"
    for c in VALUE_COUNT_COLS) + ")\nSELECT column_name, value, COUNT(*) AS count "
    "FROM long GROUP BY column_name, value")
def q_value_counts(spark, sf_dir):
    return P.value_counts(B(spark, sf_dir), VALUE_COUNT_COLS)


def _rate_sql(col):
    return f"SELECT {col}, {RATE} FROM bookings GROUP BY {col}"


for _key, _col in [("cancel_rate_by", "required_car_parking_space"),
                   ("cancel_rate_by_market_segment", "market_segment_type"),
                   ("cancel_rate_by_room_type", "room_type_reserved"),
                   ("cancel_rate_by_meal_plan", "type_of_meal_plan"),
                   ("cancel_rate_by_special_requests", "no_of_special_requests")]:
    def _make(col):
        def q(spark, sf_dir):
            return P.cancel_rate_by(B(spark, sf_dir), col)
        q.__doc__ = f"Cancel rate and count by {col}."
        return q
    register(_key, _rate_sql(_col), ["cancel_rate_pct"])(_make(_col))


@register("overall_cancel_rate", f"SELECT {RATE} FROM bookings", ["cancel_rate_pct"])
def q_overall_cancel_rate(spark, sf_dir):
    return P.overall_cancel_rate(B(spark, sf_dir))


def _lead_bucket_sql() -> str:
    cases = " ".join(f"WHEN lead_time > {lo} AND lead_time <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(P.LEAD_BINS[:-1], P.LEAD_BINS[1:], P.LEAD_LABELS))
    orders = " ".join(f"WHEN '{lab}' THEN {i + 1}" for i, lab in enumerate(P.LEAD_LABELS))
    return (f", lb AS (SELECT *, CASE {cases} END AS lead_bucket FROM bookings)\n"
            f"SELECT lead_bucket, {RATE}, CAST(CASE lead_bucket {orders} END AS BIGINT) AS bucket_order "
            f"FROM lb WHERE lead_bucket IS NOT NULL GROUP BY lead_bucket")


@register("cancel_rate_by_lead_bucket", _lead_bucket_sql(), ["cancel_rate_pct"])
def q_cancel_rate_by_lead_bucket(spark, sf_dir):
    return P.cancel_rate_by_lead_bucket(B(spark, sf_dir))


@register("monthly_volume", f"""
SELECT arrival_year, arrival_month, COUNT(*) AS total, CAST(SUM({CANCELED}) AS BIGINT) AS canceled,
       CAST(SUM({CANCELED}) AS DOUBLE) * 100 / COUNT(*) AS cancel_rate
FROM bookings GROUP BY arrival_year, arrival_month""", ["cancel_rate"])
def q_monthly_volume(spark, sf_dir):
    return P.monthly_volume(B(spark, sf_dir))


@register("month_status_pivot", f"""
SELECT arrival_month, {MONTHS} AS month_label,
       CAST(SUM(CASE WHEN booking_status = 'Not_Canceled' THEN 1 ELSE 0 END) AS BIGINT) AS Not_Canceled,
       CAST(SUM(CASE WHEN booking_status = 'Canceled' THEN 1 ELSE 0 END) AS BIGINT) AS Canceled
FROM bookings GROUP BY arrival_month""")
def q_month_status_pivot(spark, sf_dir):
    return P.month_status_pivot(B(spark, sf_dir))


@register("cancel_rate_by_month", f"""
SELECT arrival_month, {RATE}, {MONTHS} AS month_label FROM bookings GROUP BY arrival_month""",
          ["cancel_rate_pct"])
def q_cancel_rate_by_month(spark, sf_dir):
    return P.cancel_rate_by_month(B(spark, sf_dir))


@register("price_by_month", f"""
SELECT arrival_month, AVG(avg_price_per_room) AS mean_price, STDDEV_SAMP(avg_price_per_room) AS std_price,
       AVG(avg_price_per_room) - STDDEV_SAMP(avg_price_per_room) AS band_lower,
       AVG(avg_price_per_room) + STDDEV_SAMP(avg_price_per_room) AS band_upper,
       {MONTHS} AS month_label
FROM bookings WHERE avg_price_per_room > 0 GROUP BY arrival_month""",
          ["mean_price", "std_price", "band_lower", "band_upper"])
def q_price_by_month(spark, sf_dir):
    return P.price_by_month(B(spark, sf_dir))


@register("monthly_trend_label", f"""
SELECT arrival_year, arrival_month, COUNT(*) AS volume, AVG({CANCELED}) * 100.0 AS cancel_rate_pct,
       strftime(make_date(CAST(arrival_year AS INTEGER), CAST(arrival_month AS INTEGER), 1), '%b %y') AS label
FROM bookings GROUP BY arrival_year, arrival_month""", ["cancel_rate_pct"])
def q_monthly_trend_label(spark, sf_dir):
    return P.monthly_trend_label(B(spark, sf_dir))


def _spearman_sql() -> str:
    cols = SPEARMAN_COLUMNS
    src = (", sp AS (SELECT CAST(" + CANCELED + " AS DOUBLE) AS canceled, "
           "CAST(no_of_weekend_nights + no_of_week_nights AS DOUBLE) AS total_nights, "
           "CAST(no_of_adults + no_of_children AS DOUBLE) AS total_guests, "
           + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols
                       if c not in ("canceled", "total_nights", "total_guests"))
           + " FROM bookings)")
    ranks = ", rk AS (SELECT " + ", ".join(
        f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"
        for c in cols) + " FROM sp)"
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = "CAST(MAX(1.0) AS DOUBLE)" if i == j else f"corr(r_{a}, r_{b})"
            pairs.append(f"SELECT '{a}' AS row_feature, '{b}' AS col_feature, {v} AS rho FROM rk")
    return src + ranks + "\n" + "\nUNION ALL ".join(pairs)


@register("spearman_matrix", _spearman_sql(), ["rho"])
def q_spearman_matrix(spark, sf_dir):
    return P.spearman_matrix(B(spark, sf_dir))


def _target_corr_sql() -> str:
    base = _spearman_sql()
    # reuse the matrix CTEs: wrap the union as a CTE
    head, union = base.split("\n", 1)
    return (head + ", m AS (" + union + ")\n"
            "SELECT col_feature AS feature, ABS(rho) AS abs_r, "
            "CAST(ROW_NUMBER() OVER (ORDER BY ABS(rho) DESC, col_feature) AS BIGINT) AS rank "
            "FROM m WHERE row_feature = 'canceled' AND col_feature <> 'canceled'")


@register("target_correlation_rank", _target_corr_sql(), ["abs_r"])
def q_target_correlation_rank(spark, sf_dir):
    return P.target_correlation_rank(P.spearman_matrix(B(spark, sf_dir)))


@register("cancel_rate_repeat_guest", f"""
SELECT repeated_guest, {RATE},
       CASE repeated_guest WHEN 0 THEN 'New Guest' WHEN 1 THEN 'Repeat Guest' END AS guest_label
FROM bookings GROUP BY repeated_guest""", ["cancel_rate_pct"])
def q_cancel_rate_repeat_guest(spark, sf_dir):
    return P.cancel_rate_repeat_guest(B(spark, sf_dir))


@register("cancel_rate_prior_capped", f"""
SELECT LEAST(no_of_previous_cancellations, 5) AS prev_cancel_capped, {RATE},
       CASE WHEN LEAST(no_of_previous_cancellations, 5) = 5 THEN '5+'
            ELSE CAST(LEAST(no_of_previous_cancellations, 5) AS VARCHAR) END AS label
FROM bookings GROUP BY LEAST(no_of_previous_cancellations, 5)""", ["cancel_rate_pct"])
def q_cancel_rate_prior_capped(spark, sf_dir):
    return P.cancel_rate_prior_capped(B(spark, sf_dir))


def _hist_sql(expr: str, where: str, bins: int, name: str, by: str | None = None,
              src: str = "bookings", prefix: str = "") -> str:
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return prefix + f"""
, hv AS (SELECT {g}CAST({expr} AS DOUBLE) AS v FROM {src} WHERE {where}),
  hr AS (SELECT {g}MIN(v) AS lo, MAX(v) AS hi, COUNT(*) AS n FROM hv {'GROUP BY ' + by if by else ''}),
  hb AS (SELECT {g}CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(FLOOR((v - lo) * {bins} / (hi - lo)), {bins - 1}) END
                AS BIGINT) AS bin, lo, hi, n FROM hv JOIN hr {on})
SELECT '{name}' AS series, {g}bin, lo + bin * ((hi - lo) / {bins}) AS bin_lo,
       lo + (bin + 1) * ((hi - lo) / {bins}) AS bin_hi, COUNT(*) AS count,
       CAST(COUNT(*) AS DOUBLE) / (n * ((hi - lo) / {bins})) AS density
FROM hb GROUP BY {g}bin, lo, hi, n"""


_HIST = ["bin_lo", "bin_hi", "density"]


@register("histogram", _hist_sql("avg_price_per_room", "avg_price_per_room IS NOT NULL", 80,
                                 "avg_price_per_room"), ["bin_lo", "bin_hi", "density"])
def q_histogram(spark, sf_dir):
    return P.histogram(B(spark, sf_dir), F.col("avg_price_per_room"), 80, "avg_price_per_room")


@register("histogram_log_lead_time", _hist_sql("ln(1 + lead_time)", "lead_time IS NOT NULL", 60,
                                               "log1p_lead_time"), _HIST)
def q_histogram_log_lead(spark, sf_dir):
    return P.histogram(B(spark, sf_dir), F.log1p("lead_time"), 60, "log1p_lead_time")


@register("histogram_log_price", _hist_sql("ln(1 + avg_price_per_room)", "avg_price_per_room > 0", 60,
                                           "log1p_price"), _HIST)
def q_histogram_log_price(spark, sf_dir):
    b = B(spark, sf_dir).where("avg_price_per_room > 0")
    return P.histogram(b, F.log1p("avg_price_per_room"), 60, "log1p_price")


@register("histogram_lead_time", _hist_sql("lead_time", "lead_time IS NOT NULL", 70, "lead_time"), _HIST)
def q_histogram_lead_time(spark, sf_dir):
    return P.histogram(B(spark, sf_dir), F.col("lead_time"), 70, "lead_time")


@register("histogram_lead_by_status", _hist_sql("lead_time", "lead_time IS NOT NULL", 60,
                                                "lead_time_density", "booking_status"), _HIST)
def q_histogram_lead_by_status(spark, sf_dir):
    return P.histogram(B(spark, sf_dir), F.col("lead_time"), 60, "lead_time_density",
                       ["booking_status"])


_BOX_SQL = """
, qs AS (
  SELECT booking_status, quantile_cont(avg_price_per_room, 0.25) AS q1,
         quantile_cont(avg_price_per_room, 0.5) AS median,
         quantile_cont(avg_price_per_room, 0.75) AS q3
  FROM bookings GROUP BY booking_status)
SELECT b.booking_status, q1, median, q3,
       MIN(CASE WHEN avg_price_per_room >= q1 - 1.5 * (q3 - q1) THEN avg_price_per_room END) AS whisker_lo,
       MAX(CASE WHEN avg_price_per_room <= q3 + 1.5 * (q3 - q1) THEN avg_price_per_room END) AS whisker_hi
FROM bookings b JOIN qs ON b.booking_status = qs.booking_status
GROUP BY b.booking_status, q1, median, q3"""


@register("box_stats_by_status", _BOX_SQL, ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
def q_box_stats_by_status(spark, sf_dir):
    return P.box_stats_by_status(B(spark, sf_dir))


@register("violin_quartiles", """
SELECT booking_status, quantile_cont(avg_price_per_room, 0.25) AS q1,
       quantile_cont(avg_price_per_room, 0.5) AS median, quantile_cont(avg_price_per_room, 0.75) AS q3
FROM bookings WHERE avg_price_per_room > 0 GROUP BY booking_status""", ["q1", "median", "q3"])
def q_violin_quartiles(spark, sf_dir):
    return P.violin_quartiles(B(spark, sf_dir))


def _erfc_sql(x: str) -> str:
    """erfc for x >= 0: a series of positive terms below 2, a continued fraction above, folded over lists."""
    series = (f"1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * ({x}) * list_reduce("
              f"list_prepend(1.0::DOUBLE, list_reverse(range(1, 90))::DOUBLE[]), "
              f"lambda acc, k: 1 + acc * 2 * ({x}) * ({x}) / (2 * k + 1))")
    fraction = (f"exp(-({x}) * ({x})) / sqrt(pi()) / list_reduce("
                f"list_prepend(({x})::DOUBLE, list_reverse(range(1, 120))::DOUBLE[]), lambda acc, k: ({x}) + k / 2 / acc)")
    return f"CASE WHEN ({x}) < 2 THEN {series} ELSE {fraction} END"


@register("mann_whitney", f"""
, mw AS (
  SELECT avg_price_per_room AS v, COUNT(*) AS n,
         SUM(CASE WHEN booking_status = 'Not_Canceled' THEN 1 ELSE 0 END) AS n1
  FROM bookings WHERE booking_status IN ('Not_Canceled', 'Canceled') AND avg_price_per_room IS NOT NULL
  GROUP BY avg_price_per_room),
  mr AS (SELECT *, COALESCE(SUM(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   + (n + 1) / 2.0 AS avg_rank FROM mw),
  ms AS (SELECT SUM(avg_rank * n1) AS r1, CAST(SUM(n1) AS DOUBLE) AS n1,
                CAST(SUM(n) - SUM(n1) AS DOUBLE) AS n2,
                SUM(POWER(CAST(n AS DOUBLE), 3) - n) AS tie_term FROM mr),
  mu AS (SELECT r1 - n1 * (n1 + 1) / 2 AS u1, n1, n2, tie_term FROM ms),
  mz AS (SELECT u1, n1, n2,
                (GREATEST(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5)
                / SQRT(n1 * n2 / 12 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS z
         FROM mu)
SELECT u1 AS u_statistic, z, LEAST(1.0, {_erfc_sql('z / sqrt(2.0)')}) AS p_value,
       CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, 'asymptotic' AS method,
       LEAST(1.0, {_erfc_sql('z / sqrt(2.0)')}) < 0.05 AS significant
FROM mz""", ["u_statistic", "z", "p_value"])
def q_mann_whitney(spark, sf_dir):
    return P.mann_whitney(B(spark, sf_dir))


@register("mann_whitney_room_types", """
, v AS (SELECT room_type_reserved AS room, booking_status AS s, AVG(avg_price_per_room) AS x
        FROM bookings WHERE booking_status IN ('Not_Canceled', 'Canceled') GROUP BY ALL),
  n AS (SELECT COUNT(*) FILTER (s = 'Not_Canceled') AS n1, COUNT(*) FILTER (s = 'Canceled') AS n2 FROM v),
  u AS (SELECT CAST(COUNT(*) AS DOUBLE) AS u1 FROM v a JOIN v b ON a.s = 'Not_Canceled' AND b.s = 'Canceled' AND a.x > b.x),
  -- every way to place n1 of the n1 + n2 ranks
  m AS (SELECT i AS mask FROM (SELECT UNNEST(range(CAST(power(2, n1 + n2) AS BIGINT))) AS i, n1 FROM n)
        WHERE bit_count(i) = n1),
  w AS (SELECT list_sum([CAST((mask >> k) & 1 AS BIGINT) * (k + 1) for k in range(n1 + n2)]) - n1 * (n1 + 1) / 2 AS u
        FROM m, n),
  t AS (SELECT GREATEST(u1, n1 * n2 - u1) AS top, u1, n1, n2 FROM u, n),
  p AS (SELECT LEAST(1.0, 2.0 * COUNT(*) FILTER (w.u >= top) / COUNT(*)) AS p FROM w, t)
SELECT u1 AS u_statistic, (top - n1 * n2 / 2 - 0.5) / SQRT(n1 * n2 / 12 * (n1 + n2 + 1)) AS z, p AS p_value,
  n1, n2, 'exact' AS method, p < 0.05 AS significant FROM t, p""", ["u_statistic", "z", "p_value"])
def q_mann_whitney_room_types(spark, sf_dir):
    """The same test on the mean price of each room type: few values and no ties, so the exact distribution."""
    means = B(spark, sf_dir).groupBy("room_type_reserved", "booking_status").agg(
        F.avg("avg_price_per_room").alias("avg_price_per_room"))
    return P.mann_whitney(means)


@register("dashboard_kpis", f"""
SELECT COUNT(*) AS total_bookings, AVG({CANCELED}) * 100.0 AS cancellation_rate,
       AVG(avg_price_per_room) AS avg_room_price,
       AVG(CAST(repeated_guest AS DOUBLE)) * 100.0 AS repeat_guest_rate,
       CAST(SUM({CANCELED}) AS BIGINT) AS total_canceled,
       CAST(SUM(1 - {CANCELED}) AS BIGINT) AS total_not_canceled
FROM bookings""", ["cancellation_rate", "avg_room_price", "repeat_guest_rate"])
def q_dashboard_kpis(spark, sf_dir):
    return P.dashboard_kpis(B(spark, sf_dir))


@register("cancel_rate_requests_rollup", f"""
SELECT CASE WHEN no_of_special_requests >= 3 THEN '3+' ELSE CAST(no_of_special_requests AS VARCHAR) END
       AS requests, {RATE}
FROM bookings GROUP BY 1""", ["cancel_rate_pct"])
def q_cancel_rate_requests_rollup(spark, sf_dir):
    return P.cancel_rate_requests_rollup(B(spark, sf_dir))


def _dash_lead_sql() -> str:
    cases = " ".join(f"WHEN lead_time >= {lo} AND lead_time <= {hi} THEN '{lab}'"
                     for lo, hi, lab in P.DASH_LEAD)
    return (f", db AS (SELECT *, CASE {cases} WHEN lead_time > 150 THEN '{P.DASH_LEAD_TOP}' END AS bucket "
            f"FROM bookings)\nSELECT bucket, {RATE} FROM db WHERE bucket IS NOT NULL GROUP BY bucket")


@register("dashboard_lead_buckets", _dash_lead_sql(), ["cancel_rate_pct"])
def q_dashboard_lead_buckets(spark, sf_dir):
    return P.dashboard_lead_buckets(B(spark, sf_dir))


@register("price_by_room_type", """
SELECT room_type_reserved, AVG(avg_price_per_room) AS avg_price FROM bookings
GROUP BY room_type_reserved""", ["avg_price"])
def q_price_by_room_type(spark, sf_dir):
    return P.price_by_room_type(B(spark, sf_dir))
