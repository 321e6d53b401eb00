"""SQL text pieces shared by oracle queries (DuckDB dialect)."""

from __future__ import annotations

from innsight.schema import SEED

VALID_DATE = ("try_cast(concat_ws('-', CAST(arrival_year AS VARCHAR), CAST(arrival_month AS VARCHAR), "
              "CAST(arrival_date AS VARCHAR)) AS DATE) IS NOT NULL")
CANCELED = "CASE WHEN booking_status = 'Canceled' THEN 1 ELSE 0 END"

# the cleaned modelling rows: valid dates, flags and label
CLEAN_CTE = f"""
, clean AS (
  SELECT *, CAST(no_of_adults = 0 AS INTEGER) AS is_zero_adults,
         CAST(no_of_weekend_nights + no_of_week_nights = 0 AS INTEGER) AS is_zero_nights,
         CAST(avg_price_per_room = 0 AS INTEGER) AS price_is_zero,
         CAST(booking_status = 'Canceled' AS INTEGER) AS label
  FROM bookings WHERE {VALID_DATE})"""


def split_cte(src: str, out: str, strata: str | None = "label", seed: int = SEED,
              test_size: float = 0.2, val_size: float = 0.25) -> str:
    """CTEs that add ``split`` to every row of ``src`` (named ``out``): rows
    ordered by md5('<seed>:' || Booking_ID) || '|' || Booking_ID within each
    stratum; the first n_test are test, the next n_val are val. Per-class
    sizes: floors plus largest remainders, two stages."""
    s = strata or "0"
    p = f"_{out}"
    return f"""
, {p}k AS (SELECT *, {s} AS _s, md5('{seed}:' || Booking_ID) || '|' || Booking_ID AS _key FROM {src}),
  {p}c AS (SELECT _s, COUNT(*) AS n_c FROM {p}k GROUP BY _s),
  {p}t AS (SELECT SUM(n_c) AS n, CAST(CEIL({test_size} * SUM(n_c)) AS BIGINT) AS n_test FROM {p}c),
  {p}a AS (SELECT _s, n_c, FLOOR(CAST(n_c AS DOUBLE) / n * (n - n_test)) AS fl,
                  CAST(n_c AS DOUBLE) / n * (n - n_test) - FLOOR(CAST(n_c AS DOUBLE) / n * (n - n_test)) AS fr
           FROM {p}c, {p}t),
  {p}b AS (SELECT *, ROW_NUMBER() OVER (ORDER BY fr DESC, CAST(_s AS VARCHAR)) AS rr FROM {p}a),
  {p}d AS (SELECT _s, n_c, CAST(fl + CASE WHEN rr <= (SELECT n - n_test FROM {p}t) - (SELECT SUM(fl) FROM {p}a)
                                   THEN 1 ELSE 0 END AS BIGINT) AS tr1 FROM {p}b),
  {p}u AS (SELECT SUM(tr1) AS n_tv, CAST(CEIL({val_size} * SUM(tr1)) AS BIGINT) AS n_val FROM {p}d),
  {p}e AS (SELECT _s, n_c, tr1, FLOOR(CAST(tr1 AS DOUBLE) / n_tv * (n_tv - n_val)) AS fl,
                  CAST(tr1 AS DOUBLE) / n_tv * (n_tv - n_val) - FLOOR(CAST(tr1 AS DOUBLE) / n_tv * (n_tv - n_val)) AS fr
           FROM {p}d, {p}u),
  {p}f AS (SELECT *, ROW_NUMBER() OVER (ORDER BY fr DESC, CAST(_s AS VARCHAR)) AS rr FROM {p}e),
  {p}g AS (SELECT _s, n_c - tr1 AS n_test_c,
                  tr1 - CAST(fl + CASE WHEN rr <= (SELECT n_tv - n_val FROM {p}u) - (SELECT SUM(fl) FROM {p}e)
                                  THEN 1 ELSE 0 END AS BIGINT) AS n_val_c FROM {p}f),
  {p}r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY _s ORDER BY _key) AS _rn FROM {p}k),
  {out} AS (SELECT r.* EXCLUDE (_s, _key, _rn),
                   CASE WHEN _rn <= n_test_c THEN 'test' WHEN _rn <= n_test_c + n_val_c THEN 'val'
                        ELSE 'train' END AS split
            FROM {p}r r JOIN {p}g g ON r._s = g._s)"""


# fixed values: the deterministic score used to check evaluation operators
# without a trained model (lead time is the strongest planted signal)
DET_PROB_SQL = "LEAST(1.0, GREATEST(0.0, CAST(lead_time AS DOUBLE) / 443))"

SCORED_CTE = CLEAN_CTE + split_cte("clean", "splits") + f"""
, scored AS (SELECT Booking_ID, label, split, lead_time, no_of_special_requests,
                    {DET_PROB_SQL} AS prob FROM splits)"""

# price rows with their own unstratified split, and a deterministic
# prediction: the training mean price of the row's market segment
PRICE_CTE = CLEAN_CTE + f"""
, price_rows AS (SELECT * FROM clean WHERE avg_price_per_room > 0)""" + split_cte(
    "price_rows", "psplits", None) + """
, seg_mean AS (SELECT market_segment_type, AVG(avg_price_per_room) AS seg_price
               FROM psplits WHERE split = 'train' GROUP BY market_segment_type),
  priced AS (SELECT p.Booking_ID, p.split, p.market_segment_type, p.avg_price_per_room AS actual,
                    s.seg_price AS predicted
             FROM psplits p LEFT JOIN seg_mean s ON p.market_segment_type = s.market_segment_type)"""

# the derived features as DuckDB expressions over a bookings-shaped row
FEATURE_SQL = {
    "total_nights": "no_of_weekend_nights + no_of_week_nights",
    "total_guests": "no_of_adults + no_of_children",
    "has_children": "CAST(no_of_children > 0 AS INTEGER)",
    "log_lead_time": "ln(1 + lead_time)",
    "log_price": "ln(1 + avg_price_per_room)",
    "price_is_zero": "CAST(avg_price_per_room = 0 AS INTEGER)",
    "is_weekend_stay": "CAST(no_of_weekend_nights > 0 AS INTEGER)",
    "has_special_request": "CAST(no_of_special_requests > 0 AS INTEGER)",
    "prior_cancel_rate": ("CAST(no_of_previous_cancellations AS DOUBLE) / (no_of_previous_cancellations"
                          " + no_of_previous_bookings_not_canceled + 1e-9)"),
    "arrival_season": ("CAST(CASE WHEN arrival_month BETWEEN 1 AND 12 THEN FLOOR((arrival_month % 12) / 3)"
                       " ELSE 0 END AS INTEGER)"),
    "arrival_dow": (f"CAST(COALESCE(isodow(try_cast(concat_ws('-', CAST(arrival_year AS VARCHAR), "
                    f"CAST(arrival_month AS VARCHAR), CAST(arrival_date AS VARCHAR)) AS DATE)) - 1, -1) AS INTEGER)"),
}
PRICE_FEATURES = [k for k in FEATURE_SQL if k not in ("log_price", "price_is_zero")]


def features_select(kind: str = "cancellation") -> str:
    keys = list(FEATURE_SQL) if kind == "cancellation" else PRICE_FEATURES
    return ", ".join(f"{FEATURE_SQL[k]} AS {k}" for k in keys)
