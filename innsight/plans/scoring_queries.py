"""Registered queries for scoring and business rules.

The rule queries use a deterministic probability (lead time) and price
(training mean of the market segment), so the whole response can be checked
against SQL; ``score_bookings`` / ``score_stream`` use fitted models.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.operators.audit import as_requests
from innsight.operators.ranks import bounded_broadcast
from innsight.operators.scoring import (NOTE_ABOVE, NOTE_BELOW, NOTE_CLOSE, REC_LEAD,
                                        REC_NO_REQUESTS, apply_rules, default_cancellation_meta,
                                        flatten_response, scoring_inputs)
from innsight.plans.evaluate_queries import CHOSEN_THRESHOLD
from innsight.plans.prepared import deterministic_prob, price_split_table
from innsight.plans.registry import register
from innsight.plans.sqltext import DET_PROB_SQL, PRICE_CTE
from innsight.schema import RISK_BAND_TEXT
from innsight.sources.bookings import bookings_table

CLF_META = default_cancellation_meta(CHOSEN_THRESHOLD, "1.0.0")
REG_META = {"version": "1.0.0", "target_transformation": "raw"}


def _requests_with_scores(spark, sf_dir):
    req = as_requests(bookings_table(spark, sf_dir))
    seg = (price_split_table(spark, sf_dir).where("split = 'train'").groupBy("market_segment_type")
           .agg(F.avg("avg_price_per_room").alias("price")))
    return deterministic_prob(req.join(bounded_broadcast(seg), "market_segment_type", "left"))


def _rules(spark, sf_dir):
    return apply_rules(_requests_with_scores(spark, sf_dir), "prob", "price", CLF_META, REG_META)


_REQ_CTE = PRICE_CTE + f"""
, req AS (SELECT b.*, s.seg_price, {DET_PROB_SQL} AS prob,
                 CASE WHEN b.avg_price_per_room > 0
                      THEN (GREATEST(0, s.seg_price) - b.avg_price_per_room) / b.avg_price_per_room * 100
                      ELSE 0.0 END AS pct
          FROM bookings b LEFT JOIN seg_mean s ON b.market_segment_type = s.market_segment_type),
  rq AS (SELECT *,
           CASE WHEN ABS(pct) < 5 THEN '{NOTE_CLOSE}'
                WHEN pct > 0 THEN printf('{NOTE_ABOVE.replace('%s', '%s')}', printf('%.0f', round_even(ABS(pct), 0)))
                ELSE printf('{NOTE_BELOW}', printf('%.0f', round_even(ABS(pct), 0))) END AS note,
           CASE WHEN prob < 0.3 THEN 'low' WHEN prob < 0.6 THEN 'medium' ELSE 'high' END AS band
         FROM req),
  rr AS (SELECT *, list_filter([
           CASE band WHEN 'low' THEN '{RISK_BAND_TEXT['low']}' WHEN 'medium' THEN '{RISK_BAND_TEXT['medium']}'
                     ELSE '{RISK_BAND_TEXT['high']}' END,
           CASE WHEN ABS(round_even(pct, 1)) >= 10 THEN note END,
           CASE WHEN lead_time > 150 AND band IN ('medium', 'high') THEN '{REC_LEAD}' END,
           CASE WHEN no_of_special_requests = 0 AND band = 'high' THEN '{REC_NO_REQUESTS}' END],
           lambda x: x IS NOT NULL) AS recs
         FROM rq)"""


@register("scoring_inputs", """
SELECT Booking_ID, no_of_adults, no_of_children, no_of_weekend_nights, no_of_week_nights,
       type_of_meal_plan, required_car_parking_space, room_type_reserved, lead_time, arrival_year,
       arrival_month, arrival_date, market_segment_type, repeated_guest, no_of_previous_cancellations,
       no_of_previous_bookings_not_canceled, no_of_special_requests, avg_price_per_room,
       CAST(no_of_adults = 0 AS INTEGER) AS is_zero_adults,
       CAST(no_of_weekend_nights + no_of_week_nights = 0 AS INTEGER) AS is_zero_nights
FROM bookings""", ["avg_price_per_room"])
def q_scoring_inputs(spark, sf_dir):
    clf, _ = scoring_inputs(as_requests(bookings_table(spark, sf_dir)))
    return clf


@register("scoring_inputs_price", """
SELECT Booking_ID, no_of_adults, no_of_children, no_of_weekend_nights, no_of_week_nights,
       type_of_meal_plan, required_car_parking_space, room_type_reserved, lead_time, arrival_year,
       arrival_month, arrival_date, market_segment_type, repeated_guest, no_of_previous_cancellations,
       no_of_previous_bookings_not_canceled, no_of_special_requests,
       CAST(no_of_adults = 0 AS INTEGER) AS is_zero_adults,
       CAST(no_of_weekend_nights + no_of_week_nights = 0 AS INTEGER) AS is_zero_nights
FROM bookings""")
def q_scoring_inputs_price(spark, sf_dir):
    """What the price model sees: no price."""
    return scoring_inputs(as_requests(bookings_table(spark, sf_dir)))[1]


@register("price_comparison", _REQ_CTE + """
SELECT Booking_ID, round_even(avg_price_per_room, 2) AS current_room_price,
       round_even(GREATEST(0, seg_price), 2) AS predicted_room_price,
       round_even(GREATEST(0, seg_price) - avg_price_per_room, 2) AS difference,
       round_even(pct, 1) AS difference_pct, note
FROM rq""", ["current_room_price", "predicted_room_price", "difference", "difference_pct"])
def q_price_comparison(spark, sf_dir):
    pc = F.col("price_comparison")
    return _rules(spark, sf_dir).select(
        "Booking_ID", pc["current_room_price"].alias("current_room_price"),
        pc["predicted_room_price"].alias("predicted_room_price"),
        pc["difference"].alias("difference"), pc["difference_pct"].alias("difference_pct"),
        pc["note"].alias("note"))


@register("recommendations", _REQ_CTE + """
SELECT Booking_ID, band AS risk_band, CAST(len(recs) AS INTEGER) AS n_recommendations,
       array_to_string(recs, ' | ') AS recommendations FROM rr""")
def q_recommendations(spark, sf_dir):
    return _rules(spark, sf_dir).select(
        "Booking_ID", F.col("cancellation_risk_band").alias("risk_band"),
        F.size("recommendations").alias("n_recommendations"),
        F.array_join("recommendations", " | ").alias("recommendations"))


@register("score_report", _REQ_CTE + f"""
SELECT Booking_ID AS request_id, round_even(prob, 4) AS cancellation_probability,
       CASE WHEN prob >= {CHOSEN_THRESHOLD} THEN 'Canceled' ELSE 'Not_Canceled' END AS cancellation_label,
       band AS cancellation_risk_band, round_even(GREATEST(0, seg_price), 2) AS predicted_room_price,
       round_even(avg_price_per_room, 2) AS current_room_price,
       round_even(GREATEST(0, seg_price) - avg_price_per_room, 2) AS difference,
       round_even(pct, 1) AS difference_pct, note, CAST(len(recs) AS INTEGER) AS n_recommendations,
       array_to_string(recs, ' | ') AS recommendations,
       '1.0.0' AS cancellation_version, '1.0.0' AS price_version
FROM rr""", ["cancellation_probability", "predicted_room_price", "current_room_price", "difference",
             "difference_pct"])
def q_score_report(spark, sf_dir):
    return flatten_response(_rules(spark, sf_dir))
