"""Scoring bookings with both models and the business rules.

The request/response service of the study becomes a DataFrame function: the
same ``score_bookings`` runs on a batch table or on a stream (see
``innsight.streaming``). Model settings (threshold, bands, target transform,
versions) are read from a metadata dict and enter the plan as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions.columns import col_or_name, risk_band
from innsight.operators.audit import REQUEST_FIELDS
from innsight.schema import RISK_BAND_TEXT, RISK_HIGH_LOWER, RISK_LOW_UPPER

# fixed values: response texts
NOTE_CLOSE = "Predicted price closely matches the current room price."
NOTE_ABOVE = "Predicted price is %s%% above the current room price — consider reviewing the rate."
NOTE_BELOW = "Current room price is %s%% above the predicted rate — strong value for the guest."
REC_LEAD = "Long lead time combined with elevated cancellation risk — consider early guest outreach."
REC_NO_REQUESTS = "No special requests on file — confirm booking details directly with the guest."


def default_cancellation_meta(threshold: float = 0.5, version: str = "1.0.0") -> dict:
    return {
        "version": version,
        "threshold": threshold,
        "risk_bands": {
            "low": {"upper_exclusive": RISK_LOW_UPPER, "description": RISK_BAND_TEXT["low"]},
            "medium": {"lower_inclusive": RISK_LOW_UPPER, "upper_exclusive": RISK_HIGH_LOWER,
                       "description": RISK_BAND_TEXT["medium"]},
            "high": {"lower_inclusive": RISK_HIGH_LOWER, "description": RISK_BAND_TEXT["high"]},
        },
    }


def scoring_inputs(requests: DataFrame, keep: list[str] | tuple = ("Booking_ID",)):
    """(classifier rows, price rows) from request rows: the classifier sees
    the current price as ``avg_price_per_room``; the price model never sees a
    price. Both get the zero-adults / zero-nights flags."""
    keep = [k for k in keep if k in requests.columns]
    flags = [(F.col("no_of_adults") == 0).cast("int").alias("is_zero_adults"),
             ((F.col("no_of_weekend_nights") + F.col("no_of_week_nights")) == 0)
             .cast("int").alias("is_zero_nights")]
    base = [f for f in REQUEST_FIELDS if f != "current_room_price"]
    clf = requests.select(*keep, *base, F.col("current_room_price").alias("avg_price_per_room"), *flags)
    reg = requests.select(*keep, *base, *flags)
    return clf, reg


def price_comparison(current, predicted) -> Column:
    """Struct(current, predicted, difference, difference_pct, note); amounts
    rounded to 2 decimals and the percentage to 1, half to even. The note
    uses the unrounded percentage (5 % gate)."""
    cur = col_or_name(current).cast("double")
    pred = col_or_name(predicted).cast("double")
    diff = pred - cur
    pct = F.when(cur > 0, diff / cur * 100).otherwise(F.lit(0.0))
    whole = F.format_string("%.0f", F.bround(F.abs(pct), 0))
    note = (F.when(F.abs(pct) < 5, F.lit(NOTE_CLOSE))
            .when(pct > 0, F.format_string(NOTE_ABOVE, whole))
            .otherwise(F.format_string(NOTE_BELOW, whole)))
    return F.struct(F.bround(cur, 2).alias("current_room_price"),
                    F.bround(pred, 2).alias("predicted_room_price"),
                    F.bround(diff, 2).alias("difference"),
                    F.bround(pct, 1).alias("difference_pct"),
                    note.alias("note"))


def recommendations(band, lead_time, requests, comparison, meta: dict) -> Column:
    """Array of action texts: the band's description; the price note when the
    rounded gap is at least 10 %; early outreach for lead > 150 days at medium
    or high risk; a confirmation call for high risk with no requests."""
    b = col_or_name(band)
    c = col_or_name(comparison)
    desc = F.lit(None).cast("string")
    for name in ("low", "medium", "high"):
        desc = F.when(b == name, F.lit(meta["risk_bands"][name]["description"])).otherwise(desc)
    items = [
        (desc.isNotNull(), desc),
        (F.abs(c["difference_pct"]) >= 10, c["note"]),
        ((col_or_name(lead_time) > 150) & b.isin("medium", "high"), F.lit(REC_LEAD)),
        ((col_or_name(requests) == 0) & (b == "high"), F.lit(REC_NO_REQUESTS)),
    ]
    return optional_array(items)


def optional_array(items: list[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds, in order. Built with
    ``concat`` of one- or zero-element arrays, which stays in generated code
    (a higher-order ``filter`` would be interpreted per row)."""
    empty = F.array().cast("array<string>")
    parts = [F.when(cond, F.array(val.cast("string"))).otherwise(empty) for cond, val in items]
    return F.concat(*parts)


def band_expr(prob: Column, meta: dict) -> Column:
    rb = meta["risk_bands"]
    return risk_band(prob, rb["low"]["upper_exclusive"], rb["high"]["lower_inclusive"])


def apply_rules(df: DataFrame, prob: str, price: str, clf_meta: dict, reg_meta: dict,
                request_id: str | None = "Booking_ID") -> DataFrame:
    """The response row from a probability and a predicted price column."""
    p = F.col(prob)
    band = band_expr(p, clf_meta)
    label = F.when(p >= F.lit(float(clf_meta["threshold"])), F.lit("Canceled")).otherwise(
        F.lit("Not_Canceled"))
    rid = (F.col(request_id).cast("string") if request_id
           else F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 8))
    out = df.withColumns({
        "request_id": rid,
        "cancellation_probability": F.bround(p, 4),
        "cancellation_label": label,
        "cancellation_risk_band": band,
        "predicted_room_price": F.bround(F.greatest(F.lit(0.0), F.col(price)), 2),
        "price_comparison": price_comparison("current_room_price",
                                             F.greatest(F.lit(0.0), F.col(price))),
    })
    out = out.withColumn("recommendations", recommendations(
        "cancellation_risk_band", "lead_time", "no_of_special_requests", "price_comparison",
        clf_meta))
    return out.withColumn("model_versions", F.struct(
        F.lit(clf_meta.get("version", "unknown")).alias("cancellation"),
        F.lit(reg_meta.get("version", "unknown")).alias("price")))


RESPONSE_COLUMNS = ["request_id", "cancellation_probability", "cancellation_label",
                    "cancellation_risk_band", "predicted_room_price", "price_comparison",
                    "recommendations", "model_versions"]


def flatten_response(scored: DataFrame) -> DataFrame:
    """One flat row per response (structs expanded, recommendations joined)."""
    pc = F.col("price_comparison")
    return scored.select(
        "request_id", "cancellation_probability", "cancellation_label", "cancellation_risk_band",
        "predicted_room_price",
        pc["current_room_price"].alias("current_room_price"),
        pc["difference"].alias("difference"), pc["difference_pct"].alias("difference_pct"),
        pc["note"].alias("note"),
        F.size("recommendations").alias("n_recommendations"),
        F.array_join("recommendations", " | ").alias("recommendations"),
        F.col("model_versions.cancellation").alias("cancellation_version"),
        F.col("model_versions.price").alias("price_version"))


@dataclass
class Scorer:
    """Both fitted models and their metadata; ``score`` is a pure DataFrame
    transformation usable on a batch or a streaming DataFrame."""

    clf_model: object
    reg_model: object
    clf_meta: dict
    reg_meta: dict
    calibrator: object | None = None
    calibration_method: str | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark, runs: str, cancellation: str, price: str, versions: tuple = (None, None)) -> "Scorer":
        """A scorer from saved runs: the last record of each model (of the given version) names
        its folder, bands and target transform; calibrator and threshold are in the pipeline."""
        from innsight.sources.tables import load_production, run_of_version
        records = {n: run_of_version(spark, runs, n, v) for n, v in zip((cancellation, price), versions)}
        missing = [n for n, r in records.items() if r is None]
        if missing:
            raise ValueError(f"no run record of {', '.join(missing)} in {runs}")
        c, p = records[cancellation], records[price]
        bands = {b["band"]: {k: b[k] for k in ("lower_inclusive", "upper_exclusive", "description")
                             if b[k] is not None} for b in c["risk_bands"]}
        return cls(load_production(spark, c["model_path"]), load_production(spark, p["model_path"]),
                   {**c, "risk_bands": bands}, p)

    def score(self, requests: DataFrame, request_id: str | None = "Booking_ID") -> DataFrame:
        """One response per request row. ``request_id=None`` gives every row a
        random id, so micro-batches of id-less requests don't collide."""
        from pyspark.ml.functions import vector_to_array

        from innsight.operators.evaluate import apply_calibrator
        # both models run on the same rows: one projection carries every field
        rows = requests.withColumns({
            "avg_price_per_room": F.col("current_room_price"),
            "is_zero_adults": (F.col("no_of_adults") == 0).cast("int"),
            "is_zero_nights": ((F.col("no_of_weekend_nights") + F.col("no_of_week_nights")) == 0)
            .cast("int")})
        scored = self.clf_model.transform(rows)
        if "prob_cal" in scored.columns:      # the pipeline ends with its calibrator
            scored = scored.withColumn("_p", F.col("prob_cal")).select(*rows.columns, "_p")
        else:
            scored = scored.withColumn("_raw", vector_to_array("probability")[1]).select(*rows.columns, "_raw")
            if self.calibrator is not None:
                scored = apply_calibrator(scored, self.calibrator, self.calibration_method, "_raw", "_p")
            else:
                scored = scored.withColumn("_p", F.col("_raw"))
        # the price model must not see the price: drop it before transforming
        priced = self.reg_model.transform(scored.drop("avg_price_per_room"))
        pred = F.col("prediction")
        if self.reg_meta.get("target_transformation") == "log1p":
            pred = F.expm1(pred)
        priced = priced.withColumn("_price", pred)
        cols = [c for c in scored.columns] + ["_price"]
        priced = priced.select(*[c for c in cols if c in priced.columns])
        return apply_rules(priced, "_p", "_price", self.clf_meta, self.reg_meta, request_id)


@dataclass
class ReleasedScorer:
    """The scorer of the current release; ``current()`` loads a new one when the pointer row has changed."""

    spark: object
    base: str
    _sequence: int = 0
    _scorer: Scorer | None = None

    def current(self) -> Scorer:
        from innsight.sources.tables import current_release
        now = current_release(self.spark, self.base)
        if now is None:
            raise ValueError(f"nothing is released in {self.base}")
        if now["sequence"] != self._sequence:
            c, p = now["cancellation"], now["price"]
            self._scorer = Scorer.load(self.spark, now["runs"], c["name"], p["name"], (c["version"], p["version"]))
            self._sequence = now["sequence"]
        return self._scorer
