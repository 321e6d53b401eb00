"""Column expressions shared by the operators.

All are built-in Spark expressions (JVM side, whole-stage codegen); none is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.schema import MONTH_ABBR, POSITIVE_STATUS, RISK_HIGH_LOWER, RISK_LOW_UPPER


def scalar(one_row, name: str) -> Column:
    """Column ``name`` of a one-row DataFrame (a global aggregate) as an
    uncorrelated scalar subquery. Catalyst runs the aggregate once, merges
    sibling subqueries over the same aggregate into one job and inlines the
    value: no join, and the consuming stage stays in generated code."""
    return one_row.select(name).scalar()


def scalars(one_row, names=None) -> dict[str, Column]:
    """``{name: scalar(one_row, name)}`` for the given (default: all) columns."""
    return {n: scalar(one_row, n) for n in (names or one_row.columns)}


def col_or_name(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_canceled(status="booking_status") -> Column:
    """1 when the booking was canceled, else 0 (also when the status is null)."""
    return F.coalesce((col_or_name(status) == F.lit(POSITIVE_STATUS)).cast("int"), F.lit(0))


def arrival_as_date(year="arrival_year", month="arrival_month", day="arrival_date") -> Column:
    """The arrival date, or NULL when (year, month, day) is not a calendar date.

    ``try_to_date`` returns NULL for Feb 30 or month 13 instead of raising
    under ANSI mode, which is what makes the validity rules one expression.
    """
    text = F.concat_ws("-", col_or_name(year).cast("string"),
                       col_or_name(month).cast("string"), col_or_name(day).cast("string"))
    return F.try_to_date(text, "yyyy-M-d")


def valid_arrival(year="arrival_year", month="arrival_month", day="arrival_date") -> Column:
    return arrival_as_date(year, month, day).isNotNull()


def arrival_dow(year="arrival_year", month="arrival_month", day="arrival_date") -> Column:
    """Day of week, Monday=0 .. Sunday=6; -1 when the date is not valid."""
    return F.coalesce(F.weekday(arrival_as_date(year, month, day)), F.lit(-1))


def arrival_season(month="arrival_month") -> Column:
    """Dec-Feb=0, Mar-May=1, Jun-Aug=2, Sep-Nov=3; any other month -> 0."""
    m = col_or_name(month)
    return (F.when(m.between(1, 12), F.floor(F.pmod(m, F.lit(12)) / 3))
            .otherwise(F.lit(0)).cast("int"))


def month_abbr(month="arrival_month") -> Column:
    """Three-letter English month name for months 1..12, else NULL."""
    names = F.array(*[F.lit(x) for x in MONTH_ABBR])
    m = col_or_name(month)
    return F.when(m.between(1, 12), F.element_at(names, F.greatest(F.lit(1), F.least(F.lit(12), m)).cast("int")))


def pct(numer: Column, denom: Column) -> Column:
    """numer / denom * 100 as a double; NULL when denom is 0."""
    return F.try_divide(numer.cast("double") * 100.0, denom.cast("double"))


def r6(c: Column) -> Column:
    """Round to 6 decimals for cross-engine comparison of doubles."""
    return F.round(c.cast("double"), 6)


def risk_band(prob, low_upper: float = RISK_LOW_UPPER,
              high_lower: float = RISK_HIGH_LOWER) -> Column:
    p = col_or_name(prob)
    return (F.when(p < F.lit(low_upper), F.lit("low"))
            .when(p < F.lit(high_lower), F.lit("medium"))
            .otherwise(F.lit("high")))


def stay_nights(check_in, check_out) -> Column:
    """Struct(weekday, weekend, total) nights between two dates.

    A night is indexed by the date slept (check-in up to but excluding
    check-out); Saturday and Sunday nights are weekend nights. Missing or
    unparsable dates, or check-out not after check-in, give zeros.
    """
    ci = F.try_to_date(col_or_name(check_in).cast("string"), "yyyy-MM-dd")
    co = F.try_to_date(col_or_name(check_out).cast("string"), "yyyy-MM-dd")
    ok = ci.isNotNull() & co.isNotNull() & (co > ci)
    total = F.when(ok, F.datediff(co, ci)).otherwise(F.lit(0))
    # nights d = 0..total-1 fall on weekday (w + d) mod 7 (Monday = 0): two per
    # full week, plus Saturday / Sunday if they occur in the remaining days
    w = F.weekday(ci)
    rest = F.pmod(total, F.lit(7))
    weekend = F.when(ok, 2 * F.floor(total / 7)
                     + F.when(F.pmod(5 - w, F.lit(7)) < rest, 1).otherwise(0)
                     + F.when(F.pmod(6 - w, F.lit(7)) < rest, 1).otherwise(0)).otherwise(F.lit(0))
    return F.struct(
        (total - weekend).cast("bigint").alias("weekday"),
        weekend.cast("bigint").alias("weekend"),
        total.cast("bigint").alias("total"),
    )


def arrival_parts(date_text) -> Column:
    """Struct(arrival_year, arrival_month, arrival_date) from 'YYYY-MM-DD' text.

    The text is split on '-' and each part converted to a number, with no
    calendar check, so '2018-02-30' gives (2018, 2, 30).
    """
    parts = F.split(col_or_name(date_text), "-")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("arrival_year"),
        F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("arrival_month"),
        F.try_element_at(parts, F.lit(3)).try_cast("bigint").alias("arrival_date"),
    )
