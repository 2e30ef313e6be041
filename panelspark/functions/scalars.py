"""Scalar expressions that several operators share."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.spec import RUL_CAP


def clip(x: Column, lo, hi) -> Column:
    """X between lo and hi; NaN stays NaN (Spark would take it for the largest value), null stays null."""
    return F.when(F.isnan(x.cast("double")), x).when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding of halves to even."""
    return F.bround(x, digits)


def whole_share(n: Column, share: float) -> Column:
    """How many of n rows the first `share` are, the share as it is written: 63 of 90 at 0.7, where doubles give 62.99."""
    return F.floor(n.cast("bigint") * F.lit(Decimal(str(share)))).cast("bigint")


def penalty(true: Column, predicted: Column) -> Column:
    """The asymmetric cost of one prediction; late ones cost more. The error is clipped to +-100."""
    d = clip(predicted - true, -100.0, 100.0)
    return F.when(d < 0, F.exp(-d / 13) - 1).otherwise(F.exp(d / 10) - 1)


def regime_key(*settings: Column) -> Column:
    """Settings rounded to one decimal, joined by an underscore."""
    return F.concat_ws("_", *[half_even(c, 1).cast("string") for c in settings])


def file_name(name: Column) -> Column:
    """Parentheses dropped, commas and spaces to underscores."""
    return F.translate(F.regexp_replace(name, r"[()]", ""), ", ", "__")


def base_model(name: Column, suffix: str = "+cal80") -> Column:
    """A model's name without the calibration suffix."""
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def model_label(kind: str, *order: Column) -> Column:
    """Such as ARIMA(1,2,2)."""
    return F.format_string(f"{kind}(" + ",".join("%d" for _ in order) + ")", *order)


def parse_time(text: Column) -> Column:
    """G8."""
    return F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss")


def format_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def maintenance_zone(lower: Column) -> Column:
    """What to do, by the lower bound of the remaining life."""
    return F.when(lower <= 15, "immediate").when(lower <= 40, "plan").when(lower.isNotNull(), "monitor")


def in_range(x: Column, cap: int = RUL_CAP) -> Column:
    return (x >= 0) & (x <= cap)
