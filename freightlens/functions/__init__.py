"""Column expressions; all of them stay inside generated JVM code."""

from freightlens.functions.geo import direction_code, haversine_km
from freightlens.functions.scalars import (
    add, clean, clip_upper, fill, flag, floor_div, log1p, one_of, product, ratio, text_length,
)
from freightlens.functions.times import (
    days_between, days_left_in_month, hours_between, iso_week, weekday,
)

__all__ = [
    "add", "clean", "clip_upper", "days_between", "days_left_in_month", "direction_code",
    "fill", "flag", "floor_div", "haversine_km", "hours_between", "iso_week", "log1p",
    "one_of", "product", "ratio", "text_length", "weekday",
]
