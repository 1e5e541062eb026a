"""Number reading, number display and derived attributes used by pivot grids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The leading number of a text, as browsers read it.
LEADING_NUMBER = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"

# Month and day names of the date deriver.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def num(column: str, dtype: T.DataType) -> Column:
    """Numeric reading of a column: numbers pass through, text gives its leading number, else NULL."""
    value = F.col(column)
    if isinstance(dtype, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(value), value.cast("double"))
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    return F.regexp_extract(value.cast("string"), LEADING_NUMBER, 1).try_cast("double")


def bin_down(value: Column, width: float) -> Column:
    """Lower end of the bin: ``x - x % width``, the remainder taking the sign of ``x``."""
    number = value.cast("string").try_cast("double")
    return number - number % F.lit(float(width))


def date_text(value: Column, pattern: str) -> Column:
    """Format a date or a parseable text.

    ``%y`` year, ``%m`` month, ``%n`` month name, ``%d`` day, ``%w`` day name, ``%x``
    day number from Sunday, ``%H %M %S`` time.  A bad date gives the empty string.
    """
    moment = F.try_to_timestamp(value.cast("string"))
    weekday = F.dayofweek(moment) - 1
    fields = {
        "y": F.year(moment).cast("string"),
        "m": F.date_format(moment, "MM"),
        "n": F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(moment)),
        "d": F.date_format(moment, "dd"),
        "w": F.element_at(F.array(*map(F.lit, DAY_NAMES)), weekday + 1),
        "x": weekday.cast("string"),
        "H": F.date_format(moment, "HH"),
        "M": F.date_format(moment, "mm"),
        "S": F.date_format(moment, "ss"),
    }
    pieces = [
        fields.get(piece[1], F.lit(piece)) if piece.startswith("%") and len(piece) == 2 else F.lit(piece)
        for piece in re.findall(r"%.|[^%]+|%", pattern, flags=re.S)
    ]
    return F.when(moment.isNull(), "").otherwise(F.concat(*pieces))


def number_text(value: Column, digits: int = 2, scale: float = 1, suffix: str = "", show_zero: bool = False) -> Column:
    """Thousands-separated text; blank for NULL, NaN, infinity and (unless shown) zero."""
    value = value.cast("double")
    scaled = value * F.lit(float(scale))
    # A value exactly half way rounds away from zero; it is an odd multiple of 2^-(digits+1).
    half_way = F.abs((scaled * float(2 ** (digits + 1))) % 2) == 1
    text = F.concat(F.format_number(F.when(half_way, scaled * (1 + 1e-12)).otherwise(scaled), digits), F.lit(suffix))
    blank = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    if not show_zero:
        blank = blank | (value == 0)
    return F.when(blank, "").otherwise(text)


def integer_text(value: Column) -> Column:
    return number_text(value, digits=0)


def percent_text(value: Column) -> Column:
    return number_text(value, digits=1, scale=100, suffix="%")
