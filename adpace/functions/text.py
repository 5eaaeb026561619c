"""Display text: labels, percent, thousands and CTR formatting.

``format_number`` rounds the exact binary value half-even; its thousands
separators are dropped where the text has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adpace import schema as S


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(S.MISSING_TEXT))


def order_label(order_name: Column, advertiser_name: Column) -> Column:
    """``name — advertiser``; a missing part reads as text."""
    return F.concat(_text(order_name), F.lit(S.LABEL_SEPARATOR), _text(advertiser_name))


def line_item_label(name: Column, line_item_id: Column) -> Column:
    """``name (id)``."""
    return F.concat(_text(name), F.lit(" ("), _text(line_item_id), F.lit(")"))


def fixed_decimals(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals and no separators."""
    return F.translate(F.format_number(value.cast("double"), digits), ",", "")


def percent_text(fraction: Column) -> Column:
    """``12.3%`` from a fraction; missing reads as ``0.0%``."""
    value = F.coalesce(fraction.cast("double"), F.lit(0.0)) * 100.0
    return F.concat(fixed_decimals(value, 1), F.lit("%"))


def thousands_text(value: Column) -> Column:
    """``1,234``, truncated to an integer; missing reads as ``0``."""
    return F.format_number(F.coalesce(value.cast("bigint"), F.lit(0)), 0)


def index_text(index: Column, missing: str) -> Column:
    """A pacing index with two decimals, or ``missing``."""
    return F.coalesce(fixed_decimals(index, 2), F.lit(missing))


def ctr_text(ctr: Column) -> Column:
    """CTR as percent text; values up to 1 are fractions, above are percents."""
    percent = F.when(ctr <= 1, ctr.cast("double") * 100.0).otherwise(ctr.cast("double"))
    return F.coalesce(F.concat(fixed_decimals(percent, 2), F.lit("%")), F.lit("-"))
