"""Rollups of raw delivery rows to order, line-item and creative-size grain.

Each rollup is one ``groupBy``: rows combine inside the scan tasks before the
single shuffle, so a key that holds a large part of all rows arrives as one
partial row per task. Text attributes that repeat on every row of a key are
resolved with ``max``. Every aggregate is a maximum, minimum or sum, so a stored
rollup merges with the rollup of added rows (``Rollup.merge``) without the report.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpace.functions import metrics as M


#: An aggregate of a rollup: (function, source column, output column). Every function here
#: applies to its own partial results as well (max of maxima, min of minima, sum of sums),
#: so a stored rollup and the rollup of added rows merge exactly.
Spec = list[tuple[str, str, str]]


def _max(source: str, name: str | None = None) -> tuple[str, str, str]:
    return ("max", source, name or source)


def _min(source: str, name: str) -> tuple[str, str, str]:
    return ("min", source, name)


def _delivered(impressions: str, clicks: str) -> Spec:
    return [("sum", "ad_server_impressions", impressions), ("sum", "ad_server_clicks", clicks)]


@dataclass(frozen=True)
class Rollup:
    """A rollup: grouping keys, mergeable aggregates, then columns derived from them."""

    keys: tuple[str, ...]
    spec: Spec
    finish: Callable[[DataFrame], DataFrame]
    rows: Callable[[DataFrame], DataFrame] = lambda raw: raw

    def build(self, raw: DataFrame, by_order: bool = False) -> DataFrame:
        """The rollup of report rows.

        ``by_order`` is for rows in which each key has one order (``placement.ByOrder.closed``):
        they group by order as well, which changes no group and needs no shuffle where they
        lie by order.
        """
        keys = self.keys
        if by_order and "order_id" not in keys:
            keys = ("order_id", *keys)
        parts = [getattr(F, f)(source).alias(name) for f, source, name in self.spec if name not in keys]
        rolled = self.rows(raw).groupBy(*keys).agg(*parts)
        return self.finish(rolled.select(*self.keys, *(name for _, _, name in self.spec)))

    def only(self, columns: Collection[str]) -> Rollup:
        """This rollup with the named aggregates and the totals, and what derives from them."""
        kept = [part for part in self.spec if part[0] == "sum" or part[2] in columns]
        return replace(self, spec=kept)

    def merge(self, stored: DataFrame, added: DataFrame) -> DataFrame:
        """The rollup of the rows behind ``stored`` and the report rows ``added``, from both.

        Equal to ``build`` over all those rows. Only the stored rollup and the added rows
        are read, and both combine by key before one shuffle.
        """
        names = [*self.keys, *(name for _, _, name in self.spec)]
        fresh = self.build(added).select(*names)
        both = stored.select(*names).unionByName(fresh)
        parts = [getattr(F, f)(name).alias(name) for f, _, name in self.spec]
        return self.finish(both.groupBy(*self.keys).agg(*parts))


def _ctr_percent(df: DataFrame) -> DataFrame:
    return df.withColumn("ctr", M.ctr_percent(F.col("clicks"), F.col("impressions")))


def _ctr_fraction(df: DataFrame) -> DataFrame:
    return df.withColumn("ctr", M.ctr_fraction(F.col("clicks"), F.col("impressions")))


def _with_delivered_ctr(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "delivered_ctr",
        M.ctr_percent_rounded(F.col("delivered_clicks"), F.col("delivered_impressions")),
    )


def _fact_rows(df: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return _with_delivered_ctr(df).withColumns(
        {
            "device_category_name": nothing,
            "creative_name": nothing,
            "rendered_creative_size": nothing,
        }
    )


ORDERS = Rollup(
    ("order_id",),
    [
        _max("order_name"),
        _max("advertiser_name"),
        _min("order_start_date", "schedule_start_date"),
        _max("order_end_date", "schedule_end_date"),
        _min("order_start_date_time", "schedule_start_datetime"),
        _max("order_end_date_time", "schedule_end_datetime"),
        _max("order_lifetime_impressions", "lifetime_impressions"),
        _max("order_lifetime_clicks", "lifetime_clicks"),
        *_delivered("impressions", "clicks"),
        _max("order_delivery_status_name"),
    ],
    _ctr_percent,
)

LINE_ITEMS = Rollup(
    ("line_item_id",),
    [
        _max("line_item_name"),
        _max("order_id"),
        _max("order_name"),
        _max("advertiser_name"),
        _min("line_item_start_date", "schedule_start_date"),
        _max("line_item_end_date", "schedule_end_date"),
        _min("line_item_start_date_time", "schedule_start_datetime"),
        _max("line_item_end_date_time", "schedule_end_datetime"),
        _max("line_item_primary_goal_units_absolute", "impression_goal_units_raw"),
        _max("line_item_primary_goal_unit_type_name", "impression_goal_unit_type_raw"),
        _max("line_item_lifetime_impressions", "lifetime_impressions"),
        _max("line_item_lifetime_clicks", "lifetime_clicks"),
        *_delivered("impressions", "clicks"),
        _max("line_item_delivery_indicator"),
        _max("line_item_priority"),
        _max("line_item_type_name"),
        _max("order_delivery_status_name"),
        _max("creative_name"),
        _max("rendered_creative_size"),
        _max("device_category_name"),
    ],
    _ctr_fraction,
)

SIZES = Rollup(
    ("line_item_id", "rendered_creative_size", "device_category_name"),
    [
        _max("line_item_name"),
        _max("order_id"),
        _max("order_name"),
        _max("advertiser_name"),
        _min("order_start_date", "order_start_date"),
        _max("order_end_date"),
        _min("order_start_date_time", "order_start_datetime"),
        _max("order_end_date_time", "order_end_datetime"),
        *_delivered("impressions", "clicks"),
    ],
    _ctr_fraction,
    lambda raw: raw.filter(F.trim("rendered_creative_size") != ""),
)

LINE_ITEMS_TABLE = Rollup(
    ("line_item_id",),
    [
        _max("line_item_name"),
        _max("order_id"),
        _max("order_name"),
        _max("advertiser_name"),
        _max("line_item_primary_goal_units_absolute", "primary_goal_units_absolute"),
        _max("line_item_primary_goal_unit_type_name", "primary_goal_unit_type_name"),
        _max("line_item_lifetime_impressions", "lifetime_impressions"),
        _max("line_item_lifetime_clicks", "lifetime_clicks"),
        *_delivered("delivered_impressions", "delivered_clicks"),
        _max("line_item_delivery_indicator"),
        _max("line_item_priority"),
        _max("line_item_type_name"),
        _max("order_delivery_status_name"),
    ],
    _with_delivered_ctr,
)

ORDERS_TABLE = Rollup(
    ("order_id",),
    [
        _max("order_name"),
        _max("advertiser_name"),
        ("sum", "line_item_primary_goal_units_absolute", "primary_goal_units_absolute"),
        _max("line_item_primary_goal_unit_type_name", "primary_goal_unit_type_name"),
        _max("order_lifetime_impressions", "lifetime_impressions"),
        _max("order_lifetime_clicks", "lifetime_clicks"),
        *_delivered("delivered_impressions", "delivered_clicks"),
        _max("order_delivery_status_name"),
    ],
    _with_delivered_ctr,
)

DELIVERY_FACTS = Rollup(
    ("order_id", "line_item_id"),
    [
        _max("order_name"),
        _max("line_item_name"),
        _max("advertiser_name"),
        _max("line_item_primary_goal_units_absolute", "primary_goal_units_absolute"),
        _max("line_item_primary_goal_unit_type_name", "primary_goal_unit_type_name"),
        *_delivered("delivered_impressions", "delivered_clicks"),
        _max("line_item_delivery_indicator"),
        _max("line_item_priority"),
        _max("line_item_type_name"),
        _max("order_delivery_status_name"),
    ],
    _fact_rows,
)


def order_rollup(raw: DataFrame) -> DataFrame:
    """One row per order: schedule, lifetime and delivered totals, CTR in percent."""
    return ORDERS.build(raw)


def line_item_rollup(
    raw: DataFrame, by_order: bool = False, columns: Collection[str] | None = None
) -> DataFrame:
    """One row per line item, with a sample creative, size and device; CTR as fraction.

    ``columns`` names the aggregates wanted, totals always included, for rows that lack the others.
    """
    return (LINE_ITEMS.only(columns) if columns is not None else LINE_ITEMS).build(raw, by_order)


def creative_size_rollup(raw: DataFrame, by_order: bool = False) -> DataFrame:
    """One row per (line item, creative size, device); blank sizes are left out.

    The size stays as reported, padding included. A missing device is a group.
    """
    return SIZES.build(raw, by_order)


def line_items_table(raw: DataFrame) -> DataFrame:
    """The stored line-item table: rounded percent CTR, 0 without impressions."""
    return LINE_ITEMS_TABLE.build(raw)


def orders_table(raw: DataFrame) -> DataFrame:
    """The stored order table. Its goal sums the line-item goal over every raw row."""
    return ORDERS_TABLE.build(raw)


def delivery_facts(raw: DataFrame) -> DataFrame:
    """One row per (order, line item); device, creative and size are typed nulls."""
    return DELIVERY_FACTS.build(raw)
