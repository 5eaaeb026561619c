"""Order views: enrichment, filters, KPIs, rankings and display tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adpace import schema as S
from adpace.functions import bands as B
from adpace.functions import metrics as M
from adpace.functions import text as X
from adpace.functions.metrics import AsOf, as_of_date

DateBound = dt.date | str | Column

# Days before the reporting date at which a preset range starts.
PRESET_DAYS_BACK = {"past_7": 6, "past_30": 29}
PRESETS = (*PRESET_DAYS_BACK, "year_to_date", "all")


def _status(column: str = "pacing_status") -> Column:
    return F.lower(F.coalesce(column, F.lit("unknown")))


def enrich_orders(orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Add the order label, days to the end date and the urgency flags.

    ``is_urgent`` needs the pacing status behind; it differs from the mart's
    ``is_urgent_order``, which looks at the index alone.
    """
    soon = B.ending_soon(F.col("schedule_end_date"), as_of)
    return orders.withColumns(
        {
            "order_label": X.order_label(F.col("order_name"), F.col("advertiser_name")),
            "days_to_end": F.datediff(F.col("schedule_end_date"), as_of_date(as_of)),
            "is_ending_soon": soon,
            "is_urgent": soon & (_status() == "behind"),
        }
    )


def _preset_range(preset: str, today: Column) -> Column:
    first, last = F.min("schedule_end_date"), F.max("schedule_end_date")
    if preset == "all":
        start, end = first, last
    else:
        if preset == "year_to_date":
            start = F.trunc(today, "year")
        elif preset in PRESET_DAYS_BACK:
            start = F.date_sub(today, PRESET_DAYS_BACK[preset])
        else:
            raise ValueError(f"unknown preset {preset!r}")
        start = F.when(first.isNotNull(), F.greatest(start, first))
        end = F.when(last.isNotNull(), F.least(today, last))
    return F.struct(
        F.lit(preset).alias("preset"), start.alias("range_start"), end.alias("range_end")
    )


def date_preset_range(orders: DataFrame, preset: str, as_of: AsOf) -> DataFrame:
    """One row with the range of a preset, bounded to the end dates present.

    Presets: ``past_7``, ``past_30``, ``year_to_date`` and ``all``.
    """
    found = orders.agg(_preset_range(preset, as_of_date(as_of)).alias("found"))
    return found.select("found.range_start", "found.range_end")


def date_preset_ranges(orders: DataFrame, as_of: AsOf) -> DataFrame:
    """The range of every preset, a row each, from one pass over the orders."""
    found = [_preset_range(p, as_of_date(as_of)) for p in PRESETS]
    return orders.agg(F.array(*found).alias("found")).select(F.inline("found"))


def _bound(value: DateBound) -> Column:
    return value if isinstance(value, Column) else as_of_date(value)


def overlaps(columns: list[str], low: DateBound, high: DateBound) -> Column:
    """Schedule overlaps the inclusive range; null dates do not."""
    low, high = _bound(low), _bound(high)
    end = F.col("schedule_end_date")
    if "schedule_start_date" in columns:
        return (F.col("schedule_start_date") <= high) & (end >= low)
    return end.between(low, high)


def filter_orders(
    orders: DataFrame,
    advertiser: str | Column | None = None,
    pacing_status: str | Column | None = None,
    delivery_status: str | None = "active",
    date_range: tuple[DateBound, DateBound] | DataFrame | None = None,
) -> DataFrame:
    """Orders of one advertiser, status and schedule range; ``None`` does not filter.

    ``delivery_status='active'`` keeps started and not yet started orders.
    ``date_range`` is a pair of dates or the one row of ``date_preset_range``.
    """
    if advertiser is not None:
        orders = orders.filter(F.col("advertiser_name") == advertiser)
    if pacing_status is not None:
        orders = orders.filter(F.col("pacing_status") == pacing_status)
    if delivery_status == "active":
        orders = orders.filter(
            F.col("order_delivery_status_name").isin(S.ACTIVE_DELIVERY_STATUSES)
        )
    elif delivery_status is not None:
        orders = orders.filter(F.col("order_delivery_status_name") == delivery_status)
    if isinstance(date_range, DataFrame):
        bounds = date_range.select(F.struct("range_start", "range_end")).scalar()
        date_range = (bounds["range_start"], bounds["range_end"])
    if date_range is not None and "schedule_end_date" in orders.columns:
        orders = orders.filter(overlaps(orders.columns, *date_range))
    return orders


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """The sorted distinct values of a column, as text, for a selector."""
    value = F.col(column).cast("string")
    return df.select(value.alias(column)).dropna().distinct().orderBy(column)


def order_kpis(orders: DataFrame) -> DataFrame:
    """One row of portfolio KPIs over (filtered, enriched) orders."""
    status = _status()
    core = ["behind", "on_track", "ahead"]
    total_goal = F.coalesce(F.sum("impression_goal"), F.lit(0))
    total_delivered = F.coalesce(F.sum("delivered_impressions"), F.lit(0))
    return orders.agg(
        F.count(F.lit(1)).alias("active_orders"),
        *[F.count_if(status == s).alias(f"{s}_orders") for s in core],
        F.count_if(~status.isin(core)).alias("other_orders"),
        F.count_if("is_urgent").alias("urgent_orders"),
        F.coalesce(
            M.safe_ratio(total_delivered * 100, total_goal), F.lit(0.0)
        ).alias("overall_pct_goal"),
    )


def advertiser_vs_goal(orders: DataFrame) -> DataFrame:
    """Delivered impressions against goals per advertiser, least delivered first."""
    S.require_columns(
        orders.columns,
        ["advertiser_name", "delivered_impressions", "impression_goal"],
        "advertiser_vs_goal",
    )
    delivered, goal = F.col("delivered_impressions"), F.col("impression_goal")
    return (
        orders.filter(F.col("advertiser_name").isNotNull())
        .groupBy("advertiser_name")
        .agg(
            F.sum(F.coalesce(delivered, F.lit(0))).alias("delivered_impressions"),
            F.sum(F.coalesce(goal, F.lit(0))).alias("impression_goal"),
        )
        .withColumn("completion_rate", M.safe_ratio(delivered, goal))
        .orderBy("delivered_impressions", "advertiser_name")
    )


def order_pacing_list(orders: DataFrame) -> DataFrame:
    """Orders from worst to best pacing, with completion rate and urgency band."""
    delivered = F.coalesce("delivered_impressions", F.lit(0))
    goal = F.coalesce("impression_goal", F.lit(0))
    return orders.select(
        "order_id",
        "order_label",
        delivered.alias("delivered_impressions"),
        goal.alias("impression_goal"),
        M.safe_ratio(delivered, goal).alias("completion_rate"),
        "pacing_index",
        _status().alias("pacing_status"),
        "is_urgent",
        B.urgency_band(_status(), F.col("is_urgent")).alias("pacing_urgency_band"),
    ).orderBy(F.col("pacing_index").asc_nulls_last(), "order_id")


def order_table(orders: DataFrame) -> DataFrame:
    """The order detail table as display text."""
    return orders.select(
        F.when(F.col("is_urgent"), S.URGENCY_TEXT).otherwise("").alias("urgency_flag"),
        "order_id",
        "order_name",
        "advertiser_name",
        "order_delivery_status_name",
        "schedule_start_date",
        "schedule_end_date",
        "impression_goal",
        "delivered_impressions",
        X.percent_text(F.col("delivered_impressions_pct_of_goal")).alias(
            "delivered_impressions_pct_of_goal"
        ),
        X.percent_text(F.col("schedule_pct_elapsed")).alias("schedule_pct_elapsed"),
        X.index_text(F.col("pacing_index"), "0.00").alias("pacing_index"),
    )


def orders_of_club(orders: DataFrame, portfolio: DataFrame, club: str | Column | None) -> DataFrame:
    """Orders that deliver on a club, by display name; ``None`` keeps all."""
    if club is None:
        return orders
    on_club = portfolio.filter(F.col("club_display_name") == club)
    return orders.join(on_club.select("order_id"), "order_id", "left_semi")


def spotlight(
    orders: DataFrame,
    portfolio: DataFrame | None = None,
    club: str | Column | None = None,
    best: bool = False,
    n: int | None = None,
) -> DataFrame:
    """The lowest (or highest) pacing orders, optionally of one club.

    Orders without an index are left out; equal indexes go by order id.
    """
    if club is not None:
        orders = orders_of_club(orders, portfolio, club)
    index = F.col("pacing_index")
    if n is None:
        n = S.SPOTLIGHT_TOP if best else S.SPOTLIGHT_BOTTOM
    return (
        orders.filter(index.isNotNull())
        .select(
            "order_id",
            "order_name",
            "advertiser_name",
            "pacing_index",
            "delivered_impressions",
            "impression_goal",
            "schedule_pct_elapsed",
        )
        .orderBy(index.desc() if best else index.asc(), "order_id")
        .limit(n)
    )


def format_spotlight(rows: DataFrame) -> DataFrame:
    """Spotlight rows as display text, without the order id."""
    return rows.select(
        "order_name",
        "advertiser_name",
        X.index_text(F.col("pacing_index"), "").alias("pacing_index"),
        X.thousands_text(F.col("delivered_impressions")).alias("delivered_impressions"),
        X.thousands_text(F.col("impression_goal")).alias("impression_goal"),
        X.percent_text(F.col("schedule_pct_elapsed")).alias("schedule_pct_elapsed"),
    )
