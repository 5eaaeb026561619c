"""The four facts: order health, club delivery, diagnostics and creative sizes.

No join carries a broadcast hint. Spark broadcasts a side only when its size,
from file statistics or measured at run time, is under
``spark.sql.autoBroadcastJoinThreshold``; a larger side shuffles, and adaptive
execution splits the partitions of hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adpace.functions import metrics as M
from adpace.functions.metrics import AsOf
from adpace.scratch import small_tasks, work_dir, written


def order_health(orders: DataFrame, goals: DataFrame, as_of: AsOf) -> DataFrame:
    """Order rollup with its contracted goal and the pacing metrics at ``as_of``.

    Takes the output of ``order_rollup``. Names match case-insensitively; a goal
    listed twice yields two rows.
    """
    contracted = goals.select(
        F.lower("order_name").alias("_goal_order"),
        F.lower("advertiser_name").alias("_goal_advertiser"),
        F.col("impression_goal").cast("bigint"),
    )
    start, end = F.col("schedule_start_date"), F.col("schedule_end_date")
    delivered, goal = F.col("reported_impressions"), F.col("impression_goal")
    return (
        orders.withColumnsRenamed(
            {
                "impressions": "reported_impressions",
                "clicks": "reported_clicks",
                "ctr": "reported_ctr",
            }
        )
        .join(
            contracted,
            (F.lower("order_name") == F.col("_goal_order"))
            & (F.lower("advertiser_name") == F.col("_goal_advertiser")),
            "left",
        )
        .select(
            "order_id",
            "order_name",
            "advertiser_name",
            "order_delivery_status_name",
            "schedule_start_date",
            "schedule_end_date",
            "schedule_start_datetime",
            "schedule_end_datetime",
            "reported_impressions",
            "reported_clicks",
            "reported_ctr",
            "impression_goal",
            M.schedule_days(start, end).alias("schedule_days"),
            M.days_elapsed(start, end, as_of).alias("days_elapsed"),
            M.per_day(delivered, start, end).alias("actual_impressions_per_day"),
            M.per_day(goal, start, end).alias("target_impressions_per_day"),
        )
        .withColumns(
            {
                "schedule_pct_elapsed": M.schedule_pct_elapsed(
                    F.col("days_elapsed"), F.col("schedule_days")
                ),
                "delivered_impressions_pct_of_goal": M.pct_of_goal(delivered, goal),
                "pacing_index": M.pacing_index(
                    F.col("actual_impressions_per_day"),
                    F.col("target_impressions_per_day"),
                    F.col("days_elapsed"),
                    F.col("schedule_days"),
                    goal,
                ),
            }
        )
    )


def first_club_per_domain(clubs: DataFrame) -> DataFrame:
    """One club per domain, case-insensitively: the first by name, nulls last.

    ``min`` over an ordering struct combines inside each task, so a domain that
    is listed very often needs no window over its rows.
    """
    name, display = F.col("club_name"), F.col("club_display_name")
    ranked = F.struct(name.isNull(), name, display.isNull(), display)
    first = F.min(ranked)
    return clubs.groupBy(F.lower("domain_name").alias("_domain")).agg(
        first.getField("club_name").alias("club_name"),
        first.getField("club_display_name").alias("club_display_name"),
    )


def _mapped_or_fail(column: str) -> Column:
    problem = F.concat(
        F.lit("domain without a club: "), F.coalesce("domain_name", F.lit("null"))
    )
    return F.coalesce(column, F.raise_error(problem).cast("string")).alias(column)


def domains_with_clubs(
    domains: DataFrame, clubs: DataFrame, on_unmapped: str = "error"
) -> DataFrame:
    """Domain rows with their club; an unmapped domain raises unless kept.

    The guard sits on the club columns themselves. They are group keys further
    on, so the optimizer cannot prune it. The club map is stored first: its file
    size decides on a broadcast, and beyond it a hot domain can be split, which an
    aggregate between shuffle and join would prevent.
    """
    if on_unmapped not in ("error", "keep"):
        raise ValueError("on_unmapped must be 'error' or 'keep'")
    first = written(first_club_per_domain(clubs), work_dir(clubs.sparkSession, "club-map"))
    mapped = domains.join(first, F.lower("domain_name") == F.col("_domain"), "left").drop("_domain")
    if on_unmapped == "keep":
        return mapped
    return mapped.withColumns(
        {c: _mapped_or_fail(c) for c in ("club_name", "club_display_name")}
    )


def club_order_agg(mapped: DataFrame) -> DataFrame:
    """Impressions and distinct line items per (club, order)."""
    return mapped.groupBy(
        "club_name", "club_display_name", "order_id", "order_name", "advertiser_name"
    ).agg(
        F.sum("ad_server_impressions").alias("club_delivered_impressions"),
        F.count_distinct("line_item_id").alias("distinct_line_items_on_club"),
    )


def club_totals(per_order: DataFrame) -> DataFrame:
    """Impressions per club, from the rows per (club, order).

    A window over a club would bring all its orders into one task; this total
    combines in the scan tasks and its join back is one small row per club.
    """
    return per_order.groupBy("club_name", "club_display_name").agg(
        F.sum("club_delivered_impressions").alias("total_club_impressions")
    )


def club_delivery(
    domains: DataFrame, clubs: DataFrame, health: DataFrame, on_unmapped: str = "error"
) -> DataFrame:
    """One row per (club, order): delivery, shares and the order's pacing.

    Rows per (club, order) and the totals per club are stored, so the domain rows
    are read once and a hot club can be split in the join of both. Counting line items sorts
    and aggregates the domain rows several times in one stage, which runs in small tasks.
    """
    root = work_dir(domains.sparkSession, "club-delivery")
    mapped = domains_with_clubs(domains, clubs, on_unmapped)
    with small_tasks(domains.sparkSession):
        per_order = written(club_order_agg(mapped), f"{root}/per-order")
    totals = written(club_totals(per_order), f"{root}/totals").alias("t")
    order = health.select(
        F.col("order_id").alias("_order_id"),
        "order_delivery_status_name",
        "schedule_start_date",
        "schedule_end_date",
        "schedule_start_datetime",
        "schedule_end_datetime",
        "schedule_days",
        "days_elapsed",
        "schedule_pct_elapsed",
        F.col("pacing_index").alias("order_pacing_index"),
        F.col("reported_impressions").alias("order_reported_impressions"),
        F.col("reported_clicks").alias("order_reported_clicks"),
        "impression_goal",
    )
    on_club = (F.col("c.club_name") == F.col("t.club_name")) & (
        F.col("c.club_display_name") == F.col("t.club_display_name")
    )
    delivered = F.col("club_delivered_impressions")
    return (
        per_order.alias("c")
        .join(totals, on_club, "left")
        .join(order, F.col("c.order_id") == F.col("_order_id"), "left")
        .select(
            "c.club_name",
            "c.club_display_name",
            "c.order_id",
            "c.order_name",
            "c.advertiser_name",
            "order_delivery_status_name",
            "schedule_start_date",
            "schedule_end_date",
            "schedule_start_datetime",
            "schedule_end_datetime",
            "schedule_days",
            "days_elapsed",
            "schedule_pct_elapsed",
            "order_pacing_index",
            "club_delivered_impressions",
            "order_reported_impressions",
            "order_reported_clicks",
            "impression_goal",
            M.safe_ratio(delivered, F.col("order_reported_impressions")).alias(
                "club_share_of_order_delivery"
            ),
            M.safe_ratio(delivered, F.col("total_club_impressions")).alias(
                "order_share_of_club_delivery"
            ),
            "distinct_line_items_on_club",
        )
    )


def _same(left: str, right: str) -> Column:
    """Equality that only checks the rows a join brings together, without being a key of it."""
    return F.coalesce(F.col(left) == F.col(right), F.lit(False))


def line_item_diagnostics(
    domains: DataFrame,
    line_items: DataFrame,
    clubs: DataFrame,
    health: DataFrame,
    by_order: bool = False,
) -> DataFrame:
    """One row per (order, line item, domain) with attributes, club and order pacing.

    Totals are lifetime figures, window figures come from the report. A domain
    listed twice in the club map yields two rows. The wide line-item attributes
    join last, so that the shuffles before it move narrow rows. ``by_order`` is for line
    items rolled up so, of orders with few of them: all joins then go by the order alone,
    where the rows lie already, and compare advertiser and line item within the order.
    """
    club = clubs.select(
        F.lower("domain_name").alias("_domain"), "club_name", "club_display_name"
    )
    order = health.select(
        F.col("order_id").alias("_health_order"),
        F.col("advertiser_name").alias("_health_advertiser"),
        F.col("reported_impressions").alias("order_reported_impressions"),
        F.col("reported_clicks").alias("order_reported_clicks"),
        "impression_goal",
        F.col("schedule_start_date").alias("order_schedule_start_date"),
        F.col("schedule_end_date").alias("order_schedule_end_date"),
        "schedule_days",
        "days_elapsed",
        "schedule_pct_elapsed",
        "actual_impressions_per_day",
        "target_impressions_per_day",
        F.col("pacing_index").alias("order_pacing_index"),
    )
    item = line_items.select(
        F.col("order_id").alias("_item_order"),
        F.col("line_item_id").alias("_item"),
        "schedule_start_date",
        "schedule_end_date",
        "schedule_start_datetime",
        "schedule_end_datetime",
        "impression_goal_units_raw",
        "impression_goal_unit_type_raw",
        F.col("lifetime_impressions").alias("line_item_total_impressions"),
        F.col("lifetime_clicks").alias("line_item_total_clicks"),
        F.col("impressions").alias("line_item_window_impressions"),
        F.col("clicks").alias("line_item_window_clicks"),
        F.col("ctr").alias("line_item_ctr"),
        "line_item_delivery_indicator",
        "line_item_priority",
        "line_item_type_name",
        "order_delivery_status_name",
        "creative_name",
        "rendered_creative_size",
        "device_category_name",
    )
    lifetime = F.col("line_item_total_impressions")
    advertiser = F.col("advertiser_name") == F.col("_health_advertiser")
    line_item = F.col("line_item_id") == F.col("_item")
    if by_order:
        advertiser, line_item = _same("advertiser_name", "_health_advertiser"), _same("line_item_id", "_item")
    return (
        domains.withColumnRenamed("ad_server_impressions", "domain_impressions")
        .join(club, F.lower("domain_name") == F.col("_domain"), "left")
        .join(
            order,
            (F.col("order_id") == F.col("_health_order")) & advertiser,
            "left",
        )
        .join(
            item,
            (F.col("order_id") == F.col("_item_order")) & line_item,
            "left",
        )
        .drop("_domain", "_health_order", "_health_advertiser", "_item_order", "_item")
        .withColumns(
            {
                "domain_share_of_line_item": M.safe_ratio(
                    F.col("domain_impressions"), lifetime
                ),
                "line_item_share_of_order": M.safe_ratio(
                    lifetime, F.col("order_reported_impressions")
                ),
            }
        )
    )


def order_size_stats(sizes: DataFrame) -> DataFrame:
    """Impressions, line items and their average per (order, creative size)."""
    return (
        sizes.groupBy("order_id", "order_name", "advertiser_name", "rendered_creative_size")
        .agg(
            F.sum("impressions").alias("order_size_impressions"),
            F.count_distinct("line_item_id").alias("order_size_line_items"),
        )
        .withColumn(
            "order_size_avg_impressions_per_line_item",
            M.safe_ratio(F.col("order_size_impressions"), F.col("order_size_line_items")),
        )
    )


#: The line-item aggregates that diagnostics take, besides the totals.
DIAGNOSTIC_ITEM_COLUMNS = [
    "order_id",
    "schedule_start_date",
    "schedule_end_date",
    "schedule_start_datetime",
    "schedule_end_datetime",
    "impression_goal_units_raw",
    "impression_goal_unit_type_raw",
    "lifetime_impressions",
    "lifetime_clicks",
    "line_item_delivery_indicator",
    "line_item_priority",
    "line_item_type_name",
    "order_delivery_status_name",
    "creative_name",
    "rendered_creative_size",
    "device_category_name",
]
#: The line-item aggregates that creative sizes take, besides the totals.
SIZE_ITEM_COLUMNS = ["order_id", "line_item_priority", "line_item_type_name", "order_delivery_status_name"]


def creative_sizes(
    sizes: DataFrame, line_items: DataFrame, health: DataFrame, by_order: bool = False
) -> DataFrame:
    """One row per (line item, size, device) with line-item and order context.

    ``sizes`` is the output of ``creative_size_rollup``. The line-item total is
    the report window's, not the lifetime figure. Order health is attached to
    the smaller order-size statistics, which every size row with an order
    matches, so that the size rows shuffle once for both. ``by_order`` is for rollups
    made so: line items then join by order as well, where the rows lie already.
    """
    item = line_items.select(
        F.col("line_item_id").alias("_item"),
        F.col("order_id").alias("_item_order"),
        F.col("impressions").alias("line_item_total_impressions"),
        F.col("clicks").alias("line_item_total_clicks"),
        F.col("ctr").alias("line_item_ctr"),
        "line_item_priority",
        "line_item_type_name",
        "order_delivery_status_name",
    )
    order = health.select(
        F.col("order_id").alias("_health_order"),
        F.col("reported_impressions").alias("order_reported_impressions"),
        "impression_goal",
    )
    context = (
        order_size_stats(sizes)
        .select(
            F.col("order_id").alias("_stats_order"),
            F.col("rendered_creative_size").alias("_stats_size"),
            "order_size_impressions",
            "order_size_line_items",
            "order_size_avg_impressions_per_line_item",
        )
        .join(order, F.col("_stats_order") == F.col("_health_order"), "left")
    )
    size_total = F.col("order_size_impressions")
    on_item = F.col("line_item_id") == F.col("_item")
    if by_order:
        on_item = (F.col("order_id") == F.col("_item_order")) & on_item
    return (
        sizes.withColumnsRenamed(
            {
                "impressions": "creative_size_impressions",
                "clicks": "creative_size_clicks",
                "ctr": "creative_size_ctr",
            }
        )
        .join(item, on_item, "left")
        .join(
            context,
            (F.col("order_id") == F.col("_stats_order"))
            & (F.col("rendered_creative_size") == F.col("_stats_size")),
            "left",
        )
        .drop("_item", "_item_order", "_health_order", "_stats_order", "_stats_size")
        .withColumns(
            {
                "creative_size_share_of_line_item": M.safe_ratio(
                    F.col("creative_size_impressions"), F.col("line_item_total_impressions")
                ),
                "size_share_of_order_delivery": M.safe_ratio(
                    size_total, F.col("order_reported_impressions")
                ),
                "size_pct_of_order_goal": M.safe_ratio(size_total, F.col("impression_goal")),
            }
        )
    )
