"""Marts: facts with their classifications, as lazy views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpace.functions import bands as B
from adpace.functions.metrics import AsOf


def order_pacing_summary(health: DataFrame) -> DataFrame:
    """Order health with the pacing status and the delivered_* aliases."""
    status = B.pacing_status(
        F.col("impression_goal"), F.col("schedule_pct_elapsed"), F.col("pacing_index")
    )
    return health.withColumns(
        {
            "delivered_impressions": F.col("reported_impressions"),
            "delivered_clicks": F.col("reported_clicks"),
            "pacing_status": status,
        }
    )


def club_portfolio(club: DataFrame, as_of: AsOf) -> DataFrame:
    """Club delivery with pacing status, urgency flags and contribution bucket."""
    end, index = F.col("schedule_end_date"), F.col("order_pacing_index")
    return club.withColumns(
        {
            "order_pacing_status": B.order_pacing_status(index),
            "is_ending_soon_order": B.ending_soon(end, as_of),
            "is_urgent_order": B.urgent(end, index, as_of),
            "club_contribution_bucket": B.contribution_bucket(
                F.col("order_share_of_club_delivery")
            ),
        }
    ).drop("order_reported_clicks")


def diagnostics_view(diagnostics: DataFrame) -> DataFrame:
    """Line-item diagnostics with the order's pacing status."""
    return diagnostics.withColumn(
        "order_pacing_status", B.order_pacing_status(F.col("order_pacing_index"))
    )


def creative_sizes_view(sizes: DataFrame) -> DataFrame:
    """Creative sizes, unchanged."""
    return sizes.select("*")
