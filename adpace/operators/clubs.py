"""Club views: health summary, pacing mix, scale, drill-down and order shares.

Totals of a club are aggregates joined back, never windows over its orders, so
that a club with a large part of all rows does not end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adpace import schema as S
from adpace.functions import bands as B
from adpace.functions import metrics as M
from adpace.scratch import work_dir, written

LABEL = "club_display_name"


def _imps() -> Column:
    return F.coalesce("club_delivered_impressions", F.lit(0))


def _status() -> Column:
    return F.coalesce("order_pacing_status", F.lit("unknown"))


def filter_advertiser(df: DataFrame, advertiser: str | Column | None) -> DataFrame:
    """Rows of one advertiser; ``None`` keeps all."""
    return df if advertiser is None else df.filter(F.col("advertiser_name") == advertiser)


def filter_club(df: DataFrame, club: str | Column | None) -> DataFrame:
    """Rows of one club, by display name; ``None`` keeps all."""
    return df if club is None else df.filter(F.col(LABEL) == club)


def club_summary(portfolio: DataFrame) -> DataFrame:
    """One row per club: totals, status split, weighted pacing, top order, health.

    The top order is the largest share of the club; ties go to the lowest order
    id, and a missing name falls through to the next order that has one.
    """
    imps, status, index = _imps(), _status(), F.col("order_pacing_index")
    # Sums of decimals do not depend on the order of rows.
    weighted = index.cast("decimal(24,9)") * imps.cast("decimal(13,0)")
    rank = F.struct(F.col("order_share_of_club_delivery"), -F.col("order_id"))
    finite = M.is_finite(index)

    def imps_when(state: str) -> Column:
        return F.sum(F.when(status == state, imps).otherwise(0)).alias(f"imps_from_{state}")

    def of_top_order(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), rank))

    summary = (
        portfolio.filter(F.col("club_name").isNotNull() & F.col(LABEL).isNotNull())
        .groupBy("club_name", LABEL)
        .agg(
            F.sum(imps).alias("club_total_impressions"),
            F.count_distinct("order_id").alias("active_orders"),
            F.count_if("is_urgent_order").alias("urgent_orders"),
            imps_when("behind"),
            imps_when("on_track"),
            imps_when("ahead"),
            F.coalesce(F.sum(F.when(finite, weighted)), F.lit(0)).cast("double").alias("pacing_weighted_imps"),
            F.sum(F.when(finite, imps).otherwise(0)).alias("pacing_imps"),
            F.max("order_share_of_club_delivery").alias("top_order_share"),
            of_top_order(status).alias("top_order_pacing_status"),
            of_top_order(F.col("order_name")).alias("top_order_name"),
        )
    )
    return summary.withColumns(
        {
            "club_pacing_index": F.coalesce(
                M.safe_ratio(F.col("pacing_weighted_imps"), F.col("pacing_imps")), F.lit(0.0)
            ),
            "at_risk_share": F.coalesce(
                M.safe_ratio(F.col("imps_from_behind"), F.col("club_total_impressions")),
                F.lit(0.0),
            ),
        }
    ).withColumn(
        "club_health_band",
        B.club_health_band(
            F.col("club_pacing_index"),
            F.col("at_risk_share"),
            F.col("top_order_share"),
            F.col("top_order_pacing_status"),
        ),
    )


def club_pacing_mix(portfolio: DataFrame) -> DataFrame:
    """Impressions per (club, pacing status) with its share and the behind share."""
    per_status = (
        portfolio.filter(F.col(LABEL).isNotNull())
        .groupBy(LABEL, _status().alias("order_pacing_status"))
        .agg(F.sum(_imps()).alias("club_impressions"))
    )
    # At most one row per status and club is left, so the window stays tiny.
    club = Window.partitionBy(LABEL)
    share = F.coalesce(
        M.safe_ratio(F.col("club_impressions"), F.col("club_total")), F.lit(0.0)
    )
    behind = F.when(F.col("order_pacing_status") == "behind", F.col("impression_share"))
    return (
        per_status.withColumn("club_total", F.sum("club_impressions").over(club))
        .withColumn("impression_share", share)
        .withColumn("behind_share", F.coalesce(F.max(behind).over(club), F.lit(0.0)))
    )


def club_delivery_scale(portfolio: DataFrame) -> DataFrame:
    """Total impressions per club, largest first, league aggregate last."""
    totals = (
        portfolio.filter(F.col(LABEL).isNotNull())
        .groupBy(LABEL)
        .agg(F.sum(_imps()).alias("club_total"))
    )
    return rank_clubs(totals, "club_total")


def rank_clubs(df: DataFrame, by: str, pin_last: bool = True) -> DataFrame:
    """Clubs by a metric, largest first; the league aggregate may be pinned last."""
    order = [F.col(by).desc(), F.col(LABEL)]
    if pin_last:
        order.insert(0, B.pinned_last(F.col(LABEL)))
    return df.orderBy(*order)


def urgent_clubs(summary: DataFrame) -> DataFrame:
    """Clubs of a summary with at least one urgent order."""
    return summary.filter(F.col("urgent_orders") > 0)


def club_drilldown(
    portfolio: DataFrame,
    advertiser: str | Column | None = None,
    urgent_only: bool = False,
    club: str | Column | None = None,
) -> DataFrame:
    """Portfolio rows of an advertiser and club, optionally of urgent clubs only.

    If no club is urgent, ``urgent_only`` leaves no rows.
    """
    rows = filter_advertiser(portfolio, advertiser)
    if urgent_only:
        urgent = rows.filter(F.col("is_urgent_order") & F.col("club_name").isNotNull())
        rows = rows.join(urgent.select(LABEL), LABEL, "left_semi")
    return filter_club(rows, club)


def order_share_of_club(
    portfolio: DataFrame, advertiser: str | Column | None = None, club: str | Column | None = None
) -> DataFrame:
    """Each order's percent of its club's impressions, largest first, then a total row.

    The shares of a club with delivery add up to 100. Totals per club are stored: a hot
    club can then be split in the join, and the total row needs no second join.
    """
    rows = filter_club(filter_advertiser(portfolio, advertiser), club)
    totals = written(
        rows.groupBy(LABEL).agg(F.sum(_imps()).alias("_club_total")),
        work_dir(portfolio.sparkSession, "club-totals"),
    )
    share = F.coalesce(M.safe_ratio(_imps() * 100, F.col("_club_total")), F.lit(0.0))
    detail = rows.join(totals, LABEL, "left").select(
        LABEL,
        "order_name",
        "advertiser_name",
        _imps().alias("club_delivered_impressions"),
        share.alias("order_share_of_club"),
        F.lit(0).alias("_last"),
    )
    delivering = F.col(LABEL).isNotNull() & (F.col("_club_total") != 0)
    total = totals.agg(
        F.coalesce(F.sum("_club_total"), F.lit(0)).alias("club_delivered_impressions"),
        (F.count_if(delivering) * F.lit(100.0)).alias("order_share_of_club"),
    ).withColumns(
        {
            LABEL: F.lit(S.TOTAL_LABEL),
            "order_name": F.lit(""),
            "advertiser_name": F.lit(""),
            "_last": F.lit(1),
        }
    )
    return (
        detail.unionByName(total)
        .orderBy("_last", F.col("order_share_of_club").desc(), LABEL, "order_name")
        .drop("_last")
    )


def advertiser_club_mix(portfolio: DataFrame, advertiser: str | Column | None = None) -> DataFrame:
    """How an advertiser's impressions spread over clubs."""
    per_club = (
        filter_advertiser(portfolio, advertiser)
        .groupBy("advertiser_name", LABEL)
        .agg(F.sum(_imps()).alias("club_impressions"))
    )
    # One row per club is left for an advertiser, so the window stays small.
    total = F.sum("club_impressions").over(Window.partitionBy("advertiser_name"))
    return per_club.withColumn("advertiser_total", total).withColumn(
        "share_of_advertiser",
        F.coalesce(
            M.safe_ratio(F.col("club_impressions"), F.col("advertiser_total")), F.lit(0.0)
        ),
    )
