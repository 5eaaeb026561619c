"""Classifications: status ladders, buckets and flags as chained ``when``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adpace import schema as S
from adpace.functions.metrics import AsOf, as_of_date, is_finite


def order_pacing_status(index: Column) -> Column:
    """unknown / behind / on_track / ahead from the pacing index alone."""
    return (
        F.when(index.isNull(), "unknown")
        .when(index < S.BEHIND_BELOW, "behind")
        .when(index <= S.AHEAD_ABOVE, "on_track")
        .otherwise("ahead")
    )


def pacing_status(goal: Column, pct_elapsed: Column, index: Column) -> Column:
    """The order ladder: no_goal and too_early go before the index bands."""
    no_goal = goal.isNull() | (goal <= 0)
    too_early = pct_elapsed.isNull() | (pct_elapsed <= 0)
    return (
        F.when(no_goal, "no_goal")
        .when(too_early, "too_early")
        .otherwise(order_pacing_status(index))
    )


def ending_soon(end: Column, as_of: AsOf) -> Column:
    """True when the end date lies in the seven days from ``as_of``, both inclusive."""
    today = as_of_date(as_of)
    within = end.between(today, F.date_add(today, S.ENDING_SOON_DAYS))
    return F.coalesce(within, F.lit(False))


def urgent(end: Column, index: Column, as_of: AsOf) -> Column:
    """Ending soon with a pacing index below the behind threshold."""
    return ending_soon(end, as_of) & F.coalesce(index < S.BEHIND_BELOW, F.lit(False))


def contribution_bucket(share: Column) -> Column:
    """How much of a club's delivery one order stands for."""
    return (
        F.when(share.isNull(), "unknown")
        .when(share >= S.MAJOR_SHARE, "major_contributor")
        .when(share >= S.MEDIUM_SHARE, "medium_contributor")
        .otherwise("minor_contributor")
    )


def urgency_band(status: Column, is_urgent: Column) -> Column:
    """The pacing status, with urgent behind orders set apart."""
    return F.when(
        (status == "behind") & F.coalesce(is_urgent, F.lit(False)), "behind_urgent"
    ).otherwise(status)


def club_health_band(
    index: Column, at_risk_share: Column, top_share: Column, top_status: Column
) -> Column:
    """healthy / at_risk / watch / unknown from pacing, risk and concentration."""
    has_index, has_risk, has_top = map(is_finite, (index, at_risk_share, top_share))
    healthy = (
        has_index & (index >= S.HEALTHY_PACING)
        & has_risk & (at_risk_share <= S.HEALTHY_RISK)
    )
    concentrated = (
        has_top & (top_share > S.CONCENTRATED_SHARE)
        & (F.coalesce(top_status, F.lit("unknown")) == "behind")
    )
    at_risk = (
        (has_index & (index < S.AT_RISK_PACING))
        | (has_risk & (at_risk_share > S.AT_RISK_SHARE))
        | concentrated
    )
    return (
        F.when(~has_index & ~has_risk, "unknown")
        .when(healthy, "healthy")
        .when(at_risk, "at_risk")
        .otherwise("watch")
    )


def pinned_last(label: Column) -> Column:
    """1 for the league-wide aggregate, which listings keep at the end."""
    lowered = F.lower(label)
    pinned = lowered.contains(S.LEAGUE_LABEL_PART) | (lowered == S.LEAGUE_LABEL)
    return F.when(pinned, 1).otherwise(0)
