"""The SQL counterpart of every query, composed from common table expressions."""

from __future__ import annotations

import re

from adpace import schema as S
from adpace.operators.quality import NOT_NULL, RELATIONSHIPS, UNIQUE
from adpace.plans.checks import declared_checks
from adpace.sources.retail import AS_OF
from registry.queries import CLUBS

_AS_OF = f"DATE '{AS_OF}'"


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def _status_ladder(index: str) -> str:
    return (
        f"CASE WHEN {index} IS NULL THEN 'unknown' WHEN {index} < 0.9 THEN 'behind' "
        f"WHEN {index} <= 1.1 THEN 'on_track' ELSE 'ahead' END"
    )


def _label(prefix: str = "") -> str:
    return (
        f"coalesce({prefix}order_name, 'None') || ' — ' || "
        f"coalesce({prefix}advertiser_name, 'None')"
    )


def _percent_text(value: str) -> str:
    return f"format('{{:.1f}}%', coalesce({value}, 0.0::DOUBLE) * 100.0::DOUBLE)"


def _thousands(value: str) -> str:
    return f"format('{{:,}}', CAST(coalesce({value}, 0) AS BIGINT))"


def _rounded_ctr(clicks: str, imps: str) -> str:
    """Percent with four decimals, half-up, by exact integer arithmetic."""
    c, i = f"CAST({clicks} AS HUGEINT)", f"CAST({imps} AS HUGEINT)"
    return (
        f"CASE WHEN {imps} > 0 THEN CAST((2 * {c} * 1000000 + {i}) // (2 * {i}) AS DOUBLE) "
        f"/ 10000.0::DOUBLE ELSE 0.0::DOUBLE END"
    )


_TEXT_COLUMNS = ", ".join(
    f"coalesce(regexp_replace(CAST({n} AS VARCHAR), '\\.?0+$', ''), '')"
    if t.startswith("decimal")
    else f"coalesce(CAST({n} AS VARCHAR), '')"
    for n, t in S.DELIVERY_FIELDS
)
_REPORT_COLUMNS = ", ".join(
    f"CAST({n} AS DOUBLE) AS {n}" if t.startswith("decimal") else n
    for n, t in S.DELIVERY_FIELDS
)

_CTES: dict[str, str] = {}

_CTES["raw"] = """
SELECT o_orderkey AS order_id,
       'Order ' || o_orderkey AS order_name,
       CAST(o_orderdate AS DATE) AS order_start_date,
       CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS order_start_date_time,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS order_end_date,
       CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS TIMESTAMP) AS order_end_date_time,
       l_orderkey * 10 + l_linenumber AS line_item_id,
       'Line ' || (l_orderkey * 10 + l_linenumber) AS line_item_name,
       CAST(o_orderdate AS DATE) AS line_item_start_date,
       CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS line_item_start_date_time,
       greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS line_item_end_date,
       CAST(greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS TIMESTAMP) AS line_item_end_date_time,
       CAST(floor(l_extendedprice / 10) AS BIGINT) AS line_item_primary_goal_units_absolute,
       'IMPRESSIONS' AS line_item_primary_goal_unit_type_name,
       CAST(floor(l_extendedprice * 2) AS BIGINT) AS line_item_lifetime_impressions,
       CAST(floor(l_quantity) AS BIGINT) * 2 AS line_item_lifetime_clicks,
       CAST(floor(o_totalprice / 1000) AS BIGINT) AS order_lifetime_clicks,
       CAST(floor(o_totalprice) AS BIGINT) AS order_lifetime_impressions,
       CAST(l_discount AS DECIMAL(10,4)) AS line_item_delivery_indicator,
       p_name AS creative_name,
       CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 7 = 0 THEN '  ' ELSE p_type END AS rendered_creative_size,
       l_returnflag AS device_category_name,
       CAST(l_linenumber AS INTEGER) AS line_item_priority,
       CASE WHEN l_linestatus = 'O' THEN 'STANDARD' ELSE 'SPONSORSHIP' END AS line_item_type_name,
       CASE o_orderstatus WHEN 'P' THEN 'Started' WHEN 'O' THEN 'Not started' ELSE 'Completed' END AS order_delivery_status_name,
       c_name AS advertiser_name,
       CAST(floor(l_extendedprice) AS BIGINT) AS ad_server_impressions,
       CAST(floor(l_quantity) AS BIGINT) AS ad_server_clicks,
       CAST(l_tax AS DECIMAL(10,4)) AS ad_server_ctr
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey
"""

_CTES["hashed"] = f"SELECT *, md5(concat_ws('|', {_TEXT_COLUMNS})) AS row_hash FROM raw"

_CTES["hash_keys"] = (
    "SELECT row_hash, order_id, line_item_id, ad_server_impressions FROM hashed"
)

_CTES["goals"] = """
SELECT 'ORDER ' || o_orderkey AS order_name, c_name AS advertiser_name,
       CASE WHEN o_totalprice < 5000 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS impression_goal
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority <> '5-LOW'
"""

_CTES["edited_goals"] = """
SELECT order_name, advertiser_name,
       CASE WHEN impression_goal >= 250000 THEN impression_goal * 2 ELSE impression_goal END AS impression_goal
FROM goals
"""

_CTES["domain_rows"] = """
SELECT order_id, 'Order ' || order_id AS order_name, line_item_id,
       'Line ' || line_item_id AS line_item_name, c_name AS advertiser_name,
       domain_name, ad_server_impressions
FROM (
  SELECT l_orderkey AS order_id, l_orderkey * 10 + l_linenumber AS line_item_id,
         CASE WHEN l_linenumber % 2 = 1 THEN upper('nation_' || s_nationkey || '.com')
              ELSE 'nation_' || s_nationkey || '.com' END AS domain_name,
         CAST(sum(CAST(floor(l_extendedprice * 0.5) AS BIGINT)
                  * CASE WHEN l_orderkey % 1000 = 7 THEN 20000 ELSE 1 END) AS BIGINT) AS ad_server_impressions
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3
) d
JOIN orders ON d.order_id = o_orderkey
JOIN customer ON o_custkey = c_custkey
"""

_CTES["club_map"] = """
SELECT 'nation_' || n_nationkey || '.com' AS domain_name,
       'club_' || (n_nationkey % 12) AS club_name,
       CASE WHEN n_nationkey % 12 = 0 THEN 'Sports league' ELSE 'Club ' || (n_nationkey % 12) END AS club_display_name
FROM nation
"""

_CTES["order_roll"] = f"""
SELECT *, {_ratio('clicks * 100', 'impressions')} AS ctr FROM (
  SELECT order_id, max(order_name) AS order_name, max(advertiser_name) AS advertiser_name,
         min(order_start_date) AS schedule_start_date, max(order_end_date) AS schedule_end_date,
         min(order_start_date_time) AS schedule_start_datetime, max(order_end_date_time) AS schedule_end_datetime,
         max(order_lifetime_impressions) AS lifetime_impressions, max(order_lifetime_clicks) AS lifetime_clicks,
         CAST(sum(ad_server_impressions) AS BIGINT) AS impressions, CAST(sum(ad_server_clicks) AS BIGINT) AS clicks,
         max(order_delivery_status_name) AS order_delivery_status_name
  FROM raw GROUP BY order_id) r
"""

_CTES["item_roll"] = f"""
SELECT *, {_ratio('clicks', 'impressions')} AS ctr FROM (
  SELECT line_item_id, max(line_item_name) AS line_item_name, max(order_id) AS order_id,
         max(order_name) AS order_name, max(advertiser_name) AS advertiser_name,
         min(line_item_start_date) AS schedule_start_date, max(line_item_end_date) AS schedule_end_date,
         min(line_item_start_date_time) AS schedule_start_datetime, max(line_item_end_date_time) AS schedule_end_datetime,
         max(line_item_primary_goal_units_absolute) AS impression_goal_units_raw,
         max(line_item_primary_goal_unit_type_name) AS impression_goal_unit_type_raw,
         max(line_item_lifetime_impressions) AS lifetime_impressions, max(line_item_lifetime_clicks) AS lifetime_clicks,
         CAST(sum(ad_server_impressions) AS BIGINT) AS impressions, CAST(sum(ad_server_clicks) AS BIGINT) AS clicks,
         CAST(max(line_item_delivery_indicator) AS DOUBLE) AS line_item_delivery_indicator,
         max(line_item_priority) AS line_item_priority, max(line_item_type_name) AS line_item_type_name,
         max(order_delivery_status_name) AS order_delivery_status_name, max(creative_name) AS creative_name,
         max(rendered_creative_size) AS rendered_creative_size, max(device_category_name) AS device_category_name
  FROM raw GROUP BY line_item_id) r
"""

_CTES["size_roll"] = f"""
SELECT *, {_ratio('clicks', 'impressions')} AS ctr FROM (
  SELECT line_item_id, rendered_creative_size, device_category_name,
         max(line_item_name) AS line_item_name, max(order_id) AS order_id,
         max(order_name) AS order_name, max(advertiser_name) AS advertiser_name,
         min(order_start_date) AS order_start_date, max(order_end_date) AS order_end_date,
         min(order_start_date_time) AS order_start_datetime, max(order_end_date_time) AS order_end_datetime,
         CAST(sum(ad_server_impressions) AS BIGINT) AS impressions, CAST(sum(ad_server_clicks) AS BIGINT) AS clicks
  FROM raw WHERE rendered_creative_size IS NOT NULL AND trim(rendered_creative_size) <> ''
  GROUP BY line_item_id, rendered_creative_size, device_category_name) r
"""

_DELIVERED = f"""
       CAST(sum(ad_server_impressions) AS BIGINT) AS delivered_impressions,
       CAST(sum(ad_server_clicks) AS BIGINT) AS delivered_clicks,
       {_rounded_ctr('sum(ad_server_clicks)', 'sum(ad_server_impressions)')} AS delivered_ctr,
"""

_CTES["item_table"] = f"""
SELECT line_item_id, max(line_item_name) AS line_item_name, max(order_id) AS order_id,
       max(order_name) AS order_name, max(advertiser_name) AS advertiser_name,
       max(line_item_primary_goal_units_absolute) AS primary_goal_units_absolute,
       max(line_item_primary_goal_unit_type_name) AS primary_goal_unit_type_name,
       max(line_item_lifetime_impressions) AS lifetime_impressions, max(line_item_lifetime_clicks) AS lifetime_clicks,
       {_DELIVERED}
       CAST(max(line_item_delivery_indicator) AS DOUBLE) AS line_item_delivery_indicator,
       max(line_item_priority) AS line_item_priority, max(line_item_type_name) AS line_item_type_name,
       max(order_delivery_status_name) AS order_delivery_status_name
FROM raw GROUP BY line_item_id
"""

_CTES["order_tab"] = f"""
SELECT order_id, max(order_name) AS order_name, max(advertiser_name) AS advertiser_name,
       CAST(sum(line_item_primary_goal_units_absolute) AS BIGINT) AS primary_goal_units_absolute,
       max(line_item_primary_goal_unit_type_name) AS primary_goal_unit_type_name,
       max(order_lifetime_impressions) AS lifetime_impressions, max(order_lifetime_clicks) AS lifetime_clicks,
       {_DELIVERED}
       max(order_delivery_status_name) AS order_delivery_status_name
FROM raw GROUP BY order_id
"""

_CTES["fact_table"] = f"""
SELECT order_id, line_item_id, max(order_name) AS order_name, max(line_item_name) AS line_item_name,
       max(advertiser_name) AS advertiser_name, CAST(NULL AS VARCHAR) AS device_category_name,
       CAST(NULL AS VARCHAR) AS creative_name, CAST(NULL AS VARCHAR) AS rendered_creative_size,
       max(line_item_primary_goal_units_absolute) AS primary_goal_units_absolute,
       max(line_item_primary_goal_unit_type_name) AS primary_goal_unit_type_name,
       {_DELIVERED}
       CAST(max(line_item_delivery_indicator) AS DOUBLE) AS line_item_delivery_indicator,
       max(line_item_priority) AS line_item_priority, max(line_item_type_name) AS line_item_type_name,
       max(order_delivery_status_name) AS order_delivery_status_name
FROM raw GROUP BY order_id, line_item_id
"""


def _health(goals: str) -> str:
    window = "(schedule_end_date - schedule_start_date + 1)"
    return f"""
SELECT *,
       {_ratio('days_elapsed', 'schedule_days')} AS schedule_pct_elapsed,
       {_ratio('coalesce(reported_impressions, 0)', 'impression_goal')} AS delivered_impressions_pct_of_goal,
       CASE WHEN impression_goal > 0 AND target_impressions_per_day > 0 AND days_elapsed > 0 AND schedule_days > 0
            THEN CAST(actual_impressions_per_day * schedule_days AS DOUBLE)
                 / CAST(target_impressions_per_day * days_elapsed AS DOUBLE)
            ELSE 0.0::DOUBLE END AS pacing_index
FROM (
  SELECT r.order_id, r.order_name, r.advertiser_name, r.order_delivery_status_name,
         schedule_start_date, schedule_end_date, schedule_start_datetime, schedule_end_datetime,
         impressions AS reported_impressions, clicks AS reported_clicks, ctr AS reported_ctr,
         g.impression_goal,
         CASE WHEN schedule_end_date > schedule_start_date THEN CAST({window} AS INTEGER) END AS schedule_days,
         CASE WHEN schedule_start_date IS NOT NULL AND schedule_end_date IS NOT NULL
              THEN CAST(greatest(0, least({_AS_OF}, schedule_end_date) - schedule_start_date + 1) AS INTEGER)
              END AS days_elapsed,
         CASE WHEN {window} > 0 THEN coalesce(impressions, 0) // {window} END AS actual_impressions_per_day,
         CASE WHEN {window} > 0 THEN coalesce(g.impression_goal, 0) // {window} END AS target_impressions_per_day
  FROM order_roll r
  LEFT JOIN {goals} g ON lower(r.order_name) = lower(g.order_name)
                     AND lower(r.advertiser_name) = lower(g.advertiser_name)) h
"""


def _pacing(health: str) -> str:
    return f"""
SELECT *, reported_impressions AS delivered_impressions, reported_clicks AS delivered_clicks,
       CASE WHEN impression_goal IS NULL OR impression_goal <= 0 THEN 'no_goal'
            WHEN schedule_pct_elapsed IS NULL OR schedule_pct_elapsed <= 0 THEN 'too_early'
            ELSE {_status_ladder('pacing_index')} END AS pacing_status
FROM {health}
"""


_CTES["health"] = _health("goals")
_CTES["edited_health"] = _health("edited_goals")
_CTES["pacing"] = _pacing("health")
_CTES["edited_pacing"] = _pacing("edited_health")

_CTES["enriched"] = f"""
SELECT *, {_label()} AS order_label,
       CAST(schedule_end_date - {_AS_OF} AS INTEGER) AS days_to_end,
       coalesce(schedule_end_date - {_AS_OF} BETWEEN 0 AND 7, FALSE) AS is_ending_soon,
       coalesce(schedule_end_date - {_AS_OF} BETWEEN 0 AND 7, FALSE) AND lower(pacing_status) = 'behind' AS is_urgent
FROM pacing
"""

_CTES["mapped"] = """
SELECT d.*, m.club_name, m.club_display_name
FROM domain_rows d LEFT JOIN club_map m ON lower(d.domain_name) = lower(m.domain_name)
"""

_CTES["mapped_some"] = """
SELECT d.*, m.club_name, m.club_display_name
FROM domain_rows d LEFT JOIN (SELECT * FROM club_map WHERE club_name <> 'club_3') m
  ON lower(d.domain_name) = lower(m.domain_name)
"""


def _club_orders(mapped: str) -> str:
    return f"""
SELECT club_name, club_display_name, order_id, order_name, advertiser_name,
       CAST(sum(ad_server_impressions) AS BIGINT) AS club_delivered_impressions,
       count(DISTINCT line_item_id) AS distinct_line_items_on_club
FROM {mapped} GROUP BY 1, 2, 3, 4, 5
"""


def _club_totals(mapped: str) -> str:
    return f"""
SELECT club_name, club_display_name, CAST(sum(ad_server_impressions) AS BIGINT) AS total_club_impressions
FROM {mapped} GROUP BY 1, 2
"""


def _club_fact(orders: str, totals: str) -> str:
    return f"""
SELECT c.*, h.order_delivery_status_name, h.schedule_start_date, h.schedule_end_date,
       h.schedule_start_datetime, h.schedule_end_datetime, h.schedule_days, h.days_elapsed,
       h.schedule_pct_elapsed, h.pacing_index AS order_pacing_index,
       h.reported_impressions AS order_reported_impressions, h.reported_clicks AS order_reported_clicks,
       h.impression_goal,
       {_ratio('c.club_delivered_impressions', 'h.reported_impressions')} AS club_share_of_order_delivery,
       {_ratio('c.club_delivered_impressions', 't.total_club_impressions')} AS order_share_of_club_delivery
FROM {orders} c
LEFT JOIN {totals} t ON c.club_name = t.club_name AND c.club_display_name = t.club_display_name
LEFT JOIN health h ON c.order_id = h.order_id
"""


_CTES["club_orders"] = _club_orders("mapped")
_CTES["club_tot"] = _club_totals("mapped")
_CTES["club_fact"] = _club_fact("club_orders", "club_tot")
_CTES["some_orders"] = _club_orders("mapped_some")
_CTES["some_tot"] = _club_totals("mapped_some")
_CTES["some_fact"] = _club_fact("some_orders", "some_tot")

_SOON = f"coalesce(schedule_end_date BETWEEN {_AS_OF} AND {_AS_OF} + 7, FALSE)"
_CTES["portfolio"] = f"""
SELECT * EXCLUDE (order_reported_clicks),
       {_status_ladder('order_pacing_index')} AS order_pacing_status,
       {_SOON} AS is_ending_soon_order,
       {_SOON} AND coalesce(order_pacing_index < 0.9, FALSE) AS is_urgent_order,
       CASE WHEN order_share_of_club_delivery IS NULL THEN 'unknown'
            WHEN order_share_of_club_delivery >= 0.25 THEN 'major_contributor'
            WHEN order_share_of_club_delivery >= 0.10 THEN 'medium_contributor'
            ELSE 'minor_contributor' END AS club_contribution_bucket
FROM club_fact
"""

_CTES["diagnostics"] = f"""
SELECT d.order_id, d.order_name, d.advertiser_name, d.line_item_id, d.line_item_name,
       d.domain_name, d.ad_server_impressions AS domain_impressions, m.club_name, m.club_display_name,
       l.schedule_start_date, l.schedule_end_date, l.schedule_start_datetime, l.schedule_end_datetime,
       l.impression_goal_units_raw, l.impression_goal_unit_type_raw,
       l.lifetime_impressions AS line_item_total_impressions, l.lifetime_clicks AS line_item_total_clicks,
       l.impressions AS line_item_window_impressions, l.clicks AS line_item_window_clicks,
       l.ctr AS line_item_ctr, l.line_item_delivery_indicator, l.line_item_priority, l.line_item_type_name,
       l.order_delivery_status_name, l.creative_name, l.rendered_creative_size, l.device_category_name,
       h.reported_impressions AS order_reported_impressions, h.reported_clicks AS order_reported_clicks,
       h.impression_goal, h.schedule_start_date AS order_schedule_start_date,
       h.schedule_end_date AS order_schedule_end_date, h.schedule_days, h.days_elapsed, h.schedule_pct_elapsed,
       h.actual_impressions_per_day, h.target_impressions_per_day, h.pacing_index AS order_pacing_index,
       {_ratio('d.ad_server_impressions', 'l.lifetime_impressions')} AS domain_share_of_line_item,
       {_ratio('l.lifetime_impressions', 'h.reported_impressions')} AS line_item_share_of_order
FROM domain_rows d
LEFT JOIN item_roll l ON d.order_id = l.order_id AND d.line_item_id = l.line_item_id
LEFT JOIN club_map m ON lower(d.domain_name) = lower(m.domain_name)
LEFT JOIN health h ON d.order_id = h.order_id AND d.advertiser_name = h.advertiser_name
"""

_CTES["diag_view"] = (
    f"SELECT *, {_status_ladder('order_pacing_index')} AS order_pacing_status FROM diagnostics"
)

_CTES["size_stats"] = f"""
SELECT *, {_ratio('order_size_impressions', 'order_size_line_items')} AS order_size_avg_impressions_per_line_item
FROM (
  SELECT order_id, order_name, advertiser_name, rendered_creative_size,
         CAST(sum(impressions) AS BIGINT) AS order_size_impressions,
         count(DISTINCT line_item_id) AS order_size_line_items
  FROM size_roll GROUP BY 1, 2, 3, 4) s
"""

_CTES["size_fact"] = f"""
SELECT s.line_item_id, s.line_item_name, s.order_id, s.order_name, s.advertiser_name,
       s.order_start_date, s.order_end_date, s.order_start_datetime, s.order_end_datetime,
       l.impressions AS line_item_total_impressions, l.clicks AS line_item_total_clicks, l.ctr AS line_item_ctr,
       l.line_item_priority, l.line_item_type_name, l.order_delivery_status_name,
       s.rendered_creative_size, s.device_category_name, s.impressions AS creative_size_impressions,
       s.clicks AS creative_size_clicks, s.ctr AS creative_size_ctr,
       {_ratio('s.impressions', 'l.impressions')} AS creative_size_share_of_line_item,
       h.reported_impressions AS order_reported_impressions, h.impression_goal,
       o.order_size_impressions, o.order_size_line_items, o.order_size_avg_impressions_per_line_item,
       {_ratio('o.order_size_impressions', 'h.reported_impressions')} AS size_share_of_order_delivery,
       {_ratio('o.order_size_impressions', 'h.impression_goal')} AS size_pct_of_order_goal
FROM size_roll s
LEFT JOIN item_roll l ON s.line_item_id = l.line_item_id
LEFT JOIN health h ON s.order_id = h.order_id
LEFT JOIN size_stats o ON s.order_id = o.order_id AND s.rendered_creative_size = o.rendered_creative_size
"""

_CTES["top_advertiser"] = """
SELECT advertiser_name FROM order_roll GROUP BY 1 ORDER BY sum(impressions) DESC, advertiser_name DESC LIMIT 1
"""

_CTES["top_order_label"] = f"""
SELECT {_label()} AS label FROM order_roll ORDER BY impressions DESC, order_id DESC LIMIT 1
"""

_CTES["top_line_item"] = """
SELECT line_item_name || ' (' || line_item_id || ')' AS label
FROM size_roll ORDER BY impressions DESC, line_item_id DESC LIMIT 1
"""

_CTES["top_club"] = """
SELECT club_display_name FROM club_tot ORDER BY total_club_impressions DESC, club_display_name DESC LIMIT 1
"""

_CTES["summary_base"] = f"""
SELECT *,
       CASE WHEN pacing_imps > 0 THEN weighted / CAST(pacing_imps AS DOUBLE) ELSE 0.0::DOUBLE END AS pace,
       coalesce({_ratio('imps_from_behind', 'club_total_impressions')}, 0.0::DOUBLE) AS at_risk_share
FROM (
  SELECT club_name, club_display_name,
         CAST(sum(club_delivered_impressions) AS BIGINT) AS club_total_impressions,
         count(DISTINCT order_id) AS active_orders,
         count(*) FILTER (is_urgent_order) AS urgent_orders,
         CAST(coalesce(sum(club_delivered_impressions) FILTER (order_pacing_status = 'behind'), 0) AS BIGINT) AS imps_from_behind,
         CAST(coalesce(sum(club_delivered_impressions) FILTER (order_pacing_status = 'on_track'), 0) AS BIGINT) AS imps_from_on_track,
         CAST(coalesce(sum(club_delivered_impressions) FILTER (order_pacing_status = 'ahead'), 0) AS BIGINT) AS imps_from_ahead,
         CAST(coalesce(sum(CAST(order_pacing_index AS DECIMAL(24,9)) * CAST(club_delivered_impressions AS DECIMAL(13,0))), 0) AS DOUBLE) AS weighted,
         CAST(coalesce(sum(club_delivered_impressions) FILTER (order_pacing_index IS NOT NULL), 0) AS BIGINT) AS pacing_imps
  FROM portfolio WHERE club_name IS NOT NULL AND club_display_name IS NOT NULL
  GROUP BY 1, 2) b
"""

_CTES["top_order"] = """
SELECT club_name, club_display_name, order_share_of_club_delivery AS top_order_share,
       order_pacing_status AS top_order_pacing_status, order_name AS top_order_name
FROM portfolio
QUALIFY row_number() OVER (PARTITION BY club_name, club_display_name
                           ORDER BY order_share_of_club_delivery DESC NULLS LAST, order_id) = 1
"""

_CTES["summary"] = """
SELECT b.club_name, b.club_display_name, club_total_impressions, active_orders, urgent_orders,
       imps_from_behind, imps_from_on_track, imps_from_ahead,
       round(weighted, 3) AS pacing_weighted_imps, pacing_imps,
       top_order_share, top_order_pacing_status, top_order_name,
       round(pace, 9) AS club_pacing_index, at_risk_share,
       CASE WHEN pace >= 0.95 AND at_risk_share <= 0.30 THEN 'healthy'
            WHEN pace < 0.80 OR at_risk_share > 0.60
                 OR (top_order_share > 0.50 AND top_order_pacing_status = 'behind') THEN 'at_risk'
            ELSE 'watch' END AS club_health_band
FROM summary_base b JOIN top_order t
  ON b.club_name = t.club_name AND b.club_display_name = t.club_display_name
"""

_CTES["mix"] = f"""
SELECT *, max(CASE WHEN order_pacing_status = 'behind' THEN impression_share ELSE 0.0::DOUBLE END)
            OVER (PARTITION BY club_display_name) AS behind_share
FROM (
  SELECT *, coalesce({_ratio('club_impressions', 'club_total')}, 0.0::DOUBLE) AS impression_share
  FROM (
    SELECT club_display_name, order_pacing_status,
           CAST(sum(club_delivered_impressions) AS BIGINT) AS club_impressions,
           CAST(sum(sum(club_delivered_impressions)) OVER (PARTITION BY club_display_name) AS BIGINT) AS club_total
    FROM portfolio WHERE club_display_name IS NOT NULL
    GROUP BY 1, 2) s) r
"""


def _order_share(rows: str) -> str:
    share = _ratio("p.club_delivered_impressions * 100", "t.total")
    return f"""
WITH_ROWS AS (
  SELECT p.club_display_name, p.order_name, p.advertiser_name, p.club_delivered_impressions,
         coalesce({share}, 0.0::DOUBLE) AS order_share_of_club
  FROM {rows} p
  LEFT JOIN (SELECT club_display_name, sum(club_delivered_impressions) AS total FROM {rows} GROUP BY 1) t
    ON p.club_display_name = t.club_display_name)
SELECT club_display_name, order_name, advertiser_name, club_delivered_impressions,
       round(order_share_of_club, 9) AS order_share_of_club FROM WITH_ROWS
UNION ALL
SELECT 'Total', '', '', CAST(coalesce(sum(club_delivered_impressions), 0) AS BIGINT),
       round(coalesce(sum(order_share_of_club), 0.0::DOUBLE), 9) FROM WITH_ROWS
"""


_CTES["portfolio_top_club"] = (
    "SELECT * FROM portfolio WHERE club_display_name = (SELECT club_display_name FROM top_club)"
)

_CTES["labelled_sizes"] = f"""
SELECT * REPLACE (nullif(trim(rendered_creative_size), '') AS rendered_creative_size),
       {_label()} AS order_label, line_item_name || ' (' || line_item_id || ')' AS line_item_label
FROM size_fact
"""

_CTES["selected_all"] = "SELECT * FROM labelled_sizes"
_CTES["selected_order"] = (
    "SELECT * FROM labelled_sizes WHERE order_label = (SELECT label FROM top_order_label)"
)
_CTES["selected_item"] = (
    "SELECT * FROM labelled_sizes WHERE line_item_label = (SELECT label FROM top_line_item)"
)
_CTES["selected_device"] = (
    "SELECT * FROM labelled_sizes WHERE device_category_name = 'R' "
    "AND advertiser_name = (SELECT advertiser_name FROM top_advertiser)"
)


def _size_share(selected: str, one_line_item: bool) -> str:
    item_total = "max(line_item_total_impressions) FILTER (rendered_creative_size IS NOT NULL)"
    imps = "coalesce(sum(creative_size_impressions) FILTER (rendered_creative_size IS NOT NULL), 0)"
    total = f"CASE WHEN {item_total} > 0 THEN {item_total} ELSE {imps} END" if one_line_item else imps
    order_columns = [
        "order_size_impressions", "order_size_line_items",
        "order_size_avg_impressions_per_line_item", "size_share_of_order_delivery",
        "size_pct_of_order_goal",
    ]
    maxima = ", ".join(f"max({c}) AS {c}" for c in order_columns)
    shown = ", ".join(f"CASE WHEN one_order THEN {c} END AS {c}" for c in order_columns)
    return f"""
SELECT rendered_creative_size, impressions, selection_line_items,
       round_even(CAST(impressions AS DOUBLE) / CAST(selection_line_items AS DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE
         AS selection_avg_impressions_per_line_item,
       {shown},
       CAST(impressions AS DOUBLE) / CAST(total AS DOUBLE) AS impressions_share,
       CASE WHEN one_order THEN size_share_of_order_delivery
            ELSE CAST(impressions AS DOUBLE) / CAST(total AS DOUBLE) END AS share
FROM (
  SELECT rendered_creative_size, CAST(sum(creative_size_impressions) AS BIGINT) AS impressions,
         count(DISTINCT line_item_id) AS selection_line_items, {maxima}
  FROM {selected} WHERE rendered_creative_size IS NOT NULL GROUP BY 1) g,
  (SELECT CAST({total} AS BIGINT) AS total, {imps} <> 0 AS delivered,
          count(DISTINCT order_id) = 1 AS one_order FROM {selected}) c
WHERE total > 0 AND delivered
"""


_CTES["share_all"] = _size_share("selected_all", False)

_DETAIL = f"""
SELECT line_item_id, line_item_name, domain_name, device_category_name, rendered_creative_size,
       line_item_type_name, {_thousands('line_item_total_impressions')} AS line_item_total_impressions,
       {_thousands('domain_impressions')} AS domain_impressions,
       CASE WHEN line_item_ctr IS NULL THEN '-'
            WHEN line_item_ctr <= 1 THEN format('{{:.2f}}%', line_item_ctr * 100.0::DOUBLE)
            ELSE format('{{:.2f}}%', line_item_ctr) END AS line_item_ctr
FROM diagnostics
"""

_SPOTLIGHT = (
    "SELECT order_id, order_name, advertiser_name, pacing_index, delivered_impressions, "
    "impression_goal, schedule_pct_elapsed FROM enriched WHERE pacing_index IS NOT NULL"
)
_CTES["spotlight_top"] = f"{_SPOTLIGHT} ORDER BY pacing_index DESC, order_id LIMIT 3"

_KPIS = """
SELECT count(*) AS active_orders,
       count(*) FILTER (lower(pacing_status) = 'behind') AS behind_orders,
       count(*) FILTER (lower(pacing_status) = 'on_track') AS on_track_orders,
       count(*) FILTER (lower(pacing_status) = 'ahead') AS ahead_orders,
       count(*) FILTER (lower(pacing_status) NOT IN ('behind', 'on_track', 'ahead')) AS other_orders,
       count(*) FILTER (is_urgent) AS urgent_orders,
       CASE WHEN sum(impression_goal) > 0
            THEN CAST(sum(delivered_impressions) * 100 AS DOUBLE) / CAST(sum(impression_goal) AS DOUBLE)
            ELSE 0.0::DOUBLE END AS overall_pct_goal
FROM enriched
"""

_ACTIVE = "order_delivery_status_name IN ('Started', 'Not started')"
_OVERLAP_ALL = (
    "schedule_start_date <= (SELECT max(schedule_end_date) FROM pacing) "
    "AND schedule_end_date >= (SELECT min(schedule_end_date) FROM pacing)"
)


def _preset(name: str, start: str, end: str) -> str:
    return f"""
SELECT '{name}' AS preset, CAST(greatest({start}, min(schedule_end_date)) AS DATE) AS range_start,
       CAST(least({end}, max(schedule_end_date)) AS DATE) AS range_end FROM pacing
"""


# The tables that the quality report runs on, by their name in the checks.
_CHECKED = {
    "delivery_report": "hashed",
    "domain_delivery": "domain_rows",
    "orders": "order_roll",
    "line_items": "item_roll",
    "size_rollup": "size_roll",
    "order_health": "health",
    "club_delivery": "club_fact",
    "line_item_diagnostics": "diagnostics",
    "order_pacing_summary": "pacing",
    "club_portfolio": "portfolio",
    "diagnostics_view": "diag_view",
    "creative_sizes": "size_fact",
    "partner_goals": "goals",
    "domain_clubs": "club_map",
}


def _check_sql(check) -> str:
    table, column = _CHECKED[check.table], check.column
    if check.kind == NOT_NULL:
        failures = f"SELECT count(*) FROM {table} WHERE {column} IS NULL"
    elif check.kind == UNIQUE:
        failures = (
            f"SELECT count(*) FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL "
            f"GROUP BY 1 HAVING count(*) > 1) u"
        )
    elif check.kind == RELATIONSHIPS:
        failures = (
            f"SELECT count(*) FROM {table} c WHERE {column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {_CHECKED[check.parent]} p WHERE p.{check.parent_column} = c.{column})"
        )
    else:
        values = ", ".join(f"'{v}'" for v in check.values)
        failures = f"SELECT count(*) FROM {table} WHERE {column} NOT IN ({values})"
    return (
        f"SELECT '{check.kind}' AS check_kind, '{check.table}' AS table_name, "
        f"'{column}' AS column_name, ({failures}) AS failures"
    )


_DISTINCT_HASHES = "SELECT DISTINCT * FROM hash_keys"

_FINAL: dict[str, str] = {
    "row_hash": f"SELECT {_REPORT_COLUMNS}, row_hash FROM hashed",
    "delivery_report_scan": f"SELECT {_REPORT_COLUMNS}, row_hash FROM hashed",
    "validate_report": "SELECT count(*) AS parsed_rows, count(*) AS validated_rows FROM raw",
    "load_replace": "SELECT * FROM hash_keys",
    "load_append": "SELECT * FROM hash_keys UNION ALL SELECT * FROM hash_keys",
    "load_upsert": _DISTINCT_HASHES,
    "upsert_new_rows": (
        "SELECT DISTINCT row_hash, order_id, line_item_id, ad_server_impressions FROM hashed "
        "WHERE row_hash NOT IN (SELECT row_hash FROM hashed WHERE order_delivery_status_name = 'Completed')"
    ),
    "streaming_upsert": _DISTINCT_HASHES,
    "latest_report_rows": (
        "SELECT order_delivery_status_name, count(*) AS report_rows FROM raw GROUP BY 1"
    ),
    "goal_seed_scan": "SELECT * FROM goals",
    "load_goal_seed": "SELECT * FROM goals",
    "domain_club_scan": "SELECT * FROM club_map",
    "domain_delivery_scan": "SELECT * FROM domain_rows",
    "mart_scan": (
        "SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(impression_goal AS DOUBLE) AS impression_goal, "
        "pacing_index, CAST(NULL AS DOUBLE) AS order_name, schedule_start_date, schedule_end_date, "
        "CAST(NULL AS DATE) AS pacing_status FROM pacing"
    ),
    "goal_edits": "SELECT * FROM edited_goals",
    "refresh_after_goal_edits": "SELECT * FROM edited_pacing",
    "build_all": "SELECT * FROM portfolio",
    "refresh_after_upsert": "SELECT * FROM portfolio",
    "build_aggregate_tables": "SELECT * FROM fact_table",
    "refresh_aggregate_tables": "SELECT * FROM fact_table",
    "order_rollup": "SELECT * FROM order_roll",
    "line_item_rollup": "SELECT * FROM item_roll",
    "creative_size_rollup": "SELECT * FROM size_roll",
    "line_items_table": "SELECT * FROM item_table",
    "orders_table": "SELECT * FROM order_tab",
    "delivery_facts": "SELECT * FROM fact_table",
    "order_health": "SELECT * FROM health",
    "order_pacing_summary": "SELECT * FROM pacing",
    "first_club_per_domain": (
        "SELECT lower(domain_name) AS domain_name, club_name, club_display_name FROM club_map"
    ),
    "club_order_agg": "SELECT * FROM club_orders",
    "club_totals": "SELECT * FROM club_tot",
    "club_delivery": "SELECT * FROM club_fact",
    "club_delivery_unmapped_kept": "SELECT * FROM some_fact",
    "club_portfolio": "SELECT * FROM portfolio",
    "line_item_diagnostics": "SELECT * FROM diagnostics",
    "diagnostics_view": "SELECT * FROM diag_view",
    "order_size_stats": "SELECT * FROM size_stats",
    "creative_sizes": "SELECT * FROM size_fact",
    "creative_sizes_view": "SELECT * FROM size_fact",
    "enrich_orders": (
        "SELECT order_id, order_label, days_to_end, is_ending_soon, is_urgent, pacing_status FROM enriched"
    ),
    "filter_orders": (
        "SELECT order_id, order_delivery_status_name, pacing_status FROM enriched "
        f"WHERE {_ACTIVE} AND {_OVERLAP_ALL}"
    ),
    "filter_orders_by_range": (
        "SELECT order_id, schedule_start_date, schedule_end_date FROM enriched "
        "WHERE schedule_start_date <= DATE '1998-06-15' AND schedule_end_date >= DATE '1998-05-01'"
    ),
    "filter_orders_by_all": (
        "SELECT order_id, advertiser_name, pacing_status, order_delivery_status_name FROM enriched "
        "WHERE advertiser_name = (SELECT advertiser_name FROM top_advertiser) AND pacing_status = 'behind' "
        f"AND order_delivery_status_name = 'Completed' AND {_OVERLAP_ALL}"
    ),
    "date_preset_range": " UNION ALL ".join(
        [
            _preset("past_7", f"{_AS_OF} - 6", _AS_OF),
            _preset("past_30", f"{_AS_OF} - 29", _AS_OF),
            _preset("year_to_date", f"date_trunc('year', {_AS_OF})", _AS_OF),
            "SELECT 'all' AS preset, min(schedule_end_date), max(schedule_end_date) FROM pacing",
        ]
    ),
    "filter_options": (
        "SELECT DISTINCT advertiser_name FROM pacing WHERE advertiser_name IS NOT NULL"
    ),
    "filter_options_status": (
        "SELECT DISTINCT pacing_status FROM pacing WHERE pacing_status IS NOT NULL"
    ),
    "order_kpis": _KPIS,
    "active_order_kpis": f"{_KPIS} WHERE {_ACTIVE}",
    "advertiser_vs_goal": f"""
SELECT *, {_ratio('delivered_impressions', 'impression_goal')} AS completion_rate FROM (
  SELECT advertiser_name, CAST(sum(coalesce(delivered_impressions, 0)) AS BIGINT) AS delivered_impressions,
         CAST(sum(coalesce(impression_goal, 0)) AS BIGINT) AS impression_goal
  FROM pacing WHERE advertiser_name IS NOT NULL GROUP BY 1) a
""",
    "order_pacing_list": f"""
SELECT order_id, order_label, coalesce(delivered_impressions, 0) AS delivered_impressions,
       coalesce(impression_goal, 0) AS impression_goal,
       {_ratio('delivered_impressions', 'impression_goal')} AS completion_rate,
       pacing_index, pacing_status, is_urgent,
       CASE WHEN is_urgent AND pacing_status = 'behind' THEN 'behind_urgent' ELSE pacing_status END AS pacing_urgency_band
FROM enriched
""",
    "order_table": f"""
SELECT CASE WHEN is_urgent THEN '{S.URGENCY_TEXT}' ELSE '' END AS urgency_flag,
       order_id, order_name, advertiser_name, order_delivery_status_name,
       schedule_start_date, schedule_end_date, impression_goal, delivered_impressions,
       {_percent_text('delivered_impressions_pct_of_goal')} AS delivered_impressions_pct_of_goal,
       {_percent_text('schedule_pct_elapsed')} AS schedule_pct_elapsed,
       format('{{:.2f}}', coalesce(pacing_index, 0.0::DOUBLE)) AS pacing_index
FROM enriched
""",
    "spotlight_bottom5": f"{_SPOTLIGHT} ORDER BY pacing_index, order_id LIMIT 5",
    "spotlight_top3": "SELECT * FROM spotlight_top",
    "spotlight_club_top3": (
        f"{_SPOTLIGHT} AND order_id IN (SELECT order_id FROM portfolio_top_club) "
        "ORDER BY pacing_index DESC, order_id LIMIT 3"
    ),
    "format_spotlight": f"""
SELECT order_name, advertiser_name, format('{{:.2f}}', pacing_index) AS pacing_index,
       {_thousands('delivered_impressions')} AS delivered_impressions,
       {_thousands('impression_goal')} AS impression_goal,
       {_percent_text('schedule_pct_elapsed')} AS schedule_pct_elapsed
FROM spotlight_top
""",
    "club_summary": "SELECT * FROM summary",
    "club_pacing_mix": "SELECT * FROM mix",
    "club_delivery_scale": (
        "SELECT club_display_name, CAST(sum(club_delivered_impressions) AS BIGINT) AS club_total "
        "FROM portfolio WHERE club_display_name IS NOT NULL GROUP BY 1"
    ),
    "urgent_clubs": (
        "SELECT club_name, club_display_name, urgent_orders FROM summary WHERE urgent_orders > 0"
    ),
    "club_drilldown": (
        "SELECT club_display_name, order_id, club_delivered_impressions, is_urgent_order FROM portfolio "
        "WHERE club_display_name IN (SELECT club_display_name FROM summary WHERE urgent_orders > 0)"
    ),
    "club_drilldown_by_club": (
        "SELECT club_display_name, advertiser_name, order_id FROM portfolio_top_club "
        "WHERE advertiser_name = (SELECT advertiser_name FROM top_advertiser)"
    ),
    "order_share_of_club": _order_share("portfolio"),
    "order_share_of_one_club": _order_share("portfolio_top_club"),
    "advertiser_club_mix": f"""
SELECT *, coalesce({_ratio('club_impressions', 'advertiser_total')}, 0.0::DOUBLE) AS share_of_advertiser FROM (
  SELECT advertiser_name, club_display_name,
         CAST(sum(club_delivered_impressions) AS BIGINT) AS club_impressions,
         CAST(sum(sum(club_delivered_impressions)) OVER (PARTITION BY advertiser_name) AS BIGINT) AS advertiser_total
  FROM portfolio GROUP BY 1, 2) m
""",
    "creative_size_share": "SELECT * FROM share_all",
    "creative_size_share_of_order": _size_share("selected_order", False),
    "creative_size_share_of_line_item": _size_share("selected_item", True),
    "creative_size_share_of_device": _size_share("selected_device", False),
    "validate_size_shares": """
SELECT round(coalesce(sum(share), 0.0::DOUBLE), 9) AS share_sum,
       abs(coalesce(sum(share), 0) - 1) <= 0.001 * greatest(coalesce(sum(share), 0), 1) AS sums_to_one,
       (SELECT count(*) FROM selected_all WHERE rendered_creative_size IS NULL) AS dropped_rows
FROM share_all
""",
    "line_item_detail": _DETAIL,
    "line_item_detail_of_order": (
        f"{_DETAIL} WHERE {_label()} = (SELECT label FROM top_order_label)"
    ),
    "store_upsert": _DISTINCT_HASHES,
    "failing_checks": """
SELECT 'not_null' AS check_kind, 'delivery_report' AS table_name, 'rendered_creative_size' AS column_name,
       count(*) AS failures FROM raw WHERE rendered_creative_size IS NULL
UNION ALL
SELECT 'unique', 'delivery_report', 'line_item_id', count(*)
FROM (SELECT line_item_id FROM raw GROUP BY 1 HAVING count(*) > 1) u
UNION ALL
SELECT 'relationships', 'delivery_report', 'order_id', count(*) FROM raw
WHERE order_id NOT IN (SELECT order_id FROM order_roll WHERE order_delivery_status_name = 'Started')
UNION ALL
SELECT 'accepted_values', 'delivery_report', 'device_category_name', count(*) FROM raw
WHERE device_category_name NOT IN ('R', 'N')
""",
    "quality_report": " UNION ALL ".join(_check_sql(c) for c in declared_checks(CLUBS)),
}


def _needed(sql: str) -> list[str]:
    """Names of the expressions a statement uses, each after those it depends on."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if name in _CTES and name not in order:
                visit(_CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def _statement(sql: str) -> str:
    ctes = [f"{name} AS ({_CTES[name]})" for name in _needed(sql)]
    body = sql.strip()
    if body.startswith("WITH_ROWS AS"):
        head, _, body = body.partition("\nSELECT club_display_name, order_name")
        ctes.append(head)
        body = "SELECT club_display_name, order_name" + body
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + body


def statements() -> dict[str, str]:
    """All statements by query name."""
    return {name: _statement(sql) for name, sql in _FINAL.items()}
