"""Small inputs: five orders, one per club, and builders for edge rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from adpace import schema as S
from adpace.sources.delivery import with_row_hash


def day(text: str | None) -> dt.date | None:
    return dt.date.fromisoformat(text) if text else None


def at(text: str | None) -> dt.datetime | None:
    return dt.datetime.fromisoformat(text) if text else None


# Order, start, end, line item, size, device, impressions, clicks, goal, club.
SAMPLE = [
    (1001, "2025-01-01", "2025-01-15", 20001, "970x250", "Desktop", 125000, 1500, 500000, "league"),
    (1002, "2025-02-01", "2025-02-20", 20002, "300x250", "Mobile", 95000, 1200, 150000, "rabbit"),
    (1003, "2025-03-01", "2025-03-31", 20003, "300x600", "Desktop", 160000, 2100, 200000, "lion"),
    (1004, "2025-04-10", "2025-04-30", 20004, "1920x1080", "CTV", 60000, 800, 100000, "eagle"),
    (1005, "2025-05-01", "2025-05-20", 20005, "native", "Cross-device", 55000, 700, 80000, "giants"),
]


def report_row(**values) -> dict:
    """A report row with defaults for everything not given."""
    order = values.get("order_id", 1)
    item = values.get("line_item_id", order * 10)
    row = {
        "order_id": order,
        "order_name": f"Order {order}",
        "order_start_date": day("2025-01-01"),
        "order_end_date": day("2025-01-31"),
        "line_item_id": item,
        "line_item_name": f"Item {item}",
        "line_item_start_date": day("2025-01-01"),
        "line_item_end_date": day("2025-01-31"),
        "line_item_primary_goal_units_absolute": 100,
        "line_item_primary_goal_unit_type_name": "IMPRESSIONS",
        "line_item_lifetime_impressions": 1000,
        "line_item_lifetime_clicks": 10,
        "order_lifetime_clicks": 10,
        "order_lifetime_impressions": 1000,
        "line_item_delivery_indicator": Decimal("0.5"),
        "creative_name": "Banner",
        "rendered_creative_size": "300x250",
        "device_category_name": "Desktop",
        "line_item_priority": 8,
        "line_item_type_name": "STANDARD",
        "order_delivery_status_name": "Started",
        "advertiser_name": f"Advertiser {order}",
        "ad_server_impressions": 100,
        "ad_server_clicks": 1,
        "ad_server_ctr": Decimal("0.01"),
    } | values
    for name in ("order_start_date", "order_end_date", "line_item_start_date", "line_item_end_date"):
        if isinstance(row[name], str):
            row[name] = day(row[name])
        moment = dt.datetime.combine(row[name], dt.time()) if row[name] else None
        row.setdefault(f"{name}_time", moment)
    return row


def report(spark: SparkSession, *rows: dict) -> DataFrame:
    full = [report_row(**r) for r in rows]
    data = [tuple(r[c] for c in S.DELIVERY_COLUMNS) for r in full]
    return with_row_hash(spark.createDataFrame(data, S.DELIVERY_SCHEMA))


def domain_rows(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Rows of (order, line item, domain, impressions) with the default names."""
    data = [
        (o, f"Order {o}", i, f"Item {i}", f"Advertiser {o}", d, n) for o, i, d, n in rows
    ]
    return spark.createDataFrame(data, S.DOMAIN_DELIVERY_SCHEMA)


def club_map(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), S.text_struct(S.DOMAIN_CLUB_COLUMNS))


def goals(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Rows of (order, goal) with the default names in other cases."""
    data = [(f"ORDER {o}", f"advertiser {o}", g) for o, g in rows]
    return spark.createDataFrame(data, "order_name string, advertiser_name string, impression_goal bigint")


def sample_report(spark: SparkSession) -> DataFrame:
    return report(
        spark,
        *[
            dict(
                order_id=o, order_start_date=s, order_end_date=e, line_item_id=i,
                rendered_creative_size=size, device_category_name=device,
                ad_server_impressions=imps, ad_server_clicks=clicks,
                line_item_lifetime_impressions=imps,
                order_delivery_status_name="DELIVERING",
            )
            for o, s, e, i, size, device, imps, clicks, _, _ in SAMPLE
        ],
    )


def sample_goals(spark: SparkSession) -> DataFrame:
    return goals(spark, *[(r[0], r[8]) for r in SAMPLE])


def sample_domains(spark: SparkSession) -> DataFrame:
    return domain_rows(spark, *[(r[0], r[3], f"{r[9]}.COM", r[6]) for r in SAMPLE])


def sample_clubs(spark: SparkSession) -> DataFrame:
    return club_map(spark, *[(f"{r[9]}.com", r[9], f"Team {r[9]}") for r in SAMPLE])


def by(df: DataFrame, key: str) -> dict:
    return {row[key]: row for row in df.collect()}
