"""The delivery model over an order / line-item retail star schema.

Maps the tables ``orders lineitem customer part supplier nation`` onto the four
inputs of the library, so that every operator can run on data of any scale
factor. Only lossless mappings are used: each line item becomes a report row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpace import schema as S

AS_OF = "1998-06-15"

# The columns that the mapping reads; a given schema needs no inference job.
SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_name string",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int",
}

_ORDER_START = "CAST(o_orderdate AS DATE)"
_ORDER_END = f"date_add({_ORDER_START}, CAST(o_orderkey % 45 AS INT))"
_ITEM = "l_orderkey * 10 + l_linenumber"
_ITEM_END = f"greatest({_ORDER_START}, CAST(l_shipdate AS DATE))"

_DELIVERY = {
    "order_id": "o_orderkey",
    "order_name": "concat('Order ', o_orderkey)",
    "order_start_date": _ORDER_START,
    "order_start_date_time": f"CAST({_ORDER_START} AS TIMESTAMP_NTZ)",
    "order_end_date": _ORDER_END,
    "order_end_date_time": f"CAST({_ORDER_END} AS TIMESTAMP_NTZ)",
    "line_item_id": _ITEM,
    "line_item_name": f"concat('Line ', {_ITEM})",
    "line_item_start_date": _ORDER_START,
    "line_item_start_date_time": f"CAST({_ORDER_START} AS TIMESTAMP_NTZ)",
    "line_item_end_date": _ITEM_END,
    "line_item_end_date_time": f"CAST({_ITEM_END} AS TIMESTAMP_NTZ)",
    "line_item_primary_goal_units_absolute": "CAST(floor(l_extendedprice / 10) AS BIGINT)",
    "line_item_primary_goal_unit_type_name": "'IMPRESSIONS'",
    "line_item_lifetime_impressions": "CAST(floor(l_extendedprice * 2) AS BIGINT)",
    "line_item_lifetime_clicks": "CAST(floor(l_quantity) AS BIGINT) * 2",
    "order_lifetime_clicks": "CAST(floor(o_totalprice / 1000) AS BIGINT)",
    "order_lifetime_impressions": "CAST(floor(o_totalprice) AS BIGINT)",
    "line_item_delivery_indicator": "CAST(l_discount AS DECIMAL(10,4))",
    "creative_name": "p_name",
    "rendered_creative_size": (
        "CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 7 = 0 THEN '  ' ELSE p_type END"
    ),
    "device_category_name": "l_returnflag",
    "line_item_priority": "l_linenumber",
    "line_item_type_name": "if(l_linestatus = 'O', 'STANDARD', 'SPONSORSHIP')",
    "order_delivery_status_name": (
        "CASE o_orderstatus WHEN 'P' THEN 'Started' WHEN 'O' THEN 'Not started' "
        "ELSE 'Completed' END"
    ),
    "advertiser_name": "c_name",
    "ad_server_impressions": "CAST(floor(l_extendedprice) AS BIGINT)",
    "ad_server_clicks": "CAST(floor(l_quantity) AS BIGINT)",
    "ad_server_ctr": "CAST(l_tax AS DECIMAL(10,4))",
}
_PART_COLUMNS = {"creative_name", "rendered_creative_size"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (table(spark, sf_dir, n) for n in ("orders", "customer"))
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"])


def delivery(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """Raw report rows. ``part`` is joined only if a creative column is asked for;
    its key is unique and complete, so leaving it out changes no row.

    Items meet their part while they are narrow and orders their customer while they are few,
    so the one shuffle of wide rows is by order, and rollups by order need no further one."""
    wanted = list(columns or S.DELIVERY_COLUMNS)
    items = table(spark, sf_dir, "lineitem")
    if _PART_COLUMNS & set(wanted):
        part = table(spark, sf_dir, "part")
        items = items.join(part, items["l_partkey"] == part["p_partkey"])
    rows = items.join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return _project(rows, {c: _DELIVERY[c] for c in wanted})


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracted goals: every order but the low-priority ones, which have none."""
    return _project(
        _orders(spark, sf_dir).filter("o_orderpriority <> '5-LOW'"),
        {
            "order_name": "concat('ORDER ', o_orderkey)",
            "advertiser_name": "c_name",
            "impression_goal": (
                "CAST(if(o_totalprice < 5000, 0, floor(o_totalprice)) AS BIGINT)"
            ),
        },
    )


def domain_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions per (order, line item, domain), with a heavy tail of large orders."""
    items, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "supplier"))
    domain = "concat('nation_', s_nationkey, '.com')"
    per_domain = (
        _project(
            items.join(supplier, items["l_suppkey"] == supplier["s_suppkey"]),
            {
                "order_id": "l_orderkey",
                "line_item_id": _ITEM,
                "domain_name": f"if(l_linenumber % 2 = 1, upper({domain}), {domain})",
                "impressions": (
                    "CAST(floor(l_extendedprice * 0.5D) AS BIGINT) "
                    "* if(l_orderkey % 1000 = 7, 20000, 1)"
                ),
            },
        )
        .groupBy("order_id", "line_item_id", "domain_name")
        .sum("impressions")
    )
    orders = _orders(spark, sf_dir)
    named = per_domain.join(orders, per_domain["order_id"] == orders["o_orderkey"])
    mapping = {
        "order_id": "order_id",
        "order_name": "concat('Order ', order_id)",
        "line_item_id": "line_item_id",
        "line_item_name": "concat('Line ', line_item_id)",
        "advertiser_name": "c_name",
        "domain_name": "domain_name",
        "ad_server_impressions": "`sum(impressions)`",
    }
    return _project(named, {n: mapping[n] for n, _ in S.DOMAIN_DELIVERY_FIELDS})


def domain_clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain to club map: one domain per nation, twelve clubs."""
    return _project(
        table(spark, sf_dir, "nation"),
        {
            "domain_name": "concat('nation_', n_nationkey, '.com')",
            "club_name": "concat('club_', n_nationkey % 12)",
            "club_display_name": (
                "if(n_nationkey % 12 = 0, 'Sports league', concat('Club ', n_nationkey % 12))"
            ),
        },
    )
