"""Physical plans: what must hold when no side is small enough to broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from adpace.operators import clubs as C
from adpace.operators import facts, rollups
from adpace.operators import orders as O
from adpace.plans import warehouse
from adpace.scratch import work_dir
from adpace.sources import retail
from adpace.sources.tables import read_mart
from registry.queries import queries
from tests.fixtures import (
    club_map,
    goals,
    report,
    sample_clubs,
    sample_domains,
    sample_goals,
    sample_report,
)

SF_DIR = "/root/testdata/sf0.001"
# Queries that run loads before they return; their plans only read a table.
LOADING = re.compile(r"scan|load_|stream|latest|validate_report|build|refresh|quality|store|goal_seed")
LAZY = [name for name in queries() if not LOADING.search(name)]
# Windows here run over groups that are already one row per status or club.
SMALL_WINDOWS = {"club_pacing_mix", "advertiser_club_mix"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LAZY)
def test_joins_are_keyed_and_nothing_leaves_the_jvm(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "NestedLoop", "Broadcast", "Python", "Arrow"):
        assert unwanted not in text, unwanted
    if name not in SMALL_WINDOWS:
        assert "Window" not in text


def test_rollups_combine_before_their_only_shuffle(spark):
    raw = retail.delivery(spark, SF_DIR)
    stored = work_dir(spark, "raw")
    raw.write.parquet(stored)
    raw = spark.read.parquet(stored)
    for rollup in (
        rollups.order_rollup, rollups.line_item_rollup, rollups.creative_size_rollup,
        rollups.orders_table, rollups.line_items_table, rollups.delivery_facts,
    ):
        text = plan(rollup(raw))
        assert text.count("Exchange") == 1
        assert "partial_sum" in text.split("Exchange")[1]


def test_filters_and_columns_reach_the_mart_scan(spark):
    inputs = warehouse.Inputs(
        sample_report(spark), sample_goals(spark), sample_domains(spark), sample_clubs(spark)
    )
    root = work_dir(spark, "warehouse")
    warehouse.build_facts(inputs, "2025-04-20", root)
    orders = warehouse.open_warehouse(spark, root, "2025-04-20")["order_pacing_summary"]
    chosen = O.filter_orders(
        orders, advertiser="Advertiser 1001", date_range=("2025-01-01", "2025-02-01")
    ).select("order_id")
    text = plan(chosen)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text, re.S).group(1)
    for part in ("EqualTo(advertiser_name", "In(order_delivery_status_name", "schedule_start_date"):
        assert part in pushed
    schema = re.search(r"ReadSchema: struct<(.*)", text).group(1)
    assert "reported_impressions" not in schema
    portfolio = read_mart(spark, root, "club_delivery")
    assert "EqualTo(club_display_name,Team eagle)" in plan(C.filter_club(portfolio, "Team eagle"))


def test_a_hot_order_is_split_and_the_result_stays_whole(spark):
    """A third of all rows in one order, with adaptive limits scaled down to them."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(30000).withColumn(
            "order_id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
        )
        hot = ids.select(
            "order_id", F.concat(F.lit("n"), "order_id").alias("order_name"),
            F.col("id").alias("line_item_id"), F.lit("l").alias("line_item_name"),
            F.lit("A").alias("advertiser_name"), F.lit("a.com").alias("domain_name"),
            F.lit(1).cast("bigint").alias("ad_server_impressions"),
        )
        stored = work_dir(spark, "hot")
        hot.repartition(8).write.parquet(stored)
        hot = spark.read.parquet(stored)
        raw = report(spark, dict(order_id=7, advertiser_name="A"))
        health = facts.order_health(rollups.order_rollup(raw), goals(spark, (7, 10)), "2025-01-20")
        clubs = club_map(spark, ("A.com", "a", "Club A"))
        diagnostics = facts.line_item_diagnostics(
            hot, rollups.line_item_rollup(raw), clubs, health
        )
        assert len(diagnostics.collect()) == 30000
        assert "skew=true" in plan(diagnostics)
        club = facts.club_delivery(hot, clubs, health)
        summary = C.club_summary(
            warehouse.marts.club_portfolio(club, "2025-01-20")
        ).first()
        assert summary.club_total_impressions == 30000
        assert summary.active_orders == hot.select("order_id").distinct().count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_hot_clubs_and_domains_are_split(spark):
    """Nine tenths of all rows in one domain and one club, without broadcasts."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(40000)
        cold = F.col("id") % 10 == 0
        rows = ids.select(
            F.col("id").alias("order_id"), F.concat(F.lit("n"), "id").alias("order_name"),
            F.col("id").alias("line_item_id"), F.lit("l").alias("line_item_name"), F.lit("A").alias("advertiser_name"),
            F.when(cold, F.concat(F.lit("d"), F.col("id") % 50)).otherwise("a.com").alias("domain_name"),
            F.lit(1).cast("bigint").alias("ad_server_impressions"),
        )
        stored = work_dir(spark, "hot-club")
        rows.repartition(8).write.parquet(stored)
        names = [("A.com", "a", "Club A")] + [(f"d{i}", f"c{i}", f"Club {i}") for i in range(0, 50, 10)]
        domains = facts.domains_with_clubs(spark.read.parquet(stored), club_map(spark, *names))
        assert len(domains.collect()) == 40000
        assert "skew=true" in plan(domains)
        cold = F.col("order_id") % 10 == 0
        portfolio = rows.select(
            "order_id", "order_name", "advertiser_name",
            F.when(cold, F.concat(F.lit("Club "), F.col("order_id") % 50)).otherwise("Club A").alias("club_display_name"),
            F.col("ad_server_impressions").alias("club_delivered_impressions"),
            F.when(cold, F.lit("c")).otherwise("a").alias("club_name"), (~cold).alias("is_urgent_order"),
        )
        folder = work_dir(spark, "hot-portfolio")
        portfolio.repartition(8).write.parquet(folder)
        portfolio = spark.read.parquet(folder)
        shares = C.order_share_of_club(portfolio)
        assert len(shares.collect()) == 40001
        assert "skew=true" in plan(shares)
        urgent = C.club_drilldown(portfolio, urgent_only=True)
        assert len(urgent.collect()) == 36000
        assert "skew=true" in plan(urgent)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_clustered_facts_let_a_selective_filter_skip_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).selectExpr(
            "concat('Advertiser ', cast(id % 40 AS string)) AS advertiser_name", "id AS order_id", "id * 2 AS impressions"
        )
        path = str(tmp_path / "order_health")
        warehouse.clustered(rows, "order_health").write.parquet(path)
        chosen = spark.read.parquet(path).filter(F.col("advertiser_name") == "Advertiser 7")
        assert chosen.count() == 100
        chosen.collect()
        leaves = chosen._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName()]
        read = scans[0].metrics().apply("numOutputRows").value()
        assert read <= 4000 / 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_report_rows_lie_by_order(spark, tmp_path):
    """Items meet the orders after part and customer: one more shuffle of wide rows is not planned."""
    from adpace.sources import retail

    for name, ddl in retail.SCHEMAS.items():
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = retail.delivery(spark, str(tmp_path)).groupBy("order_id").count()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Items and part by part, orders and customer by customer, both sides by order: the rollup adds none.
    assert plan.count("Exchange hashpartitioning") == 6
