"""Report rows by order: what is computed where they lie equals what the general way gives."""

import pytest
from pyspark.sql import functions as F

from adpace.operators import facts, rollups
from adpace.operators.placement import rows_by_order
from adpace.scratch import ALL_JOIN_KEYS, placed_joins
from registry.queries import queries
from tests import fixtures as X


def rows(spark):
    plain = [
        dict(order_id=o, line_item_id=o * 100 + i, rendered_creative_size=size, ad_server_impressions=o * i + n)
        for o in range(1, 20) for i in range(1, 4) for n, size in enumerate(("a", "b", "a", None, " "))
    ]
    odd = [
        # One line item in three orders, another without an order and in one.
        *(dict(order_id=o, line_item_id=7, rendered_creative_size=s) for o, s in ((1, "a"), (2, "b"), (3, "a"))),
        dict(order_id=4, line_item_id=8), dict(order_id=0, line_item_id=8, order_name="n", advertiser_name="n"),
        # Without a line item, an order or both; another name for an order.
        dict(order_id=5, line_item_id=0, line_item_name="n"), dict(order_id=6, line_item_id=0, line_item_name="m"),
        dict(order_id=0, line_item_id=9, order_name="n", advertiser_name="n"),
        dict(order_id=0, line_item_id=0, order_name="n", advertiser_name="n", line_item_name="n"),
        dict(order_id=10, line_item_id=1099, rendered_creative_size="a", order_name="Renamed"),
        *[dict(order_id=11, line_item_id=1101, rendered_creative_size="c")] * 30,
    ]
    made = X.report(spark, *plain, *odd).drop("row_hash")
    return made.withColumns({c: F.nullif(c, F.lit(0)) for c in ("order_id", "line_item_id")})


def multiset(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("limit", ["10MB", "-1"])
@pytest.mark.parametrize("about", [1, 2_000_000])
def test_creative_sizes_by_order_equal_those_of_all_rows(spark, limit, about):
    raw = rows(spark)
    known = facts.order_health(rollups.order_rollup(raw), X.goals(spark, (1, 400), (10, 50)), "2025-01-31")
    wanted = multiset(facts.creative_sizes(rollups.creative_size_rollup(raw), rollups.line_item_rollup(raw), known))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        parts = rows_by_order(raw, about, order_rows=30)
        assert multiset(parts.closed.unionByName(parts.others)) == multiset(raw)
        orders = {r.order_id for r in parts.closed.select("order_id").distinct().collect()}
        assert orders == {*range(7, 20)} - {11}
        with placed_joins(spark):
            got = [
                row for part, by_order in ((parts.closed, True), (parts.others, False))
                for row in facts.creative_sizes(
                    rollups.creative_size_rollup(part, by_order),
                    rollups.line_item_rollup(part, by_order, facts.SIZE_ITEM_COLUMNS), known, by_order,
                ).collect()
            ]
        assert sorted(map(repr, got)) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_diagnostics_by_order_equal_those_of_all_rows(spark, limit):
    raw = rows(spark)
    known = facts.order_health(
        rollups.order_rollup(raw), X.goals(spark, (1, 400), (10, 50), (12, 5), (12, 6)), "2025-01-31"
    )
    listed = [(o, o * 100 + i, "A.com", o) for o in range(1, 25) for i in range(1, 5)]
    listed += [(1, 7, "b.com", 1), (3, 7, "a.com", 2), (12, 1301, "a.com", 3), (0, 9, "a.com", 4), (13, 0, "a.com", 5)]
    made = X.domain_rows(spark, *listed)
    domains = made.withColumns({
        **{c: F.nullif(c, F.lit(0)) for c in ("order_id", "line_item_id")},
        "advertiser_name": F.when(F.col("order_id") == 14, "Another").otherwise(F.col("advertiser_name")),
    })
    clubs = X.club_map(spark, ("a.com", "a", "Club A"), ("A.com", "b", "Club B"))
    wanted = facts.line_item_diagnostics(domains, rollups.line_item_rollup(raw), clubs, known)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        parts = rows_by_order(raw, order_rows=30)
        got = []
        for part, kept, by_order in ((parts.closed, "left_anti", True), (parts.others, "left_semi", False)):
            line_items = rollups.line_item_rollup(part, by_order, facts.DIAGNOSTIC_ITEM_COLUMNS)
            mine = domains.join(parts.open_orders, "order_id", kept).select(*domains.columns)
            got += facts.line_item_diagnostics(mine, line_items, clubs, known, by_order).collect()
        assert sorted(map(repr, got)) == multiset(wanted)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_line_items_meet_domain_rows_by_the_order_alone(spark):
    text = queries()["diagnostics_view"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scan = text.index("Bucketed: true")
    assert "hashpartitioning(line_item_id" not in text[:scan]
    assert "_item_order" not in "".join(line for line in text.splitlines() if "Exchange" in line)


def test_rows_that_lie_by_order_do_not_shuffle_again(spark):
    raw = rows(spark)
    closed = rows_by_order(raw, 1).closed
    health = spark.range(5).select(
        F.col("id").alias("order_id"), F.col("id").alias("reported_impressions"), F.col("id").alias("impression_goal")
    )
    with placed_joins(spark):
        fact = facts.creative_sizes(
            rollups.creative_size_rollup(closed, True), rollups.line_item_rollup(closed, True), health, True
        )
        text = fact._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text
    for column in ("line_item_id", "rendered_creative_size", "order_name"):
        assert f"Exchange hashpartitioning({column}" not in text
    assert text.count("Exchange hashpartitioning(") <= 1
    assert spark.conf.get(ALL_JOIN_KEYS) == "true"


def test_creative_sizes_leave_no_table_behind(spark):
    tables = {t.name for t in spark.catalog.listTables()}
    assert queries()["creative_sizes"](spark, "/root/testdata/sf0.001").count() > 0
    assert {t.name for t in spark.catalog.listTables()} == tables
