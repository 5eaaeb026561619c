"""Data checks and the warehouse plan."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from adpace.operators import quality as Q
from adpace.operators.rollups import orders_table
from adpace.plans import checks, warehouse
from adpace.plans.checks import TABLE_CONSTRAINTS, declared_checks
from adpace.scratch import work_dir
from tests import fixtures as X


def outcome(df):
    return {(r.check_kind, r.column_name): r.failures for r in df.collect()}


def test_each_kind_counts_failures(spark):
    child = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (None, None), (None, "a"), (9, "a"), (9, "a")],
        "k bigint, v string",
    )
    parent = spark.createDataFrame([(1,), (2,), (2,)], "k bigint")
    got = outcome(
        Q.run_checks(
            {"child": child, "parent": parent},
            [
                Q.Check(Q.NOT_NULL, "child", "k"),
                Q.Check(Q.NOT_NULL, "child", "v"),
                Q.Check(Q.UNIQUE, "child", "k"),
                Q.Check(Q.RELATIONSHIPS, "child", "k", parent="parent", parent_column="k"),
                Q.Check(Q.ACCEPTED_VALUES, "child", "v", values=("a", "b")),
            ],
        )
    )
    assert got == {
        (Q.NOT_NULL, "k"): 2, (Q.NOT_NULL, "v"): 1, (Q.UNIQUE, "k"): 2,
        (Q.RELATIONSHIPS, "k"): 2, (Q.ACCEPTED_VALUES, "v"): 1,
    }


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="nothing"):
        Q.run_checks({"t": spark.range(1)}, [Q.Check(Q.NOT_NULL, "t", "nothing")])


def test_declared_checks_by_kind():
    kinds = [c.kind for c in declared_checks()]
    assert len(kinds) == 61
    assert {k: kinds.count(k) for k in set(kinds)} == {
        Q.NOT_NULL: 41, Q.UNIQUE: 6, Q.RELATIONSHIPS: 9, Q.ACCEPTED_VALUES: 5,
    }


def sample_inputs(spark):
    return warehouse.Inputs(
        X.sample_report(spark), X.sample_goals(spark), X.sample_domains(spark), X.sample_clubs(spark)
    )


def test_sample_warehouse_passes_all_checks(spark):
    inputs, root = sample_inputs(spark), work_dir(spark, "warehouse")
    tables = warehouse.build_all(inputs, "2025-04-20", root, register_views=True)
    assert spark.table("club_portfolio").count() == 5
    reopened = warehouse.open_warehouse(spark, root, "2025-04-20")
    assert set(reopened) == set(tables) - {"orders", "line_items", "size_rollup"}
    assert reopened["creative_sizes_view"].count() == 5
    tables |= {
        "delivery_report": inputs.delivery, "domain_delivery": inputs.domains,
        "partner_goals": inputs.goals, "domain_clubs": inputs.clubs,
    }
    clubs = [r[9] for r in X.SAMPLE]
    results = Q.run_checks(tables, declared_checks(clubs)).collect()
    assert len(results) == 61
    assert [r for r in results if r.failures] == []


def test_goal_edits_rebuild_the_marts(spark):
    root = work_dir(spark, "warehouse")
    edits = spark.createDataFrame(
        [("ORDER 1001", "advertiser 1001", 125000)],
        "order_name string, advertiser_name string, new_goal bigint",
    )
    tables = warehouse.refresh_after_goal_edits(
        sample_inputs(spark), edits, f"{root}/goals", "2025-04-20", root
    )
    got = X.by(tables["order_pacing_summary"], "order_id")
    assert (got[1001].impression_goal, got[1001].pacing_status) == (125000, "on_track")
    assert got[1002].pacing_status == "behind"
    # From the rollups of that build the same follows without the report.
    inputs = sample_inputs(spark)
    inputs = replace(inputs, delivery=inputs.delivery.filter("CAST(raise_error('read') AS BOOLEAN)"))
    again = warehouse.refresh_after_goal_edits(
        inputs, edits, f"{root}/goals-again", "2025-04-20", f"{root}/again", built=root
    )
    assert X.by(again["order_pacing_summary"], "order_id") == got


def test_aggregate_tables_and_their_constraints(spark):
    raw = X.report(spark, dict(order_id=1), dict(order_id=1, line_item_id=11), dict(order_id=2))
    tables = warehouse.build_aggregate_tables(raw, work_dir(spark, "warehouse"))
    assert {n: t.count() for n, t in tables.items()} == {
        "orders_table": 2, "line_items_table": 3, "delivery_facts": 3,
    }
    assert set(TABLE_CONSTRAINTS) == set(warehouse.STORED_AGGREGATES)
    unnamed = X.report(spark, dict(order_id=1, advertiser_name=None))
    with pytest.raises(ValueError, match="orders_table violates not_null.advertiser_name.: 1"):
        warehouse.build_aggregate_tables(unnamed, work_dir(spark, "warehouse"))
    twice = orders_table(raw).unionByName(orders_table(raw))
    with pytest.raises(ValueError, match="unique.order_id.: 2"):
        Q.enforce(twice, "orders_table", *checks.TABLE_CONSTRAINTS["orders_table"])


def test_every_table_is_scanned_once(spark, tmp_path):
    from adpace.operators import quality as Q

    spark.range(50).selectExpr("id AS a_id", "id % 7 AS b_ref", "CAST(NULL AS string) AS note").write.parquet(f"{tmp_path}/a")
    spark.range(5).selectExpr("id AS b_id", "'x' AS kind").write.parquet(f"{tmp_path}/b")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in "ab"}
    checks = [
        Q.Check(Q.NOT_NULL, "a", "note"), Q.Check(Q.UNIQUE, "a", "a_id"), Q.Check(Q.UNIQUE, "a", "b_ref"),
        Q.Check(Q.RELATIONSHIPS, "a", "b_ref", "b", "b_id"), Q.Check(Q.ACCEPTED_VALUES, "b", "kind", values=("x",)),
        Q.Check(Q.UNIQUE, "b", "b_id"),
    ]
    result = Q.run_checks(tables, checks)
    got = {(r.check_kind, r.column_name): r.failures for r in result.collect()}
    assert got == {
        ("not_null", "note"): 50, ("unique", "a_id"): 0, ("unique", "b_ref"): 7,
        ("relationships", "b_ref"): 14, ("accepted_values", "kind"): 0, ("unique", "b_id"): 0,
    }
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for n in "ab":
        assert plan.count(f"{tmp_path}/{n}]") == 1


def test_facts_in_slices_equal_whole_ones(spark, monkeypatch):
    """Facts built in slices by order hold the same rows, those without an order included."""
    loose = X.report(spark, *[dict(order_id=i % 40, line_item_id=i) for i in range(200)])
    loose = loose.withColumn("order_id", F.when(F.col("line_item_id") % 9 > 0, F.col("order_id")))
    domains = X.sample_domains(spark)
    no_order = domains.limit(1).withColumn("order_id", F.lit(None).cast("bigint"))
    inputs = warehouse.Inputs(
        X.sample_report(spark).unionByName(loose), X.sample_goals(spark),
        domains.unionByName(no_order), X.sample_clubs(spark),
    )
    whole = warehouse.build_all(inputs, "2025-11-13", work_dir(spark, "whole"))
    monkeypatch.setattr(warehouse, "SLICE_ROWS", 10)
    slices, cut = [], warehouse.order_slices
    monkeypatch.setattr(warehouse, "order_slices", lambda *a: slices.extend(cut(*a)) or slices)
    sliced = warehouse.build_all(inputs, "2025-11-13", work_dir(spark, "sliced"))
    assert len(slices) > 4
    for name in warehouse.FACTS:
        rows = lambda t: Counter(map(str, t[name].collect()))
        assert rows(whole) == rows(sliced) and sum(rows(whole).values()) > 0, name
    assert None in {r.order_id for r in sliced["creative_sizes"].collect()}
    assert None in {r.order_id for r in sliced["line_item_diagnostics"].collect()}
